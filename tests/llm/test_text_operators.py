"""Text operators against brute force, on small frames with every awkward case."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from lumenlake.llm import (
    components, lattice_dedup, license_scan, line_templates, piece_codec, quality_rules, simhash, source_mix, suffix_dedup,
    token_counts, toxicity,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
# Nulls, empty and blank texts, repeated rows, a very long text, and columns named like results.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, "one two"),
    (6, "long wörd " * 20_000), (7, "x" * 30_000), (8, "▁ tab\there\n\x00 漢字 😀 ﬁ <s>"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    clash = {c: F.lit("clash") for c in ("text_hash", "n_tokens", "ids", "words", "size", "taken", "kept", "path", "print", "runs")}
    return df.withColumns(clash | {"source": F.when(F.col("doc_id") > 4, F.lit("s1")), "n_chars": F.lit(0).cast("long")})


def by_id(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_codec_equals_library():
    codec, library = piece_codec.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    letters = "abcdefgh  \n\t▁éß漢字①ﬁ　😀\x00<s>0x41.,;==----____    "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [t or "" for _, t in AWKWARD]
    for text in texts:
        assert codec.encode(text).tolist() == library.encode(text)
    for _ in range(1000):
        ids = [rng.randrange(3, 700) for _ in range(10)]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_encode_decode(awkward, spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = piece_codec.encode_decode(awkward, MODEL)
    want = collections.Counter()
    for i, t in AWKWARD:
        ids = library.encode(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert by_id(piece_codec.digests(coded).collect()) == want
    assert piece_codec.encode_decode(awkward.limit(0), MODEL).count() == 0


def test_license_scan(spark):
    mit = license_scan.KNOWN["MIT"][2]
    rows = [(1, "Copyright (c) 2020 A. Body\n" + mit.upper().replace(",", " ,")), (2, f"prose\n\n{mit}\n\nmore prose"),
            (3, "words\nLicensed under CC BY-NC 4.0.\nreleased under the MIT licence"), (4, None), (4, None), (None, "Released under the MIT License."),
            (5, "This MIT License is not it."), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    known = license_scan.known_licenses(spark)
    got = collections.Counter((r.doc_id, r.license, tuple(r.notices)) for r in license_scan.scan(df, known).collect())
    assert got == collections.Counter([
        (1, "MIT", ()), (2, None, ()), (3, None, ("CC-BY-NC-4.0", "MIT")), (4, None, ()), (4, None, ()), (None, "MIT", ("MIT",)),
        (5, None, ()), (6, None, ())])
    assert license_scan.scan(df.limit(0), known).count() == 0


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_trie_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64))
    values = np.unique(np.concatenate((base, near, base ^ np.uint64(15))))
    i, j = simhash.trie_pairs(values, np.array([0]), np.array([len(values)]))
    want = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == list(zip(want[0].tolist(), want[1].tolist()))


@pytest.mark.parametrize("group", [2048, 4])
def test_simhash_links(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    flips = np.concatenate([base] + [base ^ (np.int64(1) << rng.integers(0, 63, 40)) for _ in range(4)])
    prints = np.unique(flips)
    df = spark.createDataFrame([(int(p),) for p in prints], "print long")
    got = {r.node: r.root for r in components.components(simhash.links(df, []), "a", "b").collect()}
    u = prints.view(np.uint64)
    close = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = prints.copy()
    while True:
        least = np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == label).all():
            break
        label = least
    assert {int(p): got.get(int(p), int(p)) for p in prints} == dict(zip(prints.tolist(), label.tolist()))


def test_near_duplicates_awkward(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    want = {i: f"{plain_print(t):016x}" for i, t in AWKWARD}
    assert all(r.fingerprint == want[r.doc_id] for r in rows)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (1, 2, 3, 4, None)} == {1: 1, 2: 1, 3: 1, 4: 4, None: 4}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_line_templates(spark, awkward):
    rows = [(i, f"own {'abc'[i % 3]}{chr(97 + i)} line\nPage {i} of 12:30, see http://x.y/{i}\n\nmail me{i}@a.b now") for i in range(12)]
    rows += [(100 + i, "copy of this\ncopied too") for i in range(30)] + [(None, "Page 7 of 9, see http://q"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_dropped", F.lit(1))
    got = {r.doc_id: r for r in line_templates.drop_recurring(df).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    assert got[5].text == rows[5][1].split("\n")[0] + "\n" and (got[5].n_lines, got[5].n_dropped) == (4, 2)
    assert got[110].text == rows[25][1]
    assert line_templates.drop_recurring(df).count() == len(rows)
    clean = line_templates.clean_lines(awkward)
    assert clean.columns == awkward.columns and clean.count() == len(AWKWARD)
    assert line_templates.drop_recurring(df.limit(0)).count() == 0


def plain_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width,depths", [(200, (72, 184)), (40, (10, 30)), (30, (12,))])
def test_remove_repeats(spark, width, depths):
    rng = random.Random(1)
    texts = ["a" * 1000, "ab" * 300, None, "", "x" * 199, "y" * 200, "y" * 200, "abcde" * 50 + "q", "ü" * 120]
    base = "".join(rng.choice("abc") for _ in range(2000))
    for _ in range(40):
        at = rng.randrange(1500)
        part = base[at:at + rng.randrange(10, 450)]
        texts.append("".join(rng.choice("abcz") for _ in range(rng.randrange(40))) + part + rng.choice("abcz") * rng.randrange(3))
    ids = [i if i % 7 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("runs", F.lit(0))
    got = by_id(suffix_dedup.remove_repeats(df, width, depths).drop("kept").collect())
    assert got == collections.Counter((i, *r) for i, r in zip(ids, plain_repeats(texts, width)))
    assert suffix_dedup.remove_repeats(df.limit(0), width, depths).count() == 0


def test_token_counts(awkward):
    unigrams = token_counts.UnigramTrie(MODEL)
    for word in ("▁hello", "▁thtiestion", "漢字", "▁▁▁x", "unbelievable"):
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = best[end - 1] + len(word[end - 1].encode()) * unigrams.byte_score
            for start in range(end):
                if word[start:end] in unigrams.score:
                    best[end] = max(best[end], best[start] + unigrams.score[word[start:end]])
        best_list, count = [0.0], [0]
        unigrams.extend(word, best_list, count, 0)
        assert best_list == pytest.approx(best)
    rows = token_counts.count_tokens(awkward, MODEL).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    # One text alone gives what it gives beside others.
    alone = token_counts.UnigramTrie(MODEL)
    for r in rows:
        text = dict(AWKWARD)[r.doc_id] or ""
        assert alone.count([text])[0] == pytest.approx((r.n_pretokens, r.n_tokens, r.log_prob))


def test_quality_rules(spark, awkward):
    good = " ".join(f"the wordly{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(40))
    rows = [(1, good), (2, good.replace(" of", " of###")), (3, " ".join(["same words here"] * 30)), (4, "the of " * 10), (5, None),
            (6, "\n".join(["the one and only line of it"] * 2 + [good]))]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = [w for w in re.split("[ \t-\r]+", text or "") if w]
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        again = {p for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (text or "").split("\n") if x.strip()]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (
            len(words), sum(map(len, words)), len(again), len(lines) - len(set(lines)))
    assert [i for i in got if got[i].kept] == [1, 6] and got[3].base_failed and got[4].base_failed
    assert "symbols" in got[2].failed
    assert quality_rules.assess(awkward).count() == len(AWKWARD)
    assert quality_rules.keep_good(awkward).columns == awkward.columns
    assert quality_rules.assess(awkward.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = rng.sample(plain, 30) + (rng.sample(["vilething", "vileones", "nastylot", "rudemob"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (9000, ""), (9001, "vilelot")], "doc_id long, text string").withColumn("score", F.lit(7))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert held and all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert got[9000].score == got[None].score < 0.1 and not got[None].held_out
    assert got[9001].predicted == 1 and got[9001].evidence
    # The block-max search against all cosines.
    weights = np.zeros((len(model.total), len(model.vocabulary)))
    for t, (e, w) in enumerate(zip(model.entries, model.weights)):
        weights[e, t] = w
    for _, text in rows[:100:4]:
        places, w = model.vector(text)
        query = np.zeros(weights.shape[1])
        query[places] = w
        every = np.sort(weights @ query)[::-1]
        assert model.nearest(places, w)[1] == pytest.approx(every[every > 0][:toxicity.NEAREST])
    nothing = toxicity.fit(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_nearest_lattice_point():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    points = lattice_dedup.nearest_e8(x)
    others = points[:, None, :] + lattice_dedup._ROOTS[None]
    assert (((x - points) ** 2).sum(1) <= ((x[:, None] - others) ** 2).sum(2).min(1) + 1e-12).all()


@pytest.mark.parametrize("group", [2048, 8])
def test_embedding_near_duplicates(spark, monkeypatch, group):
    monkeypatch.setattr(lattice_dedup, "GROUP", group)
    rng = np.random.default_rng(2)
    u = rng.normal(size=(150, 16))
    v = np.concatenate([u, u + rng.normal(size=u.shape) * 0.15, u[:20] * 3, u[:20], np.tile(u[0], (30, 1)) + rng.normal(size=(30, 16)) * 0.02])
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [math.nan] * 16), (9004, [1.0, 2.0]), (9005, [2.0, 4.0]), (9006, [1.0, None]), (None, [1.0, 2.0]), (9007, [])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())] + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: tuple(r)[1:] for r in lattice_dedup.near_duplicates(df.withColumn("cells", F.lit(1))).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    links = sum(got[i][0] for i in range(len(v)))
    assert all(got[i][0] <= close[i].sum() for i in range(len(v))) and links >= 0.99 * close.sum()
    assert [got[i] for i in (9004, 9005, None, 9001, 9003, 9006, 9007)] == [
        (2, 9004, True), (2, 9004, False), (2, 9004, False), (0, 9001, True), (0, 9003, True), (0, 9006, True), (0, 9007, True)]
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0


def test_targets_and_flow():
    sizes = {"a": 10, "b": 1000, None: 100}
    shares = source_mix.targets(sizes, {"a": 5, "b": 2, None: 1}, 1110)
    assert sum(shares.values()) == pytest.approx(1110) and all(shares[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    # A pattern of both sources serves whichever is short, before anything repeats.
    taken = source_mix.route({("a",): 10, ("b",): 10, ("a", "b"): 10}, {"a": 15, "b": 15})
    assert taken == {("a",): 10, ("b",): 10, ("a", "b"): 10}
    assert source_mix.route({("a",): 10}, {"a": 25}) == {("a",): 25}


def test_mix(spark, awkward):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "abc"[i % 3] if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df).collect()
    per = collections.defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken % r.size == 0
        per[(r.source_size, r.target)] += r.taken
    assert len(got) == 400 and all(abs(n - target) <= 9 for (_, target), n in per.items())
    assert by_id(got) == by_id(source_mix.mix(df.repartition(7)).collect())
    assert source_mix.take(df).count() == sum(r.taken // r.size for r in got)
    assert source_mix.mix(awkward).count() == len(AWKWARD) and source_mix.mix(awkward.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (5, 5), (None, 3), (300, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_remove_repeats_with_a_passage_that_most_texts_hold(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd") for _ in range(260))
    other = "".join(rng.choice("efgh") for _ in range(230))
    texts = [f"{i} " + passage + "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + (other if i % 9 == 0 else "") for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffix_dedup.remove_repeats(df).drop("kept").collect())
    assert got == collections.Counter((i, *r) for i, r in enumerate(plain_repeats(texts, 200)))


def test_embeddings_of_any_scale(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 0.0]), (4, [3e200, 1.0]), (5, [0.0, 5e-324]), (6, [0.0, 1.7e308])]
    got = lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 1, 5), (6, 1, 5)]
