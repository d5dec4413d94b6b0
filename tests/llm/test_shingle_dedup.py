"""The near-duplicate stage of the pipeline against all pairs by brute force."""

import random

import corpus_pipeline
from lumenlake.llm import shingle_dedup, simhash

COLUMNS = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows, similarity=0.8):
    """Ids that stay: the smallest of each group that similar pairs chain."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (len(sets[a] & sets[b]) >= similarity * union) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return sorted(set(root.values()))


def edited(words, rng, edits):
    out = list(words)
    for place in rng.sample(range(len(out)), edits):
        out[place] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def texts():
    rng = random.Random(11)
    rows = [(1, None), (2, " \n"), (3, "one two"), (4, "One  TWO")]
    for group in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 300))]
        # Five-word shingles lost per edit: similarities lie on both sides of 0.8.
        for _ in range(8):
            rows.append((10 + len(rows), edited(words, rng, rng.randrange(0, 1 + len(words) // 30))))
    return rows


def test_stage_finds_all_similar_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, COLUMNS)
    want = plain(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert 30 < len(want) < 190


def test_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "STAR_ROUNDS", 0)
    rows = texts()
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r.doc_id for r in shingle_dedup.keep_one(docs).collect()) == plain(rows)
    assert shingle_dedup.keep_one(docs.limit(0)).count() == 0


def test_boilerplate_makes_few_pairs(spark, monkeypatch):
    # Documents with 60 % of their words in common have a similarity of about 0.4; none may become many pairs.
    tested = []

    def counted(pairs, *rest, real=shingle_dedup._similar):
        tested.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(shingle_dedup, "_similar", counted)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(80)])) for i in range(400)]
    assert shingle_dedup.keep_one(spark.createDataFrame(rows, COLUMNS)).count() == 400
    assert sum(tested) < 400


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, long), (9, long + " end"),
            (None, "alone here"), (10, None), (11, "")]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS key", "'y' AS shingles", "'z' AS n", "'w' AS _row_id", "'v' AS id", "'u' AS row")
    got = shingle_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.key) for r in got.collect()) == [(0, "x"), (7, "x"), (8, "x"), (10, "x")]


def test_near_fingerprints_are_linked_by_the_stage(spark):
    """Texts that are the same passage over and over, with a few words of their own: near by SimHash, not as sets."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(21)] * 150
    rows = [(i, " ".join(passage + [f"own{rng.randrange(10**9)}" for _ in range(40)])) for i in (4, 2, 9)]
    rows += [(7, " ".join(f"other{i}" for i in range(80))), (8, None)]
    prints = [simhash.fingerprint(t.encode(), shingle_dedup.WORDS) for _, t in rows[:3]]
    assert all((prints[0] ^ p).bit_count() <= simhash.BITS for p in prints)
    assert plain(rows) == [2, 4, 7, 8, 9]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]
