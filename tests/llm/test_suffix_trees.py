"""Substring dedup against brute force: every partition size, awkward rows, the tree itself."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import suffix_trees


def plain(rows, width):
    """The contract, window by window."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + width]) for w in texts for i in range(len(w) - width + 1))
    out = collections.Counter()
    for (name, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - width + 1):
            if seen[tuple(words[i:i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[name, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    letters = "abcdefghijklmn"
    passages = [[rng.choice("abcdefghij") for _ in range(60)] for _ in range(4)]
    out = [(1, None), (2, ""), (3, " \n\t"), (None, "a b " * 50), (None, "a b " * 50), (4, "x " * 500), (4, "x " * 500),
           (5, " ".join(map(str, range(35)))), (6, " ".join(map(str, range(36)))), (7, "wörd no break\x00 " * 40),
           (8, " ".join(str(i) for i in range(30_000)))]
    for i in range(150):
        words = [[rng.choice(letters) for _ in range(rng.randrange(30))] for _ in range(2)]
        out.append((10 + i, "\n".join(" ".join(w) for w in (words[0], rng.choice(passages)[rng.randrange(20):], words[1]))))
    return out


@pytest.mark.parametrize("capacity", [2048, 2])
def test_equals_brute_force(spark, rows, capacity):
    # A capacity of 2 drives the shared passages through every longer prefix.
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "text_hash", "data", "runs", "key")})
    got = suffix_trees.remove_repeats(df, capacity=capacity)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == plain(rows, 35)
    one = got.where("doc_id = 10").first()
    assert hashlib.sha256(one.kept.encode()).hexdigest() == one.kept_sha256 and one.n_spans == 1


def test_empty_table(spark):
    assert suffix_trees.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_nodes():
    texts = ["a b c d e".split(), "x b c d y".split(), "b c d e z".split()]
    coded = [b"".join(w.encode().rjust(8) for w in t) for t in texts]
    nodes = {(depth, frozenset(s)) for depth, s in suffix_trees.deep_nodes(coded, [3, 3, 3], 3)}
    assert nodes == {(4, frozenset({(0, 1), (2, 0)})), (3, frozenset({(0, 1), (2, 0), (1, 1)})), (3, frozenset({(0, 2), (2, 1)}))}
