"""Source divergence against a plain count, with digests that collide and blocks that hold a few terms."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import source_audit


def plain(rows, min_docs, top):
    counts, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * len(kept)) for t in kept}

        each = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        q = shares({t: sum(c[t] for c in each.values()) for t in kept})
        p = {s: shares(c) for s, c in each.items()}
        for s in sources:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s],
                     "term": [(t, p[s][t] - q[t]) for t in kept if each[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top if part == "term" else None]
                out.update((lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items, 1))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["one", "Two", "THREE", "vier", "fünf", "Éa", "éa", "x", "yz", "漢字", "ﬁ", "a1b", "can't", "\x00nul", "ÀB"]
    out = [(rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "", None]),
            " ".join(rng.choices(words, range(1, 16), k=rng.randrange(9)))) for _ in range(300)]
    # A language without kept terms, a group without terms, a very long text, a null one.
    return out + [("fr", "s1", "rare"), ("fr", "s2", None), ("en", "s9", "42"), ("en", "s1", "One two " * 40_000), ("en", "s1", None)]


@pytest.mark.parametrize("limits", [{}, {"bits": 3, "chunk": 60, "gathered": 8, "cells_per_block": 4}])
def test_equals_plain_count(spark, rows, limits, monkeypatch):
    monkeypatch.setattr(source_audit, "TERMS", 1)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("digest", "term", "value", "count", "data", "v")})
    got = source_audit.audit(df, min_docs=12, top_terms=4, **limits)
    assert {tuple(r) for r in got.collect()} == plain(rows, 12, 4)
    assert source_audit.audit(df.limit(0)).count() == 0
