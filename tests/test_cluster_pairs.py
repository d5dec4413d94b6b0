"""Clusters take narrow hits and few pairs for each node, however many pairs lie above a floor."""

import numpy as np
import pyarrow as pa
import pytest

from lumenlake.operators import clusters

_FLOORS = (0.45, 0.30, 0.40)


def _roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("rows", [7, 1 << 18])
@pytest.mark.parametrize("seed", range(4))
def test_a_forest_joins_the_same_nodes_at_every_level(monkeypatch, rows, seed):
    monkeypatch.setattr(clusters, "_FOREST_ROWS", rows)
    r = np.random.default_rng(seed)
    a = r.integers(0, 90, 400)
    b, level = a + r.integers(1, 30, 400), r.integers(1, 4, 400).astype(np.int8)
    batches = [pa.record_batch([a[i:i + 10], b[i:i + 10], level[i:i + 10]], names=["a", "b", "level"]) for i in range(0, 400, 10)]
    got = pa.Table.from_batches(list(clusters._reduce_pairs(iter(batches)))).to_pylist()
    nodes = set(a.tolist()) | set(b.tolist())
    given = list(zip(a.tolist(), b.tolist(), level.tolist()))
    assert {(p["a"], p["b"], p["level"]) for p in got} <= set(given) and len(got) < len(nodes)
    for reached in (1, 2, 3):
        assert _roots(nodes, [p[:2] for p in given if p[2] >= reached]) == _roots(nodes, [(p["a"], p["b"]) for p in got if p["level"] >= reached])


def test_nothing_is_reduced_to_nothing():
    assert list(clusters._reduce_pairs(iter([]))) == []


def test_blocks_hold_bounded_hits_and_touch_few_nodes():
    for hits in (0, 1, 20_000, 1_000_000, 120_000_000, 5_000_000_000):
        sides = clusters._sides(hits, 12)
        blocks = sides * (sides + 1) // 2
        assert blocks * clusters._BLOCK_HITS >= hits and sides <= 8 + 1.5 * (hits / clusters._BLOCK_HITS) ** 0.5


@pytest.mark.parametrize("least", [1 << 14, 200])
def test_dense_lists_give_the_rounds_few_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(clusters, "_LEAST_HITS", least)
    n, r = 120, np.random.default_rng(5)
    sims = 0.25 + 0.25 * r.random((n, n))
    sims = np.minimum(np.maximum(sims, sims.T), np.where(np.arange(n)[:, None] // 60 == np.arange(n) // 60, 1, 0.32))
    listed = r.random((n, n)) < 0.9
    rows = [(q, c, float(sims[q, c])) for q in range(n) for c in range(n) if q != c and listed[q, c]]
    table = spark.createDataFrame(rows, "query_id long, candidate_id long, sim double")
    taken, whole = [], clusters.connected_components

    def counted(pairs):
        taken.append(pairs.count())
        return whole(pairs)

    monkeypatch.setattr(clusters, "connected_components", counted)
    got = clusters.near_duplicate_clusters(table, _FLOORS).collect()
    most = clusters._sides(len(rows), spark.sparkContext.defaultParallelism) * n * len(_FLOORS)
    mutual = clusters.mutual_pairs(table, _FLOORS).collect()
    assert len(mutual) > 2 * most or least == 200
    assert taken[0] <= most and taken[0] < len(mutual) / 2
    # The second pass takes what all blocks left to at most two parts here.
    assert taken[0] < 2 * n * len(_FLOORS)
    for floor in _FLOORS:
        pairs = [(r["a"], r["b"]) for r in mutual if r["threshold"] == floor]
        assert sorted(pairs) == sorted((a, b) for a in range(n) for b in range(a + 1, n) if listed[a, b] and listed[b, a] and sims[a, b] >= floor)
        roots = _roots({x for p in pairs for x in p}, pairs)
        want, have = {}, {}
        for node, root in roots.items():
            want.setdefault(root, set()).add(node)
        for r_ in got:
            if r_["threshold"] == floor:
                have.setdefault(r_["cluster_id"], set()).add(r_["member_id"])
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))
