"""The neighbour search sends vectors in proportion to the input and hits once."""

import numpy as np
import pytest

from lumenlake.operators import knn


def _frame(spark, n, seed=3, size=6, copies=0):
    v = np.random.default_rng(seed).normal(size=(n, size)).astype(np.float32)
    v[:copies] = v[0]
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")


def test_copies_of_a_vector_follow_the_cores_and_not_the_input():
    layout, limit, tasks = knn.KnnLayout(), 201, 12
    sent = {n: n * sum(knn._block_counts({"64:": n}, layout, limit, tasks).values()) for n in (17_000, 100_000, 600_000)}
    assert sent[600_000] / sent[100_000] <= 6.01 and sent[100_000] / sent[17_000] <= 6.01
    # A task holds no more queries than it has room for, also with long vectors, long lists and many models.
    counts = {"64:": 5_000_000, "4096:": 1_000_000, "8:a": 1}
    blocks = knn._block_counts(counts, layout, limit, tasks)
    assert blocks["8:a"] == 1 and all(-(-n // blocks[m]) * max(limit, int(m.split(":")[0])) <= knn._BLOCK_ENTRIES for m, n in counts.items())


@pytest.mark.parametrize("layout", [knn.KnnLayout(block_rows=40), knn.KnnLayout(block_rows=9, max_pivots=5, rings=4, prune_from_blocks=2)])
def test_each_vector_has_its_final_list_where_it_is_made(spark, layout):
    _, frame = _frame(spark, 400)
    source = frame.selectExpr("id", "'6:' AS model", "vector")
    _, distinct = knn._distinct_vectors(source, 8, "<f4")
    lists = knn._lists(distinct, {"6:": 400}, layout, 8, "<f4").collect()
    assert len(lists) == 400 == len({r["rep"] for r in lists})
    assert all(len(r["ids"]) == 8 and r["ids"][0] == r["rep"] and r["sims"] == sorted(r["sims"], reverse=True) for r in lists)


@pytest.mark.parametrize("copies", [0, 60])
@pytest.mark.parametrize("top_k", [3, 200, 1000])
def test_small_blocks_lose_no_neighbour(spark, copies, top_k):
    v, frame = _frame(spark, 300, copies=copies)
    layout = knn.KnnLayout(block_rows=9, max_pivots=5, rings=4, prune_from_blocks=2)
    got = {(r["query_id"], r["rank"]): r["candidate_id"] for r in knn.nearest_neighbours(frame, top_k, layout=layout).collect()}
    unit = v.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, knn.SIM_DECIMALS)
    want = {}
    for q in range(300):
        order = sorted((c for c in range(300) if c != q), key=lambda c: (-sims[q, c], c))[:top_k]
        want |= {(q, rank): c for rank, c in enumerate(order, 1)}
    assert got == want
