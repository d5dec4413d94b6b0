"""Nearest neighbours, cut-off rules, clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import clusters, curve_stats, curves, knn, vector_search


def brute_force(ids, vectors, k, include_self=False):
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, knn.SIM_DECIMALS)
    out = set()
    for i, q in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if include_self or j != i), key=lambda j: (-sims[i, j], ids[j]))
        out |= {(q, rank, ids[j], round(max(0.0, sims[i, j]), 9)) for rank, j in enumerate(order[:k], 1)}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["candidate_id"], round(r["sim"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors of which a third are copies of one and a few more repeat."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    v = (centres[rng.integers(0, 6, 240)] + 0.15 * rng.normal(size=(240, 8))).astype(np.float32)
    v[::3] = v[0]
    v[1:40:4] = v[1]
    ids = rng.permutation(1000)[:240].tolist()
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id long, vector array<float>")
    return ids, v, frame


@pytest.mark.parametrize("layout", [knn.KnnLayout(), knn.KnnLayout(block_rows=48, max_pivots=3, rings=8, prune_from_blocks=2)])
@pytest.mark.parametrize("include_self", [False, True])
def test_neighbours_equal_brute_force(vectors, layout, include_self):
    ids, v, frame = vectors
    got = knn.nearest_neighbours(frame, 7, include_self=include_self, layout=layout)
    assert found(got) == brute_force(ids, v, 7, include_self)


def test_model_guard_and_unusable_vectors(spark):
    frame = spark.createDataFrame(
        [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.5, 0.5], "a"), (4, [0.0, 0.0], "a"), (5, None, "a")],
        "id long, vector array<double>, model string",
    )
    got = {(r["query_id"], r["candidate_id"]) for r in knn.nearest_neighbours(frame, 5, model_col="model").collect()}
    assert got == {(1, 3), (3, 1)}
    assert knn.nearest_neighbours(frame.where("id > 3"), 5).count() == 0


def test_vectors_of_different_sizes_never_meet(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.1]), (3, [1.0, 0.0]), (4, [1.0, 0.2]), (5, [float("nan"), 1.0]), (6, []), (7, [1.0, None])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    pairs = {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert {(r["query_id"], r["candidate_id"]) for r in knn.nearest_neighbours(frame, 5).collect()} == pairs
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 99, 1, None)], "id long")
    got, problems = vector_search.search_ids(ids, frame, 5)
    assert {(r["query_id"], r["candidate_id"]) for r in got.collect()} == pairs
    assert {tuple(r) for r in problems.collect()} == {
        (5, "not finite"), (6, "missing"), (7, "not finite"), (99, "unknown"), (None, "unknown")}


@pytest.mark.parametrize("metric, block_rows", [("cosine", 4096), ("l2", 50), ("ip", 16)])
def test_search_equals_brute_force(spark, vectors, metric, block_rows):
    ids, v, frame = vectors
    rng = np.random.default_rng(8)
    q = np.vstack([rng.normal(size=(58, 8)), v[:2]]).astype(np.float32)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<float>")
    a, b = q.astype(np.float64), v.astype(np.float64)
    if metric == "l2":
        want = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    else:
        if metric == "cosine":
            a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
        want = 1 - a @ b.T
    expected = {}
    for i, row in enumerate(np.round(want, 12)):
        order = sorted(range(len(ids)), key=lambda j: (row[j], ids[j]))[:9]
        expected |= {(i, rank): (ids[j], row[j]) for rank, j in enumerate(order, 1)}
    rows = vector_search.search_vectors(queries, frame, 9, metric=metric, block_rows=block_rows).collect()
    assert {(r["query_id"], r["rank"]): r["candidate_id"] for r in rows} == {k: x[0] for k, x in expected.items()}
    assert all(abs(r["distance"] - expected[r["query_id"], r["rank"]][1]) < 1e-9 for r in rows)


def ranked(spark, *curves_):
    rows = [(q, r, 1000 * q + r, s) for q, scores in enumerate(curves_) for r, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "query_id int, rank int, candidate_id int, sim double")


@pytest.mark.parametrize("scores, settings, kept", [
    ([.98, .85, .84, .83, .82, .50], dict(min_keep=5, min_similarity=.40), 5),
    ([.90, .89, .88, .87, .86, .85, .84, .83, .82, .81, .80], dict(min_keep=0), 5),
    ([.95, .94, .60, .59, .58], dict(min_keep=0), 2),
    ([.99 - .001 * i for i in range(200)], dict(min_keep=200, max_results=10), 10),
    ([.95, .80, .75, .65, .60], dict(min_similarity=.70), 3),
    ([.49, .48], dict(), 0),
    ([.90], dict(), 1),
])
def test_knee_filter(spark, scores, settings, kept):
    got = curves.knee_filter(ranked(spark, scores), curves.KneeSettings(**settings)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, kept + 1))


@pytest.mark.parametrize("bad", [dict(drop_ratio=1.0), dict(min_keep=-1), dict(min_similarity=1.1), dict(max_results=0)])
def test_knee_settings_are_checked(bad):
    with pytest.raises(ValueError):
        curves.KneeSettings(**bad)


def test_rules_on_short_and_flat_curves(spark):
    table = curves.to_curves(ranked(spark, [0.9], [0.9, 0.2], [0.6, 0.6, 0.6], [0.3, 0.29]), spark.range(5).withColumnRenamed("id", "query_id"))
    got = {(r["query_id"], r["method"]): (round(r["threshold"], 4), r["count"]) for r in curves.apply_methods(table).collect()}
    assert len(got) == 5 * 31
    assert got[0, "relative_gap_0.02_min0.40"] == (0.9, 1)
    assert got[0, "gap_zscore_2_min0.40"] == (0.0, 0)
    assert got[0, "two_phase_high0.95_factor2_min0.40"] == (0.9, 1)
    assert got[1, "curvature_min0.40"] == (0.2, 2)
    assert got[1, "two_phase_high0.95_factor2_min0.40"] == (0.55, 1)
    assert got[2, "kneedle_min0.40"] == (0.6, 3)
    assert got[2, "gap_zscore_2_min0.40"] == (0.6, 3)
    assert got[3, "current_max_gap_0.02"] == (0.0, 0)
    assert {v for (q, _), v in got.items() if q == 4} == {(0.0, 0)}


def test_curve_summary(spark):
    table = curves.to_curves(ranked(spark, [0.9, 0.8, 0.7, 0.5, 0.3]), spark.range(2).withColumnRenamed("id", "query_id"))
    first, empty = curves.curve_summary(table).orderBy("query_id").collect()
    assert (first["top5_similarity"], first["top200_similarity"], first["count_ge_0.70"]) == (0.3, 0.3, 3)
    assert first["second_max_gap_rank"] + first["max_gap_rank"] == 7
    assert (empty["candidate_count"], empty["top1_similarity"], empty["max_gap_rank"], empty["current_strategy_result_count"]) == (0, 0.0, 0, 0)


def test_equal_gaps_take_the_later_rank_in_the_summary_and_the_first_in_the_rule(spark):
    table = curves.to_curves(ranked(spark, [1.0, 0.75, 0.5, 0.25]))
    row = curves.curve_summary(table).first()
    assert (row["max_gap_rank"], row["second_max_gap_rank"], row["current_strategy_result_count"]) == (3, 2, 1)


def test_exact_quantiles(spark):
    rows = spark.range(101).select(F.lit("m").alias("g"), F.col("id").cast("double").alias("v"), "id")
    got = {r["probability"]: r["quantile"] for r in curve_stats.exact_quantiles(rows, "g", "v", "id", [0.0, 0.125, 0.5, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.125: 12.5, 0.5: 50.0, 1.0: 100.0}


def test_clusters_join_long_chains_and_need_both_directions(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    rows = [(a, b, 0.9) for a, b in chain] + [(b, a, 0.9) for a, b in chain] + [(100, 101, 0.99), (200, 201, 0.9), (201, 200, 0.9)]
    table = spark.createDataFrame(rows, "query_id long, candidate_id long, sim double")
    got = clusters.near_duplicate_clusters(table, (0.95, 0.8)).collect()
    members = {}
    for r in got:
        members.setdefault((r["threshold"], r["cluster_id"], r["size"]), set()).add(r["member_id"])
    assert members == {(0.8, "T0.80_00001", 60): set(range(1, 61)), (0.8, "T0.80_00002", 2): {200, 201}}
    stats = {r["threshold"]: (r["clusters"], r["members"], r["median_size"], r["size_ge_5"]) for r in curve_stats.cluster_statistics(clusters.cluster_sizes(spark.createDataFrame(got)), (0.95, 0.8)).collect()}
    assert stats == {0.95: (0, 0, None, 0), 0.8: (2, 62, 31, 1)}


def test_a_repeated_one_way_hit_is_not_mutual(spark):
    rows = [(1, 2, 0.9), (1, 2, 0.9), (3, 4, 0.9), (4, 3, 0.85), (4, 3, 0.7)]
    table = spark.createDataFrame(rows, "query_id long, candidate_id long, sim double")
    assert sorted(tuple(r) for r in clusters.mutual_pairs(table, (0.8, 0.88)).collect()) == [(0.8, 3, 4)]
