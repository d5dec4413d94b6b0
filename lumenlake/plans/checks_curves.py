"""Registered queries: similarity search, curve rules, statistics and clusters.

Floors follow the data: its best similarities lie near 0.37, so the cut-off runs
at 0.2 and the clusters at 0.45 ... 0.30.
"""

from pyspark.sql import functions as F

from lumenlake.functions import vectors as vec_fn
from lumenlake.operators import clusters, curve_stats, curves, knn, search, vector_search
from lumenlake.plans.registry import query
from lumenlake.sources import backup

_KNEE = curves.KneeSettings(min_similarity=0.2)
_FLOORS = (0.45, 0.40, 0.35, 0.30)


def _neighbours(lib):
    """All vectors against each other, the query left out (C14)."""
    return knn.library_neighbours(lib.vec, curves.CANDIDATE_COUNT, id_col="image_id")


def _curves(lib):
    return curves.to_curves(_neighbours(lib))


def _summary(lib):
    return curves.curve_summary(_curves(lib))


def similar_images(lib):
    """Flagship: same-model neighbours, knee cut-off, images with ordered tags."""
    ranked = knn.nearest_neighbours(
        lib.vec, curves.CANDIDATE_COUNT, id_col="image_id", model_col="model_hash"
    )
    kept = curves.knee_filter(ranked, _KNEE)
    tagged = search.with_tags(lib.img, lib.tag, lib.img_tag)
    shown = tagged.select("id", "original_file_name", F.array_join("tags.name", "|").alias("tags"))
    return search.ranked_images(kept, shown).select(
        "query_id", "rank", "candidate_id", F.round("sim", 6).alias("sim"), "original_file_name", "tags"
    )


_MODEL_KNN = """same AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, candidate_id) AS INTEGER) AS rank,
           candidate_id, greatest(0.0, c) AS sim
    FROM (SELECT a.image_id AS query_id, b.image_id AS candidate_id, round(list_cosine_similarity(a.vector, b.vector), 12) AS c
          FROM vec a JOIN vec b ON a.model_hash = b.model_hash {self_rule})
    QUALIFY rank <= 200)"""

# The cut-off of the production rule over a ranked table.
_KNEE_SQL = """
    steps AS (SELECT *, sim - lead(sim) OVER w AS gap, max(sim) OVER q AS top, min(sim) OVER q AS bottom, count(*) OVER q AS n
              FROM {ranked} WINDOW w AS (PARTITION BY query_id ORDER BY rank), q AS (PARTITION BY query_id)),
    cuts AS (SELECT query_id, greatest(coalesce(min(rank) FILTER (gap IS NOT NULL AND top - (sim - gap) >= 0.5 * greatest(top - bottom, 1e-9)), max(n)), 5) AS cut
             FROM steps GROUP BY query_id),
    kept AS (SELECT s.query_id, s.rank, s.candidate_id, s.sim FROM steps s JOIN cuts USING (query_id)
             WHERE top >= 0.2 AND rank <= cut AND sim >= 0.2 AND rank <= 100)"""

_TAGGED = """tagged AS (
    SELECT i.id, i.original_file_name, coalesce(string_agg(t.name, '|' ORDER BY t."order", t.id), '') AS tags
    FROM img i LEFT JOIN (SELECT DISTINCT * FROM img_tag) l ON l.image_id = i.id LEFT JOIN tag t ON t.id = l.tag_id
    GROUP BY i.id, i.original_file_name)"""

query("q_similar_images", "vec img tag img_tag", f""", {_MODEL_KNN.format(self_rule="AND a.image_id <> b.image_id")}, {_KNEE_SQL.format(ranked="same")}, {_TAGGED}
    SELECT query_id, rank, candidate_id, round(sim, 6) AS sim, original_file_name, tags FROM kept JOIN tagged ON tagged.id = candidate_id""")(similar_images)


@query("c14_library_neighbours", "vec knn", "SELECT query_id, rank, candidate_id, round(sim, 6) AS sim FROM knn")
def _(lib):
    return _neighbours(lib).withColumn("sim", F.round("sim", 6))


@query("w1_same_model_with_self", "vec", f", {_MODEL_KNN.format(self_rule='')} SELECT query_id, rank, candidate_id, round(sim, 6) AS sim FROM same")
def _(lib):
    ranked = knn.nearest_neighbours(lib.vec, 200, id_col="image_id", model_col="model_hash", include_self=True)
    return ranked.withColumn("sim", F.round("sim", 6))


# Query vectors that the library does not hold: those of every fifth image, read backwards.
_GIVEN = """, found AS (
    SELECT a.image_id AS query_id, b.image_id AS candidate_id, round({distance}, 12) AS d
    FROM vec a JOIN vec b ON {rule})
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, candidate_id) AS INTEGER) AS rank,
           candidate_id, round(d, 6) AS distance, round(greatest(0.0, 1 - d), 6) AS sim
    FROM found QUALIFY rank <= 50"""


def _given(lib):
    return lib.vec.where("image_id % 5 = 0").select(F.col("image_id").alias("query_id"), F.reverse("vector").alias("vector"), "model_hash")


def _shown(found):
    return found.withColumns({"distance": F.round("distance", 6), "sim": F.round("sim", 6)})


@query("w1_search_vectors", "vec", _GIVEN.format(
    distance="1 - list_cosine_similarity(list_reverse(a.vector), b.vector)", rule="a.model_hash = b.model_hash WHERE a.image_id % 5 = 0"))
def _(lib):
    return _shown(vector_search.search_vectors(_given(lib), lib.vec, 50, id_col="image_id", model_col="model_hash"))


@query("f1_search_l2", "vec", _GIVEN.format(
    distance="pow(list_distance(list_reverse(a.vector), b.vector), 2)", rule="true WHERE a.image_id % 5 = 0"))
def _(lib):
    return _shown(vector_search.search_vectors(_given(lib), lib.vec, 50, metric="l2", id_col="image_id"))


@query("w1_search_ids", "vec", """, wanted AS (SELECT DISTINCT 3 * image_id AS query_id FROM vec),
    found AS (
        SELECT query_id, b.image_id AS candidate_id, round(list_cosine_similarity(a.vector, b.vector), 12) AS c
        FROM wanted JOIN vec a ON a.image_id = query_id JOIN vec b ON b.image_id <> query_id),
    ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, candidate_id) AS INTEGER) AS rank,
               candidate_id, round(greatest(0.0, c), 6) AS sim, NULL::VARCHAR AS problem
        FROM found QUALIFY rank <= 20)
    SELECT * FROM ranked UNION ALL
    SELECT query_id, NULL, NULL, NULL, 'unknown' FROM wanted WHERE query_id NOT IN (SELECT image_id FROM vec)""")
def _(lib):
    wanted = lib.vec.select((3 * F.col("image_id")).alias("image_id"))
    found, problems = vector_search.search_ids(wanted, lib.vec, 20, id_col="image_id")
    return found.select("query_id", "rank", "candidate_id", F.round("sim", 6).alias("sim")).unionByName(problems, allowMissingColumns=True)


@query("b12_same_model_guard", "vec", f""", {_MODEL_KNN.format(self_rule="AND a.image_id <> b.image_id")}
    SELECT q.model_hash AS query_model, c.model_hash AS candidate_model, count(*) AS n FROM same
    JOIN vec q ON q.image_id = query_id JOIN vec c ON c.image_id = candidate_id GROUP BY ALL""")
def _(lib):
    ranked = knn.nearest_neighbours(lib.vec, 200, id_col="image_id", model_col="model_hash")
    q = lib.vec.select(F.col("image_id").alias("query_id"), F.col("model_hash").alias("query_model"))
    c = lib.vec.select(F.col("image_id").alias("candidate_id"), F.col("model_hash").alias("candidate_model"))
    return ranked.join(q, "query_id").join(c, "candidate_id").groupBy("query_model", "candidate_model").agg(F.count(F.lit(1)).alias("n"))


@query("c9_ranked_images", "vec knn part_txt", "SELECT query_id, rank, candidate_id, original_file_name FROM knn JOIN part_txt ON part_txt.id = candidate_id WHERE text_in_image IS NOT NULL")
def _(lib):
    images = lib.part_txt.where("text_in_image IS NOT NULL").select("id", "original_file_name")
    return search.ranked_images(_neighbours(lib), images).select("query_id", "rank", "candidate_id", "original_file_name")


@query("f1_similarity_metrics", "vec", """
    SELECT a.image_id, round(greatest(0, list_cosine_similarity(a.vector, b.vector)), 6) AS cosine,
           round(greatest(0, 1 - pow(list_distance(a.vector, b.vector), 2)), 6) AS l2,
           round(greatest(0, list_inner_product(a.vector, b.vector)), 6) AS ip
    FROM vec a JOIN vec b ON b.image_id = a.image_id + 1""")
def _(lib):
    a = lib.vec.select("image_id", F.col("vector").alias("a"))
    b = lib.vec.select((F.col("image_id") - 1).alias("image_id"), F.col("vector").alias("b"))
    scores = [F.round(vec_fn.similarity("a", "b", m), 6).alias(m) for m in ("cosine", "l2", "ip")]
    return a.join(b, "image_id").select("image_id", *scores)


@query("f12_vector_problems", "vec", """
    SELECT vector_id, CASE WHEN len(vector) <> 64 THEN 'dimension' WHEN image_id <= 0 THEN 'image_id'
           WHEN image_id % 10 = 0 THEN 'image_width/height' END AS problem FROM vec""")
def _(lib):
    rows = lib.vec.select(
        "*", F.lit("a.png").alias("image_filename"), (F.col("image_id") % 10).alias("image_width"), F.lit(64).alias("image_height")
    )
    return vec_fn.with_vector_problems(rows, 64).select("vector_id", "problem")


@query("f13_custom_metadata", "", "SELECT event_id, 'custom_' || event_type AS stored, event_type AS field FROM events")
def _(lib):
    custom = F.create_map("event_type", F.col("value").cast("string"), F.concat(F.lit("no "), "event_type"), F.lit(None).cast("string"))
    stored = lib.table("events").select("event_id", vec_fn.flatten_custom(custom).alias("m"))
    return stored.select("event_id", F.array_join(F.map_keys("m"), ",").alias("stored"), F.array_join(F.map_keys(vec_fn.unflatten_custom("m")), ",").alias("field"))


@query("w2_knee_filter", "vec knn", f", {_KNEE_SQL.format(ranked='knn')} SELECT query_id, rank, candidate_id, round(sim, 6) AS sim FROM kept")
def _(lib):
    return curves.knee_filter(_neighbours(lib), _KNEE).withColumn("sim", F.round("sim", 6))


@query("e7_hard_caps", "vec knn", "SELECT query_id, max(rank) AS candidates, CAST(max(rank) FILTER (rank <= 100) AS INTEGER) AS results FROM knn GROUP BY query_id")
def _(lib):
    open_rule = curves.KneeSettings(min_similarity=0.0, drop_ratio=0.999, min_keep=200)
    ranked = _neighbours(lib)
    kept = curves.knee_filter(ranked, open_rule)
    return (
        ranked.groupBy("query_id").agg(F.max("rank").alias("candidates"))
        .join(kept.groupBy("query_id").agg(F.max("rank").alias("results")), "query_id")
    )


# One CTE per family of rules; m(query_id, keep, floor, threshold, method).
_GRID_VIEWS = """,
    c AS (SELECT *, gap / greatest(sim, 1e-6) AS rel, gap - lead(gap) OVER (PARTITION BY query_id ORDER BY rank) AS bend,
                 top - (sim - gap) AS dropped FROM curve),
    s AS (SELECT query_id, max(n) AS n, max(top) AS top, max(bottom) AS bottom, max(gap) AS max_gap, max(rel) AS max_rel, max(bend) AS max_bend,
                 avg(sim) FILTER (rank <= 100) AS head_mean, stddev_pop(sim) FILTER (rank <= 100) AS head_std,
                 avg(gap) AS gap_mean, stddev_pop(gap) AS gap_std, greatest(max(top) - max(bottom), 0.001) AS total
          FROM c GROUP BY query_id),
    p AS (SELECT c.query_id,
                 min(rank) FILTER (gap = max_gap) AS gap_at, min(rank) FILTER (rel = max_rel) AS rel_at, min(rank) FILTER (bend = max_bend) + 1 AS bend_at,
                 min(rank) FILTER (gap >= gap_mean + 2 * gap_std) AS z2_at, min(rank) FILTER (gap >= gap_mean + 3 * gap_std) AS z3_at,
                 min(rank) FILTER (gap >= CASE WHEN s.top >= 0.95 THEN 0.04 ELSE 0.02 END) AS two_at,
                 min(rank) FILTER (gap IS NOT NULL AND dropped >= 0.3 * total) AS d03, min(rank) FILTER (gap IS NOT NULL AND dropped >= 0.4 * total) AS d04,
                 min(rank) FILTER (gap IS NOT NULL AND dropped >= 0.5 * total) AS d05, min(rank) FILTER (gap IS NOT NULL AND dropped >= 0.6 * total) AS d06,
                 min(rank) FILTER (gap IS NOT NULL AND dropped >= 0.7 * total) AS d07
          FROM c JOIN s USING (query_id) GROUP BY c.query_id),
    u AS (SELECT s.*, p.* EXCLUDE (query_id),
                 z2.sim - z2.gap / 2 AS z2_mid, z3.sim - z3.gap / 2 AS z3_mid, two.sim - two.gap / 2 AS two_mid
          FROM s JOIN p USING (query_id) LEFT JOIN c z2 ON z2.query_id = s.query_id AND z2.rank = z2_at
          LEFT JOIN c z3 ON z3.query_id = s.query_id AND z3.rank = z3_at LEFT JOIN c two ON two.query_id = s.query_id AND two.rank = two_at),
    m AS ({rules}),
    grid AS (SELECT m.query_id, m.method,
               CAST(count(*) FILTER (CASE WHEN threshold IS NOT NULL THEN k.sim >= threshold ELSE k.rank <= keep AND k.sim >= m.floor END) AS INTEGER) AS count,
               coalesce(any_value(threshold), min(k.sim) FILTER (k.rank <= keep AND k.sim >= m.floor), 0.0) AS threshold
             FROM m JOIN knn k USING (query_id) GROUP BY m.query_id, m.method)"""


def _rules_sql() -> str:
    rules = [(
        "current_max_gap_0.02", 0.25, "NULL",
        "CASE WHEN max_gap >= 0.02 THEN CASE WHEN gap_at = 1 AND top < 0.5 THEN 0 ELSE gap_at END WHEN top < 0.4 THEN 0 ELSE n END",
    )]

    def prefix(name, floor, keep, min_keep=0):
        rules.append((name, floor, "NULL", f"CASE WHEN top < {floor} THEN 0 ELSE greatest({keep}, {min_keep}) END"))

    for gap in ("0.02", "0.03", "0.05"):
        prefix(f"relative_gap_{gap}_min0.40", 0.40, f"CASE WHEN max_rel < {gap} THEN n ELSE rel_at END")
    prefix("curvature_min0.40", 0.40, "bend_at")
    prefix("kneedle_min0.40", 0.40, "CASE WHEN top - bottom < 0.001 THEN n ELSE 1 END")
    for k in ("1", "1.5", "2"):
        rules.append((f"mean_minus_{k}std_top100_min0.40", 0, f"greatest(head_mean - {k}::DOUBLE * head_std, 0.40)", "0"))
    for z in ("2", "3"):
        rules.append((f"gap_zscore_{z}_min0.40", 0, f"greatest(coalesce(z{z}_mid, bottom), 0.40)", "0"))
    for r in ("0.5", "0.7", "0.3", "0.4", "0.6"):
        prefix(f"drop_rate_{r}_min0.40", 0.40, f"coalesce(d{r.replace('.', '')}, n)")
    for r, keep in (("0.5", 5), ("0.5", 10), ("0.6", 5)):
        prefix(f"drop_rate_{r}_min0.40_mink{keep}", 0.40, f"coalesce(d{r.replace('.', '')}, n)", keep)
    for keep in (5, 10):
        prefix(f"curvature_min0.40_mink{keep}", 0.40, "bend_at", keep)
    for gap in ("0.03", "0.05"):
        prefix(f"relative_gap_{gap}_min0.40_mink5", 0.40, f"CASE WHEN max_rel < {gap} THEN n ELSE rel_at END", 5)
    for r, floor, keep in (("0.5", "0.70", 5), ("0.5", "0.75", 5), ("0.5", "0.80", 5), ("0.5", "0.70", 10), ("0.5", "0.75", 10), ("0.4", "0.70", 5), ("0.4", "0.75", 5)):
        prefix(f"drop_rate_{r}_min{floor}_mink{keep}", floor, f"coalesce(d{r.replace('.', '')}, n)", keep)
    rules.append((
        "two_phase_high0.95_factor2_min0.40", 0,
        "CASE WHEN top >= 0.40 THEN coalesce(two_mid, greatest(bottom, 0.40)) END", "0",
    ))
    return " UNION ALL ".join(
        f"SELECT query_id, '{name}' AS method, CAST({keep} AS BIGINT) AS keep, {floor}::DOUBLE AS floor, CAST({threshold} AS DOUBLE) AS threshold FROM u"
        for name, floor, threshold, keep in rules
    )


_GRID_SQL = _GRID_VIEWS.format(rules=_rules_sql())


@query("w13_method_grid", "vec knn curve", f"{_GRID_SQL} SELECT query_id, method, round(threshold, 6) AS threshold, count FROM grid")
def _(lib):
    return curves.apply_methods(_curves(lib)).withColumn("threshold", F.round("threshold", 6))


@query("d14_compare_methods", "vec knn curve", f"""{_GRID_SQL}
    SELECT method, round(avg(count), 2) AS mean, CAST(floor(median(count)) AS INTEGER) AS median, min(count) AS min, max(count) AS max,
      {", ".join(f'CAST(count(*) FILTER (count BETWEEN {lo} AND {hi}) AS BIGINT) AS "bucket_{b}"' for b, lo, hi in curve_stats.METHOD_BUCKETS)}
    FROM grid GROUP BY method""")
def _(lib):
    return curve_stats.compare_methods(curves.apply_methods(_curves(lib)))


@query("w17_method_examples", "vec knn curve", f"""{_GRID_SQL}
    SELECT query_id, round(max(threshold) FILTER (method = 'mean_minus_2std_top100_min0.40'), 4) AS mean_threshold,
           max(count) FILTER (method = 'drop_rate_0.5_min0.40_mink5') AS drop_count
    FROM grid WHERE query_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY query_id""")
def _(lib):
    chosen = lib.table("labels").where("quality = 1").select(F.col("doc_id").alias("query_id"))
    wide = curves.method_examples(_curves(lib), chosen)
    return wide.select(
        "query_id", F.col("`mean_minus_2std_top100_min0.40_threshold`").alias("mean_threshold"),
        F.col("`drop_rate_0.5_min0.40_mink5_count`").alias("drop_count"),
    )


# Rules at floors this data reaches, so that every branch is taken.
def _low_rules():
    return {
        "max_gap": curves.max_gap_rule(0.01),
        "relative": curves.relative_gap_rule(0.05, 0.2),
        "relative_keep": curves.relative_gap_rule(0.05, 0.2, 5),
        "bend": curves.curvature_rule(0.2),
        "bend_keep": curves.curvature_rule(0.2, 10),
        "diagonal": curves.diagonal_rule(0.2),
        "mean_std": curves.mean_std_rule(0.5, 0.1),
        "zscore": curves.gap_zscore_rule(2.0, 0.1),
        "drop": curves.drop_rate_rule(0.4, 0.1),
        "drop_keep": curves.drop_rate_rule(0.3, 0.1, 10),
        "two_phase": curves.two_phase_rule(0.4, 2.0, 0.1),
    }


_LOW_SQL = _GRID_VIEWS.replace("s.top >= 0.95", "s.top >= 0.4").format(rules=" UNION ALL ".join(
    f"SELECT query_id, '{name}' AS method, CAST({keep} AS BIGINT) AS keep, {floor}::DOUBLE AS floor, CAST({threshold} AS DOUBLE) AS threshold FROM u"
    for name, floor, threshold, keep in (
        ("max_gap", 0.25, "NULL", "CASE WHEN max_gap >= 0.01 THEN CASE WHEN gap_at = 1 AND top < 0.5 THEN 0 ELSE gap_at END WHEN top < 0.4 THEN 0 ELSE n END"),
        ("relative", 0.2, "NULL", "CASE WHEN top < 0.2 THEN 0 WHEN max_rel < 0.05 THEN n ELSE rel_at END"),
        ("relative_keep", 0.2, "NULL", "CASE WHEN top < 0.2 THEN 0 WHEN max_rel < 0.05 THEN n ELSE greatest(rel_at, 5) END"),
        ("bend", 0.2, "NULL", "CASE WHEN top < 0.2 THEN 0 ELSE bend_at END"),
        ("bend_keep", 0.2, "NULL", "CASE WHEN top < 0.2 THEN 0 ELSE greatest(bend_at, 10) END"),
        ("diagonal", 0.2, "NULL", "CASE WHEN top < 0.2 THEN 0 ELSE 1 END"),
        ("mean_std", 0, "greatest(head_mean - 0.5 * head_std, 0.1)", "0"),
        ("zscore", 0, "greatest(coalesce(z2_mid, bottom), 0.1)", "0"),
        ("drop", 0.1, "NULL", "coalesce(d04, n)"),
        ("drop_keep", 0.1, "NULL", "greatest(coalesce(d03, n), 10)"),
        ("two_phase", 0, "coalesce(two_mid, greatest(bottom, 0.1))", "0"),
    )))


@query("w4_w12_rules", "vec knn curve", f"{_LOW_SQL} SELECT query_id, method, round(threshold, 6) AS threshold, count FROM grid")
def _(lib):
    return curves.apply_methods(_curves(lib), _low_rules()).withColumn("threshold", F.round("threshold", 6))


_SUMMARY_SQL = """,
    gaps AS (SELECT query_id, gap, rank, row_number() OVER (PARTITION BY query_id ORDER BY gap DESC, rank DESC) AS pos FROM curve WHERE gap IS NOT NULL),
    g AS (SELECT query_id, max(gap) FILTER (pos = 1) AS max_gap, max(rank) FILTER (pos = 1) AS max_gap_rank,
                 max(gap) FILTER (pos = 2) AS second_max_gap, max(rank) FILTER (pos = 2) AS second_max_gap_rank,
                 min(rank) FILTER (gap = (SELECT max(h.gap) FROM curve h WHERE h.query_id = gaps.query_id)) AS first_max FROM gaps GROUP BY query_id),
    summary AS (
      SELECT query_id, CAST(max(n) AS INTEGER) AS candidate_count,
             {tops}, avg(sim) FILTER (rank <= 50) AS mean_top50_similarity,
             any_value(max_gap) AS max_gap, any_value(max_gap_rank) AS max_gap_rank,
             any_value(second_max_gap) AS second_max_gap, any_value(second_max_gap_rank) AS second_max_gap_rank,
             {counts},
             CAST(CASE WHEN any_value(max_gap) < 0.02 AND max(top) < 0.4 THEN 0
                  WHEN count(*) FILTER (sim >= 0.25 AND rank <= CASE WHEN max_gap >= 0.02 THEN first_max ELSE n END) = 1 AND max(top) < 0.5 THEN 0
                  ELSE least(100, count(*) FILTER (sim >= 0.25 AND rank <= CASE WHEN max_gap >= 0.02 THEN first_max ELSE n END)) END AS INTEGER) AS current_strategy_result_count
      FROM curve JOIN g USING (query_id) GROUP BY query_id)""".format(
    tops=", ".join(f"coalesce(max(sim) FILTER (rank = {r}), min(sim)) AS top{r}_similarity" for r in curves.FEATURE_RANKS),
    counts=", ".join(f'CAST(count(*) FILTER (sim >= {f}) AS INTEGER) AS "count_ge_{f}"' for f in curves.COUNT_FLOORS),
)


@query("d4_d7_w3_curve_summary", "vec knn curve", f"""{_SUMMARY_SQL}
    SELECT * REPLACE ({", ".join(f"round({c}, 6) AS {c}" for c in curve_stats.QUANTILE_FIELDS)}) FROM summary""")
def _(lib):
    summary = _summary(lib)
    return summary.withColumns({c: F.round(c, 6) for c in curve_stats.QUANTILE_FIELDS})


@query("d8_top1_statistics", "vec knn", f"""
    SELECT round(avg(sim), 6) AS mean, {", ".join(f"round(quantile_cont(sim, {p}), 6) AS {n}" for p, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95")))}
    FROM knn WHERE rank = 1""")
def _(lib):
    stats = curve_stats.top1_statistics(_summary(lib))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


@query("d9_quantile_table", "vec knn curve", f"""{_SUMMARY_SQL},
    long AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS v FROM summary" for c in curve_stats.QUANTILE_FIELDS)})
    SELECT metric, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
           round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max FROM long GROUP BY metric""")
def _(lib):
    table = curve_stats.quantile_table(_summary(lib))
    return table.select("metric", *[F.round(c, 6).alias(c) for c in table.columns if c != "metric"])


_BUCKET_ROWS = ", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in curve_stats.SUMMARY_BUCKETS)


@query("d11_distribution_by_threshold", "vec knn curve", f"""{_SUMMARY_SQL},
    long AS ({" UNION ALL ".join(f"""SELECT '{f}' AS threshold, "count_ge_{f}" AS c FROM summary""" for f in curves.COUNT_FLOORS)}),
    edges(bucket, lo, hi) AS (VALUES {_BUCKET_ROWS})
    SELECT t.threshold, bucket, count(l.c) AS query_count, round(count(l.c) / (SELECT count(*) FROM summary) * 100, 2) AS percent
    FROM (SELECT DISTINCT threshold FROM long) t CROSS JOIN edges LEFT JOIN long l ON l.threshold = t.threshold AND l.c BETWEEN lo AND hi
    GROUP BY t.threshold, bucket""")
def _(lib):
    return curve_stats.distribution_by_threshold(_summary(lib))


@query("d12_current_distribution", "vec knn curve", f"""{_SUMMARY_SQL}, edges(bucket, lo, hi) AS (VALUES {_BUCKET_ROWS})
    SELECT bucket, count(query_id) AS query_count, round(count(query_id) / (SELECT count(*) FROM summary) * 100, 2) AS percent
    FROM edges LEFT JOIN summary ON current_strategy_result_count BETWEEN lo AND hi GROUP BY bucket""")
def _(lib):
    return curve_stats.current_distribution(_summary(lib))


@query("d10_result_histogram", "vec knn", f""", {_KNEE_SQL.format(ranked='knn')},
    edges(bucket, lo, hi) AS (VALUES {", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in curve_stats.METHOD_BUCKETS)}),
    c AS (SELECT v.image_id, count(k.rank) AS n FROM vec v LEFT JOIN kept k ON k.query_id = v.image_id GROUP BY 1)
    SELECT bucket, count(n) AS query_count, round(count(n) / (SELECT count(*) FROM c) * 100, 2) AS percent
    FROM edges LEFT JOIN c ON n BETWEEN lo AND hi GROUP BY bucket""")
def _(lib):
    kept = curves.knee_filter(_neighbours(lib), _KNEE).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    counts = lib.vec.select(F.col("image_id").alias("query_id")).join(kept, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return curve_stats.histogram(counts, "n", curve_stats.METHOD_BUCKETS)


@query("a9_wide_scores", "vec knn", """
    SELECT query_id, round(max(sim) FILTER (rank = 1), 6) AS score_1, round(max(sim) FILTER (rank = 7), 6) AS score_7,
           CAST(NULL AS DOUBLE) AS score_201, max(candidate_id) FILTER (rank = 200) AS candidate_200
    FROM knn GROUP BY query_id""")
def _(lib):
    ranked = _neighbours(lib)
    scores = backup.wide_curves(ranked, "sim", "score_", 201)
    ids = backup.wide_curves(ranked, "candidate_id", "candidate_", 200)
    rounded = [F.round(c, 6).alias(c) for c in ("score_1", "score_7", "score_201")]
    return scores.select("query_id", *rounded).join(ids.select("query_id", "candidate_200"), "query_id")


@query("a10_curves_from_wide", "vec knn", "SELECT query_id, rank, round(sim, 6) AS sim FROM knn WHERE rank < 150")
def _(lib):
    wide = backup.wide_curves(_neighbours(lib), "sim", "score_", 200).withColumn("score_150", F.lit(None).cast("double"))
    long = backup.curves_from_wide(wide, [f"score_{i}" for i in range(1, 201)])
    return long.withColumn("sim", F.round("sim", 6))


_CLUSTER_SQL = """,
    floors(threshold) AS (VALUES (0.45::DOUBLE), (0.40::DOUBLE), (0.35::DOUBLE), (0.30::DOUBLE)),
    edges AS (SELECT threshold, least(query_id, candidate_id) AS a, greatest(query_id, candidate_id) AS b
              FROM knn JOIN floors ON sim >= threshold GROUP BY ALL HAVING count(*) = 2),
    both_ways AS (SELECT threshold, a, b FROM edges UNION ALL SELECT threshold, b, a FROM edges),
    reach AS (SELECT DISTINCT threshold, a AS node, a AS seen FROM both_ways
              UNION SELECT r.threshold, r.node, e.b FROM reach r JOIN both_ways e ON e.threshold = r.threshold AND e.a = r.seen),
    member AS (SELECT threshold, node, min(seen) AS root FROM reach GROUP BY threshold, node),
    sizes AS (SELECT threshold, root, count(*) AS size FROM member GROUP BY ALL),
    named AS (SELECT *, format('T{:.2f}_{:05d}', threshold, row_number() OVER (PARTITION BY threshold ORDER BY size DESC, root)) AS cluster_id FROM sizes)"""


def _clusters(lib):
    return clusters.near_duplicate_clusters(_neighbours(lib), _FLOORS)


@query("d19_near_duplicate_clusters", "vec knn", f"""{_CLUSTER_SQL}
    SELECT m.threshold, cluster_id, size, node AS member_id FROM member m JOIN named USING (threshold, root)""")
def _(lib):
    return _clusters(lib)


@query("d13_cluster_statistics", "vec knn", f"""{_CLUSTER_SQL}
    SELECT f.threshold, count(size) AS clusters, CAST(coalesce(sum(size), 0) AS BIGINT) AS members, CAST(floor(median(size)) AS BIGINT) AS median_size,
           CAST(floor(quantile_cont(size, 0.9)) AS BIGINT) AS p90_size, max(size) AS max_size, count(*) FILTER (size >= 5) AS size_ge_5
    FROM (SELECT threshold FROM floors UNION ALL SELECT 0.99) f LEFT JOIN sizes USING (threshold) GROUP BY f.threshold""")
def _(lib):
    return curve_stats.cluster_statistics(clusters.cluster_sizes(_clusters(lib)), (*_FLOORS, 0.99))


@query("a9_cluster_lists", "vec knn", f"""{_CLUSTER_SQL}
    SELECT m.threshold, cluster_id, size, 0 AS part, string_agg(CAST(node AS VARCHAR), ';' ORDER BY node) AS members
    FROM member m JOIN named USING (threshold, root) GROUP BY ALL""")
def _(lib):
    return backup.cluster_lists(_clusters(lib))
