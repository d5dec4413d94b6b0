"""Statistics over many curves: quantiles, histograms, method comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.curves import COUNT_FLOORS
from lumenlake.operators.ordering import with_global_index

# --- fixed values: histogram classes (label, low, high); above the last edge counts as last ---
SUMMARY_BUCKETS = (("0", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("6-20", 6, 20), ("21-100", 21, 100), ("101-200", 101, 200))
METHOD_BUCKETS = (
    ("0", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("6-20", 6, 20), ("21-50", 21, 50), ("51-100", 51, 100), ("101-200", 101, 200),
)
QUANTILE_FIELDS = (
    "top1_similarity", "top5_similarity", "top10_similarity", "top20_similarity", "top50_similarity",
    "top100_similarity", "top200_similarity", "mean_top50_similarity", "max_gap", "second_max_gap",
)
CLUSTER_FLOORS = (0.95, 0.90, 0.85, 0.80, 0.75, 0.70)
# ----------------------------------------------------------------------------------------------


def bucket_of(count: str | Column, buckets=SUMMARY_BUCKETS) -> Column:
    """Histogram label of a result count."""
    c = F.col(count) if isinstance(count, str) else count
    label = F.when(c == 0, F.lit(buckets[0][0]))
    for name, low, high in buckets[1:-1]:
        label = label.when((c >= low) & (c <= high), F.lit(name))
    return label.otherwise(F.lit(buckets[-1][0]))


def unpivot(rows: DataFrame, columns: Sequence[str], name: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Wide columns to long rows (name, value)."""
    return rows.unpivot([F.col(k) for k in keep], [F.col(f"`{c}`") for c in columns], name, value)


def histogram(
    counts: DataFrame, value: str, buckets=SUMMARY_BUCKETS, group: str | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """(group, bucket, query_count, percent) with empty classes kept.

    The grid of groups and classes is a literal list, so nothing is cross-joined.
    """
    spark = counts.sparkSession
    key = group or "_all"
    if not group:
        counts, groups = counts.withColumn(key, F.lit("")), ("",)
    found = counts.groupBy(key, bucket_of(value, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("query_count"))
    grid = spark.createDataFrame([(g, b[0]) for g in groups for b in buckets], f"{key} string, bucket string")
    filled = F.broadcast(grid).join(found, [key, "bucket"], "left").withColumn("query_count", F.coalesce("query_count", F.lit(0)))
    # One row per class from here on.
    joined = filled.join(filled.groupBy(key).agg(F.sum("query_count").alias("_total")), key)
    percent = F.when(F.col("_total") > 0, F.round(F.col("query_count") / F.col("_total") * 100, 2)).otherwise(F.lit(0.0))
    return joined.select(*([group] if group else []), "bucket", "query_count", percent.alias("percent"))


def distribution_by_threshold(summary: DataFrame, floors: Sequence[str] = COUNT_FLOORS) -> DataFrame:
    """Result-count histogram per similarity floor, long form."""
    long = unpivot(summary, [f"count_ge_{f}" for f in floors], "field", "n").withColumn("threshold", F.replace("field", F.lit("count_ge_"), F.lit("")))
    return histogram(long, "n", group="threshold", groups=floors)


def current_distribution(summary: DataFrame) -> DataFrame:
    """Result-count histogram of the earlier rule."""
    return histogram(summary, "current_strategy_result_count")


def exact_quantiles(rows: DataFrame, group: str, value: str, tie: str, probabilities: Sequence[float]) -> DataFrame:
    """(group, probability, quantile) with linear interpolation, for any number of rows.

    The built-in exact percentile gathers all values of a group in one buffer.
    Here the values are range-sorted and numbered; only the two rows around each
    requested position are read back.
    """
    ordered = with_global_index(rows.select(group, value, tie).where(F.col(value).isNotNull()), [group, value, tie], "_i", 0)
    spans = ordered.groupBy(group).agg(F.min("_i").alias("_start"), F.count(F.lit(1)).alias("_n"))
    wanted = (
        spans.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("_pos", F.col("probability") * (F.col("_n") - 1))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_i", F.col("_start") + F.least(F.floor("_pos") + F.col("_side"), F.col("_n") - 1))
        .withColumn("_share", F.when(F.col("_side") == 0, 1 - (F.col("_pos") - F.floor("_pos"))).otherwise(F.col("_pos") - F.floor("_pos")))
        .select("_i", "probability", "_share")
    )
    return (
        ordered.join(wanted, "_i")
        .groupBy(group, "probability")
        .agg(F.sum(F.col(value) * F.col("_share")).alias("quantile"))
    )


def _wide_quantiles(long: DataFrame, group: str, names: dict[float, str]) -> DataFrame:
    return long.groupBy(group).agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for p, n in names.items()])


def top1_statistics(summary: DataFrame) -> DataFrame:
    """Mean and percentiles of the best similarity of all queries."""
    values = unpivot(summary.where("candidate_count > 0"), ["top1_similarity"], "metric", "v", keep=["query_id"])
    names = {0.05: "p5", 0.25: "p25", 0.50: "p50", 0.75: "p75", 0.95: "p95"}
    wide = _wide_quantiles(exact_quantiles(values, "metric", "v", "query_id", list(names)), "metric", names)
    mean = values.groupBy("metric").agg(F.avg("v").alias("mean"))
    return mean.join(wide, "metric").drop("metric")


def quantile_table(summary: DataFrame, fields: Sequence[str] = QUANTILE_FIELDS) -> DataFrame:
    """Min, quartiles, P95 and max of the curve features."""
    long = unpivot(summary, fields, "metric", "v", keep=["query_id"])
    names = {0.0: "min", 0.25: "p25", 0.50: "p50", 0.75: "p75", 0.95: "p95", 1.0: "max"}
    return _wide_quantiles(exact_quantiles(long, "metric", "v", "query_id", list(names)), "metric", names)


def compare_methods(results: DataFrame) -> DataFrame:
    """Mean, median, extremes and class counts of the result counts per method.

    Counts have at most a few hundred values, so they are tallied first and the
    exact median runs over the tally.
    """
    tally = results.groupBy("method", "count").agg(F.count(F.lit(1)).alias("n"))
    label = bucket_of("count", METHOD_BUCKETS)
    return tally.groupBy("method").agg(
        F.round(F.sum(F.col("count") * F.col("n")) / F.sum("n"), 2).alias("mean"),
        F.floor(F.percentile("count", 0.5, F.col("n"))).cast("int").alias("median"),
        F.min("count").alias("min"),
        F.max("count").alias("max"),
        *[F.sum(F.when(label == b[0], F.col("n")).otherwise(0)).alias(f"bucket_{b[0]}") for b in METHOD_BUCKETS],
    )


def cluster_statistics(clusters: DataFrame, floors: Sequence[float] = CLUSTER_FLOORS) -> DataFrame:
    """Cluster counts and sizes per floor; floors without clusters stay in the list.

    Sizes are tallied first: distinct sizes are few even for many clusters.
    """
    spark = clusters.sparkSession
    tally = clusters.groupBy("threshold", "size").agg(F.count(F.lit(1)).alias("n"))
    stats = tally.groupBy("threshold").agg(
        F.sum("n").alias("clusters"),
        F.sum(F.col("size") * F.col("n")).alias("members"),
        F.floor(F.percentile("size", 0.5, F.col("n"))).cast("long").alias("median_size"),
        F.floor(F.percentile("size", 0.9, F.col("n"))).cast("long").alias("p90_size"),
        F.max("size").alias("max_size"),
        F.sum(F.when(F.col("size") >= 5, F.col("n")).otherwise(0)).alias("size_ge_5"),
    )
    listed = spark.createDataFrame([(float(f),) for f in floors], "threshold double")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("clusters", "members")]
    return F.broadcast(listed).join(stats, "threshold", "left").select(
        "threshold", *zero, "median_size", "p90_size", "max_size", F.coalesce("size_ge_5", F.lit(0)).alias("size_ge_5")
    )
