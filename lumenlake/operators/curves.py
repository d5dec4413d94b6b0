"""Cut-off rules over descending similarity curves (W2-W13) and curve features.

A ranked table (query_id, rank, candidate_id, sim) has at most a few hundred
rows per query. One shuffle on query_id turns it into one row per query with the
scores, the gaps and the moments all rules share; each rule is then a cheap
expression on that row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CANDIDATE_COUNT = 200
MAX_RESULTS = 100
COUNT_FLOORS = ("0.99", "0.98", "0.95", "0.92", "0.90", "0.85", "0.80", "0.75", "0.70", "0.60", "0.50", "0.40", "0.35", "0.30")
FEATURE_RANKS = (1, 5, 10, 20, 50, 100, 200)
MEAN_RANKS = 50
STD_RANKS = 100
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class KneeSettings:
    """Parameters of the production cut-off with their allowed ranges (H5)."""

    drop_ratio: float = 0.5
    min_keep: int = 5
    min_similarity: float = 0.50
    max_results: int = MAX_RESULTS
    candidates: int = CANDIDATE_COUNT

    def __post_init__(self) -> None:
        if not 0.0 < self.drop_ratio < 1.0:
            raise ValueError("drop_ratio must lie between 0 and 1")
        if self.min_keep < 0:
            raise ValueError("min_keep must not be negative")
        if not 0.0 <= self.min_similarity <= 1.0:
            raise ValueError("min_similarity must lie in [0, 1]")
        if self.max_results <= 0:
            raise ValueError("max_results must be positive")
        if self.candidates <= 0:
            raise ValueError("candidates must be positive")


def knee_filter(ranked: DataFrame, settings: KneeSettings = KneeSettings()) -> DataFrame:
    """Candidates kept by the cumulative-drop rule (W2), in their rank order.

    The drop is measured over all candidates, below the floor as well, and is
    summed in rank order.
    """
    curve = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dropped = (
        ranked.withColumn("_gap", F.col("sim") - F.lead("sim").over(curve))
        .withColumn("_drop", F.sum("_gap").over(curve.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_top", F.first("sim").over(whole))
        .withColumn("_total", F.greatest(F.col("_top") - F.last("sim").over(whole), F.lit(1e-9)))
    )
    reached = F.col("_gap").isNotNull() & (F.col("_drop") >= F.lit(settings.drop_ratio) * F.col("_total"))
    cut = F.greatest(
        F.coalesce(F.min(F.when(reached, F.col("rank"))).over(whole), F.max("rank").over(whole)), F.lit(settings.min_keep)
    )
    floor = F.lit(settings.min_similarity)
    return (
        dropped.withColumn("_cut", cut)
        .where((F.col("_top") >= floor) & (F.col("rank") <= F.col("_cut")) & (F.col("sim") >= floor))
        .where(F.col("rank") <= settings.max_results)
        .select(*ranked.columns)
    )


def to_curves(ranked: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row per query: descending scores, adjacent gaps and their moments.

    With `queries` (query_id) also those without any candidate get a row.
    """
    in_order = Window.partitionBy("query_id").orderBy("rank")
    sim, rank = F.col("sim"), F.col("rank")

    def ordered(value: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("rank", value)))), lambda p: p[value])

    curves = (
        ranked.select("query_id", "rank", "sim", (sim - F.lead("sim").over(in_order)).alias("gap"))
        .groupBy("query_id")
        .agg(
            ordered("sim").alias("scores"),
            ordered("gap").alias("gaps"),
            F.count(F.lit(1)).cast("int").alias("n"),
            F.max("sim").alias("top"),
            F.min("sim").alias("bottom"),
            F.avg(F.when(rank <= MEAN_RANKS, sim)).alias("mean_first"),
            F.avg(F.when(rank <= STD_RANKS, sim)).alias("head_mean"),
            F.stddev_pop(F.when(rank <= STD_RANKS, sim)).alias("head_std"),
            F.avg("gap").alias("gap_mean"),
            F.stddev_pop("gap").alias("gap_std"),
        )
    )
    if queries is None:
        return curves
    return (
        queries.select("query_id").distinct().join(curves, "query_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))
        .withColumn("gaps", F.coalesce("gaps", F.array().cast("array<double>")))
    )


def _score(scores: str | Column, i: Column) -> Column:
    return F.get(scores, i.cast("int") - 1)


def _first_max(values: Column) -> Column:
    return F.array_position(values, F.array_max(values))


def _count_ge(threshold: Column) -> Column:
    return F.size(F.filter("scores", lambda v: v >= threshold))


def _cut(keep: Column | None = None, floor: float | None = None, threshold: Column | None = None) -> Column:
    """A rule's verdict: keep a prefix above a floor, or everything above a threshold."""
    return F.struct(
        (keep if keep is not None else F.lit(None)).cast("int").alias("keep"),
        F.lit(floor).cast("double").alias("floor"),
        (threshold if threshold is not None else F.lit(None)).cast("double").alias("threshold"),
    )


def _nothing() -> Column:
    return _cut(keep=F.lit(0), floor=0.0)


def _everything() -> Column:
    return _cut(keep=F.col("n"), floor=float("-inf"))


def _guard(floor: float, rule: Column) -> Column:
    """No result for an empty curve or a top score below the floor."""
    return F.when((F.col("n") == 0) | (F.col("top") < floor), _nothing()).otherwise(rule)


def _drop_position(ratio: float, least_total: float) -> Column:
    """Position where the running drop reaches `ratio` of the total; null when it never does."""
    total = F.greatest(F.col("top") - F.col("bottom"), F.lit(least_total))
    start = F.struct(F.lit(0.0).alias("drop"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))

    def step(acc: Column, gap: Column) -> Column:
        drop, i = acc["drop"] + gap, acc["i"] + 1
        at = F.coalesce(acc["at"], F.when(drop >= F.lit(ratio) * total, i))
        return F.struct(drop.alias("drop"), i.alias("i"), at.alias("at"))

    return F.aggregate("gaps", start, step, lambda acc: acc["at"])


def _max_gap_keep(min_gap: float, no_gap_top: float) -> Column:
    """Prefix before the first largest gap, else all or, for a weak top score, null."""
    biggest = F.coalesce(F.array_max("gaps"), F.lit(0.0))
    return F.when(biggest >= min_gap, _first_max(F.col("gaps"))).when(F.col("top") >= no_gap_top, F.col("n"))


def max_gap_rule(min_gap: float) -> Column:
    """Largest gap with inline limits 0.4 / 0.5 / 0.25; a lone result is judged before the floor."""
    keep = _max_gap_keep(min_gap, 0.4)
    lone = (keep == 1) & (F.col("top") < 0.5)
    return F.when((F.col("n") == 0) | keep.isNull() | lone, _nothing()).otherwise(_cut(keep, 0.25))


def relative_gap_rule(min_relative_gap: float, floor: float, min_keep: int = 0) -> Column:
    """Largest gap relative to its upper score; below the minimum keep everything."""
    relative = F.zip_with("gaps", "scores", lambda g, s: g / F.greatest(s, F.lit(1e-6)))
    relative = F.slice(relative, F.lit(1), F.size("gaps"))
    keep = F.when(F.array_max(relative) < min_relative_gap, F.col("n")).otherwise(_first_max(relative))
    rule = F.when(F.col("n") == 1, _everything()).otherwise(_cut(F.greatest(keep, F.lit(min_keep)), floor))
    return _guard(floor, rule)


def curvature_rule(floor: float, min_keep: int = 0) -> Column:
    """Largest second difference; curves shorter than three are kept whole."""
    following = F.slice("gaps", F.lit(2), F.greatest(F.size("gaps") - 1, F.lit(0)))
    bends = F.slice(F.zip_with("gaps", following, lambda g, after: g - after), F.lit(1), F.size(following))
    keep = F.greatest(_first_max(bends) + 1, F.lit(min_keep))
    return _guard(floor, F.when(F.col("n") < 3, _everything()).otherwise(_cut(keep, floor)))


def diagonal_rule(floor: float) -> Column:
    """Largest distance above the diagonal of the normalised curve.

    On a descending curve the first point always wins, so this keeps one result
    unless the curve is flat; reproduced as it stands.
    """
    n, lo, hi = F.col("n"), F.col("bottom"), F.col("top")
    above = F.transform("scores", lambda v, i: (v - lo) / (hi - lo) - i / (n - 1))
    return _guard(floor, F.when(hi - lo < 0.001, _everything()).otherwise(_cut(_first_max(above), floor)))


def mean_std_rule(k: float, floor: float) -> Column:
    """Everything above mean - k * std of the first 100 scores, at least the floor."""
    threshold = F.greatest(F.col("head_mean") - F.lit(k) * F.col("head_std"), F.lit(floor))
    return F.when(F.col("n") == 0, _nothing()).otherwise(_cut(threshold=threshold))


def _first_gap(test) -> Column:
    """1-based position of the first gap passing `test`, null when none does."""
    at = F.array_position(F.transform("gaps", test), F.lit(True))
    return F.when(at > 0, at)


def _midpoint(at: Column) -> Column:
    return _score("scores", at + 1) + _score("gaps", at) / 2


def gap_zscore_rule(z: float, floor: float) -> Column:
    """Midpoint of the first gap of at least mean + z * std, else the last score."""
    limit = F.col("gap_mean") + F.lit(z) * F.col("gap_std")
    at = _first_gap(lambda g: g >= limit)
    threshold = F.greatest(F.coalesce(_midpoint(at), F.col("bottom")), F.lit(floor))
    return F.when(F.col("n") < 2, _nothing()).otherwise(_cut(threshold=threshold))


def drop_rate_rule(ratio: float, floor: float, min_keep: int = 0) -> Column:
    """Cumulative drop with a total of at least 0.001."""
    keep = F.greatest(F.coalesce(_drop_position(ratio, 0.001), F.col("n")), F.lit(min_keep))
    return _guard(floor, _cut(keep, floor))


def two_phase_rule(high_floor: float, factor: float, floor: float) -> Column:
    """First gap of 0.02, wider by `factor` for a high top score; cut at its midpoint."""
    needed = F.when(F.col("top") >= high_floor, F.lit(0.02 * factor)).otherwise(F.lit(0.02))
    at = _first_gap(lambda g: g >= needed)
    threshold = F.coalesce(_midpoint(at), F.greatest(F.col("bottom"), F.lit(floor)))
    rule = F.when(F.col("n") == 1, _everything()).otherwise(_cut(threshold=threshold))
    return _guard(floor, rule)


def legacy_gap_count(
    min_gap: float = 0.02,
    no_gap_top: float = 0.4,
    floor: float = 0.25,
    lone_floor: float = 0.5,
    max_results: int = MAX_RESULTS,
) -> Column:
    """Result count of the earlier max-gap rule (W3): the lone check follows the floor."""
    keep = _max_gap_keep(min_gap, no_gap_top)
    kept = F.least(keep.cast("int"), _count_ge(F.lit(floor)))
    lone = (kept == 1) & (F.col("top") < lone_floor)
    return F.when((F.col("n") == 0) | keep.isNull() | lone, F.lit(0)).otherwise(F.least(kept, F.lit(max_results)))


def method_grid() -> dict[str, Column]:
    """The named parameterisations compared with each other (W13), in their report order."""
    grid: dict[str, Column] = {"current_max_gap_0.02": max_gap_rule(0.02)}
    for gap in ("0.02", "0.03", "0.05"):
        grid[f"relative_gap_{gap}_min0.40"] = relative_gap_rule(float(gap), 0.40)
    grid["curvature_min0.40"] = curvature_rule(0.40)
    grid["kneedle_min0.40"] = diagonal_rule(0.40)
    for k in ("1", "1.5", "2"):
        grid[f"mean_minus_{k}std_top100_min0.40"] = mean_std_rule(float(k), 0.40)
    for z in ("2", "3"):
        grid[f"gap_zscore_{z}_min0.40"] = gap_zscore_rule(float(z), 0.40)
    for ratio in ("0.5", "0.7", "0.3", "0.4", "0.6"):
        grid[f"drop_rate_{ratio}_min0.40"] = drop_rate_rule(float(ratio), 0.40)
    for ratio, keep in (("0.5", 5), ("0.5", 10), ("0.6", 5)):
        grid[f"drop_rate_{ratio}_min0.40_mink{keep}"] = drop_rate_rule(float(ratio), 0.40, keep)
    for keep in (5, 10):
        grid[f"curvature_min0.40_mink{keep}"] = curvature_rule(0.40, keep)
    for gap in ("0.03", "0.05"):
        grid[f"relative_gap_{gap}_min0.40_mink5"] = relative_gap_rule(float(gap), 0.40, 5)
    for ratio, floor, keep in (
        ("0.5", "0.70", 5), ("0.5", "0.75", 5), ("0.5", "0.80", 5), ("0.5", "0.70", 10), ("0.5", "0.75", 10),
        ("0.4", "0.70", 5), ("0.4", "0.75", 5),
    ):
        grid[f"drop_rate_{ratio}_min{floor}_mink{keep}"] = drop_rate_rule(float(ratio), float(floor), keep)
    grid["two_phase_high0.95_factor2_min0.40"] = two_phase_rule(0.95, 2.0, 0.40)
    return grid


def apply_methods(curves: DataFrame, methods: dict[str, Column] | None = None) -> DataFrame:
    """(query_id, method, threshold, count) for every curve and method (W13); no row is shuffled.

    A prefix rule reports its last kept score as threshold, 0 when nothing is kept.
    """
    methods = methods or method_grid()
    verdicts = F.array(*[F.struct(F.lit(name).alias("method"), rule.alias("cut")) for name, rule in methods.items()])
    cut = curves.select("query_id", "scores", F.explode(verdicts).alias("v")).select("query_id", "scores", "v.method", "v.cut.*")
    above = F.when(F.col("threshold").isNotNull(), _count_ge(F.col("threshold"))).otherwise(
        F.least(F.col("keep"), _count_ge(F.col("floor")))
    )
    counted = cut.withColumn("count", above)
    last_kept = F.coalesce(_score("scores", F.col("count")), F.lit(0.0))
    return counted.select("query_id", "method", F.coalesce("threshold", last_kept).alias("threshold"), "count")


def method_examples(curves: DataFrame, query_ids: DataFrame, methods: dict[str, Column] | None = None) -> DataFrame:
    """Threshold and count of every method for chosen queries, one wide row each."""
    methods = methods or method_grid()
    chosen = curves.join(query_ids.select("query_id").distinct(), "query_id", "left_semi")
    columns = []
    for name in methods:
        mine = F.col("method") == name
        columns.append(F.max(F.when(mine, F.round("threshold", 4))).alias(f"{name}_threshold"))
        columns.append(F.max(F.when(mine, F.col("count"))).alias(f"{name}_count"))
    return apply_methods(chosen, methods).groupBy("query_id").agg(*columns)


def score_at(rank: int) -> Column:
    """Score at `rank`, the last one on a shorter curve, 0 on an empty one."""
    at = F.least(F.lit(rank), F.col("n"))
    return F.coalesce(_score("scores", at), F.lit(0.0))


def gap_summary() -> Column:
    """The two largest gaps with their ranks; equal gaps: the later rank first."""
    numbered = F.transform("gaps", lambda g, i: F.struct(g.alias("gap"), (i + 1).alias("rank")))
    best = F.slice(F.sort_array(numbered, asc=False), 1, 2)

    def part(i: int, field: str, zero: Column) -> Column:
        return F.when(F.size(best) > i, F.get(best, F.lit(i))[field]).otherwise(zero)

    return F.struct(
        part(0, "gap", F.lit(0.0)).alias("max_gap"),
        part(0, "rank", F.lit(0)).alias("max_gap_rank"),
        part(1, "gap", F.lit(0.0)).alias("second_max_gap"),
        part(1, "rank", F.lit(0)).alias("second_max_gap_rank"),
    )


def curve_summary(curves: DataFrame, ranks: Sequence[int] = FEATURE_RANKS, floors: Sequence[str] = COUNT_FLOORS) -> DataFrame:
    """One summary row per query: D4, D5, D6, D7 and the W3 count."""
    return curves.select(
        "query_id",
        F.col("n").alias("candidate_count"),
        *[score_at(r).alias(f"top{r}_similarity") for r in ranks],
        F.coalesce("mean_first", F.lit(0.0)).alias("mean_top50_similarity"),
        gap_summary().alias("_g"),
        *[_count_ge(F.lit(float(f))).alias(f"count_ge_{f}") for f in floors],
        legacy_gap_count().alias("current_strategy_result_count"),
    ).select("query_id", "candidate_count", *[f"top{r}_similarity" for r in ranks], "mean_top50_similarity", "_g.*",
             *[f"`count_ge_{f}`" for f in floors], "current_strategy_result_count")
