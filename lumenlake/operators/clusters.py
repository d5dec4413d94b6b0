"""Near-duplicate clusters over mutual neighbours.

A hit crosses the cluster as one narrow row. Pairs meet in blocks of the table of
all pairs, where those of a block touch few nodes; there they are reduced to a
forest that joins the same nodes on every floor, so the rounds of the components
work on a few pairs for each node, however many lie above a floor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.curve_stats import CLUSTER_FLOORS
from lumenlake.operators.ordering import skew_safe_lookup, with_global_index
from lumenlake.session import cut_lineage, drop_table, write_table

# Hits of a block on average, and the fewest worth a task of their own.
_BLOCK_HITS, _LEAST_HITS = 1 << 20, 1 << 14
# Pairs reduced at once.
_FOREST_ROWS = 1 << 18


def _hits(ranked: DataFrame, floors: Sequence[float]) -> DataFrame:
    """(query_id, candidate_id, level): hits that reach `level` of the floors, at least one."""
    level = sum((F.col("sim") >= float(f)).cast("byte") for f in floors).cast("byte")
    found = ranked.where((F.col("sim") >= min(floors)) & (F.col("query_id") != F.col("candidate_id")))
    return found.select("query_id", "candidate_id", level.alias("level"))


def _mutual(hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(a, b, level) with a < b: pairs that found each other, by the floors both hits reach, however often each is listed."""
    forth = F.col("query_id") < F.col("candidate_id")
    return (
        hits.groupBy(*keys, F.least("query_id", "candidate_id").alias("a"), F.greatest("query_id", "candidate_id").alias("b"))
        .agg(F.max(F.when(forth, F.col("level"))).alias("there"), F.max(F.when(~forth, F.col("level"))).alias("back"))
        .where(F.col("there").isNotNull() & F.col("back").isNotNull())
        .select("a", "b", F.least("there", "back").alias("level"))
    )


def _by_floor(pairs: DataFrame, floors: Sequence[float]) -> DataFrame:
    """(threshold, a, b): one row for each floor that a pair reaches."""
    ascending = F.array(*[F.lit(float(f)) for f in sorted(floors)])
    return pairs.select(F.explode(F.slice(ascending, F.lit(1), F.col("level").cast("int"))).alias("threshold"), "a", "b")


def mutual_pairs(ranked: DataFrame, floors: Sequence[float] = CLUSTER_FLOORS) -> DataFrame:
    """(threshold, a, b) with a < b: pairs that found each other at or above the floor, however often each is listed."""
    return _by_floor(_mutual(_hits(ranked, floors)), floors)


def _forest(a: np.ndarray, b: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Positions of fewer pairs than nodes that join the same nodes at every level as all of them."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    first, second = ends[: len(a)], ends[len(a):]
    root, kept = np.arange(len(nodes)), [np.empty(0, np.int64)]
    for reached in np.unique(level)[::-1]:
        at = np.flatnonzero(level == reached)
        while True:
            x, y = root[first[at]], root[second[at]]
            at, low, high = at[x != y], np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            if not len(at):
                break
            # Each root is hung on the smallest one that a pair leads to.
            np.minimum.at(root, high, low)
            by = np.flatnonzero(root[high] == low)
            kept.append(at[by[np.unique(high[by], return_index=True)[1]]])
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(kept)


def _reduce_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (a, b, level) to a forest of all of them; no more than the forest and a few batches are held."""
    held, kept = [], 0
    for batch in batches:
        held.append(batch)
        if sum(part.num_rows for part in held) - kept > max(_FOREST_ROWS, kept):
            held = _reduced(held)
            kept = sum(part.num_rows for part in held)
    yield from _reduced(held)


def _reduced(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not held:
        return []
    table = pa.Table.from_batches(held)
    kept = _forest(*(table.column(c).to_numpy() for c in ("a", "b", "level")))
    return table.take(pa.array(kept)).combine_chunks().to_batches()


def _sides(hits: int, tasks: int) -> int:
    """Parts of the nodes, so that the blocks between two parts hold a bounded number of hits and use the cores."""
    blocks = max(-(-hits // _BLOCK_HITS), min(2 * tasks, -(-hits // _LEAST_HITS)))
    return max(1, int(np.ceil(((8 * blocks + 1) ** 0.5 - 1) / 2)))


def _in_blocks(pairs: DataFrame, first: str, second: str, sides: int) -> DataFrame:
    """`pairs` with their block, one partition for each; a part of the nodes is in as many blocks as there are parts."""
    sides_of = [F.pmod(F.xxhash64(node), F.lit(sides)).cast("int") for node in (first, second)]
    low, high = F.least(*sides_of), F.greatest(*sides_of)
    block = F.shiftright(high * (high + 1), 1) + low
    return pairs.withColumn("block", block).repartitionById(sides * (sides + 1) // 2, F.col("block"))


def reduced_pairs(ranked: DataFrame, floors: Sequence[float] = CLUSTER_FLOORS) -> DataFrame:
    """(threshold, a, b): the components of `mutual_pairs` from fewer pairs.

    A block gives fewer pairs than it has nodes: all blocks at most parts times
    nodes. Those go through fewer and fuller blocks once more. `ranked` is read
    twice, for the number of hits and for the hits.
    """
    schema = "a long, b long, level byte"
    hits = _hits(ranked, floors)
    sides = _sides(hits.count(), ranked.sparkSession.sparkContext.defaultParallelism)
    # Hits stay in the order of queries on their way, so that a query is packed once for many of them.
    placed = _in_blocks(hits, "query_id", "candidate_id", sides)
    pairs = cut_lineage(_mutual(placed, ["block"]).mapInArrow(_reduce_pairs, schema))
    fewer = _sides(pairs.count(), 1)
    if fewer < sides:
        pairs = _in_blocks(pairs, "a", "b", fewer).select("a", "b", "level").mapInArrow(_reduce_pairs, schema)
    return _by_floor(pairs, floors)


def connected_components(pairs: DataFrame) -> DataFrame:
    """(threshold, node, label): the smallest node of each component, for all thresholds at once.

    Every round the smallest label across an edge is taken over by the node and by
    the label it had, then each node takes the label of its label, so whole trees
    join and rounds grow with the logarithm of the component size. Neighbour lists
    are bounded by the top-k of the search; only labels can become hot, so that
    lookup is split.
    """
    forth, back = (F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a")))
    # Both directions from one pass over the pairs.
    edges = cut_lineage(pairs.select("threshold", F.explode(F.array(forth, back)).alias("edge")).select("threshold", "edge.*"))
    spark = pairs.sparkSession
    labels, path = write_table(
        edges.groupBy("threshold", "node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    )
    while True:
        near = edges.join(labels, ["threshold", "node"]).withColumnRenamed("label", "mine")
        near = near.join(labels.select("threshold", F.col("node").alias("other"), "label"), ["threshold", "other"])
        # A smaller label over an edge goes to the node and to the node's label.
        offered = near.where("label < mine").select("threshold", F.explode(F.array("node", "mine")).alias("node"), "label")
        own = labels.withColumn("before", F.col("label"))
        lowered, lowered_path = write_table(
            own.unionByName(offered.withColumn("before", F.lit(None).cast("long")))
            .groupBy("threshold", "node").agg(F.min("label").alias("label"), F.max("before").alias("before"))
        )
        sizes = lowered.groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("n"))
        roots = lowered.select("threshold", F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = skew_safe_lookup(lowered, roots, ["threshold", "label"], "node", sizes, "n")
        after, after_path = write_table(jumped.select("threshold", "node", F.col("root").alias("label"), "before"))
        drop_table(spark, path)
        drop_table(spark, lowered_path)
        labels, path = after.drop("before"), after_path
        if not after.where("label <> before").limit(1).count():
            return labels


def near_duplicate_clusters(ranked: DataFrame, floors: Sequence[float] = CLUSTER_FLOORS) -> DataFrame:
    """(threshold, cluster_id, size, member_id), one row per member.

    Clusters are numbered per floor by (size desc, smallest member); ids read
    `T0.80_00001`. Members stay separate rows, as a cluster may hold a large part
    of the library.
    """
    labels = connected_components(reduced_pairs(ranked, floors))
    sizes = cut_lineage(labels.groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("size")))
    numbered = with_global_index(sizes, [F.col("threshold"), F.col("size").desc(), F.col("label")], "_i")
    # At most one row per floor.
    starts = F.broadcast(numbered.groupBy("threshold").agg(F.min("_i").alias("_start")))
    named = numbered.join(starts, "threshold").select(
        "threshold", "label", "size",
        F.format_string("T%.2f_%05d", "threshold", F.col("_i") - F.col("_start") + 1).alias("cluster_id"),
    )
    members = skew_safe_lookup(labels, named, ["threshold", "label"], "node", sizes, "size")
    return members.select("threshold", "cluster_id", "size", F.col("node").alias("member_id"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """One row per cluster (threshold, cluster_id, size) of the member table."""
    return clusters.groupBy("threshold", "cluster_id").agg(F.max("size").alias("size"))
