"""Global order, paging and skew-safe key lookups."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.session import cut_lineage

# Beyond this many rows a page is taken from a distributed index instead of a
# per-task top list.
_TOP_LIST_ROWS = 100_000

# Sort options of the paged listing; anything else means the modification date.
SORT_KEYS = {
    "imported_at": "imported_at",
    "modification_date": "modification_date",
    "original_file_name": "original_file_name",
    "file_size": "file_size",
    "date": "modification_date",
    "name": "original_file_name",
    "size": "file_size",
}


def with_global_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx", start: int = 1) -> DataFrame:
    """Number the rows 1..n in `order` without sending them through one task.

    The rows are range-partitioned and sorted once; only one count per partition
    is combined. End `order` with a unique column, so that a value shared by many
    rows is still split over partitions.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    # One row per partition: small enough for a single-partition window.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    in_partition = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_partition + F.lit(start))
        .drop("_part", "_seq", "_rows", "_offset")
    )


def skew_safe_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    sizes: DataFrame,
    size_col: str,
    salts: int = 64,
) -> DataFrame:
    """Inner join of many `rows` to one `lookup` row per key when keys may be hot.

    `sizes` holds the row count per key. A key is hot when it owns more than one
    row in a thousand, so there are fewer than 1000 hot keys whatever the data
    size, and the list of them is safe to broadcast. Hot keys are split into
    `salts` parts by `spread_by`; their lookup rows are repeated once per part.
    """
    keys = list(keys)
    total = sizes.agg(F.sum(size_col)).first()[0] or 0
    hot = F.broadcast(
        sizes.where(F.col(size_col) * 1000 > F.lit(total)).select(*keys, F.lit(True).alias("_hot"))
    )
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_salt", part).drop("_hot")
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def present_keys(request: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requested keys that the table holds, each once.

    The request is the right side of the semi join, so a small request is
    broadcast by its size and a large table is only scanned, not shuffled.
    """
    return table.select(key).join(request.select(key).distinct(), key, "left_semi").distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int = 1) -> DataFrame:
    """The first `limit` rows of every key; Spark trims each key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def newest_first(images: DataFrame) -> DataFrame:
    """Result order of all searches."""
    return images.orderBy(F.col("modification_date").desc(), F.col("id").desc())


def tag_order(tags: DataFrame) -> DataFrame:
    """Tags by (order, id) (E5)."""
    return tags.orderBy("order", "id")


def _page_order(order_by: str, descending: bool) -> list[Column]:
    key = SORT_KEYS.get(order_by, "modification_date")
    return [F.col(key).desc(), F.col("id").desc()] if descending else [F.col(key).asc(), F.col("id").asc()]


def page(
    images: DataFrame,
    order_by: str = "modification_date",
    descending: bool = True,
    offset: int = 0,
    count: int | None = None,
) -> DataFrame:
    """Paged listing (E1): ties broken by id in the same direction, no count means all."""
    order = _page_order(order_by, descending)
    if count is None and not offset:
        return images.orderBy(*order)
    if count is not None and offset + count <= _TOP_LIST_ROWS:
        return images.orderBy(*order).offset(offset).limit(count)
    wanted = F.col("_pos") > offset
    if count is not None:
        wanted &= F.col("_pos") <= offset + count
    return with_global_index(images, order, "_pos").where(wanted).orderBy("_pos").drop("_pos")


def page_after(
    images: DataFrame,
    last_key,
    last_id: int | None,
    order_by: str = "modification_date",
    descending: bool = True,
    count: int = 100,
) -> DataFrame:
    """Next page behind a known row (E3); the key filter reaches the scan."""
    order = _page_order(order_by, descending)
    if last_id is not None:
        key = F.col(SORT_KEYS.get(order_by, "modification_date"))
        edge = F.lit(last_key)
        if descending:
            images = images.where((key <= edge) & ((key < edge) | (F.col("id") < last_id)))
        else:
            images = images.where((key >= edge) & ((key > edge) | (F.col("id") > last_id)))
    return images.orderBy(*order).limit(count)


def next_id(images: DataFrame, after: int) -> DataFrame:
    """The id behind `after`, wrapping to the smallest (D3); null on an empty library."""
    return images.agg(F.coalesce(F.min(F.when(F.col("id") > after, F.col("id"))), F.min("id")).alias("next_id"))


def next_ids(images: DataFrame) -> DataFrame:
    """D3 for every id at once, as a join of the distributed index with itself."""
    ranked = with_global_index(images.select("id"), ["id"])
    follower = ranked.select((F.col("idx") - 1).alias("idx"), F.col("id").alias("next_id"))
    lowest = F.broadcast(ranked.agg(F.min("id").alias("_lowest"), F.max("idx").alias("idx")))
    return (
        ranked.join(follower, "idx", "left")
        .join(lowest, "idx", "left")
        .select("id", F.coalesce("next_id", "_lowest").alias("next_id"))
    )


def random_id(images: DataFrame, excluding: int | None = None, seed: int | None = None) -> DataFrame:
    """One uniformly drawn id, no row where there is none (E4): the one whose MD5 with the seed is smallest.

    One partial aggregation and no sort; equal seeds draw equal ids.
    """
    ids = images.select("id").where(F.col("id").isNotNull())
    if excluding is not None:
        ids = ids.where(F.col("id") != excluding)
    seed = random.randrange(1 << 62) if seed is None else seed
    return ids.agg(F.min_by("id", F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary"))).alias("id")).where(F.col("id").isNotNull())
