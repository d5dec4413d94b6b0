"""Import of new images and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlake.operators.ordering import first_per_key, present_keys, with_global_index
from lumenlake.session import cut_lineage

NEW, IN_REQUEST, IN_LIBRARY, NO_HASH = "new", "duplicate_in_request", "duplicate_in_library", "error"


def first_occurrences(rows: DataFrame, key: str, position: str = "position") -> DataFrame:
    """The first row of every key, by position."""
    return first_per_key(rows, [key], [position])


def import_outcomes(candidates: DataFrame, images: DataFrame, position: str = "position") -> DataFrame:
    """Candidates with `outcome`: first of its hash and new, repeated in the request, or known.

    A candidate without a hash is an `error`. Of candidates with one hash and one
    position a single one is the first. The request is reduced to one position per
    hash before anything is joined; the join back uses (hash, position), so a hash
    shared by many rows does not pile up anywhere.
    """
    hashed = candidates.where(F.col("hash").isNotNull())
    first = hashed.groupBy("hash").agg(F.min(position).alias(position))
    known = present_keys(hashed, images, "hash").withColumn("_known", F.lit(True))
    judged = first.join(known, "hash", "left").select(
        "hash", position, F.when(F.col("_known"), F.lit(IN_LIBRARY)).otherwise(F.lit(NEW)).alias("_outcome")
    )
    tied = Window.partitionBy("hash", position).orderBy(F.xxhash64(*candidates.columns))
    placed = hashed.withColumn("_tie", F.row_number().over(tied))
    outcome = F.when(F.col("_tie") == 1, F.col("_outcome"))
    found = placed.join(judged, ["hash", position], "left").select(
        *candidates.columns, F.coalesce(outcome, F.lit(IN_REQUEST)).alias("outcome"))
    return found.unionByName(candidates.where(F.col("hash").isNull()).withColumn("outcome", F.lit(NO_HASH)))


def new_candidates(candidates: DataFrame, images: DataFrame, position: str = "position") -> DataFrame:
    """First candidate of every hash the library does not hold."""
    hashed = candidates.where(F.col("hash").isNotNull())
    return first_occurrences(hashed, "hash", position).join(present_keys(candidates, images, "hash"), "hash", "left_anti")


def outcome_counts(plan: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Rows per outcome."""
    return plan.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def assign_ids(rows: DataFrame, existing: DataFrame, order: list, id_col: str = "id") -> DataFrame:
    """Ids max+1, max+2, ... in `order`, without a single-task sort."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]
    return with_global_index(rows, order, "_i").withColumn(id_col, F.lit(top) + F.col("_i")).drop("_i")


def largest_order(tags: DataFrame) -> int:
    """Order given to new tags."""
    return tags.agg(F.coalesce(F.max("order"), F.lit(0))).first()[0]


def append_matching(table: DataFrame, extra: DataFrame) -> DataFrame:
    """`table` plus rows of `extra`, which may lack columns but adds none."""
    return table.unionByName(extra.select(*[c for c in table.columns if c in extra.columns]), allowMissingColumns=True)


def add_missing_tags(tags: DataFrame, incoming: DataFrame, position: str = "position") -> DataFrame:
    """Tags plus incoming ones with unused names, order value kept, first of a name wins (M2)."""
    fresh = first_occurrences(incoming, "name", position).join(tags.select("name"), "name", "left_anti")
    return append_matching(tags, assign_ids(fresh, tags, [position]))


def insert_images(
    images: DataFrame, tags: DataFrame, links: DataFrame, candidates: DataFrame, position: str = "position"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, tags, links) after inserting candidates with unseen hashes (M1).

    Candidates carry `tag_names`; unknown names become new tags whose order is
    the largest in use (D2).
    """
    fresh = cut_lineage(assign_ids(new_candidates(candidates, images, position), images, [position]))
    named = fresh.select("id", position, F.posexplode("tag_names").alias("_at", "name"))
    unseen = named.groupBy("name").agg(F.min(F.struct(position, "_at")).alias("_first")).join(tags.select("name"), "name", "left_anti")
    created = assign_ids(unseen.select("name", F.col("_first.*")), tags, [position, "_at"])
    created = created.withColumn("order", F.lit(largest_order(tags))).withColumn("enabled", F.lit(True))
    all_tags = append_matching(tags, created)
    new_links = (
        named.select("id", "name").distinct().join(all_tags.select(F.col("id").alias("tag_id"), "name"), "name")
        .select(F.col("id").alias("image_id"), "tag_id")
    )
    return append_matching(images, fresh), all_tags, links.unionByName(new_links)


def new_tag_links(images: DataFrame, tags: DataFrame, links: DataFrame, incoming: DataFrame) -> DataFrame:
    """(image_id, tag_id) links that merging (hash, tag_id) would add; unknown hash or tag ignored (M3)."""
    wanted = (
        incoming.select("hash", "tag_id").distinct()
        .join(images.select("hash", F.col("id").alias("image_id")), "hash")
        .select("image_id", "tag_id").distinct()
        .join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    )
    return wanted.join(links.select("image_id", "tag_id").distinct(), ["image_id", "tag_id"], "left_anti")


def merge_tag_links(images: DataFrame, tags: DataFrame, links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links after the union (M3); existing rows, repeated ones too, stay as they are."""
    return links.unionByName(new_tag_links(images, tags, links, incoming).select("image_id", "tag_id"))
