"""Merging a library backup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import ingest
from lumenlake.operators.ordering import first_per_key, present_keys
from lumenlake.session import cut_lineage

DAMAGED, MERGED, UNCHANGED, ADDED = "damaged", "merged", "unchanged", "added"


def backup_tag_names(records: DataFrame, position: str = "position") -> DataFrame:
    """(hash, name, seen): each tag name of a hash once, with where it was first seen."""
    named = records.select("hash", position, F.posexplode("tag_names").alias("_at", "name"))
    return named.groupBy("hash", "name").agg(F.min(F.struct(position, "_at")).alias("seen"))


def dedupe_backup(records: DataFrame, position: str = "position") -> DataFrame:
    """One record per hash: fields of the first, tag names of all in first-seen order."""
    union = (
        backup_tag_names(records, position).groupBy("hash")
        .agg(F.array_sort(F.collect_list(F.struct("seen", "name"))).alias("_names"))
        .select("hash", F.transform("_names", lambda t: t["name"]).alias("_tag_names"))
    )
    first = first_per_key(records, ["hash"], [position])
    merged = first.join(union, "hash", "left")
    return merged.select(
        *[c for c in records.columns if c != "tag_names"],
        F.coalesce("_tag_names", F.array().cast("array<string>")).alias("tag_names"),
    )


def resolve_tags(records: DataFrame, tags: DataFrame, key: str = "hash") -> DataFrame:
    """(key, tag_id) of the tag names that exist; unknown names are dropped (C11)."""
    named = records.select(key, F.explode("tag_names").alias("name")).distinct()
    return named.join(tags.select(F.col("id").alias("tag_id"), "name"), "name").select(key, "tag_id")


def damage_check(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with `damaged`: file (path, actual_hash) missing or of another hash."""
    joined = records.join(files.select("path", "actual_hash"), "path", "left")
    bad = F.col("actual_hash").isNull() | (F.lower("actual_hash") != F.lower("hash"))
    return joined.withColumn("damaged", bad)


@dataclass(frozen=True)
class MergedLibrary:
    """Tables after a merge and the outcome per backup hash."""

    images: DataFrame
    tags: DataFrame
    links: DataFrame
    outcomes: DataFrame


def merge_library(
    images: DataFrame, tags: DataFrame, links: DataFrame, backup_images: DataFrame, backup_tags: DataFrame, files: DataFrame
) -> MergedLibrary:
    """Merge a backup.

    Damaged files are only reported. A known hash gains tags and keeps its image
    fields; a new hash is inserted. Merging the same backup again changes nothing.
    """
    all_tags = cut_lineage(ingest.add_missing_tags(tags, backup_tags))
    records = cut_lineage(damage_check(dedupe_backup(backup_images), files))
    sound = records.where("not damaged")
    fresh = sound.join(present_keys(sound, images, "hash"), "hash", "left_anti")
    added = cut_lineage(ingest.assign_ids(fresh, images, ["position"]))
    all_images = ingest.append_matching(images, added)

    incoming = resolve_tags(sound, all_tags)
    gained = cut_lineage(ingest.new_tag_links(all_images, all_tags, links, incoming))
    gained_ids = gained.select(F.col("image_id").alias("id")).distinct()
    grown = images.join(gained_ids, "id", "left_semi").select("hash", F.lit(MERGED).alias("_known"))
    outcomes = (
        records.select("hash", "path", "damaged")
        .join(added.select("hash", F.lit(ADDED).alias("_added")), "hash", "left")
        .join(grown, "hash", "left")
        .select(
            "hash", "path",
            F.when(F.col("damaged"), F.lit(DAMAGED)).otherwise(F.coalesce("_added", "_known", F.lit(UNCHANGED))).alias("outcome"),
        )
    )
    return MergedLibrary(all_images, all_tags, links.unionByName(gained.select("image_id", "tag_id")), outcomes)
