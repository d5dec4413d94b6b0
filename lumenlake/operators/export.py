"""Export planning and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.names import is_safe_name, rfc3339
from lumenlake.functions.text import collision_key, nfc
from lumenlake.operators.ordering import skew_safe_lookup, with_global_index
from lumenlake.operators.search import with_tags
from lumenlake.operators.tables import require_none
from lumenlake.session import DROP_SHUFFLES, drop_table, held_conf, write_table

MAX_FILES_PER_SET = 10_000


def unsafe_names(images: DataFrame) -> DataFrame:
    """Images whose file name cannot be exported."""
    return images.where(~is_safe_name("original_file_name")).select("id", "original_file_name")


def duplicate_names(images: DataFrame) -> DataFrame:
    """(name_key, n) of file names used more than once."""
    return images.groupBy(collision_key("original_file_name").alias("name_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assign_sets(images: DataFrame, max_files_per_set: int = MAX_FILES_PER_SET) -> DataFrame:
    """Images with `set_index` and `relative_path`, no name twice in a set, loads even.

    Sorted by (name group size desc, name key, name, hash, id) the images are dealt
    out in turn over max(1, ceil(n / cap), largest name group) sets; a name group
    is never larger than the number of sets, so it never meets itself. Only names,
    hashes and ids are sorted and written; the images meet their numbers in one join.
    """
    if max_files_per_set <= 0:
        raise ValueError("max_files_per_set must be positive")
    require_none(unsafe_names(images), "file names not fit for export")
    spark = images.sparkSession
    with held_conf(spark, DROP_SHUFFLES):
        named, named_path = write_table(
            images.select("id", "original_file_name", F.lower("hash").alias("_hash"))
            .withColumn("_key", collision_key("original_file_name"))
            .withColumn("_name", nfc("original_file_name"))
        )
        sizes, sizes_path = write_table(named.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")))
        n, largest = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
        sets = max(1, -(-n // max_files_per_set), largest)
        sized = skew_safe_lookup(named, sizes, ["_key"], "id", sizes, "_size")
        dealt = with_global_index(sized, [F.col("_size").desc(), "_key", "_name", "_hash", "id"], "_i", 0)
        drop_table(spark, named_path)
        drop_table(spark, sizes_path)
    # A struct also joins where the id is null; rows of one id take its numbers in the order of name and hash.
    numbers = dealt.groupBy(F.struct("id").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("original_file_name", "_hash", "_i"))).alias("_numbers"))
    place = F.row_number().over(Window.partitionBy("_row").orderBy("original_file_name", F.lower("hash")))
    numbered = images.withColumn("_row", F.struct("id")).withColumn("_place", place).join(numbers, "_row")
    number = F.pmod(F.get("_numbers", F.col("_place") - 1)["_i"], F.lit(sets).cast("long"))
    path = F.concat(F.lit("set_"), (number + 1).cast("string"), F.lit("/"), F.col("original_file_name"))
    return numbered.select(*images.columns, number.alias("set_index"), path.alias("relative_path"))


def ordered_tag_names(images: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Adds `tag_names`: each image's distinct tag names by (order, id)."""
    tagged = with_tags(images, tags, links)
    return tagged.withColumn("tag_names", F.array_distinct(F.transform("tags", lambda t: t["name"]))).drop("tags")


def sort_tag_names(rows: DataFrame, tags: DataFrame, key: str = "id", names: str = "tag_names") -> DataFrame:
    """Adds `sorted_names`: names known to the tag table by (order, id), unknown ones after them by casefold."""
    exploded = rows.select(key, F.explode(names).alias("name")).distinct()
    known = tags.select("name", F.col("order").alias("_o"), F.col("id").alias("_id"))
    place = F.struct(
        F.col("_id").isNull().alias("unknown"), F.coalesce("_o", F.lit(0)).alias("o"), F.coalesce("_id", F.lit(0)).alias("i"),
        collision_key("name").alias("k"), F.col("name"),
    )
    placed = exploded.join(known, "name", "left").groupBy(key).agg(F.array_sort(F.collect_list(place)).alias("_p"))
    joined = rows.join(placed, key, "left")
    sorted_names = F.coalesce(F.transform("_p", lambda p: p["name"]), F.array().cast("array<string>"))
    return joined.withColumn("sorted_names", sorted_names).drop("_p")


def image_entries(planned: DataFrame, zone: str = "UTC") -> DataFrame:
    """One backup entry per planned image (with `tag_names`), as struct fields."""
    return planned.select(
        "set_index",
        F.col("relative_path").alias("path"),
        F.lower("hash").alias("hash"),
        rfc3339("imported_at", zone).alias("imported_at"),
        rfc3339("modification_date", zone).alias("modification_date"),
        F.col("tag_names").alias("tags"),
        "text_in_image",
    )


def tag_entries(tags: DataFrame) -> DataFrame:
    """Backup entries of the tags, with their `position` by (order, id)."""
    placed = with_global_index(tags, ["order", "id"], "position", 0)
    return placed.select("name", F.col("color_rgb").alias("rgb"), "order", "description", "enabled", "position")


def integrity_violations(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose file is missing or whose bytes do not give the stored hash.

    `files` holds (hash, content), the key under which a file is stored and its bytes.
    """
    actual = files.select(F.lower("hash").alias("_h"), F.sha1("content").alias("actual_hash"))
    joined = images.withColumn("_h", F.lower("hash")).join(actual, "_h", "left")
    bad = F.col("actual_hash").isNull() | (F.col("actual_hash") != F.col("_h"))
    return joined.where(bad).select("id", "hash", "actual_hash")


def require_integrity(images: DataFrame, files: DataFrame) -> None:
    """Abort an export on any violation."""
    require_none(integrity_violations(images, files), "files do not match their hashes")
