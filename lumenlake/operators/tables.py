"""Changes to library tables as functions old table + change -> new table.

Writing the result out is the caller's step. Change frames hold one row per key
unless said otherwise, or name a `position` column: then the last row of a key counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.names import normalised_file_name
from lumenlake.functions.text import strip
from lumenlake.functions.vectors import with_vector_problems
from lumenlake.operators.ingest import append_matching, assign_ids, largest_order
from lumenlake.operators.ordering import first_per_key, present_keys


def missing_keys(change: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Keys of a change frame that the table does not hold."""
    return change.select(key).distinct().join(present_keys(change, table, key), key, "left_anti")


def require_none(violations: DataFrame, message: str) -> None:
    """Abort when there is any violation; the error shows a few of them."""
    shown = violations.limit(5).collect()
    if shown:
        raise ValueError(f"{message}: {[tuple(r) for r in shown]}")


def last_changes(change: DataFrame, key: str | Sequence[str], position: str | None) -> DataFrame:
    """One row per key: the one with the largest `position`; without a position, repeated keys abort."""
    keys = [key] if isinstance(key, str) else list(key)
    if position is not None:
        return first_per_key(change, keys, [F.col(position).desc()])
    repeated = change.groupBy(*keys).count().where("count > 1").select(*keys)
    require_none(repeated, f"repeated {', '.join(keys)} in a change without a position")
    return change


def update_columns(
    table: DataFrame, change: DataFrame, columns: Sequence[str], key: str = "id", position: str | None = None
) -> DataFrame:
    """Set `columns` of matching rows; null is a value like any other, unknown keys are ignored (M4).

    Of rows that repeat a key the last by `position` counts; without a position they abort.
    """
    change = last_changes(change, key, position)
    new = change.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def replace_vector_ids(images: DataFrame, change: DataFrame, position: str | None = None) -> DataFrame:
    """M4 for vector ids, but any unknown image aborts (M5)."""
    require_none(missing_keys(change, images), "unknown images")
    return update_columns(images, change, ["vector_id"], position=position)


def overwrite_images(
    images: DataFrame, links: DataFrame, rows: DataFrame, new_links: DataFrame, position: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace whole rows by id with their exact tag sets; unknown ids are skipped (M6).

    With a `position`, a column of `rows` and `new_links`, an id may repeat: its last row
    counts, with the tags of that row alone.
    """
    known = last_changes(rows, "id", position).join(images.select("id"), "id", "left_semi")
    ids = known.select(F.col("id").alias("image_id"))
    if position is not None:
        of_last = known.select(F.col("id").alias("image_id"), position)
        new_links = new_links.join(of_last, ["image_id", position], "left_semi")
    kept_images = images.join(known.select("id"), "id", "left_anti")
    kept_links = links.join(ids, "image_id", "left_anti")
    set_links = new_links.select("image_id", "tag_id").distinct().join(ids, "image_id", "left_semi")
    return kept_images.unionByName(known.select(*images.columns)), kept_links.unionByName(set_links)


def file_property_problems(change: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of a rename/re-date change that would be refused: unknown id or name not allowed (M7)."""
    joined = change.join(images.select("id", "extension"), "id", "left")
    bad_name = F.col("original_file_name").isNotNull() & normalised_file_name("original_file_name", "extension").isNull()
    return joined.where(F.col("extension").isNull() | bad_name).select("id", "original_file_name")


def update_file_properties(images: DataFrame, change: DataFrame, position: str | None = None) -> DataFrame:
    """Rename and re-date images (id, original_file_name, modification_date); null keeps the value (M7).

    With a `position` an id may repeat: the last name and the last date that are not null count.
    """
    if position is not None:
        change = change.groupBy("id").agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in ("original_file_name", "modification_date")])
    new = last_changes(change, "id", None).select("id", F.col("original_file_name").alias("_name"), F.col("modification_date").alias("_date"))
    joined = images.join(new, "id", "left")
    name = F.coalesce(normalised_file_name("_name", "extension"), "original_file_name")
    return joined.withColumn("original_file_name", name).withColumn("modification_date", F.coalesce("_date", "modification_date")).select(*images.columns)


def delete_images(images: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and links without the given images (M8)."""
    gone = ids.select("id")
    return images.join(gone, "id", "left_anti"), links.join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti")


def upsert_tags(tags: DataFrame, incoming: DataFrame, position: str | None = None) -> DataFrame:
    """Add or modify tags (M9).

    By id all fields are overwritten. Without an id the name decides: fields are
    overwritten but the order is kept. What is left becomes a new tag whose order
    is the largest in use. With a `position` (unique) a name or id may repeat (else it aborts): its last
    row counts, and new tags are numbered by the first row of their name, not by name.
    """
    fields = [c for c in incoming.columns if c in tags.columns and c not in ("id", position)]
    by_id = incoming.where("id IS NOT NULL").join(tags.select("id"), "id", "left_semi")
    changed = update_columns(tags, by_id, fields, position=position)
    by_name = incoming.where("id IS NULL").join(tags.select("name"), "name", "left_semi")
    changed = update_columns(changed, by_name.drop("id"), [c for c in fields if c not in ("name", "order")], "name", position)
    unknown_id = incoming.where("id IS NOT NULL").join(tags.select("id"), "id", "left_anti")
    unknown_name = incoming.where("id IS NULL").join(tags.select("name"), "name", "left_anti")
    if position is None:
        unknown_name = last_changes(unknown_name, "name", None)
    else:
        last = F.max(position).over(Window.partitionBy("name"))
        first = F.min(position).over(Window.partitionBy("name"))
        unknown_name = unknown_name.withColumns({"_last": last, "_first": first}).where(F.col(position) == F.col("_last"))
        unknown_name = unknown_name.withColumn(position, F.col("_first")).drop("_last", "_first")
    fresh = assign_ids(unknown_id.unionByName(unknown_name).drop("id"), tags, [position or "name"])
    fresh = fresh.withColumn("order", F.lit(largest_order(tags)))
    return append_matching(changed, fresh)


def delete_tags(tags: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and links without the given tags."""
    gone = ids.select("id")
    return tags.join(gone, "id", "left_anti"), links.join(gone.withColumnRenamed("id", "tag_id"), "tag_id", "left_anti")


def set_image_tags(images: DataFrame, tags: DataFrame, links: DataFrame, wanted: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace the tag sets of the `touched` images (image_id) by `wanted` (image_id, tag_id).

    An unknown image or tag aborts; an image without wanted rows loses all tags.
    """
    require_none(missing_keys(touched.select(F.col("image_id").alias("id")), images), "unknown images")
    require_none(missing_keys(wanted.select(F.col("tag_id").alias("id")), tags), "unknown tags")
    kept = links.join(touched.select("image_id"), "image_id", "left_anti")
    return kept.unionByName(wanted.select("image_id", "tag_id").distinct())


def edit_image_tags(
    images: DataFrame, tags: DataFrame, links: DataFrame, ids: DataFrame, tag_ids: Sequence[int], add: bool
) -> tuple[DataFrame, DataFrame]:
    """(links, changed image ids) after adding or removing tags on many images.

    An unknown tag aborts, an unknown image is skipped. `tag_ids` is the user's
    selection, a short list of literals.
    """
    spark = images.sparkSession
    chosen = list(dict.fromkeys(tag_ids))
    require_none(missing_keys(spark.createDataFrame([(t,) for t in chosen], "id long"), tags), "unknown tags")
    targets = ids.select(F.col("id").alias("image_id")).distinct().join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    if add:
        pairs = targets.withColumn("tag_id", F.explode(F.array(*[F.lit(t).cast("long") for t in chosen])))
        fresh = pairs.join(links.select("image_id", "tag_id"), ["image_id", "tag_id"], "left_anti")
        return links.unionByName(fresh), fresh.select(F.col("image_id").alias("id")).distinct()
    selected = F.col("tag_id").isin(*chosen)
    dropped = links.where(selected).join(targets, "image_id", "left_semi")
    kept = links.where(~selected).unionByName(links.where(selected).join(targets, "image_id", "left_anti"))
    return kept, dropped.select(F.col("image_id").alias("id")).distinct()


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining vectors, deleted ids): unknown ids do not count, repeated ones count once."""
    gone = ids.select("vector_id").distinct()
    return vectors.join(gone, "vector_id", "left_anti"), gone.join(vectors.select("vector_id"), "vector_id", "left_semi")


def vectors_of_images(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector ids to delete with images: the stored link or any vector of the image."""
    stored = images.where("vector_id IS NOT NULL").select("vector_id")
    found = vectors.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi").select("vector_id")
    return stored.unionByName(found).distinct()


def add_vectors(vectors: DataFrame, incoming: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, refused rows with `problem`): valid rows are appended."""
    checked = with_vector_problems(incoming, dimension)
    valid = checked.where("problem IS NULL").select(*vectors.columns)
    return vectors.unionByName(valid), checked.where("problem IS NOT NULL")


def update_vectors(vectors: DataFrame, change: DataFrame, columns: Sequence[str], position: str | None = None) -> DataFrame:
    """Overwrite vectors or metadata columns by vector id; unknown ids abort, repeated ones as in `update_columns`."""
    require_none(missing_keys(change, vectors, "vector_id"), "unknown vectors")
    return update_columns(vectors, change, columns, "vector_id", position)


def reset_vectors(vectors: DataFrame) -> DataFrame:
    """The empty vector table."""
    return vectors.where(F.lit(False))


def tag_save_problems(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, name, problem) of tag edits with an empty name or one used by another tag."""
    named = edits.withColumn("name", strip("name"))
    taken = named.join(tags.select(F.col("id").alias("_other"), "name"), "name").where(F.col("id").isNull() | (F.col("id") != F.col("_other")))
    empty = named.where(F.coalesce(F.col("name"), F.lit("")) == "")
    return empty.select("id", "name", F.lit("empty").alias("problem")).unionByName(
        taken.select("id", "name", F.lit("taken").alias("problem")).distinct()
    )


def cleaned_tag_edits(edits: DataFrame) -> DataFrame:
    """Edits as they are saved: stripped name, blank description as null."""
    return edits.withColumn("name", strip("name")).withColumn("description", F.nullif(strip("description"), F.lit("")))


def latest_per_hash(rows: DataFrame, order: str) -> DataFrame:
    """The row with the largest `order` of every hash."""
    return first_per_key(rows, ["hash"], [F.col(order).desc()])
