"""Consistency between images, blobs and vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.ordering import first_per_key
from lumenlake.operators.search import missing_text

SKIPPED, RELINK, GENERATE, MISSING_BLOB = "skipped", "relink", "generate", "missing_blob"
UPDATED, FAILED, UNMAPPED = "updated", "failed", "unmapped"


@dataclass(frozen=True)
class MaintenanceOptions:
    """Tasks of a maintenance run. `scope` is "missing" or "all"; "all" regenerates every vector.

    `match_model` also treats a vector of another model as absent; without it
    any vector of the image counts.
    """

    delete_orphan_blobs: bool = True
    extract_text: bool = True
    generate_vectors: bool = True
    scope: str = "missing"
    match_model: str | None = None

    def __post_init__(self) -> None:
        if self.scope not in ("missing", "all"):
            raise ValueError("scope must be 'missing' or 'all'")


def _stored(blobs: DataFrame) -> DataFrame:
    return blobs.select(F.lower("hash").alias("_h"), F.lower("extension").alias("_e")).distinct()


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_h", F.lower("hash")).withColumn("_e", F.lower("extension"))


def orphan_blobs(blobs: DataFrame, images: DataFrame) -> DataFrame:
    """Stored files no image refers to; hash and extension compared without case."""
    return _keyed(blobs).join(_stored(images), ["_h", "_e"], "left_anti").drop("_h", "_e")


def with_blob_flag(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """Adds `has_blob`."""
    flagged = _keyed(images).join(_stored(blobs).withColumn("_stored", F.lit(True)), ["_h", "_e"], "left")
    return flagged.withColumn("has_blob", F.coalesce("_stored", F.lit(False))).drop("_h", "_e", "_stored")


def text_plan(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """(id, action) for images without text: generate, or missing_blob."""
    plan = with_blob_flag(missing_text(images), blobs)
    return plan.select("id", F.when(F.col("has_blob"), F.lit(GENERATE)).otherwise(F.lit(MISSING_BLOB)).alias("action"))


def vector_plan(images: DataFrame, vectors: DataFrame, blobs: DataFrame, options: MaintenanceOptions = MaintenanceOptions()) -> DataFrame:
    """(id, action, vector_id) per image.

    A vector linked by id and owned by the image is valid; otherwise any vector
    owned by the image is relinked (the first by id); otherwise one is to be
    generated from the stored file.
    """
    if options.match_model is not None:
        vectors = vectors.where(F.col("model_hash") == options.match_model)
    if options.scope == "all":
        vectors = vectors.where(F.lit(False))
    owned = vectors.select("image_id", "vector_id")
    linked = owned.select(F.col("vector_id").alias("_linked"), F.col("image_id").alias("id"), F.lit(True).alias("_valid"))
    first = first_per_key(owned, ["image_id"], ["vector_id"]).select(F.col("image_id").alias("id"), F.col("vector_id").alias("_owned"))
    joined = (
        with_blob_flag(images, blobs)
        .withColumn("_linked", F.col("vector_id"))
        .join(linked, ["_linked", "id"], "left")
        .join(first, "id", "left")
    )
    action = (
        F.when(F.col("_valid"), F.lit(SKIPPED))
        .when(F.col("_owned").isNotNull(), F.lit(RELINK))
        .when(F.col("has_blob"), F.lit(GENERATE))
        .otherwise(F.lit(MISSING_BLOB))
    )
    target = F.when(F.col("_valid"), F.col("_linked")).otherwise(F.col("_owned"))
    return joined.select("id", action.alias("action"), target.alias("vector_id"))


def map_results(results: DataFrame, images: DataFrame, key: Column | str = "path") -> DataFrame:
    """Results of an enrichment run mapped to images by path.

    `outcome` is updated, failed (error kept) or unmapped (no such image).
    """
    keyed = images.select("id", "path", "original_file_name")
    joined = results.join(keyed, "path", "left")
    outcome = (
        F.when(F.col("id").isNull(), F.lit(UNMAPPED)).when(F.col("error").isNotNull(), F.lit(FAILED)).otherwise(F.lit(UPDATED))
    )
    message = (
        F.when(F.col("id").isNull(), F.concat("path", F.lit(": no image for this result")))
        .when(F.col("error").isNotNull(), F.concat("original_file_name", F.lit(": "), "error"))
    )
    return joined.select("path", "id", "value", outcome.alias("outcome"), message.alias("message"))


def maintenance_plan(images: DataFrame, vectors: DataFrame, blobs: DataFrame, options: MaintenanceOptions = MaintenanceOptions()) -> DataFrame:
    """(task, action, n): what a maintenance run would do, by task."""
    parts = []
    if options.delete_orphan_blobs:
        parts.append(orphan_blobs(blobs, images).select(F.lit("blobs").alias("task"), F.lit("delete").alias("action")))
    if options.extract_text:
        parts.append(text_plan(images, blobs).select(F.lit("text").alias("task"), "action"))
    if options.generate_vectors:
        parts.append(vector_plan(images, vectors, blobs, options).select(F.lit("vectors").alias("task"), "action"))
    if not parts:
        raise ValueError("no maintenance task chosen")
    plan = parts[0]
    for part in parts[1:]:
        plan = plan.unionByName(part)
    return plan.groupBy("task", "action").agg(F.count(F.lit(1)).alias("n"))
