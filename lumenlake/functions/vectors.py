"""Vector columns: similarity expressions, validity rules, metadata maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUSTOM_PREFIX = "custom_"
MODEL_HASH_LENGTH = 16


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance, the `l2` metric of the vector store."""
    squares = F.zip_with(_col(a), _col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def distance(a: str | Column, b: str | Column, metric: str = "cosine") -> Column:
    """Distance of two vectors for metric cosine, l2 or ip."""
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))
    if metric == "l2":
        return l2_distance(a, b)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def similarity(a: str | Column, b: str | Column, metric: str = "cosine") -> Column:
    """Similarity 1 - distance, never below zero (F1)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance(a, b, metric))


def vector_problem(vector: str | Column, dimension: int) -> Column:
    """Name of the broken vector rule, null when valid."""
    v = _col(vector)
    return F.when(v.isNull(), F.lit("vector")).when(F.size(v) != dimension, F.lit("dimension"))


def metadata_problem() -> Column:
    """Name of the first broken metadata rule, null when valid."""

    def blank(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    def not_positive(name: str) -> Column:
        return F.coalesce(F.col(name) <= 0, F.lit(True))

    return (
        F.when(blank("image_filename"), F.lit("image_filename"))
        .when(blank("model_hash"), F.lit("model_hash"))
        .when(not_positive("image_id"), F.lit("image_id"))
        .when(not_positive("image_width") | not_positive("image_height"), F.lit("image_width/height"))
    )


def flatten_custom(custom: str | Column) -> Column:
    """Custom metadata keys with their storage prefix; null values are dropped."""
    kept = F.map_filter(_col(custom), lambda k, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit(CUSTOM_PREFIX), k))


def unflatten_custom(metadata: str | Column) -> Column:
    """Custom fields of a stored metadata map; null when there are none."""
    kept = F.map_filter(_col(metadata), lambda k, v: k.startswith(CUSTOM_PREFIX))
    fields = F.transform_keys(kept, lambda k, v: F.substring(k, len(CUSTOM_PREFIX) + 1, 1 << 30))
    return F.when(F.size(fields) > 0, fields)


def model_hash(content: str | Column) -> Column:
    """Model id: the first 16 hex digits of the sha1 of the model file."""
    return F.substring(F.sha1(_col(content)), 1, MODEL_HASH_LENGTH)


def sidecar_model_hash(text: str | Column) -> Column:
    """Model id from a digest file: a full digest anywhere, else a leading short one."""
    content = F.lower(F.regexp_replace(_col(text), r"(?U)^[\s﻿]+|\s+$", ""))
    full = F.regexp_extract(content, r"\b([0-9a-f]{40})\b", 1)
    short = F.regexp_extract(content, r"^([0-9a-f]{16})(\s|$)", 1)
    return F.when(full != "", F.substring(full, 1, MODEL_HASH_LENGTH)).when(short != "", short)


def with_vector_problems(vectors: DataFrame, dimension: int) -> DataFrame:
    """Adds `problem`: the broken rule of vector or metadata, null when the row is valid."""
    return vectors.withColumn("problem", F.coalesce(vector_problem("vector", dimension), metadata_problem()))
