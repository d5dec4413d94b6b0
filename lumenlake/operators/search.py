"""Text, name and tag searches and key lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import contains_casefold, contains_literal, like_wildcard
from lumenlake.operators.ordering import first_per_key, newest_first, present_keys, tag_order


def search_text(images: DataFrame, query: str) -> DataFrame:
    """Literal substring of the extracted text, newest first (B1)."""
    return newest_first(images.where(contains_literal("text_in_image", query)))


def search_file_name(images: DataFrame, query: str) -> DataFrame:
    """Literal substring of the file name, newest first (B2)."""
    return newest_first(images.where(contains_literal("original_file_name", query)))


def match_file_name(images: DataFrame, pattern: str) -> DataFrame:
    """Substring with `%` and `_` as wildcards, unordered."""
    return images.where(like_wildcard("original_file_name", pattern))


def search_tags(tags: DataFrame, query: str, limit: int = 10, enabled_only: bool = True) -> DataFrame:
    """Tags whose name contains the query, in tag order."""
    if limit <= 0 or not query.strip():
        return tags.where(F.lit(False))
    return tag_order(list_tags(tags, enabled_only).where(contains_literal("name", query))).limit(limit)


def list_tags(tags: DataFrame, enabled_only: bool = False) -> DataFrame:
    """All or all enabled tags in tag order."""
    return tag_order(tags.where("enabled") if enabled_only else tags)


def substring_matcher(name: str | Column, query: str) -> Column:
    """Default tag matcher: Unicode-casefold substring."""
    return contains_casefold(name, query)


def match_tags(tags: DataFrame, query: str, matcher: Callable[[str | Column, str], Column] = substring_matcher) -> DataFrame:
    """Tags accepted by a pluggable matcher, a function (column, query) -> boolean column."""
    return tags.where(matcher("name", query))


def search_tag_name(images: DataFrame, tags: DataFrame, links: DataFrame, query: str) -> DataFrame:
    """Images with an enabled tag whose name contains the query, each once, newest first.

    The matching tags join the links without a hint: how many match is not
    bounded, so the size decides.
    """
    matching = tags.where(F.col("enabled") & contains_literal("name", query)).select(F.col("id").alias("tag_id"))
    hits = links.join(matching, "tag_id", "left_semi").select(F.col("image_id").alias("id"))
    return newest_first(images.join(hits.distinct(), "id", "left_semi"))


def images_with_tag(images: DataFrame, tags: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Images with the tag of exactly this name, enabled or not, unordered."""
    tag = tags.where(F.col("name") == name).select(F.col("id").alias("tag_id"))
    hits = links.join(tag, "tag_id", "left_semi").select(F.col("image_id").alias("id"))
    return images.join(hits.distinct(), "id", "left_semi")


def missing_text(images: DataFrame) -> DataFrame:
    """Images never extracted; an empty text counts as present."""
    return images.where(F.col("text_in_image").isNull())


def metadata_filter(conditions: dict) -> Column:
    """A metadata filter as one boolean column.

    {"model_hash": "a", "image_id": {"$in": [1, 2]}, "image_width": {"$gte": 64}}
    """
    tests: dict[str, Callable[[Column, object], Column]] = {
        "$eq": lambda c, v: c == v,
        "$ne": lambda c, v: c != v,
        "$in": lambda c, v: c.isin(*v),
        "$nin": lambda c, v: ~c.isin(*v),
        "$gt": lambda c, v: c > v,
        "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v,
        "$lte": lambda c, v: c <= v,
    }
    parts = []
    for name, wanted in conditions.items():
        for operator, value in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            if operator not in tests:
                raise ValueError(f"unknown operator {operator!r}")
            parts.append(tests[operator](F.col(name), value))
    return reduce(and_, parts, F.lit(True))


def query_metadata(vectors: DataFrame, conditions: dict, limit: int | None = None) -> DataFrame:
    """Vectors by metadata, optionally the first `limit` by (image_id, vector_id)."""
    found = vectors.where(metadata_filter(conditions))
    return found if limit is None else found.orderBy("image_id", "vector_id").limit(limit)


def in_request_order(requested: DataFrame, rows: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """Rows for requested keys (key, position): each once, in request order, unknown keys dropped."""
    first = requested.groupBy(key).agg(F.min(position).alias(position))
    return rows.join(first, key).orderBy(position)


def maintenance_records(images: DataFrame) -> DataFrame:
    """The narrow columns maintenance works on, by id."""
    wanted = ("id", "original_file_name", "hash", "extension", "size_width", "size_height", "vector_id", "text_in_image")
    return images.select(*[c for c in wanted if c in images.columns]).orderBy("id")


def existing(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys that exist in `rows`."""
    return keys.join(present_keys(keys, rows, key), key, "left_semi")


def vectors_by_id(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Vectors for requested vector ids."""
    return vectors.join(keys.select("vector_id"), "vector_id", "left_semi")


def first_vector_of_image(vectors: DataFrame, image_ids: DataFrame) -> DataFrame:
    """The first vector, by vector id, of each requested image."""
    wanted = vectors.join(image_ids.select("image_id"), "image_id", "left_semi")
    return first_per_key(wanted, ["image_id"], ["vector_id"])


def vector_id_map(vectors: DataFrame, image_ids: DataFrame) -> DataFrame:
    """image_id -> vector_id; of several vectors the last by vector id wins."""
    wanted = vectors.select("image_id", "vector_id").join(image_ids.select("image_id"), "image_id", "left_semi")
    return wanted.groupBy("image_id").agg(F.max("vector_id").alias("vector_id"))


def known_hashes(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """Candidate hashes already in the library, each once (C4)."""
    return present_keys(candidates, images, "hash")


def with_tags(images: DataFrame, tags: DataFrame, links: DataFrame, fields: Sequence[str] = ("name",)) -> DataFrame:
    """Adds `tags`: the image's tags as an array of structs by (order, id); empty when untagged.

    Links are combined per image before the only shuffle; a set never holds more
    than the number of tags, however often a link is repeated.
    """
    entry = F.struct("order", F.col("id").alias("id"), *[f for f in fields if f not in ("order", "id")])
    named = tags.select(F.col("id").alias("tag_id"), entry.alias("tag"))
    per_image = (
        links.join(named, "tag_id").groupBy(F.col("image_id").alias("id"))
        .agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    )
    joined = images.join(per_image, "id", "left")
    empty = F.array().cast(joined.schema["tags"].dataType)
    return joined.withColumn("tags", F.coalesce("tags", empty))


def page_with_tags(shown: DataFrame, tags: DataFrame, links: DataFrame, fields: Sequence[str] = ("name",)) -> DataFrame:
    """The images of a page, or of any other small selection, with their tags as from `with_tags`.

    Only links of the shown images are combined: their ids are the side that Spark
    may broadcast by its size, so the links are scanned and not shuffled. A repeated
    image keeps its rows; one with a null id has no tags.
    """
    wanted = shown.select(F.col("id").alias("image_id"))
    return with_tags(shown, tags, links.join(wanted, "image_id", "left_semi"), fields)


def list_images(images: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Full catalogue with tags attached (A1)."""
    return with_tags(images, tags, links, ("name", "enabled", "color_rgb"))


def ranked_images(ranked: DataFrame, images: DataFrame) -> DataFrame:
    """Search results joined to their images; results without an image are dropped, ranks kept.

    Many queries may share one neighbour; each image is looked up by every row
    that names it, and a split of such a hot neighbour is left to the adaptive
    skew join.
    """
    return ranked.join(images.withColumnRenamed("id", "candidate_id"), "candidate_id")


def with_stored_blob(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """Images whose file is stored, the only ones shown in result pages."""
    keyed = images.withColumn("_h", F.lower("hash")).withColumn("_e", F.lower("extension"))
    stored = blobs.select(F.lower("hash").alias("_h"), F.lower("extension").alias("_e"))
    return keyed.join(stored, ["_h", "_e"], "left_semi").drop("_h", "_e")


def count_rows(rows: DataFrame) -> DataFrame:
    """Row count."""
    return rows.agg(F.count(F.lit(1)).alias("n"))


def next_tag_order(tags: DataFrame) -> DataFrame:
    """Order of a new tag: the largest in use, 0 without tags, so new tags tie."""
    return tags.agg(F.coalesce(F.max("order"), F.lit(0)).alias("next_order"))


def model_hashes(vectors: DataFrame) -> DataFrame:
    """Distinct model hashes, sorted."""
    return vectors.select("model_hash").distinct().orderBy("model_hash")
