"""Backup documents, recycle rows and score tables as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.names import from_iso8601, is_hash, is_rgb, is_set_path
from lumenlake.operators.ordering import first_per_key, skew_safe_lookup, with_global_index
from lumenlake.operators.tables import require_none
from lumenlake.schemas import BACKUP, FORMAT_VERSION, HASH_ALGORITHM
from lumenlake.sources.document import split_document


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A backup JSON document as one row of variant columns."""
    return spark.read.schema(BACKUP).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _records(document: DataFrame, field: str) -> DataFrame:
    return document.select(F.posexplode(F.col(field).cast("array<variant>")).alias("position", "record"))


def document_images(document: DataFrame) -> DataFrame:
    """(position, record) of each entry of `images`, whatever it is."""
    return _records(document, "images")


def document_tags(document: DataFrame) -> DataFrame:
    return _records(document, "tags")


def _kind(value: Column) -> Column:
    """JSON kind of a variant: STRING, BIGINT, BOOLEAN, VOID (null), ARRAY<...>, OBJECT<...>; null where there is no value."""
    return F.schema_of_variant(value)


def _is(value: Column, kind: str) -> Column:
    """Whether there is a value of this kind."""
    return F.coalesce(_kind(value).startswith(kind), F.lit(False))


def _field(name: str) -> Column:
    return F.try_variant_get("record", f"$.{name}", "variant")


def _text(name: str) -> Column:
    """The field if it is a string, else null."""
    return F.when(_is(_field(name), "STRING"), F.try_variant_get("record", f"$.{name}", "string"))


def _optional_text(name: str) -> Column:
    """Whether the field is a string, null or left out."""
    return F.coalesce(_kind(_field(name)).isin("STRING", "VOID"), F.lit(True))


def _no(rule: Column) -> Column:
    return ~F.coalesce(rule, F.lit(False))


def header_problems(document: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(columns named in `carry`, problem): broken rules of the document itself, by value and JSON kind."""
    version, algorithm = F.col("format_version"), F.col("hash_algorithm")
    checks = F.array(
        F.when(_no(_is(version, "BIGINT") & (F.try_variant_get(version, "$", "long") == FORMAT_VERSION)), F.lit("format_version")),
        F.when(_no(_is(algorithm, "STRING") & (F.try_variant_get(algorithm, "$", "string") == HASH_ALGORITHM)), F.lit("hash_algorithm")),
        F.when(_no(_is(F.col("images"), "ARRAY")), F.lit("images")),
        F.when(_no(_is(F.col("tags"), "ARRAY")), F.lit("tags")),
    )
    return document.select(*carry, F.explode(F.array_compact(checks)).alias("problem"))


def first_set_problems(records: DataFrame, paths: DataFrame) -> DataFrame:
    """(problem): `set_1` where there are image records but `paths` (path, relative to the backup) has no file of the first set."""
    some = records.limit(1).select(F.lit("set_1").alias("problem"))
    found = paths.where(F.col("path").startswith("set_1/")).limit(1).select(F.lit("set_1").alias("problem"))
    return some.join(found, "problem", "left_anti")


def image_problems(records: DataFrame, zone: str = "UTC") -> DataFrame:
    """(position, problem): the first broken rule of each bad image record, by value and JSON kind."""
    tags = F.try_variant_get("record", "$.tags", "array<variant>")
    problem = (
        F.when(_no(_is(F.col("record"), "OBJECT")), F.lit("record"))
        .when(_no(is_set_path(_text("path"))), F.lit("path"))
        .when(_no(is_hash(_text("hash"))), F.lit("hash"))
        .when(~_optional_text("text_in_image"), F.lit("text_in_image"))
        .when(_no(_is(_field("tags"), "ARRAY")) | _no(F.forall(tags, lambda t: _is(t, "STRING"))), F.lit("tags"))
        .when(from_iso8601(_text("imported_at"), zone).isNull(), F.lit("imported_at"))
        .when(from_iso8601(_text("modification_date"), zone).isNull(), F.lit("modification_date"))
    )
    return records.select("position", problem.alias("problem")).where("problem IS NOT NULL")


def _named_tags(records: DataFrame) -> DataFrame:
    """Tag records with their name; of a name only the first, of records without a name all."""
    named = records.withColumn("name", _text("name"))
    key = F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.col("position").cast("string"))
    return first_per_key(named.withColumn("_none", key), ["name", "_none"], ["position"]).drop("_none")


def tag_problems(records: DataFrame) -> DataFrame:
    """(position, problem): the first broken rule of each bad tag record; repeats of a name are not judged."""
    order = F.try_variant_get("record", "$.order", "long")
    problem = (
        F.when(_no(_is(F.col("record"), "OBJECT")), F.lit("record"))
        .when(F.coalesce(F.col("name"), F.lit("")) == "", F.lit("name"))
        .when(_no(is_rgb(_text("rgb"))), F.lit("rgb"))
        .when(_no(_is(_field("order"), "BIGINT") & (order >= 0)), F.lit("order"))
        .when(_no(_is(_field("enabled"), "BOOLEAN")), F.lit("enabled"))
        .when(~_optional_text("description"), F.lit("description"))
    )
    return _named_tags(records).select("position", problem.alias("problem")).where("problem IS NOT NULL")


def checked_backup(records: DataFrame, tag_records: DataFrame, zone: str = "UTC", paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, tags) of backup records (position, record); any broken rule rejects all of them.

    With `paths`, the files beside the backup, images without a first set are rejected too.
    """
    require_none(image_problems(records, zone), "backup images rejected")
    require_none(tag_problems(tag_records), "backup tags rejected")
    if paths is not None:
        require_none(first_set_problems(records, paths), "backup rejected")
    images = records.select(
        "position", _text("path").alias("path"),
        F.lower(_text("hash")).alias("hash"),
        F.regexp_extract(_text("path"), "([^/]+)$", 1).alias("original_file_name"),
        from_iso8601(_text("imported_at"), zone).alias("imported_at"),
        from_iso8601(_text("modification_date"), zone).alias("modification_date"),
        _text("text_in_image").alias("text_in_image"),
        F.array_distinct(F.try_variant_get("record", "$.tags", "array<string>")).alias("tag_names"),
    )
    tags = _named_tags(tag_records).select(
        "position", "name", _text("rgb").alias("color_rgb"), F.try_variant_get("record", "$.order", "int").alias("order"),
        _text("description").alias("description"), F.try_variant_get("record", "$.enabled", "boolean").alias("enabled"),
    )
    return images, tags


def preflight(document: DataFrame, paths: DataFrame) -> None:
    """Abort on a document with images but without a first set of files."""
    require_none(first_set_problems(document_images(document.where(_is(F.col("images"), "ARRAY"))), paths), "backup rejected")


def read_backup(spark: SparkSession, path: str, zone: str = "UTC", paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, tags) of a backup that is one JSON document, read in parts by many tasks."""
    document = split_document(spark, path)
    require_none(header_problems(document.header), "backup rejected")
    return checked_backup(document.images, document.tags, zone, paths)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, record) of a table of `write_backup`."""
    lines = spark.read.option("singleVariantColumn", "record").option("recursiveFileLookup", True).json(path)
    return lines.select(F.try_variant_get("record", "$.position", "long").alias("position"), "record")


def read_backup_tables(spark: SparkSession, path: str, zone: str = "UTC", paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, tags) of a backup written by `write_backup`; the entries are read in parallel, with the positions they had."""
    header = spark.read.schema(BACKUP).json(f"{path}/header")
    require_none(header_problems(header), "backup rejected")
    return checked_backup(_lines(spark, f"{path}/images"), _lines(spark, f"{path}/tags"), zone, paths)


def write_backup(entries: DataFrame, tags: DataFrame, path: str, exported_at: str) -> None:
    """Backup entries as JSON lines, images partitioned by set, tags and the header beside them.

    A single document would have to pass through one task; the entries keep the
    document's fields and their `position` in it, so the parts can be put into one.
    Images are numbered by set and path, tags as `tags` numbers them.
    """
    spark = entries.sparkSession
    placed = with_global_index(entries, ["set_index", "path"], "position", 0)
    placed.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("set_index").json(f"{path}/images")
    tags.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/tags")
    # One partition: others would leave files without a row.
    header = spark.range(0, 1, 1, 1).select(
        F.lit(FORMAT_VERSION).alias("format_version"), F.lit(HASH_ALGORITHM).alias("hash_algorithm"), F.lit(exported_at).alias("exported_at"),
        # Kinds only: the entries lie beside the header.
        F.array().cast("array<string>").alias("images"), F.array().cast("array<string>").alias("tags"))
    header.write.mode("overwrite").json(f"{path}/header")


def wide_curves(ranked: DataFrame, value: str, prefix: str, top_k: int) -> DataFrame:
    """One row per query with columns `<prefix>1..<prefix>top_k`; short curves end in nulls."""
    listed = ranked.where(F.col("rank") <= top_k).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", value))).alias("_v")
    )
    return listed.select("query_id", *[F.get("_v", F.lit(i))[value].alias(f"{prefix}{i + 1}") for i in range(top_k)])


def cluster_lists(clusters: DataFrame, part_members: int = 100_000) -> DataFrame:
    """One row per cluster with its sorted members joined by `;`.

    A cluster of more than `part_members` goes on in further rows, numbered by `part`
    from 0, so that no cell and no task holds more than one part of it.
    """
    keys = ["threshold", "cluster_id"]
    placed = with_global_index(clusters, [*keys, "member_id"], "_i", 0)
    starts = placed.groupBy(*keys).agg(F.min("_i").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    rows = skew_safe_lookup(placed, starts.select(*keys, "_start"), keys, "member_id", starts, "_rows")
    part = F.floor((F.col("_i") - F.col("_start")) / part_members).cast("int")
    members = F.array_join(F.transform(F.array_sort(F.collect_list("member_id")), lambda m: m.cast("string")), ";")
    return rows.groupBy(*keys, "size", part.alias("part")).agg(members.alias("members"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; null becomes an empty cell."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_curves(spark: SparkSession, path: str, top_k: int, id_col: str = "query_id", prefix: str = "score_") -> DataFrame:
    """(query_id, rank, sim) from a wide score table (A10)."""
    columns = [id_col, *[f"{prefix}{i}" for i in range(1, top_k + 1)]]
    # The header decides which score columns there are; values stay text until cut.
    wide = spark.read.option("header", True).csv(path)
    present = [c for c in columns[1:] if c in wide.columns]
    return curves_from_wide(wide.select(F.col(id_col).cast("long").alias("query_id"), *present), present)


def curves_from_wide(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long curves from score columns; a curve stops at its first empty cell (A10)."""
    cells = F.array(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])
    empty = F.array_position(F.transform(cells, lambda v: v.isNull()), F.lit(True)).cast("int")
    kept = F.when(empty > 0, F.slice(cells, F.lit(1), empty - 1)).otherwise(cells)
    return wide.select("query_id", F.posexplode(kept).alias("pos", "v")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("v").cast("double").alias("sim")
    )


RECYCLE_VERSION = 1


def recycle_rows(deleted: DataFrame, blobs: DataFrame) -> DataFrame:
    """(hash, extension, sidecar) for deleted images.

    `deleted` holds image fields, `tag_names` and `deleted_at`. Rows without a
    stored file are skipped; of several deletes of one hash the last wins.
    """
    latest = first_per_key(deleted, ["hash"], [F.col("deleted_at").desc(), F.col("id").desc()])
    stored = blobs.select(F.lower("hash").alias("_h"), F.lower("extension").alias("_e")).distinct()
    kept = latest.withColumn("_h", F.lower("hash")).withColumn("_e", F.lower("extension")).join(stored, ["_h", "_e"], "left_semi")
    payload = F.struct(
        F.lit(RECYCLE_VERSION).alias("schema_version"), "original_file_name", "extension", "text_in_image",
        F.col("tag_names").alias("tags"), "imported_at", "modification_date", "deleted_at",
    )
    return kept.select("hash", "extension", F.to_json(payload, {"ignoreNullFields": "false"}).alias("sidecar"))


def write_recycle(rows: DataFrame, path: str) -> None:
    """Sidecars as one table, partitioned like the blob store."""
    rows.withColumn("prefix", F.substring("hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
