"""Image files and stored blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.names import blob_entities, blob_key, extension_override, format_extension, image_format, image_size
from lumenlake.functions.text import casefold

# --- fixed values: suffixes taken up by discovery and by the flat scan ---
DISCOVERED = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".avif", ".heic", ".heif")
FLAT_SCAN = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif")
# --------------------------------------------------------------------------


def _suffix(path: str = "path"):
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def _read(spark: SparkSession, paths: list[str], recursive: bool, columns: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return files.select(*columns)


def discover_images(spark: SparkSession, folders: list[str], files: list[str] = (), recursive: bool = True) -> DataFrame:
    """(path, length) of image files below folders plus explicitly named files, each path once (A2).

    Only names and sizes are read; content stays on disk.
    """
    columns = ("path", "length")
    found = None
    if folders:
        found = _read(spark, list(folders), recursive, columns).where(_suffix().isin(*DISCOVERED))
    if files:
        named = _read(spark, list(files), False, columns)
        found = named if found is None else found.unionByName(named)
    if found is None:
        raise ValueError("neither folders nor files given")
    return found.dropDuplicates(["path"]).orderBy(casefold("path"), "path")


def file_profiles(files: DataFrame) -> DataFrame:
    """Name, size, sha1, true extension, width and height of files (path, content); `error` for unknown formats (A4).

    Width and height are read from headers of fixed shape (PNG, GIF, BMP) and null elsewhere: no image is decoded.
    """
    fmt = image_format("content")
    size = image_size("content", fmt)
    return files.select(
        "path",
        F.regexp_extract("path", "([^/]+)$", 1).alias("original_file_name"),
        F.length("content").cast("long").alias("file_size"),
        F.sha1("content").alias("hash"),
        format_extension(fmt).alias("extension"),
        size["width"].alias("size_width"),
        size["height"].alias("size_height"),
        F.when(fmt.isNull(), F.concat(F.lit("unknown image format: "), "path")).alias("error"),
    )


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of the image files directly in a folder; bad files keep their row with `error` (A3)."""
    files = _read(spark, [folder], False, ("path", "content")).where(_suffix().isin(*FLAT_SCAN))
    return file_profiles(files)


def stored_blobs(spark: SparkSession, root: str) -> DataFrame:
    """(hash, extension, path) of a blob store; files of any other shape are ignored (A5)."""
    return blob_entities(_read(spark, [root], True, ("path",)))


def blobs_to_store(files: DataFrame, blobs: DataFrame, extension_col: str = "extension") -> DataFrame:
    """(hash, extension, key) of files that are not stored yet.

    A caller's hash counts only when it has 40 characters; else the bytes are
    hashed. Equal files are stored once.
    """
    trusted = F.when(F.length("hash") == 40, F.lower("hash")).otherwise(F.sha1("content"))
    wanted = files.select(trusted.alias("hash"), extension_override(extension_col).alias("extension")).where("extension IS NOT NULL").distinct()
    fresh = wanted.join(blobs.select("hash", "extension"), ["hash", "extension"], "left_anti")
    return fresh.withColumn("key", blob_key("hash", "extension"))
