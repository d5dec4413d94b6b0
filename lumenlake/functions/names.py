"""File names, paths, formats, hashes and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import strip

# --- fixed values -------------------------------------------------------------
SET_PATH = "^set_[1-9][0-9]*/[^/\\\\\\n]+$"
HASH = "^[0-9a-fA-F]{40}$"
RGB = "^#[0-9A-Fa-f]{6}$"
BLOB_PATH = "(?:^|/)([0-9a-f]{2})/(\\1[0-9a-f]{38})(\\.[^./]+)$"
FORMAT_EXTENSIONS = {
    "JPEG": ".jpg",
    "PNG": ".png",
    "GIF": ".gif",
    "BMP": ".bmp",
    "WEBP": ".webp",
    "TIFF": ".tif",
    "AVIF": ".avif",
    "HEIF": ".heif",
    "HEIC": ".heic",
    "JPEG2000": ".jp2",
}
# (format, first bytes)
MAGIC = (
    ("PNG", b"\x89PNG\r\n\x1a\n"),
    ("JPEG", b"\xff\xd8\xff"),
    ("GIF", b"GIF87a"),
    ("GIF", b"GIF89a"),
    ("BMP", b"BM"),
    ("TIFF", b"II*\x00"),
    ("TIFF", b"MM\x00*"),
    ("JPEG2000", b"\x00\x00\x00\x0cjP  \r\n\x87\n"),
    ("JPEG2000", b"\xff\x4f\xff\x51"),
)
# (format, major brands behind `ftyp` at byte 5)
BRANDS = (
    ("AVIF", (b"avif", b"avis")),
    ("HEIC", (b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx")),
    ("HEIF", (b"mif1", b"msf1")),
)
# Thumbnails: needed above 300 pixels, drawn into a 200-pixel square.
THUMBNAIL_ABOVE, THUMBNAIL_SIDE = 300, 200
# --------------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def image_format(content: str | Column) -> Column:
    """Format by the first bytes, null when unknown."""
    c = _col(content)
    brand = F.when(F.substring(c, 5, 4) == F.lit(b"ftyp"), F.substring(c, 9, 4))
    found = F.when((F.substring(c, 1, 4) == F.lit(b"RIFF")) & (F.substring(c, 9, 4) == F.lit(b"WEBP")), F.lit("WEBP"))
    for name, magic in MAGIC:
        found = found.when(F.substring(c, 1, len(magic)) == F.lit(magic), F.lit(name))
    for name, brands in BRANDS:
        found = found.when(brand.isin(*[F.lit(b) for b in brands]), F.lit(name))
    return found


def image_size(content: str | Column, fmt: Column) -> Column:
    """struct(width, height) as the header of a PNG, GIF or BMP states it; nulls for other formats and short files (A4)."""
    c = _col(content)

    def number(first: int, size: int, little: bool) -> Column:
        places = range(first + size - 1, first - 1, -1) if little else range(first, first + size)
        digits = F.concat(*[F.hex(F.substring(c, at, 1)) for at in places])
        return F.when(F.length(c) >= first + size - 1, F.conv(digits, 16, 10).cast("long"))

    # A BMP stored top-down has a negative height.
    bmp_height = number(23, 4, True)
    bmp_height = F.when(bmp_height >= 1 << 31, (1 << 32) - bmp_height).otherwise(bmp_height)
    width = F.when(fmt == "PNG", number(17, 4, False)).when(fmt == "GIF", number(7, 2, True)).when(fmt == "BMP", number(19, 4, True))
    height = F.when(fmt == "PNG", number(21, 4, False)).when(fmt == "GIF", number(9, 2, True)).when(fmt == "BMP", bmp_height)
    return F.struct(width.alias("width"), height.alias("height"))


def format_extension(fmt: str | Column) -> Column:
    """File extension of a format name, null when unknown."""
    upper = F.upper(_col(fmt))
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, extension in FORMAT_EXTENSIONS.items():
        found = found.when(upper == name, F.lit(extension))
    return found


def is_safe_name(name: str | Column) -> Column:
    """File name usable inside an export set."""
    n = _col(name)
    return n.isNotNull() & ~n.isin("", ".", "..") & ~n.rlike("[/\\\\]")


def normalised_file_name(name: str | Column, extension: str | Column) -> Column:
    """Name with the true extension exactly once; null when the name is not allowed."""
    n, ext = strip(name), _col(extension)
    has_ext = (ext != "") & F.lower(n).endswith(F.lower(ext))
    stem = F.when(has_ext, F.substring(n, F.lit(1), F.length(n) - F.length(ext))).otherwise(n)
    stem = F.regexp_replace(stem, "[ .]+$", "")
    return F.when(is_safe_name(n) & (stem != ""), F.concat(stem, ext))


def extension_override(extension: str | Column) -> Column:
    """Caller-given extension in stored form, null when not allowed."""
    e = F.lower(strip(extension))
    return F.when(e.rlike("^\\.[\\p{L}\\p{N}_-]*[\\p{L}\\p{N}][\\p{L}\\p{N}_-]*$"), e)


def blob_key(hash_: str | Column, extension: str | Column) -> Column:
    """Relative path of a stored file."""
    h = _col(hash_)
    return F.concat_ws("/", F.substring(h, 1, 2), F.concat(h, _col(extension)))


def blob_entities(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(hash, extension, path) of well-formed blob paths; anything else is ignored (A5)."""
    p = F.col(path_col)
    return paths.where(p.rlike(BLOB_PATH)).select(
        F.regexp_extract(p, BLOB_PATH, 2).alias("hash"), F.regexp_extract(p, BLOB_PATH, 3).alias("extension"), p.alias("path")
    )


def is_set_path(path: str | Column) -> Column:
    p = _col(path)
    return p.rlike(SET_PATH) & ~p.rlike("/\\.{1,2}$")


def is_hash(hash_: str | Column) -> Column:
    return _col(hash_).rlike(HASH)


def is_rgb(color: str | Column) -> Column:
    return _col(color).rlike(RGB)


def rfc3339(local: str | Column, zone: str = "UTC") -> Column:
    """Naive local time as text with its offset, UTC as `Z` (F7); microseconds only when present.

    Computed on naive times throughout, so the session's own zone plays no part.
    """
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(local).cast("timestamp_ntz"))
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    text = wall.cast("string")
    micros = F.regexp_extract(text, r"\.([0-9]+)$", 1)
    micros = F.when(micros != "", F.concat(F.lit("."), F.rpad(micros, 6, "0"))).otherwise(F.lit(""))
    ahead = wall - utc
    minutes = 60 * F.extract(F.lit("HOUR"), ahead) + F.extract(F.lit("MINUTE"), ahead)
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    size = F.abs(minutes)
    offset = F.when(minutes == 0, F.lit("Z")).otherwise(F.format_string("%s%02d:%02d", sign, (size / 60).cast("int"), (size % 60).cast("int")))
    return F.concat(F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")), micros, offset)


def from_iso8601(text: str | Column, zone: str = "UTC") -> Column:
    """ISO text to naive local time; zoned values are converted, naive ones kept (F8); null when invalid.

    Wall time and offset are read apart and joined without the session's zone.
    """
    t = _col(text)
    shaped = t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    offset = F.when(t.contains(":"), F.regexp_extract(t, "(Z|[+-][0-9]{2}:?[0-9]{2})$", 1)).otherwise(F.lit(""))
    wall = F.replace(F.substring(t, F.lit(1), F.length(t) - F.length(offset)), F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    digits = F.regexp_replace(offset, "[^0-9]", "")
    sign = F.when(offset.startswith("-"), F.lit(1)).otherwise(F.lit(-1))
    # Adding the offset's opposite gives UTC.
    hours = sign * F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0))
    minutes = sign * F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    utc = wall + F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0).cast("decimal(18,6)"))
    local = F.when(offset == "", wall).otherwise(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
    return F.when(shaped, local).cast("timestamp_ntz")


def thumbnail_plan(width: str | Column = "size_width", height: str | Column = "size_height") -> Column:
    """struct(needed, width, height) of the thumbnail of an image."""
    w, h = _col(width), _col(height)
    scale = F.least(F.lit(THUMBNAIL_SIDE) / w, F.lit(THUMBNAIL_SIDE) / h)
    needed = (w > THUMBNAIL_ABOVE) | (h > THUMBNAIL_ABOVE)

    def side(s: Column) -> Column:
        return F.when(needed, F.greatest(F.lit(1), (s * scale).cast("int"))).otherwise(s.cast("int"))

    return F.struct(needed.alias("needed"), side(w).alias("width"), side(h).alias("height"))
