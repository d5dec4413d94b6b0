"""One large backup document, read and written in parts.

Spark's text source cuts a file by bytes and ends a row at each `}`, so the parts of one
document are read by many tasks. Whether such a part lies inside a string, and how deep,
follows from what the splits before it add up to. A first pass adds up each split, once as
if it began outside a string and once as if inside, and only these sums meet on the driver.
A second pass, which knows how its split begins, puts the parts of an entry together where
they are read. An entry of an array of the document is what lies between two `}` that lead
back to the depth of the array; only what crosses the end of a split is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.operators.ordering import with_global_index
from lumenlake.schemas import FORMAT_VERSION, HASH_ALGORITHM
from lumenlake.session import DROP_SHUFFLES, cut_lineage, drop_table, held_conf, ship_package, write_table

FIELDS = ("format_version", "hash_algorithm", "exported_at", "images", "tags")
# Depth inside an array of the document: the object, then the array.
_ARRAY_DEPTH = 2


# Rows and bytes of pieces that a task hands on at once.
_BATCH_ROWS, _BATCH_BYTES = 2048, 8 << 20


class Document(NamedTuple):
    """`header` has a row of variant columns; its arrays hold only their entries beside the first object.

    The entries are read from `table`, which `drop_table` removes when they are no longer needed.
    """

    header: DataFrame
    images: DataFrame
    tags: DataFrame
    table: str


class _Row(NamedTuple):
    """A part as read: `file` and `start` name its split, `signs` are its quotes, brackets and commas without escapes."""

    file: str
    start: int
    size: int
    value: bytes
    signs: bytes


class _Start(NamedTuple):
    """How a split begins: its number, whether inside a string, at which depth; what it must hold, and where its last piece ends."""

    number: int
    quoted: int
    depth: int
    octets: int
    open: bool
    target: int


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Row]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH_ROWS):
            part = batch.slice(at, _BATCH_ROWS)
            value = part.column("value").cast(pa.binary())
            # No escape in JSON ends in `}`, so none is cut in two.
            signs = pc.replace_substring_regex(value, r'(?s)\\.|[^"\[\]{,\\]+', "")
            yield from map(_Row, *(part.column(c).to_pylist() for c in ("file", "start", "size")), value.to_pylist(), signs.to_pylist())


def _walk(outside: bytes) -> tuple[int, int, bytes, Counter]:
    """(change of depth, lowest point on the way, brackets, commas by depth) of signs outside strings."""
    depth = low = 0
    commas: Counter = Counter()
    for sign in outside:
        if sign in b"{[":
            depth += 1
        elif sign in b"}]":
            depth -= 1
            low = min(low, depth)
        elif sign == ord(","):
            commas[depth] += 1
    return depth, low, re.sub(rb"[^\[\]{}]", b"", outside), commas


# Most entries have the shape of others.
_walk_short = lru_cache(10_000)(_walk)


# A string, also one that ends in a later part.
_QUOTED = re.compile(rb'"[^"]*("|$)')


def _step(signs: bytes, quoted: int) -> tuple[int, tuple[int, int, bytes, Counter]]:
    """(whether the row ends inside a string, the walk over its signs outside strings, with its `}` if that is one of them)."""
    after = (quoted + signs.count(b'"')) % 2
    outside = _QUOTED.sub(b"", b'"' + signs if quoted else signs) + (b"" if after else b"}")
    return after, (_walk_short if len(outside) < 200 else _walk)(outside)


_SUMS = "file string, start long, size long, last boolean, octets long, quotes int, depths array<long>, ends array<long>, blank boolean"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for a split, its last part and all before it: what they add to quotes and depth, and the lowest depth
    behind a `}`, each for a start outside and inside a string."""
    def added(total: list | None, row: _Row) -> list:
        octets, quotes, depths, ends = total or (0, 0, [0, 0], [None, None])
        depths, ends = list(depths), list(ends)
        for begun in (0, 1):
            after, walk = _step(row.signs, (begun + quotes) % 2)
            depths[begun] += walk[0]
            if not after:
                ends[begun] = depths[begun] if ends[begun] is None else min(ends[begun], depths[begun])
        return [octets + len(row.value) + 1, (quotes + row.signs.count(b'"')) % 2, depths, ends]

    def told(row: _Row, before: list | None) -> list[list]:
        key = [row.file, row.start, row.size]
        return ([] if before is None else [[*key, False, *before, False]]) + [[*key, True, *added(None, row), not row.value.strip()]]

    out: list[list] = []
    before = last = None
    for row in _rows(batches):
        if last is not None and (last.file, last.start) != (row.file, row.start):
            out += told(last, before)
            before = last = None
        if last is not None:
            before = added(before, last)
        last = row
    if last is not None:
        out += told(last, before)
    names = [c.split()[0] for c in _SUMS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def _starts(sums: list) -> dict[tuple[str, int], _Start]:
    """How each split begins, from the sums of all of them."""
    sums = sorted(sums, key=lambda r: (r["file"], r["start"], r["last"]))
    octets, final = Counter(), {}
    for r in sums:
        octets[r["file"]] += r["octets"]
        final[r["file"]] = r
    # A file that does not end in `}` has a last part that none ends.
    behind = [r for r in final.values() if octets[r["file"]] > r["size"]]
    if not all(r["blank"] for r in behind):
        raise ValueError("text behind the last bracket of the backup")
    quoted = depth = 0
    begun: dict[tuple[str, int], list] = {}
    for r in sums:
        # [inside a string, depth, octets, has an open part, has the end of a piece]
        split = begun.setdefault((r["file"], r["start"]), [quoted, depth, 0, False, False])
        split[2] += r["octets"]
        if any(r is b for b in behind):
            split[3] = True
            continue
        low = r["ends"][quoted]
        split[4] |= low is not None and depth + low <= _ARRAY_DEPTH
        depth, quoted = depth + r["depths"][quoted], (quoted + r["quotes"]) % 2
    starts: dict[tuple[str, int], _Start] = {}
    target = len(begun)
    for number, (key, (quoted, depth, size, open_, ended)) in reversed(list(enumerate(begun.items()))):
        starts[key] = _Start(number, quoted, depth, size, open_, target)
        target = number if ended else target
    return starts


_PIECES = "piece long, block int, fragment boolean, text string, brackets string, low long, before long, n long"


def _pieces(starts: dict[tuple[str, int], _Start]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass that makes rows of _PIECES: whole pieces, and as fragments what a split has of its first and behind its last end.

    Pieces are numbered by split and within it; `n` commas between entries lie in a piece, `before` in its split before it.
    """
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([c.view(pa.string()) if c.type == pa.binary() else c for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for r in split_pieces(batches):
            out.append(r)
            held += len(r[3])
            if len(out) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                yield batch(out)
                out, held = [], 0
        yield batch(out)

    def split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for row in _rows(batches):
            if last is not None:
                same = (last.file, last.start) == (row.file, row.start)
                yield from took(last, not same)
            if last is None or not same:
                begin(row)
            last = row
        if last is not None:
            yield from took(last, True)

    at: dict = {}

    def begin(row: _Row) -> None:
        start = starts.get((row.file, row.start))
        if start is None:
            raise ValueError("the splits of the backup changed between two reads")
        at.update(start=start, quoted=start.quoted, depth=start.depth, octets=0, ended=0, commas=0, before=0, low=start.depth, texts=[], brackets=[])

    def piece(number: int, fragment: bool) -> tuple:
        made = (number, at["start"].number, fragment, b"".join(at["texts"]), b"".join(at["brackets"]), at["low"], at["before"], at["commas"] - at["before"])
        at.update(before=at["commas"], low=at["depth"], texts=[], brackets=[])
        return made

    def took(row: _Row, final: bool) -> Iterator[tuple]:
        start = at["start"]
        at["octets"] += len(row.value) + 1
        if not (final and start.open):
            after, (change, low, brackets, commas) = _step(row.signs, at["quoted"])
            at["texts"] += (row.value, b"}")
            at["brackets"].append(brackets)
            at["low"] = min(at["low"], at["depth"] + low)
            at["commas"] += commas[_ARRAY_DEPTH - at["depth"]]
            at["depth"] += change
            at["quoted"] = after
            if not after and at["depth"] <= _ARRAY_DEPTH:
                yield piece((start.number << 32) + at["ended"], not at["ended"])
                at["ended"] += 1
        if final:
            if at["octets"] != start.octets:
                raise ValueError("the splits of the backup changed between two reads")
            if at["texts"]:
                yield piece(start.target << 32, True)

    return run


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(pieces, their table): the text up to each `}` that leads back to the depth of an array or lower, `before` counted from the first split."""
    ship_package(spark)
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
    # Both passes must see the same splits, whatever executors come or go between them.
    fixed = {"spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)}
    with held_conf(spark, fixed | DROP_SHUFFLES):
        lines = spark.read.option("lineSep", "}").text(path).select("value", *split)
        starts = _starts(lines.mapInArrow(_sums, _SUMS).collect())
        made, table = write_table(lines.mapInArrow(_pieces(starts), _PIECES), compression="zstd")
        # One row per split.
        earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        totals = made.groupBy("block").agg(F.sum("n").alias("_n"))
        offsets = cut_lineage(totals.select("block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")))
    placed = made.join(F.broadcast(offsets), "block").withColumn("before", F.col("before") + F.col("_offset")).drop("_offset")
    columns = ["piece", "text", "brackets", "low", "before", "n"]
    ordered = F.array_sort(F.collect_list(F.struct("block", "text", "brackets")))
    crossing = placed.where("fragment").groupBy("piece").agg(
        ordered.alias("_p"), F.min("low").alias("low"), F.min("before").alias("before"), F.sum("n").alias("n"))
    joined = [F.array_join(F.col(f"_p.{c}"), "").alias(c) for c in ("text", "brackets")]
    return placed.where("NOT fragment").select(*columns).unionByName(crossing.select("piece", *joined, "low", "before", "n")), table


def _skeleton(pieces: DataFrame, mark: str) -> DataFrame:
    """(document, seams): the document without the entries that lie between others, a marked entry in their place."""
    seams = pieces.where(F.col("low") < _ARRAY_DEPTH).agg(F.array_sort(F.collect_list(F.struct("piece", "text", "brackets"))).alias("s"))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("open"))

    def bracket(open_: Column, sign: Column) -> Column:
        return F.when(sign.isin("{", "["), F.concat(open_, sign)).when(
            sign.isin("}", "]"), F.substring(open_, F.lit(1), F.length(open_) - 1)).otherwise(open_)

    def seam(state: Column, s: Column) -> Column:
        open_ = F.aggregate(F.split(s["brackets"], ""), state["open"], bracket)
        marked = F.when(open_ == "{[", F.concat(F.lit(f',{{"{mark}":'), s["piece"].cast("string"), F.lit("}"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["text"], s["text"], marked).alias("text"), open_.alias("open"))

    whole = F.aggregate("s", start, seam)
    return seams.select(F.parse_json(whole["text"]).alias("document"), F.transform("s", lambda s: s["piece"]).alias("seams"))


def _entries(pieces: DataFrame, skeleton: DataFrame, mark: str, field: str) -> DataFrame:
    """(position, record) of one array of the document."""
    value = F.try_variant_get("document", f"$.{field}", "variant")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    beside = skeleton.where(is_list).select("seams", F.posexplode(value.cast("array<variant>")).alias("at", "record"))
    marker = F.try_variant_get("record", f"$.{mark}", "long")
    # At most one row: a single place in the array is left open.
    place = beside.where(marker.isNotNull()).select("at", marker.alias("seam"), "seams").first()
    listed = beside.where(marker.isNull()).select(F.col("at").cast("long").alias("position"), "record")
    if place is None:
        return listed
    end = min(s for s in place["seams"] if s > place["seam"])
    inner = pieces.where((F.col("piece") > place["seam"]) & (F.col("piece") < end))
    first, behind = inner.agg(F.coalesce(F.min("before"), F.lit(0)), F.coalesce(F.max(F.col("before") + F.col("n")), F.lit(0))).first()
    # The entries between stand in the place of the mark.
    moved = F.when(F.col("position") < place["at"], F.col("position")).otherwise(F.col("position") + (behind - first - 1))
    text = F.when(F.col("text").rlike(r"^\s*,"), F.regexp_replace("text", r"^\s*,", "")).otherwise(
        F.raise_error(F.lit("no comma between two entries of the backup")))
    entries = F.parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    between = inner.select((F.col("before") + (place["at"] - first)).alias("_before"), F.posexplode(entries).alias("_entry", "record"))
    return between.select((F.col("_before") + F.col("_entry")).alias("position"), "record").unionByName(
        listed.select(moved.alias("position"), "record"))


def split_document(spark: SparkSession, path: str) -> Document:
    """A backup document as its header and the (position, record) entries of its arrays, read in parallel.

    Only the header, with what lies around the entries, is put together in one task; it
    grows with the fields of the document and not with its entries. Broken JSON raises an
    error. Entries that are no objects are kept in their places; many of them without an
    object between are one part. A compressed file is read by one task. The document is
    read twice and its entries are written once, compressed; they are not shuffled.
    """
    mark = f"m{uuid.uuid4().hex}"
    pieces, table = _read(spark, path)
    skeleton = cut_lineage(_skeleton(pieces, mark))
    header = skeleton.select(*[F.try_variant_get("document", f"$.{f}", "variant").alias(f) for f in FIELDS])
    return Document(header, _entries(pieces, skeleton, mark, "images"), _entries(pieces, skeleton, mark, "tags"), table)


def write_document(entries: DataFrame, tags: DataFrame, path: str, exported_at: str, parts: int | None = None) -> None:
    """The backup as text files that in the order of their names are one JSON document, byte by byte.

    `split_document` reads the folder as it is; joined, the files are the single document.
    No task sees more than its own file, of which there are as many as `parts` or as the
    session shuffles. Images are ordered by (set_index, path), tags by their `position`.
    The entries are written once as a compressed table, so that the shuffles they come
    from are gone when they are sorted, in one shuffle, into the files.
    """
    spark = entries.sparkSession

    def json(rows: DataFrame) -> Column:
        return F.to_json(F.struct(*[c for c in rows.columns if c not in ("set_index", "position")]), {"ignoreNullFields": "false"})

    # What stands before an entry is part of its row, so every file ends behind a bracket.
    head = F.struct(F.lit(FORMAT_VERSION).alias("format_version"), F.lit(HASH_ALGORITHM).alias("hash_algorithm"), F.lit(exported_at).alias("exported_at"))
    first = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"images":['))
    with held_conf(spark, DROP_SHUFFLES):
        images, table = write_table(entries.select("set_index", "path", json(entries).alias("value")), compression="zstd")
        before = F.concat(first, F.lit('],"tags":[')) if images.isEmpty() else F.lit('],"tags":[')
        rows = images.select(F.lit(0).alias("part"), F.col("set_index").cast("long").alias("place"), "path", "value")
        tail = F.concat(before, F.lit("]}"))
        if not tags.isEmpty():
            lead = F.when(F.col("place") > 0, F.lit(",")).otherwise(before)
            listed = with_global_index(tags, ["position"], "place", 0).withColumn("value", json(tags))
            rows = rows.unionByName(listed.select(F.lit(1).alias("part"), "place", F.lit("").alias("path"), F.concat(lead, "value").alias("value")))
            tail = F.lit("]}")
        rows = rows.unionByName(spark.range(1).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("place"), F.lit("").alias("path"), tail.alias("value")))
        order = ["part", "place", "path"]
        placed = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
        # The first row of the first partition is the first of all.
        placed = placed.sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
        lead = F.when(F.col("part") > 0, F.lit("")).when(F.col("_i") == 0, first).otherwise(F.lit(","))
        placed.select(F.concat(lead, "value").alias("value")).write.mode("overwrite").text(path)
        drop_table(spark, table)
