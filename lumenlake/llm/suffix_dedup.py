"""Repeated byte windows: depth-limited radix sort of all suffixes, by most significant digits first.

Only the first `width` bytes of a suffix matter, so sorting stops there: suffixes
that are still equal then are exactly the windows that occur more than once.

A digit of the usual sort is a byte; here the digit of pass i is the smallest hash
of the `depth[i]`-byte strings inside the window, which is a function of the
window's bytes alone, so equal windows always fall in the same group. Neighbouring
suffixes mostly share that digit, so a group is held as runs of suffixes, not one
by one. Of equal hashes in a window the leftmost counts and a run ends where that place
changes, so two equal windows never share a run. After each pass
  * a run whose digit occurs nowhere else holds no repeated window and leaves,
  * a run whose whole byte string occurs again is repeated as a whole and leaves,
  * the rest, with one representative of each repeated byte string beside it, goes
    on to the next and deeper digit, cut out of its text.
The last pass takes the whole window as its digit: equal groups are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import byte_rows, discard, stored
from lumenlake.llm.window_hash import hashes, mix, prefix_sums, sliding_min, window_values
from lumenlake.operators.ordering import skew_safe_lookup

WIDTH = 200
# Digit depths of the passes before the last one.
DEPTHS = (72, 184)

_KEY = ["doc_id", "text_hash"]
_PART = [*_KEY, "base"]
_RUNS = "doc_id long, text_hash long, base long, start long, n long, digit long, whole long"
_PARTS = "doc_id long, text_hash long, base long, data binary"
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_RESULT = "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _batch(columns: list, schema: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema)


def _runs(depth: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of window starts that share their digit, for each part of a text."""
    names = [c.split()[0] for c in _RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, lengths, digits, wholes, rows = [], [], [], [], []
            base = batch.column("base").to_numpy(zero_copy_only=False)
            for row, data in enumerate(byte_rows(batch.column("data"))):
                if len(data) < width:
                    continue
                sums = prefix_sums(data)
                values = window_values(sums, depth)
                # High half: the hash; low half: its place, so that a minimum is also a leftmost one.
                placed = (values & _HIGH) | np.arange(len(values), dtype=np.uint64)
                least = sliding_min(placed, width - depth + 1)
                start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                end = np.concatenate((start[1:], [len(least)]))
                starts.append(start + base[row])
                lengths.append(end - start)
                digits.append(mix(values[least[start] & _LOW]))
                wholes.append(hashes(sums, start, end - 1 + width))
                rows.append(np.full(len(start), row))
            if rows:
                where = pa.array(np.concatenate(rows))
                yield _batch([
                    batch.column("doc_id").take(where), batch.column("text_hash").take(where),
                    batch.column("base").take(where), np.concatenate(starts),
                    np.concatenate(lengths), np.concatenate(digits).view(np.int64), np.concatenate(wholes).view(np.int64),
                ], names)

    return run


def _cut(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes under each unresolved run of a part, as parts of the next pass."""
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs = batch.column("base").to_pylist(), batch.column("runs").to_pylist()
            at, pieces, rows = [], [], []
            for row, data in enumerate(byte_rows(batch.column("data"))):
                for r in runs[row]:
                    first = r["start"] - base[row]
                    at.append(r["start"])
                    pieces.append(data[first:first + r["n"] - 1 + width].tobytes())
                    rows.append(row)
            where = pa.array(rows, pa.int64())
            yield _batch([batch.column("doc_id").take(where), batch.column("text_hash").take(where),
                          pa.array(at, pa.int64()), pa.array(pieces, pa.binary())], names)

    return run


def _remove(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without the bytes that their repeated windows cover."""
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("runs")
            flat, offsets = found.flatten(), found.offsets.to_numpy()
            filled = found.is_valid().to_numpy(zero_copy_only=False)
            start = flat.field("start").to_numpy(zero_copy_only=False)
            length = flat.field("n").to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for row, data in enumerate(byte_rows(batch.column("data"))):
                gone = 0
                edges = 0
                rest = data.tobytes()
                if filled[row] and offsets[row + 1] > offsets[row]:
                    s = start[offsets[row]:offsets[row + 1]]
                    n = length[offsets[row]:offsets[row + 1]]
                    steps = np.bincount(s, minlength=len(data) + 1)[:len(data) + 1] - np.bincount(
                        s + n - 1 + width, minlength=len(data) + 1)[:len(data) + 1]
                    covered = np.cumsum(steps[:-1]) > 0
                    gone = int(covered.sum())
                    edges = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    rest = data[~covered].tobytes()
                sizes.append(len(data))
                removed.append(gone)
                spans.append(edges)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield _batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                          pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names)

    return run


def _pass(parts: DataFrame, depth: int, width: int, scratch: list[str]) -> DataFrame:
    """Runs whose digit occurs more than once, with `repeated` (the whole run) and `open` (goes on)."""
    # Counted and joined: written, as hashing every place of a text again costs far more than reading its runs.
    made: list[str] = []
    runs = stored(parts.mapInArrow(_runs(depth, width), _RUNS), made)
    name = F.xxhash64(*_KEY, "start")
    # Counted with partial sums before the shuffle; a hot digit is one row per task there and split in the joins.
    shared = stored(runs.groupBy("digit").agg(F.count(F.lit(1)).alias("rows"), (F.min("whole") < F.max("whole")).alias("several")).where("rows > 1"), scratch)
    alike = skew_safe_lookup(runs, shared.select("digit", "several"), ["digit"], name, shared, "rows")
    if depth == width:
        scratch += made
        return alike.select(*_PART, "start", "n", F.lit(True).alias("repeated"), F.lit(False).alias("open"))
    alike = stored(alike, scratch)
    discard(parts.sparkSession, made)
    strings = stored(alike.groupBy("digit", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("first")), scratch)
    return stored(
        skew_safe_lookup(alike, strings, ["digit", "whole"], name, strings, "copies").select(
            *_PART, "start", "n", (F.col("copies") > 1).alias("repeated"),
            (F.col("several") & ((F.col("copies") == 1) | (name == F.col("first")))).alias("open"),
        ), scratch)


def repeated_runs(parts: DataFrame, width: int, depths: Sequence[int], scratch: list[str]) -> DataFrame:
    """(doc_id, text_hash, start, n): runs of starts whose `width`-byte windows occur more than once."""
    found = []
    for depth in (*depths, width):
        judged = _pass(parts, depth, width, scratch)
        found.append(judged.where("repeated").select(*_KEY, "start", "n"))
        if depth < width:
            left = judged.where("open").groupBy(*_PART).agg(F.collect_set(F.struct("start", "n")).alias("runs"))
            match = parts.alias("p").join(left.alias("r"), F.expr(
                "p.doc_id <=> r.doc_id AND p.text_hash = r.text_hash AND p.base = r.base"))
            parts = stored(match.select("p.*", "r.runs").mapInArrow(_cut(width), _PARTS), scratch)
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, depths: Sequence[int] = DEPTHS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every text without the bytes covered by a `width`-byte string that also starts anywhere else.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per
    input row; `kept` is the remaining bytes. Texts are judged as UTF-8 bytes on
    the input as it is, overlaps within one text count, matches never cross rows.
    A null text is empty; a text shorter than `width` is kept whole. A repeated row
    is a copy like any other, whether or not its id is the same or null. Other
    columns are ignored. Intermediate tables lie in the shared checkpoint folder.
    """
    if not all(0 < a < b for a, b in zip(depths, (*depths[1:], width))):
        raise ValueError("depths must rise and stay below the width")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        F.lit(0).cast("long").alias("base"), text.alias("data"))
    scratch: list[str] = []
    runs = repeated_runs(parts, width, depths, scratch)
    per_text = stored(runs.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n")).alias("runs")), [])
    discard(docs.sparkSession, scratch)
    joined = parts.alias("p").join(per_text.alias("r"), F.expr("p.doc_id <=> r.doc_id AND p.text_hash = r.text_hash"), "left")
    return joined.select("p.doc_id", "p.text_hash", "p.data", "r.runs").mapInArrow(_remove(width), _RESULT).drop("text_hash")
