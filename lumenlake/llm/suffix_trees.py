"""Substring dedup by prefix-partitioned suffix trees over the words of all texts.

Only the first `width` words of a suffix matter. Suffixes are partitioned by a prefix of
variable length: a suffix's prefix ends where its *anchor* ends, the leftmost smallest
(by hash) 12-word string among its first `width` words. Equal suffixes have equal anchors
at equal distance, so they meet in one partition; neighbouring suffixes mostly share their
anchor, so they travel together as one run of text.
  * A partition of one run holds no repeat and leaves at once.
  * A run whose whole string occurs again is repeated as a whole; one copy of it goes on.
  * A partition of at most `capacity` different strings fits in memory: its suffixes become
    a suffix tree, and the internal nodes of depth `width` or more are its repeats.
  * A larger partition is split by longer prefixes: the anchor grows by words to its right
    for suffixes that start close to it, and to its left for those that start far away, so
    that each half shares `24` words, then 30, 33 and at last all `width`. A prefix of
    `width` words is itself a deep node: being there twice is all that has to be known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import byte_rows, discard, stored
from lumenlake.llm.window_hash import hashes, mix, powers, sliding_min, window_values
from lumenlake.llm.window_hash import prefix_sums as byte_sums
from lumenlake.operators.ordering import skew_safe_lookup

WIDTH = 35
ANCHOR = 12
# Different strings of one partition that a task holds at once; each has fewer than two windows' words.
CAPACITY = 2048
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_TEXT = ["id", "text_hash"]
_RUN = "id long, text_hash long, start long, n long, lead long, key long, whole long"
_PIECE = "id long, text_hash long, start long, n long, lead long, key long, data binary"
_SPAN = "id long, text_hash long, start long, n long"
_RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept string"


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte behind it; words end at the six ASCII blanks."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    starts, ends = word_bounds(data)
    return hashes(byte_sums(data), starts, ends) if len(starts) else np.empty(0, np.uint64)


def _sums(words: np.ndarray) -> np.ndarray:
    """Sums S of word hashes times falling powers, as for bytes: words [i, j) hash to (S[j] - S[i]) * power[i]."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words), -1), dtype=np.uint64, out=sums[1:])
    return sums


def _table(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                      names=[c.split()[0] for c in schema.split(", ")])


def _anchored(width: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of neighbouring suffixes that share their anchor, for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, counts, leads, keys, wholes = [], [], [], [], [], []
            for row, data in enumerate(byte_rows(batch.column("data"))):
                words = word_hashes(data)
                if len(words) < width:
                    continue
                sums = _sums(words)
                values = mix(window_values(sums, anchor))
                # High half: the hash; low half: its place, so that a minimum is also a leftmost one.
                placed = (values & _HIGH) | np.arange(len(values), dtype=np.uint64)
                least = (sliding_min(placed, width - anchor + 1) & _LOW).astype(np.int64)
                start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                end = np.concatenate((start[1:], [len(least)]))
                rows.append(np.full(len(start), row))
                starts.append(start)
                counts.append(end - start)
                leads.append(least[start] - start)
                keys.append(values[least[start]])
                wholes.append(hashes(sums, start, end - 1 + width))
            if rows:
                where = pa.array(np.concatenate(rows))
                yield _table([batch.column("id").take(where), batch.column("text_hash").take(where), np.concatenate(starts),
                              np.concatenate(counts), np.concatenate(leads), np.concatenate(keys).view(np.int64),
                              np.concatenate(wholes).view(np.int64)], _RUN)

    return run


def _cut(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words under each run that goes on, as one piece of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, at, pieces, found = batch.column("runs").to_pylist(), [], [], []
            for row, data in enumerate(byte_rows(batch.column("data"))):
                starts, ends = word_bounds(data)
                for r in runs[row]:
                    pieces.append(data[starts[r["start"]]:ends[r["start"] + r["n"] + width - 2]].tobytes())
                    found.append(r)
                    at.append(row)
            where = pa.array(at, pa.int64())
            yield _table([batch.column("id").take(where), batch.column("text_hash").take(where),
                          *[pa.array([r[c] for r in found], pa.int64()) for c in ("start", "n", "lead", "key")],
                          pa.array(pieces, pa.binary())], _PIECE)

    return run


def _longer_prefixes(width: int, share: int, smaller: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each piece as pieces of at most `smaller` suffixes, whose prefixes share `width - smaller + 1` words."""
    shared = width - smaller + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in ("id", "text_hash", "start", "n", "lead")}
            out: list[list] = [[] for _ in range(8)]
            for row, data in enumerate(byte_rows(batch.column("data"))):
                n, lead = values["n"][row], values["lead"][row]
                starts, ends = word_bounds(data)
                sums = _sums(word_hashes(data))
                for first in range(0, share, smaller):
                    # Suffixes `first` to `first + smaller - 1` words before the old prefix string.
                    begin, end = max(0, lead - first - smaller + 1), min(n, lead - first + 1)
                    if begin >= end:
                        continue
                    place, last = lead - first, end - 1 + width
                    key, whole = hashes(sums, np.array([place, begin]), np.array([place + shared, last])).view(np.int64).tolist()
                    for column, value in zip(out, (values["id"][row], values["text_hash"][row], values["start"][row] + begin, end - begin,
                                                   place - begin, key, whole, data[starts[begin]:ends[last - 1]].tobytes())):
                        column.append(value)
            yield _table([*[pa.array(c, pa.int64()) for c in out[:7]], pa.array(out[7], pa.binary())], f"{_RUN}, data binary")

    return run


def deep_nodes(texts: list[bytes], counts: list[int], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(depth, its suffixes as (text, start)) of each internal node of depth `least` or more, children first.

    The tree holds the first `counts[i]` suffixes of text i, a string of eight-byte words.
    Its nodes are read off the sorted suffixes: a node is a stretch of neighbours that
    share more words than those around it.
    """
    suffixes = sorted((text[8 * i:], j, i) for j, text in enumerate(texts) for i in range(counts[j]))
    floor = 8 * least
    open_nodes: list[tuple[int, int]] = []
    for k in range(1, len(suffixes) + 1):
        depth = 0
        if k < len(suffixes) and suffixes[k - 1][0][:floor] == suffixes[k][0][:floor]:
            depth = _shared_words(suffixes[k - 1][0], suffixes[k][0])
        left = k - 1
        while open_nodes and open_nodes[-1][0] > depth:
            node, left = open_nodes.pop()
            yield node, [s[1:] for s in suffixes[left:k]]
        if depth >= least and (not open_nodes or open_nodes[-1][0] < depth):
            open_nodes.append((depth, left))


def _shared_words(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.int64, size // 8) != np.frombuffer(b, np.int64, size // 8))
    return int(differ[0]) if len(differ) else size // 8


def _subtrees(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeated windows of each partition; rows come sorted by their prefix."""

    def marks(names: list[tuple], texts: list[bytes], counts: list[int]) -> Iterator[tuple]:
        covered = [np.zeros(n, bool) for n in counts]
        # Children come first, so the first node of a suffix is its longest repeat.
        seen: set[tuple[int, int]] = set()
        for depth, suffixes in deep_nodes(texts, counts, width):
            for j, i in suffixes:
                if (j, i) not in seen:
                    covered[j][i:i + depth - width + 1] = True
            seen.update(suffixes)
        for (name, text_hash, start), windows in zip(names, covered):
            edges = np.flatnonzero(np.diff(np.concatenate(([False], windows, [False])).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                yield name, text_hash, start + a, b - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, texts, counts, found = None, [], {}, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "id", "text_hash", "start", "n")]
            for *row, data in zip(*columns, byte_rows(batch.column("data"))):
                if row[0] != key:
                    found.extend(marks(names, list(texts), counts))
                    key, names, texts, counts = row[0], [], {}, []
                text = word_hashes(data).astype(">u8").tobytes()
                # Rows that repeat both id and text name the same piece more than once.
                if text not in texts:
                    texts[text] = None
                    names.append((row[1], row[2], row[3]))
                    counts.append(row[4])
            if len(found) > 10_000:
                yield _table([pa.array(c, pa.int64()) for c in zip(*found)], _SPAN)
                found = []
        found.extend(marks(names, list(texts), counts))
        if found:
            yield _table([pa.array(c, pa.int64()) for c in zip(*found)], _SPAN)

    return run


def _remove(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without the words that their repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("runs")
            flat, offsets = found.flatten(), found.offsets.to_numpy()
            offsets = offsets - offsets[0]
            filled = found.is_valid().to_numpy(zero_copy_only=False)
            first, count = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for row, data in enumerate(byte_rows(batch.column("data"))):
                starts, ends = word_bounds(data)
                gone = np.zeros(len(starts), bool)
                if filled[row] and offsets[row + 1] > offsets[row]:
                    s, n = first[offsets[row]:offsets[row + 1]], count[offsets[row]:offsets[row + 1]]
                    size = len(starts) + 1
                    gone = np.cumsum(np.bincount(s, minlength=size) - np.bincount(s + n - 1 + width, minlength=size))[:-1] > 0
                # A kept word's bytes and the byte behind it, which becomes the space.
                open_at, shut_at = starts[~gone], ends[~gone] + 1
                steps = np.zeros(len(data) + 2, np.int8)
                steps[open_at] += 1
                steps[shut_at] -= 1
                padded = np.append(data, np.uint8(32))
                padded[ends] = 32
                rest = padded[np.cumsum(steps[:-1]) > 0][:-1].tobytes()
                sizes.append(len(starts))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield _table([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                          pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], _RESULT)

    return run


def _judge(runs: DataFrame, capacity: int, scratch: list[str]) -> DataFrame:
    """Runs that share their prefix, with `repeated` (as a whole), `more` (goes on) and `crowded` (needs a longer prefix)."""
    shared = stored(runs.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), scratch)
    alike = stored(skew_safe_lookup(runs, shared.select("key"), ["key"], "id", shared, "rows"), scratch)
    name = F.xxhash64(*_TEXT, "start")
    strings = stored(alike.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("first")), scratch)
    per_key = stored(strings.groupBy("key").agg(F.count(F.lit(1)).alias("strings")), scratch)
    judged = stored(skew_safe_lookup(strings, per_key, ["key"], "whole", per_key, "strings"), scratch)
    several = F.col("strings") > 1
    return stored(skew_safe_lookup(alike, judged, ["key", "whole"], "id", judged, "copies").select(
        *runs.columns, (F.col("copies") > 1).alias("repeated"),
        (several & ((F.col("copies") == 1) | (name == F.col("first")))).alias("more"), (F.col("strings") > capacity).alias("crowded"),
    ), scratch)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per text under a name without nulls: its id (0 for none) and the hash of its text and of whether there is an id."""
    text, name = F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.col(id_col).cast("long")
    return docs.select(name.alias("doc_id"), F.coalesce(name, F.lit(0)).alias("id"), F.xxhash64(text, name.isNull()).alias("text_hash"),
                       text.alias("data"))


def repeated_windows(texts: DataFrame, width: int, anchor: int, capacity: int, scratch: list[str]) -> DataFrame:
    """(id, text_hash, start, n): stretches of window starts whose words occur more than once."""
    judged = _judge(texts.mapInArrow(_anchored(width, anchor), _RUN), capacity, scratch)
    found = [judged.where("repeated").select(*_TEXT, "start", "n")]
    left = judged.where("more").groupBy(*_TEXT).agg(F.collect_set(F.struct("start", "n", "lead", "key", "crowded")).alias("runs"))
    match = texts.select(*_TEXT, "data").join(left, _TEXT).dropDuplicates(_TEXT)
    # Pieces of crowded partitions are kept apart; runs name the partition they belong to.
    cut = {}
    for crowded in (False, True):
        runs = F.filter("runs", lambda r: r["crowded"] == F.lit(crowded))
        cut[crowded] = match.select(*_TEXT, "data", runs.alias("runs")).where(F.size("runs") > 0)
    share, pieces = width - anchor + 1, stored(cut[False].mapInArrow(_cut(width), _PIECE), scratch)
    crowd = stored(cut[True].mapInArrow(_cut(width), _PIECE), scratch)
    while True:
        grouped = pieces.repartition("key").sortWithinPartitions("key")
        found.append(stored(grouped.mapInArrow(_subtrees(width), _SPAN), scratch))
        if share == 1 or crowd.isEmpty():
            break
        smaller = share // 2 if share > 3 else 1
        parts = crowd.mapInArrow(_longer_prefixes(width, share, smaller), f"{_RUN}, data binary")
        judged, share = _judge(parts, capacity, scratch), smaller
        found.append(judged.where("repeated").select(*_TEXT, "start", "n"))
        names = [c.split()[0] for c in _PIECE.split(", ")]
        pieces, crowd = judged.where("more AND NOT crowded").select(names), judged.where("more AND crowded").select(names)
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every text without the words covered by a `width`-word string that also starts anywhere else.

    Returns (doc_id, n_words, n_removed, n_spans, kept_sha256, kept), one row per input
    row; `kept` is the remaining words joined by one space. Words end at the six ASCII
    blanks and are compared as they are, by 64-bit hashes. Windows are judged on the
    input, overlaps within one text count, matches never cross rows. A null text has no
    words; a text of fewer than `width` words loses none. A repeated row is a copy like
    any other, whether or not its id is the same or null. Other columns are ignored, an
    empty table gives an empty one. Intermediate tables lie in the shared checkpoint
    folder; the one that the result reads stays there.
    """
    if not 0 < anchor < width:
        raise ValueError("the anchor must be shorter than the window")
    texts = _rows(docs, id_col, text_col)
    scratch: list[str] = []
    runs = repeated_windows(texts, width, anchor, capacity, scratch)
    per_text = stored(runs.groupBy(*_TEXT).agg(F.collect_set(F.struct("start", "n")).alias("runs")), [])
    discard(docs.sparkSession, scratch)
    return texts.join(per_text, _TEXT, "left").select("doc_id", "data", "runs").mapInArrow(_remove(width), _RESULT)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
s AS (
  SELECT r, i, word, n >= i + {WIDTH - 1} AS whole,
         string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS win
  FROM w),
m AS (SELECT r, i, word, whole AND count(*) OVER (PARTITION BY whole, win) > 1 AS again FROM s),
c AS (
  SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM m),
k AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM c GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
