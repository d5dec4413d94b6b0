"""SimHash near-duplicates: fingerprints linked by a self-join of their binary trie.

Two nodes of the trie are walked together, starting with the root and itself. Going
down a level, children on different bits add one to the pair's differing bits, and
a pair beyond the budget is dropped with everything below it. To spread the walk
over tasks, the 64 bits are cut into `BITS + 1` blocks: two linked fingerprints agree
on at least one block, so each fingerprint goes to the group of each of its block
values. A group that is still too large is cut the same way on the bits left over,
again and again, which loses no pair; groups never exceed `GROUP` fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import byte_rows, discard, stored
from lumenlake.llm.components import components

WORDS = 3
BITS = 3
SEED = 42
# Fingerprints of a group that one task compares; a group has at most GROUP^2 / 2 pairs.
GROUP = 2048
# Pairs that the groups walked at once may have.
PAIRS = 4_000_000
_BLOCKS = BITS + 1


def shingle_hashes(data: bytes, size: int = WORDS) -> np.ndarray:
    """Hashes of a text's `size`-word shingles, of all its words if it has fewer. A-Z are lower-cased, words end at ASCII blanks."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64)


def fingerprint(data: bytes, size: int = WORDS) -> int:
    """SimHash of a text's `size`-word shingles; 0 without a word."""
    return fingerprint_of(shingle_hashes(data, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of shingles by their hashes, repeats included."""
    hashes = hashes.astype(">u8")
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[first:first + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, print): the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(d.tobytes()) for d in byte_rows(batch.column("data"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))],
                names=["doc_id", "text_hash", "print"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("data")).mapInArrow(
        run, "doc_id long, text_hash long, print long")


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of values of the same group that differ in at most `budget` bits.

    `values` are unsigned and ascending within each group [start, end), so a trie node
    is a range and its children are split by a count of zero bits.
    """
    found_i, found_j = [], []
    left = (starts.copy(), ends.copy())
    right = (starts.copy(), ends.copy())
    errors = np.zeros(len(starts), np.int64)
    for bit in range(63, -1, -1):
        if not len(errors):
            break
        zeros = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1) == 0)))
        same = left[0] == right[0]
        mid_l = left[0] + zeros[left[1]] - zeros[left[0]]
        mid_r = right[0] + zeros[right[1]] - zeros[right[0]]
        parts = []
        for bit_l in (0, 1):
            for bit_r in (0, 1):
                l0, l1 = (left[0], mid_l) if bit_l == 0 else (mid_l, left[1])
                r0, r1 = (right[0], mid_r) if bit_r == 0 else (mid_r, right[1])
                e = errors + (bit_l != bit_r)
                ok = (l0 < l1) & (r0 < r1) & (e <= budget)
                if (bit_l, bit_r) == (1, 0):
                    ok &= ~same
                if bit_l == bit_r:
                    ok &= ~(same & (l1 - l0 < 2))
                parts.append((l0[ok], l1[ok], r0[ok], r1[ok], e[ok]))
        l0, l1, r0, r1, errors = (np.concatenate(x) for x in zip(*parts))
        # Two leaves: their bits are compared at once.
        leaf = (l1 - l0 == 1) & (r1 - r0 == 1)
        i, j = l0[leaf], r0[leaf]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        found_i.append(i[near])
        found_j.append(j[near])
        left, right, errors = (l0[~leaf], l1[~leaf]), (r0[~leaf], r1[~leaf]), errors[~leaf]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over pairs (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each fingerprint to the smallest one it reaches within its group; rows come sorted by group."""
    paths, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

    def walk(paths: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], paths[1:] != paths[:-1])))
        ends = np.concatenate((starts[1:], [len(paths)]))
        several = ends - starts > 1
        starts, ends = starts[several], ends[several]
        load = np.cumsum((ends - starts) ** 2) // PAIRS
        for part in np.unique(load):
            s, e = starts[load == part], ends[load == part]
            values = prints[s[0]:e[-1]]
            i, j = trie_pairs(values, s - s[0], e - s[0])
            root = local_roots(len(values), i, j)
            hung = np.flatnonzero(root != np.arange(len(values)))
            if len(hung):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[hung].view(np.int64)), pa.array(values[root[hung]].view(np.int64))], names=["a", "b"])

    for batch in batches:
        paths = np.concatenate((paths, batch.column("path").to_numpy()))
        prints = np.concatenate((prints, batch.column("print").to_numpy().view(np.uint64)))
        if len(paths) >= 100_000:
            done = int(np.flatnonzero(paths != paths[-1])[-1]) + 1 if paths[0] != paths[-1] else 0
            if done:
                yield from walk(paths[:done], prints[:done])
                paths, prints = paths[done:], prints[done:]
    if len(paths):
        yield from walk(paths, prints)


def _cut(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Each row once per block of its `width` bits left over: a path that also names the block's value, and the rest."""
    block = width // _BLOCKS
    rest, b = F.col("rest"), F.col("block")

    def bits(value: Column, low: int, count: int) -> Column:
        return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << count) - 1)) if count < 64 else value

    cut = []
    for k in range(_BLOCKS):
        low, size = k * block, block if k < _BLOCKS - 1 else width - k * block
        lower = rest.bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("long")
        upper = F.shiftleft(F.shiftrightunsigned(rest, low + size), low) if low + size < width else F.lit(0).cast("long")
        cut.append(F.struct(F.xxhash64("path", F.lit(width), F.lit(k), bits(rest, low, size)).alias("path"),
                            upper.bitwiseOR(lower).alias("rest")))
    exploded = rows.select("print", F.explode(F.array(*cut)).alias("cut"))
    return exploded.select("print", "cut.path", "cut.rest"), width - block


def links(prints: DataFrame, scratch: list[str]) -> DataFrame:
    """(a, b): a forest of links that joins distinct fingerprints exactly as all pairs within `BITS` bits do."""
    groups, width = _cut(prints.select("print", F.lit(0).cast("long").alias("path"), F.col("print").alias("rest")), 64)
    found = []
    while True:
        # A crowded group is one that counting finds; there is at most one per GROUP rows.
        crowded = stored(groups.groupBy("path").count().where(F.col("count") > GROUP).select("path"), scratch)
        more = crowded.limit(1).count() > 0
        here = groups.join(crowded, "path", "left_anti") if more else groups
        sorted_rows = here.select("path", "print").repartition("path").sortWithinPartitions(
            "path", F.shiftrightunsigned("print", 1), "print")
        found.append(sorted_rows.mapInArrow(_star_links, "a long, b long"))
        if not more:
            break
        groups, width = _cut(groups.join(crowded, "path", "left_semi"), width)
        groups = stored(groups, scratch)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, print, component): components are named by their smallest (doc_id, text_hash)."""
    scratch: list[str] = []
    known = stored(fingerprints(docs, id_col, text_col), [])
    # Copies share a fingerprint and are linked once for all of them.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    distinct = stored(known.groupBy("print").agg(least.alias("first")), scratch)
    roots = components(links(distinct, scratch), "a", "b")
    named = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first")
    of_root = named.groupBy("root").agg(F.min("first").alias("component"))
    labels = stored(named.join(of_root, "root").select("print", "component"), [])
    discard(docs.sparkSession, scratch)
    return known.join(labels, "print")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints chain by `BITS` or fewer differing bits.

    `component_id` is the smallest doc_id reached, itself included. A null or blank text
    has fingerprint zero and is linked like any other. Null ids never name a component
    unless it has no other; repeated rows fall together; other columns are ignored;
    an empty table gives an empty result. Rows of a group of copies are never gathered.
    """
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0")
    return _labelled(docs, id_col, text_col).select("doc_id", hexed.alias("fingerprint"), F.col("component.doc_id").alias("component_id"))


def kept_rows(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs`, all columns, that `first` (doc_id, text_hash) names; of rows that repeat both id and text one stays."""
    # Keys without nulls: the join and the choice of one row then share one shuffle of the texts.
    keys = ["id", "no_id", "text_hash"]
    names = first.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_hash").distinct()
    name = F.col(id_col).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(name, F.lit(0)).alias("id"), name.isNull().alias("no_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_hash"))
    kept = rows.join(names, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which one document of each component stays: the one that names it.

    Of rows that repeat both id and text one stays.
    """
    first = _labelled(docs, id_col, text_col).where(
        F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("text_hash") == F.col("component.text_hash")))
    return kept_rows(docs, first, id_col, text_col)
