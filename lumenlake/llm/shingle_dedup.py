"""Near-duplicates by word shingles: SimHash, and an exact set join for the pairs that its few bits miss.

Texts whose SimHash fingerprints differ in `simhash.BITS` or fewer bits are linked by the trie
join of `simhash.py`; fingerprints count a shingle as often as it occurs. That finds
texts that are nearly the same. A similarity of 0.8 most often leaves 4 to 14 of 64 bits
apart, so an exact join of the sets of shingles on their rarest ones follows, among documents that
share a min-hash band. There a text takes part if it agrees with any other on all
`ROWS` minima of one of `BANDS` bands; at a similarity of 0.8 a pair escapes with
probability (1 - 0.8^4)^32, less than 5 in 100 million. Bands form no pairs. Pairs come from
an index of each text's rarest shingles: two sets of similarity s share one of the first
n - ceil(s n) + 1 shingles of each in any common order, and an order by frequency keeps
text that many documents share out of the index. Texts with the same set of shingles are
one node, so copies make no pairs; in `STAR_ROUNDS` rounds the members of an index entry
meet only one of them, which makes large groups one, and then those still apart meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import byte_rows, discard, stored
from lumenlake.llm.components import components
from lumenlake.llm.simhash import SEED, fingerprint_of, kept_rows, links, shingle_hashes
from lumenlake.operators.ordering import skew_safe_lookup

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
STAR_ROUNDS = 2
# Shingles are counted in so many classes by hash; the table of counts goes to every task.
CLASSES = 1 << 18
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes, size: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of a text's `size`-word shingles; of all its words if it has fewer."""
    return np.unique(shingle_hashes(data, size))


def set_key(shingles: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A hash of the minima of each band; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for first in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, (shingles[first:first + (1 << 12), None] * _MIX).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX[0]
        keys ^= keys >> np.uint64(29)
    return keys


def _signed(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("data"))


def _signatures(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, key, print, n, bands) of each whole text; `print` is its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, counts, bands = [], [], [], []
            for data in byte_rows(batch.column("data")):
                hashes = shingle_hashes(data.tobytes(), size)
                shingles = np.unique(hashes)
                prints.append(fingerprint_of(hashes))
                keys.append(set_key(shingles))
                counts.append(len(shingles))
                bands.append(band_keys(shingles))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.int64()),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(counts, pa.int64()), _signed(bands)],
                names=["doc_id", "text_hash", "key", "print", "n", "bands"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, key long, print long, n long, bands array<long>")


def _print_links(known: DataFrame, scratch: list[str]) -> DataFrame:
    """(a, b): links that join the keys of `known` (key, print) exactly as all pairs of near fingerprints do."""
    prints = stored(known.select("print").distinct(), scratch)
    roots = components(links(prints, scratch), "a", "b")
    named = stored(prints.join(roots, prints["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root")), scratch)
    members = stored(known.select("key", "print").distinct().join(named, "print").select("key", "root").distinct(), scratch)
    # One key of each group of fingerprints stands for it; the others are linked to that one.
    hubs = stored(members.groupBy("root").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), scratch)
    joined = skew_safe_lookup(members, hubs.select("root", "hub"), ["root"], "key", hubs, "rows")
    return stored(joined.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")), scratch)


def _shingles(rows: DataFrame, size: int) -> DataFrame:
    """(key, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(d.tobytes(), size) for d in byte_rows(batch.column("data"))]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), _signed(sets)], names=["key", "shingles"])

    return rows.mapInArrow(run, "key long, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    pairs = stored(pairs, scratch)
    for side in "ab":
        sizes = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("rows"))
        pairs = skew_safe_lookup(pairs, sets.select(F.col("key").alias(side), F.col("shingles").alias(f"set_{side}")), [side],
                                 "b" if side == "a" else "a", sizes, "rows")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return stored(pairs.where(both >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), scratch)


def _rare(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, n, shingle, place): the rarest shingles of each set, as many as any similar set must share one of."""
    spark = sets.sparkSession
    classes = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(CLASSES - 1)).alias("class")).count()
    # Never more than `CLASSES` rows, whatever the input.
    counts = np.zeros(CLASSES, np.int64)
    for row in classes.toLocalIterator():
        counts[row["class"]] = row["count"]
    table = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("shingles")
            flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            rows, found, places = [], [], []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                shingles = flat[a:b]
                size = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1 if len(shingles) else 0
                order = np.lexsort((shingles, table.value[shingles & (CLASSES - 1)]))[:size]
                rows.append(np.full(size, row))
                found.append(shingles[order])
                places.append(np.arange(size))
            if rows:
                where = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(where), pa.array(np.diff(offsets).astype(np.int64)).take(where), pa.array(np.concatenate(found)),
                     pa.array(np.concatenate(places).astype(np.int64))], names=["key", "n", "shingle", "place"])

    return sets.select("key", "shingles").mapInArrow(run, "key long, n long, shingle long, place long")


def _can_reach(similarity: float) -> Column:
    """Whether two sets that first share a shingle at these places of the common order can be similar."""
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return F.lit(1 + similarity) * left >= F.lit(similarity) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-6)


def _edges(sets: DataFrame, similarity: float, scratch: list[str]) -> DataFrame:
    """(a, b): links that join the nodes of `sets` (key, shingles) exactly as all similar pairs among them do."""
    rare = stored(_rare(sets, similarity), scratch)
    shared = stored(rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), scratch)
    index = skew_safe_lookup(rare, shared.select("shingle"), ["shingle"], "key", shared, "rows")
    nodes = stored(index.groupBy("key").agg(F.any_value("n").alias("n"), F.collect_list(F.struct("shingle", "place")).alias("rare")), scratch)
    edges, labels, tested = None, None, None
    for step in range(STAR_ROUNDS + 1):
        named = nodes.withColumn("label", F.col("key")) if labels is None else nodes.join(
            labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("root", "key"))
        rows = stored(named.select("key", "n", "label", F.inline("rare")), scratch)
        # The member that meets the others of its entry is the same one in all their entries, and another one each round.
        member = F.struct(F.xxhash64("key", F.lit(step)).alias("order"), "key", "n", "place", "label")
        entries = stored(rows.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(member).alias("one"),
        ).where("low <> high"), scratch)
        open_rows = skew_safe_lookup(rows, entries.select("shingle", "one"), ["shingle"], "key", entries, "rows")
        if step < STAR_ROUNDS:
            pairs = open_rows.where("label <> one.label").select(
                F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"),
                F.col("one.key").alias("b"), F.col("one.n").alias("n_b"), F.col("one.place").alias("place_b"))
        else:
            open_rows = stored(open_rows.drop("one"), scratch)
            # Groups of an entry meet group by group, so members of one group never meet each other.
            groups = open_rows.select("shingle", "label").distinct()
            both = groups.select("shingle", F.col("label").alias("label_a")).join(
                groups.select("shingle", F.col("label").alias("label_b")), "shingle").where("label_a < label_b")
            sides = [open_rows.select("shingle", F.col("label").alias(f"label_{x}"), F.col("key").alias(x), F.col("n").alias(f"n_{x}"),
                                      F.col("place").alias(f"place_{x}")) for x in "ab"]
            pairs = both.join(sides[0], ["shingle", "label_a"]).join(sides[1], ["shingle", "label_b"])
        pairs = pairs.where(_can_reach(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, scratch)
        found = _similar(pairs, sets, similarity, scratch)
        edges = found if edges is None else edges.unionByName(found)
        if step < STAR_ROUNDS:
            tested = pairs if tested is None else tested.unionByName(pairs)
            labels = stored(components(edges, "a", "b"), scratch)
    return edges


def keep_one(
    docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs`, all columns, of which one document of each group of near-duplicates stays: the one with the smallest id.

    Two documents are linked if the SimHash fingerprints of their `size`-word shingles differ
    in `simhash.BITS` or fewer bits, or if the sets of these shingles have a Jaccard
    similarity of `similarity` or more; links chain. A-Z are lower-cased, words end at
    ASCII blanks, texts without a word are alike. Null ids stay only where a group has no
    other. Of rows that repeat both id and text one stays. Candidates of the sets come from bands
    made for similarities of 0.8 and more; lower ones escape more often.
    """
    scratch: list[str] = []
    known = stored(_signatures(_rows(docs, id_col, text_col), size), scratch)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    # Copies share a set and are linked once for all of them.
    nodes = stored(known.groupBy("key").agg(least.alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), scratch)
    members = nodes.select("key", F.explode("bands").alias("band"))
    shared = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), scratch)
    alike = skew_safe_lookup(members, shared.select("band"), ["band"], "key", shared, "rows").select("key").distinct()
    likely = stored(alike.join(nodes, "key").select("first.doc_id", "first.text_hash").distinct(), scratch)
    rows = _rows(docs, id_col, text_col).alias("r").join(
        likely.alias("l"), F.expr("r.doc_id <=> l.doc_id AND r.text_hash = l.text_hash"), "left_semi")
    sets = stored(_shingles(rows, size).dropDuplicates(["key"]), scratch)
    roots = components(_print_links(known, scratch).unionByName(_edges(sets, similarity, scratch)), "a", "b")
    named = nodes.join(roots, nodes["key"] == roots["node"], "left").select(F.coalesce("root", "key").alias("root"), "first")
    first = stored(named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash"), [])
    discard(docs.sparkSession, scratch)
    return kept_rows(docs, first, id_col, text_col)
