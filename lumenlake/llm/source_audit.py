"""How far the sources of a language differ in their use of terms, with late string materialisation.

Terms become fixed-width digests where the text is read. One pass writes a table with
two kinds of rows: counts (language, source, digest, occurrences, documents), and for
each distinct term of a task one row with its digest and text. Counting then reads and
shuffles digests and numbers only, once, by digest. Terms take part in two places:
  * the smallest and largest term of each digest: where they differ, two terms share a
    digest, and its counts are split by the term that the digest stands for in each task;
  * the rows that are returned get their term at the very end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import byte_rows, discard, stored
from lumenlake.llm.window_hash import hashes, mix, powers, prefix_sums

MIN_DOCS = 30
TOP_TERMS = 50
# Bytes of text handled at once, distinct rows that a task gathers before it hands them on, cells of one dense block.
CHUNK = 1 << 19
GATHERED = 3 << 18
CELLS = 1 << 16
# A block has so many terms on average at least, however many sources there are.
TERMS = 16

_COUNTS = "part long, lang string, source string, digest long, count long, docs long, term string"
_PAIRS = "lang string, a string, b string, value long"
_TERM = ["lang", "digest", "text"]
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
# Letters of ASCII and every byte of a character beyond it.
_IN_TERM = (((_SMALL >= 97) & (_SMALL <= 122)) | (np.arange(256) >= 128))
_SECOND = np.random.default_rng(20240311).integers(1, 1 << 63, 256, dtype=np.uint64)


def _second_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash that does not hang on the first one."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SECOND[data] * powers(len(data), -1), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(sums), 1)[starts])


def _edges(*columns: np.ndarray) -> np.ndarray:
    """First place of each stretch of equal rows."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string column."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def _chunk_counts(texts: list[np.ndarray], groups: list[int], mask: np.uint64) -> tuple:
    """(group, digest, second hash, occurrences, documents, term) of each distinct term of each group."""
    data = _SMALL[np.concatenate(texts)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    digest, second = hashes(prefix_sums(data), starts, ends) & mask, _second_hash(data, starts, ends)
    order = np.lexsort((second, digest))  # stable: rows stay in order
    digest, second, row = digest[order], second[order], row[order]
    at = _edges(digest, second, row)
    times = np.diff(np.append(at, len(order)))
    group, digest, second, order = np.asarray(groups)[row[at]], digest[at], second[at], order[at]
    by = np.lexsort((second, digest, group))
    at = _edges(group[by], digest[by], second[by])
    first = by[at]
    where = order[first]
    return (group[first], digest[first], second[first], np.add.reduceat(times[by], at) if len(at) else times[:0],
            np.diff(np.append(at, len(by))), _slices(data, starts[where], ends[where]))


def _merge(parts: list[tuple]) -> tuple:
    group, digest, second, count, docs = (np.concatenate([p[i] for p in parts]) for i in range(5))
    terms = pa.concat_arrays([p[5] for p in parts])
    by = np.lexsort((second, digest, group))
    at = _edges(group[by], digest[by], second[by])
    first = by[at]
    return (group[first], digest[first], second[first], np.add.reduceat(count[by], at) if len(at) else count,
            np.add.reduceat(docs[by], at) if len(at) else docs, terms.take(pa.array(first)))


def _batches(part: int, columns: list, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows of the counted table, in small batches."""
    table = pa.Table.from_arrays([pa.array(np.full(len(columns[0]), part)), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]],
                                 names=[c.split()[0] for c in _COUNTS.split(", ")])
    yield from table.to_batches(max_chunksize=rows)


def _count(bits: int, chunk: int, gathered: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of each task's terms by language and source; `bits` of the digest are used."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        done: list[tuple] = []
        parts = [0]

        def out() -> Iterator[pa.RecordBatch]:
            group, digest, second, count, docs, terms = _merge(done)
            names = list(numbers)
            by = np.lexsort((second, digest))
            word = by[_edges(digest[by], second[by])]
            # Digests that stand for several terms here; their counts carry the term at once.
            several = digest[word][1:][digest[word][1:] == digest[word][:-1]]
            own = pc.if_else(pa.array(np.isin(digest, several)), terms, pa.scalar(None, pa.string()))
            part = (TaskContext.get().partitionId() << 32) + parts[0]
            parts[0] += 1
            blank = pa.nulls(len(word))
            yield from _batches(part, [*(pa.array([n[i] for n in names], pa.string()).take(pa.array(group)) for i in (0, 1)),
                                digest.view(np.int64), count.astype(np.int64), docs.astype(np.int64), own])
            yield from _batches(part, [blank.cast(pa.string()), blank.cast(pa.string()), digest[word].view(np.int64), blank.cast(pa.int64()),
                                blank.cast(pa.int64()), terms.take(pa.array(word))])

        for batch in batches:
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            texts, groups, size = [], [], 0
            for row, data in enumerate(byte_rows(batch.column("data"))):
                texts.append(data)
                groups.append(numbers.setdefault(names[row], len(numbers)))
                size += len(data)
                if size >= chunk or row == len(names) - 1:
                    done.append(_chunk_counts(texts, groups, mask))
                    texts, groups, size = [], [], 0
                    if sum(len(d[0]) for d in done) > gathered:
                        done = [_merge(done)]
                        if 4 * len(done[0][0]) > 3 * gathered:
                            yield from out()
                            done, numbers = [], {}
        if done:
            yield from out()

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of each block, for each pair of sources; rows come sorted by block, a source's base value first."""

    def block(lang: str, parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        kind, digest, text, source, p = (np.concatenate([x[c] for x in parts]) for c in ("kind", "digest", "text", "source", "p"))
        base = kind == 0
        names, cells = source[base], ~base
        place = np.searchsorted(names, source[cells])
        term = np.zeros(int(cells.sum()), np.int64)
        at = _edges(digest[cells], text[cells])
        term[at[1:]] = 1
        values = np.repeat(p[base][:, None], len(at), axis=1)
        values[place, np.cumsum(term)] = p[cells]
        for i in range(len(names) - 1):
            sums = np.abs(values[i + 1:] - values[i]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(sums), pa.string()), pa.array([names[i]] * len(sums), pa.string()),
                 pa.array(names[i + 1:].tolist(), pa.string()), pa.array(sums, pa.int64())], names=["lang", "a", "b", "value"])

    now, parts = None, []
    for batch in batches:
        lang, number = np.array(batch.column("lang").to_pylist(), object), batch.column("block").to_numpy()
        columns = {c: np.array(batch.column(c).to_pylist(), object) if c in ("source", "text") else batch.column(c).to_numpy()
                   for c in ("kind", "digest", "text", "source", "p")}
        at = _edges(number, lang).tolist() if len(number) else []
        for a, b in zip(at, [*at[1:], len(number)]):
            if (lang[a], number[a]) != now:
                if parts:
                    yield from block(now[0], parts)
                now, parts = (lang[a], number[a]), []
            parts.append({c: v[a:b] for c, v in columns.items()})
    if parts:
        yield from block(now[0], parts)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (count + 5) / (total + 5 * terms)), exact."""
    wide = "decimal(20,0)"
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast(wide)
    return F.lit(1) + F.call_function("div", top, (total + 5 * terms).cast(wide))


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, bits: int = 64, chunk: int = CHUNK, gathered: int = GATHERED,
    cells_per_block: int = CELLS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources and the terms a source overuses.

    A term is a run of ASCII letters, of which A-Z are lower-cased, and characters beyond
    ASCII. A language keeps the terms of at least `min_docs` of its rows. Part `pair` has
    each other source of the language with the sum of |p - q| over all kept terms, part
    `term` the `top_terms` kept terms whose share lies highest above that of the language;
    shares are 1 + floor(10^9 (count + 5) / (total + 5 kept terms)), in whole numbers.
    Null text, language and source count as ''; rows that repeat count again; other columns
    are ignored; an empty table gives an empty result. `bits` shortens the digests, which
    only makes more of them collide. A block holds the terms of a language by hash, as many
    as fit into about `cells_per_block` numbers; its pairs are summed there, so no pair is
    made per term. The tables that the result reads stay in the shared checkpoint folder.
    """
    spark, scratch = docs.sparkSession, []
    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    table = stored(named.mapInArrow(_count(bits, chunk, gathered), _COUNTS), scratch)
    counts = table.where("count IS NOT NULL")
    words = table.where("count IS NULL").select("part", "digest", F.col("term").alias("word"))
    spread = words.select("digest", "word").groupBy("digest").agg(F.min("word").alias("least"), F.max("word").alias("most"))
    mixed = stored(spread.where("least <> most").select("digest"), kept_tables := [])
    split = counts.join(mixed, "digest", "left_semi").join(words.join(mixed, "digest", "left_semi"), ["part", "digest"]).where(
        "term IS NULL OR term = word").withColumn("text", F.col("word"))
    plain = counts.join(mixed, "digest", "left_anti").withColumn("text", F.lit(""))
    numbers = ["lang", "source", "digest", "text", "count", "docs"]
    term = Window.partitionBy(*_TERM)
    # Everything below that needs a term's rows together finds them together: one shuffle, by digest.
    cells = stored(
        plain.select(numbers).unionByName(split.select(numbers)).repartition("digest")
        .groupBy("lang", "source", "digest", "text").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        .withColumns({"in_docs": F.sum("docs").over(term), "total": F.sum("count").over(term),
                      "first": F.row_number().over(term.orderBy("source")) == 1})
        .where(F.col("in_docs") >= min_docs).select("lang", "source", "digest", "text", "count", "total", "first"), kept_tables)
    one = F.col("first")
    per_lang = cells.groupBy("lang").agg(F.sum(one.cast("long")).alias("v"), F.sum(F.when(one, F.col("total"))).alias("all"))
    groups = named.select("lang", "source").distinct()
    none = {"n": 0, "v": 0, "all": 0}
    stats = stored(
        groups.join(cells.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(per_lang, "lang", "left")
        .fillna(none).join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang"), kept_tables)
    shares = cells.join(stats, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))

    full = F.call_function("div", F.col("v") * F.col("sources"), F.lit(cells_per_block))
    blocks = F.lit(1) + F.least(full, F.call_function("div", F.col("v"), F.lit(TERMS)))
    in_block = shares.select("lang", F.pmod(F.xxhash64("digest", "text"), blocks).alias("block"), F.lit(1).alias("kind"), "digest", "text", "source", "p")
    base = stats.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("digest"),
        F.lit("").alias("text"), "source", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1)).alias("p"))
    sorted_blocks = in_block.unionByName(base).repartition("lang", "block").sortWithinPartitions("lang", "block", "kind", "digest", "text", "source")
    pairs = sorted_blocks.mapInArrow(_distances, _PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    group, order = Window.partitionBy("lang", "source"), [F.col("value").desc(), F.col("item").asc()]
    pair = pairs.select("lang", F.inline(both), "value").withColumn("rank", F.row_number().over(group.orderBy(*order)))

    q = _share(F.col("total"), F.col("all"), F.col("v"))
    over = shares.select("lang", "source", "digest", "text", (F.col("p") - q).alias("value")).where("value > 0")
    # Ties with the last value stay until their terms are known.
    first = stored(over.withColumn("rank", F.rank().over(group.orderBy(F.col("value").desc()))).where(F.col("rank") <= top_terms), kept_tables)
    wanted = first.where("text = ''").select("digest").distinct()
    names = words.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("word").alias("word"))
    item = F.when(F.col("text") == "", F.col("word")).otherwise(F.col("text"))
    top = (first.join(names, "digest", "left").select("lang", "source", item.alias("item"), "value")
           .withColumn("rank", F.row_number().over(group.orderBy(*order))).where(F.col("rank") <= top_terms))
    top = stored(top, kept_tables)

    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = pair.withColumn("part", F.lit("pair")).select(columns).unionByName(top.withColumn("part", F.lit("term")).select(columns))
    discard(spark, scratch)
    return out


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN o USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, total, l.n AS all_n, v,
         1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (gn.n + 5 * v) AS p
  FROM gn JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN o USING (lang, source, term)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0) AS value
  FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
terms AS (
  SELECT lang, source, term AS item, p - (1 + (1000000000::HUGEINT * (total + 5)) // (all_n + 5 * v)) AS value FROM p WHERE c > 0),
u AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms WHERE value > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM n WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
