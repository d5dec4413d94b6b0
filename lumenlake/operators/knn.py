"""Exact batch nearest-neighbour search by cosine.

Identical vectors are searched once, for all their copies. Distinct vectors are
dealt to blocks of queries. A task keeps the best candidates of one block so far
while all vectors of the model pass through it, those of its own block first, so
every list is final where it is made and only vectors are shuffled: as many copies
of them as there are blocks, whose number follows the cores until blocks are full.
Large models are ordered by nearest pivot and angle to it; the triangle inequality
on angles then spares queries that a step of candidates cannot reach, and no
neighbour is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.operators.ordering import skew_safe_lookup
from lumenlake.session import cut_lineage

# Similarities are compared at this many decimals, so that last-bit noise of
# the matrix product never decides a tie; ties go to the smaller id.
SIM_DECIMALS = 12
_MATRIX_ROWS = 1024
# Candidates compared at once.
_STEP_ROWS = 4096
# A block holds at most this many vector components, and as many hits.
_BLOCK_ENTRIES = 1 << 23
# Smaller blocks cost more in copies than they win in tasks.
_LEAST_BLOCK = 128
# Slack for rounded similarities and for arccos near 1, in cosine and in angle.
_COS_SLACK, _ANGLE_SLACK = 1e-11, 1e-7
# What passes through a block: its queries, the candidates that lie in it, all others.
_QUERY, _OWN, _OTHER = 0, 1, 2
_LISTS = "model string, digest string, rep long, repeated boolean, ids array<long>, sims array<double>"


@dataclass(frozen=True)
class KnnLayout:
    """Physical bounds of the search.

    block_rows: most queries of a block; one task holds their hits.
    max_pivots: most pivots per model; the driver holds pivots only.
    rings: angle classes around each pivot.
    prune_from_blocks: models of fewer steps of candidates do without pivots.
    """

    block_rows: int = 32_768
    max_pivots: int = 256
    rings: int = 32
    prune_from_blocks: int = 32

    @property
    def step_rows(self) -> int:
        return min(self.block_rows, _STEP_ROWS)


def encode_vectors(dtype: str, keep_zero: bool = False):
    """Arrow batches of (id, model, vector) to raw bytes; null and non-finite vectors are left out, zero ones unless kept."""
    np_type = np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            keep = np.zeros(batch.num_rows, dtype=bool)
            raw: list[bytes | None] = [None] * batch.num_rows
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np_type, copy=False)
            start = 0
            for i, n in enumerate(vectors.value_lengths().to_pylist()):
                if n:
                    v = flat[start : start + n]
                    keep[i] = bool(np.isfinite(v).all() and (keep_zero or v.any()))
                    raw[i] = v.tobytes()
                    start += n
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["id", "model", "raw"]
            )
            yield out.filter(pa.array(keep))

    return run


def _unit(raw: pd.Series | list[bytes], dtype: str) -> np.ndarray:
    """Unit rows in double precision from the encoded vectors."""
    m = np.frombuffer(b"".join(raw), dtype=dtype).astype(np.float64).reshape(len(raw), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class _Hits:
    """The best `limit` candidates so far of a few queries, by (sim desc, id)."""

    def __init__(self, unit: np.ndarray, limit: int):
        self.unit, self.limit = unit, limit
        self.floor = np.full(len(unit), -2.0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def offer(self, rows: np.ndarray, cands: np.ndarray, first: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        """Candidates with their ids, those of one from starts[i] to starts[i + 1], for the queries `rows`."""
        if len(rows) == len(self.unit):
            sims = self.unit @ cands.T
        else:
            sims = self.unit[rows] @ cands.T
        floor = self.floor[rows]
        if sims.shape[1] > self.limit:
            # Queries without `limit` hits so far get their floor from these candidates alone.
            new = np.flatnonzero(floor == -2.0)
            if len(new):
                at = sims.shape[1] - self.limit
                floor[new] = np.round(np.partition(sims[new], at, axis=1)[:, at], SIM_DECIMALS)
        row, col = np.nonzero(sims >= floor[:, None] - _COS_SLACK)
        sim = np.round(sims[row, col], SIM_DECIMALS)
        keep = sim >= floor[row]
        row, col, sim = rows[row[keep]], col[keep], sim[keep]
        if len(ids) > len(first):
            # A candidate is out if nearer ones already have `limit` ids; the others get theirs.
            copies = np.diff(starts)
            order = np.lexsort((-sim, row))
            row, col, sim = row[order], col[order], sim[order]
            if len(row):
                new_row = np.concatenate(([True], row[1:] != row[:-1]))
                new_sim = new_row | np.concatenate(([True], sim[1:] != sim[:-1]))
                before = np.cumsum(copies[col]) - copies[col]
                before = before[new_sim][np.cumsum(new_sim) - 1] - before[new_row][np.cumsum(new_row) - 1]
                inside = before < self.limit
                row, col, sim = row[inside], col[inside], sim[inside]
                n = copies[col]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit_ids = ids[np.repeat(starts[col], n) + place]
                row, sim = np.repeat(row, n), np.repeat(sim, n)
            else:
                hit_ids = first[col]
        else:
            hit_ids = first[col]
        if len(row):
            self.parts.append((row, hit_ids, sim))
            self.pending += len(row)
            if self.pending >= len(self.unit) * self.limit:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hits per query, their ids, their similarities) in the order of queries and ranks; later candidates must reach the last."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        row, ids, sim = (np.concatenate(x) for x in zip(none, *self.parts))
        order = np.lexsort((ids, -sim, row))
        row, ids, sim = row[order], ids[order], sim[order]
        n = np.bincount(row, minlength=len(self.unit))
        keep = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < self.limit
        row, ids, sim = row[keep], ids[keep], sim[keep]
        n = np.minimum(n, self.limit)
        full = n == self.limit
        self.floor[full] = sim[(np.cumsum(n) - 1)[full]]
        self.parts, self.pending = [(row, ids, sim)], 0
        return n, ids, sim


class _Block:
    """The queries of a block and their hits, in parts of `_MATRIX_ROWS` queries."""

    def __init__(self, batches: list[pa.RecordBatch], pivots: np.ndarray | None, limit: int, dtype: str):
        self.about = pa.Table.from_batches(batches).select(["model", "digest", "rep", "repeated"])
        unit = _unit([v for b in batches for v in b.column("raw").to_pylist()], dtype)
        self.hits = [_Hits(unit[at:at + _MATRIX_ROWS], limit) for at in range(0, len(unit), _MATRIX_ROWS)]
        self.angles = None if pivots is None else [np.arccos(np.clip(h.unit @ pivots.T, -1.0, 1.0)) for h in self.hits]

    def offer(self, batch: pa.RecordBatch, dtype: str) -> None:
        cands = _unit(batch.column("raw").to_pylist(), dtype)
        lists = batch.column("ids")
        ids, starts = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        cell, angle = batch.column("cell")[0].as_py(), batch.column("angle").to_numpy()
        for i, hits in enumerate(self.hits):
            rows = np.arange(len(hits.unit))
            if self.angles is not None:
                reach = np.arccos(np.clip(hits.floor - _COS_SLACK, -1.0, 1.0)) + _ANGLE_SLACK
                own = self.angles[i][:, cell]
                rows = np.flatnonzero(np.maximum(own - angle.max(), angle.min() - own) <= reach)
            if len(rows):
                hits.offer(rows, cands, ids[starts[:-1]], ids, starts)

    def lists(self) -> Iterator[pa.RecordBatch]:
        at = 0
        for hits in self.hits:
            n, ids, sims = hits.settle()
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            about = self.about.slice(at, len(n)).combine_chunks().to_batches()[0]
            at += len(n)
            columns = [*about.columns, pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, sims)]
            yield pa.RecordBatch.from_arrays(columns, names=[*about.schema.names, "ids", "sims"])


def _search(pivots: dict, limit: int, step: int, dtype: str):
    """Arrow batches sorted by (block, kind, cell, angle) to the lists of each block's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, queries, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "kind", "cell")], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                if keys[start, 0] != number:
                    if block is not None:
                        yield from block.lists()
                    number, queries, block = keys[start, 0], [], None
                if keys[start, 1] == _QUERY:
                    queries.append(batch.slice(start, end - start))
                    continue
                if block is None and not queries:
                    continue  # no vector fell to this block
                if block is None:
                    block = _Block(queries, pivots.get(queries[0].column("model")[0].as_py()), limit, dtype)
                    queries = []
                for at in range(start, end, step):
                    block.offer(batch.slice(at, min(step, end - at)), dtype)
        if block is not None:
            yield from block.lists()

    return run


def _distinct_vectors(vectors: DataFrame, limit: int, dtype: str) -> tuple[DataFrame, DataFrame]:
    """(rows with content digest, one row per distinct vector with its `limit` smallest ids)."""
    encoded = vectors.mapInArrow(encode_vectors(dtype), "id long, model string, raw binary")
    rows = encoded.withColumn("digest", F.sha1("raw"))
    first = Window.partitionBy("model", "digest").orderBy("id")
    distinct = (
        rows.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= limit)
        .groupBy("model", "digest")
        .agg(
            F.min("id").alias("rep"),
            F.array_sort(F.collect_list("id")).alias("ids"),
            F.any_value("raw").alias("raw"),
        )
    )
    return rows, cut_lineage(distinct)


def _assign_cells(pivots: dict, rings: int, dtype: str):
    """Nearest pivot, angle to it and its ring, per distinct vector; all zero for models without pivots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, part in pdf.groupby("model", dropna=False, sort=False):
                if model not in pivots:
                    yield part.assign(cell=0, ring=0, angle=0.0)
                    continue
                sims = np.clip(_unit(part["raw"], dtype) @ pivots[model].T, -1.0, 1.0)
                cell = sims.argmax(axis=1)
                angle = np.arccos(sims[np.arange(len(part)), cell])
                ring = np.minimum((angle / (np.pi / 2) * rings).astype(int), rings - 1)
                yield part.assign(cell=cell, ring=ring, angle=angle)

    return run


def _sample_pivots(distinct: DataFrame, per_model: dict, dtype: str) -> dict:
    """Pivots per model: the vectors with the smallest digests, a uniform and repeatable draw."""
    if not per_model:
        return {}
    most = max(per_model.values())
    w = Window.partitionBy("model").orderBy("digest")
    drawn = (
        distinct.where(F.col("model").isin(list(per_model))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("model", "raw").toPandas()
    )
    return {m: _unit(part["raw"][: per_model[m]], dtype) for m, part in drawn.groupby("model", dropna=False, sort=False)}


def _block_counts(counts: dict, layout: KnnLayout, limit: int, tasks: int) -> dict:
    """Blocks per model: two for each core, more where a task could not hold a block."""
    share = max(_LEAST_BLOCK, -(-sum(counts.values()) // (2 * tasks)))
    blocks = {}
    for model, n in counts.items():
        most = max(1, min(layout.block_rows, _BLOCK_ENTRIES // max(limit, int(model.split(":")[0]))))
        blocks[model] = -(-n // min(share, most))
    return blocks


def _lists(distinct: DataFrame, counts: dict, layout: KnnLayout, limit: int, dtype: str) -> DataFrame:
    """The first `limit` hits of each distinct vector, itself included."""
    spark = distinct.sparkSession
    n_pivots = {m: int(min(layout.max_pivots, max(1, round((n / layout.step_rows) ** 0.5 * 2))))
                for m, n in counts.items() if n > layout.step_rows * (layout.prune_from_blocks - 1)}
    pivots = _sample_pivots(distinct, n_pivots, dtype)
    schema = T.StructType(distinct.schema.fields + [
        T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("angle", T.DoubleType()),
    ])
    celled = distinct.mapInPandas(_assign_cells(pivots, layout.rings, dtype), schema)

    # At most max_pivots * rings groups per model, so this list is bounded.
    groups = (
        celled.groupBy("model", "cell", "ring").agg(F.count(F.lit(1)).alias("n")).orderBy("model", "cell", "ring").toPandas()
    )
    # Blocks follow the order of the groups; a group is spread over the blocks it touches.
    blocks = _block_counts(counts, layout, limit, max(8, spark.sparkContext.defaultParallelism))
    first = dict(zip(blocks, np.cumsum([0, *blocks.values()])))
    end = groups.groupby("model", sort=False)["n"].cumsum()
    n_blocks, total = groups["model"].map(blocks), groups["model"].map(counts)
    groups["first"] = groups["model"].map(first)
    groups["blocks"] = n_blocks
    groups["low"] = (end - groups["n"]) * n_blocks // total
    groups["parts"] = (end - 1) * n_blocks // total - groups["low"] + 1
    group_frame = F.broadcast(spark.createDataFrame(
        groups[["model", "cell", "ring", "first", "blocks", "low", "parts"]],
        "model string, cell int, ring int, first int, blocks int, low int, parts int",
    ))
    own = F.col("first") + F.col("low") + F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    placed = celled.join(group_frame, ["model", "cell", "ring"]).withColumn("own", own)
    every = F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)
    passes = F.transform(every, lambda b: F.struct(b.alias("block"), F.when(b == F.col("own"), _OWN).otherwise(_OTHER).alias("kind")))
    passes = F.concat(F.array(F.struct(F.col("own").alias("block"), F.lit(_QUERY).alias("kind"))), passes)
    query = F.col("kind") == _QUERY
    sent = placed.withColumn("pass", F.explode(passes)).select("*", "pass.*").select(
        "block", "kind", "cell", "angle", "raw",
        F.when(query, F.col("model")).alias("model"), F.when(query, F.col("digest")).alias("digest"),
        F.when(query, F.col("rep")).alias("rep"), (query & (F.size("ids") > 1)).alias("repeated"),
        F.when(~query, F.col("ids")).alias("ids"),
    )
    in_order = sent.repartitionById(min(sum(blocks.values()), 4096), F.col("block")).sortWithinPartitions("block", "kind", "cell", "angle")
    return in_order.mapInArrow(_search(pivots, limit, layout.step_rows, dtype), _LISTS)


def nearest_neighbours(
    vectors: DataFrame,
    top_k: int,
    id_col: str = "id",
    vector_col: str = "vector",
    model_col: str | None = None,
    include_self: bool = False,
    layout: KnnLayout | None = None,
) -> DataFrame:
    """(query_id, rank, candidate_id, sim): the `top_k` most similar rows of every row.

    With `model_col` only vectors of the same model are compared (B12). Rows are
    ranked by (cosine desc, id); `sim` is the cosine, never below zero (F1).
    Vectors of different sizes never meet. Null, empty, all-zero and non-finite vectors
    take no part; `vector_search.vector_refusal` names them.
    """
    layout = layout or KnnLayout()
    element = vectors.schema[vector_col].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    limit = top_k if include_self else top_k + 1
    model = F.col(model_col).cast("string") if model_col else F.lit("")
    # The size is part of the model.
    source = vectors.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.concat_ws(":", F.size(vector_col), F.coalesce(model, F.lit(""))).alias("model"),
        F.col(vector_col).alias("vector"),
    )
    rows, distinct = _distinct_vectors(source, limit, dtype)

    # Models are a handful of named networks; one small row each.
    per_model = distinct.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ids")).alias("copies")).limit(10_001).collect()
    counts = {r["model"]: r["n"] for r in per_model}
    if len(counts) > 10_000:
        raise ValueError("more than 10000 model hashes; check the model column")
    if not counts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, candidate_id long, sim double")
    # Written once, by query: whatever reads the result searches no second time and finds the rows of a query together.
    lists = cut_lineage(_lists(distinct, counts, layout, limit, dtype).repartition("rep"))
    hits = F.arrays_zip(F.col("ids").alias("candidate_id"), F.col("sims").alias("sim")).alias("found")
    if max(r["copies"] for r in per_model) > 1:
        single = lists.where("NOT repeated").select(F.col("rep").alias("query_id"), hits)
        repeated = lists.where("repeated").select("model", "digest", hits)
        keys = rows.select("id", "model", "digest")
        sizes = keys.groupBy("model", "digest").agg(F.count(F.lit(1)).alias("n"))
        copies = skew_safe_lookup(keys, repeated, ["model", "digest"], "id", sizes, "n")
        lists = single.unionByName(copies.select(F.col("id").alias("query_id"), "found"))
    else:
        lists = lists.select(F.col("rep").alias("query_id"), hits)

    if not include_self:
        lists = lists.withColumn("found", F.filter("found", lambda hit: hit["candidate_id"] != F.col("query_id")))
    return lists.select("query_id", F.posexplode(F.slice("found", 1, top_k)).alias("pos", "hit")).select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("hit.candidate_id").alias("candidate_id"),
        F.greatest(F.lit(0.0), F.col("hit.sim")).alias("sim"),
    )


def library_neighbours(vectors: DataFrame, top_k: int, model_col: str = "model_hash", **kwargs) -> DataFrame:
    """Analysis form of the search (C14): the query itself is left out.

    All vectors compete; a library holding exactly one model needs no filter, so
    the model column is not used at all.
    """
    return nearest_neighbours(vectors, top_k, model_col=None, include_self=False, **kwargs)
