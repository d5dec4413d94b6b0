"""Search a library for given query vectors or ids.

Queries and library are cut into blocks by a hash, and every query block meets every
library block in one task of a grid. Each cell keeps the best hits of its queries, and
one window per query picks the best of all cells. A library row travels once per block
of queries, so a handful of queries ships the library once, and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.operators.knn import SIM_DECIMALS, encode_vectors
from lumenlake.session import ship_package

METRICS = ("cosine", "l2", "ip")
# Vectors of a block: queries, and library vectors where the queries fill a block.
BLOCK_ROWS = 4096
# Fewer queries meet larger library blocks, up to so many times the rows.
_WIDER = 8
# Distances held at once while a cell is compared.
_CELL_DISTANCES = 1 << 22
_HITS = "query_id long, candidate_id long, distance double"


def vector_refusal(vector: str | Column, metric: str = "cosine") -> Column:
    """Why a vector takes no part in a search, null when it does: `missing`, `not finite`, or `zero` (no direction, cosine only)."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def broken(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    reason = F.when(v.isNull() | (F.size(v) == 0), F.lit("missing")).when(F.exists(v, broken), F.lit("not finite"))
    return reason.when(F.forall(v, lambda x: x == 0), F.lit("zero")) if metric == "cosine" else reason


def _matrix(raw: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=dtype).astype(np.float64).reshape(len(raw), -1)


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of q to all rows of c; cosine rows are already of length one."""
    products = q @ c.T
    if metric == "l2":
        return np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * products)
    return 1.0 - products


def _cell_hits(limit: int, metric: str, dtype: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The `limit` nearest candidates of each query in one cell of the grid, by (distance, id)."""

    def run(queries: pd.DataFrame, library: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or library.empty:
            return pd.DataFrame({"query_id": [], "candidate_id": [], "distance": []})
        library = library.sort_values("id")
        q, c = _matrix(queries["raw"], dtype), _matrix(library["raw"], dtype)
        if metric == "cosine":
            q, c = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, c))
        query_ids, ids = queries["id"].to_numpy(), library["id"].to_numpy()
        n, step = min(limit, len(c)), max(1, _CELL_DISTANCES // len(c))
        found = []
        for at in range(0, len(q), step):
            rows = np.round(_distances(q[at:at + step], c, metric), SIM_DECIMALS)
            edges = np.partition(rows, n - 1, axis=1)[:, n - 1]
            for query_id, row, edge in zip(query_ids[at:at + step], rows, edges):
                near = np.flatnonzero(row <= edge)
                near = near[np.argsort(row[near], kind="stable")][:n]
                found.append(pd.DataFrame({"query_id": query_id, "candidate_id": ids[near], "distance": row[near]}))
        return pd.concat(found)

    return run


def _encoded(rows: DataFrame, id_col: str, vector_col: str, model_col: str | None, metric: str, dtype: str) -> DataFrame:
    """(id, model, raw) of usable vectors; the size is part of the model, so other sizes never meet."""
    model = F.coalesce(F.col(model_col).cast("string"), F.lit("")) if model_col else F.lit("")
    usable = rows.where(vector_refusal(vector_col, metric).isNull()).select(
        F.col(id_col).cast("long").alias("id"), F.concat_ws(":", F.size(vector_col), model).alias("model"), F.col(vector_col).alias("vector"))
    return usable.mapInArrow(encode_vectors(dtype, keep_zero=metric != "cosine"), "id long, model string, raw binary")


def search_vectors(
    queries: DataFrame, vectors: DataFrame, top_k: int, metric: str = "cosine", query_id_col: str = "query_id",
    id_col: str = "id", vector_col: str = "vector", model_col: str | None = None, include_self: bool = True, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, candidate_id, distance, sim): the `top_k` nearest library vectors of each query vector, exact.

    Distances are those of the metric (cosine, squared l2, ip) at 12 decimals; equal
    ones go by the smaller id; `sim` is 1 - distance, never below zero. Ids are unique
    on each side. With `model_col` (on both sides) only vectors of one model meet,
    and vectors of different sizes never do. `include_self=False` leaves out the
    candidate with the query's own id. Vectors that `vector_refusal` names take no part.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    ship_package(vectors.sparkSession)
    single = all(isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) for df in (queries, vectors))
    dtype = "<f4" if single else "<f8"
    left = _encoded(queries, query_id_col, vector_col, model_col, metric, dtype)
    right = _encoded(vectors, id_col, vector_col, model_col, metric, dtype)
    n_queries, n_vectors = queries.count(), vectors.count()
    library_rows = min(_WIDER * block_rows, max(block_rows, block_rows * block_rows // max(1, n_queries)))
    q_blocks, c_blocks = max(1, -(-n_queries // block_rows)), max(1, -(-n_vectors // library_rows))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    keys = ["model", "q", "c"]
    left = left.select("*", block(q_blocks).alias("q"), every(c_blocks).alias("c"))
    right = right.select("*", block(c_blocks).alias("c"), every(q_blocks).alias("q"))
    # Both sides may come from one table: fresh column ids keep them apart.
    right = right.toDF(*right.columns)
    limit = top_k if include_self else top_k + 1
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_cell_hits(limit, metric, dtype), _HITS)
    if not include_self:
        hits = hits.where("candidate_id <> query_id")
    best = Window.partitionBy("query_id").orderBy("distance", "candidate_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select(
        "query_id", "rank", "candidate_id", "distance", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("sim"))


def search_ids(
    ids: DataFrame, vectors: DataFrame, top_k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector",
    model_col: str | None = None, include_self: bool = False, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(neighbours of library rows named by `ids`, problems): a problem row is (query_id, problem).

    Problems are ids that the library does not hold (`unknown`) and vectors that take
    no part; repeated ids are searched once, null ids are unknown.
    """
    wanted = ids.select(F.col(id_col).cast("long").alias("query_id")).distinct()
    library = vectors.withColumn("query_id", F.col(id_col).cast("long"))
    queries = library.join(wanted, "query_id", "left_semi")
    unknown = wanted.join(queries.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("unknown").alias("problem"))
    refused = queries.select("query_id", vector_refusal(vector_col, metric).alias("problem")).where("problem IS NOT NULL")
    found = search_vectors(queries, vectors, top_k, metric, "query_id", id_col, vector_col, model_col, include_self, block_rows)
    return found, unknown.unionByName(refused)
