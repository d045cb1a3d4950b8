"""Nearest vectors by cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gatewell.operators.ranking import top_per_group

# Query vectors one task compares at a time: 4096 vectors of 1024 doubles are 32 MB.
QUERY_BLOCK = 4096
# Vectors per cell when there are more queries than one block.
CELL_VECTORS = 50_000


def centroids(vectors: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """The mean vector of every group: one partial sum per group and map task is shuffled."""
    means = [F.avg(F.col(vector)[i].cast("double")) for i in range(dims)]
    return vectors.groupBy(F.col(group).alias("query_id")).agg(F.array(*means).alias("query"))


def scoring(key: str, k: int):
    """(list column to unit rows, k best rows per query, both over batches). Nested, so that tasks
    receive the code itself and need no copy of this package."""

    def unit_rows(column: pa.Array, rows: int) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = flat.reshape(rows, -1)
        with np.errstate(invalid="ignore", over="ignore"):
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def best(ids: pa.Array, queries: np.ndarray, keys: pa.Array,
             vectors: np.ndarray) -> pa.RecordBatch:
        with np.errstate(invalid="ignore"):
            similar = np.round(vectors @ queries.T, 6)
        usable = np.isfinite(vectors).all(axis=1)
        similar[~usable] = -np.inf  # no score; such rows are left out below
        names = keys.to_numpy(zero_copy_only=False)
        number, row = [], []
        for q in range(similar.shape[1]):
            score = similar[:, q]
            rows = np.flatnonzero(usable)
            if len(rows) > k:  # all rows as good as the k-th; ties are settled by the key
                rows = np.flatnonzero(
                    usable & (score >= np.partition(score, len(score) - k)[len(score) - k]))
            rows = rows[np.lexsort((names[rows], -score[rows]))[:k]]
            number.append(np.full(len(rows), q))
            row.append(rows)
        number, row = np.concatenate(number), np.concatenate(row)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(number)), keys.take(pa.array(row)),
             pa.array(similar[row, number])], names=["query_id", key, "similarity"])

    def running(found: pa.RecordBatch | None, new: pa.RecordBatch) -> pa.RecordBatch:
        """The k best per query of two lists."""
        if found is None:
            return new
        both = pa.Table.from_batches([found, new]).combine_chunks().to_batches()
        if not both:
            return new
        both = both[0]
        order = both.to_pandas().assign(place=np.arange(both.num_rows)).sort_values(
            ["query_id", "similarity", key], ascending=[True, False, True])
        kept = order[order.groupby("query_id", dropna=False).cumcount() < k]
        return both.take(pa.array(kept["place"].to_numpy()))

    return unit_rows, best, running


def _few_queries(source: DataFrame, key: str, listed: pa.Table, k: int, schema: str) -> DataFrame:
    """All queries travel with the task: at most ``QUERY_BLOCK`` of them, checked by the caller."""
    listed = listed.combine_chunks()
    ids = listed.column("query_id").combine_chunks()
    unit_rows, best, running = scoring(key, k)
    wanted = unit_rows(listed.column("query").combine_chunks(), len(ids))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                found = running(found, best(ids, wanted, batch.column(0),
                                            unit_rows(batch.column(1), batch.num_rows)))
        if found is not None:
            yield found

    return source.mapInArrow(score, schema)


def _many_queries(source: DataFrame, key: str, vector: str, queries: DataFrame, n_queries: int,
                  k: int, schema: str) -> DataFrame:
    """Vectors and queries meet in a grid of cells, each bounded on both sides."""
    rows = max(1, math.ceil(source.count() / CELL_VECTORS))
    columns = math.ceil(n_queries / QUERY_BLOCK)
    placed = (source.withColumn("_r", F.pmod(F.xxhash64(key), F.lit(rows)))
              .withColumn("_c", F.explode(F.expr(f"sequence(0L, {columns - 1}L)"))))
    asked = (queries.withColumn("_c", F.pmod(F.xxhash64("query_id"), F.lit(columns)))
             .withColumn("_r", F.explode(F.expr(f"sequence(0L, {rows - 1}L)"))))

    unit_rows, best, _ = scoring(key, k)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            ids, keys = right.column("query_id"), left.column(key)
            return pa.table({"query_id": ids.slice(0, 0), key: keys.slice(0, 0),
                             "similarity": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        flat = {name: table.column(name).combine_chunks()
                for table, names in ((left, (key, vector)), (right, ("query_id", "query")))
                for name in names}
        return pa.Table.from_batches([best(
            flat["query_id"], unit_rows(flat["query"], right.num_rows),
            flat[key], unit_rows(flat[vector], left.num_rows))])

    return (placed.groupBy("_r", "_c").cogroup(asked.groupBy("_r", "_c"))
            .applyInArrow(score, schema))


def finite(vector: str) -> Column:
    """Whether a vector has a similarity to anything: no null and no value that is not finite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def finite_queries(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query").where(finite("query"))


def result_schema(vectors: DataFrame, key: str, queries: DataFrame) -> str:
    types = {**dict(vectors.select(key).dtypes), **dict(queries.select("query_id").dtypes)}
    return f"query_id {types['query_id']}, `{key}` {types[key]}, similarity double"


def _none(vectors: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame(
        [], f"{result_schema(vectors, key, queries)}, rank bigint")


def vector_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """The k most similar vectors for every query vector (``query_id``, ``query``), exactly.

    Similarities come from matrix products inside the tasks, and each task passes on k candidates
    per query, however many batches it reads. Vectors of another length than the queries, with a
    null inside or with a value that is not finite have no similarity and are left out, and so are such
    queries; queries of different lengths are an error. A set of queries that fits one block is sent to every task; a larger one
    is cut into blocks and shuffled to meet the vectors. ``key`` must be unique.
    """
    queries = finite_queries(queries)
    length = queries.agg(F.min(F.size("query")).alias("a"), F.max(F.size("query")).alias("b")).first()
    if length["a"] != length["b"]:
        raise ValueError(f"queries of {length['a']} to {length['b']} values")
    if not length["a"]:
        return _none(vectors, key, queries)
    source = vectors.where((F.size(vector) == F.lit(length["a"])) & finite(vector)).select(key, vector)
    schema = result_schema(vectors, key, queries)
    listed = queries.limit(QUERY_BLOCK + 1).toArrow()
    if listed.num_rows <= QUERY_BLOCK:
        found = _few_queries(source, key, listed, k, schema)
    else:
        found = _many_queries(source, key, vector, queries, queries.count(), k, schema)
    return top_per_group(found, ["query_id"], [F.col("similarity").desc(), F.col(key).asc()], k,
                         "rank")
