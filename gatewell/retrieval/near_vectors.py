"""Nearest vectors by cosine similarity without comparing every query with every vector."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewell.operators.ranking import top_per_group
from gatewell.retrieval.vectors import finite, finite_queries, result_schema, scoring, vector_topk
from gatewell.session import materialize


@dataclass(frozen=True)
class Planes:
    """Random hyperplanes: ``tables`` signatures of ``bits`` signs each, drawn from ``seed``.

    A query looks into its own bucket of each table and into ``probes - 1`` buckets that differ in the
    signs it is least sure of. ``bits`` of None are chosen so that a bucket of evenly spread vectors
    has ``bucket`` of them. More tables and probes find more and cost more.
    """

    tables: int = 12
    probes: int = 8
    bucket: int = 256
    bits: int | None = None
    seed: int = 7

    def sized(self, n_vectors: int) -> int:
        if self.bits is not None:
            return self.bits
        return min(40, max(1, math.ceil(math.log2(max(1, n_vectors) / self.bucket + 1))))


# Vectors and queries of one bucket that meet in one task; fuller buckets are cut into cells.
CELL_VECTORS = 20_000
CELL_QUERIES = 2_000


def _signer(planes: Planes, bits: int, length: int, probes: int):
    """Batches of (name, vector) to (name, vector, table, bucket), ``probes`` buckets per table."""
    tables, seed = planes.tables, planes.seed

    def sign(batches):
        normals = np.random.default_rng(seed).standard_normal((length, tables * bits))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.num_rows
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                margin = (flat.reshape(n, length) @ normals).reshape(n, tables, bits)
                own = ((margin > 0) * weights).sum(axis=2)
                buckets = [own]
                # The least sure signs are turned over: one at a time, then pairs of them.
                order = np.argsort(np.abs(margin), axis=2)
                flips = [(i,) for i in range(bits)] + [(i, j) for j in range(bits) for i in range(j)]
                flips.sort(key=lambda f: sum((i + 1) ** 2 for i in f))
                for flip in flips[:probes - 1]:
                    turned = own
                    for i in flip:
                        turned = turned ^ weights[order[:, :, i]]
                    buckets.append(turned)
                spread = np.stack(buckets, axis=2)  # row, table, probe
                row, table, _ = np.unravel_index(np.arange(spread.size), spread.shape)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(taken), part.column(1).take(taken),
                     pa.array(table.astype(np.int32)), pa.array(spread.reshape(-1))],
                    names=[batch.schema.field(0).name, batch.schema.field(1).name, "_t", "_b"])
    return sign


def near_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int,
              planes: Planes = Planes()) -> DataFrame:
    """About the k most similar vectors for every query: ``query_id, key, similarity, rank``.

    1. Vectors and queries get a bucket per table: the signs of products with random directions.
       Vectors at a small angle agree in all signs of some table with a high chance.
    2. Vectors of buckets that no query looks into stay where they are. The rest meet the queries of
       their bucket in cells of bounded size, where a matrix product scores them exactly.
    3. A cell passes on k vectors per query; a vector found by several tables counts once.

    Similarities are exact; only a neighbour that shares no bucket with the query is missed, so the
    recall depends on ``planes`` and on the data (``recall_at_k`` measures it). Equal vectors
    are cut to the k of smallest key first, as no query can return more of them, so a vector that
    a third of all rows hold does not fill a bucket. Queries that meet fewer than k vectors
    are answered by the exact search. What is left out is as in ``vector_topk``: null or not finite
    values, other lengths. ``key`` must be unique; an empty table, or no queries, gives no rows.
    """
    queries = materialize(finite_queries(queries), "near-queries")
    lengths = queries.agg(F.min(F.size("query")).alias("a"), F.max(F.size("query")).alias("b")).first()
    length = lengths["a"]
    if length != lengths["b"]:
        raise ValueError(f"queries of {length} to {lengths['b']} values")
    types = {**dict(vectors.select(key, vector).dtypes), **dict(queries.dtypes)}
    if not length:
        return vector_topk(vectors, key, vector, queries, k)
    schema = result_schema(vectors, key, queries)
    source = vectors.where((F.size(vector) == F.lit(length)) & finite(vector)).select(key, vector)
    source = materialize(top_per_group(source.withColumn("_same", F.xxhash64(vector)),
                                       ["_same", vector], [F.col(key).asc()], k, "_copy")
                         .select(key, vector), "near-vectors")
    bits = planes.sized(source.count())
    signed = source.mapInArrow(_signer(planes, bits, length, 1),
                               f"`{key}` {types[key]}, `{vector}` {types[vector]}, _t int, _b bigint")
    probes = min(planes.probes, 1 + bits + bits * (bits - 1) // 2)
    asked = materialize(queries.mapInArrow(
        _signer(planes, bits, length, probes),
        f"query_id {types['query_id']}, query {types['query']}, _t int, _b bigint"), "near-probes")

    wanted = asked.groupBy("_t", "_b").agg(F.count(F.lit(1)).alias("_queries"))
    met = materialize(signed.join(wanted.select("_t", "_b"), ["_t", "_b"], "left_semi"), "near-met")
    sizes = met.groupBy("_t", "_b").agg(F.count(F.lit(1)).alias("_vectors")).join(wanted, ["_t", "_b"])
    grid = materialize(sizes.select(
        "_t", "_b", F.ceil(F.col("_vectors") / CELL_VECTORS).alias("_rows"),
        F.ceil(F.col("_queries") / CELL_QUERIES).alias("_columns")), "near-cells")

    def listed(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    placed = (met.join(grid, ["_t", "_b"]).withColumn("_r", F.pmod(F.xxhash64(key), F.col("_rows")))
              .withColumn("_c", listed("_columns")))
    probing = (asked.join(grid, ["_t", "_b"])
               .withColumn("_c", F.pmod(F.xxhash64("query_id"), F.col("_columns")))
               .withColumn("_r", listed("_rows")))
    unit_rows, best, _ = scoring(key, k)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": right.column("query_id").slice(0, 0),
                             key: left.column(key).slice(0, 0),
                             "similarity": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        return pa.Table.from_batches([best(
            right.column("query_id").combine_chunks(),
            unit_rows(right.column("query").combine_chunks(), right.num_rows),
            left.column(key).combine_chunks(),
            unit_rows(left.column(vector).combine_chunks(), left.num_rows))])

    cell = ["_t", "_b", "_r", "_c"]
    found = (placed.select(*cell, key, vector).groupBy(*cell)
             .cogroup(probing.select(*cell, "query_id", "query").groupBy(*cell))
             .applyInArrow(score, schema)
             .groupBy("query_id", key).agg(F.max("similarity").alias("similarity")))
    order = [F.col("similarity").desc(), F.col(key).asc()]
    ranked = materialize(top_per_group(found, ["query_id"], order, k, "rank"), "near-found")
    full = ranked.where(F.col("rank") == k).select("query_id")
    short = materialize(queries.join(full, "query_id", "left_anti"), "near-short")
    if short.isEmpty():
        return ranked
    rest = vector_topk(source, key, vector, short, k)
    return ranked.join(full, "query_id", "left_semi").unionByName(rest)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: ``wanted`` rows of the exact result and ``hits``, how many rows of ``found`` are as
    similar as its last one. Of equally similar neighbours any is right."""
    least = exact.groupBy("query_id").agg(F.min("similarity").alias("_least"),
                                          F.count(F.lit(1)).alias("wanted"))
    scored = found.select("query_id", "similarity")
    return (least.join(scored, "query_id", "left").groupBy("query_id", "wanted")
            .agg(F.count(F.when(F.col("similarity") >= F.col("_least"), 1)).alias("hits")))
