"""Nearest vectors by buckets, against the exact search."""

import random

import pytest
from pyspark.sql import functions as F

import gatewell.retrieval.near_vectors as near
from gatewell.plans.queries_observe import nearest_to_many
from gatewell.retrieval.near_vectors import Planes, near_topk, recall_at_k
from gatewell.retrieval.vectors import vector_topk
from gatewell.session import load

ROWS = "id bigint, v array<float>"


def recall(found, exact):
    got = recall_at_k(found, exact).agg(F.sum("hits"), F.sum("wanted")).first()
    return got[0] / got[1]


def asked(vectors, key="id", vector="v", every=20):
    return vectors.where(F.col(key) % every == 0).select(
        F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("query"))


def clustered(spark, n, seed, dims=32, centres=40):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return spark.createDataFrame(
        [(i, [x + draw.gauss(0, 0.4) for x in middle[i % centres]]) for i in range(n)], ROWS)


def test_recall_of_the_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    vectors = load(spark, folder, "embeddings")
    exact = vector_topk(vectors, "vec_id", "embedding", asked(vectors, "vec_id", "embedding"), 10)
    found = nearest_to_many(spark, folder)
    assert found.groupBy("query_id").count().where("count <> 10").isEmpty()
    assert recall(found, exact) >= 0.9


def test_recall_with_many_buckets(spark):
    vectors = clustered(spark, 4000, 5)
    queries = asked(vectors)
    found = near_topk(vectors, "id", "v", queries, 10, Planes(bits=8))
    exact = vector_topk(vectors, "id", "v", queries, 10)
    assert recall(found, exact) >= 0.9
    pairs = found.join(exact.withColumnRenamed("similarity", "s"), ["query_id", "id"])
    assert pairs.where("abs(similarity - s) > 1e-6").isEmpty()  # what is found has its exact score


def test_cells_do_not_change_the_result(spark, monkeypatch):
    vectors = clustered(spark, 600, 6)
    planes = Planes(tables=4, bits=2)
    whole = sorted(map(tuple, near_topk(vectors, "id", "v", asked(vectors), 5, planes).collect()))
    monkeypatch.setattr(near, "CELL_VECTORS", 50)
    monkeypatch.setattr(near, "CELL_QUERIES", 3)
    cells = sorted(map(tuple, near_topk(vectors, "id", "v", asked(vectors), 5, planes).collect()))
    assert [r[:2] + r[3:] for r in cells] == [r[:2] + r[3:] for r in whole]


def test_copies_of_one_vector_are_cut_to_k(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1000)] + [(1000 + i, [1.0, 0.01 * i, 1.0]) for i in range(5)]
    vectors = spark.createDataFrame(rows, ROWS)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query array<double>")
    got = near_topk(vectors, "id", "v", queries, 4).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(i, 1.0) for i in range(4)]


def test_lonely_queries_are_answered_exactly(spark):
    vectors = clustered(spark, 60, 8)
    queries = asked(vectors, every=6)
    found = near_topk(vectors, "id", "v", queries, 20, Planes(tables=1, probes=1, bits=12))
    exact = vector_topk(vectors, "id", "v", queries, 20)
    assert recall(found, exact) == 1
    assert found.count() == exact.count()


def test_what_has_no_similarity(spark):
    nan, inf = float("nan"), float("inf")
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0]), (6, [0.0, 0.0])], ROWS)
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, None), (4, [inf, 1.0])], "query_id int, query array<double>")
    for search in (vector_topk, near_topk):
        got = sorted(map(tuple, search(vectors, "id", "v", queries, 3).collect()))
        assert got == [(1, 1, 1.0, 1), (1, 6, 0.0, 2)]
        assert search(vectors.where("false"), "id", "v", queries, 3).count() == 0
        assert search(vectors, "id", "v", queries.where("query_id > 1"), 3).count() == 0
    with pytest.raises(ValueError, match="queries"):
        near_topk(vectors, "id", "v", spark.createDataFrame(
            [(1, [1.0]), (2, [1.0, 2.0])], "query_id int, query array<double>"), 3)


def test_no_stage_compares_everything(spark):
    vectors = clustered(spark, 200, 9)
    found = near_topk(vectors, "id", "v", asked(vectors), 3)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
