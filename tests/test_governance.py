"""Approvals, stages, lineage, masking, streams and retrieval on small tables."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewell.functions.detectors import DETECTORS, found
from gatewell.governance.approvals import current_state, episodes
from gatewell.governance.audit import append_audit, read_audit
from gatewell.governance.lineage import upstream
from gatewell.governance.pii import (
    comment_tags, create_masked_view, mask_columns, rules_from_tags, tag_tables,
)
from gatewell.governance.stages import latest_stage, stage_reach, time_in_stage
from gatewell.observe.runtime import runtime_stats
from gatewell.retrieval import vectors
from gatewell.retrieval.chunks import chunk_documents
from gatewell.retrieval.search import keyword_search
from gatewell.retrieval.vectors import vector_topk
from gatewell.session import fresh_table, load, scratch_path
from gatewell.streaming.load import file_stream, load_available, unique_within

T0 = datetime.datetime(2024, 1, 1)


def hours(n):
    return T0 + datetime.timedelta(hours=n)


@pytest.mark.parametrize("max_group", [10_000, 0])
def test_approval_fold(spark, max_group):
    log = spark.createDataFrame([
        (1, hours(0), "a", "approved"),                       # before any request: no effect
        (2, hours(1), "a", "requested"), (3, hours(2), "a", "rejected"),
        (4, hours(3), "a", "approved"),                       # already closed: no effect
        (5, hours(4), "a", "requested"),                      # a second request
        (6, hours(5), "b", "requested"), (7, hours(5), "b", "approved"),  # equal times
        (8, hours(6), "b", "approved"), (9, hours(7), "c", "approved"),
    ], "event_id long, ts timestamp_ntz, approval_id string, action string")
    got = sorted((r["approval_id"], r["episode"], r["state"]) for r in
                 episodes(log, max_group).collect())
    assert got == [("a", 1, "rejected"), ("a", 2, "pending"), ("b", 1, "approved")]
    state = {r["approval_id"]: (r["state"], r["episodes"]) for r in
             current_state(log, max_group).collect()}
    assert state == {"a": ("pending", 2), "b": ("approved", 1)}


@pytest.mark.parametrize("max_group", [10_000, 0])
def test_stages(spark, max_group):
    log = spark.createDataFrame([
        (1, hours(0), "p", "planning"), (2, hours(2), "p", "querying"), (3, hours(2), "p", "approval"),
        (4, hours(5), "p", "querying"), (5, hours(1), "q", "planning"),
    ], "event_id long, ts timestamp_ntz, pipeline_id string, stage string")
    spent = {(r["pipeline_id"], r["stage"]): (r["visits"], r["micros_in_stage"] // 3_600_000_000)
             for r in time_in_stage(log, max_group).collect()}
    assert spent == {("p", "planning"): (1, 2), ("p", "querying"): (2, 0), ("p", "approval"): (1, 3),
                     ("q", "planning"): (1, 0)}
    assert {r["pipeline_id"]: r["stage"] for r in latest_stage(log).collect()} == {
        "p": "querying", "q": "planning"}
    reach = {r["stage"]: r["share"] for r in stage_reach(log).collect()}
    assert reach["planning"] == 1.0 and reach["querying"] == 0.5 and reach["completed"] == 0.0


def test_upstream_with_cycle_and_start(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "c"),
                                   (None, "c")], "src string, dst string")
    got = {(r["node"], r["ancestor"]): r["distance"] for r in
           upstream(edges, spark.createDataFrame([("b",)], "node string")).collect()}
    assert got == {("b", "a"): 1, ("b", "c"): 2, ("b", "b"): 3, ("b", "x"): 3}
    assert {r["node"] for r in upstream(edges).collect()} == {"a", "b", "c"}
    near = upstream(edges, spark.createDataFrame([("b",)], "node string"), max_depth=2)
    assert {r["ancestor"] for r in near.collect()} == {"a", "c"}


def test_masking_leaves_nothing_to_find(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([
        (-1, "mail a.b@c.de, +1 (743) 555-1234 from 10.0.0.1 card 4785380592391139"),
        (-2, "x" * 200 + "@mail.org and é4785380592391139é")], "doc_id long, text string")
    masked = mask_columns(docs.unionByName(extra), {"text": "redact", "doc_id": "hash"})
    hits = masked.agg(*[F.count_if(found(F.col("text"), d)).alias(d) for d in DETECTORS]).first()
    assert set(hits.asDict().values()) == {0}
    assert masked.where(F.col("text").contains("<phone>")).count() >= 1


def test_tags_give_rules_comments_and_views(spark):
    df = spark.createDataFrame([("a@b.cd", "x"), ("none", "y")], "mail string, other string")
    table = fresh_table(spark, "people")
    df.write.saveAsTable(table)
    tags = tag_tables({table: df}, 0.5)
    assert rules_from_tags(tags, table) == {"mail": "redact"}
    comment_tags(spark, tags, table)
    assert [f.metadata.get("comment") for f in spark.table(table).schema] == ["pii: email", None]
    create_masked_view(spark, f"{table}_masked", table, {"mail": "redact", "other": "shape"})
    assert sorted(map(tuple, spark.table(f"{table}_masked").collect())) == [
        ("<email>", "x"), ("none", "x")]
    with pytest.raises(ValueError):
        mask_columns(df, {"mail": "blur"})


def test_audit_retry_replaces_itself(spark):
    path = scratch_path(spark, "audit")
    rows = spark.createDataFrame([(1, T0, "me", "write", "{}"), (2, hours(30), "me", "write", "{}")],
                                 "event_id long, ts timestamp_ntz, actor string, action string, "
                                 "details string")
    for batch in ("a", "b", "b"):
        append_audit(rows, path, batch)
    assert read_audit(spark, path).count() == 4


def test_stream_reads_each_file_once(spark):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    schema = spark.range(1).schema
    for batch in (range(0, 5), range(5, 8)):
        spark.createDataFrame([(i,) for i in batch], "id long").write.mode("append").parquet(source)
        for _ in range(2):
            load_available(file_stream(spark, source, schema), target, checkpoint)
        assert spark.read.parquet(target).count() == batch.stop


def test_stream_drops_repeats(spark):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    rows = spark.createDataFrame([(1, T0), (1, T0), (2, hours(1))], "id long, ts timestamp_ntz")
    rows.write.parquet(source)
    load_available(unique_within(file_stream(spark, source, rows.schema), ["id"], "ts", "1 hour"),
                   target, checkpoint)
    assert spark.read.parquet(target).count() == 2


def test_quantile_sketch_form(spark):
    runs = spark.createDataFrame([("j", hours(i % 3), float(i), i % 4 == 0) for i in range(100)],
                                 "job string, ts timestamp_ntz, cost double, failed boolean")
    exact, sketch = runtime_stats(runs).first(), runtime_stats(runs, exact=False).first()
    assert exact["p50"] == 49.5 and exact["error_rate"] == 0.25 and exact["runs"] == 100
    assert sketch["p50"] == pytest.approx(exact["p50"], abs=2)


@pytest.mark.parametrize("overlap", [0, 3, 5, 8])
def test_chunks_cover_the_text(spark, overlap):
    alphabet = "aé\n😀b\r\u2028c"
    texts = ["".join(alphabet[(i * 7) % len(alphabet)] for i in range(n))
             for n in (0, 1, 9, 10, 11, 17, 18, 100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for row in chunk_documents(df, "id", "text", size=10, overlap=overlap).orderBy(
            "id", "chunk_no").collect():
        got.setdefault(row["id"], []).append(row["text"])
    for number, text in enumerate(texts):
        stride = 10 - overlap
        want = [text[at:at + 10] for at in range(0, max(len(text) - overlap, 1), stride)]
        assert got.get(number, []) == (want if text else [])


def test_keyword_search_scores(spark):
    docs = spark.createDataFrame([(1, "Cat cat dog"), (2, "dog-cat"), (3, "bird"), (4, None)],
                                 "id long, text string")
    got = [(r["query"], r["id"], r["hits"], r["score"]) for r in keyword_search(
        docs, "id", "text", ["CAT", "dog bird", "cats", "42"]).orderBy("query", "rank").collect()]
    half, quarter = round(math.log(2), 6), round(math.log(4), 6)
    assert got == [("CAT", 1, 2, round(2 * math.log(2), 6)), ("CAT", 2, 1, half),
                   ("dog bird", 3, 1, quarter), ("dog bird", 1, 1, half), ("dog bird", 2, 1, half)]


@pytest.mark.parametrize("block", [4096, 7])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "CELL_VECTORS", 50)
    rng = np.random.default_rng(3)
    data = rng.integers(-3, 4, (200, 6)).astype(float)
    data[10], data[20] = data[5], 0.0   # an exact copy and a zero vector
    asked = rng.normal(size=(20, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)],
                               "id long, v array<float>").repartition(5)
    queries = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(asked)],
                                    "query_id int, query array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in
           vector_topk(df, "id", "v", queries, 4).collect()}
    norms = np.linalg.norm(data, axis=1)
    for q, vector in enumerate(asked):
        scores = np.round(np.divide(data @ vector, norms * np.linalg.norm(vector),
                                    out=np.zeros(len(data)), where=norms > 0), 6)
        best = sorted(range(len(data)), key=lambda i: (-scores[i], i))[:4]
        assert [got[q, r + 1] for r in range(4)] == [(i, scores[i]) for i in best]
