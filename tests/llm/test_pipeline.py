"""The pipeline stage by stage against brute force, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from gatewell.llm.queries import QUERIES, SQL
from test_dedup import brute_components, low
from test_models import brute_hits

NAMES = ["op1_quality", "op2_exact_dedup", "op3_suffix_dedup", "op4_licenses", "op5_near_dedup",
         "op6_language_model", "op7_private", "op8_decontamination", "op9_packing",
         "op10_chunk_dedup", "op11_ranked_search", "op12_periodic_runs", "op13_ngram_join"]


def test_registration():
    assert sorted(QUERIES) == sorted(NAMES)
    assert {*NAMES, "pipeline"} <= set(contract.queries())
    assert set(SQL) <= set(NAMES) and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    kept = {}
    for name in ("quality classifier", "exact dedup", "near dedup", "decontamination"):
        before = texts_of(docs)
        docs = stages[name](spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = texts_of(docs)
        assert set(kept[name].items()) <= set(before.items())
        if name == "exact dedup":
            last = {low(t): k for k, t in sorted(before.items())}
            assert set(kept[name]) == set(last.values())
        if name == "near dedup":
            assert set(kept[name]) == {k for k, (_, c) in brute_components(before).items() if c == k}
        if name == "decontamination":
            items = duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()
            assert set(kept[name]) == {k for k, h in brute_hits(before, items).items() if not h[3]}
    packed = stages["packing"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept["decontamination"])
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole) == sorted(
        (r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_quality_stage_follows_the_labels(spark):
    """On 400 labels; the smallest tables have 87, with ten of some kinds, too few to learn from."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = set(texts_of(dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, folder)))
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{folder}/labels.parquet'").fetchall()
    right = sum((k in kept) == (q == 1 and t == 0) for k, q, t in labels)
    assert right / len(labels) > 0.93


def test_stages_on_no_rows_and_extra_columns(spark, docs, nothing, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, folder).count() == 0
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, folder).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_queries_run_on_the_smallest_tables(spark, folder, name):
    found = QUERIES[name](spark, folder)
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert found.count() == n if name != "op9_packing" else found.count() >= n
    assert found.columns[0] == "doc_id"


def test_repeated_ids_lose_only_the_row_that_goes(spark, folder):
    """Rows that share an id are judged by their own texts."""
    from texts_for_tests import prose

    stages = dict(corpus_pipeline.STAGES)
    long, alone = " ".join(prose(1, 80)), " ".join(prose(2, 80))
    rows = [(5, "a"), (9, "A"), (5, "unique"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, stages["exact dedup"](spark, docs, folder).collect()), key=str) == sorted(
        rows[1:], key=str)
    rows = [(5, long + " end"), (3, long), (5, alone), (7, alone + " end"), (8, None), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, stages["near dedup"](spark, docs, folder).collect()), key=str) == sorted(
        [rows[1], rows[2], rows[4], rows[5]], key=str)
    item = duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet' ORDER BY 1 DESC").fetchall()[0][0]
    rows = [(5, item), (5, alone), (6, alone), (6, alone)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, stages["decontamination"](spark, docs, folder).collect())) == sorted(rows[1:])
