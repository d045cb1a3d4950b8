"""The document pipeline: judge quality, drop copies, drop near copies, decontaminate, pack.

Each stage takes the documents its predecessor kept. ``run`` writes every stage's result to the
shared folder and reads it back, so a lost executor never replays an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.llm.contamination import contaminated
from gatewell.llm.exact import exact_duplicates
from gatewell.llm.near import near_duplicates
from gatewell.llm.packing import best_fit_packing
from gatewell.llm.quality import quality_scores
from gatewell.llm.queries import vocabulary
from gatewell.llm.shipping import ship
from gatewell.session import load, materialize

# A stage on a word model, a token count or an estimate has no counterpart in SQL.
ORACLE_SQL = None


# Names a row by its id and text, as ids may repeat; null where there is no id.
ROW = "gatewell_row"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.when(F.col("doc_id").isNotNull(), F.xxhash64(
        "doc_id", F.coalesce("text", F.lit("")))))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose key was dropped; rows without an id stay.

    The dropped keys are narrow rows. Adaptive execution broadcasts them only if they are few.
    """
    keys = dropped.select(ROW).where(F.col(ROW).isNotNull()).distinct()
    return _keyed(docs).join(keys, ROW, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    judged = quality_scores(docs, load(spark, folder, "labels"))
    return judged.where("accepted").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    rows = _keyed(docs).select("doc_id", "text", ROW)
    return _without(docs, exact_duplicates(rows, carry=[ROW]).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays."""
    ship(spark)
    rows = _keyed(docs).select("doc_id", ROW, "text")
    found = (near_duplicates(rows.select(ROW, "text"), id_column=ROW)
             .where(F.col(ROW).isNotNull()).select(ROW, "component_id").distinct())
    found = materialize(found.join(rows.select("doc_id", ROW).distinct(), ROW), "near-rows")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", ROW)).alias("first"))
    stay = first.select(F.col(f"first.{ROW}").alias(ROW))
    return _without(docs, found.join(stay, ROW, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    found = contaminated(_keyed(docs).select(ROW, "text"),
                         load(spark, folder, "benchmark").select("item_id", "text"), doc_id=ROW)
    return _without(docs, found.where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship(spark)
    return best_fit_packing(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
