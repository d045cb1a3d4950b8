"""A stored term index: built once, extended by new documents, searched with a pruned scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.functions import quoted
from gatewell.retrieval.search import ranked, words_wanted
from gatewell.session import materialize

NOT_LETTERS = r"[^\p{L}]+"
BUCKETS = 64


@dataclass(frozen=True)
class TermIndex:
    """Two tables: postings (bucket, term, document, tf), partitioned by a hash of the term, and the
    documents that were indexed."""

    postings: str
    documents: str
    buckets: int = BUCKETS

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, key: str, text: str) -> None:
        """Index documents; those that are in the index already are left alone.

        Null keys are left out. A term of a document is one row, counted before the shuffle, so a
        frequent term is spread over the files of its bucket. The postings are shuffled once, by
        bucket, term and document, and counted and written where they land.
        """
        spark = docs.sparkSession
        new = docs.select(F.col(quoted(key)).alias("document"), F.col(quoted(text)).alias("text"))
        new = new.where("document IS NOT NULL")
        if spark.catalog.tableExists(self.documents):
            new = new.join(spark.table(self.documents), "document", "left_anti")
        known = materialize(new.select("document").distinct(), "indexed")
        words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), NOT_LETTERS), "")
        terms = new.select("document", F.explode(words).alias("term"))
        (terms.withColumn("bucket", self._bucket("term")).repartition("bucket", "term", "document")
         .groupBy("bucket", "term", "document").agg(F.count(F.lit(1)).alias("tf"))
         .select("term", "document", "tf", "bucket").sortWithinPartitions("bucket", "term")
         .write.mode("append").format("parquet").partitionBy("bucket").saveAsTable(self.postings))
        known.write.mode("append").format("parquet").saveAsTable(self.documents)

    def frequencies(self, spark: SparkSession) -> DataFrame:
        """In how many documents each term occurs."""
        return spark.table(self.postings).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def of(self, spark: SparkSession, terms: Sequence[str]) -> DataFrame:
        """The postings of a few terms. Only their buckets are read, and of those only files and
        row groups that may hold the terms."""
        listed = spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = {row[0] for row in listed.select(self._bucket("term")).collect()}
        return spark.table(self.postings).where(
            F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(list(terms)))

    def search(self, spark: SparkSession, key: str, queries: Sequence[str], top: int = 10
               ) -> DataFrame:
        """The best documents per query by the sum of tf * ln(N / df) over its words."""
        wanted, words = words_wanted(queries)
        counts = materialize(self.of(spark, words).groupBy(F.col("document").alias(key)).agg(*[
            F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}")
            for i, w in enumerate(words)]), "search")
        return ranked(counts, spark.table(self.documents).count(), wanted, words, key, top)
