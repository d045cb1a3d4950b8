"""Benchmark decontamination by winnowing: least hashes of windows find the places to look at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.llm.textcode import (
    ALNUM, mixed, run_edges, run_hashes, signed, slices, sliding_least, texts_of, whole_starts,
    words_of,
)

WINDOW = 13
# More fingerprints or windows than this on the benchmark's side are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_MARKS = pa.schema([
    ("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("size", pa.int32()),
    ("start", pa.int64()), ("mark", pa.int64()), ("windows", pa.list_(pa.int64()))])
_MARKS_SQL = ("id bigint, key bigint, n_words bigint, size int, start bigint, mark bigint, "
              "windows array<bigint>")


def gram_size(size: int) -> int:
    """Words in a fingerprinted gram, for spans of ``size`` words that must not be missed."""
    return max(1, size * 5 // 13)


def _marks(sizes: list[int], exact_sizes: bool, window: int):
    """Fingerprints of all windows of the given sizes.

    Of the grams within a window the one with the least hash is kept, so two equal windows keep the
    same gram wherever they stand. Neighbouring windows mostly share theirs and come as one row:
    the hash of the gram, and the hashes of the windows. Each text also gives one row of size 0.
    With ``exact_sizes`` a text of fewer than ``window`` words is one window of its own size.
    """
    def rows_of(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = words_of(texts, ALNUM)
                counts = words.counts()
                ids = part.column("id")
                key = part.column("key")
                n = len(texts)
                yield pa.RecordBatch.from_arrays([
                    ids, key, pa.array(counts, pa.int64()), pa.array(np.zeros(n, np.int32)),
                    pa.array(np.zeros(n, np.int64)), key,
                    pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)),
                                             pa.array([], pa.int64()))], schema=_MARKS)
                for size in sizes:
                    valid = whole_starts(words.first, size)
                    if exact_sizes and size < window:
                        valid = valid[counts[words.text[valid]] == size]
                    if len(valid) == 0:
                        continue
                    tag = mixed(np.array([size], np.uint64))[0]
                    whole = run_hashes(words.hashes, size) + tag
                    gram = gram_size(size)
                    grams = run_hashes(words.hashes, gram)
                    place = sliding_least(grams, size - gram + 1)[valid]
                    # Two texts never share a run: the chosen place lies within the window.
                    edges = run_edges(place)
                    begin = edges[:-1]
                    text = words.text[valid[begin]]
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(at), key.take(at), pa.array(counts[text], pa.int64()),
                        pa.array(np.full(len(begin), size, np.int32)),
                        pa.array(valid[begin] - words.first[text]),
                        pa.array(signed(mixed(grams[place[begin]] + tag))),
                        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)),
                                                 pa.array(signed(whole[valid])))], schema=_MARKS)
    return rows_of


def _counted(items):
    def rows_of(batches):
        for batch in batches:
            for _, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words_of(texts, ALNUM).counts(), pa.int64())], ["n"])
    return items.mapInArrow(rows_of, "n bigint")


def _covered(spans: Column) -> Column:
    """Words covered by spans (start, size), counted once."""
    def step(acc, span):
        end = span["start"] + span["size"]
        fresh = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(span["start"], acc["end"]))
        return F.struct((acc["total"] + fresh).alias("total"),
                        F.greatest(acc["end"], end).alias("end"))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("total"), zero.alias("end")),
                       step, lambda acc: acc["total"])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                 doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted item ids as strings), contaminated.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is
    ``window`` consecutive words of an item; an item with fewer words (but some) is one window. A
    document's word is hit inside any occurrence of a window. It is contaminated if at least one
    word is hit and at least one in twenty.

    Fingerprints of both sides meet in a join; only windows next to a shared fingerprint are then
    compared, by 64-bit hashes. Every window has a fingerprint and equal windows have the same one,
    so no shared span of ``window`` words is missed. Documents' texts are not shuffled. The
    benchmark's sides are broadcast only if they were counted to be at most ``broadcast_rows``;
    beyond it the same joins shuffle.

    Null and empty texts have no words. Rows that repeat an id, a text or both are all returned. Null
    ids are kept; null item ids never count. With an empty benchmark nothing is hit; with no documents
    there are no rows. Ids must be integers; other columns play no part.
    """
    def narrowed(frame, ident, text):
        body = F.coalesce(F.col(quoted(text)), F.lit(""))
        return frame.select(ident.alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))

    items = (benchmark.where(F.col(quoted(item_id)).isNotNull())
             .select(F.col(quoted(item_id)).cast("string").alias("item"),
                     F.col(quoted(item_text)).alias("text")))
    sizes = sorted({min(row["n"], window) for row in
                    _counted(items.select("text")).select(F.least("n", F.lit(window)).alias("n"))
                    .distinct().collect()} - {0})
    # Items are told apart by their text here; the ids come back by a join on its hash.
    texts = items.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "item").distinct()
    parts = narrowed(items, F.lit(0).cast("bigint"), "text").dropDuplicates(["key"])
    parts = parts.mapInArrow(_marks(sizes, True, window), _MARKS_SQL).where("size > 0")
    marks = parts.select("mark").distinct().withColumn("shared", F.lit(True))
    spans = (parts.select("key", F.explode("windows").alias("whole")).distinct()
             .join(texts, "key").groupBy("whole").agg(F.collect_set("item").alias("items")))

    def sided(frame):
        return F.broadcast(frame) if frame.count() <= broadcast_rows else frame

    source = narrowed(docs, F.col(quoted(doc_id)).cast("bigint"), doc_text)
    found = (source
             .mapInArrow(_marks(sizes, False, window), _MARKS_SQL)
             .join(sided(marks), "mark", "left").where("size = 0 OR shared")
             .select("id", "key", "n_words", "size", "start",
                     F.posexplode_outer("windows").alias("step", "whole")))
    # A row of a document without windows keeps its own key there, which meets no window.
    found = found.withColumn("whole", F.coalesce("whole", "key")).join(sided(spans), "whole", "left")
    hit = F.col("items").isNotNull() & (F.col("size") > 0)
    span = F.struct((F.col("start") + F.col("step")).alias("start"),
                    F.col("size").cast("bigint").alias("size"))
    per_text = found.groupBy("id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, span)).alias("spans"),
        F.collect_set(F.when(hit, F.col("items"))).alias("items"))
    n_hit = _covered(F.col("spans"))
    listed = F.array_sort(F.array_distinct(F.flatten("items")))
    # Rows that repeat id and text were judged as one; each row gets the verdict back.
    judged = per_text.select(F.col("id").alias("judged"), F.col("key").alias("text_key"), "n_words",
                             n_hit.alias("n_hit"), listed.alias("items"))
    rows = source.select("id", "key")
    return (rows.join(judged, rows["id"].eqNullSafe(judged["judged"])
                      & (rows["key"] == judged["text_key"]))
            .select(F.col("id").alias(doc_id), "n_words", "n_hit",
                    F.size("items").cast("bigint").alias("n_items"), "items",
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
                    .alias("contaminated")))
