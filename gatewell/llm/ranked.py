"""Ranked lexical search: item bundles carry accumulators through the stages that own the terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gatewell.functions import quoted
from gatewell.llm.textcode import ALNUM, run_edges, signed, slices, words_of
from gatewell.session import materialize

TOP = 20
OWNERS = 4                 # stages; each owns a band of term weights, the heaviest first
BUNDLE = 128               # items that travel together, on average
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20   # documents whose accumulators travel together

_COUNTS = "item bigint, term bigint, n bigint"
_POSTINGS = ("block bigint, term bigint, n_docs bigint, total bigint, ids array<bigint>, "
             "docs binary, counts binary")
_STATE = ("block bigint, bundle bigint, ids array<bigint>, rest array<bigint>, spread binary, "
          "slots binary, docs binary, scores binary")
_FOUND = "bundle bigint, slot int, doc bigint, score bigint"


def _tallied(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, text) in this order with their number, and the number of terms of each text."""
    words = words_of(texts, ALNUM)
    order = np.lexsort((words.text, words.hashes))
    term, text = words.hashes[order], words.text[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    edges = np.append(np.flatnonzero(fresh), len(term))
    return term[edges[:-1]], text[edges[:-1]], np.diff(edges), words.counts()


def _item_terms(batches):
    for batch in batches:
        for part, texts in slices(batch, "text"):
            term, text, n, _ = _tallied(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("item").take(pa.array(text)), pa.array(signed(term)),
                 pa.array(n.astype(np.int64))], names=["item", "term", "n"])


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [
        None, pa.py_buffer((edges * width).astype(np.int32)),
        pa.py_buffer(np.ascontiguousarray(values))])


def _postings(batches):
    """Per block of documents a row for each term, and one without a term for the block itself."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for row in range(0, batch.num_rows, BLOCK_ROWS):
            for part, texts in slices(batch.slice(row, BLOCK_ROWS), "text", BLOCK_BYTES):
                term, text, n, sizes = _tallied(texts)
                edges = run_edges(term)
                terms = len(edges) - 1
                total = np.concatenate(([0], np.cumsum(n)))[edges]
                head = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()),
                                                part.column("id"))
                whole = np.array([0, part.num_rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([None], pa.int64()),
                     pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), head,
                     pa.array([b""], pa.binary()), _packed(sizes.astype("<i8"), whole)],
                    names=["block", "term", "n_docs", "total", "ids", "docs", "counts"])
                if terms:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(terms, block)), pa.array(signed(term[edges[:-1]])),
                         pa.array(np.diff(edges)), pa.array(np.diff(total)),
                         pa.nulls(terms, pa.list_(pa.int64())),
                         _packed(text.astype("<i4"), edges), _packed(n.astype("<i4"), edges)],
                        names=["block", "term", "n_docs", "total", "ids", "docs", "counts"])
                block += 1


def _best_of_row(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the highest scores above 0; equal scores by id."""
    some = np.flatnonzero(scores)
    if len(some) > top:
        bound = np.partition(scores[some], len(some) - top)[len(some) - top]
        some = some[scores[some] >= bound]
    return some[np.lexsort((ids[some], -scores[some]))][:top]


def _visit(stage: int, owners: int, top: int, n_docs: int, n_terms: int):
    """What the owners of a stage do for one bundle and one block of documents.

    They add the contributions of their terms. A document whose score cannot reach the block's
    ``top``-th best any more, whatever the later stages add, is dropped from its item's accumulators.
    """
    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if stage == 0:
            head = right.filter(pa.compute.is_null(right["term"]))
            # The length of a document against the mean, in hundredths, a quarter of it unaltered.
            sizes = np.frombuffer(head["counts"][0].as_py(), "<i8")
            spread = 75 + 25 * sizes * n_docs // max(n_terms, 1)
            slots, docs, scores = (np.zeros(0, t) for t in ("<i4", "<i4", "<i8"))
            rest_list = head["uses"][0]
        else:
            head = left
            spread = np.frombuffer(left["spread"][0].as_py(), "<i8")
            slots, docs, scores = (np.frombuffer(left[c][0].as_py(), t) for c, t in (
                ("slots", "<i4"), ("docs", "<i4"), ("scores", "<i8")))
            rest_list = left["rest"][0]
        rest = rest_list.values.to_numpy().reshape(-1, owners)
        sums = np.zeros((len(rest), len(spread)), np.int64)
        sums[slots, docs] = scores
        for term, weight, uses, where, counts in zip(*(right[c].combine_chunks() for c in (
                "term", "weight", "uses", "docs", "counts"))):
            if not term.is_valid:
                continue
            where = np.frombuffer(where.as_py(), "<i4")
            tf = np.frombuffer(counts.as_py(), "<i4").astype(np.int64)
            uses = uses.values.to_numpy().reshape(-1, 2)  # slot, times in the item
            given = weight.as_py() * (1_000_000_000 * tf // (1000 * tf + 12 * spread[where]))
            sums[np.ix_(uses[:, 0], where)] += uses[:, 1:] * given
        block, bundle = (right if len(right) else left).select(["block", "bundle"]).slice(0, 1) \
            .to_pylist()[0].values()
        if stage == owners - 1:
            ids = head["ids"][0].values
            order = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            best = [_best_of_row(row, order, top) for row in sums]
            slot = np.repeat(np.arange(len(best)), [len(b) for b in best])
            place = np.concatenate(best) if best else np.zeros(0, np.int64)
            return pa.table({
                "bundle": pa.array(np.full(len(slot), bundle, np.int64)),
                "slot": pa.array(slot.astype(np.int32)), "doc": ids.take(pa.array(place)),
                "score": pa.array(sums[slot, place])})
        alive = sums > 0
        if sums.shape[1] > top:
            bound = np.partition(sums, -top, axis=1)[:, -top]
            alive &= sums + rest[:, stage, None] >= bound[:, None]
        slots, docs = np.nonzero(alive)
        return pa.table({
            "block": pa.array([block]), "bundle": pa.array([bundle]),
            "ids": head["ids"].combine_chunks(), "rest": pa.array([rest.ravel()]),
            "spread": [spread.astype("<i8").tobytes()], "slots": [slots.astype("<i4").tobytes()],
            "docs": [docs.astype("<i4").tobytes()],
            "scores": [sums[slots, docs].astype("<i8").tobytes()]},
            schema=pa.schema([("block", pa.int64()), ("bundle", pa.int64()),
                              ("ids", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64())),
                              *((c, pa.binary()) for c in ("spread", "slots", "docs", "scores"))]))
    return visit


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", top: int = TOP,
                  owners: int = OWNERS, bundle: int = BUNDLE) -> DataFrame:
    """Per item its ``top`` documents: item_id, rank, doc_id, score; equal scores by doc_id.

    Terms are runs of digits, letters and non-ASCII characters after lower-casing A-Z, compared by
    64-bit hashes. With N documents that hold a term, L terms in them, n in one, df documents with a
    term and tf of it in one, a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), m is
    75 + 25 n N div L, and a score sums weight * (10**9 tf div (1000 tf + 12 m)) over the item's terms.

    Documents are read once, into postings by block of documents. The vocabulary is parted into
    ``owners`` bands of weight. A bundle of items with its accumulators for one block meets the
    postings of each band in turn, in a cogroup, and goes on to the next: integers only, so the order
    does not matter. Heavy terms come first, so that later bands can be bounded and documents out of
    reach are let go; this never changes the result. A group is one bundle and one block, so its size
    does not depend on the frequency of a term. The highest of all blocks are chosen at the end.

    Rows that repeat an item id, or have none, are one item of all their terms. Every row of the
    documents is a document of its own, also if its id repeats; null ids come last among equal
    scores. Null and empty texts have no terms and are never found; an item without terms has no
    rows. Empty tables give no rows. Other columns play no part.
    """
    if owners < 1 or top < 1 or bundle < 1:
        raise ValueError("owners, top and bundle must be positive")
    texts = F.coalesce(F.col(quoted(item_text)), F.lit(""))
    asked = materialize(
        items.select(F.col(quoted(item_id)).cast("bigint").alias("item"), texts.alias("text"))
        .mapInArrow(_item_terms, _COUNTS).groupBy("item", "term").agg(F.sum("n").alias("n")),
        "rank-items")
    source = docs.select(F.col(quoted(doc_id)).cast("bigint").alias("id"),
                         F.coalesce(F.col(quoted(doc_text)), F.lit("")).alias("text"))
    postings = materialize(source.mapInArrow(_postings, _POSTINGS), "rank-postings")

    sums = (postings.where("term IS NULL")
            .agg(F.sum("n_docs").alias("n"), F.sum("total").alias("l")).first())
    n_docs, n_terms = int(sums["n"] or 0), int(sums["l"] or 0)
    bundles = max(1, -(-asked.select("item").distinct().count() // bundle))
    named = (asked.select("item").distinct()
             .withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)))
             .withColumn("slot", F.row_number().over(Window.partitionBy("bundle").orderBy("item")) - 1))
    named = materialize(named, "rank-bundles")

    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    most = F.greatest(F.lit(1.0), F.lit(1000.0) * F.log((2 * F.lit(n_docs) + 2) / F.lit(3.0)))
    owner = F.least(F.lit(owners - 1), F.floor(owners * (1 - F.col("weight") / most))).cast("int")
    wanted = postings.join(asked.select("term").distinct(), "term", "left_semi")
    terms = (wanted.groupBy("term").agg(F.sum("n_docs").alias("df"))
             .withColumn("weight", weight).withColumn("owner", F.greatest(F.lit(0), owner)))
    uses = materialize(
        asked.join(terms, "term").join(named.withColumnRenamed("item", "named"),
                                       F.col("item").eqNullSafe(F.col("named")))
        .select("bundle", "slot", "term", "owner", "weight", "n"), "rank-uses")
    # No term adds more than a million of its weight.
    later = [F.sum(F.when(F.col("owner") > k, F.col("weight") * F.col("n") * 1_000_000)
                   .otherwise(0)).alias(f"rest_{k}") for k in range(owners)]
    rest = named.join(uses.groupBy("bundle", "slot").agg(*later), ["bundle", "slot"], "left")
    rest = (rest.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct(
        "slot", F.array(*[F.coalesce(f"rest_{k}", F.lit(0)) for k in range(owners)]).alias("rest"))))
        .alias("all")).select(
            "bundle", F.lit(None).cast("bigint").alias("term"), F.lit(0).alias("owner"),
            F.lit(0).cast("bigint").alias("weight"), F.flatten("all.rest").alias("uses")))
    shares = (uses.groupBy("bundle", "term", "owner", "weight")
              .agg(F.flatten(F.collect_list(F.array(F.col("slot").cast("bigint"), "n"))).alias("uses"))
              .unionByName(rest))
    shares = materialize(shares, "rank-shares")

    state = docs.sparkSession.createDataFrame([], _STATE)
    for stage in range(owners):
        owned = shares.where(F.col("owner") == stage).withColumnRenamed("term", "own")
        met = (postings.join(owned, F.col("term").eqNullSafe(F.col("own")))
               .select("block", "bundle", "term", "weight", "uses", "ids", "docs", "counts"))
        state = (state.groupBy("block", "bundle").cogroup(met.groupBy("block", "bundle"))
                 .applyInArrow(_visit(stage, owners, top, n_docs, n_terms),
                               _FOUND if stage == owners - 1 else _STATE))
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(named, ["bundle", "slot"]).select(
        F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
