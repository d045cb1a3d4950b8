"""N-gram Jaccard join: the global order of n-grams cut into fragments, overlaps summed per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.llm.components import components
from gatewell.llm.sorting import maybe_repeated
from gatewell.llm.textcode import (
    NON_SPACE, mixed, run_edges, run_hashes, signed, slices, whole_starts, words_of,
)
from gatewell.session import materialize

NGRAM = 3
SHARED, OF = 90, 100     # documents are linked when 100 * intersection >= 90 * union
FRAGMENTS = 8
COUNTER_BITS = 20        # the order rests on this many counters (2**20), whatever the input
COUNTER_BLOCK = 14       # a row carries 2**14 of them
_SLOTS = 1 << COUNTER_BITS


def _distinct(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram hash) of all distinct n-grams; a text of fewer words is one n-gram."""
    words = words_of(texts, NON_SPACE)
    counts = words.counts()
    start = whole_starts(words.first, size)
    text, value = [words.text[start]], [run_hashes(words.hashes, size)[start]]
    for short in range(1, size):
        alone = np.flatnonzero(counts == short)
        text.append(alone)
        value.append(run_hashes(words.hashes, short)[words.first[:-1][alone]])
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh]


def _counters(size: int):
    """How many documents of a partition have n-grams of each counter."""
    def rows_of(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                _, value = _distinct(texts, size)
                total += np.bincount((value & np.uint64(_SLOTS - 1)).astype(np.int64),
                                     minlength=_SLOTS)
        yield from _counter_rows(total.reshape(-1, 1 << COUNTER_BLOCK),
                                 np.arange(_SLOTS >> COUNTER_BLOCK))
    return rows_of


def _counter_rows(total: np.ndarray, blocks: np.ndarray):
    some = np.flatnonzero(total.any(axis=1))
    # Counts of a partition are small: 32 bits, unless they need 64.
    kind = "<u4" if total.max(initial=0) < 1 << 32 else "<u8"
    yield pa.RecordBatch.from_arrays(
        [pa.array(blocks[some].astype(np.int64)),
         pa.array([row.astype(kind).tobytes() for row in total[some]], pa.binary())],
        names=["block", "counts"])


def _summed(batches):
    """The sum per block of a partition's rows, read one at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            raw = counts.as_buffer()
            kind = "<u4" if raw.size == 4 << COUNTER_BLOCK else "<u8"
            held = sums.setdefault(block, np.zeros(1 << COUNTER_BLOCK, np.int64))
            held += np.frombuffer(raw, kind).astype(np.int64)
    if sums:
        yield from _counter_rows(np.stack(list(sums.values())), np.array(list(sums)))


def _order_of(source: DataFrame, size: int, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each counter, rare ones first, and the ranks at which fragments begin.

    The driver gets 2**20 counts, at any size of the input. Equally many n-grams fall to a fragment.
    """
    rows = (source.mapInArrow(_counters(size), "block bigint, counts binary")
            .repartition(_SLOTS >> COUNTER_BLOCK, "block")
            .mapInArrow(_summed, "block bigint, counts binary").collect())
    counts = np.zeros((_SLOTS >> COUNTER_BLOCK, 1 << COUNTER_BLOCK), np.int64)
    for row in rows:
        raw = bytes(row["counts"])
        counts[row["block"]] = np.frombuffer(raw, "<u4" if len(raw) == 4 << COUNTER_BLOCK else "<u8")
    counts = counts.ravel()
    order = np.argsort(counts, kind="stable")
    rank = np.empty(_SLOTS, np.uint32)
    rank[order] = np.arange(_SLOTS)
    mass = np.cumsum(counts[order])
    return rank, np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments, side="left")


def _ordered(texts, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct n-grams, sorted within each text, and where each text's begin.

    A key is the rank of the n-gram's counter followed by the other bits of its hash: keys compare
    in the global order, and equal keys are equal hashes.
    """
    text, value = _distinct(texts, size)
    key = (rank[(value & np.uint64(_SLOTS - 1)).astype(np.int64)].astype(np.uint64)
           << np.uint64(64 - COUNTER_BITS)) | (value >> np.uint64(COUNTER_BITS))
    order = np.lexsort((key, text))
    return key[order], np.searchsorted(text, np.arange(len(texts) + 1))


def _names(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The name of each set: a hash of its size and of two sums over its keys."""
    name = np.diff(first).astype(np.uint64)
    for seed in (1, 2):
        total = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(mixed(key ^ mixed(np.array([seed], np.uint64))[0]), out=total[1:])
        name = mixed(name + total[first[1:]] - total[first[:-1]])
    return signed(name)


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def _profiles(size: int, order, shared: int, of: int):
    """Per document the size of its set, the set's name and its prefix: the first n-grams in the
    order, so many that two linked sets have one of them in common."""
    def rows_of(batches):
        rank, _ = order.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                key, first = _ordered(texts, size, rank)
                n = np.diff(first)
                take = np.where(n > 0, n - (shared * n + of - 1) // of + 1, 0)
                edges = np.concatenate(([0], np.cumsum(take)))
                index = np.arange(edges[-1]) + np.repeat(first[:-1] - edges[:-1], take)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), pa.array(_names(key, first)),
                     _lists(signed(key[index]), edges)], names=["id", "n", "node", "prefix"])
    return rows_of


def _segments(size: int, order):
    """Per document and fragment the keys that lie in it."""
    def rows_of(batches):
        rank, pivots = order.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                key, first = _ordered(texts, size, rank)
                node = _names(key, first)
                text = np.repeat(np.arange(len(texts)), np.diff(first))
                rank_of = (key >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
                fragment = np.searchsorted(pivots, rank_of, side="right")
                edges = run_edges(text * (len(pivots) + 1) + fragment)
                head = edges[:-1]
                body = pa.Array.from_buffers(pa.binary(), len(head), [
                    None, pa.py_buffer((edges * 8).astype(np.int32)),
                    pa.py_buffer(np.ascontiguousarray(key))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[text[head]]), pa.array(fragment[head].astype(np.int32)), body],
                    names=["node", "fragment", "keys"])
    return rows_of


def _overlaps(batches):
    """How many keys two segments have in common."""
    for batch in batches:
        both = [len(np.intersect1d(np.frombuffer(a.as_buffer(), "<u8"),
                                   np.frombuffer(b.as_buffer(), "<u8"), assume_unique=True))
                for a, b in zip(batch.column("keys"), batch.column("other"))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("u", "v", "fragment")), pa.array(both, pa.int64())],
            names=["u", "v", "fragment", "both"])


def ngram_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               size: int = NGRAM, shared: int = SHARED, of: int = OF, fragments: int = FRAGMENTS
               ) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest id reachable over links.

    Words are runs of anything but white space after lower-casing A-Z. A document's set are its
    distinct runs of ``size`` words, or its whole sequence if it has fewer, compared by 64-bit
    hashes. Documents are linked when ``of`` * intersection >= ``shared`` * union.

    1. N-grams are put in one global order, about from rare to frequent: by counters of a fixed
       number, then by hash. Any order gives the same result; this one keeps candidates few.
    2. Equal sets are one node. Linked sets share an n-gram of their prefixes; nodes with the same
       n-gram in their prefix are a bucket, found by a sort that splits frequent n-grams.
    3. A bucket's leader is the node that has the n-gram earliest, so the one with the fewest n-grams
       of its own. Each node is first compared with the leader that it shares most buckets with.
    4. In buckets that still hold several components, nodes outside the leader's component are
       compared with those of other components, if sizes and places leave room for enough overlap.
       Nodes of one component are never compared again, so a large group of near copies costs one
       comparison a node.
    5. A comparison cuts both sets at the fragments of the order, counts the overlap of each fragment
       by itself in a join on (node, fragment), and sums the counts per pair.

    Null or empty texts have no n-grams, link with nothing and are their own component. Rows with a
    null id are returned with a null component and link with nothing. Rows that repeat an id are
    documents of their own. An empty table gives no rows. Other columns play no part.
    """
    if not 0 < shared <= of or fragments < 1 or size < 1:
        raise ValueError("the threshold lies above 0 and at most at 1; one fragment and word at least")
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(quoted(id_column)).cast("bigint").alias("id"),
                         F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    order = context.broadcast(_order_of(source, size, fragments))
    profiles = materialize(
        source.mapInArrow(_profiles(size, order, shared, of),
                          "id bigint, n bigint, node bigint, prefix array<bigint>"),
        "fragment-profiles")
    linkable = profiles.where("n > 0 AND id IS NOT NULL")
    nodes = materialize(linkable.groupBy("node").agg(
        F.min("id").alias("rep"), F.first("n").cast("int").alias("n"),
        F.first("prefix").alias("prefix")), "fragment-nodes")
    prefixes = nodes.select("node", "n", F.posexplode("prefix").alias("place", "gram"))
    buckets = materialize(maybe_repeated(prefixes, "gram", "place", "node"), "fragment-buckets")

    def linked(pairs: DataFrame) -> DataFrame:
        return _linked(source, nodes, pairs, _segments(size, order), shared, of)

    earliest = F.min(F.struct("place", "node", "n")).alias("leader")
    leaders = (buckets.groupBy("gram").agg(earliest, F.count(F.lit(1)).alias("members"))
               .where("members > 1").select("gram", "leader.*"))
    leaders = materialize(leaders.select("gram", F.col("node").alias("v"), F.col("n").alias("n_v")),
                          "fragment-leaders")
    near_size = F.expr(f"{of} * least(n, n_v) >= {shared} * greatest(n, n_v)")
    stars = (buckets.join(leaders, "gram").where(near_size & (F.col("node") != F.col("v")))
             .groupBy(F.col("node").alias("u"), "v").agg(
                 F.count(F.lit(1)).alias("grams"), F.first("n").alias("n_u"),
                 F.first("n_v").alias("n_v")))
    best = (stars.groupBy("u").agg(F.max(F.struct("grams", "v", "n_u", "n_v")).alias("top"))
            .select("u", "top.v", "top.n_u", "top.n_v"))
    links = linked(best)
    roots = materialize(components(links), "fragment-roots")

    members = (buckets.join(leaders.select("gram"), "gram", "left_semi")
               .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed_grams = (members.groupBy("gram").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.min_by("root", F.struct("place", "node")).alias("main"))
        .where("lo < hi").select("gram", "main"))
    open_ = materialize(members.join(mixed_grams, "gram"), "fragment-open")
    left = open_.where("root != main").select(
        "gram", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("at_a"),
        F.col("root").alias("root_a"))
    cross = (left.join(open_, "gram")
             .where("root_a != root AND (root = main OR a < node)")
             .where(f"{of} * least(n, n_a) >= {shared} * greatest(n, n_a)")
             .select(F.least("a", "node").alias("u"), F.greatest("a", "node").alias("v"),
                     F.expr("if(a < node, n_a, n)").alias("n_u"),
                     F.expr("if(a < node, n, n_a)").alias("n_v"),
                     F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("place")).alias("room"))
             .groupBy("u", "v").agg(F.count(F.lit(1)).alias("grams"), F.min("room").alias("room"),
                                    F.first("n_u").alias("n_u"), F.first("n_v").alias("n_v"))
             # Up to the last n-gram they share here all common ones are counted; ``room`` is what
             # is left from it on, itself included.
             .where(f"{of + shared} * (grams + room - 1) >= {shared} * (n_u + n_v)")
             .select("u", "v", "n_u", "n_v"))
    roots = components(links.unionByName(linked(cross)))
    return _labelled(profiles, nodes, roots, id_column)


def _linked(source: DataFrame, nodes: DataFrame, pairs: DataFrame, segments_of, shared: int,
            of: int) -> DataFrame:
    """The pairs (u, v) of nodes whose overlaps, summed over the fragments, are large enough."""
    pairs = materialize(pairs, "fragment-pairs")
    sides = materialize(pairs.select(F.col("u").alias("node")).unionByName(
        pairs.select(F.col("v").alias("node"))).distinct(), "fragment-sides")
    asked = nodes.join(sides, "node", "left_semi").select(F.col("rep").alias("id")).distinct()
    # Rows that repeat an id and a text would meet each other in the joins below.
    texts = (source.join(asked, "id", "left_semi").groupBy("id", F.xxhash64("text").alias("key"))
             .agg(F.min("text").alias("text")))
    # Other texts of a repeated id are nodes of no pair; the joins below leave them out.
    segments = materialize(
        texts.select("text").mapInArrow(segments_of, "node bigint, fragment int, keys binary"),
        "fragment-segments")
    met = (pairs.select("u", "v").join(segments.withColumnRenamed("node", "u"), "u")
           .join(segments.select(F.col("node").alias("v"), "fragment", F.col("keys").alias("other")),
                 ["v", "fragment"]))
    partial = (met.select("u", "v", "fragment", "keys", "other")
               .mapInArrow(_overlaps, "u bigint, v bigint, fragment int, both bigint"))
    # A set that several texts of one id share is met more than once, with the same overlap.
    total = (partial.groupBy("u", "v", "fragment").agg(F.max("both").alias("both"))
             .groupBy("u", "v").agg(F.sum("both").alias("both")))
    return materialize(
        pairs.join(total, ["u", "v"]).where(f"{of} * both >= {shared} * (n_u + n_v - both)")
        .select("u", "v"), "fragment-links")


def _labelled(profiles: DataFrame, nodes: DataFrame, roots: DataFrame, id_column: str) -> DataFrame:
    named = nodes.select("node", "rep").join(roots, "node", "left").select(
        "node", "rep", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "fragment-named")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = materialize(named.join(least, "root").select("node", "component"), "fragment-components")
    full = profiles.where("n > 0 AND id IS NOT NULL").join(named, "node")
    lone = profiles.where("n = 0 OR id IS NULL").withColumn("component", F.col("id"))
    return (full.select("id", "n", "component").unionByName(lone.select("id", "n", "component"))
            .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
                    F.col("component").alias("component_id")))
