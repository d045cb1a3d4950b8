"""Repeated byte strings by sorting suffixes: a sparse set of them, with the text around each.

A suffix for every byte would be many times the input. Of the grams in each window of ``span``
bytes, the one with the least hash is the window's anchor; equal windows have the same anchor at the
same place, wherever they are. So only suffixes that begin at anchors are dealt out and sorted, and
each stands for the windows that it is the anchor of.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.llm.sorting import maybe_repeated, whole_groups
from gatewell.llm.textcode import (
    Texts, byte_run_hashes, mixed, run_edges, signed, slices, sliding_least, texts_of, whole_starts,
)
from gatewell.session import materialize

SPAN = 200
GRAM = 40
TOKEN = 50        # leading tokens of this many bytes are the characters of the local sort
CONTEXT_BYTES = 2 << 20


def _anchors(span: int, gram: int):
    def rows_of(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                windows = whole_starts(texts.bounds, span)
                if len(windows) == 0:
                    continue
                grams = byte_run_hashes(texts.data, gram)
                place = sliding_least(grams, span - gram + 1)[windows]
                edges = run_edges(place)
                begin = edges[:-1]
                first = windows[begin]
                text = np.searchsorted(texts.bounds, first, side="right") - 1
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(grams[place[begin]])), part.column("key").take(at),
                     part.column("id").take(at),
                     pa.array((first - texts.bounds[text]).astype(np.int64)),
                     pa.array(np.diff(edges).astype(np.int32))],
                    names=["token", "key", "id", "start", "windows"])
    return rows_of


def _gathered(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Texts:
    """The byte ranges of ``data``, one after another."""
    bounds = np.concatenate(([0], np.cumsum(length)))
    index = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], length)
    return Texts(data[index], bounds)


def _contexts(span: int):
    """For each anchor that may be repeated: the bytes of the windows it stands for."""
    def rows_of(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                marks = part.column("marks")
                counts = np.diff(np.asarray(marks.offsets))
                flat = marks.flatten()
                token, start, windows = (flat.field(k).to_numpy() for k in range(3))
                text = np.repeat(np.arange(part.num_rows), counts)
                begin = texts.bounds[text] + start
                length = windows.astype(np.int64) + span - 1
                step = max(1, CONTEXT_BYTES // (2 * span))
                for k in range(0, len(begin), step):
                    some = slice(k, k + step)
                    around = _gathered(texts.data, begin[some], length[some])
                    at = pa.array(text[some])
                    body = pa.Array.from_buffers(pa.binary(), len(at), [
                        None, pa.py_buffer(around.bounds.astype(np.int32)),
                        pa.py_buffer(around.data)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token[some]), pa.array(_names(around)),
                         part.column("key").take(at), part.column("id").take(at),
                         pa.array(start[some]), body],
                        names=["token", "name", "key", "id", "start", "body"])
    return rows_of


def _names(texts: Texts) -> np.ndarray:
    """A hash of each text's bytes."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
        mixed(texts.data.astype(np.uint64) + (np.arange(len(texts.data), dtype=np.uint64)
              - np.repeat(texts.bounds[:-1], np.diff(texts.bounds)).astype(np.uint64))
              * np.uint64(256)), dtype=np.uint64)))
    return signed(mixed(sums[texts.bounds[1:]] - sums[texts.bounds[:-1]]
                        + np.diff(texts.bounds).astype(np.uint64)))


def with_equal(tokens: list[np.ndarray]) -> np.ndarray:
    """Which items have an equal one, by multikey quicksort over ``tokens`` (first one first).

    Items are sorted by a token; runs of equal ones are sorted by the next, and items alone in
    their run are never looked at again.
    """
    alive = np.arange(len(tokens[0]))
    run = np.zeros(len(alive), np.int64)
    for token in tokens:
        value = mixed(token[alive] + mixed(run.astype(np.uint64)))
        order = np.argsort(value)
        edges = run_edges(value[order])
        length = np.diff(edges)
        number = np.repeat(np.arange(len(length)), length)
        shared = np.repeat(length > 1, length)
        alive, run = alive[order][shared], number[shared]
        if len(alive) == 0:
            break
    found = np.zeros(len(tokens[0]), bool)
    found[alive] = True
    return found


def _resolved(span: int, buckets: int):
    """Compare the windows within each group of suffixes with the same leading token.

    Gives spans of windows that are repeated within the group. The partition's first and last group
    may go on in other partitions; their windows are also given as hashes, dealt into buckets:
    those without an equal one here with their owners, and of the others the hash alone.
    """
    def rows_of(batches):
        whole = whole_groups(batches, ["token"])
        first, held = True, next(whole, None)
        while held is not None:
            table, held = held, next(whole, None)
            yield from _group_rows(table.combine_chunks(), span, buckets, first, held is None)
            first = False
    return rows_of


_OPEN = pa.struct([("hash", pa.int64()), ("key", pa.int64()), ("id", pa.int64()),
                   ("start", pa.int64())])
_RESOLVED = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("id", pa.int64()),
                       ("start", pa.int64()), ("end", pa.int64()), ("open", pa.list_(_OPEN))])
_RESOLVED_SQL = ("bucket int, key bigint, id bigint, start bigint, end bigint, "
                 "open array<struct<hash: bigint, key: bigint, id: bigint, start: bigint>>")


def _group_rows(table: pa.Table, span: int, buckets: int, first: bool, last: bool):
    token = table["token"].to_numpy()
    name, start = table["name"].to_numpy(), table["start"].to_numpy()
    key, ident = table["key"], table["id"]
    bodies = texts_of(table["body"])
    # Suffixes with the very same bytes around them settle each other and are compared once.
    order = np.lexsort((name, token))
    same = (token[order][1:] == token[order][:-1]) & (name[order][1:] == name[order][:-1])
    copied = np.zeros(len(order), bool)
    copied[order[1:]] |= same
    copied[order[:-1]] |= same
    one = np.ones(len(order), bool)
    one[order[1:]] = ~same
    rows = np.flatnonzero(one)
    few = _gathered(bodies.data, bodies.bounds[rows], np.diff(bodies.bounds)[rows])
    windows = whole_starts(few.bounds, span)
    owner = np.searchsorted(few.bounds, windows, side="right") - 1
    grams = byte_run_hashes(few.data, TOKEN)
    offsets = list(range(0, span - TOKEN + 1, TOKEN)) + ([span - TOKEN] if span % TOKEN else [])
    lead = signed_to_unsigned(token[rows])
    hit = with_equal([mixed(grams[windows] ^ lead[owner])] + [grams[windows + k] for k in offsets[1:]])
    hit |= copied[rows][owner]
    at = windows - few.bounds[owner]

    # Runs of neighbouring repeated windows of one suffix are one span.
    chosen = np.flatnonzero(hit & ~copied[rows][owner])
    cut = np.ones(len(chosen) + 1, bool)
    if len(chosen):
        cut[1:-1] = (np.diff(chosen) != 1) | (owner[chosen][1:] != owner[chosen][:-1])
        lo, hi = chosen[cut[:-1]], chosen[np.flatnonzero(cut[1:])]
        row = rows[owner[lo]]
        yield _span_batch(key, ident, row, start[row] + at[lo], start[row] + at[hi] + span)
    row = np.flatnonzero(copied)
    if len(row):
        yield _span_batch(key, ident, row, start[row], start[row] + np.diff(bodies.bounds)[row])

    ends = np.zeros(len(rows), bool)
    if first:
        ends |= token[rows] == token[0]
    if last:
        ends |= token[rows] == token[-1]
    chosen = np.flatnonzero(ends[owner])
    if len(chosen) == 0:
        return
    value = byte_run_hashes(few.data, span)[windows[chosen]]
    value = signed(mixed(value ^ lead[owner[chosen]]))
    lone = ~hit[chosen]
    told = np.unique(value[~lone])
    mine = owner[chosen[lone]]
    row = rows[mine]
    value = np.concatenate([value[lone], told])
    blank = np.zeros(len(told), np.int64)
    pick = pa.array(row)
    pieces = [value, np.concatenate([key.take(pick).to_numpy(), blank]),
              np.concatenate([ident.take(pick).to_numpy(), blank]),
              np.concatenate([start[row] + at[chosen[lone]], blank - 1])]
    bucket = value % buckets
    order = np.argsort(bucket, kind="stable")
    edges = run_edges(bucket[order])
    n = len(edges) - 1
    none = pa.nulls(n, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[order][edges[:-1]].astype(np.int32)), none, none, none, none,
         pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(
             [pa.array(p[order]) for p in pieces], fields=list(_OPEN)))], schema=_RESOLVED)


def signed_to_unsigned(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64, copy=False).view(np.uint64)


def _span_batch(key, ident, row, start, end) -> pa.RecordBatch:
    n, pick = len(row), pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int32()), _flat(key.take(pick)), _flat(ident.take(pick)), pa.array(start),
         pa.array(end), pa.nulls(n, pa.list_(_OPEN))], schema=_RESOLVED)


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _met(span: int):
    """Windows of groups that lie in several partitions: those whose hash came from two of them."""
    def rows_of(batches):
        for table in whole_groups(batches, ["bucket"]):
            flat = _flat(table["open"]).flatten()
            value, key, ident, start = (flat.field(k).to_numpy() for k in range(4))
            order = np.argsort(value, kind="stable")
            edges = run_edges(value[order])
            length = np.diff(edges)
            at = order[np.repeat(length > 1, length)]
            at = at[start[at] >= 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at]), pa.array(ident[at]), pa.array(start[at]),
                 pa.array(start[at] + span)], names=["key", "id", "start", "end"])
    return rows_of


def _kept(batches):
    for batch in batches:
        for part, texts in slices(batch, "text"):
            counts = part.column("spans")
            offsets = np.asarray(counts.offsets)
            flat = counts.flatten()
            start, end = (flat.field(k).to_numpy() for k in range(2))
            present = counts.is_valid().to_numpy(zero_copy_only=False)
            rows = []
            base = offsets[0]
            for k in range(part.num_rows):
                body = texts.data[texts.bounds[k]:texts.bounds[k + 1]]
                gone = np.zeros(len(body) + 1, np.int32)
                if present[k]:
                    some = slice(offsets[k] - base, offsets[k + 1] - base)
                    np.add.at(gone, start[some], 1)
                    np.add.at(gone, end[some], -1)
                gone = np.cumsum(gone)[:-1] > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(body), int(gone.sum()), runs,
                             hashlib.sha256(body[~gone].tobytes()).hexdigest()))
            size, removed, runs, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(digest)],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


NO_ID = -(1 << 63)


def repeated_spans(source: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, id, start, end) byte spans of ``source`` (key, id, text) that hold repeated windows."""
    spark = source.sparkSession
    anchors = materialize(source.mapInArrow(
        _anchors(span, gram), "token bigint, key bigint, id bigint, start bigint, windows int"),
        "suffix-anchors")
    marks = (maybe_repeated(anchors, "token", "key", "start").groupBy("key", "id")
             .agg(F.collect_list(F.struct("token", "start", "windows")).alias("marks")))
    contexts = (source.join(marks, ["key", "id"]).select("key", "id", "text", "marks")
                .mapInArrow(_contexts(span), "token bigint, name bigint, key bigint, id bigint, "
                                             "start bigint, body binary"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resolved = materialize(
        contexts.repartitionByRange("token", "name", "key", "start")
        .sortWithinPartitions("token", "name", "key", "start")
        .mapInArrow(_resolved(span, buckets), _RESOLVED_SQL), "suffix-spans")
    met = (resolved.where("bucket IS NOT NULL").select("bucket", "open").repartition("bucket")
           .sortWithinPartitions("bucket")
           .mapInArrow(_met(span), "key bigint, id bigint, start bigint, end bigint"))
    return resolved.where("bucket IS NULL").select("key", "id", "start", "end").unionByName(met)


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte is removed if a string of ``span`` bytes that covers it also starts anywhere else in the
    texts, taken as UTF-8; copies may overlap, all of them are removed, and strings never cross
    documents.

    Suffixes at anchors are dealt out by their leading token with sampled splitters, twice: first
    as narrow rows, to find those whose token is repeated at all, then with the bytes around them.
    Each partition is sorted and compared locally; a group of suffixes that goes on in another
    partition is settled by hashes of its windows, so a string in a third of all documents is
    never in one task.

    Null and empty texts keep nothing and lose nothing. Rows that repeat each other are documents
    of their own: their texts repeat. A null id is kept as null. An empty table gives no rows.
    """
    body = F.coalesce(F.col(quoted(text_column)), F.lit(""))
    source = docs.select(F.xxhash64(F.col(quoted(id_column)), body).alias("key"),
                         F.coalesce(F.col(quoted(id_column)).cast("bigint"),
                                    F.lit(NO_ID)).alias("id"), body.alias("text"))
    spans = (repeated_spans(source, span, gram).groupBy("key", "id")
             .agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    return (source.join(spans, ["key", "id"], "left").select("id", "text", "spans")
            .mapInArrow(_kept, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
                               "kept_sha256 string")
            .withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
            .withColumnRenamed("id", id_column))
