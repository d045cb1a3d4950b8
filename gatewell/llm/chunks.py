"""Substring dedup by content-defined chunks: cuts by a gear rolling hash, copies by digest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.llm.sorting import maybe_repeated
from gatewell.llm.textcode import BYTE_VALUE, Texts, slices, sliding_least
from gatewell.session import materialize

REACH = 24        # a cut is the least gear hash within this many bytes to either side
LONGEST = 4096    # text without cuts, such as one character repeated, is cut after so many bytes
LEAST_RUN = 1     # shorter runs of repeated chunks are left alone; every chunk counts
GEAR_BYTES = 32
GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
NO_ID = -(1 << 63)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the last 32 bytes' gear values, each shifted by its distance.

    Shifting one to the left per byte pushes a byte out after 32 of them; the sums over 1, 2, 4, ...
    bytes are put together instead of rolling byte by byte.
    """
    sums, width = GEAR[data], 1
    while width < GEAR_BYTES:
        sums[width:] += sums[:-width] << np.uint32(width)
        width *= 2
    return sums


def cut_points(texts: Texts, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Where chunks begin, each text's start included, in order."""
    data, bounds = texts.data, texts.bounds
    n = len(data)
    starts = bounds[:-1][np.diff(bounds) > 0]
    if n == 0:
        return starts
    around = 2 * reach + 1
    # The multiplier spreads the bits: low ones depend on few bytes.
    place = sliding_least(gear_hashes(data) * np.uint32(0x9E3779B1), around)
    cuts = np.flatnonzero(place == np.arange(len(place)) + reach) + reach
    # A cut may depend on bytes of its own text only.
    text = np.searchsorted(bounds, cuts, side="right") - 1
    own = (cuts - bounds[text] >= reach + GEAR_BYTES) & (bounds[text + 1] - cuts > reach)
    points = np.union1d(starts, cuts[own] + 1)
    size = np.diff(np.append(points, n))
    extra = (size - 1) // longest
    if extra.any():
        long = np.flatnonzero(extra)
        more = np.concatenate([points[k] + longest * np.arange(1, extra[k] + 1) for k in long])
        points = np.union1d(points, more)
    return points


def _chunks(reach: int, longest: int):
    def rows_of(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                begin = cut_points(texts, reach, longest)
                if len(begin) == 0:
                    continue
                end = np.append(begin[1:], len(texts.data))
                body = texts.data.tobytes()
                digest = np.frombuffer(b"".join(
                    [hashlib.blake2b(body[a:b], digest_size=16).digest()
                     for a, b in zip(begin.tolist(), end.tolist())]), dtype="<i8").reshape(-1, 2)
                text = np.searchsorted(texts.bounds, begin, side="right") - 1
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(digest[:, 0])),
                     pa.array(np.ascontiguousarray(digest[:, 1])),
                     part.column("key").take(at), part.column("id").take(at),
                     pa.array((begin - texts.bounds[text]).astype(np.int64)),
                     pa.array((end - begin).astype(np.int32))],
                    names=["digest", "digest_2", "key", "id", "start", "size"])
    return rows_of


def _kept(least_run: int):
    def rows_of(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                column = part.column("chunks")
                offsets = np.asarray(column.offsets)
                flat = column.flatten()
                present = column.is_valid().to_numpy(zero_copy_only=False)
                start, size, first = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                rows = []
                for k in range(part.num_rows):
                    body = texts.data[texts.bounds[k]:texts.bounds[k + 1]]
                    some = slice(offsets[k] - offsets[0], offsets[k + 1] - offsets[0])
                    rows.append(_without(body, start[some], size[some], first[some], least_run)
                                if present[k] else
                                (len(body), 0, 0, 0, hashlib.sha256(body.tobytes()).hexdigest()))
                total, repeated, removed, spans, digest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[pa.array(c, pa.int64())
                                          for c in (total, repeated, removed, spans)],
                     pa.array(digest)],
                    names=["id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256"])
    return rows_of


def _without(body, start, size, first, least_run):
    order = np.argsort(start)
    start, size, first = start[order], size[order], first[order]
    end = start + size
    # Chunks that touch are one run.
    run = np.cumsum(np.append([0], start[1:] != end[:-1]))
    keep = np.bincount(run, size)[run] >= least_run
    gone = np.zeros(len(body), bool)
    for a, b in zip(start[keep & ~first], end[keep & ~first]):
        gone[a:b] = True
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return (len(body), int(size[keep].sum()), int(gone.sum()), spans,
            hashlib.sha256(body[~gone].tobytes()).hexdigest())


def chunk_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                reach: int = REACH, longest: int = LONGEST, least_run: int = LEAST_RUN) -> DataFrame:
    """Per document: n_bytes, n_repeated, n_removed, n_spans (removed runs) and kept_sha256.

    Texts are taken as UTF-8 and cut where the gear hash is the least of all within ``reach`` bytes,
    so a cut depends on some 80 bytes around it only and an insertion shifts no other cut. A chunk
    is repeated if its digest occurs more than once anywhere. Runs of touching repeated chunks of
    at least ``least_run`` bytes count as n_repeated; of these, all chunks but the first of their
    digest (smallest id, then place) are removed.

    Digests are dealt out by range and sorted, so one very frequent chunk is split over partitions.
    Texts are shuffled once, to meet their repeated chunks.

    Null and empty texts have no chunks. Rows that repeat each other are documents of their own;
    where the first chunk's place is tied between such rows, the copies of both are kept. A null
    id sorts before all others and stays null. An empty table gives no rows.
    """
    body = F.coalesce(F.col(quoted(text_column)), F.lit(""))
    source = docs.select(F.xxhash64(F.col(quoted(id_column)), body).alias("key"),
                         F.coalesce(F.col(quoted(id_column)).cast("bigint"),
                                    F.lit(NO_ID)).alias("id"), body.alias("text"))
    chunks = source.mapInArrow(
        _chunks(reach, longest), "digest bigint, digest_2 bigint, key bigint, id bigint, "
                                 "start bigint, size int")
    chunks = materialize(maybe_repeated(chunks, "digest", "key", "start"), "chunks")
    groups = (chunks.groupBy("digest", "digest_2")
              .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "start")).alias("top"))
              .where("copies > 1").select("digest", "digest_2", "top"))
    groups = materialize(groups, "chunk-groups")
    first = F.struct("id", "start") == F.col("top")
    repeated = (chunks.join(groups, ["digest", "digest_2"])
                .groupBy("key", "id").agg(F.collect_set(F.struct("start", "size", first.alias("first")))
                                          .alias("chunks")))
    return (source.join(repeated, ["key", "id"], "left").select("id", "text", "chunks")
            .mapInArrow(_kept(least_run), "id bigint, n_bytes bigint, n_repeated bigint, "
                                          "n_removed bigint, n_spans bigint, kept_sha256 string")
            .withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
            .withColumnRenamed("id", id_column))
