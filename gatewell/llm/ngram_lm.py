"""Stupid-backoff language model: counts of n-grams over all documents, scored document by document.

N-grams are hashed. Documents are dealt into chunks; each chunk sends its distinct n-grams with
their counts to the part of the count table that owns the hash, packed as arrays, and the part adds
them up and sends the totals back in the same order. So the tables are built and joined in one
exchange each way, an n-gram costs a few bytes there, and one that is in every document costs one
entry per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.llm.sorting import whole_groups
from gatewell.llm.textcode import (
    ALNUM, mixed, run_edges, run_hashes, signed, texts_of, whole_starts, words_of,
)

ORDER = 3        # of the registered model
BACKOFF = 0.4
CHUNK_BYTES = 2 << 20
PART_BYTES = 16 << 20
UNSEEN = 0.5     # what a word that no other document has counts as


def _grams(texts, order: int):
    """Words of the texts, and for each n the n-grams' hashes and where they start.

    The empty gram (n = 0) is at every word, so its count is the number of words.
    """
    words = words_of(texts, ALNUM)
    grams = []
    for n in range(order + 1):
        start = whole_starts(words.first, max(n, 1))
        tag = mixed(np.array([n], np.uint64))[0]
        value = (np.zeros(len(start), np.uint64) if n == 0 else words.hashes if n == 1
                 else run_hashes(words.hashes, n)[start])
        grams.append((mixed(value + tag), start))
    return words, grams


def _edges(values: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's share of the sorted hashes begins; parts own equal ranges of hashes."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(values, bounds), [len(values)]))


def _packed(names: np.ndarray) -> bytes:
    """Sorted hashes as their differences, byte plane by byte plane: of neighbours within a part the
    upper planes are zero, and the shuffle's compression takes those out."""
    steps = np.diff(names, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _requests(order: int, parts: int):
    def rows_of(batches):
        for table in whole_groups(batches, ["chunk"]):
            chunk = table["chunk"].to_numpy()
            edges = run_edges(chunk)
            for lo, hi in zip(edges[:-1], edges[1:]):
                texts = texts_of(table["text"].slice(lo, hi - lo))
                for value, _ in _grams(texts, order)[1]:
                    names, counts = np.unique(value, return_counts=True)
                    at = _edges(names, parts)
                    full = np.flatnonzero(np.diff(at))
                    if len(full) == 0:
                        continue
                    offsets = pa.array(np.append(at[full], len(names)).astype(np.int32))
                    n = len(full)
                    shares = np.split(names, at[full][1:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full.astype(np.int64)), pa.array(np.full(n, chunk[lo])),
                         pa.array([_packed(s) for s in shares], pa.binary()),
                         pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))],
                        names=["part", "chunk", "names", "counts"])
    return rows_of


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    return column.flatten().to_numpy(), offsets - offsets[0]


def _totals(batches):
    """Per part: add up the counts of each n-gram over all chunks, and answer each chunk."""
    for table in whole_groups(batches, ["part"]):
        edges = run_edges(table["part"].to_numpy())
        for lo, hi in zip(edges[:-1], edges[1:]):
            some = table.slice(lo, hi - lo)
            counts, offsets = _lists(some["counts"])
            names = np.concatenate([_unpacked(x.as_buffer()) for chunk in some["names"].chunks
                                    for x in chunk])
            order = np.argsort(names, kind="stable")
            runs = run_edges(names[order])
            sums = np.add.reduceat(counts[order].astype(np.int64), runs[:-1])
            total = np.empty(len(names), np.int64)
            total[order] = np.repeat(sums, np.diff(runs))
            # Names tell which n-gram a list is of; each list keeps its first name for that.
            yield pa.RecordBatch.from_arrays(
                [some["chunk"].combine_chunks(), some["part"].combine_chunks(),
                 pa.array(signed(names[offsets[:-1]])),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(total))],
                names=["chunk", "part", "name", "totals"])


def _scores(order: int, parts: int, backoff: float):
    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(docs["text"])
        words, grams = _grams(texts, order)
        totals, offsets = _lists(answers["totals"])
        lists = {(p, name): k for k, (p, name) in enumerate(
            zip(answers["part"].to_pylist(), answers["name"].to_pylist()))}
        others = []  # per n: at each word, how often the n-gram ending there is in other documents
        for n, (value, start) in enumerate(grams):
            names, code = np.unique(value, return_inverse=True)
            at = _edges(names, parts)
            whole = np.empty(len(names), np.int64)
            shown = signed(names)
            for p in np.flatnonzero(np.diff(at)):
                k = lists[int(p), int(shown[at[p]])]
                whole[at[p]:at[p + 1]] = totals[offsets[k]:offsets[k + 1]]
            pair = words.text[start].astype(np.int64) * len(names) + code
            _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
            count = np.full(len(words.hashes), -1, np.int64)
            count[start + max(n - 1, 0)] = whole[code] - own[back]
            others.append(count)
        score = np.log(np.maximum(others[1], UNSEEN) / np.maximum(others[0], 1))
        seen = np.zeros(len(score), bool)
        for n in range(2, order + 1):
            here = others[n]
            context = np.concatenate(([0], others[n - 1][:-1]))
            known = here > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                longer = np.log(here / context)
            score = np.where(known, longer, np.where(here >= 0, np.log(backoff) + score, score))
            seen = known if n == order else seen
        n = len(texts)
        sums = np.bincount(words.text, score, n).astype(float)
        size = words.counts()
        mean = sums / np.maximum(size, 1)
        return pa.table({
            "id": docs["id"], "n_words": pa.array(size, pa.int64()),
            "n_seen": pa.array(np.bincount(words.text, seen, n).astype(np.int64)),
            "log_score": pa.array(sums),
            "mean_log_score": pa.array(mean, mask=size == 0)})
    return scored


def backoff_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   order: int = 2, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES,
                   part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: id, n_words, n_seen, log_score and mean_log_score (natural logarithms).

    The score of a word is count(n-gram) / count(its context) for the longest n-gram up to
    ``order`` that other documents have, times ``backoff`` for every step down; the last step is
    the word's share of all words, with ``UNSEEN`` in place of a count of 0. Counts are those of
    all documents less the document's own, so a text cannot vouch for itself. n_seen counts words
    whose n-gram of full order is found elsewhere.

    Texts are dealt into chunks by a hash, once; that exchange serves both the requests and the
    scores. Chunks and parts have a bounded size at any size of the input.

    Null and empty texts have no words: log_score 0 and a null mean. Rows with a null or repeated
    id are scored on their own. A row that repeats another counts for it. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(quoted(text_column)), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(body)), F.count(F.lit(1))).first()
    n_bytes = size[0] or 0
    chunks = max(1, n_bytes // chunk_bytes)
    parts = max(1, n_bytes * 4 // part_bytes)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ident = F.col(quoted(id_column)).cast("bigint")
    source = (docs.select(F.pmod(F.xxhash64(ident, body), F.lit(chunks)).alias("chunk"),
                          ident.alias("id"), body.alias("text"))
              .repartition(max(tasks, chunks // 4), "chunk"))
    requests = source.sortWithinPartitions("chunk").mapInArrow(
        _requests(order, parts), "part bigint, chunk bigint, names binary, counts array<int>")
    answers = (requests.repartition(max(tasks, parts // 4), "part").sortWithinPartitions("part")
               .mapInArrow(_totals, "chunk bigint, part bigint, name bigint, totals array<bigint>"))
    return (source.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(_scores(order, parts, backoff),
                          "id bigint, n_words bigint, n_seen bigint, log_score double, "
                          "mean_log_score double")
            .withColumnRenamed("id", id_column))
