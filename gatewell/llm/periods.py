"""Periodic runs of words: suffix classes united by falling common prefix, with ordered positions."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.llm.textcode import NON_SPACE, mixed, run_hashes, slices, whole_starts, words_of

LEAST_LENGTH = 6
LEAST_EXPONENT = 4


def _ranked(hashes: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, and where each suffix's text ends.

    A suffix ends with its text, and texts differ in their first word, so no class crosses texts.
    The last ranks are all different: they are the order of the suffixes.
    """
    n = len(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    place = np.arange(n)
    rank = np.unique(mixed(hashes + mixed(text.astype(np.uint64) + np.uint64(1))),
                     return_inverse=True)[1]
    levels, width = [rank.astype(np.int32)], 1
    while n and int(rank.max()) + 1 < n:
        after = place + width
        inside = after < end
        second = np.zeros(n, np.int64)
        second[inside] = rank[after[inside]] + 1
        rank = np.unique(rank.astype(np.int64) * (n + 1) + second, return_inverse=True)[1]
        levels.append(rank.astype(np.int32))
        width *= 2
    return levels, end


def _common_prefixes(levels: list[np.ndarray], end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that neighbours of the suffix order share, by descending powers of two."""
    left, right = order[:-1], order[1:]
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = np.flatnonzero((a < end[left]) & (b < end[right]))
        same = levels[k][a[inside]] == levels[k][b[inside]]
        common[inside[same]] += 1 << k
    return common


def _seeds(order, common, before, least: int, least_length: int, least_exponent: int):
    """Unite the classes of neighbouring suffixes, longest common prefix first.

    A class is an ordered list of positions. When two classes meet at a common prefix of l words,
    every pair of positions that become neighbours at a distance d shares exactly l words, so
    d + l words from the first have period d, and no longer stretch to the right. It is kept if it
    is long enough and the word before does not continue it: then it is a run, and d is its least
    period, as positions at a smaller one would have stood between the two.
    """
    pick = np.flatnonzero(common >= least)
    if len(pick) == 0:
        return []
    involved = np.unique(np.concatenate((pick, pick + 1)))
    left = np.searchsorted(involved, pick)
    rank = np.argsort(-common[pick], kind="stable")
    joins = zip(left[rank].tolist(), common[pick][rank].tolist())
    members = [[p] for p in order[involved].tolist()]
    parent = list(range(len(members)))
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def seed(p: int, q: int, l: int) -> None:
        d = q - p
        if (least_exponent - 1) * d <= l and d + l >= least_length and before[p] != before[q]:
            found.append((p, d + l, d))

    for a, l in joins:
        a, b = root(a), root(a + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        last = len(small) - 1
        for j, x in enumerate(small):
            k = bisect_left(large, x)
            if k and (j == 0 or large[k - 1] > small[j - 1]):
                seed(large[k - 1], x, l)
            if k < len(large) and (j == last or large[k] < small[j + 1]):
                seed(x, large[k], l)
        if len(small) * 32 < len(large):
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            large += small
            large.sort()  # two ordered runs are merged in linear time
        parent[b], members[b] = a, []
    return found


def runs_of(hashes: np.ndarray, first: np.ndarray, least_length: int = LEAST_LENGTH,
            least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs in texts whose words have these hashes.

    Texts without a repeated stretch of as many words as any run repeats are left out first.
    """
    least = min(max((least_exponent - 1) * d, least_length - d) for d in range(1, least_length + 1))
    none = np.zeros((0, 4), np.int64)
    start = whole_starts(first, least)
    if len(start) == 0:
        return none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = mixed(run_hashes(hashes, least)[start] + mixed(text[start].astype(np.uint64)))
    order = np.argsort(grams)
    twice = order[1:][grams[order][1:] == grams[order][:-1]]
    chosen = np.unique(text[start[twice]])
    if len(chosen) == 0:
        return none
    sizes = np.diff(first)[chosen]
    some = np.concatenate(([0], np.cumsum(sizes)))
    index = np.arange(some[-1]) + np.repeat(first[chosen] - some[:-1], sizes)
    levels, end = _ranked(hashes[index], some)
    suffixes = np.argsort(levels[-1])
    before = np.empty(some[-1], np.int64)
    before[1:] = levels[0][:-1]
    before[some[:-1]] = -1 - np.arange(len(chosen))
    found = _seeds(suffixes, _common_prefixes(levels, end, suffixes), before.tolist(), least,
                   least_length, least_exponent)
    if not found:
        return none
    rows = np.array(found, np.int64)
    owner = np.searchsorted(some, rows[:, 0], side="right") - 1
    rows = np.column_stack((chosen[owner], rows[:, 0] - some[owner], rows[:, 1], rows[:, 2]))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = ("id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, "
         "period: bigint>>, collapsed string")


def _collapsed(body: bytes, runs: np.ndarray) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    words = body.split()  # of bytes: at space and 0x09-0x0D only
    if len(runs):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 1] + runs[:, 3], 1)
        np.add.at(gone, runs[:, 1] + runs[:, 2], -1)
        words = [w for w, k in zip(words, np.cumsum(gone).tolist()) if k == 0]
    return b" ".join(words)


def _runs(least_length: int, least_exponent: int):
    def rows_of(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = words_of(texts, NON_SPACE, lower=False)
                rows = runs_of(words.hashes, words.first, least_length, least_exponent)
                edges = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
                bodies = [_collapsed(texts.data[lo:hi].tobytes(), rows[a:b]) for lo, hi, a, b in zip(
                    texts.bounds[:-1], texts.bounds[1:], edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(words.counts(), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)),
                                              pa.StructArray.from_arrays(
                         [pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)],
                         fields=list(_RUN))),
                     pa.array(bodies, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])
    return rows_of


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
                  ) -> DataFrame:
    """Per row: the id, n_words, runs (by start, then period) and the collapsed text.

    Words are runs of anything but white space, compared as they are, by 64-bit hashes. A run is a
    stretch whose words equal those one period further on, that no neighbouring word continues. Its
    period is its smallest one, at least 2 * period long; here at least ``least_exponent`` periods
    and ``least_length`` words. In the collapsed text every word that some run holds after its
    first period is left out; the others are joined by one space.

    Each text is judged on its own, in slices of a few megabytes: no row is shuffled, and a task
    needs memory for one slice, or for one text that is longer. Time grows with n log(n)^2.

    Null and empty texts have no words, no runs and an empty collapsed text. Null and repeated ids
    are kept, each row by itself. An empty table gives no rows. Other columns play no part.
    """
    if least_exponent < 2:
        raise ValueError("a run needs an exponent of at least 2")
    source = docs.select(F.col(quoted(id_column)).cast("bigint").alias("id"),
                         F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    return (source.mapInArrow(_runs(least_length, least_exponent), _RUNS)
            .withColumnRenamed("id", id_column))
