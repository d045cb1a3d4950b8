"""Find equal keys by a range-partitioned sort, so that one very frequent key is split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables in which no group is cut, from batches sorted by the integer columns ``keys``."""
    kept: list[pa.RecordBatch] = []

    def last(batch):
        return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        edge = last(batch)
        same = np.ones(batch.num_rows, bool)
        for k, value in zip(keys, edge):
            same &= batch.column(k).to_numpy() == value
        start = batch.num_rows - int(same.sum())
        if start == 0 and kept and last(kept[-1]) == edge:
            kept.append(batch)  # a group over several batches
            continue
        ready = pa.Table.from_batches([*kept, batch.slice(0, start)])
        if ready.num_rows:
            yield ready
        kept = [batch.slice(start)]
    if kept:
        yield pa.Table.from_batches(kept)


def _with_equal_neighbour(key: str):
    def rows_of(batches):
        held, before, start = None, None, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                after = batch.column(key)[0].as_py()
                yield _chosen(held, key, before, after, start, False)
                before, start = held.column(key)[held.num_rows - 1].as_py(), False
            held = batch
        if held is not None:
            yield _chosen(held, key, before, None, start, True)
    return rows_of


def _chosen(batch, key, before, after, first: bool, last: bool) -> pa.RecordBatch:
    values = batch.column(key).to_numpy()
    equal = values[1:] == values[:-1]
    keep = np.zeros(len(values), bool)
    keep[1:] |= equal
    keep[:-1] |= equal
    keep[0] |= first or before == values[0]
    keep[-1] |= last or after == values[-1]
    return batch.filter(pa.array(keep))


def maybe_repeated(frame: DataFrame, key: str, *others: str) -> DataFrame:
    """All rows whose ``key`` occurs more than once, and at most two further rows per partition.

    Spark samples splitters and deals the rows out by range; ``others`` belong to the range, so the
    rows of one key may lie in several partitions. Each partition is sorted and a row is kept if a
    neighbour has its key. What lies beyond a partition's first and last row is unknown there, so
    those two are kept as well: callers count again among the few rows that are left.
    """
    dealt = frame.repartitionByRange(key, *others).sortWithinPartitions(key, *others)
    return dealt.mapInArrow(_with_equal_neighbour(key), frame.schema)
