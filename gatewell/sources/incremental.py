"""Loading only what is new since the last load."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from gatewell.functions import literal, quoted


def new_rows(source: DataFrame, target: DataFrame, time: str, key: str,
             look_back: datetime.timedelta = datetime.timedelta(0)) -> DataFrame:
    """Source rows the target does not have yet, judged by its latest time.

    The latest time is one value and becomes a literal, so the filter reaches the file scan. Rows
    from ``look_back`` before that time up to it may have arrived late and are compared by key, and
    so are rows without a time; null keys are equal. A target whose rows have no time at all knows
    rows by key only. Running it again after the rows are appended finds nothing.
    """
    seen = target.agg(F.max(time).alias("latest"), F.count(F.lit(1)).alias("rows")).first()
    latest = seen["latest"]
    if seen["rows"] == 0:
        return source
    if latest is None:
        return _unknown(source, target, key)
    at = literal(latest, source.schema[time].dataType)
    since = literal(latest - look_back, source.schema[time].dataType)
    when = F.col(quoted(time))
    unsure = (when >= since) & (when <= at) | when.isNull()
    return source.where(when > at).unionByName(
        _unknown(source.where(unsure), target.where(unsure), key))


def _unknown(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    known = target.select(F.col(quoted(key)).alias("gatewell_known"))
    return source.join(known, F.col(quoted(key)).eqNullSafe(F.col("gatewell_known")), "left_anti")
