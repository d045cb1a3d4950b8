"""Raw rows to staging rows: trimming, casting, keeping the latest, setting bad rows aside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.operators.ranking import top_per_group


def tag_violations(df: DataFrame, rules: Mapping[str, Column], out: str = "violations") -> DataFrame:
    """Add the names of the rules a row breaks. A rule that is null for a row counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name))
              for name, rule in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def quarantine_split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``violations``). Both come from the same narrow pass."""
    tagged = tag_violations(df, rules)
    return (tagged.where(F.size("violations") == 0).drop("violations"),
            tagged.where(F.size("violations") > 0))


def staging_clean(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column],
                  trim: Sequence[str] = (), lower: Sequence[str] = (),
                  casts: Mapping[str, Column] | None = None) -> DataFrame:
    """Trim and lower text, cast, and keep the latest row per key.

    Exact duplicates share their key, so keeping one row per key removes them too.
    """
    changes: dict[str, Column] = {}
    for name in {*trim, *lower}:
        value = F.col(quoted(name))
        if name in trim:
            value = F.trim(value)
        changes[name] = F.lower(value) if name in lower else value
    changes.update(casts or {})
    return top_per_group(df.withColumns(changes), keys, order_by, 1, "_rank").drop("_rank")
