"""Small column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F, types as T

# Accepted spelling of a plain decimal number. Engines disagree on what else a cast may accept
# (exponents, surrounding blanks), so text is tested against this before it is cast.
PLAIN_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"
PLAIN_INTEGER = r"^[+-]?[0-9]+$"


def quoted(name: str) -> str:
    """Back-quote a column name so that dots in it are not read as nesting."""
    return "`" + name.replace("`", "``") + "`"


def money(column: Column | str) -> Column:
    """Money as a decimal, so that sums do not depend on the order of the rows."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def elapsed_micros(start: Column, end: Column) -> Column:
    """Microseconds between two times of one kind.

    The difference is taken as an interval, so times without a zone are not read in the zone of the
    session, whose clock changes would shift them.
    """
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def hours_between(start: Column, end: Column) -> Column:
    return elapsed_micros(start, end).cast("double") / F.lit(3_600_000_000.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def text_number(column: Column, to: str) -> Column:
    """A number read from text; null unless the text is a plain number of that kind."""
    pattern = PLAIN_INTEGER if to in ("int", "bigint", "smallint", "tinyint") else PLAIN_NUMBER
    return F.when(column.rlike(pattern), column.try_cast(to))


def literal(value, kind: T.DataType | None = None) -> Column:
    """A literal of exactly the column's type, so that a filter on it can reach the scan.

    A time without a zone is passed as text: it must not be moved by the zone of the Python process.
    """
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        if kind is None or isinstance(kind, T.TimestampNTZType):
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value) if kind is None else F.lit(value).cast(kind)
