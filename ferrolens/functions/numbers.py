"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def shown(x: Column | str, digits: int) -> Column:
    """A number as text with some decimal places, half up; the number counts to ten places, so that noise of sums doesn't show."""
    return F.format_string(f"%.{digits}f", F.round(x, 10))


def shown_sql(x: str, digits: int) -> str:
    """The same in DuckDB, whose printf rounds the binary value (1.45 as 1.4)."""
    return f"cast(cast(round(cast({x} as decimal(28, 10)), {digits}) as decimal(28, {digits})) as varchar)"


def rounded_sql(x: str, digits: int) -> str:
    """Half up in DuckDB of a number that counts to ten places."""
    return f"cast(round(cast({x} as decimal(28, 10)), {digits}) as double) + 0.0"


def micros(x: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp."""
    return F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)
