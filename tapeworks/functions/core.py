"""Small column helpers shared by all operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less UTC timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts))


def bar_open(us: str | Column, seconds: int) -> Column:
    """Open time (epoch s) of the UTC grid bar that holds a microsecond time."""
    u = col(us)
    return ((u - F.pmod(u, F.lit(seconds * 1_000_000))) / 1_000_000).cast("long")


def grid(t: str | Column, seconds: int) -> Column:
    """Epoch second rounded down to a grid."""
    c = col(t)
    return (c - F.pmod(c, F.lit(seconds))).cast("long")


def day_text(us: str | Column) -> Column:
    """UTC day of a microsecond time as ``YYYY-MM-DD``."""
    u = col(us)
    days = ((u - F.pmod(u, F.lit(86_400_000_000))) / 86_400_000_000).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def iso_text(seconds: str | Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DDTHH:MM:SSZ``."""
    s = F.floor(col(seconds)).cast("long")
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("SECOND", s, base), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``; NULL where ``b`` is 0 or NULL."""
    return F.try_divide(col(a), col(b))


def known(cond: Column) -> Column:
    """A filter that fails closed: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL, so comparisons fail closed."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def rounded(**cols: tuple[str | Column, int]) -> list[Column]:
    return [F.round(col(c), n).alias(name) for name, (c, n) in cols.items()]
