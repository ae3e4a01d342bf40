"""Calendar buckets and codec strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col


def day_bucket(ts: Column | str, now: Column | str) -> Column:
    """Whole days from ``ts`` back from ``now``: 0 is today, negative is the future."""
    return F.datediff(F.to_date(col(now)), F.to_date(col(ts)))


def week_start(ts: Column | str) -> Column:
    """The Sunday on or before ``ts``."""
    day = F.to_date(col(ts))
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_bucket(ts: Column | str, now: Column | str) -> Column:
    # Both ends are Sundays, so the difference is a multiple of seven.
    return (F.datediff(week_start(now), week_start(ts)) / 7).cast("int")


def month_bucket(ts: Column | str, now: Column | str) -> Column:
    def index(c):
        return F.year(col(c)) * 12 + F.month(col(c))

    return index(now) - index(ts)


def codec_of(text: Column | str) -> Column:
    """Codec name of ``name`` or ``name:level``; empty or NULL means ``none``."""
    name = F.regexp_replace(F.coalesce(col(text), F.lit("")), "^([^:]+):.*$", "$1")
    return F.when(name == "", "none").otherwise(name)


def level_of(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(text), F.lit("")), "^[^:]+:(.*)$", 1), F.lit("")).try_cast("int")
