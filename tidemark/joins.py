"""Join and aggregation shapes shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import materialize

BROADCAST_BYTES = 64 << 20

_FIXED_WIDTH = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType,
)


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it measures at most ``max_bytes``.

    The size is measured by one aggregation over ``df``. A larger side comes
    back unchanged and joins by shuffle, with AQE splitting skewed partitions.
    """
    width = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        elif isinstance(field.dataType, _FIXED_WIDTH):
            width = width + 8
        else:
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    measured = df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if measured <= max_bytes else df


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a derived table that has one row per key.

    A table that measures small is broadcast. A large one is written out first:
    AQE splits the hot partitions of ``left`` only if both inputs of the join
    are plain shuffles, which an aggregate directly below the join is not.
    """
    side = bounded_broadcast(right)
    return left.join(materialize(right) if side is right else side, on, how)


def null_safe(left: DataFrame, right: DataFrame, on: dict[str, str]) -> Column:
    """Condition of an equi join in which NULL equals NULL; ``on`` maps columns of ``left`` to those of ``right``."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in on.items()])


def fixed_width(df: DataFrame, columns: list[str]) -> bool:
    return all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in columns)


def latest_by(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The payload of the row with the greatest ``order`` per key.

    A partial maximum is taken before the shuffle, so a key that owns a large
    part of the input sends one row per task. Ordering values must be unique
    within a key. Payloads of fixed width stay in the hash aggregate.
    """
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    if len(order) == 1 and fixed_width(df, payload + order):
        return df.groupBy(*keys).agg(*[F.max_by(c, rank).alias(c) for c in payload])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in payload])


def overlay(base: DataFrame, latest: DataFrame, keys: list[str], deleted: str) -> DataFrame:
    """``base`` with the rows of ``latest`` put over it by key.

    ``latest`` has one row per changed key, with a boolean column ``deleted``.
    Only the changed keys are matched against the base, so unchanged base rows
    are never sorted or aggregated, and stay in place if the keys are small.
    ``latest`` is read three times and therefore materialized once.
    """
    latest = materialize(latest)
    changed_keys = bounded_broadcast(latest.select(*[F.col(c).alias(f"_changed_{c}") for c in keys]))
    kept = base.join(changed_keys, null_safe(base, changed_keys, {c: f"_changed_{c}" for c in keys}), "left_anti")
    written = latest.where(~F.col(deleted)).select(*base.columns)
    return kept.unionByName(written)
