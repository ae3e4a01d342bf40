"""Increments by a tree of prints: only what differs is compared, only what changed is moved.

Every row has a print of its values, and stands in a bucket given by its key.
A bucket's print is the count, sum and exclusive-or of its rows' prints, and so a
partial aggregate: tasks send one row per bucket, whatever they read. Buckets
whose prints are equal hold equal rows and drop out. Of the rows in the others,
keys and prints are joined; values are fetched last, for changed keys alone.

The prints of a bucket are stored with the snapshot that last changed it, so a
state is described by one table of buckets that names the holder of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import bounded_broadcast, null_safe
from .snapshot import row_fingerprint

#: Rows of a bucket at which one more bit pays, and the most bits: so many bucket rows are sent by a task.
ROWS_PER_BUCKET, MOST_BITS = 1024, 16
#: Directories the prints of a snapshot are written to.
FOLDERS = 64


def bits_for(rows: int) -> int:
    bits = 0
    while bits < MOST_BITS and rows >> bits > ROWS_PER_BUCKET:
        bits += 1
    return bits


def bucket_of(key: list[str], bits: int) -> Column:
    """The first bits of a hash of the key; NULLs have a place of their own."""
    # xxhash64 skips a NULL, so each value is hashed with a flag that tells where one stands.
    spread = F.xxhash64(*[x for c in key for x in (F.col(c).isNull(), F.col(c))])
    return (F.shiftrightunsigned(spread, 64 - bits) if bits else F.lit(0)).cast("int")


def row_prints(df: DataFrame, key: list[str], bits: int) -> DataFrame:
    """``(bucket, <key>, print)``: what is known of a row without its values."""
    columns = sorted(c for c in df.columns if c not in key)
    return df.select(bucket_of(key, bits).alias("bucket"), *key, F.substring(F.unhex(row_fingerprint(columns)), 1, 16).alias("print"))


def bucket_prints(prints: DataFrame, key: list[str]) -> DataFrame:
    """``(bucket, rows, xor, sum)`` of rows' prints, in any order."""
    row = F.xxhash64("print", *[x for c in key for x in (F.col(c).isNull(), F.col(c))])
    return prints.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("xor"), F.sum(row.cast("decimal(38,0)")).alias("sum")
    )


def differing_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Buckets ``(bucket)`` that are in one table only, or whose prints differ."""
    same = old.select("bucket", "rows", "xor", "sum").intersect(new.select("bucket", "rows", "xor", "sum")).select("bucket")
    return old.select("bucket").union(new.select("bucket")).distinct().join(same, "bucket", "left_anti")


def changed_keys(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``(<key>, op)`` from two tables of row prints: I, U or D.

    Keys and prints are joined, never values; keys are unique on both sides.
    """
    left = old.select(*[F.col(c).alias(f"_old_{c}") for c in key], F.col("print").alias("_old"))
    right = new.select(*key, F.col("print").alias("_new"))
    rows = left.join(right, null_safe(left, right, {f"_old_{c}": c for c in key}), "full_outer")
    gone = F.col("_new").isNull()
    op = F.when(F.col("_old").isNull(), "I").when(gone, "D").when(F.col("_old") != F.col("_new"), "U")
    keys = [F.when(gone, F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in key]
    return rows.select(*keys, op.alias("op")).where(F.col("op").isNotNull())


def fetch_changes(df: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``(<key>, op, <values>)``: the rows of ``df`` under changed keys, and a row without values for each deleted one.

    The keys are broadcast if they measure small; then no row of ``df`` moves.
    """
    values = [c for c in df.columns if c not in key]
    live = changes.where("op <> 'D'").select(*[F.col(c).alias(f"_key_{c}") for c in key], "op")
    live = bounded_broadcast(live)
    found = df.join(live, null_safe(df, live, {c: f"_key_{c}" for c in key})).select(*key, "op", *values)
    gone = changes.where("op = 'D'").select(*key, "op", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in values])
    return found.unionByName(gone)


def changes_by_prints(
    df: DataFrame, key: list[str], bits: int, old_buckets: DataFrame, old_prints: Callable[[DataFrame], DataFrame], keep: Callable[[str, DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(changed rows, prints of differing buckets, buckets of df)``.

    ``old_prints`` reads the stored row prints of given buckets; ``keep`` writes an
    intermediate table and gives it back, so that it is computed once.
    """
    new_buckets = keep("buckets", bucket_prints(row_prints(df, key, bits), key))
    differing = keep("differing", differing_buckets(old_buckets, new_buckets))
    # At most 2 ** MOST_BITS numbers.
    new = keep("prints", row_prints(df, key, bits).join(F.broadcast(differing), "bucket", "left_semi"))
    changes = keep("changes", changed_keys(old_prints(differing), new, key))
    return fetch_changes(df, changes, key), new, new_buckets
