"""Snapshots of ordinary tables: increments, and rebuilding a chain of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import latest_by, null_safe, overlay


def row_fingerprint(columns: list[str]) -> Column:
    """SHA-256 over all values; NULL and empty text give different prints."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(body.cast("binary"), 256)


def incremental_snapshot(
    parent: DataFrame, current: DataFrame, key: list[str], columns: list[str] | None = None, fingerprints: bool = False
) -> DataFrame:
    """Rows inserted (I), updated (U) or deleted (D) since the parent.

    The parent is the full table or, with ``fingerprints``, ``key`` and the
    ``fingerprint`` of the values. Deleted rows keep their key and have NULL values. Keys are unique on both
    sides, so the full outer join cannot be skewed; a NULL in a key is a value like others.
    Whole rows of both sides are joined; ``changes_by_prints`` moves only prints and changed rows.
    """
    columns = columns or [c for c in current.columns if c not in key]
    held = [F.col(c).alias(f"_old_{c}") for c in key]
    if fingerprints:
        old = parent.select(*held, F.struct("fingerprint").alias("_old"))
        new_value = F.struct(row_fingerprint(columns).alias("fingerprint"))
    else:
        old = parent.select(*held, F.struct(*columns).alias("_old"))
        new_value = F.struct(*columns)
    new = current.select(*key, F.struct(*columns).alias("_row"), new_value.alias("_new"))
    op = (
        F.when(F.col("_old").isNull(), "I")
        .when(F.col("_new").isNull(), "D")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "U")
    )
    keys = [F.when(F.col("_new").isNull(), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in key]
    return (
        old.join(new, null_safe(old, new, {f"_old_{c}": c for c in key}), "full_outer")
        .select(*keys, op.alias("op"), "_row")
        .where(F.col("op").isNotNull())
        .select(*key, "op", *[F.col("_row")[c].alias(c) for c in columns])
    )


def restore_chain(base: DataFrame, increments: list[DataFrame], key: list[str]) -> DataFrame:
    """The table after applying increments (oldest first) to a base snapshot."""
    if not increments:
        return base
    values = [c for c in base.columns if c not in key]
    numbered = [
        inc.select(*key, "op", *values, F.lit(pos).alias("_pos")) for pos, inc in enumerate(increments, start=1)
    ]
    changes = reduce(DataFrame.unionByName, numbered).withColumn("_gone", F.coalesce(F.col("op") == "D", F.lit(False)))
    latest = latest_by(changes, key, ["_pos"], [*values, "_gone"])
    return overlay(base, latest, key, "_gone").select(*base.columns)
