"""Deletion plans. Nothing here deletes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.lsn import SEGMENT_BYTES, segment_no
from ..joins import bounded_broadcast


def prune_objects(plan: DataFrame, objects: DataFrame) -> DataFrame:
    """Every object under an expirable backup, manifests first.

    ``delete_order`` 0 marks the manifest: once it is gone a half-deleted backup
    is no longer listed as valid. One backup may own most objects, so the
    listing stays where it is while the expirable ids fit a broadcast.
    """
    expirable = plan.where(~F.col("kept")).select("backup_id")
    named = objects.withColumn("backup_id", naming.first_part("path")).where(F.col("backup_id").isNotNull())
    is_manifest = F.col("path") == F.concat(F.col("backup_id"), F.lit("/" + naming.MANIFEST_NAME))
    return named.join(bounded_broadcast(expirable), "backup_id", "left_semi").select(
        "backup_id", "path", "size", F.when(is_manifest, 0).otherwise(1).alias("delete_order")
    )


def prune_segments(
    segments: DataFrame, low_water: Column | DataFrame, per_timeline: bool = False, seg_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """Segments that end before the low-water position. A NULL position prunes nothing.

    ``low_water`` is a scalar Column (for instance ``df.scalar()``); with
    ``per_timeline`` it is a table ``(tli, low_water_lsn)``.
    """
    segments = segments.where(F.col("kind") == "segment")
    if not per_timeline:
        return segments.where(F.col("seg_no") < segment_no(low_water, seg_bytes))
    cutoffs = low_water.select("tli", segment_no("low_water_lsn", seg_bytes).alias("_cutoff"))
    return segments.join(bounded_broadcast(cutoffs), "tli").where(F.col("seg_no") < F.col("_cutoff")).drop("_cutoff")


def prune_summary(plan: DataFrame, objects: DataFrame, segments: DataFrame) -> DataFrame:
    """``(kind, n)`` for backups, objects and segments to be deleted."""
    parts = [
        plan.where(~F.col("kept")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("backups").alias("kind"), "n"),
        objects.agg(F.count(F.lit(1)).alias("n")).select(F.lit("objects").alias("kind"), "n"),
        segments.agg(F.count(F.lit(1)).alias("n")).select(F.lit("segments").alias("kind"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
