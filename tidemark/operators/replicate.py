"""Totals and replica status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replica_status(replicas: DataFrame) -> DataFrame:
    """Per backup: complete once one target committed, with the failed count."""
    return replicas.groupBy("backup_id").agg(
        F.bool_or(F.col("status") == "committed").alias("complete"),
        F.count_if(F.col("status") == "committed").alias("committed"),
        F.count_if(F.col("status") != "committed").alias("failed"),
    )


def run_totals(files: DataFrame, segments: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: files, bytes, log segments and, given the duration, bytes per second."""
    rows = files.select("size", F.lit(0).alias("_seg")).unionByName(
        segments.select(F.lit(None).cast("bigint").alias("size"), F.lit(1).alias("_seg"))
    )
    total = F.coalesce(F.sum("size"), F.lit(0))
    rate = (total / F.lit(seconds)) if seconds else F.lit(None).cast("double")
    return rows.agg(
        F.count_if(F.col("_seg") == 0).alias("files"),
        total.alias("bytes"),
        F.count_if(F.col("_seg") == 1).alias("segments"),
        rate.alias("bytes_per_second"),
    )
