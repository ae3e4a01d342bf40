"""Health report: six probes in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import orphans

# Fixed probe names and order.
PROBES = (
    "storage_reachable",
    "info_decodable",
    "chain_integrity",
    "wal_expected",
    "archive_command",
    "standby_coordination",
)


def _probe(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return df.agg(ok.alias("ok"), detail.alias("detail")).select(
        F.lit(PROBES.index(name)).alias("ord"), F.lit(name).alias("name"), "ok", "detail"
    )


def _count_probe(df: DataFrame, name: str, good: str, bad: str) -> DataFrame:
    n = F.count(F.lit(1))
    return _probe(df, name, n == 0, F.when(n == 0, good).otherwise(F.concat(n.cast("string"), F.lit(" " + bad))))


def health_report(
    objects: DataFrame,
    backups: DataFrame,
    warnings: DataFrame,
    segments: DataFrame,
    archive: DataFrame | None = None,
    standby: DataFrame | None = None,
    unreachable: str | None = None,
) -> DataFrame:
    """``(ord, name, ok, detail, all_ok)``.

    ``archive`` is the result of the archive-lag query (``reached``), ``standby``
    that of the liveness query (``ok``); without them their probes are skipped.
    ``unreachable`` is the error a listing of the store ended with, if it did.
    """
    n = F.count(F.lit(1))
    reached = F.lit(unreachable) if unreachable is not None else F.concat(n.cast("string"), F.lit(" objects listed"))
    backups_and_wal = backups.select(F.lit(1).alias("_b"), F.lit(0).alias("_w")).unionByName(
        segments.select(F.lit(0).alias("_b"), F.lit(1).alias("_w"))
    )
    has_backup, logs = F.coalesce(F.max("_b"), F.lit(0)) == 1, F.coalesce(F.sum("_w"), F.lit(0))
    parts = [
        _probe(objects, "storage_reachable", F.lit(unreachable is None), reached),
        _count_probe(warnings, "info_decodable", "every sidecar decodes", "sidecar(s) failed to decode"),
        _count_probe(orphans(backups), "chain_integrity", "every incremental has its parent", "orphan(s)"),
        _probe(
            backups_and_wal,
            "wal_expected",
            ~has_backup | (logs > 0),
            F.when(~has_backup, "no backups yet")
            .when(logs == 0, "log archive is empty but there are backups")
            .otherwise(F.concat(logs.cast("string"), F.lit(" segments archived"))),
        ),
    ]
    for name, table, flag, bad in (
        ("archive_command", archive, "reached", "marker(s) never reached the archive"),
        ("standby_coordination", standby, "ok", "standby host(s) disconnected"),
    ):
        if table is None:
            skipped = objects.sparkSession.range(1).select(
                F.lit(PROBES.index(name)).alias("ord"),
                F.lit(name).alias("name"),
                F.lit(True).alias("ok"),
                F.lit("skipped").alias("detail"),
            )
            parts.append(skipped)
        else:
            parts.append(_count_probe(table.where(~F.col(flag)), name, "ok", bad))
    report = reduce(DataFrame.unionByName, parts)
    from pyspark.sql import Window

    # Six rows: the only place where a window without partitions is right.
    return report.withColumn("all_ok", F.bool_and("ok").over(Window.partitionBy(F.lit(1)))).orderBy("ord")
