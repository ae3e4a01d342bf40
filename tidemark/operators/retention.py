"""Retention: which chains a policy keeps, and from which log position on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import day_bucket, month_bucket, week_bucket
from ..joins import lookup
from .chains import resolve_chains


@dataclass(frozen=True)
class Policy:
    """Rules set to 0 are off. ``now`` is explicit so that plans are repeatable."""

    now: datetime | str
    keep_fulls: int = 0
    keep_full_age: int = 0  # seconds
    keep_daily: int = 0
    keep_weekly: int = 0
    keep_monthly: int = 0

    def __post_init__(self) -> None:
        if not any((self.keep_fulls, self.keep_full_age, self.keep_daily, self.keep_weekly, self.keep_monthly)):
            raise ValueError("empty retention policy: every backup would expire")

    @property
    def now_col(self) -> Column:
        return F.lit(self.now).cast("timestamp")


def newest_chains(fulls: DataFrame, n: int, partition_by: str | None = None, salts: int = 64) -> DataFrame:
    """Ids of the newest ``n`` full backups, overall or per ``partition_by``.

    Overall the order is taken by per-task top-n lists. Per group a first ranking
    runs inside salted parts of the group, so that a group holding most backups
    is ranked by many tasks; the second ranking sees at most n rows per part.
    """
    newest = [F.col("stop_time").desc_nulls_last(), F.col("backup_id")]
    if partition_by is None:
        return fulls.orderBy(*newest).limit(n).select("backup_id")
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64("backup_id"), F.lit(salts))
    rows = fulls.select("backup_id", "stop_time", partition_by, salt.alias("_salt"))
    for parts in ([partition_by, "_salt"], [partition_by]):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy(*newest))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return rows.select("backup_id")


def one_per_bucket(fulls: DataFrame, bucket: Column, n: int) -> DataFrame:
    """Ids of the newest full in each of the buckets 0..n-1; equal times: smallest id."""
    dated = fulls.where(F.col("stop_time").isNotNull()).select("backup_id", "stop_time", bucket.alias("_bucket"))
    # A minimum over (time backwards, id): every task sends one row per bucket.
    newest_first = F.struct((-F.unix_micros("stop_time")).alias("t"), F.col("backup_id"))
    best = dated.where(F.col("_bucket").between(0, n - 1)).groupBy("_bucket").agg(F.min(newest_first).alias("best"))
    return best.select(F.col("best.backup_id").alias("backup_id"))


def kept_fulls(backups: DataFrame, policy: Policy, partition_by: str | None = None) -> DataFrame:
    """``(chain_id, reasons)`` of every full backup some rule keeps."""
    fulls = backups.where(F.col("type") == "full")
    now = policy.now_col
    rules: list[tuple[str, DataFrame]] = []
    if policy.keep_fulls > 0:
        rules.append(("keep_fulls", newest_chains(fulls, policy.keep_fulls, partition_by)))
    if policy.keep_full_age > 0:
        cutoff = now - F.make_dt_interval(secs=F.lit(policy.keep_full_age))
        rules.append(("keep_full_age", fulls.where(F.col("stop_time") > cutoff).select("backup_id")))
    for name, n, bucket in (
        ("keep_daily", policy.keep_daily, day_bucket),
        ("keep_weekly", policy.keep_weekly, week_bucket),
        ("keep_monthly", policy.keep_monthly, month_bucket),
    ):
        if n > 0:
            rules.append((name, one_per_bucket(fulls, bucket("stop_time", now), n)))
    hits = None
    for name, ids in rules:
        rows = ids.select(F.col("backup_id").alias("chain_id"), F.lit(name).alias("reason"))
        hits = rows if hits is None else hits.unionByName(rows)
    # At most one row per rule and chain, so the list stays tiny.
    return hits.groupBy("chain_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def retention_plan(
    backups: DataFrame,
    policy: Policy,
    chains: DataFrame | None = None,
    partition_by: str | None = None,
    kept: DataFrame | None = None,
) -> DataFrame:
    """``(backup_id, chain_id, kept, reasons)``; a chain is kept or expires as a whole.

    Backups without a root belong to neither side and are left out. ``chains``
    and ``kept`` may be given where they are known already.
    """
    chains = resolve_chains(backups) if chains is None else chains
    kept = kept_fulls(backups, policy, partition_by) if kept is None else kept
    rooted = chains.where(F.col("chain_id").isNotNull()).select("backup_id", "chain_id")
    return lookup(rooted, kept, ["chain_id"]).select(
        "backup_id",
        "chain_id",
        F.col("reasons").isNotNull().alias("kept"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def low_water(backups: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: the smallest start position of the kept chains' fulls.

    NULL, with the reason, when a kept full has no readable start position or
    nothing is kept; nothing may be pruned then.
    """
    starts = backups.where(F.col("type") == "full").join(
        kept.select(F.col("chain_id").alias("backup_id")), "backup_id", "left_semi"
    )
    unknown = F.count_if(F.col("start_lsn").isNull())
    rows = F.count(F.lit(1))
    return starts.agg(
        F.when(unknown == 0, F.min("start_lsn")).alias("low_water_lsn"),
        F.when(rows == 0, "nothing kept").when(unknown > 0, "unreadable start position").alias("reason"),
    )
