"""Recovery targets: exactly one of time, transaction, log position or name."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("pause", "promote", "shutdown")


@dataclass(frozen=True)
class Target:
    time: datetime | str | None = None
    xid: int | None = None
    lsn: int | None = None
    name: str | None = None
    action: str = "pause"

    def __post_init__(self) -> None:
        given = [f for f in ("time", "xid", "lsn") if getattr(self, f) is not None]
        given += ["name"] if self.name else []
        if len(given) > 1:
            raise ValueError(f"give at most one recovery target, got {', '.join(given)}")
        if self.action not in ACTIONS:
            raise ValueError(f"target action must be one of {', '.join(ACTIONS)}")

    @property
    def kind(self) -> str | None:
        for field in ("time", "xid", "lsn", "name"):
            if getattr(self, field) not in (None, ""):
                return field
        return None


def target_predicate(target: Target, changes: DataFrame) -> Column:
    """Predicate selecting the changes at or before the target (inclusive).

    A transaction or a restore point is first resolved to the position of its
    last record, because transactions commit in log order, not in id order.
    """
    kind = target.kind
    if kind is None:
        return F.lit(True)
    if kind == "time":
        return F.col("ts") <= F.lit(target.time).cast("timestamp")
    if kind == "lsn":
        return F.col("lsn") <= F.lit(target.lsn)
    marker = F.col("xid") == target.xid if kind == "xid" else F.col("restore_point") == target.name
    stop = changes.where(marker).agg(F.max("lsn")).first()[0]
    if stop is None:
        raise ValueError(f"recovery target not found: {kind} {getattr(target, kind)}")
    return F.col("lsn") <= F.lit(stop)
