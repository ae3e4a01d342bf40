"""Point-in-time state of a table from a base and its change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.targets import Target, target_predicate
from ..joins import latest_by, overlay


def replay_to_target(
    changes: DataFrame,
    target: Target,
    key: list[str],
    values: list[str],
    base: DataFrame | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Last change per key at or before the target; deletes remove the key.

    ``changes`` has ``op`` (``D`` deletes, all else writes, NULL too), ``lsn`` and, as the target needs
    them, ``ts``, ``xid`` or ``restore_point``. The winner per key is chosen by
    a partial aggregation, so a key with very many changes is cut down in every
    task before it is shuffled.
    """
    order = order or ["lsn"]
    seen = changes.where(target_predicate(target, changes)).select(
        *key, *order, *values, F.coalesce(F.col("op") == "D", F.lit(False)).alias("_gone")
    )
    latest = latest_by(seen, key, order, [*values, "_gone"])
    if base is None:
        return latest.where(~F.col("_gone")).select(*key, *values)
    return overlay(base.select(*key, *values), latest, key, "_gone").select(*key, *values)
