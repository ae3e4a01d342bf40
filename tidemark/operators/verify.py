"""Integrity: stored bodies against the digests their manifest recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import bounded_broadcast


def verify_files(files: DataFrame, digests: DataFrame, codecs: DataFrame | None = None, full: bool = False) -> DataFrame:
    """One row per recorded file with ``status`` and both hashes.

    ``files`` is ``(backup_id, path, size, sha256)``. ``digests`` holds what
    ``content_digests`` made of the stored bodies, so the join moves digests and
    never bodies. ``codecs`` is ``(backup_id, codec, encrypted)``; without it all
    bodies count as plain.

    ``status`` is OK, MISMATCH, MISSING, UNDECODABLE or ENCRYPTED; ``full`` adds
    SIZE (same hash field, other size) and EXTRA (stored but not recorded).
    """
    wanted = files.where(F.col("sha256").isNotNull()).select(
        "backup_id", "path", F.col("size").alias("expected_size"), F.lower("sha256").alias("expected")
    )
    stored = digests.select(
        "backup_id",
        "path",
        F.lit(True).alias("_stored"),
        F.col("codec").alias("_seen"),
        "stored_sha256",
        "stored_size",
        "plain_sha256",
        "plain_size",
        F.col("error").alias("_error"),
    )
    rows = wanted.join(stored, ["backup_id", "path"], "full_outer" if full else "left")
    if codecs is None:
        rows = rows.withColumn("_codec", F.lit("none")).withColumn("_encrypted", F.lit(False))
    else:
        # One row per backup: while that is small the file rows are not shuffled a second time.
        per_backup = codecs.select(
            "backup_id", F.col("codec").alias("_codec"), F.coalesce("encrypted", F.lit(False)).alias("_encrypted")
        )
        rows = rows.join(bounded_broadcast(per_backup), "backup_id", "left")
    plain_stored = F.col("_codec") == "none"
    actual = F.when(plain_stored, F.col("stored_sha256")).when(
        F.col("_codec") == F.col("_seen"), F.col("plain_sha256")
    )
    size = F.when(plain_stored, F.col("stored_size")).otherwise(F.col("plain_size"))
    status = (
        F.when(F.col("expected").isNull(), "EXTRA")
        .when(F.col("_stored").isNull(), "MISSING")
        .when(F.col("_encrypted"), "ENCRYPTED")
        .when(actual.isNull(), "UNDECODABLE")
        .when(actual != F.col("expected"), "MISMATCH")
    )
    if full:
        status = status.when(size != F.col("expected_size"), "SIZE")
    return rows.select(
        "backup_id",
        "path",
        status.otherwise("OK").alias("status"),
        "expected",
        F.when(~F.coalesce("_encrypted", F.lit(False)), actual).alias("actual"),
        F.when(
            F.col("_stored") & actual.isNull(),
            F.coalesce("_error", F.concat(F.lit("body is not "), F.col("_codec"))),
        ).alias("detail"),
    )


def mismatches(verified: DataFrame) -> DataFrame:
    return verified.where(~F.col("status").isin("OK", "ENCRYPTED"))


def verify_summary(verified: DataFrame, backups: DataFrame) -> DataFrame:
    """Per backup: counts, manifest flag and overall status.

    ``backups`` is ``(backup_id, readable, checksum_ok, sidecar_ok)``. Mismatches
    stay rows of their own (see :func:`mismatches`): one backup may have any
    number of them.
    """
    counts = verified.groupBy("backup_id").agg(
        F.count_if(F.col("status") == "OK").alias("files_ok"),
        F.count_if(~F.col("status").isin("OK", "ENCRYPTED")).alias("files_mismatched"),
        F.count_if(F.col("status") == "ENCRYPTED").alias("files_encrypted"),
    )
    unreadable = ~(F.col("readable") & F.col("sidecar_ok"))
    status = (
        F.when(unreadable, "UNREADABLE")
        .when(~F.col("checksum_ok") | (F.col("files_mismatched") > 0), "FAILED")
        .when(F.col("files_encrypted") > 0, "ENCRYPTED")
        .otherwise("OK")
    )
    joined = backups.join(counts, "backup_id", "left").na.fill(0, ["files_ok", "files_mismatched", "files_encrypted"])
    return joined.select(
        "backup_id",
        "files_ok",
        "files_mismatched",
        "files_encrypted",
        F.col("checksum_ok").alias("manifest_checksum_ok"),
        status.alias("status"),
    )
