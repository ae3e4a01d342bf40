"""JSON metadata files: manifests (read forgivingly), sidecars and checkpoints (strictly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import naming
from ..functions.digests import bytes_to_hex, manifest_checksum_ok
from ..functions.lsn import parse_lsn
from ..functions.policy import codec_of
from ..schemas import CHECKPOINT_VERSION, MANIFEST_JSON, SIDECAR_JSON, checkpoint_json
from .objects import split_backup_path

_JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _only(contents: DataFrame, filename: str) -> DataFrame:
    return split_backup_path(contents).where(F.col("path") == filename)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed one time per row.

    Filters and projections are not merged into a generator, so a parsed
    document is not parsed again for each later use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _decoded(contents: DataFrame, schema: T.StructType) -> DataFrame:
    # The cast keeps broken bytes, which the JSON reader then reports; decode() would fail the job.
    raw = F.col("content").cast("string")
    return _once(contents.withColumn("_raw", raw), _doc=F.from_json("_raw", schema, _JSON_OPTIONS))


def _unknown_keys(raw: Column, struct: T.StructType) -> Column:
    known = F.array(*[F.lit(f.name) for f in struct.fields if f.name != "_corrupt"])
    return F.array_except(F.json_object_keys(raw), known)


def _strict(docs: DataFrame, schema: T.StructType, nested: str) -> DataFrame:
    """Adds ``error``: NULL when the document decodes and has no field beyond the schema.

    ``nested`` names the one field that is a list of objects.
    """
    nested_type = schema[nested].dataType.elementType
    items = F.from_json(F.get_json_object("_raw", f"$.{nested}"), T.ArrayType(T.StringType()))
    nested_unknown = F.array_distinct(F.flatten(F.transform(items, lambda x: _unknown_keys(x, nested_type))))
    empty = F.array().cast("array<string>")
    docs = _once(
        docs,
        _top=_unknown_keys(F.col("_raw"), schema),
        _extra=F.coalesce(F.when(F.col("_doc").isNotNull(), nested_unknown), empty),
    )
    # A document that is no object has no keys at all.
    broken = F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull() | F.col("_top").isNull()
    unknown = F.array_union("_top", "_extra")
    error = F.when(broken, "invalid JSON").when(
        (F.size("_top") > 0) | (F.size("_extra") > 0), F.concat(F.lit("unknown field: "), F.array_join(unknown, ", "))
    )
    return docs.withColumn("error", error).drop("_top", "_extra")


# --- manifests ------------------------------------------------------------


def scan_manifests(contents: DataFrame) -> DataFrame:
    """One row per ``backup_manifest`` with its decoded document and checksum flag."""
    docs = _decoded(_only(contents, naming.MANIFEST_NAME), MANIFEST_JSON)
    readable = F.col("_doc").isNotNull() & F.col("_doc._corrupt").isNull()
    return docs.select(
        "backup_id",
        readable.alias("readable"),
        manifest_checksum_ok("content").alias("checksum_ok"),
        F.when(readable, F.col("_doc.System-Identifier")).alias("system_identifier"),
        F.when(readable, F.col("_doc.Files")).alias("files"),
        F.when(readable, F.col("_doc.WAL-Ranges")).alias("ranges"),
    )


def manifest_headers(manifests: DataFrame) -> DataFrame:
    """Files, bytes, oldest and newest file time and first log range per manifest.

    Each manifest is one row, so this folds its arrays in place: no explode, no
    shuffle. (``manifest_header`` gives the same from exploded tables.)
    """
    times = F.transform(
        "files", lambda f: F.try_to_timestamp(f["Last-Modified"], F.lit("yyyy-MM-dd HH:mm:ss 'GMT'"))
    )
    total = F.aggregate(
        "files", F.lit(0).cast("bigint"), lambda acc, f: acc + F.coalesce(f["Size"], F.lit(0)).cast("bigint")
    )
    first = F.try_element_at("ranges", F.lit(1))
    return _once(manifests.where("readable"), times=times).select(
        "backup_id",
        F.coalesce(F.array_size("files"), F.lit(0)).cast("bigint").alias("files"),
        F.coalesce(total, F.lit(0)).alias("bytes"),
        F.array_min("times").alias("start_time"),
        F.array_max("times").alias("stop_time"),
        first["Timeline"].alias("timeline"),
        parse_lsn(first["Start-LSN"], on_overflow="null").alias("start_lsn"),
        parse_lsn(first["End-LSN"], on_overflow="null").alias("stop_lsn"),
    )


def manifest_files(manifests: DataFrame) -> DataFrame:
    file = F.col("f")
    return manifests.select("backup_id", F.explode("files").alias("f")).select(
        "backup_id",
        file["Path"].alias("path"),
        F.coalesce(file["Size"], F.lit(0)).cast("bigint").alias("size"),
        F.nullif(F.lower(file["Checksum"]), F.lit("")).alias("sha256"),
        F.try_to_timestamp(file["Last-Modified"], F.lit("yyyy-MM-dd HH:mm:ss 'GMT'")).alias("mod_time"),
        F.coalesce(file["Incremental"], F.lit(False)).alias("incremental"),
    )


def wal_ranges(manifests: DataFrame) -> DataFrame:
    return manifests.select("backup_id", F.posexplode("ranges").alias("idx", "r")).select(
        "backup_id",
        "idx",
        F.col("r.Timeline").alias("timeline"),
        parse_lsn("r.Start-LSN", on_overflow="null").alias("start_lsn"),
        parse_lsn("r.End-LSN", on_overflow="null").alias("end_lsn"),
    )


def manifest_warnings(manifests: DataFrame) -> DataFrame:
    """``(backup_id, error)`` for readable manifests whose first log range has no usable position."""
    first = F.try_element_at("ranges", F.lit(1))
    bad = [x.isNotNull() & parse_lsn(x, on_overflow="null").isNull() for x in (first["Start-LSN"], first["End-LSN"])]
    return manifests.where("readable").where(bad[0] | bad[1]).select("backup_id", F.lit("unusable log position in the manifest").alias("error"))


# --- sidecars -------------------------------------------------------------


def decode_sidecars(contents: DataFrame) -> DataFrame:
    """One row per sidecar; ``error`` is NULL or tells why it does not decode."""
    docs = _strict(_decoded(_only(contents, naming.SIDECAR_NAME), SIDECAR_JSON), SIDECAR_JSON, "wal_segments")
    d = F.col("_doc")

    def text(name):
        return F.nullif(d[name], F.lit("")).alias(name)

    return docs.select(
        "backup_id",
        "error",
        d["version"].alias("version"),
        text("server"),
        text("compression"),
        codec_of(d["compression"]).alias("codec"),
        d["encryption_recipients"].alias("recipients"),
        d["system_identifier"].alias("system_identifier"),
        text("type"),
        text("parent_backup_id"),
        text("annotation"),
        F.coalesce(d["lock_held"], F.lit(False)).alias("lock_held"),
        d["directories"].alias("directories"),
        F.transform(
            d["wal_segments"],
            lambda s: F.struct(s["name"].alias("name"), s["size"].alias("size"), bytes_to_hex(s["sha256"]).alias("sha256")),
        ).alias("wal_segments"),
    )


def scan_sidecars(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded sidecars, and ``(backup_id, error)`` for those that do not decode."""
    docs = decode_sidecars(contents)
    good = docs.where(F.col("error").isNull()).drop("error")
    return good, docs.where(F.col("error").isNotNull()).select("backup_id", "error")


# --- resume checkpoints ---------------------------------------------------


def scan_checkpoints(
    contents: DataFrame, tool_version_field: str = "tool_version"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(checkpoints, checkpoint_files, corrupt)`` of all ``backup_manifest.copy`` bodies.

    ``tool_version_field`` is the JSON name under which the writer stored its
    own version; decoding is strict, so it has to be given exactly.
    """
    schema = checkpoint_json(tool_version_field)
    docs = _strict(_decoded(_only(contents, naming.CHECKPOINT_NAME), schema), schema, "files")
    wrong_version = F.col("_doc.version").isNull() | (F.col("_doc.version") != CHECKPOINT_VERSION)
    docs = docs.withColumn(
        "error", F.coalesce("error", F.when(wrong_version, "unsupported checkpoint version"))
    )
    good, d = docs.where(F.col("error").isNull()), F.col("_doc")
    lsn = d["start_lsn"]
    checkpoints = good.select(
        "backup_id",
        d["version"].alias("version"),
        d[tool_version_field].alias("tool_version"),
        d["backup_type"].alias("backup_type"),
        F.nullif(d["parent_backup_id"], F.lit("")).alias("parent_backup_id"),
        d["compression"].alias("compression"),
        F.coalesce(d["encryption_recipients"], F.array().cast("array<string>")).alias("recipients"),
        d["system_identifier"].alias("system_identifier"),
        d["timeline"].alias("timeline"),
        lsn.cast("bigint").alias("start_lsn"),
        d["start_time"].try_cast("timestamp").alias("start_time"),
        d["checkpointed_at"].try_cast("timestamp").alias("checkpointed_at"),
    )
    files = good.select("backup_id", F.explode(d["files"]).alias("f")).select(
        "backup_id",
        F.col("f.path").alias("path"),
        F.col("f.size").alias("size"),
        bytes_to_hex("f.sha256").alias("sha256"),
        F.col("f.mod_time").try_cast("timestamp").alias("mod_time"),
        F.nullif(F.col("f.repo_size"), F.lit(0)).alias("repo_size"),
        bytes_to_hex("f.repo_sha256").alias("repo_sha256"),
    )
    corrupt = docs.where(F.col("error").isNotNull()).select("backup_id", "error")
    return checkpoints, files, corrupt
