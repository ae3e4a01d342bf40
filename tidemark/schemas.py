"""Explicit schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

OBJECTS = "path STRING, size BIGINT, mod_time TIMESTAMP"
CONTENTS = "path STRING, size BIGINT, content BINARY"
SEGMENTS = "tli BIGINT, name STRING, kind STRING, seg_no BIGINT, sha256 STRING, size BIGINT, path STRING"
REPLICAS = "target STRING, backup_id STRING, object STRING, status STRING, error STRING"

# Wire formats: field names are fixed by the files on disk.
MANIFEST_JSON = T.StructType([
    T.StructField("PostgreSQL-Backup-Manifest-Version", T.IntegerType()),
    T.StructField("System-Identifier", T.DecimalType(20, 0)),
    T.StructField("Files", T.ArrayType(T.StructType([
        T.StructField("Path", T.StringType()),
        T.StructField("Size", T.LongType()),
        T.StructField("Last-Modified", T.StringType()),
        T.StructField("Checksum-Algorithm", T.StringType()),
        T.StructField("Checksum", T.StringType()),
        T.StructField("Incremental", T.BooleanType()),
    ]))),
    T.StructField("WAL-Ranges", T.ArrayType(T.StructType([
        T.StructField("Timeline", T.LongType()),
        T.StructField("Start-LSN", T.StringType()),
        T.StructField("End-LSN", T.StringType()),
    ]))),
    T.StructField("Manifest-Checksum", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])

SIDECAR_JSON = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("server", T.StringType()),
    T.StructField("encryption_recipients", T.ArrayType(T.StringType())),
    T.StructField("compression", T.StringType()),
    T.StructField("storage_layout_version", T.IntegerType()),
    T.StructField("wal_segments", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("sha256", T.ArrayType(T.ShortType())),
    ]))),
    T.StructField("system_identifier", T.DecimalType(20, 0)),
    T.StructField("directories", T.ArrayType(T.StringType())),
    T.StructField("type", T.StringType()),
    T.StructField("parent_backup_id", T.StringType()),
    T.StructField("annotation", T.StringType()),
    T.StructField("lock_held", T.BooleanType()),
    T.StructField("_corrupt", T.StringType()),
])


def checkpoint_json(tool_version_field: str) -> T.StructType:
    """Resume checkpoint; the name of the tool-version field differs per producer."""
    return T.StructType([
        T.StructField("version", T.IntegerType()),
        T.StructField(tool_version_field, T.StringType()),
        T.StructField("backup_id", T.StringType()),
        T.StructField("backup_type", T.StringType()),
        T.StructField("parent_backup_id", T.StringType()),
        T.StructField("compression", T.StringType()),
        T.StructField("encryption_recipients", T.ArrayType(T.StringType())),
        T.StructField("system_identifier", T.DecimalType(20, 0)),
        T.StructField("timeline", T.LongType()),
        T.StructField("start_lsn", T.DecimalType(20, 0)),
        T.StructField("start_time", T.StringType()),
        T.StructField("checkpointed_at", T.StringType()),
        T.StructField("files", T.ArrayType(T.StructType([
            T.StructField("path", T.StringType()),
            T.StructField("size", T.LongType()),
            T.StructField("sha256", T.ArrayType(T.ShortType())),
            T.StructField("mod_time", T.StringType()),
            T.StructField("repo_size", T.LongType()),
            T.StructField("repo_sha256", T.ArrayType(T.ShortType())),
        ]))),
        T.StructField("_corrupt", T.StringType()),
    ])


CHECKPOINT_VERSION = 1
