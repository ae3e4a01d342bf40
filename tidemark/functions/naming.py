"""Names and paths: backup ids, archive names, file classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col
from .lsn import hex_to_long

# Fixed file names of the repository layout.
MANIFEST_NAME = "backup_manifest"
CHECKPOINT_NAME = "backup_manifest.copy"
SIDECAR_NAME = "Storage-Metadata.json"
WAL_DIR = "wal"

# Fixed forms of the names an archiver ships.
SEGMENT_FORM = r"^[0-9A-Fa-f]{24}$"
BACKUP_FORM = r"^[0-9A-Fa-f]{24}\.[0-9A-Fa-f]{8}\.backup$"
PARTIAL_FORM = r"^[0-9A-Fa-f]{24}\.partial$"
HISTORY_FORM = r"^[0-9A-Fa-f]{8}\.history$"
_SHA_SUFFIX = r"-[0-9a-f]{64}$"

# Files that every new run must copy again.
NEVER_REUSED = ("backup_label", "backup_manifest", "tablespace_map")


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def first_part(path: Column | str) -> Column:
    """Text before the first slash; NULL for a path without a directory."""
    path = col(path)
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1))


# --- backup ids -----------------------------------------------------------


def is_backup_dir(name: Column | str) -> Column:
    """Loose test used by catalog and verify: the name ends in F or I."""
    return col(name).rlike("[FI]$")


def is_backup_id(name: Column | str) -> Column:
    """Shape test used by resume: date, ``T``, time, then F or I."""
    return col(name).rlike("^[0-9]{8}T[0-9]{6}[FI]")


def backup_id_of(path: Column | str) -> Column:
    part = first_part(path)
    return F.when(is_backup_dir(part), part)


def type_from_id(backup_id: Column | str) -> Column:
    backup_id = col(backup_id)
    return F.when(backup_id.endswith("I"), "incremental").when(backup_id.endswith("F"), "full")


def parent_from_id(backup_id: Column | str) -> Column:
    """``<parent>_<ts>I`` gives the parent; anything else gives NULL."""
    backup_id = col(backup_id)
    return F.when(backup_id.endswith("I"), F.nullif(F.regexp_extract(backup_id, "^(.+)_[^_]*I$", 1), F.lit("")))


def format_backup_id(ts: Column | str, backup_type: Column | str) -> Column:
    """Fixed format ``yyyyMMddTHHmmss`` followed by F or I (UTC session zone)."""
    suffix = F.when(col(backup_type) == "incremental", "I").otherwise("F")
    return F.concat(F.date_format(col(ts), "yyyyMMdd'T'HHmmss"), suffix)


# --- archive names --------------------------------------------------------


def segment_kind(name: Column | str) -> Column:
    name = basename(name)
    return (
        F.when(name.rlike(SEGMENT_FORM), "segment")
        .when(name.rlike(BACKUP_FORM), "backup")
        .when(name.rlike(PARTIAL_FORM), "partial")
        .when(name.rlike(HISTORY_FORM), "history")
    )


def is_archivable(name: Column | str) -> Column:
    return segment_kind(name).isNotNull()


def timeline_of(name: Column | str) -> Column:
    return F.when(is_archivable(name), hex_to_long(F.substring(basename(name), 1, 8)))


def strip_sha_suffix(base: Column | str) -> Column:
    return F.regexp_replace(col(base), _SHA_SUFFIX, "")


def sha_suffix(base: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(base), "-([0-9a-f]{64})$", 1), F.lit(""))


def segment_prefix(tli: Column | str, name: Column | str) -> Column:
    return F.concat(F.format_string("wal/%08X/", col(tli).cast("bigint")), col(name), F.lit("-"))


def segment_key(tli: Column | str, name: Column | str, sha256: Column | str) -> Column:
    return F.concat(segment_prefix(tli, name), F.lower(col(sha256)))


# --- file classes ---------------------------------------------------------


def is_page_file(path: Column | str) -> Column:
    path = col(path)
    return path.startswith("base/") | path.startswith("global/") | path.startswith("pg_tblspc/")


def never_reuse(path: Column | str) -> Column:
    return col(path).isin(*NEVER_REUSED)


def unsafe_path(path: Column | str) -> Column:
    path = col(path)
    return path.startswith("/") | path.contains("..")


def is_incremental_file(path: Column | str) -> Column:
    return basename(path).startswith("INCREMENTAL.")


def is_inline_wal(path: Column | str) -> Column:
    path = col(path)
    inner = F.substring(path, 8, 2**31 - 1)
    return path.startswith("pg_wal/") & ~inner.contains("/") & is_archivable(inner)
