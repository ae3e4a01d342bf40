"""Digests, labels and little-endian fields of binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col, let
from .lsn import hex_to_long, parse_lsn

_MARK = '"Manifest-Checksum"'
_OPENING = '"Manifest-Checksum": "'


def manifest_checksum_ok(content: Column | str) -> Column:
    """SHA-256 of the bytes before the checksum field equals the recorded hex."""
    # A binary column cast to text keeps its bytes, and the search compares bytes,
    # so the prefix is exact whatever the encoding of the paths in it.
    text = col(content).cast("string")
    prefix = F.substring_index(text, _MARK, 1)
    rest = F.substring_index(F.substring_index(text, _OPENING, 2), _OPENING, -1)
    present = text.contains(_OPENING) & rest.contains('"')
    matches = F.sha2(prefix.cast("binary"), 256) == F.lower(F.substring_index(rest, '"', 1))
    return F.coalesce(present & matches, F.lit(False))


def bytes_to_hex(byte_array: Column | str) -> Column:
    """A 32-number JSON byte array as lower-case hex; NULL when absent or all zero."""
    hexed = F.array_join(F.transform(col(byte_array), lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), "")
    digest = let(F.lower(hexed), lambda h: F.nullif(h, F.lit("0" * 64)))
    return F.when(F.size(col(byte_array)) == 32, digest)


def u32le(content: Column | str, offset: Column | int) -> Column:
    """Little-endian unsigned 32-bit number at a zero-based byte offset."""
    content = col(content)
    start = offset if isinstance(offset, Column) else F.lit(offset)
    parts = [F.hex(F.substring(content, (start + k + 1).cast("int"), F.lit(1))) for k in (3, 2, 1, 0)]
    return hex_to_long(F.concat(*parts))


def label_start_lsn(text: Column | str) -> Column:
    found = F.regexp_extract(col(text), r"(?m)^START WAL LOCATION:\s+([0-9A-Fa-f]+/[0-9A-Fa-f]+)", 1)
    return let(found, lambda text: parse_lsn(F.nullif(text, F.lit(""))))


def label_timeline(text: Column | str) -> Column:
    found = F.regexp_extract(col(text), r"(?m)^START TIMELINE:\s+(\d+)", 1).try_cast("bigint")
    return let(found, lambda tli: F.when(tli <= 0xFFFFFFFF, tli))


def parse_backup_label(text: Column | str) -> Column:
    """``struct(start_lsn, timeline)``; NULL unless both fields are present."""
    fields = F.struct(label_start_lsn(text).alias("start_lsn"), label_timeline(text).alias("timeline"))
    return let(fields, lambda f: F.when(f["start_lsn"].isNotNull() & f["timeline"].isNotNull(), f))
