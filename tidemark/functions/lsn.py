"""Log positions and segment arithmetic as Column expressions.

A log position (LSN) is a BIGINT here; its text form is ``hi/lo`` in hex. A
segment is ``seg_bytes`` long and named by timeline, high part and low part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col

SEGMENT_BYTES = 16 * 1024 * 1024
_LSN_FORM = r"^0*[0-9A-Fa-f]{1,8}/0*[0-9A-Fa-f]{1,8}$"


def hex_to_long(c: Column | str) -> Column:
    return F.conv(col(c), 16, 10).try_cast("bigint")


def parse_lsn(text: Column | str, on_overflow: str = "error") -> Column:
    """``hi/lo`` hex to BIGINT; NULL when malformed or a half exceeds 32 bits.

    Positions from 2^63 on do not fit a BIGINT. They raise, or become NULL with
    ``on_overflow="null"``.
    """
    text = col(text)
    hi = hex_to_long(F.substring_index(text, "/", 1))
    lo = hex_to_long(F.substring_index(text, "/", -1))
    overflow = (
        F.raise_error(F.concat(F.lit("log position beyond 2^63: "), text)).cast("bigint")
        if on_overflow == "error"
        else F.lit(None).cast("bigint")
    )
    return F.when(
        text.rlike(_LSN_FORM),
        F.when(hi > 0x7FFFFFFF, overflow).otherwise(hi * F.lit(1 << 32) + lo),
    )


def format_lsn(lsn: Column | str) -> Column:
    lsn = col(lsn).cast("bigint")
    return F.when(
        lsn.isNotNull(),
        F.format_string("%X/%X", F.shiftrightunsigned(lsn, 32), lsn.bitwiseAND(F.lit(0xFFFFFFFF))),
    )


def int_div(a: Column | str, b: int) -> Column:
    """Whole-number division of a non-negative column by a positive constant."""
    a = col(a).cast("bigint")
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _segments_per_id(seg_bytes: int) -> int:
    return (1 << 32) // seg_bytes


def segment_no(lsn: Column | str, seg_bytes: int = SEGMENT_BYTES) -> Column:
    return int_div(lsn, seg_bytes)


def segment_name(tli: Column | str, seg_no: Column | str, seg_bytes: int = SEGMENT_BYTES) -> Column:
    tli, seg_no = col(tli).cast("bigint"), col(seg_no).cast("bigint")
    per_id = _segments_per_id(seg_bytes)
    return F.when(
        tli.isNotNull() & seg_no.isNotNull(),
        F.format_string("%08X%08X%08X", tli, int_div(seg_no, per_id), seg_no % F.lit(per_id)),
    )


def segment_no_of_name(name: Column | str, seg_bytes: int = SEGMENT_BYTES) -> Column:
    """Inverse of :func:`segment_name`; NULL unless the name starts with 24 hex digits."""
    name = col(name)
    high, low = hex_to_long(F.substring(name, 9, 8)), hex_to_long(F.substring(name, 17, 8))
    return F.when(name.rlike("^[0-9A-Fa-f]{24}"), high * F.lit(_segments_per_id(seg_bytes)) + low)


def last_segment_no(start: Column | str, stop: Column | str, seg_bytes: int = SEGMENT_BYTES) -> Column:
    """Segment of the last byte before ``stop``: the stop position is exclusive."""
    start, stop = col(start), col(stop)
    last = segment_no(stop, seg_bytes)
    on_boundary = (stop % F.lit(seg_bytes) == 0) & (stop > start) & (last > 0)
    return F.when(on_boundary, last - 1).otherwise(last)


def segments_between(start: Column | str, stop: Column | str, seg_bytes: int = SEGMENT_BYTES) -> Column:
    """Segment numbers needed to replay ``[start, stop)``; empty when stop < start."""
    start, stop = col(start), col(stop)
    return F.when(
        stop >= start,
        F.sequence(segment_no(start, seg_bytes), last_segment_no(start, stop, seg_bytes)),
    ).otherwise(F.array().cast("array<bigint>"))
