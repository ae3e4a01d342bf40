"""Golden rows for the Column functions."""

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn

MIB16 = 16 << 20


def one(spark, column, **values):
    row = [F.lit(v).cast(t).alias(k) for k, (t, v) in values.items()]
    return spark.range(1).select(*row).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, value",
    [
        ("0/0", 0), ("0/12345678", 305419896), ("1/42", 4294967362), ("1/ab", 4294967467), ("0000000001/00000042", 4294967362),
        ("", None), ("garbage", None), ("0/0/0", None), ("/0", None), ("0/", None), ("xyz/000", None), ("1/zzz", None),
        ("1/12zz", None), ("123456789/0", None), ("0/123456789", None), (None, None),
    ],
)
def test_parse_lsn(spark, text, value):
    assert one(spark, fn.parse_lsn("s"), s=("string", text)) == value


def test_parse_lsn_overflow(spark):
    with pytest.raises(Exception, match="beyond 2"):
        one(spark, fn.parse_lsn("s"), s=("string", "80000000/0"))
    assert one(spark, fn.parse_lsn("s", on_overflow="null"), s=("string", "80000000/0")) is None


@pytest.mark.parametrize("value, text", [(0, "0/0"), (305419896, "0/12345678"), (4294967362, "1/42"), (0xB38F70002F0, "B38/F70002F0"), (None, None)])
def test_format_lsn(spark, value, text):
    assert one(spark, fn.format_lsn("x"), x=("bigint", value)) == text


@pytest.mark.parametrize(
    "tli, lsn, name",
    [
        (1, 0x3000028, "000000010000000000000003"),
        (1, 0x4000000, "000000010000000000000004"),
        (2, 0x3000028, "000000020000000000000003"),
        (1, 0xB38 << 32 | 0xF70002F0, "0000000100000B38000000F7"),
        (1, MIB16 * 0x100000001, "000000010100000000000001"),
    ],
)
def test_segment_name(spark, tli, lsn, name):
    got = one(spark, fn.segment_name("t", fn.segment_no("l")), t=("bigint", tli), l=("bigint", lsn))
    assert got == name
    assert one(spark, fn.segment_no_of_name("n"), n=("string", name)) == lsn // MIB16


@pytest.mark.parametrize(
    "start, stop, numbers",
    [
        (0x3000028, 0x3000100, [3]),
        (0x3FFFFFE, 0x4000010, [3, 4]),
        (0x3000028, 0x4000000, [3]),
        (0x4000000, 0x4000000, [4]),
        (0x5000000, 0x4000000, []),
        (0x3000000, 0x7000001, [3, 4, 5, 6, 7]),
    ],
)
def test_segments_between(spark, start, stop, numbers):
    assert one(spark, fn.segments_between("a", "b"), a=("bigint", start), b=("bigint", stop)) == numbers


def test_segment_key(spark):
    sha = bytes(range(32)).hex()
    name = "000000010000000000000003"
    got = one(spark, fn.segment_key("t", "n", "s"), t=("bigint", 1), n=("string", name), s=("string", sha))
    assert got == f"wal/00000001/{name}-{sha}"
    assert one(spark, fn.strip_sha_suffix("b"), b=("string", f"{name}-{sha}")) == name
    assert one(spark, fn.sha_suffix("b"), b=("string", f"{name}-{sha}")) == sha


@pytest.mark.parametrize(
    "name, kind",
    [
        ("000000010000000000000003", "segment"),
        ("0000000100000B38000000F7", "segment"),
        ("0000000100000B38000000F7.partial", "partial"),
        ("0000000100000B38000000E1.00000028.backup", "backup"),
        ("00000001.history", "history"),
        ("00000003.history", "history"),
        ("", None),
        ("nope", None),
        ("00000001000000000000000", None),
        ("000000010000000000000003abc", None),
        ("000000010000000000000003.partial.bogus", None),
        ("Z" * 24, None),
        ("00000001.history.bak", None),
        ("0000000100000B38000000E1.SHRTOFFSET.backup", None),
        ("0000000100000B38000000E1.00000028.backup.tmp", None),
    ],
)
def test_segment_kind(spark, name, kind):
    assert one(spark, fn.segment_kind("n"), n=("string", name)) == kind
    assert one(spark, fn.is_archivable("n"), n=("string", name)) == (kind is not None)


@pytest.mark.parametrize(
    "name, tli",
    [
        ("000000010000000000000003", 1),
        ("0000000100000B38000000F7.partial", 1),
        ("0000000100000B38000000E1.00000028.backup", 1),
        ("00000003.history", 3),
        ("FFFFFFFF.history", 4294967295),
    ],
)
def test_timeline_of(spark, name, tli):
    assert one(spark, fn.timeline_of("n"), n=("string", name)) == tli


@pytest.mark.parametrize(
    "text, ok",
    [
        ("20260430T120000F", True), ("20260430T120000I", True), ("20260101T000000F_20260102T030405I", True),
        ("wal", False), (".server-demo.lock", False), ("Storage-Metadata.json", False), ("20260430T12000F", False),
        ("20260430X120000F", False), ("20260430T120000Z", False), ("", False),
    ],
)
def test_is_backup_id(spark, text, ok):
    assert one(spark, fn.is_backup_id("s"), s=("string", text)) is ok


@pytest.mark.parametrize(
    "backup_id, parent, kind",
    [
        ("20260101T000000F_20260102T030405I", "20260101T000000F", "incremental"),
        ("20260101T000000F_20260102T030405I_20260103T030405I", "20260101T000000F_20260102T030405I", "incremental"),
        ("20260101T000000F", None, "full"),
        ("20260101T000000I", None, "incremental"),
    ],
)
def test_ids(spark, backup_id, parent, kind):
    assert one(spark, fn.parent_from_id("s"), s=("string", backup_id)) == parent
    assert one(spark, fn.type_from_id("s"), s=("string", backup_id)) == kind
    assert one(spark, fn.backup_id_of("s"), s=("string", backup_id + "/base/1")) == backup_id


def test_format_backup_id(spark):
    ts = F.lit("2026-04-30 12:00:01").cast("timestamp")
    assert one(spark, fn.format_backup_id(ts, F.lit("full")), s=("string", "")) == "20260430T120001F"
    assert one(spark, fn.format_backup_id(ts, F.lit("incremental")), s=("string", "")) == "20260430T120001I"


LABEL = "START WAL LOCATION: {} (file 000000010000000000000003)\nCHECKPOINT LOCATION: 0/3000060\nSTART TIMELINE: {}\n"


@pytest.mark.parametrize(
    "text, value",
    [
        (LABEL.format("0/3000028", "1"), (0x3000028, 1)),
        ("X: y\n" + LABEL.format("12/34567890", "42"), (0x1234567890, 42)),
        ("START TIMELINE: 1\n", None),
        ("START WAL LOCATION: 0/3000028\n", None),
        ("START WAL LOCATION: zz\nSTART TIMELINE: 1\n", None),
        ("", None),
    ],
)
def test_backup_label(spark, text, value):
    got = one(spark, fn.parse_backup_label("s"), s=("string", text))
    assert (tuple(got) if got else None) == value


@pytest.mark.parametrize("text, codec, level", [("", "none", None), (None, "none", None), ("none", "none", None), ("zstd:3", "zstd", 3), ("gzip", "gzip", None), ("lz4:x", "lz4", None)])
def test_codec(spark, text, codec, level):
    assert one(spark, fn.codec_of("s"), s=("string", text)) == codec
    assert one(spark, fn.level_of("s"), s=("string", text)) == level


@pytest.mark.parametrize(
    "ts, day, week, month",
    [
        ("2026-04-30 23:00:00", 0, 0, 0),
        ("2026-04-26 00:00:00", 4, 0, 0),  # a Sunday
        ("2026-04-25 23:59:59", 5, 1, 0),  # the Saturday before
        ("2025-12-31 10:00:00", 120, 17, 4),
        ("2026-05-03 00:00:00", -3, -1, -1),
    ],
)
def test_buckets(spark, ts, day, week, month):
    now, t = F.lit("2026-04-30 12:00:00").cast("timestamp"), F.col("t").cast("timestamp")
    got = [one(spark, f(t, now), t=("string", ts)) for f in (fn.day_bucket, fn.week_bucket, fn.month_bucket)]
    assert got == [day, week, month]


@pytest.mark.parametrize(
    "path, page, inline, unsafe, inc, never",
    [
        ("base/1/2", True, False, False, False, False),
        ("global/1", True, False, False, False, False),
        ("pg_tblspc/1/x", True, False, False, False, False),
        ("pg_wal/000000010000000000000003", False, True, False, False, False),
        ("pg_wal/archive_status/x", False, False, False, False, False),
        ("pg_wal/00000002.history", False, True, False, False, False),
        ("/etc/passwd", False, False, True, False, False),
        ("a/../b", False, False, True, False, False),
        ("base/5/INCREMENTAL.123", True, False, False, True, False),
        ("backup_label", False, False, False, False, True),
        ("tablespace_map", False, False, False, False, True),
    ],
)
def test_path_classes(spark, path, page, inline, unsafe, inc, never):
    fs = (fn.is_page_file, fn.is_inline_wal, fn.unsafe_path, fn.is_incremental_file, fn.never_reuse)
    assert [one(spark, f("p"), p=("string", path)) for f in fs] == [page, inline, unsafe, inc, never]


def test_manifest_checksum(spark):
    import hashlib

    head = '{ "Files": [ { "Path": "bäse/1" } ],\n'.encode()
    good = head + b'"Manifest-Checksum": "' + hashlib.sha256(head).hexdigest().encode() + b'"}\n'
    bad = bytearray(good)
    bad[10] ^= 0xFF
    cases = [(good, True), (good.replace(b"Checksum", b"Chicksum"), False), (bytes(bad), False), (b"", False), (head, False)]
    for body, want in cases:
        assert one(spark, fn.manifest_checksum_ok("c"), c=("binary", body)) is want


def test_targets():
    with pytest.raises(ValueError):
        fn.Target(xid=1, lsn=2)
    with pytest.raises(ValueError):
        fn.Target(xid=1, action="explode")
    assert fn.Target(lsn=0).kind == "lsn"
    assert fn.Target().kind is None
