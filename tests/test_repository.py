"""A real repository tree on disk: catalog, health, verify, prune, restore plan."""

import json
import os

import pytest

from tests.builder import Builder, day, flip_middle, segment
from tidemark import operators as op
from tidemark.operators import Policy
from tidemark.plans import open_repository, prune, restore_plan, verify
from tidemark.sources import scan_contents, scan_objects


@pytest.fixture
def repo(workdir):
    return Builder(workdir)


def ids(df):
    return sorted(r["backup_id"] for r in df.select("backup_id").distinct().collect())


def health(spark, repo):
    r = open_repository(spark, repo.root)
    rows = op.health_report(r.objects, r.backups, r.warnings, r.segments).collect()
    assert [x["name"] for x in rows] == list(op.health.PROBES)
    assert [x["ord"] for x in rows] == list(range(6))
    assert len({x["all_ok"] for x in rows}) == 1
    return {x["name"]: x["ok"] for x in rows}, rows[0]["all_ok"]


def test_listing(spark, repo):
    repo.full(day(0))
    repo.wal(3)
    repo.put("20260301T120000F/base/1.copying-tmp.x", b"in flight")
    paths = {r["path"] for r in scan_objects(spark, repo.root, temp_marker=".copying-tmp").collect()}
    assert paths == {f"20260301T120000F/{f}" for f in ("PG_VERSION", "backup_manifest", "Storage-Metadata.json")}
    assert scan_objects(spark, repo.root, prefix="wal").count() == 1
    assert scan_objects(spark, repo.root, prefix="absent").count() == 0
    wanted = spark.createDataFrame([("20260301T120000F/PG_VERSION",)], "path STRING")
    assert [bytes(r["content"]) for r in scan_contents(spark, repo.root, paths=wanted).collect()] == [b"18\n"]
    inventory = spark.createDataFrame([("a/b", 1, None), ("wal/x", 2, None)], "path STRING, size BIGINT, mod_time TIMESTAMP")
    assert [r["path"] for r in scan_objects(spark, repo.root, inventory=inventory).collect()] == ["a/b"]


def test_listing_is_complete(spark, repo):
    for path in ("a/_x", "a/.y", "a/empty", "a/b/c/d/e/f/g", "top", "é/ü"):
        repo.put(path, b"" if path == "a/empty" else b"z")
    rows = {r["path"]: r["size"] for r in scan_objects(spark, repo.root).collect()}
    assert rows == {"a/_x": 1, "a/.y": 1, "a/empty": 0, "a/b/c/d/e/f/g": 1, "top": 1, "é/ü": 1}
    assert scan_objects(spark, "file://" + repo.root).count() == 6


def test_catalog(spark, repo):
    f1 = repo.full(day(0))
    i1 = repo.incremental(f1, day(1), sidecar_type=False)
    f2 = repo.full(day(2))
    r = open_repository(spark, repo.root)
    rows = {x["backup_id"]: x for x in r.backups.collect()}
    assert sorted(rows) == sorted([f1, i1, f2])
    assert rows[i1]["parent_backup_id"] == f1 and rows[i1]["type"] == "incremental"
    assert rows[f1]["parent_backup_id"] is None and rows[f1]["type"] == "full"
    assert rows[f1]["start_lsn"] == 0x3000028 and rows[f1]["stop_lsn"] == 0x3100028
    assert rows[f1]["files"] == 1 and rows[f1]["bytes"] == 3 and rows[f1]["annotation"] == "note"
    assert rows[f2]["stop_time"].day == 3
    assert r.warnings.count() == 0


def test_corrupt_sidecar(spark, repo):
    good, bad, unknown, gone = (repo.full(day(n)) for n in range(4))
    repo.put(f"{bad}/Storage-Metadata.json", b"not valid json \xff\xfe")
    body = json.load(open(f"{repo.root}/{unknown}/Storage-Metadata.json"))
    repo.put(f"{unknown}/Storage-Metadata.json", json.dumps(body | {"new_field": 1}).encode())
    os.remove(f"{repo.root}/{gone}/Storage-Metadata.json")
    r = open_repository(spark, repo.root)
    assert ids(r.backups) == [good]
    assert {x["backup_id"]: x["error"] for x in r.warnings.collect()} == {
        bad: "invalid JSON", unknown: "unknown field: new_field", gone: "sidecar missing"
    }
    repo.wal(3)
    probes, all_ok = health(spark, repo)
    assert not probes["info_decodable"] and not all_ok


def test_health(spark, repo):
    f = repo.full(day(0))
    probes, all_ok = health(spark, repo)
    assert not probes["wal_expected"] and not all_ok
    repo.wal(3)
    assert health(spark, repo)[1]
    repo.incremental(f, day(1))
    assert health(spark, repo)[1]
    repo.orphan(day(2))
    probes, _ = health(spark, repo)
    assert not probes["chain_integrity"]


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2", "zstd", "lz4"])
def test_verify(spark, repo, codec):
    files = {"PG_VERSION": b"18\n", "base/1/2": os.urandom(50000), "base/1/é": b"x" * 9000, "global/1": b""}
    a = repo.full(day(0), codec=codec, files=files)
    b = repo.full(day(1), codec=codec, files=files)
    summary, bad = verify(spark, repo.root)
    assert {r["backup_id"]: (r["status"], r["files_ok"]) for r in summary.collect()} == {a: ("OK", 4), b: ("OK", 4)}
    assert bad.count() == 0
    flip_middle(f"{repo.root}/{b}/base/1/2")
    os.remove(f"{repo.root}/{b}/PG_VERSION")
    summary, bad = verify(spark, repo.root)
    got = {r["backup_id"]: (r["status"], r["files_ok"], r["files_mismatched"]) for r in summary.collect()}
    assert got == {a: ("OK", 4, 0), b: ("FAILED", 2, 2)}
    rows = {r["path"]: r for r in bad.collect()}
    assert rows["PG_VERSION"]["status"] == "MISSING"
    if codec == "none":
        assert rows["base/1/2"]["status"] == "MISMATCH" and rows["base/1/2"]["actual"] != rows["base/1/2"]["expected"]
    else:
        assert rows["base/1/2"]["status"] in ("MISMATCH", "UNDECODABLE")
    assert ids(verify(spark, repo.root, backup_id=a)[0]) == [a]


def test_plain_bodies_that_look_compressed(spark, repo):
    import gzip

    a = repo.full(day(0), files={"base/archive.gz": gzip.compress(b"inner"), "base/1": b"y"})
    repo.full(day(1), codec="zstd")
    summary, _ = verify(spark, repo.root)
    assert {r["backup_id"]: r["status"] for r in summary.collect()}[a] == "OK"


def test_verify_manifest_and_unreadable(spark, repo):
    a, b, c = repo.full(day(0)), repo.full(day(1)), repo.full(day(2), codec="gzip", recipients=["age1x"])
    path = f"{repo.root}/{a}/backup_manifest"
    body = open(path, "rb").read().replace(b"1234567890", b"1234567891")
    open(path, "wb").write(body)
    repo.put(f"{b}/Storage-Metadata.json", b"{")
    summary = {r["backup_id"]: r for r in verify(spark, repo.root)[0].collect()}
    assert not summary[a]["manifest_checksum_ok"] and summary[a]["status"] == "FAILED"
    assert summary[b]["status"] == "UNREADABLE"
    assert summary[c]["status"] == "ENCRYPTED" and summary[c]["files_encrypted"] == 1


def test_verify_full_mode(spark, repo):
    a = repo.full(day(0))
    repo.put(f"{a}/base/extra", b"surplus")
    assert verify(spark, repo.root)[1].count() == 0
    assert [(r["path"], r["status"]) for r in verify(spark, repo.root, full=True)[1].collect()] == [("base/extra", "EXTRA")]


def test_prune(spark, repo):
    f1 = repo.full(day(0))
    i1 = repo.incremental(f1, day(0.5))
    repo.next_lsn = 0x9000028
    f2 = repo.full(day(2))
    orphan = repo.orphan(day(3))
    kept_wal = [repo.wal(9), repo.wal(0xFFFFFF)]
    old_wal = [repo.wal(1), repo.wal(2, bare=True), repo.wal(8)]
    policy = Policy(now=day(4), keep_fulls=1)
    dry = prune(spark, repo.root, policy)
    assert ids(dry.plan.where("not kept")) == sorted([f1, i1])
    assert ids(dry.plan.where("kept")) == [f2]
    assert dry.low_water_lsn == 0x9000028
    assert {r["kind"]: r["n"] for r in dry.summary.collect()} == {"backups": 2, "objects": 6, "segments": 3}
    assert all(os.path.exists(p) for p in kept_wal + old_wal)
    done = prune(spark, repo.root, policy, dry_run=False)
    assert {r["kind"]: r["n"] for r in done.summary.collect()} == {"backups": 2, "objects": 6, "segments": 3}
    assert [os.path.exists(p) for p in kept_wal + old_wal] == [True] * 2 + [False] * 3
    assert ids(open_repository(spark, repo.root).backups) == sorted([f2, orphan])
    again = prune(spark, repo.root, policy, dry_run=False)
    assert {r["kind"]: r["n"] for r in again.summary.collect()} == {"backups": 0, "objects": 0, "segments": 0}


def test_prune_keeps_wal_without_start_position(spark, repo):
    f = repo.full(day(0))
    path = f"{repo.root}/{f}/backup_manifest"
    body = open(path, "rb").read().replace(b"0/3000028", b"zz")
    open(path, "wb").write(body)
    repo.wal(1)
    plan = prune(spark, repo.root, Policy(now=day(1), keep_fulls=1))
    assert plan.low_water_lsn is None and plan.segments.count() == 0


def test_restore_plan(spark, repo):
    f1 = repo.full(day(0))
    i1 = repo.incremental(f1, day(1))
    i2 = repo.incremental(i1, day(2))
    repo.full(day(-1))
    repo.wal(1), repo.wal(3)
    r = open_repository(spark, repo.root)
    rows = restore_plan(r.backups, r.objects, r.segments).collect()
    assert {(x["seq"], x["backup_id"]) for x in rows if x["kind"] == "file"} == {(0, f1), (1, i1), (2, i2)}
    assert sum(x["kind"] == "wal" for x in rows) == 2
    needed = restore_plan(r.backups, r.objects, r.segments, backup_id=i1, wal="needed").collect()
    assert {x["backup_id"] for x in needed if x["kind"] == "file"} == {f1, i1}
    assert [os.path.basename(x["path"])[:24] for x in needed if x["kind"] == "wal"] == [segment(3)]
    with pytest.raises(LookupError):
        restore_plan(r.backups, r.objects, r.segments, backup_id="nope")
    repo.orphan(day(5))
    r = open_repository(spark, repo.root)
    with pytest.raises(LookupError):
        restore_plan(r.backups, r.objects, r.segments)


def test_checkpoint_with_foreign_version_field(spark, repo):
    from tidemark.sources import scan_checkpoints

    doc = {
        "version": 1, "my_version": "9", "backup_id": "x", "backup_type": "full", "compression": "none", "encryption_recipients": None,
        "system_identifier": 2**64 - 1, "timeline": 1, "start_lsn": 5, "start_time": "2026-01-01T00:00:00Z",
        "checkpointed_at": "2026-01-01T00:00:00.5+02:00", "files": [],
    }
    repo.put("20260101T000000F/backup_manifest.copy", json.dumps(doc).encode())
    contents = scan_contents(spark, repo.root, names=["backup_manifest.copy"])
    good, _, bad = scan_checkpoints(contents, "my_version")
    row = good.first()
    assert (row["tool_version"], str(row["system_identifier"]), row["recipients"]) == ("9", str(2**64 - 1), [])
    assert row["checkpointed_at"].isoformat().startswith("2025-12-31T22:00:00.5")
    assert bad.count() == 0
    good, _, bad = scan_checkpoints(contents)
    assert good.count() == 0 and "my_version" in bad.first()["error"]
