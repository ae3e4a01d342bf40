"""The log archive under writers that push at the same time, die half-way or come back."""

import glob
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.sources import archive as arc
from tidemark.sources.archive import archive_ingest, read_archive, vacuum_archive

SEGMENTS = "tli BIGINT, name STRING, sha256 STRING, size BIGINT"


def names(n, first=0):
    return ["00000001%08X%08X" % ((first + i) // 256, (first + i) % 256) for i in range(n)]


def push(spark, archive, batch, rows, **more):
    got = archive_ingest(spark.createDataFrame(rows, SEGMENTS), archive, batch, **more).collect()
    return {(r["name"], r["sha256"]): r["status"] for r in got}


def stored(spark, archive, **more):
    rows = read_archive(spark, archive, **more).collect()
    held = {r["name"]: r["sha256"] for r in rows}
    assert len(held) == len(rows)
    return held


def at_once(jobs):
    """Runs the jobs side by side and returns what they return."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


@pytest.fixture
def crowded(monkeypatch):
    """All writers have read the archive before any of them publishes for the first time."""

    def meet(writers):
        barrier, newest, first = threading.Barrier(writers), arc._newest, threading.local()

        def slow(files, folder):
            got = newest(files, folder)
            if not getattr(first, "met", False):
                first.met = True
                barrier.wait(60)
            return got

        monkeypatch.setattr(arc, "_newest", slow)

    return meet


def settle(archive, rows, owner, compact_after=64):
    return arc._settle(arc._range_files(archive, None)(), "tli=1/range=r000000", rows, owner, compact_after)


def test_writers_that_read_the_same_state_agree_on_one_content(spark, workdir, crowded):
    every = names(40)
    crowded(6)
    told = at_once([lambda k=k: settle(f"{workdir}/a", [(n, f"{k % 3}-{n}", 1) for n in every], f"w{k}") for k in range(6)])
    held = stored(spark, f"{workdir}/a")
    assert sorted(held) == every
    assert all({n: s for n, (s, _) in known.items()} == held for known in told)
    assert len({owner for known in told for _, owner in known.values()}) == 1


def test_crowded_writers_with_compaction_in_between(spark, workdir, crowded):
    every = names(120)
    crowded(8)

    def job(k):
        for start in range(0, 120, 10):
            part = every[start : start + 10 + k]
            settle(f"{workdir}/a", [(n, f"{k}-{n}", 1) for n in part], f"w{k}-{start}", compact_after=3)

    at_once([lambda k=k: job(k) for k in range(8)])
    held = stored(spark, f"{workdir}/a")
    assert sorted(held) == every and all(s[2:] == n for n, s in held.items())
    assert glob.glob(f"{workdir}/a/tli=1/range=r000000/gen=1/*.parquet")


def test_two_jobs_at_the_same_time(spark, workdir):
    every, archive = names(60), f"{workdir}/a"
    one, two = at_once([lambda k=k: push(spark, archive, k, [(1, n, f"{k}{n}" if i % 2 else n, 1) for i, n in enumerate(every)]) for k in "xy"])
    held = stored(spark, archive)
    for i, n in enumerate(every):
        told = sorted([one[n, f"x{n}" if i % 2 else n], two[n, f"y{n}" if i % 2 else n]])
        assert told == (["conflict", "new"] if i % 2 else ["duplicate", "new"])
        assert {**one, **two}[n, held[n]] != "conflict"


def test_a_writer_that_died_leaves_no_hole(spark, workdir):
    archive, every = f"{workdir}/a", names(9)
    push(spark, archive, "0", [(1, n, "a", 1) for n in every[:3]])
    # One died before its file was published, one after it had closed the generation.
    os.makedirs(f"{archive}/_staged", exist_ok=True)
    with open(f"{archive}/_staged/left", "wb") as f:
        f.write(b"half a file")
    files = arc._range_files(archive, None)()
    empty = files.read("tli=1/range=r000000/gen=0/00000000.parquet").slice(0, 0)
    assert files.create("tli=1/range=r000000/gen=0/00000001.parquet", empty)
    os.makedirs(f"{archive}/tli=1/range=r000000/gen=1")
    assert set(stored(spark, archive)) == set(every[:3])
    assert set(push(spark, archive, "1", [(1, n, "b", 1) for n in every]).values()) == {"conflict", "new"}
    assert stored(spark, archive) == {n: "a" if i < 3 else "b" for i, n in enumerate(every)}


def test_a_full_generation_that_nobody_closed_is_closed_later(spark, workdir):
    archive = f"{workdir}/a"
    for k in range(5):  # a larger limit than that of the next writers
        push(spark, archive, str(k), [(1, names(9)[k], "a", 1)], compact_after=50)
    assert push(spark, archive, "x", [(1, names(9)[0], "b", 1)], compact_after=3) == {(names(9)[0], "b"): "conflict"}
    push(spark, archive, "y", [(1, names(9)[8], "a", 1)], compact_after=3)
    assert len(stored(spark, archive)) == 6 and glob.glob(f"{archive}/tli=1/range=*/gen=1/*.parquet")


def test_a_range_with_a_lost_file_is_refused(spark, workdir, monkeypatch):
    monkeypatch.setattr(arc, "_LISTINGS", 3)
    for k in range(3):
        settle(f"{workdir}/a", [(names(3)[k], "a", 1)], str(k))
    os.remove(f"{workdir}/a/tli=1/range=r000000/gen=0/00000001.parquet")
    with pytest.raises(OSError, match="is missing"):
        settle(f"{workdir}/a", [(names(3)[1], "b", 1)], "x")


def test_replays_and_repeated_tasks_change_nothing(spark, workdir):
    archive, rows = f"{workdir}/a", [(1, n, "a", 1) for n in names(5)]
    first = push(spark, archive, "7", rows)
    before = sorted(glob.glob(f"{archive}/tli=*/**/*.parquet", recursive=True))
    assert push(spark, archive, "7", rows) == first == {(n, "a"): "new" for n in names(5)}
    assert sorted(glob.glob(f"{archive}/tli=*/**/*.parquet", recursive=True)) == before
    assert set(push(spark, archive, "8", rows).values()) == {"duplicate"}


def test_a_push_reads_only_the_ranges_it_touches(spark, workdir):
    archive = f"{workdir}/a"
    near, far = names(3), names(3, first=5 << 16)
    push(spark, archive, "0", [(1, n, "a", 1) for n in near + far])
    (file,) = glob.glob(f"{archive}/tli=1/range=r000005/gen=0/*.parquet")
    with open(file, "wb") as f:
        f.write(b"not a table")
    assert push(spark, archive, "1", [(1, near[0], "b", 1)]) == {(near[0], "b"): "conflict"}
    assert stored(spark, archive, names=(near[0], near[1])) == {near[0]: "a", near[1]: "a"}


def test_odd_names_nulls_and_empty_pushes(spark, workdir):
    archive = f"{workdir}/a"
    rows = [(1, "00000001.history", "h", 1), (None, names(1)[0], "a", 1), (1, None, "n", 1), (1, None, None, None), (2, "x/../é", None, 5)]
    got = push(spark, archive, "0", rows)
    # Of the two contents without a name the one without a hash sorts first.
    assert got == {("00000001.history", "h"): "new", (names(1)[0], "a"): "new", (None, None): "new", (None, "n"): "conflict", ("x/../é", None): "new"}
    again = [(r["tli"], r["name"]) for r in read_archive(spark, archive).collect()]
    assert sorted(again, key=str) == sorted([(1, "00000001.history"), (None, names(1)[0]), (1, None), (2, "x/../é")], key=str)
    assert push(spark, archive, "1", []) == {} and read_archive(spark, f"{workdir}/none").count() == 0


def test_vacuum_takes_old_generations_only(spark, workdir):
    archive = f"{workdir}/a b"
    for k in range(7):
        push(spark, archive, str(k), [(1, names(9)[k], "a", 1), (1, names(9, first=9 << 16)[k], "a", 1)], compact_after=3)
    before = stored(spark, archive)
    old = vacuum_archive(spark, archive).count()
    assert old and len(before) == 14
    assert vacuum_archive(spark, archive, dry_run=False).count() == old
    assert stored(spark, archive) == before and vacuum_archive(spark, archive).count() == 0


def test_stores_need_a_conditional_put(spark, workdir, monkeypatch):
    from pyarrow import fs

    root = f"{workdir}/store"
    os.makedirs(root)
    monkeypatch.setattr(arc, "_open_store", lambda: lambda _: (fs.SubTreeFileSystem(root, fs.LocalFileSystem()), ""))
    with pytest.raises(ValueError, match="if it is absent"):
        arc._range_files("store://a", None)()
    refused = []

    def claim(key, body):
        path = key.replace("store://a", root)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if not refused:
            refused.append(key)
            with open(path, "wb") as f:  # another writer was faster, with the same bytes
                f.write(body)
            return False
        try:
            with open(path, "xb") as f:
                f.write(body)
            return True
        except FileExistsError:
            return False

    files = arc._range_files("store://a", claim)()
    assert arc._settle(files, "tli=1/range=r0", [("A", "a", 1)], "x", 9) == {"A": ("a", "x")} and len(refused) == 1
    assert arc._settle(files, "tli=1/range=r0", [("A", "b", 1), ("B", "b", 1)], "y", 9) == {"A": ("a", "x"), "B": ("b", "y")}


def test_current_rows_of_a_plan_without_compaction_are_not_shuffled(spark, workdir):
    push(spark, f"{workdir}/a", "0", [(1, n, "a", 1) for n in names(5)])
    plan = read_archive(spark, f"{workdir}/a")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_a_push_lists_its_own_names_and_reads_each_file_once(workdir):
    """What a push costs beyond its names is reading the files of its range as tables, each once."""
    files = arc._range_files(f"{workdir}/once", None)()
    read, paths = files.read, []
    files.read = lambda path: paths.append(path) or read(path)
    push = lambda names, owner: arc._settle(files, "tli=1/range=r0", [(n, owner, 1) for n in names], owner, 2)
    assert push("AB", "x") == {n: ("x", "x") for n in "AB"}
    # The second file closes the generation; the next one holds what was read already.
    assert push("BC", "y") == {"B": ("x", "x"), "C": ("y", "y")}
    assert len(paths) == len(set(paths)) and not any("gen=1" in p for p in paths)
    assert push("AD", "z") == {"A": ("x", "x"), "D": ("z", "z")}
    assert sorted(read("tli=1/range=r0/gen=1/00000000.parquet")["name"].to_pylist()) == list("ABC")
