"""Watching arrivals: required segments, archive lag, replica liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lsn import int_div
from ..session import materialize

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Numbers of one piece of a requirement: a backup's state is spread over pieces.
PIECE = 1 << 14
#: Keys of the state. Pieces are dealt over them by hash, so that very many small backups share the cost of a key.
SHELVES = 1 << 10
#: What stands for a timeline, and for a number, of a segment that cannot be named, and of no segment at all.
UNKNOWN, NOTHING = -1, -2


def _pieces():
    """The processor of pieces, built as a closure so that tasks need no package import."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    nothing, most = NOTHING, 1 << 18

    def sorted_rows(batch):
        """Names of owners, and (owner's place, piece, tli, number, the batch's order) sorted."""
        codes, names = pd.factorize(batch["owner"])
        piece, tli, number = (batch[c].to_numpy("int64") for c in ("piece", "tli", "seg_no"))
        order = np.lexsort((number, tli, piece, codes))
        return names, codes[order], piece[order], tli[order], number[order], order

    def joined(spans):
        """Ranges of an entry that came in several parts, each number once."""
        out = []
        for tli, low, high in sorted(spans):
            if out and out[-1][0] == tli and low <= out[-1][2] + 1:
                out[-1] = (tli, out[-1][1], max(high, out[-1][2]))
            else:
                out.append((tli, low, high))
        return out

    def without(span, seen):
        """What is left of one range after some of its numbers were seen."""
        tli, low, high = span
        hit = seen[np.searchsorted(seen, low) : np.searchsorted(seen, high, "right")]
        if not len(hit):
            return [span]
        first, last = [low, *(hit + 1).tolist()], [*(hit - 1).tolist(), high]
        return [(tli, a, b) for a, b in zip(first, last) if a <= b]

    def out(rows):
        owners, status, *numbers = zip(*rows)
        number = lambda v: pd.array([None if x < 0 else x for x in v], dtype="Int64")
        tli, low, high = map(number, numbers)
        return pd.DataFrame({"owner": owners, "status": status, "tli": tli, "low": low, "high": high})

    class Outstanding(StatefulProcessor):
        """Keeps the ranges the pieces of a shelf still wait for; they shrink as segments arrive.

        A shelf has one timer, at the earliest moment of its pieces. If that piece
        completes before, the timer finds nothing due and only asks for the next.
        """

        def init(self, handle):
            self.handle = handle
            self.open = handle.getValueState(
                "open", "owner ARRAY<STRING>, piece ARRAY<BIGINT>, moment ARRAY<BIGINT>, tli ARRAY<BIGINT>, low ARRAY<BIGINT>, high ARRAY<BIGINT>"
            )

        def load(self):
            """{(owner, piece): (moment, ranges)}"""
            value, entries = self.open.get(), {}
            for owner, piece, moment, *span in [] if value is None else zip(*value):
                entries.setdefault((owner, piece), (moment, []))[1].append(tuple(span))
            return entries

        def store(self, entries):
            rows = [(*key, moment, *span) for key, (moment, spans) in entries.items() for span in spans]
            if rows:
                self.open.update(tuple(list(c) for c in zip(*rows)))
            else:
                self.open.clear()

        def handleInitialState(self, key, initialState, timerValues):
            entries = self.load()
            names, code, piece, tli, number, order = sorted_rows(initialState)
            moments = initialState["moment"].to_numpy("int64")[order]
            new = np.ones(len(code), dtype=bool)
            new[1:] = (np.diff(code) != 0) | (np.diff(piece) != 0) | (np.diff(tli) != 0) | (np.diff(number) > 1)
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(code)])) - 1
            known, again = set(entries), set()
            for c, p, t, low, high, moment in zip(*(v.tolist() for v in (code[first], piece[first], tli[first], number[first], number[last], moments[first]))):
                entry = (names[c], p)
                entries.setdefault(entry, (moment, []))[1].append((t, low, high))
                if entry in known:
                    again.add(entry)
            for entry in again:
                entries[entry] = (entries[entry][0], joined(entries[entry][1]))
            self.store(entries)
            earliest = min(moment for moment, _ in entries.values())
            if earliest not in [int(t) for t in self.handle.listTimers()]:
                self.handle.registerTimer(earliest)

        def handleInputRows(self, key, rows, timerValues):
            entries, done, held, size = self.load(), [], [], 0

            def see():
                names, code, piece, tli, number, _ = sorted_rows(pd.concat(held) if len(held) > 1 else held[0])
                new = np.ones(len(code), dtype=bool)
                new[1:] = (np.diff(code) != 0) | (np.diff(piece) != 0) | (np.diff(tli) != 0)
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(code)]))
                for c, p, t, a, b in zip(*(v.tolist() for v in (code[first], piece[first], tli[first], first, last))):
                    entry = (names[c], p)
                    if entry not in entries:
                        continue
                    seen, (moment, spans) = np.unique(number[a:b]), entries[entry]
                    spans = [r for s in spans for r in (without(s, seen) if s[0] == t else [s])]
                    if spans:
                        entries[entry] = (moment, spans)
                    else:
                        del entries[entry]
                        done.append((names[c], "complete", -1, -1, -1))

            for batch in rows:
                held.append(batch)
                size += len(batch)
                if size >= most:
                    see()
                    held, size = [], 0
            if size:
                see()
            self.store(entries)
            if done:
                yield out(done)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            entries, told = self.load(), []
            fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
            for entry, (moment, spans) in list(entries.items()):
                if moment <= fired or moment < now:
                    del entries[entry]
                    # A backup that needs nothing is done as soon as the stream knows any time.
                    told += [(entry[0], "complete", -1, -1, -1) if s[0] == nothing else (entry[0], "timeout", *s) for s in spans]
            self.store(entries)
            if entries:
                self.handle.registerTimer(min(moment for moment, _ in entries.values()))
            if told:
                yield out(told)

        def close(self):
            pass

    return Outstanding()


def _counter():
    """Counts the pieces of backups that are complete; the last one completes a backup."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Remaining(StatefulProcessor):
        """Keeps a number for each backup of more than one piece."""

        def init(self, handle):
            self.left = handle.getValueState("left", "owner ARRAY<STRING>, n ARRAY<BIGINT>")

        def load(self):
            value = self.left.get()
            return {} if value is None else dict(zip(*value))

        def store(self, left):
            self.left.update((list(left), list(left.values())))

        def handleInitialState(self, key, initialState, timerValues):
            left = self.load()
            left.update(zip(initialState["owner"], (int(n) for n in initialState["pieces"])))
            self.store(left)

        def handleInputRows(self, key, rows, timerValues):
            left = self.load()
            counted = bool(left)
            for batch in rows:
                missed = batch[batch["status"] == "timeout"]
                if len(missed):
                    yield missed[["owner", "status", "tli", "low", "high"]]
                complete = []
                for owner in batch.loc[batch["status"] == "complete", "owner"]:
                    n = left.get(owner, 1) - 1
                    if owner in left:
                        left[owner] = n
                    if not n:
                        complete.append(owner)
                if complete:
                    nothing = pd.array([None] * len(complete), dtype="Int64")
                    yield pd.DataFrame({"owner": complete, "status": "complete", "tli": nothing, "low": nothing, "high": nothing})
            if counted:
                self.store(left)

        def close(self):
            pass

    return Remaining()


def watch_required(required: DataFrame, arrivals: DataFrame, delay: str = "0 seconds", backups: DataFrame | None = None, shelves: int = SHELVES) -> DataFrame:
    """Stream of ``(backup_id, status, tli, seg_no)``.

    One ``complete`` row once every required segment arrived by the deadline;
    otherwise, when event time passes the deadline, one ``timeout`` row per
    missing segment. ``required`` is a table ``(backup_id, tli, seg_no,
    deadline)``, ``arrivals`` a stream ``(tli, seg_no, ts)``. A required segment
    without a number never arrives. ``backups`` ``(backup_id)`` are all that are
    watched: one that needs nothing is complete as soon as time moves.

    The state of a backup is kept in pieces of at most ``PIECE`` numbers, so a
    backup of any size is spread over the tasks, and pieces are kept in
    ``shelves``, so the calls of the state do not grow with the backups. Their
    number must stay the same for a stream that is started again. A second, small
    state counts the pieces of backups that have several. Missing segments travel
    as ranges and are written out last. Ids are values that a cast to text and
    back keeps.
    """
    spark = arrivals.sparkSession
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
    id_type = required.schema["backup_id"].dataType
    number = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([T.StructField("owner", T.StringType()), T.StructField("status", T.StringType()), number("tli"), number("low"), number("high")])
    # Arrivals nobody waits for move time as well: a condition that is not
    # deterministic keeps the filters of the join from going below the watermark.
    timed = arrivals.select("tli", "seg_no", "ts").withWatermark("ts", delay).where(F.spark_partition_id() >= 0)
    # No NULL enters the state: an id is text after a sign, a segment without a name has numbers of its own.
    owner = F.coalesce(F.concat(F.lit("="), F.col("backup_id").cast("string")), F.lit("")).alias("owner")
    piece = F.coalesce(int_div("seg_no", PIECE), F.lit(-1)).alias("piece")
    named = F.col("tli").isNotNull() & F.col("seg_no").isNotNull()
    numbers = [F.when(named, F.col(c)).otherwise(UNKNOWN).cast("bigint").alias(c) for c in ("tli", "seg_no")]
    wanted = required.select(owner, *numbers, "deadline", piece, named.alias("named"))
    if backups is not None:
        none, epoch = F.lit(NOTHING).cast("bigint"), F.timestamp_millis(F.lit(1))
        idle = backups.select("backup_id").distinct().join(required.select("backup_id").distinct(), "backup_id", "left_anti")
        wanted = wanted.unionByName(idle.select(owner, none.alias("tli"), none.alias("seg_no"), epoch.alias("deadline"), F.lit(-1).cast("bigint").alias("piece"), F.lit(False).alias("named")))
    shelf = lambda *key: F.pmod(F.xxhash64(*key), F.lit(shelves)).alias("shelf")
    # Read by the join and by both states.
    wanted = materialize(wanted.select(shelf("owner", "piece"), "*", F.unix_millis("deadline").alias("moment")))
    hits = (
        timed.join(wanted.where("named").select("shelf", "owner", "piece", "tli", "seg_no", "deadline"), ["tli", "seg_no"])
        .where(F.col("ts") <= F.col("deadline"))
        .select("shelf", "owner", "piece", "tli", "seg_no", "ts")
    )
    start = wanted.select("shelf", "owner", "piece", "tli", "seg_no", "moment")
    pieces = hits.groupBy("shelf").transformWithStateInPandas(_pieces(), schema, "Append", "EventTime", initialState=start.groupBy("shelf"))
    counts = wanted.groupBy("owner").agg(F.count_distinct("piece").alias("pieces")).where("pieces > 1").select(shelf("owner"), "owner", "pieces")
    told = pieces.select(shelf("owner"), "*").groupBy("shelf").transformWithStateInPandas(_counter(), schema, "Append", "None", initialState=counts.groupBy("shelf"))
    missing = F.when(F.col("low").isNotNull(), F.sequence("low", "high")).otherwise(F.array(F.lit(None).cast("bigint")))
    backup_id = F.when(F.col("owner") != "", F.col("owner").substr(F.lit(2), F.length("owner"))).cast(id_type).alias("backup_id")
    return told.select(backup_id, "status", "tli", F.explode(missing).alias("seg_no"))


def archive_lag(markers: DataFrame, arrivals: DataFrame, timeout: str, delay: str = "1 minute") -> DataFrame:
    """Stream of ``(marker_id, written_at, seen_at, reached)``.

    ``markers`` ``(marker_id, tli, name, ts)`` were written to the log;
    ``arrivals`` ``(tli, name, ts)`` are seen in the archive. A marker not seen
    within ``timeout`` comes out with ``reached = false`` as event time passes.
    """
    m = markers.select("marker_id", F.col("tli").alias("m_tli"), F.col("name").alias("m_name"), F.col("ts").alias("written_at"))
    a = arrivals.select(F.col("tli").alias("a_tli"), F.col("name").alias("a_name"), F.col("ts").alias("seen_at"))
    m, a = m.withWatermark("written_at", delay), a.withWatermark("seen_at", delay)
    in_time = (F.col("seen_at") >= F.col("written_at")) & (
        F.col("seen_at") <= F.col("written_at") + F.expr(f"INTERVAL {timeout}")
    )
    same = (F.col("m_tli") == F.col("a_tli")) & (F.col("m_name") == F.col("a_name"))
    return m.join(a, same & in_time, "left_outer").select(
        "marker_id", "written_at", "seen_at", F.col("seen_at").isNotNull().alias("reached")
    )


def _standby_ok(sample: Column) -> Column:
    replaying = F.coalesce(sample["replay_lsn"], F.lit("")) != ""
    fed = (F.coalesce(sample["receivers"], F.lit(0)) > 0) | (F.coalesce(sample["restore_command"], F.lit("")) != "")
    return ~F.coalesce(sample["in_recovery"], F.lit(False)) | (replaying & fed)


def replica_liveness(samples: DataFrame) -> DataFrame:
    """Per host, from its latest sample: ``(host, ts, ok)``. Batch or stream.

    A primary is always fine. A standby is fine while it replays and has either
    a streaming receiver or a restore command. ``samples`` is ``(host, ts,
    in_recovery, replay_lsn, receivers, restore_command)``; only the latest
    sample per host is kept as state.
    """
    fields = ["ts", "in_recovery", "replay_lsn", "receivers", "restore_command"]
    # Comparing the whole struct breaks ties of equal times the same way on every run.
    latest = samples.groupBy("host").agg(F.max(F.struct(*fields)).alias("s"))
    return latest.select("host", F.col("s.ts").alias("ts"), _standby_ok(F.col("s")).alias("ok"))
