"""The incremental operators as Structured Streaming queries; each gives what its batch form gives over the same rows."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import address, relations, rewrite
from ..sources.store import materialize
from .tables import KeyedTable


def _stateful(stream: DataFrame, columns: list[str], step: Callable[[tuple, dict, list[tuple]], Iterator[tuple]], schema: str, start: Callable[[], dict]) -> DataFrame:
    """A fold per job whose state is a small JSON object."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else start()
        rows = sorted((r for f in frames for r in f[columns].itertuples(index=False, name=None)), key=lambda r: r[0])
        out = list(step(key, held, rows))
        state.update((json.dumps(held, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy("job_id").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


#: The state store that keeps maps and lists; others keep one value for a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Release(StatefulProcessor):
    """Per job the next row to go out, and the rows that wait for it, each an entry of its own."""

    def __init__(self, first: int, rest: list[str], schema: str) -> None:
        self.first, self.rest, self.schema = first, rest, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ahead = handle.getValueState("ahead", "idx long")
        self.waiting = handle.getMapState("waiting", "idx long", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        start = ahead = self.ahead.get()[0] if self.ahead.exists() else self.first
        early = {r.idx: tuple(r[c] for c in self.rest) for r in rows if r.idx >= ahead}
        while True:
            if ahead in early:
                held = early.pop(ahead)
            elif self.waiting.containsKey((ahead,)):
                held = tuple(self.waiting.getValue((ahead,)))
                self.waiting.removeKey((ahead,))
            else:
                break
            yield Row(job_id=key[0], idx=ahead, **dict(zip(self.rest, held)))
            ahead += 1
        for idx, held in early.items():
            self.waiting.updateValue((idx,), held)
        if ahead != start:
            self.ahead.update((ahead,))

    def close(self) -> None:
        pass


def ordered_release(stream: DataFrame, first: int = 1) -> DataFrame:
    """Rows (job_id, idx, any others) in order: those up to the first that is missing, as soon as they are.

    Rows that wait are entries of a map on disk, so a row that never comes costs space, and each batch costs what it brings. A row
    that comes again after it went out is dropped; of two that wait the last holds. Sets the session's state store to STORE."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rest = [c for c in stream.columns if c not in ("job_id", "idx")]
    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in rest)
    return stream.groupBy("job_id").transformWithState(_Release(first, rest, schema), f"job_id long, idx long, {schema}", "Append", "None")


def stream_speech_intervals(stream: DataFrame, most: int = 30_000) -> DataFrame:
    """Intervals of events (job_id, seq, start_ms, end_ms) with the open start kept between batches."""

    def step(key, held, rows):
        for seq, start, end in rows:
            if start >= 0:
                held["open"] = int(start)
            if end >= 0:
                begin = held["open"] if held["open"] is not None else max(0, int(end) - most)
                held["open"] = None
                if end > begin:
                    yield key[0], int(seq), begin, int(end)

    return _stateful(stream, ["seq", "start_ms", "end_ms"], step, "job_id long, seq long, start_ms long, end_ms long", lambda: {"open": None})


class _Meaning(StatefulProcessor):
    """Per job whom its rows mean, in order: its people and their names, the next row, the rows that wait, and the last TRAIL rows.

    A job opens with its sheet; rows that come before it, or out of order, wait as entries of a map. What rows say by themselves comes
    with them, as the batch form finds it; here are the rules that look back."""

    WAITS = "text_zh string, call string, said array<string>, loose boolean, male boolean, female boolean, alone boolean, able boolean, kind string, text_vi string"

    def __init__(self, first: int) -> None:
        self.first, self.fields = first, [f.split(" ")[0] for f in self.WAITS.split(", ")]
        self.person = [f.split(":")[0] for f in address.PERSON[7:-1].split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ahead = handle.getValueState("ahead", "idx long")
        self.names = handle.getListState("names", "name string, id string")
        self.people = handle.getMapState("people", "id string", address.PERSON[7:-1].replace(":", " "))
        self.waiting = handle.getMapState("waiting", "idx long", self.WAITS)
        self.trail = handle.getListState("trail", "here array<string>, reads array<string>, male boolean, female boolean, called string")

    def handleInputRows(self, key, rows, timerValues):
        opened = self.ahead.exists()
        ahead = self.ahead.get()[0] if opened else self.first
        for r in rows:
            if r.names is not None and not opened:
                opened = True
                if r.names:
                    self.names.put([(n["name"], n["who"]["id"]) for n in r.names])
                for n in r.names:
                    self.people.updateValue((n["who"]["id"],), tuple(n["who"][f] for f in self.person))
            elif r.names is None and r.idx >= ahead:
                self.waiting.updateValue((r.idx,), tuple(r[c] for c in self.fields))
        if not opened:
            return
        names = [tuple(n) for n in self.names.get()] if self.names.exists() else []
        people = {id_: Row(**dict(zip(self.person, self.people.getValue((id_,))))) for id_ in dict.fromkeys(i for _, i in names)}
        trail = deque((tuple(t) for t in self.trail.get()) if self.trail.exists() else (), address.TRAIL)
        while self.waiting.containsKey((ahead,)):
            row = Row(**dict(zip(self.fields, self.waiting.getValue((ahead,)))))
            self.waiting.removeKey((ahead,))
            yield self._settled(key[0], ahead, row, names, people, trail)
            ahead += 1
        if trail:
            self.trail.put(list(trail))
        self.ahead.update((ahead,))

    @staticmethod
    def _settled(job, idx, row, names, people, trail) -> Row:
        here, left = [], row.text_zh
        for name, id_ in names:  # the longest first
            if name in left:
                left = left.replace(name, "\x01" * len(name))
                here += [] if id_ in here else [id_]
        scope = list(trail)[-address.SCOPE :]
        recent = list(dict.fromkeys(i for t in scope for i in t[0]))
        near = {i for t in scope[-address.NEAR :] for i in t[0]} | set(here)
        away = [i for i in recent if i not in here]
        leads = len(here) == 1 and any(row.text_zh.lstrip().startswith(n) for n, i in names if i == here[0])
        able = [i for i in (here if not away and leads else away) if people[i].role != "narrator"]
        who = people[able[0]] if len(able) == 1 else None
        wants = "她" if who is not None and who.gender == "female" else "他"
        sure = (
            who is not None
            and len({*recent, *here}) == 1
            and who.id in near
            and len(row.said) == 1
            and not row.loose
            and not any(t[2 if who.gender == "female" else 3] for t in scope)
            and who.gender in ("male", "female")
            and (who.auto is False or who.role == "family" or who.sure is True)
            and all(x == wants for t in trail for x in t[1])
        )
        called = next((i for n, i in names if n == row.call), None)
        answers = called if called is not None else trail[-1][4] if trail else None
        flips = sure and row.able and bool(who.form_third) and row.kind not in (None, who.gender)
        trail.append((here, [wants] if flips else list(row.said), row.male, row.female, called if row.alone else None))
        return Row(job_id=job, idx=idx, text_zh=row.text_zh, text_vi=row.text_vi, _who=who, _sure=sure, _called=None if answers is None else people[answers])

    def close(self) -> None:
        pass


def stream_pronouns(stream: DataFrame, sheets: DataFrame, profile: str = "neutral", first: int = 1) -> DataFrame:
    """rewrite_pronouns over a stream of rows (job_id, idx, text_zh, text_vi) in any order, each job by its own sheet.

    sheets is a stream with one row for each job: job_id and people, an array of characters, which may be empty. A job's rows wait for its
    sheet and for the rows before them; a sheet that comes again is ignored. Everything else is state, so no table is read."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    facts = address.said_by_itself(stream.select("job_id", F.col("idx").cast("long").alias("idx"), F.coalesce("text_zh", F.lit("")).alias("text_zh"), F.coalesce("text_vi", F.lit("")).alias("text_vi")))
    named = sheets.select("job_id", address.names_of(F.col("people"), profile).alias("names"))
    both = facts.unionByName(named, allowMissingColumns=True)
    person = address.PERSON
    meant = both.groupBy("job_id").transformWithState(_Meaning(first), f"job_id long, idx long, text_zh string, text_vi string, _who {person}, _sure boolean, _called {person}", "Append", "None")
    return address.applied(meant).select("job_id", "idx", "text", "changes")


class _Frozen(StatefulProcessor):
    """Per job the first snapshot that it was opened with, and the rows that came before it was."""

    def __init__(self, rest: list[str], schema: str) -> None:
        self.rest, self.schema = rest, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.snapshot = handle.getValueState("snapshot", "id long")
        self.early = handle.getListState("early", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        known = self.snapshot.get()[0] if self.snapshot.exists() else None
        if known is None:
            opened = []
            for r in rows:
                if r.opens is not None:
                    opened.append(r.opens)
                else:
                    self.early.appendValue(tuple(r[c] for c in self.rest))
            if not opened:
                return
            known = min(opened)
            self.snapshot.update((known,))
            rows = self.early.get()
            for r in rows:
                yield Row(job_id=key[0], **dict(zip(self.rest, tuple(r))), snapshot_id=known)
            self.early.clear()
            return
        for r in rows:
            if r.opens is None:
                yield Row(job_id=key[0], **{c: r[c] for c in self.rest}, snapshot_id=known)

    def close(self) -> None:
        pass


def frozen_snapshot(stream: DataFrame, opens: DataFrame) -> DataFrame:
    """Rows of a stream (job_id, any others) with snapshot_id, the first one that a stream `opens` (job_id, snapshot_id) gives for their job;
    of two in one batch the smaller. Rows wait in state until their job is opened."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rest = [c for c in stream.columns if c != "job_id"]
    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in rest)
    both = stream.unionByName(opens.select("job_id", F.col("snapshot_id").cast("long").alias("opens")), allowMissingColumns=True)
    return both.groupBy("job_id").transformWithState(_Frozen(rest, schema), f"job_id long, {schema}, snapshot_id long", "Append", "None")


def stream_moderate(stream: DataFrame, opens: DataFrame, rules: str, out: str, column: str = "text"):
    """A writer of replace_terms where each job keeps the rules it began with.

    rules is a Parquet table (snapshot_id, rule_id, source, replacement) in folders by snapshot_id, to which snapshots are added but in which
    none is changed; a batch reads those of its jobs. Rows go to out/epoch=N, which a repeated batch overwrites."""

    def each(batch: DataFrame, epoch: int) -> None:
        rows = materialize(batch, "moderated")
        wanted = [r.snapshot_id for r in rows.select("snapshot_id").distinct().collect()]  # few: the versions of one rule table
        if wanted:
            table = batch.sparkSession.read.schema("rule_id string, source string, replacement string, snapshot_id long").parquet(rules).filter(F.col("snapshot_id").isin(wanted))
            rewrite.replace_by_snapshot(rows, column, table).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return frozen_snapshot(stream, opens).writeStream.foreachBatch(each)


class _Latest(StatefulProcessor):
    """Per key its last row by event time; forgotten once no row of it may come any more."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, state string, percent double")

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.last.get()) if self.last.exists() else None
        best = held
        for r in rows:
            mine = (r.at, r.state, r.percent)
            if best is None or (mine[0], mine[1] or "") > (best[0], best[1] or ""):
                best = mine
        if best is not None and best != held:
            self.last.update(best)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(best[0] // 1000 + self.keep_ms)
            yield Row(job_id=key[0], step=key[1], at=best[0], state=best[1], percent=best[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_progress(events: DataFrame, late: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """The latest percent and state of each job and step (job_id, step, ts, state, percent), whenever it changes; in update mode.

    Rows later than the watermark are dropped. A step's state goes `keep_ms` of event time after its last row; what a sink has stays."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.withWatermark("ts", late).select("job_id", "step", "ts", F.unix_micros("ts").alias("at"), "state", "percent")
    last = rows.groupBy("job_id", "step").transformWithState(_Latest(keep_ms), "job_id long, step string, at long, state string, percent double", "Update", "EventTime")
    return last.select("job_id", "step", F.timestamp_micros("at").alias("ts"), "state", "percent")


def upsert_writer(stream: DataFrame, table: KeyedTable, most_parts: int = 8):
    """A writer in update mode that keeps the last row of each key in a table; a batch that runs again changes nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, epoch)
        table.compact(epoch, most_parts)

    return stream.writeStream.outputMode("update").foreachBatch(each)


def job_progress(table: KeyedTable) -> DataFrame:
    """overall_progress of every job from a table of its steps' last rows (job_id, step, state, percent)."""
    return relations.overall_progress(table.read())


def stream_throughput(events: DataFrame, window: str = "30 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Sums of amount in sliding windows (job_id, ts, amount): in append mode once they are over, in update mode whenever they change. Rows
    of windows that are over are dropped."""
    return events.withWatermark("ts", late).groupBy("job_id", F.window("ts", window, slide).alias("w")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n")).select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "amount", "n")


def stale_heartbeats(beats: DataFrame, silence: str = "30 seconds", late: str | None = "10 minutes") -> DataFrame:
    """Runs of beats (job_id, ts) with no silence inside: first and last beat, and the time from which the key is stale, when a beat begins
    a new run. In append mode a run comes once the watermark has passed that time; beats later than the watermark are dropped. With
    late=None, for complete mode, no beat is late and all runs come, those still open too; all stay in the state, which is on disk."""
    if late is None:
        beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    else:
        beats = beats.withWatermark("ts", late)
    gap = f"{silence} -1 microseconds"  # a window also takes a beat at its end
    return beats.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("beats")).select("job_id", "first", "last", (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("stale_at"), "beats")


CHECKPOINT = "job_id long, stage string, idx long, fingerprint string, output string"


def checkpoint_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """Outputs by (job_id, stage, idx): the last fingerprint and output of a row hold."""
    return KeyedTable(spark, path, ["job_id", "stage", "idx"], CHECKPOINT, buckets)


def incremental_apply(stream: DataFrame, table: KeyedTable, fn: Callable[[DataFrame], DataFrame], most_parts: int = 8, first_epoch: int = 0):
    """A writer that computes only rows (job_id, stage, idx, fingerprint, ...) whose fingerprint the table lacks, and keeps what fn makes of
    them (job_id, stage, idx, fingerprint, output). A batch opens the buckets of its own keys; of rows that share a key the last by
    fingerprint is taken. Batches are numbered from `first_epoch` in the table."""

    def each(batch: DataFrame, epoch: int) -> None:
        rows = materialize(batch, "incremental")
        fresh = relations.pending_rows(rows, table.lookup(rows)).dropDuplicates(["job_id", "stage", "idx", "fingerprint"])
        last = F.row_number().over(Window.partitionBy("job_id", "stage", "idx").orderBy(F.desc("fingerprint")))
        table.upsert(fn(fresh.withColumn("_n", last).filter("_n = 1").drop("_n")), first_epoch + epoch)
        table.compact(first_epoch + epoch, most_parts)

    return stream.writeStream.foreachBatch(each)


def streak_guard(results: DataFrame, most: int = 5) -> DataFrame:
    """The row at which a job (job_id, idx, ok) has failed `most` times without a success between."""

    def step(key, held, rows):
        for idx, ok in rows:
            held["streak"] = 0 if ok else held["streak"] + 1
            if held["streak"] == most and not held["stopped"]:
                held["stopped"] = True
                yield key[0], int(idx)

    return _stateful(results, ["idx", "ok"], step, "job_id long, idx long", lambda: {"streak": 0, "stopped": False})


def streak_guard_batch(results: DataFrame, most: int = 5) -> DataFrame:
    """streak_guard over a table, by windows."""
    w = Window.partitionBy("job_id").orderBy("idx")
    run = F.coalesce(F.sum(F.col("ok").cast("int")).over(w), F.lit(0))
    df = results.withColumn("_run", run).withColumn("_n", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("job_id", "_run").orderBy("idx")))
    return df.filter((F.col("_n") == most) & ~F.col("ok")).groupBy("job_id").agg(F.min("idx").alias("idx"))
