"""Segments, spans, units and cues: window functions and ordered folds per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranks import LONG, carried, long_keys, ranged, with_places
from .scan import scan_islands, scan_ordered, with_running

ALL_BEFORE = (Window.unboundedPreceding, -1)


def pair_speech_events(events: DataFrame, most: int = 30_000) -> DataFrame:
    """Intervals from open and close marks: events (job_id, seq, start_ms, end_ms; -1 for none) to (job_id, seq, start_ms, end_ms).

    A close takes the last open start since the close before it, or at most `most` back; empty ones go; a start left open at the
    end of a job closes at the job's last time, column total_ms if there is one."""
    w = Window.partitionBy("job_id").orderBy("seq")
    e = events.withColumn("group", F.coalesce(F.sum((F.col("end_ms") >= 0).cast("long")).over(w.rowsBetween(*ALL_BEFORE)), F.lit(0)))
    g = Window.partitionBy("job_id", "group").orderBy("seq")
    e = e.withColumn("open", F.last(F.when(F.col("start_ms") >= 0, F.col("start_ms")), ignorenulls=True).over(g.rowsBetween(Window.unboundedPreceding, 0)))
    closed = e.filter(F.col("end_ms") >= 0).select("job_id", "seq", F.coalesce("open", F.greatest(F.lit(0).cast("long"), F.col("end_ms") - most)).alias("start_ms"), "end_ms")
    if "total_ms" in events.columns:
        last = e.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).filter((F.col("n") == 1) & (F.col("end_ms") < 0) & F.col("open").isNotNull())
        closed = closed.unionByName(last.select("job_id", "seq", F.col("open").alias("start_ms"), F.col("total_ms").alias("end_ms")))
    return closed.filter("end_ms > start_ms")


def group_spans(spans: DataFrame, gap: int = 700, cap: int = 30_000, long: int = LONG) -> DataFrame:
    """Greedy groups of spans (job_id, start_ms, end_ms): a span joins while its gap is small and the group stays within the cap.

    A span that starts more than `gap` after every earlier one has ended begins a group; jobs of more than `long` spans are cut there."""

    def fold(rows):
        job = first = last = None
        number = 0
        for key, start, end in rows:
            if job is not None and start - last <= gap and end - first <= cap:
                last = max(last, end)
                continue
            if job is not None:
                yield job, number, first, last
                number += 1
            job, first, last = key, start, end
        if job is not None:
            yield job, number, first, last

    kind = dict(spans.dtypes)["job_id"]
    good = spans.filter("end_ms > start_ms").select("job_id", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))
    far = lambda reach: F.col("start_ms") - reach > gap
    return scan_islands(good, ["start_ms", "end_ms"], fold, f"job_id {kind}, chunk_no int, start_ms long, end_ms long", far, F.col("end_ms"), "chunk_no", 0, long)


def chunk_overlap(groups: DataFrame, extra: int = 2500, near: int = 100) -> DataFrame:
    """Chunks that reach into a close neighbour; own_start_ms and own_end_ms are the group's."""
    w = Window.partitionBy("job_id").orderBy("chunk_no")
    before, after = F.lag("end_ms").over(w), F.lead("start_ms").over(w)
    more = lambda close: F.when(F.coalesce(close, F.lit(False)), extra).otherwise(0)
    return groups.select(
        "job_id",
        "chunk_no",
        F.greatest(F.lit(0), F.col("start_ms") - more(F.col("start_ms") - before <= near)).cast("long").alias("start_ms"),
        (F.col("end_ms") + more(after - F.col("end_ms") <= near)).cast("long").alias("end_ms"),
        F.col("start_ms").alias("own_start_ms"),
        F.col("end_ms").alias("own_end_ms"),
    )


def dedupe_overlaps(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Rows (job_id, start_ms, end_ms, text) in time order without those that repeat a stretch already covered; idx from 1.

    A row that starts when every earlier one has ended is kept, and all that matters from then on; jobs of more than `long` rows are cut there."""

    def fold(group):
        prev_start = prev_end = -1
        n = 0
        for job, start, end, text in group:
            shared = max(0, min(prev_end, end) - max(prev_start, start))
            inside = end <= prev_end and start < prev_end - 500
            if prev_end > 0 and (inside or shared > 0.65 * max(1, min(end - start, prev_end - prev_start))):
                continue
            prev_start, prev_end, n = start, max(prev_end, end), n + 1
            yield job, n, start, end, text

    kind = dict(rows.dtypes)["job_id"]
    apart = lambda reach: F.least("start_ms", "end_ms") >= reach
    return scan_islands(rows.select("job_id", "start_ms", "end_ms", "text"), ["start_ms", "end_ms", "text"], fold, f"job_id {kind}, idx long, start_ms long, end_ms long, text string", apart, F.col("end_ms"), "idx", 1, long)


def paragraphs(rows: DataFrame, gap: int = 1500, span: int = 60_000, chars: int = 240, long: int = LONG) -> DataFrame:
    """Paragraph texts of rows (job_id, idx, start_ms, end_ms, text). A row more than `gap` after every earlier end begins one; jobs of
    more than `long` rows are cut there."""

    def fold(group):
        job, parts, size, first, last, n = None, [], 0, 0, -1, 0
        for key, _, start, end, text in group:
            if parts and (start - last > gap or start - first > span or size > chars):
                yield job, n, first, "".join(parts)
                parts, size, n = [], 0, n + 1
            if not parts:
                first = start
            job, last, size = key, max(last, end), size + len(text)
            parts.append(text)
        if parts:
            yield job, n, first, "".join(parts)

    kind = dict(rows.dtypes)["job_id"]
    far = lambda reach: (F.col("start_ms") - F.greatest(reach, F.lit(-1)) > gap) & (F.col("end_ms") >= reach)
    return scan_islands(rows.select("job_id", "idx", "start_ms", "end_ms", "text"), ["idx"], fold, f"job_id {kind}, paragraph int, start_ms long, text string", far, F.col("end_ms"), "paragraph", 0, long)


def sentence_groups(rows: DataFrame, most: int = 6, chars: int = 120, row_chars: int = 80, ends: str = "。！？!?…") -> DataFrame:
    """Group number and place for each row (job_id, idx, text, optional cached): short uncached rows up to a sentence end."""

    def fold(group):
        number, size, total, open_ = -1, 0, 0, False
        for job, idx, text, cached in group:
            body = (text or "").strip()
            joins = bool(body) and len(text) <= row_chars and not cached
            if not joins or not open_:
                number, size, total = number + 1, 0, 0
            size, total = size + 1, total + len(text or "")
            yield job, idx, number, size, joins
            open_ = joins and not (body[-1] in ends or size >= most or total >= chars)

    kind = dict(rows.dtypes)["job_id"]
    cached = F.coalesce(F.col("cached"), F.lit(False)) if "cached" in rows.columns else F.lit(False)
    return scan_ordered(rows.select("job_id", "idx", "text", cached.alias("cached")), ["job_id"], ["idx"], fold, f"job_id {kind}, idx long, group_no int, place int, grouped boolean")


def narration_units(rows: DataFrame, style: tuple[int, int, bool] | None, most: int = 220, scene: int = 1500, long: int = LONG) -> DataFrame:
    """Units (job_id, index, rows, text, gap_after_ms, start_ms, end_ms) of rows (job_id, idx, start_ms, end_ms, text).

    A unit ends with a sentence, before a new scene, or before the row that would make it longer than `most` characters, a space
    counted after each row. Rows are first cut where a sentence or scene must end, then by a running length within such a stretch; a unit
    is never longer than `most` and a row. In jobs of more than `long` rows the row before, the stretch and the unit after are
    carried between ranges of rows, and stretches are tasks' work of their own."""
    if style is None:
        return rows.select("job_id", F.col("idx").alias("index"), F.lit(1).alias("rows"), "text", F.lit(None).cast("int").alias("gap_after_ms"), "start_ms", "end_ms")
    df = rows.select("job_id", "idx", "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text")).withColumn("_bare", X.strip(F.col("text")))
    df = df.withColumn("_size", F.length("text") + 1).withColumn("_own", F.length("_bare"))
    must = F.coalesce(X.sentence_end(F.col("_before")) | (F.col("start_ms") - F.col("_ended") >= scene), F.lit(True))
    job = ["job_id"]

    def step(state, row):
        must, size, own = row
        if must or state[0] + own > most:
            state[:] = [0, state[1] + 1]
        state[0] += size
        return (state[1],)

    def units_of(cut: DataFrame, *keys: str) -> DataFrame:
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_own") > 0, F.struct("idx", "_bare")))), lambda x: x["_bare"]), " ")
        return cut.groupBy("job_id", *keys, "_unit").agg(F.min("idx").alias("index"), F.count("*").cast("int").alias("rows"), text.alias("text"), F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"))

    def finished(units: DataFrame) -> DataFrame:
        gap, long_gap, cues = style
        spoken = units.withColumn("text", X.add_cues(F.col("text"))) if cues else units
        pause = F.when(F.col("_next").isNull(), 0).when((F.col("_next") - F.col("end_ms") >= scene) | X.long_end(F.col("text")), long_gap).otherwise(gap)
        return spoken.select("job_id", "index", "rows", "text", pause.cast("int").alias("gap_after_ms"), "start_ms", "end_ms")

    def whole(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("job_id").orderBy("idx")
        cut = df.withColumn("_before", F.lag("_bare").over(w)).withColumn("_ended", F.lag("end_ms").over(w)).withColumn("_must", must)
        units = units_of(with_running(cut, "job_id", ["idx"], ["_must", "_size", "_own"], "_unit long", lambda: [0, 0], step))
        return finished(units.withColumn("_next", F.lead("start_ms").over(Window.partitionBy("job_id").orderBy("index"))))

    def in_ranges(df: DataFrame) -> DataFrame:
        cut = carried(ranged(df, job, ["idx"]), job, lags={"_before": F.col("_bare"), "_ended": F.col("end_ms")}).withColumn("_must", must)
        cut = carried(cut, job, sums={"_stretch": F.col("_must").cast("long")}).withColumn("_key", F.struct("job_id", "_stretch"))
        units = units_of(with_running(cut.repartition("_key"), "_key", ["idx"], ["_must", "_size", "_own"], "_unit long", lambda: [0, 0], step), "_stretch")
        return finished(carried(ranged(units, job, ["index"]), job, leads={"_next": F.col("start_ms")}))

    known = long_keys(df, "job_id", long)
    if known is None:
        return whole(df)
    return whole(df.join(known, "job_id", "left_anti")).unionByName(in_ranges(df.join(known, "job_id", "left_semi")))


def unit_offsets(units: DataFrame) -> DataFrame:
    """units (job_id, index, length_ms, gap_ms) with start_ms and end_ms, laid one after another."""
    w = Window.partitionBy("job_id").orderBy("index").rowsBetween(*ALL_BEFORE)
    start = F.coalesce(F.sum(F.col("length_ms") + F.coalesce("gap_ms", F.lit(0))).over(w), F.lit(0)).cast("long")
    return units.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("length_ms"))


def share_unknown_lengths(units: DataFrame) -> DataFrame:
    """Units without a length (job_id, index, text, length_ms, gap_ms, total_ms) share the time left by their characters."""
    job = Window.partitionBy("job_id")
    weight = F.when(F.col("length_ms").isNull(), F.greatest(F.lit(1), F.length("text")))
    left = F.greatest(F.lit(0), F.col("total_ms") - F.coalesce(F.sum("length_ms").over(job), F.lit(0)) - F.sum(F.coalesce("gap_ms", F.lit(0))).over(job))
    share = F.bround(left * weight / F.sum(weight).over(job)).cast("long")
    return units.withColumn("length_ms", F.coalesce(F.col("length_ms").cast("long"), share))


def build_cues(units: DataFrame, max_chars: int = 84, min_seconds: float = 1.0, normalize: bool = True) -> DataFrame:
    """Subtitle cues of units (job_id, index, text, length_ms, gap_ms, optional total_ms).

    A unit's pieces share its time by their characters, the last one ends with it; short cues last `min_seconds`, but never into the
    next; none goes beyond the total; empty ones go. Pieces become rows at once, so a text is split once; all else are windows over the
    pieces of a job or unit, which share one exchange by job. `normalize` as in split_text."""
    known = share_unknown_lengths(units) if "total_ms" in units.columns else units
    total = ["total_ms"] if "total_ms" in units.columns else []
    pieces = unit_offsets(known).select("job_id", "index", "start_ms", "end_ms", "length_ms", *total, F.posexplode(X.split_text(F.col("text"), max_chars, normalize)).alias("piece", "text"))
    chars = F.length("text")
    unit, order = Window.partitionBy("job_id", "index"), Window.partitionBy("job_id").orderBy("index", "piece")
    df = pieces.withColumn("_part", F.bround(F.col("length_ms") * chars / F.sum(chars).over(unit)).cast("long"))
    since = F.coalesce(F.sum("_part").over(unit.orderBy("piece").rowsBetween(*ALL_BEFORE)), F.lit(0))
    df = df.withColumn("_from", F.col("start_ms") + since).withColumn("_last", F.col("piece") == F.max("piece").over(unit))
    following, wanted = F.lead("_from").over(order), F.col("_from") + int(min_seconds * 1000)
    own = F.when(F.col("_last"), F.col("end_ms")).otherwise(F.col("_from") + F.col("_part"))
    df = df.withColumn("_to", F.when(own >= wanted, own).otherwise(F.greatest(own, F.least(wanted, following))))
    if total:
        df = df.withColumn("_to", F.when(F.col("total_ms") > 0, F.least("_to", "total_ms")).otherwise(F.col("_to")))
    kept = df.filter(F.col("_to") > F.col("_from"))
    return kept.select("job_id", F.row_number().over(order).alias("cue_no"), F.col("_from").alias("start_ms"), F.col("_to").alias("end_ms"), X.two_lines(F.col("text")).alias("text"))


def rolling_context(rows: DataFrame, n: int = 512) -> DataFrame:
    """rows with the last n characters of all earlier text of the job, whatever rows hold it; rows pass in order with a state of n
    characters. A null text is an empty one."""

    def step(state, row):
        before = state[0]
        if row[0]:
            state[0] = (before + row[0])[-n:] if n else ""
        return (before,)

    return with_running(rows.repartition("job_id"), "job_id", ["idx"], ["text"], "context string", lambda: [""], step)


def contiguous_prefix(rows: DataFrame, done: str = "done") -> DataFrame:
    """Rows before the first that is not done."""
    first = F.min(F.when(~F.coalesce(F.col(done), F.lit(False)), F.col("idx"))).over(Window.partitionBy("job_id"))
    return rows.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col("idx") < F.col("_first"))).drop("_first")


def assign_numbers(jobs: DataFrame, scope: str = "scope") -> DataFrame:
    """Jobs without workflow_no are numbered by (created_at, id) after the largest number (or column last_no) of their scope.

    Scopes are few and large: places come from ranges of jobs, the largest numbers from one aggregate."""
    last = [F.max("workflow_no"), *([F.max("last_no")] if "last_no" in jobs.columns else [])]
    most = jobs.groupBy(scope).agg(F.coalesce(F.greatest(*last) if len(last) > 1 else last[0], F.lit(0)).alias("_most")).withColumnRenamed(scope, "_scope")
    placed = with_places(jobs.withColumn("_new", F.col("workflow_no").isNull()), [scope, "_new"], ["created_at", "id"])
    numbered = placed.join(most, F.col(scope).eqNullSafe(F.col("_scope")), "left")
    number = F.coalesce(F.col("workflow_no").cast("long"), (F.col("_most") + F.col("_place")).cast("long"))
    return numbered.select(*[number.alias(c) if c == "workflow_no" else F.col(c) for c in jobs.columns])


def chunk_rows(rows: DataFrame, size: int = 100) -> DataFrame:
    """Nonblank rows with chunk_no."""
    there = rows.filter(F.length(X.strip(F.col("text"))) > 0)
    return there.withColumn("chunk_no", F.floor((F.row_number().over(Window.partitionBy("job_id").orderBy("idx")) - 1) / size).cast("int"))


def attempt_cutoff(attempts: DataFrame, final: str = "final") -> DataFrame:
    """Attempts up to the first final error."""
    seen = F.max(F.col(final).cast("int")).over(Window.partitionBy("job_id").orderBy("attempt_no").rowsBetween(*ALL_BEFORE))
    return attempts.withColumn("_seen", seen).filter(F.coalesce("_seen", F.lit(0)) == 0).drop("_seen")


def lru_keep(entries: DataFrame, key: str = "scope", most_bytes: int = 1 << 30, most: int = 1000) -> DataFrame:
    """The most recent entries (used_at, name, size) of each key within both limits, by running counts and sums over ranges of entries."""
    kept = with_places(entries, [key], [F.desc("used_at"), F.asc("name")], ["size"])
    return kept.filter((F.col("_place") <= most) & (F.col("_sum_size") <= most_bytes)).drop("_place", "_sum_size")


def last_state(transitions: DataFrame) -> DataFrame:
    """Per job and step the current state, attempts (RUNNING marks) and retries; transitions have job_id, step, at, seq, state."""
    return transitions.groupBy("job_id", "step").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.sum((F.col("state") == "RUNNING").cast("long")).alias("attempt"), F.greatest(F.sum((F.col("state") == "RUNNING").cast("long")) - 1, F.lit(0)).alias("retry_count"))


def first_unfinished(states: DataFrame, order: list[str]) -> DataFrame:
    """Per job the first step, in order, that is not completed; null if all are."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("step"))
    return states.groupBy("job_id").agg(F.min_by("step", F.when(F.col("state") != "COMPLETED", place)).alias("next_step"), F.max((F.col("state") != "COMPLETED").cast("int")).alias("_open")).select("job_id", F.when(F.col("_open") == 1, F.col("next_step")).alias("next_step"))


def phase_view(jobs: DataFrame) -> DataFrame:
    """The four phases of transcription of jobs (job_id, status, state, has_vad, has_chunks, chunks_done, chunks_total, duration_ms, processed_ms)."""
    done = F.col("state") == "COMPLETED"
    current = F.when(done, 5).when(F.col("status").isin("MERGING", "TRANSCRIPTION_COMPLETED"), 4).when(F.col("status") == "VAD", 1).when(F.col("has_chunks") | (F.coalesce("chunks_total", F.lit(0)) > 0), 3).when(F.col("has_vad"), 2).otherwise(1)
    df = jobs.withColumn("_current", current).withColumn("phase", F.explode(F.sequence(F.lit(1), F.lit(4))))
    here = F.col("phase") == F.col("_current")
    state = F.when(done | (F.col("phase") < F.col("_current")), "COMPLETED").when(here & F.col("state").isNotNull() & (F.col("state") != "PENDING"), F.col("state")).otherwise("PENDING")
    df = df.withColumn("phase_state", state)
    progress = (
        F.when(F.col("phase_state") == "COMPLETED", 100.0)
        .when(F.col("phase_state") == "PENDING", 0.0)
        .when((F.col("phase") == 3) & (F.col("chunks_total") > 0), 100.0 * F.coalesce("chunks_done", F.lit(0)) / F.col("chunks_total"))
        .when((F.col("phase") == 1) & (F.col("status") == "VAD") & (F.col("duration_ms") > 0), 100.0 * F.coalesce("processed_ms", F.lit(0)) / F.col("duration_ms"))
    )
    return df.select("job_id", "phase", F.col("phase_state").alias("state"), progress.alias("progress"))


def failure_history(errors: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per job and row the number of failures and the latest detail, without rows since resolved (job_id, idx)."""
    per = errors.groupBy("job_id", "idx").agg(F.count("*").alias("failure_count"), F.max_by("detail", F.struct("failed_at", "detail")).alias("detail"))
    return per.join(resolved.select("job_id", "idx").distinct(), ["job_id", "idx"], "left_anti")
