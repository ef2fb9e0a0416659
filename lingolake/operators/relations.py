"""Joins, aggregations, top rows and set operations over segments, jobs, steps, files and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jobs as J
from ..functions import text as X

# Joins


def assign_ownership(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sentences (job_id, chunk_no, start_ms, end_ms relative to the chunk, text) that their chunk owns, in job time.

    A chunk owns what has its midpoint within its own bounds; the last chunk of a job has one millisecond more."""
    last = F.col("chunk_no") == F.max("chunk_no").over(Window.partitionBy("job_id"))
    c = chunks.select("job_id", "chunk_no", F.col("start_ms").alias("_at"), "own_start_ms", "own_end_ms", last.alias("_last"))
    df = sentences.join(c, ["job_id", "chunk_no"]).withColumn("_from", F.col("start_ms") + F.col("_at")).withColumn("_to", F.col("end_ms") + F.col("_at"))
    middle = F.col("_from") + F.col("_to")
    owned = df.filter((2 * F.col("own_start_ms") <= middle) & (middle < 2 * (F.col("own_end_ms") + F.col("_last").cast("int"))))
    return owned.select("job_id", "chunk_no", F.greatest(F.lit(0), "_from").cast("long").alias("start_ms"), F.greatest("_from", "_to").cast("long").alias("end_ms"), "text")


def owners_by_time(points: DataFrame, chunks: DataFrame, bin_ms: int = 30_000) -> DataFrame:
    """Range join of points (job_id, at_ms) with chunks (job_id, chunk_no, own_start_ms, own_end_ms): an equi join on time bins."""
    whole = lambda c: F.floor(F.col(c) / bin_ms)
    spread = chunks.withColumn("_bin", F.explode(F.sequence(whole("own_start_ms"), F.floor(F.greatest(F.col("own_end_ms") - 1, F.col("own_start_ms")) / bin_ms))))
    met = points.withColumn("_bin", whole("at_ms")).join(spread, ["job_id", "_bin"])
    return met.filter((F.col("own_start_ms") <= F.col("at_ms")) & (F.col("at_ms") < F.col("own_end_ms"))).drop("_bin")


def resume_rows(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """rows with the cached output of the same stage, idx and fingerprint, if any."""
    return rows.join(checkpoints.select("job_id", "stage", "idx", "fingerprint", "output"), ["job_id", "stage", "idx", "fingerprint"], "left")


def pending_rows(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    return rows.join(checkpoints, ["job_id", "stage", "idx", "fingerprint"], "left_anti")


def completed_stage(markers: DataFrame, files: DataFrame) -> DataFrame:
    """markers (job_id, stage, signature, wanted_signature, outputs map of path to sha256) with complete: all outputs are there unchanged."""
    outputs = markers.select("job_id", "stage", F.explode("outputs").alias("path", "_sha"))
    per = outputs.join(files.select("job_id", "path", "sha256"), ["job_id", "path"], "left").groupBy("job_id", "stage").agg(F.bool_and(F.coalesce(F.col("sha256") == F.col("_sha"), F.lit(False))).alias("_same"))
    df = markers.join(per, ["job_id", "stage"], "left")
    return df.withColumn("complete", F.col("signature").eqNullSafe(F.col("wanted_signature")) & F.coalesce("_same", F.lit(True))).drop("_same")


def overlay_live(published: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """Published rows with the live values of some columns on top."""
    l = live.select("job_id", *[F.col(c).alias(f"_{c}") for c in columns])
    df = published.join(l, "job_id", "left")
    return df.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in published.columns])


def match_terms(rows: DataFrame, terms: list[str], column: str = "text") -> DataFrame:
    """A row for each row and term that occurs in it. Terms are a small list, tested in one pass without a join."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(column), t))
    return rows.select("*", F.explode(found).alias("term"))


def assign_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose path is the one expected of their type."""
    return files.join(expected.select("job_id", "type", "path"), ["job_id", "type", "path"], "left_semi")


def available_voices(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs that have an available voice file, newest first."""
    voices = files.filter((F.col("type") == "voice") & (F.col("status") == "AVAILABLE"))
    able = jobs.filter((F.col("scope") == "workflows") | (F.col("tool") == "tts"))
    return able.join(voices, "job_id", "left_semi").orderBy(F.desc("created_at"), "job_id")


def seed_rules(rules: DataFrame, shipped: DataFrame, normalize: bool = True) -> DataFrame:
    """rules and the shipped ones of unknown source, the first of each; shipped has pos."""
    key = X.nfc(F.col("source")) if normalize else F.col("source")
    new = shipped.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("pos"))).filter("_n = 1")
    unknown = new.join(rules.select(key.alias("_key")), "_key", "left_anti")
    return rules.unionByName(unknown.select(*rules.columns))


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules (rule_id, source, replacement) after changes (action add, edit or delete, rule_id, source, replacement); the last change of an id holds."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("seq")))).filter("_n = 1").select("rule_id", "action", F.col("source").alias("_s"), F.col("replacement").alias("_r"))
    both = rules.withColumn("_old", F.lit(True)).join(last, "rule_id", "full")
    kept = both.filter((F.col("action").isNull()) | (F.col("action") == "add") | ((F.col("action") == "edit") & F.col("_old")))
    changed = F.col("action").isin("add", "edit")
    return kept.select("rule_id", F.when(changed, F.col("_s")).otherwise(F.col("source")).alias("source"), F.when(changed, F.col("_r")).otherwise(F.col("replacement")).alias("replacement"))


def checked_rule_changes(rules: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules after changes, and the changes refused with their problem (no source, no replacement, too long, or a source that another
    rule has): a refused edit leaves the rule as it was, a refused addition adds nothing."""
    after = J.validate_rules(apply_rule_changes(rules, changes))
    touched = changes.filter(F.col("action") != "delete").select("rule_id").distinct().withColumn("_touched", F.lit(True))
    old = rules.select("rule_id", F.col("source").alias("_s"), F.col("replacement").alias("_r"), F.lit(True).alias("_old"))
    both = after.join(touched, "rule_id", "left").join(old, "rule_id", "left")
    bad = F.col("problem").isNotNull() & F.coalesce("_touched", F.lit(False))
    kept = both.filter(~bad | F.coalesce("_old", F.lit(False)))
    pick = lambda c, o: F.when(bad, F.col(o)).otherwise(F.col(c)).alias(c)
    return kept.select("rule_id", pick("source", "_s"), pick("replacement", "_r")), both.filter(bad).select("rule_id", "source", "replacement", "problem")


def same_output(a: DataFrame, b: DataFrame, tolerance: int = 30) -> DataFrame:
    """Per job whether two transcripts have the same rows, with times within a tolerance."""
    r = b.select("job_id", "idx", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("text").alias("_t"), F.lit(True).alias("_there"))
    near = (F.abs(F.col("start_ms") - F.col("_s")) <= tolerance) & (F.abs(F.col("end_ms") - F.col("_e")) <= tolerance) & (F.col("text") == F.col("_t"))
    return a.join(r, ["job_id", "idx"], "full").groupBy("job_id").agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("same"))


def context_rows(rows: DataFrame, n: int = 12) -> DataFrame:
    """Per chunk (job_id, chunk_no) the n rows before it: idx, source, and the target unless the row was flagged."""
    w = Window.partitionBy("job_id").orderBy("idx").rowsBetween(-n, -1)
    item = F.struct("idx", "text", F.when(~F.coalesce("flagged", F.lit(False)), F.col("target")).alias("target"))
    first = F.row_number().over(Window.partitionBy("job_id", "chunk_no").orderBy("idx"))
    return rows.withColumn("context", F.collect_list(item).over(w)).withColumn("_n", first).filter("_n = 1").select("job_id", "chunk_no", "context")


def downstream(files: DataFrame, restart: DataFrame, order: list[str]) -> DataFrame:
    """files with status STALE from the restarted step on; a subtitle restart touches its own files, and burnt ones if burn is set.

    restart has job_id, step, burn."""
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in order]), c)
    df = files.join(restart.select("job_id", F.col("step").alias("_step"), F.col("burn").alias("_burn")), "job_id", "left")
    only = (F.col("step") == F.col("_step")) | ((F.col("step") == J.BURN) & F.coalesce("_burn", F.lit(False)))
    hit = F.when(F.col("_step") == J.SUBTITLE, only).otherwise(place(F.col("step")) >= place(F.col("_step")))
    return df.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "STALE").otherwise(F.col("status"))).drop("_step", "_burn")


def backfill_missing(expected: DataFrame, published: DataFrame) -> DataFrame:
    """Expected finals not published, of steps without stale or half-published files."""
    busy = published.filter(F.col("status").isin("STALE", "PUBLISHING"))
    return expected.join(published, ["job_id", "type"], "left_anti").join(busy, ["job_id", "step"], "left_anti")


def voice_units_of(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """runs (job_id, voice_of) with the manifest path of their own voice, else of the run they refer to."""
    own = runs.join(manifests.select("job_id", F.col("path").alias("_own")), "job_id", "left")
    other = manifests.select(F.col("job_id").alias("voice_of"), F.col("path").alias("_other"))
    return own.join(other, "voice_of", "left").select("job_id", "voice_of", F.coalesce("_own", "_other").alias("manifest"))


def join_telemetry(jobs: DataFrame, *sides: DataFrame) -> DataFrame:
    """Side tables attached by job_id; a missing side leaves nulls."""
    for side in sides:
        jobs = jobs.join(side, "job_id", "left")
    return jobs


# Aggregations


def overall_progress(steps: DataFrame) -> DataFrame:
    """Mean of a job's step percents (job_id, step, state, percent), completed ones 100; null if an active one is unknown."""
    return steps.groupBy("job_id").agg(progress_of(F.col("percent"), F.col("state")).alias("progress"))


def progress_of(percent: Column, state: Column) -> Column:
    """overall_progress as an aggregate of the caller's groups."""
    value = F.when(state == "COMPLETED", 100.0).otherwise(percent)
    return F.when(~F.bool_or(value.isNull()), F.bround(F.avg(value), 2))


def rule_counts(hits: Column, rule_ids: list[str]) -> Column:
    """An aggregate: how often each rule occurs in arrays of hits, zeros included, as a map."""
    times = [F.coalesce(F.sum(F.size(F.filter(hits, lambda h: h == r)).cast("long")), F.lit(0)) for r in rule_ids]
    return F.map_from_arrays(F.array(*[F.lit(r) for r in rule_ids]), F.array(*times))


def translation_report(rows: DataFrame) -> DataFrame:
    """Per job: chunks done and in all, rows done and in all, flagged ids, characters billed; rows have done, flagged, chars."""
    per = rows.groupBy("job_id", "chunk_no").agg(F.bool_and("done").alias("_done"), F.count("*").alias("_n"), F.sum(F.col("done").cast("long")).alias("_d"), F.collect_list(F.when(F.col("flagged"), F.col("idx"))).alias("_f"), F.sum("chars").alias("_c"))
    return per.groupBy("job_id").agg(F.sum(F.col("_done").cast("long")).alias("chunks_done"), F.count("*").alias("chunks_total"), F.sum("_d").alias("rows_done"), F.sum("_n").alias("rows_total"), F.sort_array(F.flatten(F.collect_list("_f"))).alias("flagged_rows"), F.sum(F.when(F.col("_done"), F.col("_c")).otherwise(0)).alias("billed_chars"))


def group_stats(groups: DataFrame) -> DataFrame:
    """Per job groups, grouped rows and fallbacks; groups have rows and fell_back."""
    return groups.groupBy("job_id").agg(F.count("*").alias("groups"), F.sum("rows").alias("grouped_rows"), F.sum(F.col("fell_back").cast("long")).alias("fallbacks"))


def voice_layout(units: DataFrame, sample_bytes: int = 2) -> DataFrame:
    """Frames of a job's whole voice, 48 for each millisecond of gap, and whether its file needs 64-bit sizes."""
    frames = F.sum(F.col("frames") + 48 * F.coalesce("gap_after_ms", F.lit(0)))
    return units.groupBy("job_id").agg(frames.cast("long").alias("frames")).withColumn("container", F.when(F.col("frames") * sample_bytes + 128 >= (1 << 32) - 1, "RF64").otherwise("WAV"))


def manifest_adds_up(units: DataFrame, tolerance: int = 1000) -> DataFrame:
    """Per job whether lengths and gaps come to total_ms within a tolerance, or a length is unknown."""
    gap = F.abs(F.sum(F.col("length_ms") + F.coalesce("gap_ms", F.lit(0))) - F.max("total_ms"))
    return units.groupBy("job_id").agg((F.bool_or(F.col("length_ms").isNull()) | F.max("total_ms").isNull() | (F.max("total_ms") == 0) | (gap <= tolerance)).alias("adds_up"))


# kbit/s by height and quality; codecs that can be copied; heights.
BITRATES = {1080: {"high": 8000, "medium": 5000, "light": 3000}, 720: {"high": 4000, "medium": 2500, "light": 1500}, 480: {"high": 2000, "medium": 1200, "light": 800}}
COPYABLE = ["h264", "hevc", "av1", "vp9", "mpeg4"]
HEIGHTS = [480, 720, 1080]


def video_plan(clips: DataFrame, resolution: str = "keep", quality: str = "medium", burn: bool = False, audio_kbps: int = 128, bitrates: dict = BITRATES) -> DataFrame:
    """Per job copy or encode, size, repeats and estimated bytes; clips have pos, width, height, fps, codec, pix_fmt, rotation, duration_ms, bitrate, voice_ms."""
    one = lambda c: F.min_by(c, "pos").alias(f"first_{c}")
    same = [F.min(c) == F.max(c) for c in ("codec", "width", "height", "pix_fmt", "rotation")]
    alike = same[0] & same[1] & same[2] & same[3] & same[4] & (F.max("fps") - F.min("fps") < 0.01)
    g = clips.groupBy("job_id").agg(*[one(c) for c in ("codec", "width", "height", "fps")], alike.alias("_alike"), F.sum("duration_ms").alias("clips_ms"), (F.sum(F.col("bitrate") * F.col("duration_ms")) / F.greatest(F.sum("duration_ms"), F.lit(1)) / 1000).alias("_kbps"), F.max("voice_ms").alias("voice_ms"))
    even = lambda c: F.greatest(F.lit(2), (F.bround(c / 2) * 2)).cast("int")
    w, h = F.col("first_width"), F.col("first_height")
    copy = F.col("_alike") & F.col("first_codec").isin(COPYABLE) & F.lit(resolution == "keep" and not burn)
    if resolution == "keep":
        width, height = even(w), even(h)
        near = F.array_min(F.transform(F.array(*[F.lit(x) for x in bitrates]), lambda x: F.struct(F.abs(x - F.least(width, height)).alias("far"), x.alias("row"))))["row"]
    else:
        short = int(resolution)
        long_ = even(short * (F.greatest(w, h) / F.least(w, h)))
        width, height = F.when(h > w, short).otherwise(long_), F.when(h > w, long_).otherwise(short)
        near = F.lit(short)
    table = F.create_map(*[F.lit(x) for k, v in bitrates.items() for x in (k, v[quality])])
    kbps = F.when(copy, F.col("_kbps")).otherwise(F.try_element_at(table, near))
    repeats = F.when((F.col("voice_ms") > 0) & (F.col("clips_ms") > 0), F.ceil(F.col("voice_ms") / F.col("clips_ms")).cast("int"))
    size = F.when(F.col("voice_ms") > 0, F.floor((kbps + audio_kbps) * 1000 / 8 * F.col("voice_ms") / 1000 * 1.02).cast("long"))
    return g.select("job_id", F.when(copy, "copy").otherwise("encode").alias("mode"), width.alias("width"), height.alias("height"), F.floor(kbps).cast("int").alias("video_kbps"), "clips_ms", repeats.alias("repeats"), size.alias("size_bytes"))


def allowed_resolutions(clips: DataFrame, heights: list[int] = HEIGHTS) -> DataFrame:
    """Heights not above the largest clip's smaller side."""
    most = F.max(F.least("width", "height"))
    return clips.groupBy("job_id").agg(most.alias("_m")).select("job_id", F.filter(F.array(*[F.lit(h) for h in heights]), lambda h: h <= F.col("_m")).alias("heights"))


def download_outcome(attempts: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One code per job from its attempts (job_id, attempt_no, cookies, error); null cookies are anonymous."""
    low = F.lower("error")
    has = lambda t: F.bool_or(F.coalesce(F.contains(low, F.lit(t)), F.lit(False)))
    signed = F.col("cookies").isNotNull() & (F.col("cookies") != "") & F.col("error").isNotNull()
    g = attempts.groupBy("job_id").agg(F.bool_or(F.col("error").isNotNull()).alias("any"), has("http error 429").alias("limited"), F.bool_or(signed).alias("signed"), has("sign in to confirm").alias("asked"), F.max_by(F.when(signed, low), F.when(signed, F.col("attempt_no"))).alias("last"))
    if jobs is not None:
        g = jobs.select("job_id").distinct().join(g, "job_id", "left")
    last = lambda t: F.coalesce(F.col("signed") & F.contains("last", F.lit(t)), F.lit(False))
    code = F.when(F.col("any").isNull(), "T101").when(~F.col("any"), "T106").when(F.col("limited"), "T103").when(~F.col("signed") & F.col("asked"), "T101").when(last("sign in to confirm"), "T101").when(last("needs to be reloaded"), "T102").otherwise("T107")
    return g.select("job_id", code.alias("code"))


def artifact_flags(files: DataFrame, types: list[str]) -> DataFrame:
    """Per job a boolean for each type of file. Types are a fixed list, so the pivot takes one pass."""
    return files.groupBy("job_id").agg(*[F.bool_or((F.col("type") == t) & (F.col("status") == "AVAILABLE")).alias(f"has_{t.lower()}") for t in types])


def status_facets(jobs: DataFrame) -> DataFrame:
    return jobs.select("status").distinct().orderBy("status")


def run_durations(transitions: DataFrame) -> DataFrame:
    """Per job and step the attempts and the milliseconds in RUNNING up to the next mark, without waits (column wait_ms)."""
    w = Window.partitionBy("job_id", "step").orderBy("at", "seq")
    df = transitions.withColumn("_next", F.lead("at").over(w))
    wait = F.coalesce(F.col("wait_ms"), F.lit(0)) if "wait_ms" in transitions.columns else F.lit(0)
    ran = F.when((F.col("state") == "RUNNING") & F.col("_next").isNotNull(), F.greatest(F.lit(0), F.unix_millis(F.col("_next").cast("timestamp")) - F.unix_millis(F.col("at").cast("timestamp")) - wait))
    return df.withColumn("_ms", ran).groupBy("job_id", "step").agg(F.sum((F.col("state") == "RUNNING").cast("long")).alias("attempt"), F.sum("_ms").cast("long").alias("duration_ms"))


def throughput(events: DataFrame, seconds: int = 30) -> DataFrame:
    """events (job_id, ts, amount) with the amount per second of the trailing window."""
    w = Window.partitionBy("job_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("rate", F.sum("amount").over(w) / seconds)


def slow_routes(timings: DataFrame, slow_ms: int = 2000) -> DataFrame:
    """Per route requests, slow ones, and the milliseconds of each step (steps_ms map)."""
    per = timings.groupBy("route").agg(F.count("*").alias("requests"), F.sum((F.col("total_ms") >= slow_ms).cast("long")).alias("slow"))
    parts = timings.select("route", F.explode("steps_ms").alias("step", "ms")).groupBy("route", "step").agg(F.sum("ms").alias("step_ms"))
    return per.join(parts, "route", "left")


def longest_dedupe(tasks: DataFrame, config: str = "config", text: str = "text") -> DataFrame:
    """tasks with the id of the task that does the work for all of the same config and text: the least."""
    first = tasks.groupBy(config, text).agg(F.min("task_id").alias("worker_id"))
    on = F.col("t." + config).eqNullSafe(F.col("f." + config)) & F.col("t." + text).eqNullSafe(F.col("f." + text))
    return tasks.alias("t").join(first.alias("f"), on).select("t.*", "f.worker_id")


def merge_cards(updates: DataFrame, limit: int = 30) -> DataFrame:
    """Per job the latest update of each name (job_id, seq, name, card), the last `limit` of them."""
    last = updates.groupBy("job_id", "name").agg(F.max("seq").alias("seq"), F.max_by("card", "seq").alias("card"))
    return last.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq"), "name"))).filter(F.col("_n") <= limit).drop("_n")


# Sorts and limits


def history(jobs: DataFrame, search: str = "", status: str = "ALL", sort: str = "newest", page: int = 1, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """A page of jobs (workflow_no, id, name, url, status, created_at) and the number of all that match."""
    words = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("undefined")) for c in ("workflow_no", "id", "name", "url")])
    found = jobs.filter(F.contains(F.lower(words), F.lit(search.lower())))
    found = found if status in ("", "ALL", None) else found.filter(F.col("status") == status)
    limit, page = max(1, min(100, limit or 25)), max(1, page or 1)
    at = F.col("created_at").asc() if sort == "oldest" else F.col("created_at").desc()
    return found.orderBy(at, "id").offset((page - 1) * limit).limit(limit), found.agg(F.count("*").alias("total"))


def merge_sorted(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("job_id", "start_ms", "end_ms")


def latest_errors(errors: DataFrame, n: int = 100) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc("failed_at"), F.desc("seq"))
    return errors.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def top_names(names: DataFrame, n: int = 40) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc("count"), "source")
    return names.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def first_pending(jobs: DataFrame) -> DataFrame:
    """Per scope the oldest job that can run: pending, or paused by the program itself."""
    able = jobs.filter((F.col("status") == "PENDING") | ((F.col("status") == "PAUSED") & F.coalesce("auto_paused", F.lit(False))))
    return able.groupBy("scope").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def manifest_order(units: DataFrame) -> DataFrame:
    """Units of a job in one partition and in order, for export."""
    return units.repartition("job_id").sortWithinPartitions("job_id", "index")


# Sets


def union_runs(*runs: DataFrame) -> DataFrame:
    """Runs of all sources, the first source's of each id."""
    both = None
    for k, r in enumerate(runs):
        r = r.withColumn("_k", F.lit(k))
        both = r if both is None else both.unionByName(r)
    w = Window.partitionBy("id").orderBy("_k")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_k")


def same_ids(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Ids (job_id, idx) that were requested but not returned, or the other way round; empty if a reply is right."""
    return requested.exceptAll(returned).withColumn("side", F.lit("missing")).union(returned.exceptAll(requested).withColumn("side", F.lit("extra")))


def merge_glossaries(*sources: DataFrame) -> DataFrame:
    """One target for each source term (job_id, source, target): the earlier table's."""
    both = None
    for k, s in enumerate(sources):
        s = s.select("job_id", "source", "target", F.lit(k).alias("_k"))
        both = s if both is None else both.unionByName(s)
    return both.groupBy("job_id", "source").agg(F.min_by("target", F.struct("_k", "target")).alias("target"))


def keep_latest_output(files: DataFrame, restarted: DataFrame) -> DataFrame:
    """Files without those of restarted steps."""
    return files.join(restarted, ["job_id", "step"], "left_anti")


def voice_catalog(default: str, *sources: DataFrame) -> DataFrame:
    """Voices by name, the later source's; is_default marks the default, or the first name if that is missing."""
    both = None
    for k, s in enumerate(sources):
        s = s.withColumn("_k", F.lit(k))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("name").orderBy(F.desc("_k"))
    one = both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_k")
    head = one.agg(F.coalesce(F.max(F.when(F.col("name") == default, F.col("name"))), F.min("name")).alias("_default"))
    return one.join(F.broadcast(head)).withColumn("is_default", F.col("name") == F.col("_default")).drop("_default")


def initial_card(glossary: DataFrame, characters: DataFrame) -> DataFrame:
    """Cards (job_id, name, target, gender): glossary entries under the character sheet's."""
    c = characters.select("job_id", F.col("source").alias("name"), F.when(F.length("target") > 0, F.col("target")).alias("_t"), F.coalesce("gender", F.lit("unknown")).alias("_g"))
    g = glossary.select("job_id", F.col("source").alias("name"), "target")
    return g.join(c, ["job_id", "name"], "full").select("job_id", "name", F.coalesce("_t", "target", F.lit("")).alias("target"), F.coalesce("_g", F.lit("unknown")).alias("gender"))
