"""Scalar functions over jobs, steps, files and failures, as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import values as V
from .text import nfc

# The steps of a run, in order.
STEPS = ["DOWNLOAD", "TRANSCRIPTION", "TRANSLATION", "MODERATION", "TTS"]
SUBTITLE, VIDEO, BURN = "SUBTITLE", "VIDEO", "BURN"


def classify_error(kind: Column, code: Column, message: Column, errno: Column) -> Column:
    """An error's code, by the first rule that holds. `code` is one the error brings along, or null."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: functools.reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))
    return (
        F.when(code.isin(V.LICENCE_CODES), code)
        .when((kind == "VideoError") & code.isin("VIDEO_TYPE", "VIDEO_INVALID"), "VIDEO_UNREADABLE")
        .when((kind == "VideoError") & code.isNotNull(), code)
        .when(kind == "YouTubeSessionError", "YOUTUBE_AUTH")
        .when(kind == "ModuleNotFoundError", "DEPENDENCY_MISSING")
        .when((F.coalesce(errno, F.lit(0)) == 28) | has(*V.DISK_WORDS), "DISK_FULL")
        .when(kind == "PermissionError", "FILE_PERMISSION")
        .when(has("out of memory") & has("cuda"), "CUDA_OOM")
        .when(has(*V.DEVICE_WORDS), "CUDA_CONFIG")
        .when(has(*V.SIGN_IN_WORDS), "YOUTUBE_AUTH")
        .when(has("429"), "RATE_LIMIT")
        .when(has(*V.TOOL_WORDS) & (kind == "FileNotFoundError"), "FFMPEG_MISSING")
        .when(has(*V.MODEL_WORDS) & has(*V.MISSING_WORDS), "MODEL_MISSING")
        .when(kind == "FileNotFoundError", "PATH_MISSING")
        .when((kind == "ValueError") & has(*V.SETTING_WORDS), "ENV_CONFIG")
        .otherwise("STEP_FAILED")
    )


def with_error_id(errors: DataFrame, ids: DataFrame, guides: DataFrame, default: str = "X900") -> DataFrame:
    """Short id, message and hint of each error_code; ids (error_code, error_id) and guides (error_id, message, hint) are small tables."""
    known = errors.join(ids, "error_code", "left").withColumn("error_id", F.coalesce("error_id", F.lit(default)))
    return known.join(guides, "error_id", "left")


def redact(message: Column) -> Column:
    """URLs, lines that look secret and key=value masked; 2000 characters at most."""
    text = F.regexp_replace(message, V.MASK_URL, "[URL]")
    text = F.regexp_replace(F.regexp_replace(text, V.MASK_LINE, "[Sensitive detail removed]"), V.MASK_PAIR, "[REDACTED]")
    return F.substring(text, 1, 2000)


def valid_video_url(url: Column, short_hosts: tuple[str, ...] = ("youtu.be", "www.youtu.be"), hosts: tuple[str, ...] = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com")) -> Column:
    """https, a listed host without user or port, and an 11-character id in the path or as the first v=."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https)://([A-Za-z0-9.-]+)(?=[/?#]|$)", 1))
    path = F.regexp_extract(url, r"^(?i:https)://[A-Za-z0-9.-]+(/[^?#]*)", 1)
    first = F.regexp_extract(url, r"^[^?#]*\?(?:(?!v=)[^&#]*&)*v=([^&#]*)", 1)
    short = host.isin(*short_hosts) & path.rlike(r"^/[A-Za-z0-9_-]{11}/?$")
    watch = (path == "/watch") & first.rlike(r"^[A-Za-z0-9_-]{11}$")
    clip = path.rlike(r"^/(shorts|live)/[A-Za-z0-9_-]{11}/?$")
    return F.coalesce(short | (host.isin(*hosts) & (watch | clip)), F.lit(False))


def percent(done: Column, total: Column, completed: Column | None = None) -> Column:
    """Share done in percent, two decimals, within 0 to 100; null if the total is unknown or zero, but 100 if completed."""
    known = F.when(total > 0, F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * done / total)), 2))
    return known if completed is None else F.when(completed & (F.coalesce(total, F.lit(0)) == 0), 100.0).otherwise(known)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, none negative; 0 without a start."""
    return F.when(start.isNull(), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))))


def artifact_name(number: Column, name: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 6, "0"), F.lit("-"), name)


def display_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def display_size(size: Column) -> Column:
    return F.when(size < 1 << 20, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / (1 << 20)))


def character_problems(df: DataFrame, key: str = "job_id", most: int = 200) -> DataFrame:
    """df with `problems`: what its character rows (source, aliases, target, gender, role, rank, third, you) break."""
    bad = lambda c, n: F.when((F.length(c) > n) | F.col(c).rlike(r"[\x00-\x1f<>]"), f"invalid {c}")
    aliases = F.coalesce("aliases", F.array("source"))
    reasons = F.array_compact(
        F.array(
            F.when(F.length(F.trim(F.coalesce("source", F.lit("")))) == 0, "no source"),
            bad("source", 20),
            bad("target", 40),
            bad("third", 20),
            bad("you", 20),
            F.when(~F.size(aliases).between(1, 10), "1 to 10 aliases"),
            F.when(F.exists(aliases, lambda a: (F.length(a) > 20) | a.rlike(r"[\x00-\x1f<>]")), "invalid alias"),
            F.when(F.col("gender").isNotNull() & ~F.col("gender").isin("male", "female"), "invalid gender"),
            F.when(~F.coalesce(F.col("role").isin(*V.ROLES), F.lit(False)), "invalid role"),
            F.when(~F.coalesce(F.col("rank").isin(*V.RANKS), F.lit(False)), "invalid rank"),
            F.when(F.count("*").over(Window.partitionBy(key)) > most, "too many characters"),
        )
    )
    return df.withColumn("problems", reasons)


def validate_rules(rules: DataFrame, source: str = "source", replacement: str = "replacement") -> DataFrame:
    """rules with `problem`, why one is refused; sources are compared in NFC, the form in which they are matched."""
    marked = rules.withColumn("_nfc", nfc(F.col(source)))
    same = F.count("*").over(Window.partitionBy("_nfc"))
    problem = (
        F.when(F.coalesce(F.length(F.trim("_nfc")), F.lit(0)) == 0, "empty source")
        .when(F.col(replacement).isNull(), "no replacement")
        .when((F.length("_nfc") > 1000) | (F.length(replacement) > 10000), "too long")
        .when(same > 1, "duplicate source")
    )
    return marked.withColumn("problem", problem).drop("_nfc")


# Limits of subtitle settings.
SUBTITLE_LIMITS = {"max_chars": (20, 200), "min_seconds": (0.5, 5.0)}


def validate_subtitle_settings(max_chars: int = 84, min_seconds: float = 1.0) -> tuple[int, float]:
    for name, value in (("max_chars", max_chars), ("min_seconds", min_seconds)):
        low, high = SUBTITLE_LIMITS[name]
        if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= high:
            raise ValueError(f"{name} must be {low:g} to {high:g}")
    return int(max_chars), float(min_seconds)


def subtitle_problem(max_chars: Column, min_seconds: Column) -> Column:
    """Why the settings of a row are refused; null if they are not."""
    (a, b), (c, d) = SUBTITLE_LIMITS["max_chars"], SUBTITLE_LIMITS["min_seconds"]
    return F.when(~F.coalesce(max_chars.between(a, b), F.lit(False)), "max_chars").when(~F.coalesce(min_seconds.between(c, d), F.lit(False)), "min_seconds")


def validate_style(style: str | None) -> tuple[int, int, bool] | None:
    """The values of a narration style; None for the default."""
    if style in (None, "", "default"):
        return None
    if style not in V.STYLES:
        raise ValueError("unknown narration style")
    return V.STYLES[style]


PUBLIC_COLUMNS = ["id", "workflow_no", "name", "status", "progress", "created_at", "completed_at", "steps"]
PUBLIC_STEP = ["state", "progress", "started_at", "completed_at", "duration_ms", "attempt", "retry_count"]


def public_job(jobs: DataFrame, columns: list[str] = PUBLIC_COLUMNS, step_fields: list[str] = PUBLIC_STEP) -> DataFrame:
    """An allow-list of columns, and of the fields of each step."""
    out = jobs.select(*[c for c in columns if c in jobs.columns])
    if "steps" not in out.columns:
        return out
    there = [f.name for f in jobs.schema["steps"].dataType.valueType.fields if f.name in step_fields]
    return out.withColumn("steps", F.transform_values("steps", lambda _, s: F.struct(*[s[f].alias(f) for f in there])))


def effective_steps(tool_steps: Column, subtitle: Column, video: Column, burn: Column) -> Column:
    """A run's steps in order."""
    none = F.array().cast("array<string>")
    more = lambda test, step: F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(step))).otherwise(none)
    own = F.concat(F.array(*[F.lit(s) for s in STEPS]), more(subtitle, SUBTITLE), more(video, VIDEO), more(video & burn, BURN))
    return F.when(F.size(tool_steps) > 0, tool_steps).otherwise(own)


def valid_cached(row_start: Column, row_end: Column, source: Column, start: Column, end: Column, cached_source: Column, target: Column, problem: Column, dropped: Column) -> Column:
    """Whether a cached output still stands for a row: same times and source, a target that passes, '' for a dropped row."""
    same = row_start.eqNullSafe(start) & row_end.eqNullSafe(end) & source.eqNullSafe(cached_source) & target.isNotNull()
    return same & F.when(dropped, target == "").otherwise(problem.isNull())
