"""Sources and sinks of the transcript operators: segments, uploads, manifests, jobs, published files, logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .store import materialize

MOST_CHARS = 65_536


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (file, line from 0, value), whatever the size of a file: long ones are read in many tasks.

    Spark cuts files by spark.sql.files.maxPartitionBytes and gives a line to the split in which it begins. A line's number is its place in
    its split, plus the lines of the splits before it, which a first pass counts. A carriage return before the line feed goes; a last
    line feed ends the line before it; an empty file has no lines."""
    return lines_of(spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start"))


def lines_of(rows: DataFrame) -> DataFrame:
    """read_lines of what a text source has read (value, file_path, file_block_start), for instance of a batch of a stream of files."""
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "lines")  # ascending within a split, whichever task reads it
    splits = rows.groupBy("file_path", "file_block_start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file_path", "file_block_start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = rows.join(splits, ["file_path", "file_block_start"])
    return placed.select(F.col("file_path").alias("file"), (F.col("id") + F.col("shift")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def stream_lines(spark: SparkSession, path: str, write: Callable[[DataFrame, int], None], files: int = 100):
    """A writer that hands the lines of new files of a folder, `files` of them at a time, to write(lines, epoch)."""
    source = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files).text(path)
    return source.select("value", "_metadata.file_path", "_metadata.file_block_start").writeStream.foreachBatch(lambda batch, epoch: write(lines_of(batch), epoch))


def read_segments(spark: SparkSession, path: str, text_col: str = "text", job_pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """JSONL segments (job_id, idx from 1, start_ms, end_ms, text); a bad row stops the read with its place."""
    parsed = read_lines(spark, path).select(F.regexp_extract("file", job_pattern, 1).alias("job_id"), (F.col("line") + 1).cast("long").alias("idx"), F.from_json("value", f"start_ms bigint, end_ms bigint, `{text_col}` string").alias("r"))
    rows = parsed.select("job_id", "idx", "r.start_ms", "r.end_ms", F.col(f"r.{text_col}").alias("text"))
    checked = validate_segments(rows, keep_all=True)
    reason = F.concat_ws(" ", F.lit("bad segment"), "job_id", F.col("idx").cast("string"), F.col("problem"))
    return checked.withColumn("text", F.when(F.col("problem").isNull(), F.col("text")).otherwise(F.raise_error(reason))).drop("problem")


def validate_segments(rows: DataFrame, keep_all: bool = False) -> DataFrame:
    """Rows (job_id, idx, start_ms, end_ms, text) that break a rule, with `problem`, the first that they break."""
    before = F.lag("start_ms").over(Window.partitionBy("job_id").orderBy("idx"))
    problem = (
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "time is not an integer")
        .when(F.col("start_ms") < 0, "negative time")
        .when(F.col("end_ms") < F.col("start_ms"), "end before start")
        .when(F.col("start_ms") < before, "start before previous start")
        .when(F.col("text").isNull(), "missing text")
    )
    out = rows.withColumn("problem", problem)
    return out if keep_all else out.filter("problem is not null")


def text_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and refusals of lines (job_id, line, value): one row per nonblank trimmed line, its ordinal from 0 as both times."""
    trimmed = lines.withColumn("text", X.strip(F.col("value"))).filter(F.length("text") > 0)
    bad = (F.length("value") > MOST_CHARS) | F.contains("value", F.lit("\0"))
    refused = trimmed.filter(bad).select("job_id", "line", F.when(F.contains("value", F.lit("\0")), "NUL").otherwise("too long").alias("problem"))
    place = (F.row_number().over(Window.partitionBy("job_id").orderBy("line")) - 1).cast("long")
    good = trimmed.filter(~bad).withColumn("start_ms", place)
    return good.select("job_id", (F.col("start_ms") + 1).alias("idx"), "start_ms", F.col("start_ms").alias("end_ms"), "text"), refused


def ingest_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return text_rows(read_lines(spark, path).select(F.col("file").alias("job_id"), "line", "value"))


# The text column that each stage takes.
STAGE_TEXT = {"translation": ["text"], "moderation": ["text_vi"], "voice": ["text_vi_moderated", "text_vi"]}


def ingest_jsonl(lines: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Rows and refusals of JSON lines (job_id, line, value) for a stage; the voice stage takes text_vi where there is no moderated text."""
    names = STAGE_TEXT[stage]
    r = lines.withColumn("_r", F.from_json("value", "start_ms bigint, end_ms bigint, " + ", ".join(f"{c} string" for c in names)))
    r = r.withColumn("text", F.coalesce(*[F.col(f"_r.{c}") for c in names]))
    timed = F.col("_r.start_ms").isNotNull() & F.col("_r.end_ms").isNotNull() if stage == "voice" else F.lit(True)
    good = F.coalesce(F.col("text").isNotNull() & timed, F.lit(False))
    return r.filter(good).select("job_id", (F.col("line") + 1).cast("long").alias("idx"), "_r.start_ms", "_r.end_ms", "text"), r.filter(~good).select("job_id", "line", "value")


def accept_upload(path: Column, mime: Column | None = None) -> Column:
    """Whether a file's name and type are of those taken as text."""
    good = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin("txt", "md", "jsonl")
    kinds = ["text/plain", "text/markdown", "application/json", "application/jsonl", "application/x-ndjson", "application/octet-stream", ""]
    return good if mime is None else good & F.coalesce(mime, F.lit("")).isin(kinds)


def write_transcript(rows: DataFrame, path: str, text_col: str = "text") -> None:
    """JSON rows and Markdown paragraphs, a pair of folders job_id=... for each job, both in order of idx.

    A job's rows go through one task and are one file, unless Spark is told to cut files by spark.sql.files.maxRecordsPerFile."""
    ordered = rows.repartition("job_id").sortWithinPartitions("job_id", "idx")
    ordered.write.partitionBy("job_id").json(f"{path}/rows")
    ordered.select("job_id", F.concat(F.coalesce(text_col, F.lit("")), F.lit("\n")).alias("value")).write.partitionBy("job_id").text(f"{path}/markdown")


def to_srt(cues: DataFrame) -> DataFrame:
    """One SubRip text per job of cues (job_id, cue_no, start_ms, end_ms, text)."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("cue_no"))
    block = F.concat(n.cast("string"), F.lit("\n"), X.srt_timestamp(F.col("start_ms")), F.lit(" --> "), X.srt_timestamp(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n\n"))
    placed = cues.select("job_id", F.struct(n.alias("n"), block.alias("block")).alias("b"))
    return placed.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "").alias("srt"))


def manifest_units(rows: DataFrame, rate: int = 48_000) -> DataFrame:
    """Units (job_id, index, text, length_ms, gap_ms) of manifest rows; lengths are frames in milliseconds, half to even."""
    return rows.select("job_id", "index", F.coalesce("text", F.lit("")).alias("text"), F.bround(F.col("frames") * 1000 / rate).cast("long").alias("length_ms"), F.coalesce("gap_after_ms", F.lit(0)).cast("int").alias("gap_ms"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Units of manifest files, a job for each; an empty one among them is an error."""
    rows = spark.read.schema("index bigint, text string, file string, frames bigint, gap_after_ms int").json(path).withColumn("job_id", F.input_file_name())
    files = rows.inputFiles()  # the listing that Spark's driver has made, empty files included
    listed = spark.createDataFrame([(f,) for f in files], "job_id string")
    empty = listed.join(rows.filter("index is not null").select("job_id").distinct(), "job_id", "left_anti").first()
    if empty is not None or not files:
        raise ValueError(f"the voice manifest is empty: {path if empty is None else empty.job_id}")
    return manifest_units(rows)


JOB = "id string, workflow_no long, name string, url string, status string, progress double, created_at string, completed_at string, steps map<string, struct<state:string, attempt:int, retry_count:int, progress:double, started_at:string, completed_at:string, duration_ms:long>>"


#: Parts of a scan that a task reads together. Spark counts 4 MB for opening a file, so a part holds 32 small ones.
SCAN_PARTS = 32


def read_jobs(spark: SparkSession, path: str | list[str], schema: str = JOB, name: str = "job.json") -> DataFrame:
    """One job per file of that name (a glob) under a folder, or several; scope is workflows or tools by the folder.

    Runs are many, each a folder with a small file. Left alone, Spark lists every folder in a task of its own (up to 10,000) and reads
    32 files in a task, so that starting tasks takes longer than their work. Here few tasks list, and a task reads about a thousand files."""
    key, least = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), least)))
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).json(path)
    finally:
        spark.conf.set(key, before)
    df = df.withColumn("scope", F.when(F.input_file_name().contains("/tools/"), "tools").otherwise("workflows")).withColumn("created_at", F.to_timestamp("created_at"))
    return df.coalesce(max(least, df.rdd.getNumPartitions() // SCAN_PARTS))


def publish_files(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """The manifest after an upsert by (job_id, type): the first created_at stays, what is staged becomes AVAILABLE, an equal digest changes nothing."""
    s = staged.select("job_id", "type", *[F.col(c).alias(f"_{c}") for c in ("path", "size", "sha256", "created_at")])
    both = existing.join(s, ["job_id", "type"], "full")
    same = F.col("sha256").eqNullSafe(F.col("_sha256")) | F.col("_sha256").isNull()
    take = lambda c: F.when(same, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return both.select("job_id", "type", take("path"), take("size"), take("sha256"), F.when(same, F.col("status")).otherwise("AVAILABLE").alias("status"), F.coalesce("created_at", "_created_at").alias("created_at"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def digests(df: DataFrame, content: str = "content") -> DataFrame:
    """df with the size and SHA-256 of a binary or text column."""
    return df.withColumn("size", F.octet_length(content).cast("long")).withColumn("sha256", F.sha2(content, 256))


def scan_binary_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file under a path."""
    return digests(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)).select("path", "size", "sha256")
