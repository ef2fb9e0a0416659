"""The driver's tables as tables of the transcript model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as segments: a job per conversation, 60 ms for each character of earlier turns, 50 ms for each of its own."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).alias("idx"), "role", "text")
    n = F.length("text").cast("long")
    before = F.sum(60 * n).over(Window.partitionBy("job_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("start_ms", F.coalesce(before, F.lit(0)).cast("long"))
    return c.withColumn("end_ms", F.col("start_ms") + 50 * n)


SEGMENTS = """segments AS (
  SELECT job_id, idx, role, text, start_ms, start_ms + 50 * length(text) AS end_ms FROM (
    SELECT conv_id AS job_id, turn + 1 AS idx, role, text,
      CAST(coalesce(sum(60 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
    FROM conversations))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: job_id, line from 0, value."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("line", "value")).withColumn("line", F.col("line").cast("long"))


DOC_LINES = """doc_lines AS (
  SELECT doc_id AS job_id, unnest(range(0, len(l))) AS line, unnest(l) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of speech: a job per user, milliseconds since 2024 in hundredths, a length of 40 ms for each unit of value."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.floor((F.unix_millis("ts") - 1704067200000) / 100).cast("long")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), at.alias("start_ms"), (at + F.floor(F.col("value") * 40).cast("long")).alias("end_ms"), "event_type", "ts", "value")


SPANS = """spans AS (
  SELECT user_id AS job_id, event_id AS seq, start_ms, start_ms + CAST(floor(value * 40) AS BIGINT) AS end_ms, event_type, ts, value FROM (
    SELECT *, (epoch_us(ts) // 1000 - 1704067200000) // 100 AS start_ms FROM events))"""

STATES = {"signup": "PENDING", "view": "RUNNING", "click": "PAUSED", "purchase": "COMPLETED", "error": "FAILED"}


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as step transitions: the step by event_id, the state by event_type."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("user_id").alias("job_id"), F.concat(F.lit("S"), (F.col("event_id") % 4).cast("string")).alias("step"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("state"), F.col("value").alias("percent"))


TRANSITIONS = """transitions AS (
  SELECT user_id AS job_id, 'S' || CAST(event_id % 4 AS VARCHAR) AS step, ts AS tm, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'PAUSED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS state, value AS percent
  FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("scope"))


JOBS = "jobs AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at, o_orderpriority AS name, 'c' || CAST(o_custkey % 7 AS VARCHAR) AS scope FROM orders)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files, units and clips of a job: pos orders them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    i = read(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w).cast("long"))
    return i.select(F.col("l_orderkey").alias("job_id"), "pos", F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") * 100).cast("long").alias("length_ms"), (F.col("l_partkey") % 500).cast("long").alias("gap_ms"), (F.col("l_partkey") * 100).cast("long").alias("size"), F.col("l_shipdate").alias("created_at"), F.col("l_suppkey").alias("supplier"))


FILES = """files AS (
  SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos, l_returnflag AS type, l_linestatus AS status,
    CAST(l_quantity * 100 AS BIGINT) AS length_ms, l_partkey % 500 AS gap_ms, l_partkey * 100 AS size, l_shipdate AS created_at, l_suppkey AS supplier
  FROM lineitem)"""
