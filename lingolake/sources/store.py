"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session makes one of its own; a cluster has no folder that could
    stand for it, since executors would write to their own disks, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lingolake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; clear() deletes what is there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, so a lost executor costs one stage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _made(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_lingolake_tables"):
        context._lingolake_tables = []
    return context._lingolake_tables


def mark(spark: SparkSession) -> int:
    """Where the list of intermediate tables ends now, for clear()."""
    return len(_made(spark))


def clear(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete intermediate tables, those made between two marks or all. Tables that unread results come from must stay."""
    made = _made(spark)
    chosen = [p for p in made[first:last] if p]
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in chosen:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    made[first:last] = [""] * len(made[first:last])  # marks stay valid
