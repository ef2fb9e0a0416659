"""A sink of text files with a two-phase commit: tasks write to folders of their own, and one manifest names those that count.

A task's files lie in data/<its own id>/. When all tasks have ended, the driver puts one small file into manifests/, with the folders of
the tasks that Spark has committed; readers begin there. So a task that fails removes its folder, one that runs twice counts once, a
write that is broken off shows nothing, and what readers see changes at once. The driver holds a name for each task, not for each file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and its name there; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if ":/" in uri else "file://" + uri)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator) -> Written:
        store, root = open_store(self.path)
        folder, out, name, files = uuid.uuid4().hex, None, None, 0
        try:
            for row in iterator:
                if row.file != name:
                    if out is not None:
                        out.close()
                    name, files = row.file, files + 1
                    place = f"{root}/data/{folder}/{name}"
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(place, compression=None)
                out.write((row.text or "").encode())
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            if files:
                store.delete_dir(f"{root}/data/{folder}")
            raise
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        store.create_dir(f"{root}/manifests", recursive=True)
        last, kept = _last(store, root)
        folders = ([] if self.overwrite else kept) + [m.folder for m in messages if m is not None and m.files]
        with store.open_output_stream(f"{root}/manifests/{last + 1:012d}.json") as out:
            out.write(json.dumps({"folders": folders}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        for m in messages:
            if m is not None and m.files:
                store.delete_dir(f"{root}/data/{m.folder}")


def _last(store: pafs.FileSystem, root: str) -> tuple[int, list[str]]:
    """The number of the last manifest and its folders; -1 and none if there is no manifest."""
    found = store.get_file_info(pafs.FileSelector(f"{root}/manifests", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
    if not names:
        return -1, []
    with store.open_input_stream(f"{root}/manifests/{names[-1]}", compression=None) as f:
        return int(names[-1][:12]), json.loads(f.read())["folders"]


class FileSink(DataSource):
    """spark.dataSource.register(FileSink); df.write.format("files_at_once"). Rows (file, text) in order of file."""

    @classmethod
    def name(cls) -> str:
        return "files_at_once"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (file, place, text) as one file for each name, its texts in order of place; all of them show at once.

    Each file is written by one task, and many files by many tasks."""
    rows.sparkSession.dataSource.register(FileSink)
    ordered = rows.repartition("file").sortWithinPartitions("file", "place").select("file", "text")
    ordered.write.format("files_at_once").option("path", path).mode(mode).save()


def written_folders(path: str) -> list[str]:
    """The folders that the last manifest names, one for each task that wrote; names of files go on from there."""
    store, root = open_store(path)
    return [f"{path}/data/{f}" for f in _last(store, root)[1]]


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and whole text of each file that the last manifest names; Spark gives no row for an empty file."""
    folders = written_folders(path)
    if not folders:
        return spark.createDataFrame([], "file string, text string")
    texts = spark.read.option("recursiveFileLookup", True).text(folders, wholetext=True)
    return texts.select(F.url_decode(F.replace(F.regexp_extract(F.input_file_name(), r"/data/[0-9a-f]{32}/(.*)$", 1), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("text"))


def publish_transcripts(rows: DataFrame, path: str, text_col: str = "text", mode: str = "append") -> None:
    """write_transcript through write_files: JSON lines and Markdown paragraphs of each job, which show together or not at all."""
    job = F.concat(F.lit("job_id="), F.col("job_id").cast("string"))
    line = F.concat(F.to_json(F.struct(*[c for c in rows.columns if c != "job_id"])), F.lit("\n"))
    body = F.concat(F.coalesce(text_col, F.lit("")), F.lit("\n\n"))
    pair = F.array(F.struct(F.lit("/transcript.jsonl").alias("name"), line.alias("text")), F.struct(F.lit("/transcript.md").alias("name"), body.alias("text")))
    each = rows.select(job.alias("job"), F.col("idx").alias("place"), F.explode(pair).alias("x"))
    write_files(each.select(F.concat("job", "x.name").alias("file"), "place", "x.text"), path, mode)


def publish_subtitles(srt: DataFrame, path: str, mode: str = "append") -> None:
    """The SubRip texts of to_srt as a file for each job."""
    write_files(srt.select(F.concat(F.lit("job_id="), F.col("job_id").cast("string"), F.lit("/subtitles.srt")).alias("file"), F.lit(0).alias("place"), F.col("srt").alias("text")), path, mode)
