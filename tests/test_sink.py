"""Files that show all at once: failed and repeated tasks, broken-off writes, overwriting."""

import os

import pytest
from pyspark.sql import functions as F

from lingolake.sources import sink


def files_under(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def shown(spark, path):
    return {r.file: r.text for r in sink.written_files(spark, str(path)).collect()}


ROWS = [(f"job_id={j}/a b+é.txt", k, f"{j}-{k}\n") for j in range(20) for k in range(9, -1, -1)] + [("one", 0, None), ("one", 1, "z"), ("empty", 0, None)]


def test_files_show_at_once(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "file string, place long, text string").repartition(5)
    assert shown(spark, tmp_path) == {}
    sink.write_files(df, str(tmp_path))
    want = {f"job_id={j}/a b+é.txt": "".join(f"{j}-{k}\n" for k in range(10)) for j in range(20)} | {"one": "z"}
    assert shown(spark, tmp_path) == want
    sink.write_files(spark.createDataFrame([("two", 0, "x")], "file string, place long, text string"), str(tmp_path))
    assert shown(spark, tmp_path) == want | {"two": "x"}
    sink.write_files(df.filter("file = 'one'"), str(tmp_path), "overwrite")
    assert shown(spark, tmp_path) == {"one": "z"}
    sink.write_files(df.limit(0), str(tmp_path))
    assert shown(spark, tmp_path) == {"one": "z"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "file string, place long, text string").repartition(5)
    sink.write_files(df.filter("file = 'one'"), str(tmp_path))
    before = files_under(tmp_path)
    broken = df.withColumn("text", F.when((F.col("file") == "job_id=7/a b+é.txt") & (F.col("place") == 5), F.raise_error(F.lit("no more"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no more"):
        sink.write_files(broken, str(tmp_path))
    assert files_under(tmp_path) == before and shown(spark, tmp_path) == {"one": "z"}


def test_a_repeated_task_counts_once(spark, tmp_path):
    """A second attempt writes to a folder of its own; the one that is not committed is not read."""
    from pyspark.sql import Row

    writer = sink._Writer(str(tmp_path), False)
    rows = [Row(file="a", text="1"), Row(file="a", text="2")]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert lost.folder != kept.folder
    writer.commit([kept, None])
    assert shown(spark, tmp_path) == {"a": "12"}
    more = writer.write(iter([Row(file="b", text="x")]))
    writer.abort([more])
    assert shown(spark, tmp_path) == {"a": "12"} and not os.path.exists(tmp_path / "data" / more.folder)


def test_transcripts_and_subtitles(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 5, "b\nc"), (1, 1, 0, "a"), (2, 1, 0, None)], "job_id long, idx long, start_ms long, text string")
    sink.publish_transcripts(rows, str(tmp_path))
    sink.publish_subtitles(spark.createDataFrame([(1, "1\n")], "job_id long, srt string"), str(tmp_path))
    assert shown(spark, tmp_path) == {
        "job_id=1/transcript.jsonl": '{"idx":1,"start_ms":0,"text":"a"}\n{"idx":2,"start_ms":5,"text":"b\\nc"}\n',
        "job_id=1/transcript.md": "a\n\nb\nc\n\n",
        "job_id=2/transcript.jsonl": '{"idx":1,"start_ms":0}\n',
        "job_id=2/transcript.md": "\n\n",
        "job_id=1/subtitles.srt": "1\n",
    }
