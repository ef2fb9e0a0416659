"""Lines of files of any length, read in splits, with their exact numbers."""

import json

import pytest

from lingolake.sources import segments as S

BODIES = {"a": "one\ntwo\r\n\nfour", "b": "\n" * 300, "c": "".join(f"line {k} é漢\n" for k in range(2000)), "d": "", "e": "no end " * 50, "f": "x" * 5000 + "\ny\n" + "z" * 700}


def expected(body):
    lines = body.split("\n")
    return [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]


@pytest.mark.parametrize("size", ["100", "1k", "128m"])
def test_line_numbers_whatever_the_splits(spark, tmp_path, size):
    for name, body in BODIES.items():
        (tmp_path / f"{name}.txt").write_bytes(body.encode())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, size)
    try:
        rows = S.read_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.line)):
        got.setdefault(r.file[-5], []).append((r.line, r.value))
    assert got == {n: list(enumerate(expected(b))) for n, b in BODIES.items() if expected(b)}


def test_segments_of_a_file_of_many_splits(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "t.jsonl").write_text("".join(json.dumps({"start_ms": 10 * k, "end_ms": 10 * k + 5, "text": f"t{k}"}) + "\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = S.read_segments(spark, str(tmp_path / "*" / "*.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.job_id, r.idx, r.start_ms, r.text) for r in rows) == [("j", k + 1, 10 * k, f"t{k}") for k in range(3000)]


def test_lines_of_a_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = {}
    write = lambda lines, epoch: got.update({(r.file[-5], r.line): r.value for r in lines.collect()})
    for names in ("ab", "cf"):
        for n in names:
            (tmp_path / "in" / f"{n}.txt").write_bytes(BODIES[n].encode())
        S.stream_lines(spark, str(tmp_path / "in"), write, 1).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert got == {(n, k): v for n in "abcf" for k, v in enumerate(expected(BODIES[n]))}
