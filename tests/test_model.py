"""A caller's model: chunks that depend on a card, runs that go on, groups that fall back; and results whose order is the operator."""

import pytest
from pyspark.sql import functions as F

from lingolake.operators import model, relations


def test_merged_card_is_by_recency():
    card = [{"name": n, "target": n.upper(), "gender": "unknown", "note": ""} for n in "abc"]
    got = model.merged_card(card, [{"name": "a", "target": "A2"}, {"name": " "}, {"target": "x"}, {"name": "d", "gender": "male", "note": 5}, {"name": "a", "target": "y" * 300}], 3)
    assert [c["name"] for c in got] == ["c", "d", "a"] and got[1] == {"name": "d", "target": "", "gender": "male", "note": "5"} and len(got[2]["target"]) == 200


def test_chunks_with_a_card_go_on_after_a_failure(spark, tmp_path):
    """Chunk n sees the card of n - 1; rounds that were written are not sent again; jobs of other lengths end earlier."""
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    broken.write_text("")
    rows = spark.createDataFrame([(j, i, f"t{i}" if i != 3 else " ") for j, n in ((1, 10), (2, 3), (3, 1)) for i in range(1, n + 1)], "job_id long, idx long, text string")
    cards = spark.createDataFrame([(1, "zed", "Z", None), (1, "amy", "A", "female"), (9, "none", "", None)], "job_id long, name string, target string, gender string")

    def fn(todo, before, card):
        key = f"{todo[0]['id']}-{'.'.join(c['name'] for c in card)}-{'.'.join(str(b['id']) + ('' if 'target' in b else '!') for b in before)}"
        if broken.exists() and todo[0]["id"] > 5:
            raise RuntimeError("the gateway is gone")
        with open(calls / f"{key}.txt", "a") as f:
            f.write("x")
        return {"rows": [{"id": r["id"], "text": f" {r['text']}~{len(card)} ", "ok": r["id"] != 4} for r in todo], "characters": [{"name": f"n{todo[0]['id']}"}, {"name": "amy"}], "billed": 7}

    run = lambda: model.translate_chunks_with_card(rows, cards, fn, str(tmp_path / "state"), 3, 2, 3)
    with pytest.raises(Exception, match="the gateway is gone"):
        run().collect()
    broken.unlink()
    got = {(r.job_id, r.idx): (r.chunk_no, r.output, r.flagged, r.billed) for r in run().collect()}
    assert {p.name.removesuffix(".txt"): p.read_text() for p in calls.iterdir()} == {"1-amy.zed-": "x", "1--": "xx", "5-zed.n1.amy-2.4!": "x", "8-n1.n5.amy-6.7": "x"}
    assert got[1, 4] == (0, "t4~2", True, 7) and got[1, 5] == (1, "t5~3", False, 7) and got[1, 10] == (2, "t10~3", False, 7) and got[2, 2] == (0, "t2~0", False, 7)
    assert len(got) == 9 + 2 + 1


def test_another_set_of_rows_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "job_id long, idx long, text string")
    none = spark.createDataFrame([], "job_id long, name string, target string, gender string")
    with pytest.raises(Exception, match="another set of rows"):
        model.translate_chunks_with_card(rows, none, lambda todo, before, card: {"rows": [{"id": 1, "text": "x", "ok": True}]}, str(tmp_path / "s")).collect()
    assert model.translate_chunks_with_card(rows.limit(0), none, None, str(tmp_path / "t")).count() == 0


def test_groups_fall_back_row_by_row(spark):
    groups = spark.createDataFrame([(1, 0, [1, 2], ["ab", "cd"]), (1, 1, [3], ["lost"]), (2, 0, [1, 2], ["lost", "odd"])], "job_id long, group_no int, ids array<long>, texts array<string>")
    fn = lambda texts: ["nothing" if "lost" in t else t.replace("</s", "!</s") for t in texts]
    done, failed, stats = model.map_groups_with_fallback(groups, fn, [lambda t, seed: "" if t == "odd" else t + "1", lambda t, seed: ""])
    assert sorted((r.job_id, r.idx, r.output, r.alone) for r in done.collect()) == [(1, 1, "ab!", False), (1, 2, "cd!", False), (1, 3, "lost1", True), (2, 1, "lost1", True)]
    assert [(r.job_id, r.idx, len(r.attempts)) for r in failed.collect()] == [(2, 2, 2)]
    assert sorted(map(tuple, stats.collect())) == [(1, 2, 3, 1), (2, 1, 2, 1)]


def test_results_come_in_order(spark):
    """The order of rows is what these two give; ties by the rest of the key."""
    rows = spark.createDataFrame([(k % 3, (k * 7) % 50, (k * 11) % 60) for k in range(300)], "job_id long, start_ms long, end_ms long").repartition(7)
    got = [(r.start_ms, r.end_ms) for r in relations.merge_sorted(rows).filter("job_id = 1").collect()]
    assert got == sorted(got) and len(got) == 100
    units = spark.range(300).select((F.col("id") % 3).alias("job_id"), ((F.col("id") * 37) % 100).alias("index")).repartition(7)
    parts = relations.manifest_order(units).select("job_id", "index", F.spark_partition_id().alias("p")).collect()
    for job in range(3):
        mine = [(r.p, r["index"]) for r in parts if r.job_id == job]
        assert [i for _, i in mine] == sorted(i for _, i in mine)
