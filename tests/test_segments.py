import pytest
from pyspark.sql import functions as F

from lingolake.functions import jobs as J
from lingolake.operators import folds, model, names, relations, rewrite
from lingolake.plans import registry
from lingolake.sources import segments as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_group_spans_and_chunks(spark):
    spans = spark.createDataFrame([("j", 0, 28000), ("j", 28000, 34000), ("j", 40000, 42000), ("k", 5, 5)], "job_id string, start_ms long, end_ms long")
    chunks = folds.chunk_overlap(folds.group_spans(spans))
    assert rows(chunks, "chunk_no") == [("j", 0, 0, 30500, 0, 28000), ("j", 1, 25500, 34000, 28000, 34000), ("j", 2, 40000, 42000, 40000, 42000)]


def test_merge(spark):
    given = [("j", 1000, 2000, "你好。"), ("j", 4000, 5000, "世界。"), ("j", 1200, 1800, "你好。"), ("j", 6000, 7000, "再见。")]
    kept = folds.dedupe_overlaps(spark.createDataFrame(given, "job_id string, start_ms long, end_ms long, text string"))
    assert [r[4] for r in rows(kept, "idx")] == ["你好。", "世界。", "再见。"]
    assert [r[3] for r in rows(folds.paragraphs(kept), "paragraph")] == ["你好。", "世界。再见。"]


def test_folds_on_empty(spark):
    none = spark.createDataFrame([], "job_id string, start_ms long, end_ms long, text string, idx long")
    assert folds.group_spans(none).count() == 0 and folds.dedupe_overlaps(none).count() == 0 and folds.paragraphs(none).count() == 0


def test_folds_do_not_depend_on_partitions(spark):
    given = [(f"j{i % 7}", (i * 37) % 5000, (i * 37) % 5000 + i % 900, str(i)) for i in range(2000)]
    df = spark.createDataFrame(given, "job_id string, start_ms long, end_ms long, text string")
    assert rows(folds.dedupe_overlaps(df.repartition(1)), "job_id", "idx") == rows(folds.dedupe_overlaps(df.repartition(13)), "job_id", "idx")


def test_narration(spark):
    given = [("j", 1, 0, 900, "Kiếp trước tôi,"), ("j", 2, 950, 1800, "đã chết."), ("j", 3, 1900, 2500, "Thật sao?"), ("j", 4, 2600, 3000, "Ừ."), ("j", 5, 6000, 7000, "Ba năm sau.")]
    df = spark.createDataFrame(given, "job_id string, idx long, start_ms long, end_ms long, text string")
    got = folds.narration_units(df, J.validate_style("rebirth")).select("index", "text", "gap_after_ms")
    assert rows(got, "index") == [(1, "Kiếp trước tôi, đã chết.", 420), (3, "Thật sao?", 1000), (4, "Ừ.", 1000), (5, "Ba năm sau.", 0)]
    plain = folds.narration_units(df, None)
    assert plain.count() == 5 and plain.filter("gap_after_ms is not null").count() == 0


@pytest.mark.parametrize(
    ("units", "options", "total", "cues"),
    [
        ([("Xin chào.", 2000, 300), ("Tạm biệt các bạn.", 3000, 0)], (84, 1.0), None, [(0, 2000), (2300, 5300)]),
        ([("Vâng.", 400, 100), ("Được rồi.", 400, 5000), ("Hết.", 3000, 0)], (84, 1.0), None, [(0, 500), (500, 1500), (5900, 8900)]),
        ([("Hết.", 300, 0)], (84, 2.0), 300, [(0, 300)]),
        ([("Hết.", 300, 0)], (84, 2.0), None, [(0, 2000)]),
        ([("A" * 20 + ".", None, 0), ("B" * 20 + ".", None, 0)], (84, 1.0), 10000, [(0, 5000), (5000, 10000)]),
    ],
)
def test_cues(spark, units, options, total, cues):
    df = spark.createDataFrame([("j", i, *u) for i, u in enumerate(units)], "job_id string, index long, text string, length_ms long, gap_ms long")
    df = df if total is None else df.withColumn("total_ms", F.lit(total).cast("long"))
    assert [r[2:4] for r in rows(folds.build_cues(df, *options), "cue_no")] == cues


def test_cue_pieces_share_time(spark):
    df = spark.createDataFrame([("j", 0, "A" * 20 + "`. " + "B" * 60 + ".", 8000, 0)], "job_id string, index long, text string, length_ms long, gap_ms long")
    got = rows(folds.build_cues(df, 62), "cue_no")
    assert len(got) == 2 and got[0][3] == got[1][2] and got[1][3] == 8000


def test_srt(spark):
    cues = spark.createDataFrame([("j", 1, 0, 4160, "Xin chào"), ("j", 2, 3723599, 3725000, "dòng\nhai")], "job_id string, cue_no long, start_ms long, end_ms long, text string")
    assert S.to_srt(cues).first()["srt"] == "1\n00:00:00,000 --> 00:00:04,160\nXin chào\n\n2\n01:02:03,599 --> 01:02:05,000\ndòng\nhai\n\n"


def test_replace_terms(spark):
    rules = [("short", "thế", "short"), ("long", "thế giới", "a.b"), ("literal", "a.b", "OK")]
    import unicodedata

    df = spark.createDataFrame([(1, unicodedata.normalize("NFD", "thế giới a.b aXb")), (2, None), (3, "")], "idx long, text string")
    got = rows(rewrite.replace_terms(df, "text", rules), "idx")
    assert got[0] == (1, "a.b OK aXb", ["long", "literal"]) and got[1][1] is None and got[2][1] == ""


def test_clean_source(spark):
    df = spark.createDataFrame([("j", 1, "今天真煤运。"), ("j", 2, "他苦苦婆心，"), ("j", 3, "没有错字。")], "job_id string, idx long, text string")
    assert [r[1:] for r in rows(rewrite.clean_source(df), "idx")] == [(1, "今天真霉运。"), (2, "他苦口婆心，")]
    # a phrase that runs over four rows and begins inside the first
    lines = ["甲乙丙欢迎收听，", "本台广播。", "请勿走开", "谢谢。", "正文开始。"]
    df = spark.createDataFrame([("j", i, t) for i, t in enumerate(lines, 1)] + [("k", 1, None), ("k", 2, "请勿走开")], "job_id string, idx long, text string")
    phrase = [r"欢迎收听[，。]*本台广播[，。]*请勿走开[，。]*谢谢"]
    assert [r[1:] for r in rows(rewrite.remove_boilerplate(df, phrase), "idx")] == [(1, "甲乙丙，"), (2, ""), (3, ""), (4, "")]
    assert rewrite.remove_boilerplate(df, phrase, head=3).count() == 0
    two = rewrite.remove_boilerplate(df, ["甲乙", "乙丙"]).first()
    assert two.text == "欢迎收听，"


def test_clean_source_of_random_jobs(spark, capsys):
    """Against single characters kept or not, row by row; a long job sends few rows to its group."""
    import random
    import re

    rng, made, want = random.Random(5), [], []
    patterns, fixes = ["ab+c", "CA。?", "b。a"], [("aab", "cc")]
    for job in [None, "j", "k", "l"]:
        texts = {i: "".join(rng.choices("abc。， ", k=rng.randrange(9))) for i in range(rng.choice([3, 40, 90]))}
        made += [(job, i, t) for i, t in texts.items()]
        fixed = {i: t.replace(*fixes[0]) for i, t in texts.items()}
        head = "".join(fixed[i] for i in sorted(fixed)[:20])
        cut, at = {k for p in patterns for m in re.finditer(p, head, re.I) for k in range(*m.span())}, 0
        for i in sorted(fixed):
            t, own = fixed[i], range(at, at + len(fixed[i])) if i < 20 else range(0)
            at += len(own)
            if cut & set(own):
                t = "".join(c for c, k in zip(t, own) if k not in cut)
                t = t.lstrip("，,。 ") if t.strip("。， ") else ""
                t += fixed[i][-1] if t and fixed[i][-1] in "。，" and t[-1] not in "。，" else ""
            if t != texts[i]:
                want.append((job, i, t))
    df = spark.createDataFrame(made + [("l", 0, made[-len(texts)][2])], "job_id string, idx long, text string").repartition(5)
    got = [tuple(r) for r in rewrite.clean_source(df, fixes, patterns, head=20).collect()]
    assert sorted(set(got), key=str) == sorted(want, key=str)
    assert sum(r[:2] == ("l", 0) for r in got) == 2 * sum(r[:2] == ("l", 0) for r in want)
    with pytest.raises(ValueError):
        rewrite.clean_source(df, fixes, ["a*"])
    rewrite._heads(df.select("job_id", "idx", F.col("text").alias("before"), F.col("text").alias("fixed")), 20).explain()
    plan = capsys.readouterr().out
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")  # below the exchange too
    assert rewrite.clean_source(df.limit(0), fixes, patterns).count() == 0 and rewrite.clean_source(df, fixes, []).count() > 0


def test_flow(spark):
    corpus = [("j", i, "tôi chạy rồi cuối cùng ngã") for i in range(6)]
    for before, text, want in [("qua sông,", "Rồi tôi chết.", "rồi tôi chết."), ("qua sông,", "Lý Cường đến.", "Lý Cường đến."), ("qua sông,", "Mumu đến.", "Mumu đến."), ("qua sông.", "Rồi tôi chết.", "Rồi tôi chết."), ("qua sông:", "Rồi tôi.", "Rồi tôi.")]:
        df = spark.createDataFrame([*corpus, ("j", 10, before), ("j", 11, text)], "job_id string, idx long, text string")
        assert rows(rewrite.fix_flow(df), "idx")[-1][2] == want


def test_foreign_report(spark):
    given = ["ok", "Xin chào 世界.", "a", "Lý (李明)"]
    df = spark.createDataFrame([("j", i, t) for i, t in enumerate(given)], "job_id string, idx long, text string")
    assert rows(rewrite.foreign_report(df, "text"), "job_id") == [("j", 4, 2, 4, [1, 3])]
    once = rewrite.clean_foreign(df, "text")
    assert rows(once, "idx") == rows(rewrite.clean_foreign(once, "text"), "idx")


def test_names(spark):
    texts = ["罗静雯推门", "罗静雯坐下", "罗静雯问", "静雯哭", "静雯睡", "高飞到", "高飞家", "高飞看", "高飞问", "那年", "那年那年"]
    df = spark.createDataFrame([("j", t) for t in texts], "job_id string, text string")
    tables = ({"司马": "Tư Mã"}, {"罗": "La", "高": "Cao", "那": "Na"}, {"静": "Tĩnh", "雯": "Văn", "飞": "Phi", "家": "Gia", "年": "Niên"}, ["那"])
    got = {r["source"]: (r["target"], r["count"]) for r in names.mine_names(df, *tables).collect()}
    assert got == {"罗静雯": ("La Tĩnh Văn", 3), "高飞": ("Cao Phi", 4), "静雯": ("Tĩnh Văn", 2)}


def test_incremental(spark):
    key = "job_id long, stage string, idx long, fingerprint string"
    all_rows = spark.createDataFrame([(1, "t", i, f"f{i}") for i in range(1, 6)], key)
    done = spark.createDataFrame([(1, "t", i, f"f{i}", f"o{i}") for i in (1, 2)], key + ", output string")
    assert [r[2] for r in rows(relations.pending_rows(all_rows, done), "idx")] == [3, 4, 5]
    assert [r[4] for r in rows(relations.resume_rows(all_rows, done), "idx")] == ["o1", "o2", None, None, None]


def test_chunked_model(spark):
    df = spark.createDataFrame([(1, i, f"r{i}") for i in range(1, 8)], "job_id long, idx long, text string")

    def fn(chunk, before):
        return {r["idx"]: "漢" if r["idx"] == 5 else f"{r['text']}:{[b['idx'] for b in before]}" for r in chunk}

    got = rows(model.translate_chunks(df, fn, 3, 2), "idx")
    assert got[3][4] == "r4:[2, 3]" and [r[1] for r in got if r[5]] == [5] and got[4][4] == "…"


def test_retries(spark):
    df = spark.createDataFrame([(1, 1, "一"), (1, 2, "她来了。"), (1, 3, "三")], "job_id long, idx long, text string")

    def first(text, seed):
        return {"一": "một", "她来了。": "Anh ta và cô ấy", "三": "漢"}[text]

    done, failed = model.with_retries(df, [first, first])
    assert [(r[1], r[3], r[5]) for r in rows(done, "idx")] == [(1, "một", False), (2, "Cô ta và cô ấy", True)]
    assert [(r["idx"], [a["reason"] for a in r["attempts"]]) for r in failed.collect()] == [(3, ["untranslated Chinese"] * 2)]


def test_a_strategy_sees_a_row_once(spark):
    import tempfile

    seen = tempfile.mkdtemp()

    def calls(k, answer):
        def fn(text, seed):
            with open(f"{seen}/{k}", "a") as f:
                f.write(f"{text}\n")
            return answer(text)

        return fn

    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(30)], "job_id long, idx long, text string")
    done, failed = model.with_retries(df, [calls(0, lambda t: ""), calls(1, lambda t: "ok" if t < "t2" else ""), calls(2, lambda t: "")])
    for _ in range(2):
        assert done.count() + failed.count() == 30
    assert [sum(1 for _ in open(f"{seen}/{k}")) for k in range(3)] == [30, 30, done.filter("attempt = 1").count() * -1 + 30]
    groups = spark.createDataFrame([(1, g, [g], [f"t{g}"]) for g in range(10)], "job_id long, group_no int, ids array<long>, texts array<string>")
    good, bad = model.map_groups(groups, lambda texts: [calls(3, lambda t: t)(t, 0) for t in texts])
    assert good.count() == 10 and bad.count() == 0 and sum(1 for _ in open(f"{seen}/3")) == 10


def test_rolling_context(spark):
    texts = ["first text"] + [""] * 700 + [None, "x" * 600, "y", "z"]
    df = spark.createDataFrame([("j", i, t) for i, t in enumerate(texts)] + [("k", 0, "other"), ("k", 1, "a")], "job_id string, idx long, text string")
    got = {(r.job_id, r.idx): r.context for r in folds.rolling_context(df).collect()}
    for i in range(len(texts)):
        assert got["j", i] == "".join(t or "" for t in texts[:i])[-512:]
    assert got["k", 1] == "other" and len(got) == len(texts) + 2


def test_checked_rule_changes(spark):
    rules = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "rule_id int, source string, replacement string")
    changes = spark.createDataFrame([(1, "edit", "b", "z", 1), (2, "delete", None, None, 2), (3, "add", "", "z", 3), (4, "add", "d", "w", 4), (5, "add", "d", "v", 5)], "rule_id int, action string, source string, replacement string, seq int")
    good, bad = relations.checked_rule_changes(rules, changes)
    assert rows(good, "rule_id") == [(1, "b", "z")]
    assert [(r.rule_id, r.problem) for r in bad.orderBy("rule_id").collect()] == [(3, "empty source"), (4, "duplicate source"), (5, "duplicate source")]


def test_groups_and_batches(spark):
    df = spark.createDataFrame([(1, 0, [1, 2], ["一", "二"]), (1, 1, [3], ["bad"])], "job_id long, group_no int, ids array<long>, texts array<string>")
    good, bad = model.map_groups(df, lambda texts: ["oops" if "bad" in t else t.replace("一", "a").replace("二", "b") for t in texts])
    assert [r[4] for r in rows(good, "idx")] == ["a", "b"] and [r[2] for r in rows(bad, "idx")] == [3]


def test_download_outcome(spark):
    given = [(1, 1, None, "HTTP Error 429"), (2, 1, None, "Sign in to confirm"), (3, 1, "file", "needs to be reloaded"), (4, 1, None, None), (5, 1, None, "boom")]
    df = spark.createDataFrame(given, "job_id long, attempt_no int, cookies string, error string")
    jobs = spark.createDataFrame([(i,) for i in range(1, 7)], "job_id long")
    assert [r[1] for r in rows(relations.download_outcome(df, jobs), "job_id")] == ["T103", "T101", "T102", "T106", "T107", "T101"]


def test_video_plan(spark):
    clip = (1, "h264", 854, 480, 30.0, "yuv420p", 0, 1000, 900_000, 3500)
    df = spark.createDataFrame([("j", *clip)], "job_id string, pos int, codec string, width int, height int, fps double, pix_fmt string, rotation int, duration_ms long, bitrate long, voice_ms long")
    got = relations.video_plan(df).first()
    assert (got.mode, got.repeats) == ("copy", 4)
    hour = df.withColumn("voice_ms", F.lit(3_600_000).cast("long"))
    assert relations.video_plan(hour, "480", "medium").first().size_bytes == int((1200 + 128) * 1000 / 8 * 3600 * 1.02)
    assert relations.video_plan(df.withColumn("voice_ms", F.lit(None).cast("long"))).first().size_bytes is None


def test_sources(spark, tmp_path):
    job = tmp_path / "job1"
    job.mkdir()
    (job / "t.jsonl").write_text('{"start_ms": 0, "end_ms": 5, "text": "a"}\n{"start_ms": 3, "end_ms": 9, "text": "b"}\n')
    assert rows(S.read_segments(spark, f"{job}/t.jsonl"), "idx") == [("job1", 1, 0, 5, "a"), ("job1", 2, 3, 9, "b")]
    (job / "bad.jsonl").write_text('{"start_ms": 9, "end_ms": 5, "text": "a"}\n')
    with pytest.raises(Exception, match="end before start"):
        S.read_segments(spark, f"{job}/bad.jsonl").collect()
    (job / "x.txt").write_text("  one \n\n two\n")
    good, _ = S.ingest_text(spark, f"{job}/x.txt")
    assert [(r[1], r[2], r[4]) for r in rows(good, "idx")] == [(1, 0, "one"), (2, 1, "two")]
    second = S.read_segments(spark, f"{job}/t.jsonl").withColumn("job_id", F.lit("job2")).withColumn("text", F.upper("text"))
    S.write_transcript(S.read_segments(spark, f"{job}/t.jsonl").union(second), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/rows")).count() == 4
    for name, text in (("job1", "a\n\nb\n\n"), ("job2", "A\n\nB\n\n")):
        assert "".join(f.read_text() for f in (tmp_path / f"out/markdown/job_id={name}").glob("*.txt")) == text
    (job / "m.jsonl").write_text('{"index": 1, "text": "a", "frames": 96000, "gap_after_ms": 500}\n{"index": 2, "text": "b", "frames": 144000}\n')
    units = S.read_manifest(spark, f"{job}/m.jsonl")
    assert [r[3:5] for r in rows(units, "index")] == [(2000, 500), (3000, 0)]
    assert relations.manifest_adds_up(units.withColumn("total_ms", F.lit(5500))).first().adds_up
    assert not relations.manifest_adds_up(units.withColumn("total_ms", F.lit(60000))).first().adds_up
    (job / "n.jsonl").write_text("")
    with pytest.raises(ValueError, match="n.jsonl"):
        S.read_manifest(spark, f"{job}/[mn].jsonl")
    assert S.scan_binary_digests(spark, str(job)).count() == 4  # Spark passes empty files over


def test_jobs_of_many_folders(spark, tmp_path):
    """A few tasks list the folders, and a few read the files, though Spark alone would start one for each."""
    for n in range(400):
        run = tmp_path / ("tools" if n % 3 == 0 else "workflows") / str(n)
        run.mkdir(parents=True)
        (run / "job.json").write_text(f'{{\n "id": "{n}",\n "progress": {n}.5\n}}')
        (run / "delete-request.json").write_text('{"id": "none"}')
    context, confs = spark.sparkContext, {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "10000"}
    before = {k: spark.conf.get(k) for k in confs}
    context.setJobGroup("list", "list")
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        jobs = S.read_jobs(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
        assert jobs.rdd.getNumPartitions() == 16
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    status = context.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("list") for s in status.getJobInfo(j).stageIds]
    assert 0 < sum(s.numTasks for s in stages) <= 32
    assert rows(jobs.select(F.col("id").cast("int"), "progress", "scope"), "id") == [(n, n + 0.5, "workflows" if n % 3 else "tools") for n in range(400)]


def test_jobs_of_odd_suppliers(spark, tmp_path):
    """Every row comes back: no key, a key that comes again, no name, numbers that JSON has no form for."""
    given = [(None, "a", 1.0), (None, "b", None), (3, "c", -2.5), (3, "c", -2.5), (3, 'd"\n\\', float("inf")), (-3, None, 0.0), (-4, "e/é", 1e300), (0, "", -0.0), (7, "f", 0.1)]
    df = spark.createDataFrame(given, "s_suppkey long, s_name string, s_acctbal double")
    query = registry.queries()["a9_read_jobs"]
    df.write.parquet(f"{tmp_path}/some/supplier.parquet")
    want = [(None if k is None else str(k), name, progress, "workflows" if k is None or k % 3 else "tools") for k, name, progress in given]
    assert sorted(map(repr, rows(query(spark, f"{tmp_path}/some"), "id"))) == sorted(map(repr, want))
    df.limit(0).write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert query(spark, f"{tmp_path}/none").collect() == []
