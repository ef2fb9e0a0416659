"""Ordered work on long keys: cut into ranges and islands it equals the uncut form, and no task holds a whole key."""

import random

import pytest
from pyspark.sql import functions as F

from lingolake.operators import folds, ranks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def spans_of(spark, seed, n=600, jobs=3, malformed=False):
    rng = random.Random(seed)
    rows, at = [], dict.fromkeys(range(jobs), 0)
    for k in range(n):
        job = rng.choice([0] * 4 + list(range(jobs)))
        at[job] += rng.choice([0, 0, 50, 300, 699, 700, 701, 1500, 1501, 40_000])
        length = rng.choice([-200, 0] if malformed and rng.random() < 0.1 else [1, 30, 500, 2_000, 29_999])
        rows.append((job, k, at[job], at[job] + length, f"w{k} " * rng.randint(1, 4) + rng.choice(["", ".", "!", ","])))
    return spark.createDataFrame(rows, "job_id long, idx long, start_ms long, end_ms long, text string").repartition(3).cache()


@pytest.mark.parametrize("seed", range(2))
def test_islands_equal_the_uncut_fold(spark, seed):
    df = spans_of(spark, seed, malformed=seed % 2 == 1)
    for fold in (folds.group_spans, folds.dedupe_overlaps, folds.paragraphs):
        assert rows_of(fold(df, long=40)) == rows_of(fold(df, long=10**9)), fold.__name__
    units = lambda long: rows_of(folds.narration_units(df, (420, 1000, True), 60, 1500, long))
    assert units(40) == units(10**9)


def test_islands_of_equal_rows_and_of_one_island(spark):
    same = spark.createDataFrame([(1, 0, 10, "x")] * 300, "job_id long, start_ms long, end_ms long, text string")
    chain = spark.createDataFrame([(1, 600 * k, 600 * k + 650, "x") for k in range(300)], "job_id long, start_ms long, end_ms long, text string")
    for df in (same, chain):
        for fold in (folds.group_spans, folds.dedupe_overlaps):
            assert rows_of(fold(df, long=10)) == rows_of(fold(df, long=10**9))


def test_a_long_job_is_many_tasks(spark):
    """Rows of one job: ranges hold near equal shares, and so do the tasks that fold its islands."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + F.when(F.col("id") % 5 == 0, 200).otherwise(900)).alias("end_ms"))
    ranges = ranks.ranged(df, ["job_id"], ["start_ms"], 16).groupBy("_part").count().collect()
    assert len(ranges) == 16 and max(r["count"] for r in ranges) < n / 8
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ranks.carried(ranks.ranged(df, ["job_id"], ["start_ms"], 16), ["job_id"], maxes={"_reach": F.col("end_ms")})
        rows = ranks.carried(rows, ["job_id"], sums={"_island": (F.col("start_ms") - F.col("_reach") > 700).cast("long")})
        tasks = rows.repartition(16, "job_id", "_island").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 16 and max(r["count"] for r in tasks) < n / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    summed = [F.count("*"), F.min("chunk_no"), F.max("chunk_no"), F.sum(F.col("end_ms") * F.col("chunk_no")), F.sum("start_ms")]
    assert folds.group_spans(df, long=1000).agg(*summed).first() == folds.group_spans(df, long=10**9).agg(*summed).first()


def test_carried_columns(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 5), k, rng.choice([None, k % 7])) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, at int, id int, v int").repartition(5)
    got = ranks.carried(ranks.ranged(df, ["key"], [F.desc("at"), "id"], 7), ["key"], "place", {"total": F.col("v")}, {"most": F.col("v")}, {"last": F.col("v"), "last_id": F.col("id")}, {"next_id": F.col("id")})
    want = []
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        for k, r in enumerate(mine):
            before = [x[3] for x in mine[:k] if x[3] is not None]
            want.append((*r, k + 1, sum(before) + (r[3] or 0), max(before, default=None), mine[k - 1][3] if k else None, mine[k - 1][2] if k else None, mine[k + 1][2] if k + 1 < len(mine) else None))
    key = lambda r: tuple((x is None, x or 0) for x in r[1:])
    assert sorted((tuple(r) for r in got.drop("_pos", "_part").collect()), key=key) == sorted(want, key=key)


def test_numbers_with_ties(spark):
    """Equal (created_at, id) take neighbouring numbers; kept ones stay; a later last_no holds."""
    jobs = [("s", f"d{k // 50}", k // 3, None) for k in range(300)] + [("s", "d0", 999, 17), ("t", "d", 1, 4), (None, "d", 2, None)]
    df = spark.createDataFrame(jobs, "scope string, created_at string, id long, workflow_no long")
    got = folds.assign_numbers(df)
    numbered = got.collect()
    assert sorted(r.workflow_no for r in numbered if r.scope == "s") == [17, *range(18, 318)]
    new = sorted((r.workflow_no, r.created_at, r.id) for r in numbered if r.scope == "s" and r.workflow_no > 17)
    assert [x[1:] for x in new] == sorted(x[1:] for x in new)
    assert [r.workflow_no for r in numbered if r.scope is None] == [1]
    late = folds.assign_numbers(df.withColumn("last_no", F.lit(1000)))
    assert sorted(r.workflow_no for r in late.collect() if r.scope == "s") == [17, *range(1001, 1301)]


def test_retention_with_ties(spark):
    entries = [("s", k // 10, f"n{k % 10}", 10 + k % 3) for k in range(200)] * 2 + [("t", 1, "x", None)]
    df = spark.createDataFrame(entries, "scope string, used_at long, name string, size long")
    total, want = 0, []
    for e in sorted((e for e in entries if e[0] == "s"), key=lambda e: (-e[1], e[2])):
        total += e[3]
        want += [e] * (total <= 1000)
    assert sorted(tuple(r) for r in folds.lru_keep(df, most_bytes=1000).filter("scope = 's'").collect()) == sorted(want)
    assert folds.lru_keep(df, most=33).filter("scope = 's'").count() == 33


def test_no_window_is_keyed_by_scope_alone(spark):
    df = spark.createDataFrame([("s", "d", 1, None)], "scope string, created_at string, id long, workflow_no long")
    entries = spark.createDataFrame([("s", 1, "n", 1)], "scope string, used_at long, name string, size long")
    for result in (folds.assign_numbers(df), folds.lru_keep(entries)):
        windows = [line for line in plan(result).splitlines() if "Window [" in line]
        over_rows = [w for w in windows if "_rs" not in w]  # the others run over one row for each range
        assert over_rows and all("[_part#" in w for w in over_rows)


def test_cues_split_a_text_once(spark):
    units = spark.createDataFrame([(1, 1, "a b", 10, 1, 100)], "job_id long, index long, text string, length_ms long, gap_ms long, total_ms long")
    for df in (folds.build_cues(units), folds.build_cues(units.drop("total_ms"))):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("posexplode(") == 1 and text.count("aggregate(") == 1
