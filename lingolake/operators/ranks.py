"""Ordered work on keys of any size, by ranges of rows instead of a window over a whole key.

Rows are exchanged by ranges of (keys, order), so a key of any size is many tasks, and ties are cut like other rows. Each range adds up its
own rows; what it must know of those before and after it comes from a summary of one row for each range and key, which windows carry from
range to range and a join brings back. No row count, sum or order passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize

#: Rows of a key beyond which its ordered work is cut into ranges.
LONG = 1_000_000
_SHIFT = 33  # monotonically_increasing_id() has the partition above these bits


def ranged(df: DataFrame, keys: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df written in ranges of (keys, order), with _pos, a row's place in the order of all rows (with gaps), and _part, its range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.select(*[c for c in df.columns if c not in ("_pos", "_part", "_tie")], F.monotonically_increasing_id().alias("_tie"))
    rows = tied.repartitionByRange(parts, *keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie")
    rows = materialize(rows.withColumn("_pos", F.monotonically_increasing_id()), "ranges")
    return rows.withColumn("_part", F.shiftright("_pos", _SHIFT))


def carried(rows: DataFrame, keys: list[str], place: str | None = None, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, leads: dict[str, Column] | None = None) -> DataFrame:
    """Rows of `ranged` with more columns over their key: `place` (from 1), running sums up to and with the row, the largest value before
    the row, and the value of the row before or after it. Null keys are a key of their own; nulls add nothing."""
    sums, maxes, lags, leads = sums or {}, maxes or {}, lags or {}, leads or {}
    own = Window.partitionBy("_part", *keys).orderBy("_pos")
    upto, earlier = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    mine, ranges, across, result = [], [], [], []
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    counted = {**({place: F.lit(1)} if place else {}), **sums}
    for k, (name, value) in enumerate(counted.items()):
        mine.append(F.coalesce(F.sum(value).over(upto), F.lit(0)).alias(f"_s{k}"))
        ranges.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"_rs{k}"))
        across.append(F.coalesce(F.sum(f"_rs{k}").over(before), F.lit(0)).alias(f"_cs{k}"))
        result.append((F.col(f"_s{k}") + F.col(f"_cs{k}")).alias(name))
    for k, (name, value) in enumerate(maxes.items()):
        mine.append(F.max(value).over(earlier).alias(f"_m{k}"))
        ranges.append(F.max(value).alias(f"_rm{k}"))
        across.append(F.max(f"_rm{k}").over(before).alias(f"_cm{k}"))
        result.append(F.greatest(f"_m{k}", f"_cm{k}").alias(name))
    for sign, found, end, near in (("l", lags, F.max_by, Window.partitionBy(*keys).orderBy("_part")), ("f", leads, F.min_by, Window.partitionBy(*keys).orderBy(F.desc("_part")))):
        shift = F.lag if sign == "l" else F.lead
        for k, (name, value) in enumerate(found.items()):  # boxed, so that a null value is not a missing row
            mine.append(shift(F.struct(value.alias("v"))).over(own).alias(f"_{sign}{k}"))
            ranges.append(end(F.struct(value.alias("v")), F.col("_pos")).alias(f"_r{sign}{k}"))
            across.append(F.lag(f"_r{sign}{k}").over(near).alias(f"_c{sign}{k}"))
            result.append(F.coalesce(f"_{sign}{k}", f"_c{sign}{k}")["v"].alias(name))
    columns = [c for c in rows.columns if c not in {*counted, *maxes, *lags, *leads}]
    summary = rows.groupBy("_part", *keys).agg(*ranges).select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_key_{k}") for k in keys], *across)
    on = F.col("_part") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.select(*columns, *mine).join(summary, on, "left").select(*columns, *result)


def with_places(df: DataFrame, keys: list[str], order: list[Column | str], sums: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with _place (from 1) and, for each column of `sums`, _sum_<column> up to and with the row: over the rows of its key, in order.

    Ties take their places in some order."""
    done = carried(ranged(df, keys, order, parts), keys, "_place", {f"_sum_{s}": F.col(s) for s in sums or []})
    return done.withColumn("_place", F.col("_place").cast("long")).drop("_part", "_pos")


def long_keys(df: DataFrame, key: str, most: int) -> DataFrame | None:
    """Keys (not null) of more than `most` rows, as a written table of at most a row for every `most` rows of df; None if there are none."""
    found = materialize(df.groupBy(key).count().filter((F.col("count") > most) & F.col(key).isNotNull()).select(key), "long-keys")
    return None if found.isEmpty() else found
