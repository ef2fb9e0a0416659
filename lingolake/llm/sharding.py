"""Sharding by histogram sort: splitters are refined by exact counts until shards are near equal in bytes, then rows move once.

The order is (hash of the text, doc_id, row number), so equal texts lie together and a group larger than a shard is split by
doc_id and, where that repeats, by row. Each round puts probes between the known bounds of every splitter, counts bytes and
rows between probes in all partitions at once, and narrows the bounds; a splitter is done when the bytes below it are
within `tolerance` of a shard from its target. Hashes that hold more than that are found beforehand by one pre-aggregated
count and serve as probes, so a splitter that falls into such a group goes on at the next level at once. The driver sees
counts at probes only.

Law: `bytes`. A single document larger than the tolerance stays whole, and the nearer boundary is taken. For slots, shards are
cut into ranges of about ROWS_PER_RANGE rows by the same search; a row's slot is its place in its range plus the counts of the
ranges before it.

Defined results: a null text has no bytes and its hash is that of an empty text. A null doc_id comes first; ids that are not
integers are ordered by their hash. Repeated rows are told apart by row number. Empty tables give no rows. Columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

SHARDS = 40
TOLERANCE = 0.005
ROWS_PER_RANGE = 1_000_000
EXTRA = 16
LEVELS = ("h", "d", "r")
LOW, HIGH = -(1 << 63), (1 << 63) - 1

#: A splitter: as many numbers as levels that it needs; rows whose key is below it come before it.
Splitter = tuple[int, ...]


def _order(docs: DataFrame, key: str) -> Column:
    """An id as a number: itself, or its hash where it is not an integer; null comes first."""
    number = F.col(key).cast("long") if isinstance(docs.schema[key].dataType, T.IntegralType) else F.xxhash64(key)
    return F.when(F.col(key).isNull(), LOW).otherwise(number)


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The compact table that is searched: doc_id, size, text_crc32, h, d, r."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + EXTRA).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        _order(docs, key).alias("d"),
        F.monotonically_increasing_id().alias("r"),
    )


def histogram(keys: DataFrame, level: int, groups: dict[Splitter, np.ndarray]) -> dict[Splitter, tuple[np.ndarray, np.ndarray]]:
    """For each group (a prefix of key values) the exact bytes and rows below each of its probes (ascending) at this level."""
    order = list(groups)

    def count(batches):
        total = [np.zeros((len(groups[g]) + 1, 2), np.int64) for g in order]
        for batch in batches:
            values = [batch.column(c).to_numpy() for c in LEVELS[: level + 1]]
            both = np.stack([batch.column("size").to_numpy(), np.ones(batch.num_rows, np.int64)], 1)
            for k, g in enumerate(order):
                mine = np.ones(len(both), bool)
                for x, v in zip(g, values):
                    mine &= v == x
                if mine.any():
                    np.add.at(total[k], np.searchsorted(groups[g], values[level][mine], "right"), both[mine])
        rows = [(k, b, *t) for k, x in enumerate(total) for b, t in enumerate(x.tolist()) if t[1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))], ["k", "bin", "bytes", "rows"])

    part = keys if not level else keys.filter(F.col("h").isin([g[0] for g in order]))
    found = part.select(*LEVELS[: level + 1], "size").mapInArrow(count, "k long, bin long, bytes long, rows long").groupBy("k", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("n")).collect()
    bins = [np.zeros((len(groups[g]) + 1, 2), np.int64) for g in order]
    for row in found:
        bins[row.k][row.bin] = row.bytes, row.n
    return {g: (np.cumsum(b[:, 0])[:-1], np.cumsum(b[:, 1])[:-1]) for g, b in zip(order, bins)}


def _probes(low: int, high: int, n: int) -> list[int]:
    """Up to n places strictly between two bounds, evenly spread."""
    return sorted({low + (high - low) * k // (n + 1) for k in range(1, n + 1)} - {low, high})


def find_splitters(keys: DataFrame, total: int, rows: int, parts: int, allowed: float) -> list[Splitter]:
    """Splitters between `parts` ranges of near equal bytes."""
    many = max(3, min(31, 20_000 // max(1, parts)))
    sums = keys.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
    heavy = {r.h: r for r in sums.filter(F.col("bytes") > max(allowed, total / 1e5)).collect()}  # fewer than 1e5
    found: dict[int, Splitter] = {}
    # target number -> group, bytes before the group, low bound, high bound; a bound is a key value with the bytes and rows of the group below it
    open_ = {i: ((), 0, (LOW, 0, 0), (HIGH + 1, total, rows)) for i in range(1, parts)}
    while open_:
        level = min(len(x[0]) for x in open_.values())
        now = {i: x for i, x in open_.items() if len(x[0]) == level}
        wanted: dict[Splitter, set[int]] = {}
        for g, _, low, high in now.values():
            more = set(_probes(low[0], high[0], many))
            if not level:
                more |= {p for x in heavy for p in (x, x + 1) if low[0] < p < high[0]}
            wanted.setdefault(g, set()).update(p for p in more if LOW < p <= HIGH)
        probes = {g: np.array(sorted(p), np.int64) for g, p in wanted.items() if p}
        below = histogram(keys, level, probes) if probes else {}
        for i, (g, before, low, high) in now.items():
            target = total * i / parts - before
            middle = [x for x in zip(probes[g].tolist(), *(c.tolist() for c in below[g])) if low[0] < x[0] < high[0]] if g in below else []
            places = [low, *middle, high]
            best = min(places, key=lambda x: abs(x[1] - target))
            k = max(j for j, x in enumerate(places[:-1]) if x[1] <= target or j == 0)
            low, high = places[k], places[k + 1]
            if abs(best[1] - target) <= allowed or high[2] - low[2] <= 1 or (high[0] - low[0] <= 1 and level == len(LEVELS) - 1):
                found[i] = (*g, min(best[0], HIGH))
                del open_[i]
            elif high[0] - low[0] <= 1:  # one value holds many rows: go on within it
                first, last = (heavy[low[0]].least, heavy[low[0]].most + 1) if not level and low[0] in heavy else (LOW, HIGH + 1)
                open_[i] = ((*g, low[0]), before + low[1], (first, 0, 0), (last, high[1] - low[1], high[2] - low[2]))
            else:
                open_[i] = (g, before, low, high)
    return sorted(found[i] for i in range(1, parts))


def ranges_of(splitters: list[Splitter], values: list[np.ndarray]) -> np.ndarray:
    """The range of each row: how many splitters are not above its key."""
    first = np.array([s[0] for s in splitters], np.int64)
    plain = np.array([len(s) == 1 for s in splitters], bool)
    out = np.searchsorted(first[plain], values[0], "right")
    for s in (s for s in splitters if len(s) > 1):
        above = values[0] > s[0]
        tie = values[0] == s[0]
        for k in range(1, len(s)):
            above |= tie & (values[k] > s[k])
            tie &= values[k] == s[k]
        out = out + (above | tie)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, text: str = "text", key: str = "doc_id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; only these compact rows are exchanged."""
    keys = materialize(keyed(docs, text, key), "shard-keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cut = max(1, -(-n // (shards * rows_per_range)))
    splitters = find_splitters(keys, total, n, shards * cut, tolerance * total / (shards * cut)) if n else []

    def place(batches):
        for batch in batches:
            found = ranges_of(splitters, [batch.column(c).to_numpy() for c in LEVELS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "range"])

    fields = ", ".join(f"{c} {t}" for c, t in keys.dtypes)
    placed = materialize(keys.mapInArrow(place, f"{fields}, range int"), "shard-places")
    counts = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}
    starts, at = [], 0
    for k in range(shards * cut):
        at = 0 if k % cut == 0 else at
        starts.append(at)
        at += counts.get(k, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("range")) if cut > 1 else F.lit(0).cast("long")
    order = Window.partitionBy("range").orderBy("h", "d", "r")
    return placed.select("doc_id", "size", "text_crc32", F.floor(F.col("range") / cut).cast("int").alias("shard"), (start + F.row_number().over(order) - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, text: str = "text", key: str = "doc_id", rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Write whole rows as shard=N folders: one exchange of the rows, after the search on the compact table.

    A shard is as many ranges as it has `rows_per_range` rows. Each range is sorted and is one file, and files come in the order of their
    names within a shard, so a task holds a range and never a shard. Rows that repeat an id and its text are told apart by their place in this
    reading. An empty table writes no shard; a column called shard is replaced."""
    keys = materialize(keyed(docs, text, key), "shard-keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cut = max(1, -(-n // (shards * rows_per_range)))
    splitters = find_splitters(keys, total, n, shards * cut, tolerance * total / (shards * cut)) if n else []

    @F.pandas_udf("int")
    def range_of(h, d, r):
        import pandas as pd

        return pd.Series(ranges_of(splitters, [h.to_numpy(), d.to_numpy(), r.to_numpy()]))

    names = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h"), _order(docs, key).alias("__d"), F.monotonically_increasing_id().alias("__r")]
    placed = docs.drop("shard").select("*", *names).withColumn("__range", range_of("__h", "__d", "__r")).withColumn("shard", F.floor(F.col("__range") / cut).cast("int"))
    # the number of a partition is that of its range, so no two ranges share a task and a shard's files are in order
    dealt = placed.repartitionById(shards * cut, F.col("__range")).sortWithinPartitions("shard", "__h", "__d", "__r")
    dealt.drop("__h", "__d", "__r", "__range").write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
