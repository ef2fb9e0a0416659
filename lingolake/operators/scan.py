"""Ordered folds: rows of a key pass once, in order, through a small state.

Rows are exchanged once by key, sorted within partitions and streamed, so a fold holds one batch and its state, never a whole
group, whatever the length of a job. Where a fold can prove that it begins anew at some rows, long jobs are cut there (scan_islands).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .ranks import LONG, carried, long_keys, ranged, with_places

#: A fold takes the rows of one key, in order, as tuples of the input's columns, and yields rows of the result.
Fold = Callable[[Iterator[tuple]], Iterator[tuple]]


def scan_ordered(df: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str) -> DataFrame:
    """`fold` over the rows of each key (non-null columns `keys`) in ascending `order`."""
    target = to_arrow_schema(T._parse_datatype_string(schema))
    places = [df.columns.index(k) for k in keys]

    def run(batches):
        out: list[tuple] = []

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        source = rows()
        ahead = next(source, None)

        def group(key):
            nonlocal ahead
            while ahead is not None and tuple(ahead[p] for p in places) == key:
                row, ahead = ahead, None
                yield row
                ahead = next(source, None)

        while ahead is not None:
            mine = group(tuple(ahead[p] for p in places))
            for row in fold(mine):
                out.append(row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                    out.clear()
            for _ in mine:  # what the fold has left
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def scan_islands(df: DataFrame, order: list[str], fold: Fold, schema: str, breaks: Callable[[Column], Column], reach: Column, number: str, first: int, most: int = LONG) -> DataFrame:
    """`fold` over the rows of each job_id in ascending `order`; a job of more than `most` rows is folded in many tasks.

    breaks: true for a row at which the fold begins anew whatever came before, given the largest `reach` of all rows before it. Such a job
    is cut there into islands, folded each on its own; `number` counts the fold's results from `first`, and goes on from island to island.
    """
    long = long_keys(df, "job_id", most)
    if long is None:
        return scan_ordered(df, ["job_id"], order, fold, schema)
    rows = carried(ranged(df.join(long, "job_id", "left_semi"), ["job_id"], order), ["job_id"], maxes={"_reach": reach})
    rows = carried(rows, ["job_id"], sums={"_island": F.coalesce(breaks(F.col("_reach")), F.lit(True)).cast("long")})

    def stripped(group):
        island = None

        def plain():
            nonlocal island
            for *row, island in group:
                yield tuple(row)

        for row in fold(plain()):
            yield (*row, island)

    cut = scan_ordered(rows.select(*df.columns, "_island"), ["job_id", "_island"], order, stripped, f"{schema}, _island long")
    kind = cut.schema[number].dataType
    placed = with_places(cut, ["job_id"], ["_island", number]).withColumn(number, (F.col("_place") + (first - 1)).cast(kind))
    others = scan_ordered(df.join(long, "job_id", "left_anti"), ["job_id"], order, fold, schema)
    return others.unionByName(placed.select(*others.columns))


def with_running(df: DataFrame, key: str, order: list[str], reads: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple]) -> DataFrame:
    """df with the columns of `schema`, which `step` makes of a state and the columns `reads`, row by row of each key in order.

    df must be partitioned by key (it is not exchanged here). Other columns pass as they are; what is held is one state."""
    fields = T._parse_datatype_string(schema).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        last, state = object(), None
        for batch in batches:
            made = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *reads))):
                if k != last:
                    last, state = k, start()
                made.append(step(state, tuple(row)))
            columns = zip(*made) if made else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds))], [*batch.schema.names, *(f.name for f in fields)])

    return df.sortWithinPartitions(key, *order).mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
