"""Helpers of the corpus operators: shared storage, and words as byte spans of Arrow text columns."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import materialize  # noqa: F401  the operators take it from here

#: Text bytes that one numpy step handles; a longer document is a step of its own.
STEP_BYTES = 2 << 20

#: Words are runs of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def where(df: DataFrame, condition: Column) -> DataFrame:
    """df.filter that stays where it is. A filter would be pushed below the projections that its columns come from and repeat
    them, array by array, inside each other's lambdas; one that also reads a nondeterministic column is not."""
    marked = df.withColumn("__row_mark", F.monotonically_increasing_id())
    return marked.filter(condition & (F.col("__row_mark") >= 0)).drop("__row_mark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_part(doc_id, rest: int):
    """True for rows whose crc32 of the id as text is not `rest` modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 != rest


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column end to end, and where each row starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most `limit` bytes together, or one row."""
    _, offsets = utf8(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, min(last, batch.num_rows) - first)
        first = last


def give_back() -> None:
    """Return freed memory to the machine, since Spark keeps workers for the next task."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


IS_WORD = np.ones(256, bool)
IS_WORD[list(WHITE)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: each bit of the result depends on each bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, b, np.uint64)])) for b in (BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n or more of each."""
    return _powers(max(int(n - 1).bit_length(), (STEP_BYTES - 1).bit_length()))


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every word, a run of bytes of which is_word is true."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a row starts here
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case: differences of one running polynomial sum, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LOWER[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
