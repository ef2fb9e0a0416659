"""Importance resampling towards a target: documents are drawn by how much likelier their word runs are in the target than here.

One Aho-Corasick automaton holds the frequent words between delimiters; each carries its CRC-32 and length as payload. Texts are
lower-cased (A-Z), other characters become delimiters, and a scan emits the payload of every word. Payloads of neighbours compose:
the CRC of "a b" follows from those of a and b and b's length, so runs of words are hashed without being built. Their buckets
are counted in documents and target, and the same scan adds up the gains of a document's buckets.

The dictionary holds the words that make one in RARE of all words of documents or more, so RARE words at most, of LONGEST bytes at
most each. It only saves time: a word that it lacks gets the same payload from its own bytes. Counts are over all rows; each task
adds up its buckets before the exchange. Drawing is by Gumbel keys, so the highest scores are a sample without replacement;
ranks come from ranges of rows (operators/ranks.py), never from one task.

Defined results: a null text has no words. A null doc_id hashes as an empty text and comes first among ties; rows that share score and
doc_id take their ranks in some order. Repeated rows are scored and ranked one by one, very long texts whole. An empty target
counts as zeros. Empty tables give no rows. Columns of the input but doc_id and text are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import with_places
from . import sql
from .shared import LOWER, give_back, materialize, steps, table, utf8, words

BUCKETS = 10_000
RARE, LONGEST = 100_000, 48
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_IS_WORD = np.array([c >= 0x80 or 48 <= LOWER[c] <= 57 or 97 <= LOWER[c] <= 122 for c in range(256)])
_PLAIN = np.where(_IS_WORD, LOWER, 32).astype(np.uint8)
_SPACE = zlib.crc32(b" ")


@functools.lru_cache(64)
def _after_zeros(k: int) -> np.ndarray:
    """Tables, by byte, of what 2**k zero bytes make of a CRC-32's state; linear, so bytes are looked up apart."""
    if k:
        half = _after_zeros(k - 1)
        return _apply(half, half)
    bits = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return bits


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def compose(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together: of the first ones, of the second ones, and the bytes of the second ones."""
    out = first.astype(np.uint32)
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        some = np.flatnonzero((length >> k) & 1)
        out[some] = _apply(_after_zeros(k), out[some])
    return out ^ second.astype(np.uint32)


class Dictionary:
    """Words between delimiters as an automaton, with the CRC-32 and length of each."""

    def __init__(self, entries: list[str]) -> None:
        raw = [w.encode() for w in entries]
        self.crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(raw):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def payloads(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC-32, bytes and row of every word, in order. Texts are joined by delimiters and scanned at once, a character a byte."""
        starts, ends, row = words(raw, offsets, _IS_WORD_RAW)
        crc = np.zeros(len(starts), np.uint32)
        if not len(starts):
            return crc, ends - starts, row
        plain = np.full(len(raw) + len(offsets), 32, np.uint8)
        plain[np.arange(len(raw)) + 1 + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = _PLAIN[raw]
        known = np.zeros(len(starts), bool)
        if len(self.crc):
            found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(plain.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends + row + 1, found[:, 0])  # a match ends with the delimiter after its word
            crc[at], known[at] = self.crc[found[:, 1]], True
        text = plain.tobytes()
        rest = np.flatnonzero(~known)
        low, high = starts + row + 1, ends + row + 1
        crc[rest] = [zlib.crc32(text[a:b]) for a, b in zip(low[rest].tolist(), high[rest].tolist())]
        return crc, ends - starts, row


#: Bytes of words before lower-casing: A-Z are letters too.
_IS_WORD_RAW = _IS_WORD[LOWER]


def features(crc: np.ndarray, length: np.ndarray, row: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and row of all runs of 1 to `most` neighbouring words of a row, joined by one space."""
    found, where, now = [crc], [row], crc
    for n in range(2, most + 1):
        if len(crc) < n:
            break
        spaced = compose(np.full(len(crc) - n + 1, _SPACE, np.uint32), crc[n - 1 :], length[n - 1 :])
        now = compose(now[:-1], spaced, length[n - 1 :] + 1)
        inside = row[n - 1 :] == row[: len(row) - n + 1]
        found.append(now[inside])
        where.append(row[n - 1 :][inside])
    return np.concatenate(found), np.concatenate(where)


@functools.lru_cache(2)
def _built(entries: tuple[str, ...]) -> Dictionary:
    return Dictionary(list(entries))


def _body(docs: DataFrame, text: str):
    return docs.select(F.col(text).alias("__body"))


def frequent_words(docs: DataFrame, text: str = "text", rare: int = RARE, longest: int = LONGEST) -> list[str]:
    """Words that make one in `rare` of all words or more, so `rare` at most; longer ones than `longest` bytes are left out."""
    low = F.when(F.octet_length("w") == F.length("w"), F.lower("w")).otherwise(F.translate("w", sql.UPPER, sql.LOWER))
    each = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).alias("w"))
    counts = materialize(each.groupBy(low.alias("w")).agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.filter((F.col("n") * rare >= total) & (F.octet_length("w") <= longest)).select("w").collect()
    return sorted(r.w for r in found)


def bucket_counts(docs: DataFrame, entries: tuple[str, ...], text: str = "text", most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all rows fall in each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(entries)

    def count(batches):
        dictionary, total = _built(shared.value), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in steps(whole, "__body"):
                crc, _ = features(*dictionary.payloads(*utf8(batch.column("__body"))), most)
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])
        give_back()

    found = _body(docs, text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's share in the target over that here, both smoothed by one, rounded down."""
    n, s, t = float(len(here)), float(here.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)))) for x, y in zip(here.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", most: int = 1, buckets: int = BUCKETS, target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's runs of 1 to `most` words."""
    entries = tuple(frequent_words(docs, text))
    gain = gains(bucket_counts(docs, entries, text, most, buckets), bucket_counts(target, entries, target_text, most, buckets))
    shared = docs.sparkSession.sparkContext.broadcast((entries, gain))

    def score(batches):
        held, gain = shared.value
        dictionary = _built(held)
        for whole in batches:
            for batch in steps(whole, "__body"):
                crc, length, row = dictionary.payloads(*utf8(batch.column("__body")))
                n = np.bincount(row, minlength=batch.num_rows)
                crc, where = features(crc, length, row, most)
                weight = np.zeros(batch.num_rows, np.int64)
                np.add.at(weight, where, gain[crc % np.uint32(buckets)])
                columns = [pa.array(n, pa.int64()), pa.array(np.bincount(where, minlength=batch.num_rows), pa.int64()), pa.array(weight, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])
        give_back()

    fields = [T.StructField("doc_id", docs.schema[key].dataType), *T.StructType.fromDDL("n_words long, n_features long, weight long").fields]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__body")).mapInArrow(score, T.StructType(fields))


def gumbel(key, seed: int):
    """A thousandfold Gumbel number, rounded down, from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least: int = 20, text: str = "text", key: str = "doc_id", most: int = 1, buckets: int = BUCKETS, target_text: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: of the documents with `least` words or more, `percent` in a hundred
    with the highest scores are drawn and ranked from 1, ties to the smaller doc_id; rank is null for others."""
    scored = weigh(docs, target, text, key, most, buckets, target_text)
    scored = materialize(scored.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least).alias("fit")), "scores")
    drawn = percent * scored.filter("fit").count() // 100
    placed = with_places(scored, ["fit"], [F.desc("score"), F.asc("doc_id")])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("_place") <= drawn), F.col("_place")).alias("rank"))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all({sql.ascii_lower('text')}, '{WORD}')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
du AS (SELECT doc_id, unnest(w) AS w FROM d),
dc AS (SELECT w, count(*) AS n FROM du GROUP BY w),
tc AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
kinds AS (SELECT w, {sql.crc32('w')} % {BUCKETS} AS bucket FROM (SELECT w FROM dc UNION SELECT w FROM tc)),
sums AS (SELECT bucket, sum(coalesce(dc.n, 0)) AS s, sum(coalesce(tc.n, 0)) AS t FROM kinds LEFT JOIN dc USING (w) LEFT JOIN tc USING (w) GROUP BY bucket),
every AS (SELECT sum(s) AS s, sum(t) AS t FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(sums.t AS DOUBLE) + 1) * (CAST(every.s AS DOUBLE) + {BUCKETS}) / ((CAST(sums.s AS DOUBLE) + 1) * (CAST(every.t AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS g FROM sums, every),
weights AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM du JOIN kinds USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
