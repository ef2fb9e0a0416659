"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all benchmark items.

Texts are scanned once. A-Z become lower case and words are runs of digits, letters a-z and non-ASCII bytes; words are known by
64-bit hashes and numbered by the benchmark's vocabulary, and word positions are mapped back to code points of the original.

The automaton's states are the prefixes of windows, in arrays: an edge for each state, a failure link to the longest suffix that
is a prefix too, and a link to the longest window that ends there. It is built once, level by level, and broadcast once, whatever
the benchmark: 13 states of 20 bytes for a word of it at most, which MAX_WORDS bounds. Tasks run it over many texts in step: texts are cut into
lanes of LANE words, each led in by the words before it that a window can reach back to, so that lanes meet all windows and
long texts cost no more than short ones.

Defined results: a null or empty text has no words and no hits. A null or wordless item has no window; an item without an id hits
and is not named. Items that share a window are all named. Repeated rows are judged one by one, very long texts whole. Columns of the
input that bear the name of a result column are replaced. An empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, steps, utf8, word_hashes, words

WINDOW = 13
#: Words of a benchmark at most; its automaton then has 260 MB for each million.
MAX_WORDS = 8_000_000
#: Words that a lane adds to what leads it in, and text bytes that a task scans at once.
LANE, SCAN_BYTES = 500, 2 << 20

_IS_WORD = np.array([c >= 0x80 or 48 <= LOWER[c] <= 57 or 97 <= LOWER[c] <= 122 for c in range(256)])
_SPAN = "array<struct<start:int,end:int>>"
_NAMELESS = 0xFFFFFFFF


class Automaton:
    """Windows of items (lists of word hashes) as arrays; state 0 is the root, -1 stands for none."""

    def __init__(self, items: list[np.ndarray], size: int = WINDOW) -> None:
        self.size = size
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
        starts, item, lengths, flat, base = [], [], [], [], 0
        for k, x in enumerate(items):
            n = max(1, len(x) - size + 1) if len(x) else 0
            starts.append(base + np.arange(n))
            item.append(np.full(n, k))
            lengths.append(np.full(n, min(size, len(x))))
            flat.append(np.searchsorted(self.vocabulary, x))
            base += len(x)
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        starts, item, lengths, flat = map(join, (starts, item, lengths, flat))
        here = np.zeros(len(starts), np.int64)  # the state of each window's prefix
        edges, self.depth, fail, first = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        terminal = {}
        for d in range(size):
            longer = lengths > d
            key = (here[longer] << 32) | flat[starts[longer] + d]
            kinds, which = np.unique(key, return_inverse=True)
            here[longer] = first + which
            edges.append(kinds)
            self.depth.append(np.full(len(kinds), d + 1))
            first += len(kinds)
            terminal[d] = here[longer & (lengths == d + 1)]
        self.edges = join(edges)  # ascending: states of a level come after those of the one before, and an edge leads to its place + 1
        self.depth = np.concatenate(self.depth)
        self.fail = np.zeros(len(self.depth), np.int64)
        self.root = np.full(len(self.vocabulary) + 1, 0, np.int64)
        if size and len(edges) and len(edges[0]):
            self.root[edges[0] & 0xFFFFFFFF] = 1 + np.arange(len(edges[0]))
        at = len(edges[0]) if edges else 0
        for level in edges[1:]:
            self.fail[1 + at : 1 + at + len(level)] = self.step(self.fail[level >> 32], level & 0xFFFFFFFF)
            at += len(level)
        ends = np.zeros(len(self.depth), bool)
        ends[join(terminal.values())] = True
        self.longest = np.where(ends, np.arange(len(self.depth)), -1)  # the longest window that ends in a state
        self.shorter = np.full(len(self.depth), -1)
        for d in range(1, size + 1):
            level = np.flatnonzero(self.depth == d)
            below = self.longest[self.fail[level]]
            self.shorter[level] = below
            self.longest[level] = np.where(ends[level], level, below)
        order = np.unique((here << 32) | item)  # items of each window
        self.owner, self.items = order >> 32, order & 0xFFFFFFFF
        for name in ("depth", "fail", "longest", "shorter", "root"):
            setattr(self, name, getattr(self, name).astype(np.int32))

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where states go on a word each: along its edge, or that of the first failure link that has one."""
        out, open_ = self.root[word].astype(np.int64), np.flatnonzero(state)
        state = state.astype(np.int64)
        while len(open_):
            key = (state[open_] << 32) | word[open_]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[at] == key
            out[open_[found]] = at[found] + 1
            open_ = open_[~found]
            state[open_] = self.fail[state[open_]]
            open_ = open_[state[open_] > 0]
        return out

    def scan(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End (place of the last word) and state of every window in texts: numbers of their words, -1 for others, and the place of
        each text's first word (with the end)."""
        sizes = np.diff(first)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        end = np.minimum(begin + LANE, first[text + 1])
        begin = np.maximum(begin - (self.size - 1), first[text])
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still open are a head
        begin, width = begin[order], (end - begin)[order]
        state, ends, states = np.zeros(len(begin), np.int64), [], []
        still = np.searchsorted(-width, -np.arange(width[0] if len(width) else 0))  # lanes wider than each step
        for t, n in enumerate(still.tolist()):
            w = word[begin[:n] + t]
            now = np.zeros(n, np.int64)
            known = np.flatnonzero(w >= 0)
            now[known] = self.step(state[known], w[known])
            state = now
            hit = np.flatnonzero(self.longest[now] >= 0)
            if len(hit):
                ends.append(begin[hit] + t)
                states.append(self.longest[now[hit]])
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ends), np.concatenate(states).astype(np.int64)

    def named(self, states: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Distinct text << 32 | item of windows found, with those that end there inside them."""
        found = np.unique((texts << 32) | states)
        pairs = []
        while len(found):
            text, state = found >> 32, found & 0xFFFFFFFF
            low, high = np.searchsorted(self.owner, state), np.searchsorted(self.owner, state, "right")
            n = high - low
            place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append((np.repeat(text, n) << 32) | self.items[place])
            below = self.shorter[state]
            found = np.unique((text[below >= 0] << 32) | below[below >= 0])
        return np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


def automaton(items: list[str], size: int = WINDOW) -> Automaton:
    raw, offsets = utf8(pa.array(items, pa.string()))
    starts, ends, row = words(raw, offsets, _IS_WORD)
    hashes = word_hashes(raw, starts, ends)
    return Automaton(np.split(hashes, np.cumsum(np.bincount(row, minlength=len(items)))[:-1]) if items else [], size)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, ranges: bool = True) -> DataFrame:
    """Columns `keep` of docs (all by default) and n_words, hits (ranges of words), items, spans (code points), n_hit, contaminated. Without
    `ranges`, hits and spans are empty."""
    own = ["n_words", "hits", "items", "spans", "n_hit", "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    bodies = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("body")).filter(F.length("body") > 0)
    size = bodies.agg(F.coalesce(F.sum(F.size(F.split("body", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    if size > MAX_WORDS:
        raise ValueError(f"the benchmark has {size} words, more than {MAX_WORDS}: give its parts to separate calls and unite their hits")
    rows = sorted(((r.item, r.body) for r in bodies.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))  # MAX_WORDS words at most
    shared = docs.sparkSession.sparkContext.broadcast((automaton([r[1] for r in rows], window), [r[0] for r in rows]))
    fields = [*docs.select(*keep).schema.fields, *T.StructType.fromDDL(f"n_words long, hits {_SPAN}, items array<string>, spans {_SPAN}, n_hit long, contaminated boolean").fields]
    return docs.select(*keep, F.col(text).alias("__body")).mapInArrow(_scanner(shared, keep, own, ranges), T.StructType(fields))


def _scanner(shared, keep: list[str], own: list[str], ranges: bool):
    def run(batches):
        machine, names = shared.value
        known = _known(names)
        for whole in batches:
            for batch in steps(whole, "__body", SCAN_BYTES):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *_judged(batch, machine, names, ranges, known)], [*keep, *own])

    return run


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of n rows, of the values whose rows (ascending) are given."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _known(names: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """Distinct names of items in order, and the place of each item's name among them, or _NAMELESS."""
    found = sorted({x for x in names if x is not None})
    place = {x: k for k, x in enumerate(found)}
    return pa.array(found, pa.string()), np.array([_NAMELESS if x is None else place[x] for x in names], np.int64)


def _judged(batch: pa.RecordBatch, machine: Automaton, names: list[str | None], ranges: bool = True, known: tuple[pa.Array, np.ndarray] | None = None) -> list[pa.Array]:
    n = batch.num_rows
    named, same = known or _known(names)
    raw, offsets = utf8(batch.column("__body"))
    starts, ends, row = words(raw, offsets, _IS_WORD)
    counts = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    hit, none = np.zeros(n, np.int64), np.zeros(0, np.int64)
    pairs, a, b = none, none, none
    if len(starts) and len(machine.edges):
        hashes = word_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(machine.vocabulary, hashes), len(machine.vocabulary) - 1)
        last, state = machine.scan(np.where(machine.vocabulary[at] == hashes, at, -1), first)
        if len(last):
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, last + 1 - machine.depth[state], 1)
            np.add.at(change, last + 1, -1)
            covered = np.cumsum(change)[:-1] > 0
            hit = np.bincount(row[covered], minlength=n)
            pairs = machine.named(state, row[last])
            pairs = np.unique((pairs & ~np.int64(0xFFFFFFFF)) | same[pairs & 0xFFFFFFFF])
            pairs = pairs[(pairs & 0xFFFFFFFF) != _NAMELESS]
            if ranges:  # they end with a text, and where the next word is not hit
                before = np.concatenate([[False], covered[:-1] & (row[1:] == row[:-1])])
                after = np.concatenate([covered[1:] & (row[1:] == row[:-1]), [False]])
                a, b = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
    items = _lists(pairs >> 32, n, named.take(pa.array(pairs & 0xFFFFFFFF)))
    zero = first[row[a]]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if len(a) else none
    base = chars[offsets[row[a]]] if len(a) else none
    struct = lambda low, high: _lists(row[a], n, pa.StructArray.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["start", "end"]))
    hits, spans = (struct(a - zero, b + 1 - zero), struct(chars[starts[a]] - base, chars[ends[b]] - base)) if len(a) else (struct(a, b), struct(a, b))
    contaminated = (hit > 0) & (20 * hit >= counts)
    return [pa.array(counts, pa.int64()), hits, items, spans, pa.array(hit, pa.int64()), pa.array(contaminated)]


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"], ranges=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of which a twentieth or more lies in benchmark windows go; all others stay as they are, nulls and
    empty texts too, and very long texts are judged whole. All columns of docs come out as they went in, whatever their names; repeated
    rows stay or go together. An empty table stays empty; an empty benchmark drops nothing."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return find_contamination(whole, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__row"], ranges=False).filter(~F.col("contaminated")).select("__row.*")


OP1_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, t.item FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.win = t.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
