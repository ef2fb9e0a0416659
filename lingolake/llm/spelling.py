"""Spelling variants: words that differ by one code point from a far more frequent word, found by a bit-sliced position index.

The vocabulary is cut into groups in which any two near words must meet: with the shorter one's length L and h = L // 2, words one
edit apart share their first h or their last L - h code points. A word is thus a row of a few groups; those of more than BLOCK
rows are cut into blocks by the word's hash, and every pair of blocks is a task's work of its own, so no group is ever held whole.

Within a stretch of groups the words are the index: for each (position, letter) a bitset of the words that have it there. A query
word walks its letters once; 64 words of the index at a time, four sets are carried: those that agree so far, and those one replaced,
one missing and one added letter away, which read the bitset at, before and after the position. A query yields its number of near words and the best
of them, not the pairs; pairs that meet in both halves count in the first only.

Forms lead to words at least `factor` times as frequent, so chains are short: their ends are found by doubling links.

Defined results: null and empty texts have no words; a null doc_id hashes as an empty text. Repeated rows count each. A run of any
length is one word. Ties between near words go to the smaller one in code-point order. Empty tables give no rows. Columns of the input
but doc_id and text are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sql
from .shared import give_back, materialize, table

RUN = r"[A-Za-zÀ-ÿ]+"
#: A group's rows (and code points) at most before it is cut, and rows and code points that small groups share an index up to.
BLOCK, BLOCK_CHARS, CHUNK = 4_096, 1 << 20, 1_024


def planted(doc_id: Column, run: Column, every: int = 199) -> Column:
    """A run without one code point, where the CRC-32 of "doc_id:run" is a multiple of `every`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Distinct words (word, n) of `shortest` code points and `least` occurrences or more."""
    runs = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= shortest)
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", sql.UPPER, sql.LOWER))
    found = runs.select("id", low.alias("run")).select(planted(F.col("id"), F.col("run")).alias("word"))
    return found.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def grouped(vocab: DataFrame, shortest: int, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (base, half, head, cell, side, group, word, n): a word once for each group and pair of blocks that it belongs to.

    base: the shorter word's length in the group's pairs; half: 0 for the first, 1 for the last code points; head: hash of the first ones;
    cell: whether the pair is a block with itself; side: the word's block in it."""
    n = F.length("word")
    lengths = F.filter(F.array(n, n - 1), lambda x: x >= shortest)
    rows = vocab.select("word", "n", F.explode(lengths).alias("base")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    h = F.floor(F.col("base") / 2).cast("int")
    part = F.when(F.col("half") == 0, F.left("word", h)).otherwise(F.right("word", F.col("base") - h))
    rows = rows.select("*", F.xxhash64("base", "half", part).alias("key"), F.xxhash64(F.left("word", h)).alias("head"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("chars"))
    blocks = F.ceil(F.greatest(F.col("rows") / block, F.col("chars") / chars)).cast("int")
    large = materialize(sizes.select("key", blocks.alias("blocks")).filter("blocks > 1"), "large-groups")
    rows = rows.join(large, "key", "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"), F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.struct(F.least(x, "side").alias("a"), F.greatest(x, "side").alias("b")))
    rows = rows.withColumn("pair", F.explode(pairs))
    return rows.select("base", "half", "head", (F.col("pair.a") == F.col("pair.b")).alias("cell"), "side", F.xxhash64("key", "pair.a", "pair.b").alias("group"), "word", "n")


class Index:
    """Bitsets over words, one for each position and letter, made as positions are reached."""

    def __init__(self, words: list[str]) -> None:
        self.length = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, codes = np.unique(flat, return_inverse=True)
        self.letters, self.wide = len(letters), -(-len(words) // 64)
        self.codes = np.full((len(words), int(self.length.max(initial=0)) + 2), self.letters, np.int32)  # the last one stands for none
        at = np.repeat(np.arange(len(words)), self.length)
        self.codes[at, np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)] = codes

    def bits(self, rows: np.ndarray) -> np.ndarray:
        """Rows of booleans as rows of 64-bit words."""
        packed = np.zeros((len(rows), self.wide * 8), np.uint8)
        packed[:, : -(-rows.shape[1] // 8)] = np.packbits(rows, axis=1, bitorder="little")
        return packed.view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """The bitset of each letter at a position (none for a place before the first)."""
        has = np.zeros((self.letters + 1, len(self.codes)), bool)
        if position >= 0:
            has[self.codes[:, position], np.arange(len(self.codes))] = True
        has[self.letters] = False
        return self.bits(has)

    def longer(self, n: int) -> np.ndarray:
        """The bitset of words of n letters or more."""
        return self.bits((self.length >= n)[None, :])[0]

    def exactly(self, n: int) -> np.ndarray:
        return self.bits((self.length == n)[None, :])[0]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """All (query, word) one edit apart, as places; each pair both ways."""
        order = np.argsort(self.length, kind="stable")
        codes, length = self.codes[order], self.length[order]
        agree = np.repeat(self.longer(0)[None, :], len(order), 0)
        replaced, missing = np.zeros_like(agree), np.zeros_like(agree)
        added = agree & self.longer(1)
        before, here, after = self.at(-1), self.at(0), self.at(1)
        first, found = 0, []
        for i in range(int(length[-1]) if len(length) else 0):
            done = int(np.searchsorted(length, i, "right")) - first  # queries that have ended
            if done:
                agree, replaced, missing, added = agree[done:], replaced[done:], missing[done:], added[done:]
                first += done
            letter = codes[first:, i]
            same = here[letter]
            replaced = (replaced & same) | (agree & ~same & self.longer(i + 1))
            missing = (missing & before[letter]) | agree
            agree = agree & same
            added = (added & after[letter]) | (agree & self.longer(i + 2))
            ends = int(np.searchsorted(length, i + 1, "right")) - first
            if ends:
                hit = (replaced[:ends] & self.exactly(i + 1)) | (missing[:ends] & self.exactly(i)) | (added[:ends] & self.exactly(i + 2))
                row, word = np.nonzero(hit)
                place, bit = np.nonzero(np.unpackbits(hit[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                found.append((order[first + row[place]], word[place] * 64 + bit))
            before, here, after = here, after, self.at(min(i + 2, self.codes.shape[1] - 1))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))


_NAMES = ["word", "n_near", "near_n", "near"]


def _nearest(chunk: pa.Table) -> pa.RecordBatch:
    """For each word of a stretch of whole groups that has near words there: how many, and the most frequent."""
    words = chunk.column("word").to_pylist()
    base, half, head, cell, side, group, n = (chunk.column(c).to_numpy() for c in ("base", "half", "head", "cell", "side", "group", "n"))
    index = Index(words)
    q, v = index.near()
    keep = (group[q] == group[v]) & (np.minimum(index.length[q], index.length[v]) == base[q]) & (cell[q] | (side[q] != side[v])) & ((half[q] == 0) | (head[q] != head[v]))
    q, v = q[keep], v[keep]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[v], -n[v], q))
    q, v = q[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    pick = lambda at: pa.array([words[k] for k in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([pick(q[first]), pa.array(np.diff(np.append(first, len(q))), pa.int64()), pa.array(n[v[first]], pa.int64()), pick(v[first])], _NAMES)


def _scan(batches, rows: int = CHUNK, area: int = BLOCK_CHARS):
    """Rows that lie together by group, a stretch of whole groups at a time: `rows` at most, and as many as make `area` with the width
    of the longest word, or one group. A group of one row has no pairs."""

    def stretches(whole: pa.Table, last: bool):
        group, base = whole.column("group").to_numpy(), whole.column("base").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        if not last:
            cuts = cuts[:-1]  # the last group may go on, and waits
        more = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
        kept = whole.slice(0, len(more)).filter(pa.array(more))
        ends = np.cumsum(np.diff(cuts)[np.diff(cuts) > 1])
        start = 0
        for a, b, wide in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), (base[cuts[1:] - 1] + 1)[np.diff(cuts) > 1].tolist()):
            if a > start and (b - start > rows or (b - start) * wide > area):
                yield _nearest(kept.slice(start, a - start))
                start = a
        if len(ends):
            yield _nearest(kept.slice(start))
        return whole.slice(len(more))

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= 4 * rows:
            rest = yield from stretches(pa.Table.from_batches(waiting), False)
            waiting = rest.combine_chunks().to_batches() if rest.num_rows else []
    if waiting:
        yield from stretches(pa.Table.from_batches(waiting), True)
    give_back()


def nearest(vocab: DataFrame, shortest: int = 6, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """Words that have near ones (word, n_near, near_n, near): how many, and the one of largest n, ties to the smaller."""
    rows = grouped(vocab, shortest, block, chars)
    parts = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "group").sortWithinPartitions("base", "group").mapInArrow(functools.partial(_scan, area=chars), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def variants(vocab: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """word, form, root, n, n_near and form_n of a written table (word, n) of distinct words with n of `least` or more.

    The form is the near word of largest n, if that is `factor` (2 or more) times the word's own or more; the root is where forms lead."""
    formed = F.col("near_n") >= factor * F.col("n")
    named = vocab.join(nearest(vocab, shortest, block, chars), "word", "left")
    named = materialize(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    most = named.agg(F.max("form_n")).first()[0] or 0
    steps = 0  # of the longest chain: each multiplies n by `factor` at least
    while least * factor ** (steps + 1) <= most:
        steps += 1
    links = named.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return named.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(materialize(vocabulary(table(spark, sf_dir, "documents")), "vocabulary"))


_HASH = sql.crc32("doc_id || ':' || run")

#: Near words share what one deletion at most leaves of them; words of equal length that share a deletion may also differ by two letters
#: (a move), so their places are compared.
OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({sql.ascii_lower('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_HASH} AS h FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, run, n FROM runs)),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, unnest(list_prepend({{'i': 0, 'd': word}}, list_transform(range(1, length(word) + 1), lambda i: {{'i': i, 'd': substr(word, 1, i - 1) || substr(word, i + 1)}}))) AS c FROM vocab),
cuts AS (SELECT DISTINCT word, n, c.d AS d FROM cut),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.d = b.d AND a.word <> b.word
  WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near WHERE abs(length(word) - length(near)) <= 1 GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best USING (word)),
roots AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT r.word, f.form, k + 1 FROM roots r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, k) AS root FROM roots GROUP BY word) USING (word)"""
