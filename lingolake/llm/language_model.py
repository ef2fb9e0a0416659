"""Language-model scores by a weighted backoff automaton over words.

States are the empty context and each word as a context, the start of a text among them. Each bigram of the training documents is
an arc of a state, weighted with the logarithm of its smoothed probability; any other word takes the failure arc to the empty
context, whose weight is the backoff, and then the arc of the word there, its smoothed unigram:

    p(w)     = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    p(w | v) = (c(v, w) + m(v) * p(w)) / (c(v) + m(v)) for seen bigrams, else backoff(v) * p(w)
    backoff(v) = m(v) / (c(v) + m(v)),  m(v) = SCALE * c(v) ** POWER;  1 for a word never seen as a context

so p(. | v) sums to one over the V known words and one unknown word. Counts are exact and cover all training documents: no word and
no bigram is left out, however rare and at any size.

A text is traversed once from left to right with the part of the automaton that is broadcast: words of relative frequency HEAD or
more (1 / HEAD at most, since counts sum to N), and of their bigrams those that occur HOT times or more in a bounded sample (at most
HOT_PAIRS), counted exactly over all documents. What is chosen there decides where an arc is met, never its weight. All other arcs
meet the texts in one exchange: the traversal hands on the bigrams whose arcs it lacks, those of all documents are dealt by
their key, counted over the training documents, weighed, and summed by document. Their keys are rare, so none is hot, and they
stay in arrays, one for each step, kind and bucket of keys, up to the task that weighs them bucket by bucket. A word outside the
broadcast part is counted by the bigrams that end in it, in its bucket; where both words of a bigram are such, the count of the first
is joined from the table of counts.

Words are runs of non-white bytes with A-Z in lower case, known by a 64-bit hash; then comes one end.

Defined results: a null text is an empty one, just the end. A null doc_id counts as training. Rows are scored one by one,
repeated ones too. Without training documents every token is unknown and each has probability 1. An empty table gives no rows. Very
long texts are steps of their own. Columns that bear a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import give_back, materialize, mix, steps, training_part, utf8, word_hashes, words

#: Relative frequency of the words that are broadcast.
HEAD = 3e-7
#: Prior weight of the unigram in a context that was seen c times: SCALE * c ** POWER.
SCALE, POWER = 3.0, 0.8
#: Tokens of the sample in which bigrams to broadcast are sought, and how often they must occur there.
SAMPLE_TOKENS, HOT = 4_000_000, 16
HOT_PAIRS = SAMPLE_TOKENS // HOT
END, START = np.uint64(0), np.uint64(1)
#: Tokens that a task counts at once before it sends counts on.
COUNT_TOKENS = 2_000_000
#: Text bytes whose bigrams a task deals at once, and rows of sums that it holds before it puts them together.
DEAL_BYTES, SUM_ROWS = 2 << 20, 1_000_000
#: Training tokens, and text bytes of all documents, for each task that weighs dealt bigrams, so that tasks grow in number and not in size.
DEALT_TOKENS, DEALT_BYTES = 3_000_000, 32 << 20
#: Documents whose sums are put together at once, as a power of two.
BLOCK = 12
_IN_BLOCK = (1 << BLOCK) - 1
#: Kinds of dealt rows: documents, bigrams of two broadcast words, those that end in another word, those that begin with one.
DOCUMENT, NEAR, ENDS, BEGINS = range(4)
_ID = 24  # bits of a broadcast word's number


def _tokens(batch, text: str = "text"):
    """Hashes and rows of all words of a batch, each row's closed by END."""
    raw, offsets = utf8(batch.column(text))
    starts, ends, doc = words(raw, offsets)
    n = batch.num_rows
    counts = np.bincount(doc, minlength=n) + 1
    last = np.cumsum(counts) - 1
    out = np.empty(int(counts.sum()), np.uint64)
    rows = np.repeat(np.arange(n), counts)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner], out[last] = word_hashes(raw, starts, ends), END
    return out, rows


def _before(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The token before each; the first of a row follows START."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)] = START
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _counter(keys_of):
    """A task that counts what keys_of finds in batches, many at a time: rows (key, c)."""

    def counted(parts):
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "c"])

    def run(batches):
        parts, held = [], 0
        for whole in batches:
            for batch in steps(whole, "text"):
                parts.append(keys_of(batch))
                held += len(parts[-1])
                if held >= COUNT_TOKENS:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)
        parts = None
        give_back()

    return run


class Automaton:
    """The part that is broadcast: words with counts and backoffs, and arcs of bigrams of theirs."""

    def __init__(self, found: np.ndarray, counts: np.ndarray, n: int, v: int, n_docs: int) -> None:
        order = np.argsort(found)
        found, counts = found[order], counts[order]
        self.n, self.v = n, v
        self.words = np.unique(np.concatenate([found, np.array([END, START], np.uint64)]))
        at, known = _find(found, self.words)
        self.counts = np.where(known, counts[at] if len(counts) else 0, 0)
        self.counts[np.searchsorted(self.words, END)] = n_docs  # each document has one end
        self.log_p = self.log_unigram(self.counts)
        contexts = self.counts.copy()
        contexts[np.searchsorted(self.words, START)] = n_docs
        self.prior, self.log_backoff = prior(contexts), log_backoff(contexts)
        self.set_arcs(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def codes_of(self, batch) -> np.ndarray:
        """The bigrams of a batch whose words are both here: number of the first, then of the second."""
        tokens, rows = _tokens(batch)
        (at, near), (before, after) = _find(self.words, tokens), _find(self.words, _before(tokens, rows))
        return ((before << _ID) | at)[near & after]

    def gain(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What bigrams seen so often add to backoff and unigram."""
        return gain(counts, self.prior[codes >> _ID], self.log_p[codes & ((1 << _ID) - 1)])

    def set_arcs(self, codes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes = codes[order]
        self.gains = self.gain(self.codes, counts[order])


def prior(counts: np.ndarray) -> np.ndarray:
    return SCALE * np.asarray(counts, float) ** POWER


def log_backoff(counts: np.ndarray) -> np.ndarray:
    weight = np.maximum(prior(counts), 1e-300)
    return np.where(counts > 0, np.log10(weight / (counts + weight)), 0.0)


def gain(counts: np.ndarray, weight: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """log10 of (c + m p) / (m p): a seen bigram's probability over that by backoff."""
    return np.log10(1 + counts / np.maximum(weight * 10.0**log_p, 1e-300)) * (counts > 0)


def train(docs: DataFrame, head: float = HEAD, hot: int = HOT) -> tuple[Automaton, DataFrame]:
    """The automaton's broadcast part and the exact counts (w, c) of all words of docs (a column text)."""
    counts = materialize(docs.select("text").mapInArrow(_counter(lambda b: _tokens(b)[0]), "key long, c long").groupBy(F.col("key").alias("w")).agg(F.sum("c").alias("c")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.filter(F.col("c") >= head * n).toArrow()  # 1 / head rows at most, since counts sum to n
    n_docs = counts.filter(F.col("w") == int(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    model = Automaton(top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy(), n, v, n_docs)
    if not n:
        return model, counts
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sample = docs.select("text").sample(min(1.0, SAMPLE_TOKENS / n), 11)
    often = sample.mapInArrow(_counter(lambda b: shared.value.codes_of(b)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= hot)
    wanted = np.sort(often.orderBy(F.desc("c"), "key").limit(HOT_PAIRS).toArrow().column("key").to_numpy())

    def counted(batch):
        codes = shared.value.codes_of(batch)
        return codes[_find(wanted, codes)[1]]

    exact = docs.select("text").mapInArrow(_counter(counted), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()  # the keys are those of wanted
    shared.unpersist()
    model.set_arcs(exact.column("key").to_numpy(), exact.column("c").to_numpy())
    return model, counts


_PAIRS = "a array<long>, b array<long>, rows array<int>, times array<int>"
_DEALT = ["kind", "bucket", "base", "a", "b", "rows", "times", "head"]


def _lists(bucket: np.ndarray, n: int, *columns: tuple[np.ndarray, pa.DataType]) -> list[pa.Array]:
    at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(at), pa.array(x, t)) for x, t in columns]


def _dealer(shared, keep: list[str], head: pa.DataType, buckets: int):
    """Texts to rows for the exchange: one for each document, and for each kind and bucket the bigrams that are to be weighed."""
    listed = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def dealt(kind, base, row, learn, a, b):
        """Equal bigrams of a document are one, with the number of times."""
        if not len(a):
            return
        order = np.lexsort((a, row) if b is None else (b, a, row))
        row, a, b = row[order], a[order], None if b is None else b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
        if b is not None:
            new[1:] |= b[1:] != b[:-1]
        first = np.flatnonzero(new)
        times, row, a, b = np.diff(np.append(first, len(a))), row[first], a[first], None if b is None else b[first]
        bucket = (mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, row = bucket[order], row[order]
        full, place = np.unique(bucket, return_inverse=True)
        arrays = _lists(place, len(full), (a[order], pa.int64()), *([] if b is None else [(b[order], pa.int64())]), (row * 2 + learn[row], pa.int32()), (times[order], pa.int32()))
        if b is None:
            arrays.insert(1, pa.array([[]] * len(full), listed[1]))
        columns = [pa.array(np.full(len(full), kind), pa.int32()), pa.array(full, pa.int32()), pa.array(np.full(len(full), base)), *arrays, pa.nulls(len(full), head)]
        yield pa.RecordBatch.from_arrays(columns, _DEALT)

    def run(batches):
        m = shared.value
        base = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in steps(whole, "text", DEAL_BYTES):
                n = batch.num_rows
                tokens, rows = _tokens(batch)
                ahead = _before(tokens, rows)
                (at, near), (before, after) = _find(m.words, tokens), _find(m.words, ahead)
                codes = (before << _ID) | at
                arc, met = _find(m.codes, codes)
                met &= near & after
                flat = np.where(near, m.log_p[at], 0.0)
                walk = flat + np.where(after, m.log_backoff[before], 0.0)
                if met.any():
                    walk[met] += m.gains[arc[met]]
                known = near & (m.counts[at] > 0)
                values = [*(batch.column(c) for c in keep), pa.array(np.bincount(rows, minlength=n)), pa.array(np.bincount(rows[known], minlength=n)), pa.array(np.bincount(rows, flat, n)), pa.array(np.bincount(rows, walk, n))]
                struct = pa.StructArray.from_arrays(values, fields=list(head))
                places = np.arange(base, base + n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, DOCUMENT), pa.int32()), pa.array(places % buckets, pa.int32()), pa.array(places), *[pa.nulls(n, t) for t in listed], struct], _DEALT)
                learn = batch.column("__learn").to_numpy(zero_copy_only=False).astype(np.int64)
                signed = tokens.view(np.int64), ahead.view(np.int64)
                open_, ends, begins = near & after & ~met, ~near, near & ~after
                yield from dealt(NEAR, base, rows[open_], learn, codes[open_], None)
                yield from dealt(ENDS, base, rows[ends], learn, signed[0][ends], signed[1][ends])
                yield from dealt(BEGINS, base, rows[begins], learn, signed[1][begins], at[begins])
                base += n
        give_back()

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row is in."""
    new = np.zeros(len(columns[0]), bool)
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _weigher(shared, head: pa.DataType):
    """Arrays of bigrams, sorted by bucket, to sums by document, in arrays for each block of documents, to bigrams of two words that
    are not broadcast (v, q, t), and to the documents themselves. A task holds a batch, one bucket, and sums."""
    names = ["block", "at", "known", "base", "gain", "v", "q", "t", "head"]

    def numbers(part):
        """kind, row, a, b and times of the bigrams in the arrays; b is 0 where a says both words."""
        a, rows, times = (part.column(c).flatten().to_numpy() for c in ("a", "rows", "times"))
        per = part.column("a").value_lengths().to_numpy()
        kind = np.repeat(part.column("kind").to_numpy(), per)
        b = np.zeros(len(a), np.int64)
        b[kind != NEAR] = part.column("b").flatten().to_numpy()
        return kind, np.repeat(part.column("base").to_numpy(), per) + (rows >> 1), a, b, np.where(rows & 1, times, -times)

    def summed(parts):
        found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return (found, *(np.bincount(where, np.concatenate([p[k] for p in parts]), len(found)) for k in (1, 2, 3)))

    def sums(part):
        """A row for each block of documents: places in it and sums as arrays."""
        row = part[0]
        blocks, first = np.unique(row >> BLOCK, return_index=True)
        per = pa.array(np.append(first, len(row)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(per, pa.array(x)) for x in ((row & _IN_BLOCK).astype(np.int32), part[1].astype(np.int64), part[2], part[3])]
        n = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array(blocks), *lists, pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, head)], names)

    def alone(row, v, q, t, heads):
        """Rows of one document each."""
        n = len(row)
        per = pa.array(np.arange(n + 1, dtype=np.int32))
        at = pa.ListArray.from_arrays(per, pa.array((row & _IN_BLOCK).astype(np.int32)))
        none = [pa.nulls(n, pa.list_(k)) for k in (pa.int64(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(row >> BLOCK), at, *none, v, q, t, heads], names)

    def weighed(m, kind, row, a, b, times):
        """The sums of a bucket, and its bigrams of two words that are not broadcast; times are negative in texts not learned from."""
        t, learned = np.abs(times), np.maximum(times, 0)
        known, base, more = np.zeros(len(kind), np.int64), np.zeros(len(kind)), np.zeros(len(kind))
        i = np.flatnonzero(kind == NEAR)
        i = i[np.argsort(a[i])]
        pair = _runs(a[i])
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        more[i] = t[i] * m.gain(a[i[first]], np.bincount(pair, learned[i]))[pair]
        i = np.flatnonzero(kind != NEAR)
        if not len(i):
            return (row, known, base, more), None
        i = i[np.lexsort((b[i], kind[i], a[i]))]
        word, pair = _runs(a[i]), _runs(a[i], kind[i], b[i])
        c = np.bincount(pair, learned[i])[pair].astype(np.int64)
        ca = np.bincount(word, learned[i] * (kind[i] == ENDS))[word].astype(np.int64)
        begins, ends = kind[i] == BEGINS, kind[i] == ENDS
        j = i[begins]
        more[j] = t[j] * gain(c[begins], prior(ca[begins]), m.log_p[b[j]])
        j, c, ca = i[ends], c[ends], ca[ends]
        log_p = m.log_unigram(ca)
        at, near = _find(m.words, b[j].view(np.uint64))
        known[j], base[j] = t[j] * (ca > 0), t[j] * log_p
        more[j] = t[j] * (log_p + log_backoff(ca) + np.where(near, gain(c, m.prior[at], log_p), 0.0))
        both = ~near & (c > 0)
        return (row, known, base, more), (row[j][both], b[j][both], c[both] / 10.0 ** log_p[both], t[j][both])

    def run(batches):
        m = shared.value
        parts, held, kept, bucket = [], 0, [], None

        def closed():
            """What goes on from the bucket that is over."""
            nonlocal parts, held, kept
            if not kept:
                return
            done, both = weighed(m, *(np.concatenate(x) for x in zip(*kept)))
            kept = []
            parts.append(done)
            held += len(done[0])
            if both is not None and len(both[0]):
                yield rest(*both)
            if held >= SUM_ROWS:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held >= SUM_ROWS // 2:
                    yield sums(parts[0])
                    parts, held = [], 0

        for batch in batches:
            whole = batch.column("kind").to_numpy() == DOCUMENT
            if n := int(whole.sum()):
                some = batch.filter(pa.array(whole))
                yield alone(some.column("base").to_numpy(), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), some.column("head"))
            pairs = batch.select(["kind", "bucket", "base", "a", "b", "rows", "times"]).filter(pa.array(~whole))
            for first, last in _stretches(pairs.column("bucket").to_numpy()):
                if pairs.column("bucket")[first].as_py() != bucket:
                    yield from closed()
                    bucket = pairs.column("bucket")[first].as_py()
                kept.append(numbers(pairs.slice(first, last - first)))
        yield from closed()
        if parts:
            yield sums(summed(parts))
        parts = kept = None
        give_back()

    def rest(row, v, q, t):
        return alone(row, pa.array(v), pa.array(q), pa.array(t, pa.int32()), pa.nulls(len(row), head))

    return run


def _gatherer(head: pa.DataType):
    """Rows sorted by block to one row for each document: row, head, sums, and its bigrams of two words that are not broadcast."""
    item = pa.struct([("v", pa.int64()), ("q", pa.float64()), ("t", pa.int32())])

    def gathered(block, sums, heads, places, rest, owners):
        whole = pa.concat_arrays(heads)
        at = np.concatenate(places).astype(np.int64)
        order = np.argsort(at)
        at, whole = at[order], whole.take(pa.array(order))
        if rest:
            owner = np.concatenate(owners)
            mine = np.argsort(owner, kind="stable")
            parts = pa.concat_arrays(rest).take(pa.array(mine))
            per = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=1 << BLOCK))])
            # documents without any have equal ends, so the ends of those that are there follow each other
            lists = pa.ListArray.from_arrays(pa.array(np.append(per[at], per[-1]).astype(np.int32)), parts)
        else:
            lists = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), pa.array([], item))
        return pa.RecordBatch.from_arrays([pa.array((block << BLOCK) | at), whole, *(pa.array(x[at]) for x in sums), lists], ["row", "head", "known", "base", "gain", "rest"])

    def run(batches):
        block, sums, heads, places, rest, owners = None, [], [], [], [], []
        for batch in batches:
            key = batch.column("block").to_numpy()
            for first, last in _stretches(key):
                if key[first] != block:
                    if block is not None:
                        yield gathered(block, sums, heads, places, rest, owners)
                    block, heads, places, rest, owners = int(key[first]), [], [], [], []
                    sums = [np.zeros(1 << BLOCK, np.int64), np.zeros(1 << BLOCK), np.zeros(1 << BLOCK)]
                part = batch.slice(first, last - first)
                at, alone = part.column("at"), part.column("known").is_null()
                one, many = np.flatnonzero(alone.to_numpy(zero_copy_only=False)), pa.array(np.flatnonzero(~alone.to_numpy(zero_copy_only=False)))
                places_of = at.take(many).flatten().to_numpy()
                for total, name in zip(sums, ("known", "base", "gain")):
                    np.add.at(total, places_of, part.column(name).take(many).flatten().to_numpy())
                if len(one):
                    some, where = part.take(pa.array(one)), at.take(pa.array(one)).flatten().to_numpy()
                    doc = some.column("head").is_valid().to_numpy(zero_copy_only=False)
                    if doc.any():
                        heads.append(some.column("head").filter(pa.array(doc)))
                        places.append(where[doc])
                    if not doc.all():
                        pairs = some.filter(pa.array(~doc))
                        rest.append(pa.StructArray.from_arrays([pairs.column(c) for c in ("v", "q", "t")], fields=list(item)))
                        owners.append(where[~doc])
        if block is not None:
            yield gathered(block, sums, heads, places, rest, owners)

    return run


def _stretches(key: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return list(zip(edge.tolist(), np.append(edge[1:], len(key)).tolist()))


def language_model_scores(docs: DataFrame, learn: Column, keep: list[str] | None = None, text: str = "text", head: float = HEAD, hot: int = HOT) -> tuple[DataFrame, Automaton]:
    """Columns `keep` of docs (all by default) and n_tokens, n_known, base_score, score of every row, by a model of the rows for
    which `learn` holds; and the broadcast part of the model. Texts to be scored by a model of others are united with them."""
    own = ["n_tokens", "n_known", "base_score", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    spark = docs.sparkSession
    given = docs.select(*[F.col(c) for c in keep if c != "text"], *([F.col("text").alias("__kept_text")] if "text" in keep else []), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    kept = ["__kept_text" if c == "text" else c for c in keep]
    model, counts = train(given.filter("__learn").select("text"), head, hot)
    shared = spark.sparkContext.broadcast(model)
    kinds = given.select(*kept).schema.fields
    fields = T.StructType([*kinds, *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(fields)
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.n // DEALT_TOKENS), -(-size // DEALT_BYTES))
    buckets = 8 * parts  # a task weighs one at a time
    schema = T.StructType([*T.StructType.fromDDL(f"kind int, bucket int, base long, {_PAIRS}").fields, T.StructField("head", fields)])
    dealt = given.mapInArrow(_dealer(shared, kept, arrow, buckets), schema).repartition(parts, "bucket").sortWithinPartitions("bucket")
    out = T.StructType([*T.StructType.fromDDL("block long, at array<int>, known array<long>, base array<double>, gain array<double>, v long, q double, t int").fields, T.StructField("head", fields)])
    weighed = dealt.mapInArrow(_weigher(shared, arrow), out).repartition("block").sortWithinPartitions("block")
    whole = T.StructType([T.StructField("row", T.LongType()), T.StructField("head", fields), *T.StructType.fromDDL("known long, base double, gain double, rest array<struct<v:long,q:double,t:int>>").fields])
    scored = materialize(weighed.mapInArrow(_gatherer(arrow), whole), "lm-scores")
    weight = SCALE * F.pow(F.col("c").cast("double"), F.lit(POWER))
    both = scored.filter(F.size("rest") > 0).select("row", F.inline("rest")).join(counts.select(F.col("w").alias("v"), "c"), "v")
    both = both.groupBy("row").agg(F.sum(F.col("t") * F.log10(1 + F.col("q") / weight)).alias("more"))
    done = scored.drop("rest").join(both, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = [F.col("head.n_tokens"), F.col("head.n_known") + zero("known"), F.col("head.base_score") + zero("base"), F.col("head.score") + zero("gain") + zero("more")]
    return done.select(*[F.col(f"head.`{k}`").alias(c) for k, c in zip(kept, keep)], *[x.alias(c) for x, c in zip(total, own)]), model


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (~training_part(F.col("doc_id"), 1)).alias("held_out"))
    scored, model = language_model_scores(docs, ~F.col("held_out"), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.n)).cast("long").alias("train_tokens"), "base_score", "score")
