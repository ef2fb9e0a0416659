"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

Features of a text are its byte trigrams, with A-Z in lower case and anything but letters as one blank, that hold two or more
letter bytes, hashed to BUCKETS. A text is the mean of its features' embeddings; a linear layer and a softmax give the
languages. Both layers are trained by stochastic gradient descent in numpy, on at most FIT_DOCS labelled documents, those of
least hash, of which a fifth is kept to fit the temperature and the rejection threshold. Features of the sample are counted in
Spark, so the driver holds at most BUCKETS counts for each. For prediction the layers are one table of BUCKETS rows.

Defined results: a null text or one without a letter is `und` with score 0. If there is nothing to learn from, all are `und`.
Rows are predicted one by one, repeated ones too, whole texts whatever their length; equal rows count once in the
sample. A null doc_id is predicted and not learned from. An empty table gives no rows. Columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, steps, training_part, utf8

BUCKETS = 1 << 13
FIT_DOCS = 4_000
DIM = 16
#: Predictions that are right less often than this at their score are rejected.
ACCEPT = 0.8

_LETTER = np.array([c >= 0x80 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
_BLANKED = np.where(_LETTER, LOWER, 32).astype(np.uint32)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, letter = _BLANKED[raw], _LETTER[raw]
    good = (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:]) >= 2
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good &= row[:-2] == row[2:]
    at = np.flatnonzero(good)
    code = b[at] | (b[at + 1] << np.uint32(8)) | (b[at + 2] << np.uint32(16))
    code = (code ^ (code >> np.uint32(11))) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), row[at]


class Model:
    """A table of one row of logits for each bucket, a bias, a temperature and a rejection threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject: float) -> None:
        self.langs, self.table, self.bias, self.temperature, self.reject = langs, table.astype(np.float32), bias, temperature, reject

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and calibrated probability of each row; -1 and 0 without features."""
        n = len(offsets) - 1
        bucket, row = features(raw, offsets)
        counts = np.bincount(row, minlength=n)
        mean = np.stack([np.bincount(row, self.table[bucket, k], n) for k in range(len(self.langs))], 1) / np.maximum(counts, 1)[:, None]
        p = softmax((mean + self.bias) / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 12, rate: float = 8.0, seed: int = 5) -> Model | None:
    """Train on (buckets, counts, language) of documents."""
    langs = sorted({x[2] for x in rows})
    rows = [x for x in rows if len(x[0])]
    if not langs or not rows:
        return None
    rng = np.random.default_rng(seed)
    truth = np.array([langs.index(x[2]) for x in rows])
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    used = order[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))

    def dense(which):
        x = np.zeros((len(which), BUCKETS))
        for i, d in enumerate(which):
            x[i, rows[d][0]] = rows[d][1] / rows[d][1].sum()
        return x

    for epoch in range(epochs):
        used = rng.permutation(used)
        step = rate * (1 - epoch / epochs)
        for k in range(0, len(used), 32):
            which = used[k : k + 32]
            x = dense(which)
            hidden = x @ embed
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(which)), truth[which]] -= 1
            error /= len(which)
            back = error @ layer.T
            layer -= 0.1 * step * (hidden.T @ error)
            bias -= 0.1 * step * error.sum(0)
            embed -= step * 10 * (x.T @ back)
    table = embed @ layer
    if not len(held):
        return Model(langs, table, bias, 1.0, 0.0)
    logits = np.concatenate([dense(held[k : k + 256]) @ table + bias for k in range(0, len(held), 256)])
    right = truth[held]
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), right], 1e-12)).mean()
    temperature = min(np.geomspace(0.2, 20, 60), key=loss)
    p = softmax(logits / temperature)
    order = np.argsort(p.max(1))
    good = (p.argmax(1) == right)[order]
    from_here = np.cumsum(good[::-1])[::-1] / np.arange(len(good), 0, -1)
    local = np.convolve(np.pad(good.astype(float), 10, mode="edge"), np.ones(21) / 21, "valid")
    low = np.flatnonzero((local < ACCEPT) & (from_here < 1))
    reject = float(p.max(1)[order][low[-1]]) if len(low) else 0.0
    return Model(langs, table, bias, float(temperature), reject)


def _histograms(batches):
    for whole in batches:
        for batch in steps(whole, "text"):
            bucket, row = features(*utf8(batch.column("text")))
            code, n = np.unique(row * BUCKETS + bucket, return_counts=True)
            per = np.concatenate([[0], np.cumsum(np.bincount(code // BUCKETS, minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(per), pa.array(x.astype(np.int32))) for x in (code % BUCKETS, n)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *lists], ["lang", "buckets", "counts"])


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """A model from at most `fit_docs` documents (doc_id, text, lang) with a language."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.xxhash64("lang")]  # all rows that tie are equal
    chosen = labelled.select(F.xxhash64("doc_id", "text", "lang").alias("__row"), *[x.alias(f"__{k}") for k, x in enumerate(order)])
    chosen = chosen.orderBy("__0", "__1", "__2", "__3").limit(fit_docs).select("__row").distinct()
    sample = labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen), F.xxhash64("doc_id", "text", "lang") == F.col("__row"), "left_semi").dropDuplicates()  # fit_docs hashes at most
    found = sample.select("text", "lang").mapInArrow(_histograms, "lang string, buckets array<int>, counts array<int>").toArrow()  # fit_docs rows at most
    langs, buckets, counts = (found.column(c).to_pylist() for c in ("lang", "buckets", "counts"))
    return fit(sorted(((np.array(b), np.array(c, float), x) for x, b, c in zip(langs, buckets, counts)), key=lambda r: (r[2], len(r[0]), r[0].tobytes())))


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all by default) and lang_pred, score, rejected."""
    own = ["lang_pred", "score", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for whole in batches:
            for batch in steps(whole, "__body"):
                lettered = batch.column("__lettered").to_numpy(zero_copy_only=False).astype(bool)
                best, p = m.predict(*utf8(batch.column("__body")))
                best, p = np.where(lettered, best, len(m.langs)), np.where(lettered, p, 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(p), pa.array(p < max(m.reject, 1e-9))], [*keep, *own])

    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, body.alias("__body"), body.rlike(r"\p{L}").alias("__lettered"))
    kinds = dict(docs.dtypes)
    return df.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double, rejected boolean")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(training_part(F.col("doc_id"), 0)).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text", (~training_part(F.col("doc_id"), 0)).alias("held_out")), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
