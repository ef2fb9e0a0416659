"""Quality rules: a decision list learned from labelled documents, as ordered Spark conditional expressions.

Statistics of each document are native expressions. Sequential covering learns conjunctions of thresholds that find the
documents labelled as poor, and then those labelled as toxic among the rest: a rule grows by the condition of best information gain on one part of the sample, is pruned
from its end on the other part, and is kept while it is precise there; the documents that it covers leave the sample and the
next rule follows. The list is applied as CASE WHEN: the first rule that holds rejects, and what no rule covers is kept.

Toxic documents are told by how many of their words are listed, and how many are hinted at. Half of the sample makes the two lists, of
LISTED entries at most each. Listed are words that LISTED_DOCS toxic documents or more hold, and hardly any other document. Hints are
weaker: words and heads of words (their first letters) that stand mostly in toxic documents, so that languages with few labels, or with many
forms of a word, have some. Rules on both are learned on the other half, where the lists are as good as on documents never seen.

The fit uses at most FIT_ROWS labelled documents, those of least hash, so the driver holds a bounded table of numbers.

Defined results: a null text has no words, as an empty one, and fails the base test. A document with several labels counts
as poor if one of them is 0, as toxic if one is 1; null labels are left out. No labels, or labels of one kind only: no rules, so the
base test alone decides. Repeated rows are judged alike, very long texts whole. An empty table gives no rows.
Columns that bear the name of a statistic are replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, where

FIT_ROWS = 20_000
#: Words listed at most, toxic documents that hold one at least, and the least share of toxic ones among its documents (and one more).
LISTED, LISTED_DOCS, LISTED_SHARE = 400, 5, 0.9
#: The same of hints, and the lengths of heads.
HINT_DOCS, HINT_SHARE, HEADS = 4, 0.6, (3, 4, 5, 6, 7)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_WHITE = " \t\n\x0b\x0c\r"

#: What rules may test; all are made from the statistics.
FEATURES = {
    "n_words": lambda: F.col("n_words"),
    "mean_word": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "words_per_line": lambda: F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    "digit_share": lambda: F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)),
    "n_listed": lambda: F.col("n_listed"),
    "listed_share": lambda: F.col("n_listed") / F.greatest(F.col("n_words"), F.lit(1)),
    "n_hinted": lambda: F.col("n_hinted"),
    "hinted_share": lambda: F.col("n_hinted") / F.greatest(F.col("n_words"), F.lit(1)),
}
#: What rules for poor documents may test, and those for toxic ones.
OF_POOR, OF_TOXIC = list(FEATURES)[:-4], list(FEATURES)[-4:]


def letter_words(text: Column) -> Column:
    """Runs of letters in lower case, as an array; some may be empty."""
    return F.split(F.lower(text), r"\P{L}+")


def units(word: Column) -> Column:
    """A word, and its heads where it goes on after them."""
    heads = [F.when(F.length(word) > k, F.concat(F.left(word, F.lit(k)), F.lit("*"))) for k in HEADS]
    return F.array_compact(F.array(word, *heads))


def is_hinted(word: Column, hinted: tuple[str, ...]) -> Column:
    """Whether a word or a head of it is in the list. Nearly all words are told by their first letters, in one look-up."""
    test = word.isin(*[u for u in hinted if not u.endswith("*")] or [""])
    for k in HEADS:
        if heads := [u[:-1] for u in hinted if u.endswith("*") and len(u) == k + 1]:
            test = test | ((F.length(word) > k) & F.left(word, F.lit(k)).isin(*heads))
    return F.left(word, F.lit(HEADS[0])).isin(*sorted({u.rstrip("*")[: HEADS[0]] for u in hinted})) & test


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None, listed: tuple[str, ...] = (), hinted: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` of docs (all by default) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_digits, and
    n_listed and n_hinted, the words of either list."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_listed", "n_hinted"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim("__body", F.lit(_WHITE))
    letters = letter_words(body) if listed or hinted else F.lit(None).cast("array<string>")
    df = docs.select(*keep, body.alias("__body"), letters.alias("__letters"))
    among = lambda test: F.coalesce(F.size(F.filter("__letters", test)), F.lit(0)).cast("long")
    df = df.select(
        *keep,
        F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("__words"),
        F.filter(F.split("__body", "\n"), lambda x: F.length(F.btrim(x, F.lit(_WHITE))) > 0).alias("__lines"),
        F.length(F.translate("__body", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("__body") - F.length(F.translate("__body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("__body") - F.length(F.translate("__body", "0123456789", ""))).cast("long").alias("n_digits"),
        (among(lambda w: w.isin(*listed)) if listed else F.lit(0).cast("long")).alias("n_listed"),
        (among(lambda w: is_hinted(w, hinted)) if hinted else F.lit(0).cast("long")).alias("n_hinted"),
    )
    plain = [*keep, "word_chars", "n_symbols", "n_digits", "n_listed", "n_hinted"]
    df = df.select(
        *plain,
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__words").alias("__n"),
        F.when(F.size("__words") >= WINDOW, F.transform("__words", lambda w: F.xxhash64(w))).alias("__hashes"),
    )
    plain += ["n_words", "n_lines", "n_dup_lines"]
    # windows of 2, 4 and 8 words, each of two halves, so that a window costs three hashes
    for half in (1, 2, 4):
        later = F.slice("__hashes", half + 1, F.greatest(F.size("__hashes") - half, F.lit(0)))
        joined = F.zip_with("__hashes", later, lambda a, b: F.xxhash64(a, b))
        df = df.select(*plain, "__n", F.when(F.col("__n") >= WINDOW, F.slice(joined, 1, F.size("__hashes") - half)).alias("__hashes"))
    df = df.select(*plain, F.col("__hashes").alias("__windows"))
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.select(*plain, F.when(repeated, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__sorted"))
    same = lambda x, j: (x["h"] == F.get("__sorted", j - 1)["h"]) | (x["h"] == F.get("__sorted", j + 1)["h"])
    twice = F.sort_array(F.array_compact(F.transform("__sorted", lambda x, j: F.when(same(x, j), x["i"]))))
    df = df.select(*plain, twice.alias("__at"))
    covered = F.aggregate(F.transform("__at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


Condition = tuple[str, str, float]


def learn_rules(values: dict[str, np.ndarray], poor: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.97, seed: int = 7) -> list[list[Condition]]:
    """Sequential covering over columns of numbers; each rule is a conjunction of (feature, '<=' or '>', threshold)."""
    rules: list[list[Condition]] = []
    if not len(poor) or poor.all() or not poor.any():
        return rules
    grow = np.random.default_rng(seed).random(len(poor)) < 2 / 3
    left = np.ones(len(poor), bool)
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1])) for k, v in values.items()}
    while len(rules) < max_rules and (poor & left & grow).sum() >= 5:
        rule = _prune(_grow(values, cuts, poor, left & grow, max_conditions), values, poor, left & ~grow)
        hit = holds(rule, values) & left
        if not rule or not (poor & hit).any() or (poor & hit & ~grow).sum() < precision * (hit & ~grow).sum() or (poor & hit).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def holds(rule: list[Condition], values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for name, sign, at in rule:
        out &= values[name] <= at if sign == "<=" else values[name] > at
    return out


def _grow(values, cuts, poor, rows, most) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        p0, n0 = (poor & rows).sum(), (~poor & rows).sum()
        if not p0 or not n0:
            break
        best, gain = None, 0.0
        for name, at in cuts.items():
            for sign in ("<=", ">"):
                for t in at:
                    hit = rows & (values[name] <= t if sign == "<=" else values[name] > t)
                    p = (poor & hit).sum()
                    if p and (g := p * (math.log2(p / hit.sum()) - math.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                        best, gain = (name, sign, float(t)), g
        if best is None:
            break
        name, sign, t = best
        mine = values[name][rows]
        below, above = mine[mine <= t], mine[mine > t]
        if len(below) and len(above):  # midway between the values on either side, so that neither side is favoured
            best = (name, sign, float(below.max() + above.min()) / 2)
        rule = [c for c in rule if c[:2] != best[:2]] + [best]  # a tighter threshold takes the place of a looser one
        rows = rows & holds([best], values)
    return rule


def _prune(rule, values, poor, rows) -> list[Condition]:
    """The shortest head of the rule of best (p - n) / (p + n) on rows that it was not grown on."""
    best, value = rule, -2.0
    for k in range(1, len(rule) + 1):
        hit = holds(rule[:k], values) & rows
        p, n = (poor & hit).sum(), (~poor & hit).sum()
        if p + n and (p - n) / (p + n) > value + 1e-9:
            best, value = rule[:k], (p - n) / (p + n)
    return best


class Model(NamedTuple):
    """Rules in their order, and the lists of words and of hints that their statistics count."""

    rules: list[list[Condition]]
    listed: tuple[str, ...] = ()
    hinted: tuple[str, ...] = ()


def toxic_words(sample: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words to list and hints, from rows (text, __toxic); LISTED at most of each, those of most toxic documents."""
    held = sample.select("__toxic", F.explode(F.array_distinct(F.flatten(F.transform(letter_words(F.col("text")), units)))).alias("unit")).filter(F.length("unit") > 0)
    counts = materialize(held.groupBy("unit").agg(F.sum("__toxic").alias("toxic"), F.count("*").alias("n")).filter("toxic > 1"), "toxic-units")

    def chosen(docs: int, share: float, rows: DataFrame) -> tuple[str, ...]:
        good = rows.filter((F.col("toxic") >= docs) & (F.col("toxic") >= share * (F.col("n") + 1)))
        return tuple(r.unit for r in good.orderBy(F.desc("toxic"), "unit").limit(LISTED).collect())

    return chosen(LISTED_DOCS, LISTED_SHARE, counts.filter(~F.col("unit").endswith("*"))), chosen(HINT_DOCS, HINT_SHARE, counts)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Rules for documents with quality 0, then for those with toxic 1, from at most `fit_rows` labelled documents."""
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None).cast("int")
    graded = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"), F.max(toxic).alias("__toxic"))
    chosen = graded.filter(F.coalesce("__quality", "__toxic").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("__half")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen has fit_rows rows at most
    sample = sample.groupBy("doc_id", "__quality", "__toxic").agg(F.min("text").alias("text"))  # of rows that share an id one, the same each time
    sample = materialize(sample.select("doc_id", "text", "__quality", "__toxic", half), "quality-sample")
    listed, hinted = toxic_words(sample.filter("__half = 0 and __toxic is not null"))
    known = ["__quality", "__toxic", "__half"]
    numbers = with_statistics(sample, keep=["doc_id", *known], listed=listed, hinted=hinted)
    rows = numbers.select(*known, *[make().cast("double").alias(k) for k, make in FEATURES.items()]).collect()  # rows of fit_rows documents
    rules = _learn([r for r in rows if r["__quality"] is not None], OF_POOR, lambda r: r["__quality"] == 0)
    if listed or hinted:
        rules += _learn([r for r in rows if r["__toxic"] is not None and r["__half"] == 1], OF_TOXIC, lambda r: r["__toxic"] == 1)
    return Model(rules, listed, hinted)


def _learn(rows: list, features: list[str], bad) -> list[list[Condition]]:
    return learn_rules({k: np.array([r[k] for r in rows]) for k in features}, np.array([bad(r) for r in rows], bool))


def first_rule(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, at in rule:
            value = FEATURES[name]()
            test = test & (value <= at if sign == "<=" else value > at)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """with_statistics, and base_failed, rule (the first that holds) and kept."""
    df = with_statistics(docs, keep=keep, listed=model.listed, hinted=model.hinted).withColumn("base_failed", base_failed()).withColumn("rule", first_rule(model.rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", "n_listed", "n_hinted")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the base test or a rule rejects go, null and empty texts among them. All columns come out as they
    went in, whatever their names; repeated rows stay or go together. Very long texts are judged whole, an empty table stays empty, and
    without labels the base test alone decides."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = judge(docs.select(F.struct(*docs.columns).alias("__row"), "text"), model, keep=["__row"])
    return where(kept, F.col("kept")).select("__row.*")
