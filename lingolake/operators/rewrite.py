"""Rewriting of text columns over tables: literal rules with counts, source cleanup, sentence flow, foreign characters."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..sources.store import materialize

Rule = tuple[str, str, str]  # id, source, replacement


def quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def replace_terms(df: DataFrame, column: str, rules: list[Rule], out: str | None = None, normalize: bool = True) -> DataFrame:
    """df with the replaced text and `hits`, an array of the ids of the rules used, in order.

    At each place the longest literal wins, the leftmost first; what comes out is not matched again. Rules are a small list that
    becomes one literal pattern and one literal map. They are normalised as texts are; an empty source, or two that are equal
    once normalised, are refused."""
    out = out or column
    form = (lambda x: unicodedata.normalize("NFC", x)) if normalize else (lambda x: x)
    rules = [(i, form(source), form(to)) for i, source, to in rules]
    sources = [r[1] for r in rules]
    if not all(s.strip() for s in sources) or len(set(sources)) < len(sources):
        raise ValueError("rules need sources that are not empty and differ")
    body = X.nfc(F.col(column)) if normalize else F.col(column)
    if not rules:
        return df.withColumn(out, body).withColumn("hits", F.array().cast("array<string>"))
    pattern = "|".join(quoted(r[1]) for r in sorted(rules, key=lambda r: len(r[1]), reverse=True))
    ids, to = X.literal_map({r[1]: r[0] for r in rules}), X.literal_map({r[1]: r[2] for r in rules})
    df = df.withColumn("_body", body)
    df = df.withColumn("_hits", F.regexp_extract_all("_body", F.lit(pattern), F.lit(0)))
    joined = F.array_join(F.zip_with(F.split("_body", pattern, -1), "_hits", lambda p, h: F.concat(p, F.coalesce(F.try_element_at(to, h), F.lit("")))), "")
    text = F.when(F.size("_hits") > 0, joined).otherwise(F.col("_body"))
    return df.withColumn(out, X.nfc(text) if normalize else text).withColumn("hits", F.coalesce(F.transform("_hits", lambda h: F.element_at(ids, h)), F.array().cast("array<string>"))).drop("_body", "_hits")


def replace_by_snapshot(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """replace_terms where each row names its rules: df has snapshot_id, and rules are a table (snapshot_id, rule_id, source, replacement).

    A snapshot's rules become one pattern and one map, joined to the rows of it. Rows of an unknown snapshot keep their text. Rules are
    normalised as texts are; those with an empty source are left out, and of equal sources the one of the smallest id holds."""
    each = rules.select("snapshot_id", "rule_id", X.nfc(F.col("source")).alias("source"), X.nfc(F.coalesce("replacement", F.lit(""))).alias("to")).filter(F.length(X.strip(F.col("source"))) > 0)
    each = each.groupBy("snapshot_id", "source").agg(F.min(F.struct("rule_id", "to")).alias("rule"))
    safe = F.regexp_replace("source", r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    longest = F.transform(F.sort_array(F.collect_list(F.struct((-F.length("source")).alias("short"), safe.alias("safe")))), lambda x: x["safe"])
    sets = each.groupBy("snapshot_id").agg(F.array_join(longest, "|").alias("_pattern"), F.map_from_entries(F.collect_list(F.struct("source", "rule"))).alias("_rules"))
    rows = df.join(sets, "snapshot_id", "left").withColumn("_body", X.nfc(F.col(column)))
    rows = rows.withColumn("_hits", F.when(F.col("_pattern").isNotNull(), F.regexp_extract_all("_body", F.col("_pattern"), F.lit(0))))
    joined = F.array_join(F.zip_with(F.split("_body", F.col("_pattern"), -1), "_hits", lambda p, h: F.concat(p, F.coalesce(F.try_element_at("_rules", h)["to"], F.lit("")))), "")
    text = X.nfc(F.when(F.size("_hits") > 0, joined).otherwise(F.col("_body")))
    hits = F.coalesce(F.transform("_hits", lambda h: F.element_at("_rules", h)["rule_id"]), F.array().cast("array<string>"))
    return rows.withColumn(column, text).withColumn("hits", hits).select(*df.columns, "hits")


def moderation_stats(replaced: DataFrame, rule_ids: list[str], changed: Column) -> DataFrame:
    """Per job and rule the hits, zeros included, with totals: segments, modified segments, all replacements."""
    totals = replaced.groupBy("job_id").agg(F.count("*").alias("segments"), F.sum(changed.cast("long")).alias("modified"), F.sum(F.size("hits").cast("long")).alias("replacements"))
    counts = replaced.select("job_id", F.explode("hits").alias("rule_id")).groupBy("job_id", "rule_id").agg(F.count("*").alias("hits"))
    grid = totals.withColumn("rule_id", F.explode(F.array(*[F.lit(r) for r in rule_ids])))
    return grid.join(counts, ["job_id", "rule_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def _mask(text: Column, pattern: str) -> Column:
    """A text of the same length: 1 where the pattern matches, 0 elsewhere."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    run = lambda digit, part: F.repeat(F.lit(digit), F.coalesce(F.length(part), F.lit(0)))
    return F.array_join(F.zip_with(between, hits, lambda b, h: F.concat(run("0", b), run("1", h))), "")


def _heads(base: DataFrame, head: int) -> DataFrame:
    """A row for each job: its first rows in order, as an array of (idx, before, fixed, n). A map task sends `head` rows of a job at most."""
    place = F.rank().over(Window.partitionBy("job_id").orderBy("idx", "before"))
    first = base.withColumn("_place", place).filter(F.col("_place") <= head).groupBy("job_id", "idx", "before", "fixed").agg(F.count("*").alias("n"))
    return first.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("idx", "before", "fixed", "n"))).alias("rows"))


def clean_source(rows: DataFrame, corrections: list[tuple[str, str]] = V.CORRECTIONS, patterns: list[str] = V.BOILERPLATE, head: int = 80) -> DataFrame:
    """Changed rows only (job_id, idx, text): corrections, and boilerplate found across the first rows of a job; '' drops a row.

    Only first rows meet in a job's group. Each pattern makes a mask of their joined text, and a row is cut by its range of the masks. All
    other rows stay where they are; those that a correction changes are told from first rows by a join with one row for each job.
    Patterns are matched whatever the case and must not match empty text. A null text is an empty one; rows that repeat job, idx and
    text stand once in the joined text, and each gets the result. A null job is a job."""
    if any(re.search(p, "") for p in patterns):
        raise ValueError("a pattern matches empty text")
    base = rows.select("job_id", "idx", F.coalesce("text", F.lit("")).alias("before"))
    base = base.withColumn("fixed", X.correct_terms(F.col("before"), corrections))
    heads = materialize(_heads(base, head), "heads")

    joined = F.array_join(F.transform("rows", lambda r: r["fixed"]), "")
    masks = heads.select("job_id", "rows", joined.alias("_joined")).select("job_id", "rows", F.array(*[_mask(F.col("_joined"), f"(?iuU){p}") for p in patterns]).cast("array<string>").alias("_masks"))
    start = lambda i: F.aggregate(F.slice("rows", 1, i), F.lit(0), lambda n, r: n + F.length(r["fixed"]))
    cut = lambda r, i: F.filter(F.transform("_masks", lambda m: F.substring(m, start(i) + 1, F.length(r["fixed"]))), lambda m: m.contains("1"))
    marked = F.transform("rows", lambda r, i: F.named_struct(F.lit("row"), r, F.lit("cuts"), cut(r, i)))
    strike = lambda chars, m: F.zip_with(chars, F.split(m, ""), lambda c, gone: F.when(gone == "0", c).otherwise(""))
    kept = lambda e: F.when(F.size(e["cuts"]) > 0, F.aggregate(e["cuts"], F.split(e["row"]["fixed"], ""), strike, lambda chars: F.array_join(chars, "")))
    each = F.transform(marked, lambda e: F.named_struct(F.lit("row"), e["row"], F.lit("left"), kept(e)))
    left = masks.select("job_id", F.explode(each).alias("e")).select("job_id", "e.row.*", F.col("e.left").alias("_left"))
    left = left.withColumn("_bare", F.when(F.col("_left").rlike(rf"(?U)\A(?:{V.ONLY_MARKS.pattern})\z"), "").otherwise(F.regexp_replace("_left", "^[，,。 ]+", "")))
    ends = lambda c: F.coalesce(F.instr(F.lit(V.ROW_ENDS), F.right(c, F.lit(1))) > 0, F.lit(False)) & (F.length(c) > 0)
    swallowed = (F.length("_bare") > 0) & ends(F.col("fixed")) & ~ends(F.col("_bare"))
    rest = F.when(swallowed, F.concat("_bare", F.right("fixed", F.lit(1)))).otherwise(F.col("_bare"))
    text = F.when(F.col("_left").isNotNull(), rest).otherwise(F.col("fixed"))
    changed = left.select("job_id", "idx", "before", text.alias("text"), "n").filter("text <> before")
    changed = changed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("job_id", "idx", "text")
    if not corrections:
        return changed
    last = heads.select(F.col("job_id").alias("_job"), F.element_at("rows", -1).alias("_last"))
    beyond = F.struct("idx", "before") > F.struct(F.col("_last.idx"), F.col("_last.before"))
    later = base.filter("fixed <> before").join(last, F.col("job_id").eqNullSafe(F.col("_job")) & beyond)
    return changed.union(later.select("job_id", "idx", F.col("fixed").alias("text")))


def remove_boilerplate(rows: DataFrame, patterns: list[str] = V.BOILERPLATE, head: int = 80) -> DataFrame:
    """clean_source without corrections."""
    return clean_source(rows, [], patterns, head)


WORD = r"(?U)[^\W\d_]+"


def fix_flow(rows: DataFrame, column: str = "text", names: list[str] = (), least: int = 5) -> DataFrame:
    """rows with the first word in lower case where the row goes on from the one before and the word is common in its job."""
    words = rows.select("job_id", F.explode(F.slice(F.regexp_extract_all(column, F.lit(WORD), F.lit(0)), 2, 1 << 30)).alias("_word"))
    common = words.filter((F.lower("_word") == F.col("_word")) & (F.upper("_word") != F.col("_word"))).groupBy("job_id", "_word").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    before = F.lag(column).over(Window.partitionBy("job_id").orderBy("idx"))
    df = rows.withColumn("_goes_on", F.coalesce(X.strip(before).rlike("[,;、，]$"), F.lit(False)))
    df = df.withColumn("_first", F.regexp_extract(column, r"(?U)^[^\W\d_]+", 0)).withColumn("_word", F.lower("_first"))
    df = df.join(common.withColumn("_common", F.lit(True)), ["job_id", "_word"], "left")
    proper = sorted({w for n in names for w in re.findall(r"[^\W\d_]+", n)})
    low = F.col("_goes_on") & F.col("_common") & F.col("_first").rlike(r"^\p{Lu}") & ~F.col("_first").isin(proper or [""]) & ~F.col(column).rlike(r"(?U)^[^\W\d_]+ \p{Lu}")
    fixed = F.concat(F.lower(F.substring(column, 1, 1)), F.substring(column, 2, 1 << 30))
    return df.withColumn(column, F.when(F.coalesce(low, F.lit(False)), fixed).otherwise(F.col(column))).select(*rows.columns)


def clean_foreign(rows: DataFrame, column: str, pattern: str = X.FOREIGN) -> DataFrame:
    """rows with foreign characters removed where there are any."""
    return rows.withColumn(column, F.when(X.is_foreign(F.col(column), pattern), X.strip_foreign(F.col(column), pattern)).otherwise(F.col(column)))


def foreign_report(rows: DataFrame, column: str, pattern: str = X.FOREIGN) -> DataFrame:
    """Per job: rows checked and changed, characters removed, and the changed rows (idx)."""
    n = F.regexp_count(F.col(column), F.lit(pattern))
    return rows.groupBy("job_id").agg(F.count("*").alias("rows_checked"), F.sum((n > 0).cast("long")).alias("rows_changed"), F.sum(n.cast("long")).alias("characters_removed"), F.sort_array(F.collect_list(F.when(n > 0, F.col("idx")))).alias("rows"))
