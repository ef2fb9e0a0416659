r"""Line dedup: windows of three consecutive lines that occur earlier, in order of document and line, are removed.

Each window is known by two independent 64-bit hashes. A window that occurs more than once keeps its first occurrence; the
lines that later occurrences cover are merged and removed. Each line that is removed stands earlier somewhere, so the first
copy of any line stays.

Defined results: lines are what \n separates, compared as they are; all blank lines are alike, and windows of blank lines
alone do not count. A text of one or two lines is one window of those, which only other such texts can repeat. A null text
stays null, an empty one empty. A null doc_id comes before all others. Rows that repeat doc_id and text are one document,
and all get the same result. An empty table gives no rows; very long texts are cut whole. Columns that bear the name of a result column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, where

_WHITE = " \t\x0b\x0c\r"
_KEY = ("__id", "__text_hash")


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each window: __id, __text_hash, pos (its first line), and the hashes h1 and h2."""
    hashed = lambda seed: F.transform("__lines", lambda x: F.when(F.length(F.btrim(x, F.lit(_WHITE))) > 0, F.xxhash64(*seed, x)).otherwise(0))
    lines = docs.filter(F.length(text) > 0).select(F.col(key).alias("__id"), F.xxhash64(text).alias("__text_hash"), F.split(text, "\n").alias("__lines"))
    lines = lines.select(*_KEY, hashed([]).alias("__a"), hashed([F.lit(1)]).alias("__b"))
    part = lambda name, i: [F.get(name, i), F.get(name, i + 1), F.get(name, i + 2)]  # noqa: E731  null beyond the last line, which the hash leaves out
    blank = lambda i: (F.get("__a", i) == 0) & (F.coalesce(F.get("__a", i + 1), F.lit(0)) == 0) & (F.coalesce(F.get("__a", i + 2), F.lit(0)) == 0)
    window = lambda i: F.when(~blank(i), F.struct(i.alias("pos"), F.xxhash64(*part("__a", i)).alias("h1"), F.xxhash64(*part("__b", i)).alias("h2")))
    places = F.sequence(F.lit(0), F.greatest(F.size("__a") - 3, F.lit(0)))
    return lines.select(*_KEY, F.explode(F.array_compact(F.transform(places, window))).alias("w")).select(*_KEY, "w.pos", "w.h1", "w.h2")


def later_windows(found: DataFrame) -> DataFrame:
    """Per document the windows that occur earlier: __id, __text_hash, __later (first lines)."""
    place = F.struct(*_KEY, "pos")
    # written first: where a window is in very many documents, Spark can split the join with a table, not with an aggregate below it
    first = materialize(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "line-firsts")
    later = found.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy(*_KEY).agg(F.collect_set("pos").alias("__later"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the remaining text, and n_lines, n_removed and removed (line numbers from 0)."""
    own = ["n_lines", "n_removed", "removed"]
    keep = [c for c in docs.columns if c not in own]
    found = materialize(occurrences(docs, text, key), "line-windows")
    later = later_windows(found)
    df = docs.select(*keep).withColumn("__hash", F.xxhash64(text))
    df = df.join(later, df[key].eqNullSafe(later["__id"]) & (df["__hash"] == later["__text_hash"]), "left").drop(*_KEY, "__hash")
    df = df.withColumn("__lines", F.split(text, "\n"))
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    cut = F.sort_array(F.array_intersect(F.flatten(F.transform("__later", lambda p: F.array(p, p + 1, p + 2))), every))
    df = df.withColumn("removed", F.when(F.col("__later").isNotNull(), cut).otherwise(F.array().cast("array<int>")))
    left = F.array_join(F.transform(F.array_except(every, "removed"), lambda i: F.get("__lines", i)), "\n")
    df = df.withColumn(text, F.when(F.size("removed") > 0, left).otherwise(F.col(text)))
    df = df.withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0)).cast("long")).withColumn("n_removed", F.size("removed").cast("long"))
    return df.select(*keep, *own)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document its lines, the lines removed, and the digest of the text that remains."""
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated windows of lines go, and documents of which nothing remains; n_chars is counted anew.

    All other columns come out as they went in, whatever their names. A null text stays, and so does an empty or blank one of which
    nothing was removed. Repeated rows are one document, and all get the same result."""
    done = dedup_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row")))
    done = where(done, (F.col("n_removed") == 0) | (F.length(F.btrim("text", F.lit(_WHITE + "\n"))) > 0))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
n AS (SELECT doc_id, list_transform(lines, lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' THEN '' ELSE x END) AS l FROM d),
w AS (SELECT doc_id, i, l[i + 1 : i + 3] AS win FROM (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 1))) AS i FROM n)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE array_to_string(win, '') <> '') WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM later)),
per AS (SELECT g.doc_id, list_sort(list(g.p)) AS cut FROM gone g JOIN d USING (doc_id) WHERE g.p < len(d.lines) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(per.cut), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(per.cut, ','), '') AS removed,
  sha256(CASE WHEN per.cut IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(0, len(d.lines)), lambda i: NOT list_contains(per.cut, i)), lambda i: d.lines[i + 1]), chr(10)) END) AS text_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
