"""Matches of a regular expression with their places, by native expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,before:string,after:string>"
#: Code points kept from before and after a match, for its context.
CONTEXT = 40
_BLOCK = 256


def _placed(pieces: Column, start: Column) -> Column:
    """Spans of (gap, before, hit) pieces that follow each other from `start`."""

    def add(state, x):
        first = state["at"] + x["gap"]
        last = first + F.length(x["hit"])
        span = F.struct(first.alias("start"), last.alias("end"), x["hit"].alias("text"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(span).cast(f"array<{SPAN}>")).alias("out"))

    return F.aggregate(pieces, F.struct(start.cast("int").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), add, lambda s: s["out"])


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """df with an array of spans (code points, end exclusive) for each pattern: {column: (pattern, condition or None)}.

    Patterns match at least one character. Texts for which the condition is false or nothing matches get empty arrays. Places
    are running sums of the lengths between and in matches; they are taken in blocks, so that a text with very many matches
    costs little more than its length.
    """
    others = list(df.columns)
    hits = {c: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for c, (p, _) in patterns.items()}
    df = df.select(*others, *[(hits[c] if test is None else F.when(test, hits[c])).alias(f"__hits_{c}") for c, (_, test) in patterns.items()])
    gaps = {c: F.arrays_zip(F.split(text, p, -1).alias("piece"), F.col(f"__hits_{c}").alias("hit")) for c, (p, _) in patterns.items()}
    df = df.select(*others, *[F.when(F.size(f"__hits_{c}") > 0, gaps[c]).alias(f"__gaps_{c}") for c in patterns])

    def cut(c):
        after = lambda i: F.left(F.get(f"__gaps_{c}", i + 1)["piece"], F.lit(CONTEXT))
        piece = lambda x, i: F.when(x["hit"].isNotNull(), F.struct(F.length(x["piece"]).alias("gap"), F.right(x["piece"], F.lit(CONTEXT)).alias("before"), x["hit"].alias("hit"), after(i).alias("after")))
        return F.array_compact(F.transform(f"__gaps_{c}", piece))

    df = df.select(*others, *[cut(c).alias(f"__pieces_{c}") for c in patterns])
    block = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(f"__pieces_{c}") - 1) / _BLOCK).cast("int")), lambda b: F.slice(f"__pieces_{c}", b * _BLOCK + 1, F.lit(_BLOCK)))
    df = df.select(*others, *[F.when(F.size(f"__pieces_{c}") > 0, block(c)).alias(f"__blocks_{c}") for c in patterns])
    length = lambda pieces: F.aggregate(pieces, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["hit"]))

    def starts(c):
        add = lambda s, pieces: F.struct((s["at"] + length(pieces)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(f"__blocks_{c}", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda s: s["out"])

    df = df.select(*others, *[F.col(f"__blocks_{c}") for c in patterns], *[F.when(F.size(f"__blocks_{c}") > 0, starts(c)).alias(f"__starts_{c}") for c in patterns])
    placed = lambda c: F.flatten(F.zip_with(f"__blocks_{c}", f"__starts_{c}", _placed))
    return df.select(*others, *[F.coalesce(placed(c), F.array().cast(f"array<{SPAN}>")).alias(c) for c in patterns])


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(kind: str) -> Column:
    """How many of the structs in column `found` are of a kind."""
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
