"""Table and aggregate functions for SQL: split_text, split_source, ngrams, overall_progress."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import values as V
from .text import budget_parts

_SENTENCES, _CLAUSES = re.compile(V.SENTENCE_BREAK), re.compile(V.CLAUSE_BREAK)


class SplitText:
    """text.split_text for SQL: a row for each piece of at most `limit` characters."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, str]]:
        wrap = re.compile(rf"\S.{{0,{limit - 1}}}(?= |$)|\S{{{limit}}}")
        flat = " ".join(unicodedata.normalize("NFC", text or "").split())
        parts = [flat] if flat else []
        for cut in (_SENTENCES.split, _CLAUSES.split, wrap.findall):
            parts = [x for p in parts for x in ([p] if len(p) <= limit else cut(p))]
        if len(flat) <= limit:
            parts = [flat] if flat else []
        piece, number = "", 0
        for part in [*parts, None]:
            if part is not None and (not piece or len(piece) + 1 + len(part) <= limit):
                piece = f"{piece} {part}" if piece else part
            elif piece:
                yield number, piece
                piece, number = part, number + 1


class SplitSource:
    """text.split_source for SQL: lossless parts under a budget of characters."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(budget_parts(text or "", limit))


class Ngrams:
    """Grams of n characters with their places from 1."""

    def eval(self, text: str, n: int) -> Iterator[tuple[int, str]]:
        for i in range(len(text or "") - n + 1):
            yield i + 1, text[i : i + n]


def _mean(percent: pd.Series) -> float:
    return None if percent.isna().any() or not len(percent) else round(float(percent.mean()), 2)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: tables split_text, split_source and ngrams, and the aggregate overall_progress, the mean of step
    percents, null if one is unknown (the steps of a run are few)."""
    spark.udtf.register("split_text", F.udtf(SplitText, returnType="piece int, text string"))
    spark.udtf.register("split_source", F.udtf(SplitSource, returnType="part int, text string"))
    spark.udtf.register("ngrams", F.udtf(Ngrams, returnType="at int, gram string"))
    spark.udf.register("overall_progress", F.pandas_udf(_mean, "double", F.PandasUDFType.GROUPED_AGG))
