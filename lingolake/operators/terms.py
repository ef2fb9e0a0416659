"""Terms in texts, each job by a list of its own, whatever its length."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import LONG, long_keys
from .scan import scan_ordered


class Terms:
    """A trie of terms with links to the longest suffix that goes on, so that a text is walked once, whatever the number of terms."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.step: list[dict[str, int]] = [{}]
        self.own, self.suffix, self.shorter = [-1], [0], [0]  # a state's term, its longest suffix, and the nearest of those with a term
        for k, term in enumerate(terms):
            state = 0
            for c in term:
                if c not in self.step[state]:
                    self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.own.append(-1)
                state = self.step[state][c]
            self.own[state] = k if state else -1
        self.suffix, self.shorter = [0] * len(self.step), [0] * len(self.step)
        waiting = deque(self.step[0].values())
        while waiting:  # level by level, since suffixes are shorter
            state = waiting.popleft()
            for c, after in self.step[state].items():
                back = self.suffix[state]
                while back and c not in self.step[back]:
                    back = self.suffix[back]
                self.suffix[after] = self.step[back].get(c, 0) if state else 0
                waiting.append(after)
            back = self.suffix[state]
            self.shorter[state] = back if self.own[back] >= 0 else self.shorter[back]

    def found(self, text: str) -> list[str]:
        """The distinct terms that occur in a text, in order of their first ends."""
        state, seen = 0, {}
        for c in text:
            while state and c not in self.step[state]:
                state = self.suffix[state]
            state = self.step[state].get(c, 0)
            at = state if self.own[state] >= 0 else self.shorter[state]
            while at and at not in seen:  # what a state ends with was seen when it was seen
                seen[at] = None
                at = self.shorter[at]
        return [self.terms[self.own[s]] for s in seen]


def match_job_terms(rows: DataFrame, terms: DataFrame, column: str = "text", long: int = LONG) -> DataFrame:
    """job_id, idx and term of the terms (job_id, term) of a row's job that occur in the row (job_id, idx, text).

    A job's list passes to its rows once, ahead of them: both are exchanged by job and sorted, lists first, and a task keeps the
    trie of one job. Jobs of more than `long` rows are dealt to several tasks by idx, with a copy of their list for each. Null
    and empty terms and texts match nothing; a term listed twice is found once; rows of a job without a list are left out."""
    kind = dict(rows.dtypes)["job_id"]
    texts = rows.select("job_id", F.lit(1).alias("_kind"), F.col("idx").cast("long").alias("idx"), F.col(column).alias("text")).filter((F.length("text") > 0) & F.col("job_id").isNotNull())
    lists = terms.select("job_id", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("idx"), F.col("term").alias("text")).filter(F.length("text") > 0).distinct()
    known = long_keys(texts, "job_id", long)
    if known is None:
        both = texts.unionByName(lists).withColumn("_deal", F.lit(0))
    else:
        shares = texts.join(known, "job_id", "left_semi").groupBy("job_id").agg(F.ceil(F.count("*") / long).cast("int").alias("_n"))
        part = F.coalesce("_n", F.lit(1))
        dealt = texts.join(shares, "job_id", "left").withColumn("_deal", F.pmod(F.xxhash64("idx"), part).cast("int"))
        copied = lists.join(shares, "job_id", "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), part - 1)))
        both = dealt.unionByName(copied).drop("_n")

    def fold(group):
        listed: list[str] = []
        trie = None
        for job, kind_, idx, text, _ in group:
            if not kind_:
                listed.append(text)
                continue
            if not listed:
                continue
            trie = trie or Terms(listed)
            for term in trie.found(text):
                yield job, idx, term

    return scan_ordered(both, ["job_id", "_deal"], ["_kind", "idx"], fold, f"job_id {kind}, idx long, term string")
