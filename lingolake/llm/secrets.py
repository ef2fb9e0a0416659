r"""Secret scans with an incremental ledger of blobs.

Each version of each path is known by the SHA-256 of its content. The ledger holds, for each blob, the rules (with their
versions) that have been run on it and what they found; a scan runs only pairs of blob and rule version that the ledger
lacks, on one copy of each blob, and joins findings back to all paths and versions that hold the blob. A new version of a rule
is scanned again, an unchanged one is not.

Base rules: assign, access, hex; the method adds private_key, jwt and vcs_token. All is native.

Defined results: a null text is an empty one and has no findings. Repeated rows each get the findings of their content. An empty table
gives no rows and adds nothing to the ledger; very long texts are scanned whole.
Columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .spans import count_kind, joined, with_spans

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    check: Callable[[Column], Column] | None = None
    needs: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, _ASSIGN, lambda t: F.length(F.regexp_extract(t, _ASSIGN, 1)) >= 6),
    Rule("access", 1, r"AKIA[A-Z0-9]++", lambda t: F.length(t) >= 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]++", lambda t: F.length(t) >= 24),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]++ )*+PRIVATE KEY-----", None, "PRIVATE KEY"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", None, "eyJ"),
    Rule("vcs_token", 1, r"gh[pousr]_[A-Za-z0-9]{36}+", None, "gh"),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rules array<string>, found array<struct<kind:string,version:int,start:int,end:int>>"


def _hex_runs(pattern: str) -> str:
    """Runs too short to pass are left out of the match list; runs match whole, so no other match changes."""
    return pattern.replace("[0-9a-f]++", "(?:(?<![0-9a-f])|\\G)[0-9a-f]{24,}+")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text, todo: names of the rules to run)."""
    test = lambda r: F.array_contains("todo", r.name) if r.needs is None else F.array_contains("todo", r.name) & F.contains("text", F.lit(r.needs))
    df = with_spans(blobs, "text", {f"__{r.kind}": (_hex_runs(r.pattern), test(r)) for r in rules})

    def kept(r: Rule) -> Column:
        good = F.col(f"__{r.kind}") if r.check is None else F.filter(f"__{r.kind}", lambda s: r.check(s["text"]))
        return F.transform(good, lambda s: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), s["start"].alias("start"), s["end"].alias("end")))

    return df.select("blob", F.col("todo").alias("rules"), F.concat(*[kept(r) for r in rules]).alias("found"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings for every row of versions (columns `keep`, blob, found), and the rows that the ledger gains."""
    keep = [c for c in (versions.columns if keep is None else keep) if c not in ("blob", "found")]
    body = F.coalesce(F.col(text), F.lit(""))
    address = F.sha2(body, 256).alias("blob")
    names = F.array(*[F.lit(r.name) for r in rules])
    texts = versions.select(address, body.alias("text"))
    if ledger is None:
        todo = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", names)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        lacking = texts.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
        todo = texts.join(lacking.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")).join(lacking, "blob")
    gained = materialize(scan(todo, rules), "secret-ledger")
    # written first where a ledger was given: a blob of very many paths is then a large key of a table, which Spark can split in the join
    known = gained if ledger is None else materialize(ledger.unionByName(gained).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found")), "secret-known")
    now = F.filter("found", lambda s: F.concat_ws("@", s["kind"], s["version"].cast("string")).isin(*[r.name for r in rules]))
    order = F.array(*[F.lit(r.kind) for r in rules])
    sorted_ = F.transform(F.sort_array(F.transform(now, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = known.filter(F.size("found") > 0).select("blob", sorted_.alias("found"))
    out = versions.select(*keep, address).join(found, "blob", "left")
    return out.select(*keep, "blob", F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("found")), gained


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Findings of the whole table as its second version: the ledger comes from a first one, the documents of even id, so that the scan of
    the second runs on blobs that the first did not hold, and findings of both are joined to all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, ledger = scan_versions(docs.filter(F.pmod("doc_id", F.lit(2)) == 0), keep=["doc_id"])
    found, _ = scan_versions(docs, ledger, keep=["doc_id"])
    counts = [count_kind(k).alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "blob")
