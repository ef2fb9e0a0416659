"""A caller's model over rows: batches, groups, retries, chunks. Only rows that need it reach the model."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..sources.store import materialize
from . import relations

#: Texts in, texts out, as many.
Model = Callable[[list[str]], list[str]]

_FOREIGN = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af]")


def map_batches(df: DataFrame, fn: Model, column: str = "text", out: str = "output", batch_size: int = 4) -> DataFrame:
    """df with `out`: what fn makes of the texts, at most 8 at a time. Blank texts are not sent and give ''."""
    size, names, place = max(1, min(8, batch_size)), df.columns, df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            made, full = [""] * len(texts), [i for i, t in enumerate(texts) if t.strip()]
            for k in range(0, len(full), size):
                part = full[k : k + size]
                got = fn([texts[i] for i in part])
                if len(got) != len(part) or any(not (x or "").strip() for x in got):
                    raise ValueError("the model returned another number of texts, or an empty one")
                for i, x in zip(part, got):
                    made[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*names, out])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, `{out}` string")


def map_groups(groups: DataFrame, fn: Model, batch_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows aligned from marked replies, and rows of groups that could not be aligned, for another try row by row.

    groups have job_id, group_no, ids and texts (arrays). A group is sent as one marked text, once: replies are written to the shared
    folder before either result is made of them."""
    sent = map_batches(groups.withColumn("prompt", X.group_prompt(F.col("texts"))), fn, "prompt", "reply", batch_size)
    split = materialize(sent.drop("prompt"), "replies").withColumn("_s", X.split_group(F.col("reply"), F.col("texts")))
    rows = split.select("job_id", "group_no", F.col("_s.problem").alias("problem"), F.explode(F.arrays_zip("ids", "texts", F.coalesce("_s.values", F.array().cast("array<string>")).alias("values"))).alias("x"))
    rows = rows.select("job_id", "group_no", F.col("x.ids").alias("idx"), F.col("x.texts").alias("text"), F.col("x.values").alias("output"), "problem")
    return rows.filter("problem is null").drop("problem"), rows.filter("problem is not null").drop("output")


def map_groups_with_fallback(groups: DataFrame, fn: Model, fns: list[Callable[[str, int], str]], names: list[str] | None = None, batch_size: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """map_groups, then the rows of groups that could not be aligned each on its own through with_retries.

    Rows (job_id, idx, text, output, alone), the failures of with_retries, and per job groups, grouped rows and fallbacks. Each group is sent once, and
    a row on its own once for each strategy that it needs."""
    good, bad = map_groups(groups, fn, batch_size)
    alone, failed = with_retries(bad.select("job_id", "idx", "text"), fns, names)
    done = good.select("job_id", "idx", "text", "output", F.lit(False).alias("alone")).unionByName(alone.select("job_id", "idx", "text", "output", F.lit(True).alias("alone")))
    lost = bad.select("job_id", "group_no").distinct().withColumn("fell_back", F.lit(True))
    sizes = groups.select("job_id", "group_no", F.size("ids").alias("rows")).join(lost, ["job_id", "group_no"], "left").withColumn("fell_back", F.coalesce("fell_back", F.lit(False)))
    return done, failed, relations.group_stats(sizes)


def with_retries(df: DataFrame, fns: list[Callable[[str, int], str]], names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (output, attempt, soft) and failures (attempts array), after each strategy has seen what is left.

    df has job_id, idx, text. A strategy takes a text and its seed. A draft whose pronouns disagree is kept in case nothing better
    comes, and then made to follow the source. Each strategy is called once for a row: its drafts are written to the shared folder,
    and both results and the next strategy read them there."""
    known = F.array(*[F.lit(n) for n in names or []]).cast("array<string>")
    left = df.withColumn("_soft", F.lit(None).cast("string")).withColumn("attempts", F.array().cast("array<struct<seed:bigint,draft:string,reason:string,strategy:int>>"))
    accepted = []
    for k, fn in enumerate(fns):
        tried = materialize(_seeded(left.withColumn("_seed", X.attempt_seed(F.col("text"), 0, k)), fn), "drafts")
        reason = X.output_problem(F.col("_draft"), F.col("text"))
        soft = F.when(reason.isNull(), X.gender_problem(F.col("text"), F.col("_draft"), known))
        tried = tried.withColumn("_why", F.coalesce(reason, soft)).withColumn("_soft", F.coalesce("_soft", F.when(soft.isNotNull(), F.col("_draft"))))
        accepted.append(tried.filter("_why is null").select("job_id", "idx", "text", F.col("_draft").alias("output"), F.lit(k).alias("attempt"), F.lit(False).alias("soft")))
        note = F.struct(F.col("_seed").alias("seed"), F.col("_draft").alias("draft"), F.col("_why").alias("reason"), F.lit(k).alias("strategy"))
        left = tried.filter("_why is not null").withColumn("attempts", F.concat("attempts", F.array(note))).drop("_seed", "_draft", "_why")
    accepted.append(left.filter("_soft is not null").select("job_id", "idx", "text", X.harmonize_gender(F.col("text"), F.col("_soft")).alias("output"), F.lit(len(fns)).alias("attempt"), F.lit(True).alias("soft")))
    return functools.reduce(DataFrame.unionByName, accepted), left.filter("_soft is null").drop("_soft")


def _seeded(df: DataFrame, fn: Callable[[str, int], str]) -> DataFrame:
    names = df.columns
    text, seed = names.index("text"), names.index("_seed")

    def run(batches):
        for batch in batches:
            made = [fn(t or "", s) for t, s in zip(batch.column(text).to_pylist(), batch.column(seed).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*names, "_draft"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", _draft string")


def translate_chunks(rows: DataFrame, fn: Callable[[list[dict], list[dict]], dict], size: int = 100, context: int = 12) -> DataFrame:
    """Rows (job_id, idx, text) through a chunk model in order: fn takes a chunk's rows and the rows before it with what was made of
    them, and returns texts by idx. Missing or blank ones are flagged and keep a readable draft."""
    from .folds import chunk_rows
    from .scan import scan_ordered

    kind = dict(rows.dtypes)["job_id"]

    def fold(group):
        done: list[dict] = []
        held: list[tuple] = []

        def close():
            got = fn([{"idx": r[1], "text": r[3]} for r in held], done[-context:])
            for job, idx, chunk, text in held:
                out = got.get(idx) or ""
                flagged = not out.strip() or bool(_FOREIGN.search(out))
                draft = " ".join(_FOREIGN.sub("", out).split()) or "…"
                done.append({"idx": idx, "text": text} | ({} if flagged else {"target": out.strip()}))
                yield job, idx, chunk, text, draft if flagged else out.strip(), flagged
            del done[:-context]

        for row in group:
            if held and held[-1][2] != row[2]:
                yield from close()
                held = []
            held.append(row)
        if held:
            yield from close()

    chunks = chunk_rows(rows, size).select("job_id", "idx", "chunk_no", "text")
    return scan_ordered(chunks, ["job_id"], ["idx"], fold, f"job_id {kind}, idx long, chunk_no int, text string, output string, flagged boolean")


#: A character card, the one seen last at the end; and what a round of chunks leaves for each job.
CARD = "array<struct<name:string,target:string,gender:string,note:string>>"
_ROUND = f"job_id {{kind}}, chunk_no int, done array<struct<idx:bigint,text:string,output:string,flagged:boolean>>, card {CARD}, recent array<struct<idx:bigint,text:string,target:string>>, billed long"
_LONGEST = 200


def merged_card(card: list[dict], updates: list[dict], limit: int) -> list[dict]:
    """merge_cards for one job: an update takes the place of its name's entry and moves to the end; the last `limit` stay."""
    found = {c["name"]: c for c in card}
    for u in updates:
        if isinstance(u.get("name"), str) and u["name"].strip():
            found.pop(u["name"], None)
            found[u["name"]] = {k: str(u.get(k) or ("unknown" if k == "gender" else ""))[:_LONGEST] for k in ("name", "target", "gender", "note")}
    return list(found.values())[-limit:]


def translate_chunks_with_card(rows: DataFrame, cards: DataFrame, fn: Callable[[list[dict], list[dict], list[dict]], dict], path: str, size: int = 100, context: int = 12, limit: int = 30) -> DataFrame:
    """translate_chunks where each chunk also sees its job's card of characters and changes it for the next one.

    rows are (job_id, idx, text), cards (job_id, name, target, gender; as initial_card makes them, in order of name). fn takes a chunk's rows (id, text),
    the rows before it (id, text, and target unless flagged) and the card, and returns {"rows": [{"id", "text", "ok"}], "characters": [...],
    "billed": n}; another set of ids is refused. Result: job_id, idx, chunk_no, text, output, flagged, billed (of the chunk).

    Chunks of a job depend on each other, jobs do not: round k sends the k-th chunk of every job, in parallel, and writes results, cards and
    the last `context` rows to path/round=k. A run that starts again goes on after the last whole round, so no chunk of it is sent twice."""
    from . import folds

    spark, kind = rows.sparkSession, dict(rows.dtypes)["job_id"]
    schema = _ROUND.format(kind=kind)
    row = F.struct(F.col("idx").cast("long").alias("idx"), "text")
    chunked = folds.chunk_rows(rows, size).groupBy("job_id", "chunk_no").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # `size` rows at most
    if not _written(spark, f"{path}/chunks"):
        chunked.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    entry = F.struct("name", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("gender", F.lit("unknown")).alias("gender"), F.lit("").alias("note"))
    first = cards.groupBy("job_id").agg(F.sort_array(F.collect_list(entry)).cast(CARD).alias("card"))
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def call(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for job, number, todo, card, recent in zip(*(batch.column(c).to_pylist() for c in ("job_id", "chunk_no", "rows", "card", "recent"))):
                before = [{"id": r["idx"], "text": r["text"]} | ({} if r["target"] is None else {"target": r["target"]}) for r in recent or []]
                reply = fn([{"id": r["idx"], "text": r["text"]} for r in todo], before, (card or [])[-limit:])
                got = {r["id"]: r for r in reply.get("rows", [])}
                if set(got) != {r["idx"] for r in todo}:
                    raise ValueError("the model returned another set of rows")
                done = []
                for r in todo:
                    text = got[r["idx"]].get("text")
                    good = got[r["idx"]].get("ok") is True and isinstance(text, str) and bool(text.strip())
                    draft = " ".join(_FOREIGN.sub("", str(text or "")).split()) or "…"
                    done.append({"idx": r["idx"], "text": r["text"], "output": text.strip() if good else draft, "flagged": not good})
                kept = [*(recent or []), *({"idx": r["idx"], "text": r["text"], "target": None if r["flagged"] else r["output"]} for r in done)]
                out.append((job, number, done, merged_card(card or [], reply.get("characters", []), limit), kept[-context:] if context else [], int(reply.get("billed") or 0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(target)], schema=target)

    rounds = chunks.agg(F.coalesce(F.max("chunk_no"), F.lit(-1))).first()[0] + 1
    for k in range(rounds):
        here = f"{path}/round={k}"
        if _written(spark, here):
            continue
        state = first.withColumn("recent", F.lit(None).cast("array<struct<idx:bigint,text:string,target:string>>")) if not k else spark.read.schema(schema).parquet(f"{path}/round={k - 1}").select("job_id", "card", "recent")
        chunks.filter(F.col("chunk_no") == k).join(state, "job_id", "left").mapInArrow(call, schema).write.mode("overwrite").parquet(here)
    if not rounds:
        done = spark.createDataFrame([], schema)
    else:
        done = spark.read.schema(schema).parquet(*[f"{path}/round={k}" for k in range(rounds)])
    return done.select("job_id", "chunk_no", "billed", F.inline("done")).select("job_id", "idx", "chunk_no", "text", "output", "flagged", "billed")


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
