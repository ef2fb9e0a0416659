"""Every query over the driver's tables that uses the transcript operators, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jobs as J
from ..functions import text as X
from ..functions import values as V
from ..operators import folds, relations, rewrite
from ..sources import segments as S
from ..sources.store import new_path
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


RULES = [("r1", "the", "THE"), ("r2", "then", "T.N"), ("r3", "tion", ""), ("r4", "a.b", "x"), ("r5", "la", "[la]"), ("r6", "en", "e"), ("r7", "e\u0301", "E")]  # the last one is not in NFC

_REPLACED = f"""{T.SEGMENTS},
cut AS (SELECT *, regexp_split_to_array(text, 'tion|then|a\\.b|the|la|en|é') AS p, regexp_extract_all(text, 'tion|then|a\\.b|the|la|en|é') AS h FROM segments),
replaced AS (SELECT job_id, idx, text AS before, h, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(CASE h[i] WHEN 'the' THEN 'THE' WHEN 'then' THEN 'T.N' WHEN 'tion' THEN '' WHEN 'a.b' THEN 'x' WHEN 'la' THEN '[la]' WHEN 'en' THEN 'e' WHEN 'é' THEN 'E' END, '')), '') AS text FROM cut)"""


@query("c1_replace_terms", f"WITH {_REPLACED} SELECT job_id, idx, text, CAST(len(h) AS BIGINT) AS n_hits FROM replaced")
def c1(spark, d):
    done = rewrite.replace_terms(T.segments(spark, d), "text", RULES)
    return done.select("job_id", "idx", "text", F.size("hits").cast("long").alias("n_hits"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    done = rewrite.replace_terms(T.segments(spark, d), "text", RULES, out="after")
    return rewrite.moderation_stats(done, [r[0] for r in RULES], F.col("after") != F.col("text"))


query("e1_moderation_stats", f"""WITH {_REPLACED},
totals AS (SELECT job_id, count(*) AS segments, CAST(sum(CASE WHEN text <> before THEN 1 ELSE 0 END) AS BIGINT) AS modified, CAST(sum(len(h)) AS BIGINT) AS replacements FROM replaced GROUP BY 1),
hit AS (SELECT job_id, CASE s WHEN 'the' THEN 'r1' WHEN 'then' THEN 'r2' WHEN 'tion' THEN 'r3' WHEN 'a.b' THEN 'r4' WHEN 'la' THEN 'r5' WHEN 'en' THEN 'r6' ELSE 'r7' END AS rule_id, count(*) AS hits FROM (SELECT job_id, unnest(h) AS s FROM replaced) GROUP BY 1, 2)
SELECT t.job_id, r.rule_id, t.segments, t.modified, t.replacements, coalesce(hit.hits, 0) AS hits
FROM totals t CROSS JOIN (SELECT unnest(['r1', 'r2', 'r3', 'r4', 'r5', 'r6', 'r7']) AS rule_id) r LEFT JOIN hit ON hit.job_id = t.job_id AND hit.rule_id = r.rule_id""")(flagship)


@query("a2_validate_segments", f"""WITH {T.SPANS}
SELECT job_id, seq, problem FROM (SELECT job_id, seq, CASE WHEN start_ms - 100 < 0 THEN 'negative time' WHEN end_ms - 1000 < start_ms THEN 'end before start'
  WHEN start_ms < lag(start_ms) OVER (PARTITION BY job_id ORDER BY seq) THEN 'start before previous start' WHEN event_type = 'error' THEN 'missing text' END AS problem FROM spans) WHERE problem IS NOT NULL""")
def a2(spark, d):
    s = T.spans(spark, d)
    rows = s.select("job_id", F.col("seq").alias("idx"), (F.col("start_ms") - 100).alias("start_ms"), (F.col("end_ms") - 1100).alias("end_ms"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("text"))
    return S.validate_segments(rows).select("job_id", F.col("idx").alias("seq"), "problem")


def _written(spark, d) -> str:
    """Segments written as a transcript: a folder of rows and one of Markdown for each job."""
    path = new_path(spark, "transcript")
    S.write_transcript(T.segments(spark, d), path)
    return path


@query("a1_read_segments", f"WITH {T.SEGMENTS} SELECT CAST(job_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS idx, start_ms, end_ms, text FROM segments")
def a1(spark, d):
    return S.read_segments(spark, f"{_written(spark, d)}/rows/*/*.json", job_pattern=r"job_id=([^/]+)/")


@query("a3_read_lines", f"WITH {T.DOC_LINES} SELECT part, row_number() OVER (PARTITION BY part ORDER BY job_id, line) - 1 AS line, value FROM (SELECT job_id % 3 AS part, * FROM doc_lines)")
def a3b(spark, d):
    """Documents of a remainder as one long file of lines each, read in splits of 64 KB; the numbers are those in the file."""
    docs, path = T.read(spark, d, "documents"), new_path(spark, "long-files")
    for part in range(3):
        body = docs.filter(F.col("doc_id") % 3 == part).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select("text")
        body.write.text(f"{path}/part={part}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = S.read_lines(spark, f"{path}/*/*.txt")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return lines.select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("part"), "line", "value")


@query("a4_ingest_jsonl", f"""WITH {T.SEGMENTS}, l AS (SELECT *, CASE WHEN idx % 3 = 0 THEN NULL ELSE idx % 5 <> 0 END AS timed FROM segments)
SELECT job_id, idx, CASE WHEN timed THEN start_ms END AS start_ms, CASE WHEN timed THEN CASE WHEN idx % 2 = 0 THEN 'M:' || text ELSE text END END AS text, coalesce(timed, false) AS taken FROM l""")
def a4(spark, d):
    s = T.segments(spark, d)
    row = F.struct("start_ms", F.when(F.col("idx") % 5 != 0, F.col("end_ms")).alias("end_ms"), F.when(F.col("idx") % 2 == 0, F.concat(F.lit("M:"), "text")).alias("text_vi_moderated"), F.col("text").alias("text_vi"))
    lines = s.select("job_id", (F.col("idx") - 1).alias("line"), F.when(F.col("idx") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(row)).alias("value"))
    good, bad = S.ingest_jsonl(lines, "voice")
    return good.select("job_id", "idx", "start_ms", "text", F.lit(True).alias("taken")).unionByName(bad.select("job_id", (F.col("line") + 1).alias("idx"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("taken")))


@query("a6_write_transcript", f"WITH {T.SEGMENTS} SELECT CAST(job_id AS VARCHAR) AS job_id, string_agg(text || chr(10) || chr(10), '' ORDER BY idx) AS markdown FROM segments GROUP BY job_id")
def a6(spark, d):
    files = spark.read.text(f"{_written(spark, d)}/markdown/*/*.txt", wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"job_id=([^/]+)/", 1).alias("job_id"), F.col("value").alias("markdown"))


@query("a6_publish_transcripts", f"""WITH {T.SEGMENTS} SELECT 'job_id=' || job_id || '/transcript.md' AS file, string_agg(text || chr(10) || chr(10), '' ORDER BY idx) AS text FROM segments GROUP BY job_id
UNION ALL SELECT 'job_id=' || job_id || '/transcript.jsonl', string_agg('{{"idx":' || idx || ',"start_ms":' || start_ms || '}}' || chr(10), '' ORDER BY idx) FROM segments GROUP BY job_id""")
def a6b(spark, d):
    """Half of the jobs are published, then the others; each time both files of all of them at once."""
    from ..sources import sink

    s, path = T.segments(spark, d), new_path(spark, "published")
    for part in (0, 1):
        sink.publish_transcripts(s.filter(F.col("job_id") % 2 == part).select("job_id", "idx", "start_ms", "text"), path)
    whole = sink.written_files(spark, path)
    return whole.withColumn("text", F.when(F.col("file").endswith(".jsonl"), F.regexp_replace("text", r',"text":".*?"}\n', "}\n")).otherwise(F.col("text")))


@query("a9_read_jobs", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS progress, CASE WHEN s_suppkey % 3 = 0 THEN 'tools' ELSE 'workflows' END AS scope FROM supplier")
def a9(spark, d):
    """A job.json in a folder of its own for each supplier, written by the sink's tasks and read again; a folder's name counts on where a key comes again."""
    from ..sources import sink

    s = T.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("progress"), F.when(F.col("s_suppkey") % 3 == 0, "tools").otherwise("workflows").alias("scope"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("name", "progress"))
    run = F.concat_ws("-", F.coalesce("id", F.lit("none")), F.when(nth > 1, nth))
    path = new_path(spark, "jobs")
    sink.write_files(s.select(F.concat_ws("/", "scope", run, F.lit("job.json")).alias("file"), F.lit(0).alias("place"), F.to_json(F.struct("id", "name", "progress")).alias("text")), path)
    return S.read_jobs(spark, sink.written_folders(path)).select("id", "name", "progress", "scope")


@query("a11_append_log", f"WITH {T.TRANSITIONS} SELECT job_id, seq, step FROM transitions WHERE state IN ('FAILED', 'PAUSED')")
def a11(spark, d):
    t, path = T.transitions(spark, d).select("job_id", "seq", "step", "state"), new_path(spark, "log")
    for state in ("FAILED", "PAUSED"):
        S.append_log(t.filter(F.col("state") == state).drop("state"), path)
    return spark.read.schema("job_id long, seq long, step string").json(path)


@query("a3_ingest_text", f"""WITH {T.DOC_LINES},
kept AS (SELECT job_id, line, trim(value, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS text FROM doc_lines WHERE length(value) <= 65536)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY line) AS idx, row_number() OVER (PARTITION BY job_id ORDER BY line) - 1 AS start_ms, text FROM kept WHERE text <> ''""")
def a3(spark, d):
    good, _ = S.text_rows(T.doc_lines(spark, d))
    return good.select("job_id", "idx", "start_ms", "text")


@query("a5_accept_upload", """SELECT page_id, lower(regexp_extract(f, '\\.([A-Za-z0-9]+)$', 1)) IN ('txt', 'md', 'jsonl') AS accepted
FROM (SELECT page_id, 'p' || CAST(page_id AS VARCHAR) || CASE page_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.html' ELSE '.jsonl' END AS f FROM pages)""")
def a5(spark, d):
    end = F.create_map(*[F.lit(x) for x in (0, ".TXT", 1, ".md", 2, ".html", 3, ".jsonl")])[(F.col("page_id") % 4).cast("int")]
    return T.read(spark, d, "pages").select("page_id", S.accept_upload(F.concat(F.lit("p"), F.col("page_id").cast("string"), end)).alias("accepted"))


_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"


@query("a7_to_srt", f"""WITH {T.SEGMENTS}
SELECT job_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {_STAMP.format("start_ms")} || ' --> ' || {_STAMP.format("end_ms")} || chr(10) || text || chr(10) || chr(10), '' ORDER BY n) AS srt
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS n FROM segments) GROUP BY job_id""")
def a7(spark, d):
    return S.to_srt(T.segments(spark, d).select("job_id", F.col("idx").alias("cue_no"), "start_ms", "end_ms", "text"))


@query("a8_manifest_units", f"WITH {T.FILES} SELECT job_id, pos AS index, CAST(round_even(length_ms * 7 * 1000 / 48000, 0) AS BIGINT) AS length_ms, CAST(gap_ms AS INT) AS gap_ms FROM files")
def a8(spark, d):
    f = T.files(spark, d).select("job_id", F.col("pos").alias("index"), F.lit("").alias("text"), (F.col("length_ms") * 7).alias("frames"), F.col("gap_ms").alias("gap_after_ms"))
    return S.manifest_units(f).drop("text")


@query("a8_read_manifest", f"WITH {T.FILES} SELECT supplier AS job_id, job_id * 8 + pos AS index, 'n' || pos AS text, CAST(round_even(length_ms * 7 * 1000 / 48000, 0) AS BIGINT) AS length_ms, CAST(CASE WHEN pos % 2 = 0 THEN gap_ms ELSE 0 END AS INT) AS gap_ms FROM files")
def a8b(spark, d):
    """Manifests written as JSON lines, a folder for each job, and read back."""
    f, path = T.files(spark, d), new_path(spark, "manifests")
    rows = f.select(F.col("supplier").alias("job_id"), (F.col("job_id") * 8 + F.col("pos")).alias("index"), F.concat(F.lit("n"), F.col("pos").cast("string")).alias("text"), (F.col("length_ms") * 7).alias("frames"), F.when(F.col("pos") % 2 == 0, F.col("gap_ms")).alias("gap_after_ms"))
    rows.repartition("job_id").sortWithinPartitions("job_id", "index").write.partitionBy("job_id").json(path)
    units = S.read_manifest(spark, f"{path}/*/*.json")
    return units.withColumn("job_id", F.regexp_extract("job_id", r"job_id=(\d+)/", 1).cast("long"))


_OLD = f"""{T.FILES},
old AS (SELECT job_id, type, max(size) AS size, sha256(CAST(max(size) AS VARCHAR)) AS sha256, min(created_at) AS created_at, 'STALE' AS status FROM files WHERE pos % 3 <> 0 GROUP BY 1, 2),
new AS (SELECT job_id, type, max(size) AS size, sha256(CAST(max(size) AS VARCHAR)) AS sha256, min(created_at) AS created_at FROM files WHERE pos % 2 = 0 GROUP BY 1, 2)"""


@query("a10_publish_files", f"""WITH {_OLD}
SELECT coalesce(o.job_id, n.job_id) AS job_id, coalesce(o.type, n.type) AS type,
  CASE WHEN n.sha256 IS NULL OR o.sha256 IS NOT DISTINCT FROM n.sha256 THEN o.size ELSE n.size END AS size,
  CASE WHEN n.sha256 IS NULL OR o.sha256 IS NOT DISTINCT FROM n.sha256 THEN o.status ELSE 'AVAILABLE' END AS status, coalesce(o.created_at, n.created_at) AS created_at
FROM old o FULL JOIN new n ON o.job_id = n.job_id AND o.type = n.type""")
def a10(spark, d):
    f = T.files(spark, d)
    part = lambda x: x.groupBy("job_id", "type").agg(F.max("size").alias("size"), F.min("created_at").alias("created_at")).withColumn("sha256", F.sha2(F.col("size").cast("string"), 256)).withColumn("path", F.col("type"))
    done = S.publish_files(part(f.filter("pos % 3 <> 0")).withColumn("status", F.lit("STALE")), part(f.filter("pos % 2 = 0")))
    return done.select("job_id", "type", "size", "status", "created_at")


@query("a12_digests", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents")
def a12(spark, d):
    return S.digests(T.read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "size", "sha256")


@query("b1_clean_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def b1(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.clean_ws(F.col("text")).alias("text"))


@query("b2_nfc", "SELECT doc_id, nfc_normalize(nfd) AS text FROM (SELECT doc_id, text AS nfd FROM documents)")
def b2(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.nfc(F.col("text")).alias("text"))


PAIRS = [("the", "he"), ("her", "HER"), ("tion", "sion")]


@query("b3_correct_terms", "SELECT doc_id, replace(replace(replace(text, 'the', 'he'), 'her', 'HER'), 'tion', 'sion') AS text FROM documents")
def b3(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.correct_terms(F.col("text"), PAIRS).alias("text"))


ACCENTS = "[äöüßéèêçñíó]"


@query("b4_is_foreign", f"SELECT doc_id, regexp_matches(text, '{ACCENTS}') AS is_foreign FROM documents")
def b4(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.is_foreign(F.col("text"), ACCENTS).alias("is_foreign"))


@query("b5_strip_foreign", f"""SELECT doc_id, CASE WHEN t = '' THEN '…' ELSE t END AS text FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{ACCENTS}', '', 'g'), '[(（\\[]\\s*[)）\\]]', '', 'g'), '\\s+', ' ', 'g'), '\\s+([,.;:!?…])', '\\1', 'g')) AS t FROM documents)""")
def b5(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.strip_foreign(F.col("text"), ACCENTS).alias("text"))


@query("b6_readable", f"SELECT doc_id, CASE WHEN t = '' THEN '…' ELSE t END AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{ACCENTS}', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)")
def b6(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.readable(F.col("text"), ACCENTS).alias("text"))


@query("b7_output_problem", f"""WITH {T.SEGMENTS}, pairs AS (SELECT job_id, idx, text AS result, coalesce(lag(text) OVER (PARTITION BY job_id ORDER BY idx), '') AS source FROM segments)
SELECT job_id, idx, CASE WHEN result = '' THEN 'empty text or reasoning/control tokens' WHEN regexp_matches(result, '[äß]') THEN 'untranslated Chinese'
  WHEN regexp_matches(result, '^\\s*[\\[【][^\\]】\\n]{{1,40}}[\\]】]') AND NOT regexp_matches(source, '^\\s*[\\[【][^\\]】\\n]{{1,40}}[\\]】]') THEN 'additional prompt/explanation content'
  WHEN contains(trim(result, chr(10) || ' '), chr(10)) AND NOT contains(source, chr(10)) AND length(source) <= 120 THEN 'additional prompt/explanation content'
  WHEN length(source) <= 120 AND length(result) > greatest(80, 12 * length(source)) THEN 'output much longer than the source' END AS problem FROM pairs""")
def b7(spark, d):
    s = T.segments(spark, d)
    source = F.coalesce(F.lag("text").over(Window.partitionBy("job_id").orderBy("idx")), F.lit(""))
    p = s.select("job_id", "idx", F.col("text").alias("result"), source.alias("source"))
    return p.select("job_id", "idx", X.output_problem(F.col("result"), F.col("source"), "[äß]").alias("problem"))


@query("b10_match_case", f"""WITH {T.SEGMENTS} SELECT job_id, idx, CASE WHEN regexp_matches(text, '^\\p{{Lu}}') THEN upper(left(role, 1)) || substr(role, 2) ELSE role END AS cased FROM segments""")
def b10(spark, d):
    return T.segments(spark, d).select("job_id", "idx", X.match_case(F.col("text"), F.col("role")).alias("cased"))


@query("b11_output_budget", "SELECT doc_id, CAST(least(2048, 48 + 6 * length(text)) AS BIGINT) AS budget FROM documents")
def b11(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.output_budget(F.col("text"), 2048).cast("long").alias("budget"))


@query("b12_attempt_seed", "SELECT doc_id, CAST(('0x' || substr(sha256(text), 1, 8)) AS BIGINT) % 100000 + 202 + 1 AS seed FROM documents")
def b12(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.attempt_seed(F.col("text"), 2, 1).alias("seed"))


@query("b13_fingerprint", """SELECT doc_id, sha256('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}') AS fingerprint FROM documents""")
def b13(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.fingerprint("doc_id", "lang", "n_chars").alias("fingerprint"))


TERMS = [("thea", "T1"), ("the", "T2"), ("ing", "T3"), ("theaing", "T4"), ("the", "T5")]


@query("b14_terms_in", f"""WITH {T.SEGMENTS}, t AS (SELECT * FROM (VALUES ('thea', 'T1'), ('the', 'T2'), ('ing', 'T3'), ('theaing', 'T4')) v(source, target)),
chosen AS (SELECT s.job_id, s.idx, s.text, t.source, t.target FROM segments s JOIN t ON contains(s.text, t.source)),
kept AS (SELECT * FROM chosen a WHERE NOT EXISTS (SELECT 1 FROM chosen b WHERE a.job_id = b.job_id AND a.idx = b.idx AND a.source <> b.source AND contains(b.source, a.source) AND NOT contains(replace(a.text, b.source, ''), a.source)))
SELECT job_id, idx, source, target FROM kept""")
def b14(spark, d):
    terms = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in TERMS])
    return T.segments(spark, d).select("job_id", "idx", F.explode(X.terms_in(F.col("text"), terms)).alias("t")).select("job_id", "idx", "t.source", "t.target")


@query("b15_prompt", f"""WITH {T.SEGMENTS} SELECT job_id, idx, CASE WHEN contains(text, 'the') THEN '参考下面的翻译：' || chr(10) || 'the 翻译成 T' || chr(10) || chr(10) ELSE '' END || 'Translate 〈x〉' || chr(10) || chr(10) || text AS prompt FROM segments""")
def b15(spark, d):
    terms = X.terms_in(F.col("text"), F.array(F.struct(F.lit("the").alias("source"), F.lit("T").alias("target"))))
    return T.segments(spark, d).withColumn("terms", terms).select("job_id", "idx", X.prompt(F.col("text"), F.col("terms"), "Translate <|x|>").alias("prompt"))


@query("b16_group_prompt", f"""WITH {T.SEGMENTS}, g AS (SELECT job_id, list(text ORDER BY idx) AS t FROM segments GROUP BY job_id)
SELECT job_id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: '<s' || i || '>' || t[i] || '</s' || i || '>'), '') AS prompt FROM g""")
def b16(spark, d):
    g = T.segments(spark, d).groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("t"))
    return g.select("job_id", X.group_prompt(F.col("t")).alias("prompt"))


@query("b17_split_group", f"""WITH {T.SEGMENTS}, g AS (SELECT job_id, list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY idx) AS t FROM segments GROUP BY job_id)
SELECT job_id, CASE WHEN job_id % 3 = 1 THEN NULL ELSE array_to_string(t, '|') END AS parts, CASE WHEN job_id % 3 = 1 THEN 'text outside segment markers' END AS problem FROM g""")
def b17(spark, d):
    g = T.segments(spark, d).groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("t"))
    reply = F.concat(F.lit("<target>"), X.group_prompt(F.col("t")), F.when(F.col("job_id") % 3 == 1, " more").otherwise(""), F.lit("</target>"))
    s = g.select("job_id", X.split_group(reply, F.col("t")).alias("s"))
    return s.select("job_id", F.array_join("s.values", "|").alias("parts"), "s.problem")


@query("b20_sentence_end", """SELECT doc_id, regexp_matches(text, '[.!?…。！？]["”’)\\]]*$') AS sentence_end, regexp_matches(text, '(?:[!?…！？]|\\.\\.\\.)["”’)\\]]*$') AS long_end FROM documents""")
def b20(spark, d):
    return T.read(spark, d, "documents").select("doc_id", X.sentence_end(F.col("text")).alias("sentence_end"), X.long_end(F.col("text")).alias("long_end"))


def _packed(units: str, limit: int) -> str:
    """SQL: neighbours in a list of texts put together, with a space, while they stay within the limit."""
    return f"list_reduce(list_transform({units}, lambda u: [u]), lambda a, e: CASE WHEN length(a[len(a)]) + 1 + length(e[1]) <= {limit} THEN list_append(a[:len(a) - 1], a[len(a)] || ' ' || e[1]) ELSE list_concat(a, e) END)"


def _pieces(limit: int) -> str:
    """SQL: segments cut into pieces."""
    lines = lambda c: f"CASE WHEN length({c}) <= {limit} THEN [{c}] ELSE {_packed(f'string_split({c}, chr(32))', limit)} END"
    cut = lambda x, marks: f"string_split(regexp_replace({x}, '([{marks}])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    clauses = f"CASE WHEN length(s) <= {limit} THEN [s] ELSE flatten(list_transform({cut('s', ',;:')}, lambda c: {lines('c')})) END"
    return f"""flat AS (SELECT *, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS f FROM segments),
cutup AS (SELECT *, flatten(list_transform({cut('f', '.!?…')}, lambda s: {clauses})) AS u FROM flat WHERE f <> ''),
pieces AS (SELECT job_id, idx, start_ms, end_ms, unnest(p) AS text, CAST(unnest(range(0, len(p))) AS INT) AS piece, len(p) AS n FROM (SELECT *, {_packed('u', limit)} AS p FROM cutup))"""


@query("b21_split_text", f"WITH {T.SEGMENTS}, {_pieces(40)} SELECT job_id, idx, piece, text FROM pieces")
def b21(spark, d):
    return T.segments(spark, d).select("job_id", "idx", F.posexplode(X.split_text(F.col("text"), 40)).alias("piece", "text"))


_PARTS = f"""RECURSIVE {T.SEGMENTS}, cuts AS (SELECT job_id, idx, 0 AS part, '' AS text, text AS rest FROM segments
  UNION ALL SELECT job_id, idx, part + 1, left(rest, n), substr(rest, n + 1) FROM (
    SELECT *, CASE WHEN length(rest) <= 120 THEN length(rest) WHEN near >= 60 THEN near ELSE 120 END AS n FROM (
      SELECT *, length(regexp_extract(left(rest, 120), '(?s)^(.*[。！？!?；，;,:：\\s]+[”’"）)]*)', 1)) AS near FROM cuts WHERE rest <> '')))"""


@query("b22_split_source", f"WITH {_PARTS} SELECT job_id, idx, CAST(part - 1 AS INT) AS part, text FROM cuts WHERE part > 0")
def b22(spark, d):
    return T.segments(spark, d).select("job_id", "idx", F.posexplode(X.split_source(F.col("text"), 120)).alias("part", "text"))


@query("b23_two_lines", f"""WITH {T.SEGMENTS}, {_pieces(84)}, s AS (SELECT job_id, idx, piece, text AS t, length(text) AS n, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) = ' ') AS sp FROM pieces),
b AS (SELECT *, list_sort(list_transform(sp, lambda i: [abs((i - 1) * 2 - n), i]))[1][2] AS mid FROM s)
SELECT job_id, idx, piece, CASE WHEN n > 42 AND mid IS NOT NULL THEN substr(t, 1, mid - 1) || chr(10) || substr(t, mid + 1) ELSE t END AS text FROM b""")
def b23(spark, d):
    pieces = T.segments(spark, d).select("job_id", "idx", F.posexplode(X.split_text(F.col("text"), 84)).alias("piece", "t"))
    return pieces.select("job_id", "idx", "piece", X.two_lines(F.col("t")).alias("text"))


@query("b24_srt_timestamp", f"WITH {T.SEGMENTS} SELECT job_id, idx, {_STAMP.format('end_ms')} AS stamp FROM segments")
def b24(spark, d):
    return T.segments(spark, d).select("job_id", "idx", X.srt_timestamp(F.col("end_ms")).alias("stamp"))


@query("b25_reading", """WITH n AS (SELECT page_id, regexp_extract(url, '^http[s]?://([a-z]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN length(host) > 2 AND left(host, 2) = 'th' AND NOT regexp_matches(substr(host, 3), '[^a-h]') THEN array_to_string(list_concat(['TH'], list_transform(string_split(substr(host, 3), ''), lambda c: upper(c))), ' ')
  WHEN length(host) > 2 AND left(host, 2) = 'th' THEN NULL
  WHEN length(host) > 1 AND left(host, 1) IN ('a', 'o', 'e') AND NOT regexp_matches(substr(host, 2), '[^a-h]') THEN array_to_string(list_concat([upper(left(host, 1)) || '.'], list_transform(string_split(substr(host, 2), ''), lambda c: upper(c))), ' ') END AS reading FROM n""")
def b25(spark, d):
    host = F.regexp_extract("url", r"^http[s]?://([a-z]+)", 1)
    given = {c: c.upper() for c in "abcdefgh"}
    return T.read(spark, d, "pages").select("page_id", host.alias("host")).select("page_id", X.reading(F.col("host"), {"th": "TH"}, {"a": "A.", "o": "O.", "e": "E."}, given).alias("reading"))


@query("b26_classify_error", f"""WITH {T.SEGMENTS} SELECT job_id, idx, CASE WHEN regexp_matches(m, 'out of memory') AND contains(m, 'cuda') THEN 'CUDA_OOM' WHEN regexp_matches(m, 'cuda|not compiled with|invalid device') THEN 'CUDA_CONFIG'
  WHEN regexp_matches(m, 'cookie|sign in') THEN 'YOUTUBE_AUTH' WHEN contains(m, '429') THEN 'RATE_LIMIT' WHEN regexp_matches(m, 'ffmpeg|ffprobe') AND role = 'system' THEN 'FFMPEG_MISSING'
  WHEN regexp_matches(m, 'model|tokenizer|weights') AND regexp_matches(m, 'not found|load') THEN 'MODEL_MISSING' WHEN role = 'system' THEN 'PATH_MISSING'
  WHEN role = 'user' AND regexp_matches(m, 'invalid literal|environment|device|batch|results_root') THEN 'ENV_CONFIG' ELSE 'STEP_FAILED' END AS code
FROM (SELECT *, lower(text) || CASE job_id % 5 WHEN 0 THEN ' http 429' WHEN 1 THEN ' batch size' WHEN 2 THEN ' weights: not found' WHEN 3 THEN ' sign in' ELSE '' END AS m FROM segments)""")
def b26(spark, d):
    kind = F.when(F.col("role") == "system", "FileNotFoundError").when(F.col("role") == "user", "ValueError").otherwise("RuntimeError")
    ends = F.element_at(F.array(*[F.lit(x) for x in (" HTTP 429", " batch size", " weights: not found", " Sign in", "")]), (F.col("job_id") % 5 + 1).cast("int"))
    return T.segments(spark, d).select("job_id", "idx", J.classify_error(kind, F.lit(None).cast("string"), F.concat("text", ends), F.lit(None).cast("int")).alias("code"))


@query("b27_error_id", f"""WITH {T.TRANSITIONS} SELECT job_id, seq, CASE state WHEN 'FAILED' THEN 'X100' WHEN 'PAUSED' THEN 'X200' ELSE 'X900' END AS error_id, CASE state WHEN 'FAILED' THEN 'failed' WHEN 'PAUSED' THEN 'paused' END AS message FROM transitions""")
def b27(spark, d):
    ids = spark.createDataFrame([("FAILED", "X100"), ("PAUSED", "X200")], "error_code string, error_id string")
    guides = spark.createDataFrame([("X100", "failed", "retry"), ("X200", "paused", "resume")], "error_id string, message string, hint string")
    e = T.transitions(spark, d).select("job_id", "seq", F.col("state").alias("error_code"))
    return J.with_error_id(e, ids, guides).select("job_id", "seq", "error_id", "message")


@query("b28_redact", """SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\s]+', '[URL]', 'g'), '(?im)^.*(?:cookie|authorization|bearer|password|secret|token|api[_-]?key|\\bSID=|\\bSAPISID=).*$', '[Sensitive detail removed]', 'g'), '\\b[\\w-]{2,}=[^\\s;,]+', '[REDACTED]', 'g'), 2000) AS text FROM documents""")
def b28(spark, d):
    return T.read(spark, d, "documents").select("doc_id", J.redact(F.col("text")).alias("text"))


@query("b29_valid_video_url", """WITH u AS (SELECT page_id, unnest([regexp_replace(url, '^https?://[^/]+', 'https://www.youtube.com'), 'https://youtu.be/' || right(url, 11), 'http://youtu.be/' || right(url, 11), 'https://m.youtube.com/watch?a=1&v=' || right(url, 11), 'https://music.youtube.com/shorts/' || right(url, 12), url]) AS url, unnest(range(0, 6)) AS n FROM pages)
SELECT page_id, CAST(n AS INT) AS n, regexp_matches(url, '^https://(www\\.)?youtu\\.be/[A-Za-z0-9_-]{11}/?([?#]|$)') OR regexp_matches(url, '^https://(www\\.|m\\.|music\\.)?youtube\\.com/(shorts|live)/[A-Za-z0-9_-]{11}/?([?#]|$)')
  OR regexp_matches(url, '^https://(www\\.|m\\.|music\\.)?youtube\\.com/watch\\?a=1&v=[A-Za-z0-9_-]{11}([&#]|$)') AS valid FROM u""")
def b29(spark, d):
    end = lambda k: F.right("url", F.lit(k))
    urls = F.array(F.regexp_replace("url", "^https?://[^/]+", "https://www.youtube.com"), F.concat(F.lit("https://youtu.be/"), end(11)), F.concat(F.lit("http://youtu.be/"), end(11)), F.concat(F.lit("https://m.youtube.com/watch?a=1&v="), end(11)), F.concat(F.lit("https://music.youtube.com/shorts/"), end(12)), F.col("url"))
    return T.read(spark, d, "pages").select("page_id", F.posexplode(urls).alias("n", "u")).select("page_id", "n", J.valid_video_url(F.col("u")).alias("valid"))


@query("b30_percent", f"""WITH {T.FILES} SELECT job_id, pos, CASE WHEN type = 'R' AND gap_ms = 0 THEN 100.0 WHEN gap_ms > 0 THEN CAST(round_even(least(100.0, greatest(0.0, 100.0 * length_ms / gap_ms)), 2) AS DOUBLE) END AS percent FROM files""")
def b30(spark, d):
    return T.files(spark, d).select("job_id", "pos", J.percent(F.col("length_ms"), F.col("gap_ms"), F.col("type") == "R").alias("percent"))


@query("b31_elapsed_ms", """SELECT o.o_orderkey AS id, l.l_linenumber AS n, l.l_partkey AS p, greatest(0, epoch_ms(l.l_shipdate) - epoch_ms(o.o_orderdate)) AS ms FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def b31(spark, d):
    o, l = T.read(spark, d, "orders"), T.read(spark, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), J.elapsed_ms(F.col("o_orderdate"), F.col("l_shipdate")).alias("ms"))


@query("b32_artifact_name", f"WITH {T.JOBS} SELECT id, lpad(CAST(id AS VARCHAR), 6, '0') || '-' || name AS artifact FROM jobs")
def b32(spark, d):
    return T.jobs(spark, d).select("id", J.artifact_name(F.col("id"), F.col("name")).alias("artifact"))


@query("b33_display", f"""WITH {T.FILES} SELECT job_id, pos, printf('%02d:%02d:%02d', length_ms * 60 // 1000 // 3600, length_ms * 60 // 1000 % 3600 // 60, length_ms * 60 // 1000 % 60) AS duration,
  CASE WHEN size * 8 < 1048576 THEN printf('%.1f KB', floor(size * 80 / 1024 + 0.5) / 10) ELSE printf('%.1f MB', floor(size * 80 / 1048576 + 0.5) / 10) END AS size FROM files""")
def b33(spark, d):
    return T.files(spark, d).select("job_id", "pos", J.display_duration(F.col("length_ms") * 60).alias("duration"), J.display_size(F.col("size") * 8).alias("size"))


@query("b34_validate_character", """SELECT c_custkey AS id, CASE WHEN length(c_name) > 20 THEN 'invalid source' WHEN c_acctbal < 0 THEN 'invalid gender' WHEN c_mktsegment = 'BUILDING' THEN 'invalid role' END AS problem FROM customer""")
def b34(spark, d):
    c = T.read(spark, d, "customer")
    gender = F.when(F.col("c_acctbal") < 0, "none").when(F.col("c_acctbal") < 3000, "male").when(F.col("c_acctbal") < 6000, "female")
    rows = c.select("c_custkey", (F.col("c_custkey") % 50).alias("job_id"), F.col("c_name").alias("source"), F.array("c_mktsegment").alias("aliases"), F.lit("x").alias("target"), gender.alias("gender"), F.when(F.col("c_mktsegment") == "BUILDING", "nobody").otherwise("friend").alias("role"), F.lit("peer").alias("rank"), F.lit("").alias("third"), F.lit("").alias("you"))
    return J.character_problems(rows, most=100_000).select(F.col("c_custkey").alias("id"), F.get("problems", 0).alias("problem"))


@query("b35_validate_rules", """SELECT id, CASE WHEN source = '' THEN 'empty source' WHEN replacement IS NULL THEN 'no replacement' WHEN count(*) OVER (PARTITION BY source) > 1 THEN 'duplicate source' END AS problem
FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(p_partkey // 2 % 40 AS VARCHAR) || p_name || 'é' END AS source, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS replacement FROM part)""")
def b35(spark, d):
    accent = F.when(F.col("p_partkey") % 2 == 0, "é").otherwise("e\u0301")  # the same once normalised
    name = F.concat((F.floor(F.col("p_partkey") / 2) % 40).cast("string"), "p_name", accent)
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(name).alias("source"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("replacement"))
    return J.validate_rules(p).select("id", "problem")


@query("b36_subtitle_settings", f"WITH {T.FILES} SELECT job_id, pos, CASE WHEN length_ms // 10 NOT BETWEEN 20 AND 200 THEN 'max_chars' WHEN gap_ms / 100.0 NOT BETWEEN 0.5 AND 5.0 THEN 'min_seconds' END AS problem FROM files")
def b36(spark, d):
    return T.files(spark, d).select("job_id", "pos", J.subtitle_problem(F.floor(F.col("length_ms") / 10), F.col("gap_ms") / 100.0).alias("problem"))


@query("b37_public_job", f"WITH {T.JOBS} SELECT id, name, status, created_at FROM jobs")
def b37(spark, d):
    return J.public_job(T.jobs(spark, d).withColumn("token", F.lit("secret")))


@query("b38_effective_steps", f"""WITH {T.JOBS} SELECT id, CASE WHEN status = 'P' THEN 'TTS' ELSE 'DOWNLOAD,TRANSCRIPTION,TRANSLATION,MODERATION,TTS' || CASE WHEN id % 2 = 0 THEN ',SUBTITLE' ELSE '' END || CASE WHEN id % 3 = 0 THEN ',VIDEO' ELSE '' END || CASE WHEN id % 6 = 0 THEN ',BURN' ELSE '' END END AS steps FROM jobs""")
def b38(spark, d):
    own = F.when(F.col("status") == "P", F.array(F.lit("TTS")))
    return T.jobs(spark, d).select("id", F.array_join(J.effective_steps(own, F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("id") % 2 == 0), ",").alias("steps"))


@query("b39_valid_cached", f"""WITH {T.SEGMENTS} SELECT job_id, idx, (idx % 4 <> 0) AND (CASE WHEN role = 'system' THEN false ELSE length(text) > 0 AND NOT regexp_matches(text, '[äß]') END) AS valid FROM segments""")
def b39(spark, d):
    s = T.segments(spark, d).withColumn("cached_end", F.when(F.col("idx") % 4 == 0, F.col("end_ms") + 1).otherwise(F.col("end_ms")))
    problem = X.output_problem(F.col("text"), F.col("text"), "[äß]")
    return s.select("job_id", "idx", J.valid_cached(F.col("start_ms"), F.col("end_ms"), F.col("text"), F.col("start_ms"), F.col("cached_end"), F.col("text"), F.col("text"), problem, F.col("role") == "system").alias("valid"))


@query("c4_fix_flow", f"""WITH {T.SEGMENTS},
words AS (SELECT job_id, unnest(w[2:]) AS word FROM (SELECT job_id, regexp_extract_all(text, '\\p{{L}}+') AS w FROM segments)),
common AS (SELECT job_id, word FROM words WHERE lower(word) = word AND upper(word) <> word GROUP BY 1, 2 HAVING count(*) >= 3),
s AS (SELECT *, lag(text) OVER (PARTITION BY job_id ORDER BY idx) AS before, regexp_extract(text, '^\\p{{L}}+') AS first FROM segments)
SELECT s.job_id, s.idx, CASE WHEN regexp_matches(before, '[.;,]$') IS TRUE AND c.word IS NOT NULL AND regexp_matches(first, '^\\p{{Lu}}') AND NOT regexp_matches(text, '^\\p{{L}}+ \\p{{Lu}}') THEN lower(left(text, 1)) || substr(text, 2) ELSE text END AS text
FROM s LEFT JOIN common c ON c.job_id = s.job_id AND c.word = lower(s.first)""")
def c4(spark, d):
    # the tables' turns end in full stops, which stand for commas here
    s = T.segments(spark, d).withColumn("text", F.regexp_replace("text", r"\.$", ","))
    fixed = rewrite.fix_flow(s, least=3)
    return fixed.select("job_id", "idx", F.regexp_replace("text", ",$", ".").alias("text"))


@query("c9_clean_foreign", f"""WITH {T.SEGMENTS}, n AS (SELECT job_id, idx, len(regexp_extract_all(text, '{ACCENTS}')) AS n FROM segments)
SELECT job_id, count(*) AS rows_checked, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_changed, CAST(sum(n) AS BIGINT) AS characters_removed, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (n > 0), '') AS rows FROM n GROUP BY job_id""")
def c9(spark, d):
    r = rewrite.foreign_report(T.segments(spark, d), "text", ACCENTS)
    return r.withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


_CHUNKS = "chunks AS (SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1 AS INT) AS chunk_no, start_ms, start_ms AS own_start_ms, start_ms + CAST(floor((end_ms - start_ms) / 2) AS BIGINT) AS own_end_ms FROM segments)"


def _chunks(s: DataFrame) -> DataFrame:
    n = (F.row_number().over(Window.partitionBy("job_id").orderBy("idx")) - 1).cast("int")
    return s.select("job_id", n.alias("chunk_no"), "start_ms", F.col("start_ms").alias("own_start_ms"), (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2).cast("long")).alias("own_end_ms"))


@query("d1_assign_ownership", f"""WITH {T.SEGMENTS}, {_CHUNKS}, sent AS (SELECT job_id, chunk_no, k * 400 AS s, k * 400 + 300 AS e, 't' || k AS text FROM chunks, (SELECT unnest(range(0, 8)) AS k)),
j AS (SELECT c.job_id, c.chunk_no, c.start_ms + s AS f, c.start_ms + e AS t, text, own_start_ms, own_end_ms, c.chunk_no = max(c.chunk_no) OVER (PARTITION BY c.job_id) AS last FROM sent JOIN chunks c USING (job_id, chunk_no))
SELECT job_id, chunk_no, f AS start_ms, t AS end_ms, text FROM j WHERE 2 * own_start_ms <= f + t AND f + t < 2 * (own_end_ms + CASE WHEN last THEN 1 ELSE 0 END)""")
def d1(spark, d):
    c = _chunks(T.segments(spark, d))
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    s = c.select("job_id", "chunk_no", k.alias("k")).select("job_id", "chunk_no", (F.col("k") * 400).cast("long").alias("start_ms"), (F.col("k") * 400 + 300).cast("long").alias("end_ms"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("text"))
    return relations.assign_ownership(s, c)


@query("d1_owners_by_time", f"""WITH {T.SEGMENTS}, {_CHUNKS} SELECT c.job_id, s.idx, c.chunk_no FROM segments s JOIN chunks c ON s.job_id = c.job_id AND c.own_start_ms <= s.start_ms + 700 AND s.start_ms + 700 < c.own_end_ms""")
def d1b(spark, d):
    s = T.segments(spark, d)
    return relations.owners_by_time(s.select("job_id", "idx", (F.col("start_ms") + 700).alias("at_ms")), _chunks(s)).select("job_id", "idx", "chunk_no")


_KEYED = f"""{T.SEGMENTS}, keyed AS (SELECT job_id, 'translation' AS stage, idx, sha256(text) AS fingerprint FROM segments),
cached AS (SELECT job_id, 'translation' AS stage, idx, sha256(CASE WHEN idx % 3 = 0 THEN text || '!' ELSE text END) AS fingerprint, text || '?' AS output FROM segments WHERE idx % 2 = 1)"""


def _keyed(spark, d):
    s = T.segments(spark, d).withColumn("stage", F.lit("translation"))
    rows = s.select("job_id", "stage", "idx", F.sha2("text", 256).alias("fingerprint"))
    old = s.filter("idx % 2 = 1").select("job_id", "stage", "idx", F.sha2(F.when(F.col("idx") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("fingerprint"), F.concat("text", F.lit("?")).alias("output"))
    return rows, old


@query("d2_resume_rows", f"WITH {_KEYED} SELECT k.job_id, k.idx, c.output FROM keyed k LEFT JOIN cached c ON k.job_id = c.job_id AND k.idx = c.idx AND k.fingerprint = c.fingerprint")
def d2(spark, d):
    return relations.resume_rows(*_keyed(spark, d)).select("job_id", "idx", "output")


@query("d3_pending_rows", f"WITH {_KEYED} SELECT k.job_id, k.idx FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE k.job_id = c.job_id AND k.idx = c.idx AND k.fingerprint = c.fingerprint)")
def d3(spark, d):
    return relations.pending_rows(*_keyed(spark, d)).select("job_id", "idx")


@query("d4_completed_stage", f"""WITH {T.FILES}, m AS (SELECT job_id, count(*) AS n, bool_and(pos % 5 <> 0 AND status = 'F') AS same FROM files GROUP BY job_id) SELECT job_id, same AND job_id % 4 <> 0 AS complete FROM m""")
def d4(spark, d):
    f = T.files(spark, d).withColumn("path", F.col("pos").cast("string")).withColumn("sha256", F.sha2(F.col("size").cast("string"), 256))
    wanted = F.when((F.col("pos") % 5 != 0) & (F.col("status") == "F"), F.col("sha256")).otherwise("other")
    m = f.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("path", wanted))).alias("outputs")).select("job_id", F.lit("voice").alias("stage"), F.lit("a").alias("signature"), F.when(F.col("job_id") % 4 == 0, "b").otherwise("a").alias("wanted_signature"), "outputs")
    return relations.completed_stage(m, f).select("job_id", "complete")


@query("d5_overlay_live", f"WITH {T.JOBS}, live AS (SELECT id, 'RUNNING' AS status FROM jobs WHERE id % 10 = 0) SELECT j.id AS job_id, coalesce(l.status, j.status) AS status, name FROM jobs j LEFT JOIN live l USING (id)")
def d5(spark, d):
    j = T.jobs(spark, d).select(F.col("id").alias("job_id"), "status", "name")
    return relations.overlay_live(j, j.filter("job_id % 10 = 0").select("job_id", F.lit("RUNNING").alias("status")), ["status"])


WORDS = ["thea", "ing", "tion", "en"]


@query("d6_match_terms", f"WITH {T.SEGMENTS} SELECT job_id, idx, t.term FROM segments JOIN (SELECT unnest(['thea', 'ing', 'tion', 'en']) AS term) t ON contains(text, t.term)")
def d6(spark, d):
    return relations.match_terms(T.segments(spark, d), WORDS).select("job_id", "idx", "term")


@query("d6_match_job_terms", f"""WITH {T.SEGMENTS}, t AS (SELECT DISTINCT job_id, unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS term FROM segments WHERE idx <= 2)
SELECT s.job_id, s.idx, t.term FROM segments s JOIN t ON s.job_id = t.job_id AND contains(s.text, t.term)""")
def d6b(spark, d):
    """Each conversation's list is the words of its first two turns."""
    from ..operators import terms

    s = T.segments(spark, d).select("job_id", "idx", "text")
    lists = s.filter("idx <= 2").select("job_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("term"))
    return terms.match_job_terms(s, lists)


@query("d7_assign_files", f"WITH {T.FILES} SELECT job_id, pos, type FROM files WHERE (type = 'A' AND pos = 1) OR (type = 'R' AND pos = 2)")
def d7(spark, d):
    f = T.files(spark, d).withColumn("path", F.col("pos").cast("string"))
    e = f.select("job_id").distinct().select("job_id", F.explode(F.array(F.struct(F.lit("A").alias("type"), F.lit("1").alias("path")), F.struct(F.lit("R").alias("type"), F.lit("2").alias("path")))).alias("e")).select("job_id", "e.type", "e.path")
    return relations.assign_files(f, e).select("job_id", "pos", "type")


@query("d8_available_voices", f"WITH {T.JOBS}, {T.FILES} SELECT id AS job_id, created_at FROM jobs WHERE scope IN ('c0', 'c1') AND EXISTS (SELECT 1 FROM files f WHERE f.job_id = id AND f.type = 'R' AND f.status = 'F')")
def d8(spark, d):
    j = T.jobs(spark, d).select(F.col("id").alias("job_id"), "created_at", F.when(F.col("scope") == "c0", "workflows").otherwise("tools").alias("scope"), F.when(F.col("scope") == "c1", "tts").alias("tool"))
    f = T.files(spark, d).select("job_id", F.when(F.col("type") == "R", "voice").alias("type"), F.when(F.col("status") == "F", "AVAILABLE").alias("status"))
    return relations.available_voices(j, f).select("job_id", "created_at")


@query("d9_seed_rules", """WITH rules AS (SELECT DISTINCT p_name AS source FROM part WHERE p_partkey % 2 = 0), shipped AS (SELECT p_name AS source, min(p_partkey) AS pos FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT source, 'own' AS replacement FROM rules UNION ALL SELECT s.source, CAST(s.pos AS VARCHAR) FROM shipped s WHERE s.source NOT IN (SELECT source FROM rules)""")
def d9(spark, d):
    p = T.read(spark, d, "part")
    rules = p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("source")).distinct().withColumn("replacement", F.lit("own"))
    shipped = p.filter("p_partkey % 2 = 1").select(F.col("p_name").alias("source"), F.col("p_partkey").cast("string").alias("replacement"), F.col("p_partkey").alias("pos"))
    return relations.seed_rules(rules, shipped)


@query("d10_apply_rule_changes", """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS source, p_brand AS replacement FROM part WHERE p_partkey % 3 <> 0""")
def d10(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("source"), F.col("p_brand").alias("replacement"))
    action = F.when(F.col("rule_id") % 3 == 0, "delete").otherwise("edit")
    changes = p.filter("rule_id % 3 <> 2").select(action.alias("action"), "rule_id", F.upper("source").alias("source"), "replacement", F.lit(1).alias("seq"))
    return relations.apply_rule_changes(p, changes)


@query("d10_checked_rule_changes", """WITH r AS (SELECT p_partkey AS rule_id, p_name AS source FROM part WHERE p_partkey % 3 <> 0),
c AS (SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN 'add' ELSE 'edit' END AS action, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'new ' || CAST(p_partkey AS VARCHAR) END AS source FROM part WHERE p_partkey % 4 = 0)
SELECT coalesce(r.rule_id, c.rule_id) AS rule_id, CASE WHEN c.source IS NOT NULL AND c.source <> '' THEN c.source ELSE r.source END AS source FROM r FULL JOIN c ON r.rule_id = c.rule_id WHERE r.rule_id IS NOT NULL OR c.source <> ''""")
def d10b(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("source"), F.lit("x").alias("replacement"))
    action = F.when(F.col("rule_id") % 3 == 0, "add").otherwise("edit")
    new = F.when(F.col("rule_id") % 5 == 0, "").otherwise(F.concat(F.lit("new "), F.col("rule_id").cast("string")))
    changes = p.filter("rule_id % 4 = 0").select("rule_id", action.alias("action"), new.alias("source"), "replacement", F.lit(1).alias("seq"))
    return relations.checked_rule_changes(p.filter("rule_id % 3 <> 0"), changes)[0].select("rule_id", "source")


@query("d11_same_output", f"WITH {T.SEGMENTS} SELECT job_id, count(*) FILTER (idx = 3) = 0 OR job_id % 2 = 0 AS same FROM segments GROUP BY job_id")
def d11(spark, d):
    s = T.segments(spark, d)
    other = s.withColumn("start_ms", F.col("start_ms") + F.when((F.col("job_id") % 2 == 1) & (F.col("idx") == 3), 31).otherwise(30))
    return relations.same_output(s, other)


@query("d12_context_rows", f"""WITH {T.SEGMENTS}, c AS (SELECT *, CAST(floor((idx - 1) / 3) AS INT) AS chunk_no FROM segments)
SELECT a.job_id, a.chunk_no, coalesce(string_agg(CAST(b.idx AS VARCHAR) || CASE WHEN b.role = 'system' THEN '' ELSE '=' || b.role END, ',' ORDER BY b.idx), '') AS context
FROM (SELECT job_id, chunk_no, min(idx) AS first FROM c GROUP BY 1, 2) a LEFT JOIN c b ON a.job_id = b.job_id AND b.idx < a.first AND b.idx >= a.first - 2 GROUP BY 1, 2""")
def d12(spark, d):
    s = T.segments(spark, d).withColumn("chunk_no", F.floor((F.col("idx") - 1) / 3).cast("int")).withColumn("target", F.col("role")).withColumn("flagged", F.col("role") == "system")
    c = relations.context_rows(s, 2)
    return c.select("job_id", "chunk_no", F.array_join(F.transform("context", lambda x: F.concat_ws("=", x["idx"].cast("string"), x["target"])), ",").alias("context"))


@query("d13_downstream", f"""WITH {T.FILES} SELECT job_id, pos, CASE WHEN job_id % 2 = 0 AND (CASE type WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) >= 2 THEN 'STALE' ELSE status END AS status FROM files""")
def d13(spark, d):
    f = T.files(spark, d).withColumn("step", F.col("type"))
    r = f.filter("job_id % 2 = 0").select("job_id", F.lit("N").alias("step"), F.lit(False).alias("burn")).distinct()
    return relations.downstream(f, r, ["A", "N", "R"]).select("job_id", "pos", "status")


@query("d14_backfill_missing", f"""WITH {T.FILES}, jobs AS (SELECT DISTINCT job_id FROM files), e AS (SELECT job_id, t AS type, 'S' AS step FROM jobs, (SELECT unnest(['A', 'N', 'R']) AS t))
SELECT job_id, type FROM e WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.job_id = e.job_id AND f.type = e.type) AND NOT EXISTS (SELECT 1 FROM files f WHERE f.job_id = e.job_id AND f.status = 'O' AND f.pos = 1)""")
def d14(spark, d):
    f = T.files(spark, d).select("job_id", "type", F.lit("S").alias("step"), F.when((F.col("status") == "O") & (F.col("pos") == 1), "STALE").otherwise("AVAILABLE").alias("status"))
    e = f.select("job_id").distinct().select("job_id", F.explode(F.array(*map(F.lit, "ANR"))).alias("type"), F.lit("S").alias("step"))
    return relations.backfill_missing(e, f).select("job_id", "type")


@query("d15_voice_units_of", """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_orderkey WHEN (o_orderkey + 1) % 2 = 0 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders) THEN 'm' || (o_orderkey + 1) END AS manifest FROM orders""")
def d15(spark, d):
    j = T.jobs(spark, d).select(F.col("id").alias("job_id"), (F.col("id") + 1).alias("voice_of"))
    m = j.filter("job_id % 2 = 0").select("job_id", F.concat(F.lit("m"), F.col("job_id").cast("string")).alias("path"))
    return relations.voice_units_of(j, m).select("job_id", "manifest")


@query("d16_join_telemetry", f"WITH {T.FILES}, a AS (SELECT job_id, sum(length_ms) AS ran FROM files WHERE type = 'A' GROUP BY 1), b AS (SELECT job_id, count(*) AS failures FROM files WHERE type = 'R' GROUP BY 1) SELECT o_orderkey AS job_id, CAST(a.ran AS BIGINT) AS ran, b.failures FROM orders LEFT JOIN a ON a.job_id = o_orderkey LEFT JOIN b ON b.job_id = o_orderkey")
def d16(spark, d):
    f = T.files(spark, d)
    a, b = f.filter("type = 'A'").groupBy("job_id").agg(F.sum("length_ms").alias("ran")), f.filter("type = 'R'").groupBy("job_id").agg(F.count("*").alias("failures"))
    return relations.join_telemetry(T.jobs(spark, d).select(F.col("id").alias("job_id")), a, b)


# Aggregations


@query("e6_overall_progress", f"""WITH {T.TRANSITIONS}, last AS (SELECT job_id, step, arg_max(state, tm) AS state, max(tm) AS m FROM transitions GROUP BY 1, 2),
l AS (SELECT t.job_id, t.step, t.state, CASE WHEN t.percent < 1 THEN NULL ELSE floor(t.percent) END AS percent FROM transitions t JOIN last ON t.job_id = last.job_id AND t.step = last.step AND t.tm = last.m),
v AS (SELECT job_id, CASE WHEN state = 'COMPLETED' THEN 100.0 ELSE percent END AS v FROM l)
SELECT job_id, CASE WHEN bool_or(v IS NULL) THEN NULL ELSE CAST(round_even(avg(v), 2) AS DOUBLE) END AS progress FROM v GROUP BY job_id""")
def e6(spark, d):
    t = T.transitions(spark, d).withColumn("percent", F.when(F.col("percent") >= 1, F.floor("percent").cast("double")))
    w = Window.partitionBy("job_id", "step").orderBy(F.desc("at"))
    return relations.overall_progress(t.withColumn("n", F.row_number().over(w)).filter("n = 1"))


@query("e7_translation_report", f"""WITH {T.SEGMENTS}, c AS (SELECT job_id, floor((idx - 1) / 3) AS chunk, idx, idx % 4 <> 3 AS done, role = 'system' AS flagged, length(text) AS chars FROM segments),
p AS (SELECT job_id, chunk, bool_and(done) AS d, count(*) AS n, sum(CASE WHEN done THEN 1 ELSE 0 END) AS dn, sum(chars) AS ch FROM c GROUP BY 1, 2),
f AS (SELECT job_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS flagged FROM c WHERE flagged GROUP BY 1)
SELECT p.job_id, CAST(sum(CASE WHEN d THEN 1 ELSE 0 END) AS BIGINT) AS chunks_done, count(*) AS chunks_total, CAST(sum(dn) AS BIGINT) AS rows_done, CAST(sum(n) AS BIGINT) AS rows_total, coalesce(any_value(f.flagged), '') AS flagged_rows, CAST(sum(CASE WHEN d THEN ch ELSE 0 END) AS BIGINT) AS billed_chars
FROM p LEFT JOIN f USING (job_id) GROUP BY p.job_id""")
def e7(spark, d):
    s = T.segments(spark, d)
    r = s.select("job_id", F.floor((F.col("idx") - 1) / 3).alias("chunk_no"), "idx", (F.col("idx") % 4 != 3).alias("done"), (F.col("role") == "system").alias("flagged"), F.length("text").cast("long").alias("chars"))
    return relations.translation_report(r).withColumn("flagged_rows", F.array_join(F.col("flagged_rows").cast("array<string>"), ","))


@query("e8_group_stats", f"WITH {T.FILES} SELECT job_id, count(*) AS groups, CAST(sum(length_ms) AS BIGINT) AS grouped_rows, CAST(sum(CASE WHEN type = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks FROM files GROUP BY job_id")
def e8(spark, d):
    return relations.group_stats(T.files(spark, d).select("job_id", F.col("length_ms").alias("rows"), (F.col("type") == "R").alias("fell_back")))


@query("e9_voice_layout", f"WITH {T.FILES} SELECT job_id, CAST(sum(size * 50000 + 48 * gap_ms) AS BIGINT) AS frames, CASE WHEN sum(size * 50000 + 48 * gap_ms) * 2 + 128 >= 4294967295 THEN 'RF64' ELSE 'WAV' END AS container FROM files GROUP BY job_id")
def e9(spark, d):
    return relations.voice_layout(T.files(spark, d).select("job_id", (F.col("size") * 50000).alias("frames"), F.col("gap_ms").alias("gap_after_ms")))


@query("e10_manifest_adds_up", f"WITH {T.FILES} SELECT job_id, abs(sum(length_ms + gap_ms) - 9000) <= 1000 OR bool_or(status = 'O' AND pos = 1) AS adds_up FROM files GROUP BY job_id")
def e10(spark, d):
    f = T.files(spark, d).withColumn("length_ms", F.when(~((F.col("status") == "O") & (F.col("pos") == 1)), F.col("length_ms"))).withColumn("total_ms", F.lit(9000))
    return relations.manifest_adds_up(f)


def _clips(spark, d):
    f = T.files(spark, d)
    return f.select("job_id", "pos", F.when(F.col("type") == "A", "h264").otherwise("hevc").alias("codec"), F.lit(1280).alias("width"), (F.lit(500) + F.col("supplier") % 3 * 100).cast("int").alias("height"), F.lit(30.0).alias("fps"), F.lit("yuv420p").alias("pix_fmt"), F.lit(0).alias("rotation"), F.col("length_ms").alias("duration_ms"), (F.col("size") * 10).alias("bitrate"), F.lit(60_000).alias("voice_ms"))


_CLIPS = f"{T.FILES}, clips AS (SELECT job_id, pos, CASE WHEN type = 'A' THEN 'h264' ELSE 'hevc' END AS codec, 500 + supplier % 3 * 100 AS height, length_ms AS duration_ms, size * 10 AS bitrate FROM files)"


@query("e11_video_plan", f"""WITH {_CLIPS}, g AS (SELECT job_id, min(codec) = max(codec) AND min(height) = max(height) AS alike, arg_min(height, pos) AS h, sum(duration_ms) AS ms, sum(bitrate * duration_ms) / greatest(sum(duration_ms), 1) / 1000 AS kbps FROM clips GROUP BY 1),
k AS (SELECT *, CASE WHEN alike THEN kbps WHEN h <= 600 THEN 1200 ELSE 2500 END AS v FROM g)
SELECT job_id, CASE WHEN alike THEN 'copy' ELSE 'encode' END AS mode, CAST(1280 AS INT) AS width, CAST(h AS INT) AS height, CAST(floor(v) AS INT) AS video_kbps, CAST(ms AS BIGINT) AS clips_ms, CAST(ceil(60000 / ms) AS INT) AS repeats, CAST(floor((v + 128) * 1000 / 8 * 60000 / 1000 * 1.02) AS BIGINT) AS size_bytes FROM k""")
def e11(spark, d):
    return relations.video_plan(_clips(spark, d))


@query("e12_allowed_resolutions", f"WITH {_CLIPS} SELECT job_id, CASE WHEN max(height) >= 720 THEN '480,720' ELSE '480' END AS heights FROM clips GROUP BY job_id")
def e12(spark, d):
    return relations.allowed_resolutions(_clips(spark, d)).select("job_id", F.array_join(F.col("heights").cast("array<string>"), ",").alias("heights"))


@query("e13_download_outcome", f"""WITH {T.FILES}, a AS (SELECT job_id, pos, CASE WHEN status = 'F' THEN 'file' END AS cookies, CASE WHEN type = 'A' AND gap_ms < 100 THEN 'http error 429' WHEN type = 'A' THEN 'sign in to confirm' WHEN type = 'R' THEN 'page needs to be reloaded' WHEN gap_ms < 250 THEN 'other' END AS error FROM files),
s AS (SELECT job_id, bool_or(error IS NOT NULL) AS e, bool_or(coalesce(contains(error, '429'), false)) AS l, bool_or(coalesce(contains(error, 'sign in'), false)) AS q, arg_max(error, pos) FILTER (cookies IS NOT NULL AND error IS NOT NULL) AS last FROM a GROUP BY 1)
SELECT job_id, CASE WHEN NOT e THEN 'T106' WHEN l THEN 'T103' WHEN last IS NULL AND q THEN 'T101' WHEN contains(last, 'sign in') THEN 'T101' WHEN contains(last, 'reloaded') THEN 'T102' ELSE 'T107' END AS code FROM s""")
def e13(spark, d):
    kind = F.when((F.col("type") == "A") & (F.col("gap_ms") < 100), "HTTP Error 429").when(F.col("type") == "A", "Sign in to confirm").when(F.col("type") == "R", "page needs to be reloaded").when(F.col("gap_ms") < 250, "other")
    return relations.download_outcome(T.files(spark, d).select("job_id", F.col("pos").alias("attempt_no"), F.when(F.col("status") == "F", "file").alias("cookies"), kind.alias("error")))


@query("e14_artifact_flags", f"WITH {T.FILES} SELECT job_id, bool_or(type = 'A' AND status = 'F') AS has_a, bool_or(type = 'N' AND status = 'F') AS has_n, bool_or(type = 'R' AND status = 'F') AS has_r FROM files GROUP BY job_id")
def e14(spark, d):
    f = T.files(spark, d).withColumn("status", F.when(F.col("status") == "F", "AVAILABLE").otherwise("STALE"))
    return relations.artifact_flags(f, ["A", "N", "R"])


@query("e15_status_facets", f"WITH {T.JOBS} SELECT DISTINCT status FROM jobs")
def e15(spark, d):
    return relations.status_facets(T.jobs(spark, d))


@query("e16_run_durations", f"""WITH {T.TRANSITIONS}, n AS (SELECT *, lead(tm) OVER (PARTITION BY job_id, step ORDER BY tm, seq) AS nxt FROM transitions)
SELECT job_id, step, CAST(sum(CASE WHEN state = 'RUNNING' THEN 1 ELSE 0 END) AS BIGINT) AS attempt, CAST(sum(CASE WHEN state = 'RUNNING' AND nxt IS NOT NULL THEN epoch_us(nxt) // 1000 - epoch_us(tm) // 1000 END) AS BIGINT) AS duration_ms FROM n GROUP BY 1, 2""")
def e16(spark, d):
    return relations.run_durations(T.transitions(spark, d))


@query("e17_throughput", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) / 3600 AS rate FROM events")
def e17(spark, d):
    e = T.read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("value").alias("amount"), "event_id")
    return relations.throughput(e, 3600).select("event_id", "rate")


@query("e18_slow_routes", """WITH t AS (SELECT event_type AS route, CAST(floor(value * 100) AS BIGINT) AS ms, user_id FROM events), p AS (SELECT route, count(*) AS requests, CAST(sum(CASE WHEN ms >= 2000 THEN 1 ELSE 0 END) AS BIGINT) AS slow FROM t GROUP BY 1)
SELECT p.route, p.requests, p.slow, s.step, CAST(s.ms AS BIGINT) AS step_ms FROM p JOIN (SELECT route, 'read' AS step, sum(ms // 3) AS ms FROM t GROUP BY 1 UNION ALL SELECT route, 'work', sum(ms - ms // 3) FROM t GROUP BY 1) s USING (route)""")
def e18(spark, d):
    ms = F.floor(F.col("value") * 100).cast("long")
    t = T.read(spark, d, "events").select(F.col("event_type").alias("route"), ms.alias("total_ms"))
    third = F.floor(F.col("total_ms") / 3).cast("long")
    return relations.slow_routes(t.withColumn("steps_ms", F.create_map(F.lit("read"), third, F.lit("work"), F.col("total_ms") - third)))


@query("e19_longest_dedupe", "SELECT doc_id AS task_id, min(doc_id) OVER (PARTITION BY source, text) AS worker_id FROM documents")
def e19(spark, d):
    t = T.read(spark, d, "documents").select(F.col("doc_id").alias("task_id"), F.col("source").alias("config"), F.sha2("text", 256).alias("text"))
    return relations.longest_dedupe(t).select("task_id", "worker_id")


@query("e20_merge_cards", f"""WITH {T.TRANSITIONS}, l AS (SELECT job_id, step || state AS name, max(seq) AS seq, arg_max(percent, seq) AS card FROM transitions GROUP BY 1, 2)
SELECT job_id, name, seq, card FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC, name) AS n FROM l) WHERE n <= 5""")
def e20(spark, d):
    return relations.merge_cards(T.transitions(spark, d).select("job_id", "seq", F.concat("step", "state").alias("name"), F.col("percent").alias("card")), 5)


# Windows and folds


@query("f1_pair_speech_events", f"""WITH {T.SPANS}, m AS (SELECT job_id, seq, CASE WHEN event_type IN ('view', 'signup') THEN start_ms ELSE -1 END AS s, CASE WHEN event_type IN ('click', 'view') THEN end_ms ELSE -1 END AS e FROM spans),
g AS (SELECT *, coalesce(sum(CASE WHEN e >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM m),
o AS (SELECT *, last_value(CASE WHEN s >= 0 THEN s END IGNORE NULLS) OVER (PARTITION BY job_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM g)
SELECT job_id, seq, coalesce(o, greatest(0, e - 30000)) AS start_ms, e AS end_ms FROM o WHERE e >= 0 AND e > coalesce(o, greatest(0, e - 30000))""")
def f1(spark, d):
    s = T.spans(spark, d)
    return folds.pair_speech_events(s.select("job_id", "seq", F.when(F.col("event_type").isin("view", "signup"), F.col("start_ms")).otherwise(-1).alias("start_ms"), F.when(F.col("event_type").isin("click", "view"), F.col("end_ms")).otherwise(-1).alias("end_ms")))


_ORDERED = "o AS (SELECT job_id, start_ms, end_ms, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms) AS n FROM spans WHERE end_ms > start_ms)"
_GROUPED = f"""RECURSIVE {T.SPANS}, {_ORDERED},
f AS (SELECT job_id, n, start_ms AS first, end_ms AS last, 0 AS g FROM o WHERE n = 1
  UNION ALL SELECT o.job_id, o.n, CASE WHEN o.start_ms - f.last <= 700 AND o.end_ms - f.first <= 30000 THEN f.first ELSE o.start_ms END,
    CASE WHEN o.start_ms - f.last <= 700 AND o.end_ms - f.first <= 30000 THEN greatest(f.last, o.end_ms) ELSE o.end_ms END,
    CASE WHEN o.start_ms - f.last <= 700 AND o.end_ms - f.first <= 30000 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.job_id = f.job_id AND o.n = f.n + 1),
grouped AS (SELECT job_id, CAST(g AS INT) AS chunk_no, min(first) AS start_ms, max(last) AS end_ms FROM f GROUP BY 1, 2)"""


@query("f2_group_spans", f"WITH {_GROUPED} SELECT * FROM grouped")
def f2(spark, d):
    return folds.group_spans(T.spans(spark, d))


@query("f3_chunk_overlap", f"""WITH {_GROUPED} SELECT job_id, chunk_no, greatest(0, start_ms - CASE WHEN start_ms - lag(end_ms) OVER w <= 4000 THEN 2500 ELSE 0 END) AS start_ms,
  end_ms + CASE WHEN lead(start_ms) OVER w - end_ms <= 4000 THEN 2500 ELSE 0 END AS end_ms, start_ms AS own_start_ms, end_ms AS own_end_ms FROM grouped WINDOW w AS (PARTITION BY job_id ORDER BY chunk_no)""")
def f3(spark, d):
    return folds.chunk_overlap(folds.group_spans(T.spans(spark, d)), near=4000)


_KEPT = f"""RECURSIVE {T.SPANS}, o AS (SELECT job_id, start_ms, end_ms, CAST(seq AS VARCHAR) AS text, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, CAST(seq AS VARCHAR)) AS n FROM spans),
f AS (SELECT job_id, n, start_ms, end_ms, text, start_ms AS ps, greatest(-1, end_ms) AS pe, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT job_id, n, start_ms, end_ms, text, CASE WHEN k THEN start_ms ELSE ps END, CASE WHEN k THEN greatest(pe, end_ms) ELSE pe END, k FROM (
    SELECT o.*, f.ps, f.pe, NOT (f.pe > 0 AND ((o.end_ms <= f.pe AND o.start_ms < f.pe - 500) OR greatest(0, least(f.pe, o.end_ms) - greatest(f.ps, o.start_ms)) > 0.65 * greatest(1, least(o.end_ms - o.start_ms, f.pe - f.ps)))) AS k
    FROM f JOIN o ON o.job_id = f.job_id AND o.n = f.n + 1)),
kept AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY n) AS idx, start_ms, end_ms, text FROM f WHERE kept)"""


@query("f4_dedupe_overlaps", f"WITH {_KEPT} SELECT * FROM kept")
def f4(spark, d):
    return folds.dedupe_overlaps(T.spans(spark, d).withColumn("text", F.col("seq").cast("string")))


@query("f5_paragraphs", f"""WITH RECURSIVE {T.SEGMENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS n FROM segments),
f AS (SELECT job_id, n, start_ms AS first, end_ms AS last, text AS t, 0 AS p FROM o WHERE n = 1
  UNION ALL SELECT job_id, n, CASE WHEN b THEN start_ms ELSE first END, greatest(last, end_ms), CASE WHEN b THEN text ELSE t || text END, CASE WHEN b THEN p + 1 ELSE p END FROM (
    SELECT o.job_id, o.n, o.start_ms, o.end_ms, o.text, f.first, f.last, f.t, f.p, o.start_ms - f.last > 1500 OR o.start_ms - f.first > 60000 OR length(f.t) > 240 AS b FROM f JOIN o ON o.job_id = f.job_id AND o.n = f.n + 1))
SELECT job_id, CAST(p AS INT) AS paragraph, min(first) AS start_ms, arg_max(t, n) AS text FROM f GROUP BY job_id, p""")
def f5(spark, d):
    return folds.paragraphs(T.segments(spark, d))


@query("f6_sentence_groups", f"""WITH RECURSIVE {T.SEGMENTS}, o AS (SELECT job_id, idx, text, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS n, trim(text) <> '' AND length(text) <= 300 AND idx % 5 <> 0 AS j FROM segments),
f AS (SELECT job_id, idx, n, j, 0 AS g, 1 AS size, length(text) AS total, j AND NOT (right(trim(text), 1) = '.' AND length(text) % 2 = 0 OR length(text) >= 700) AS open FROM o WHERE n = 1
  UNION ALL SELECT job_id, idx, n, j, g, size, total, j AND NOT (e OR size >= 6 OR total >= 700) FROM (
    SELECT o.job_id, o.idx, o.n, o.j, CASE WHEN o.j AND f.open THEN f.g ELSE f.g + 1 END AS g, CASE WHEN o.j AND f.open THEN f.size + 1 ELSE 1 END AS size, CASE WHEN o.j AND f.open THEN f.total ELSE 0 END + length(o.text) AS total,
      right(trim(o.text), 1) = '.' AND length(o.text) % 2 = 0 AS e FROM f JOIN o ON o.job_id = f.job_id AND o.n = f.n + 1))
SELECT job_id, idx, CAST(g AS INT) AS group_no, CAST(size AS INT) AS place, j AS grouped FROM f""")
def f6(spark, d):
    # turns end in full stops; every second one stands for a row that goes on
    s = T.segments(spark, d).withColumn("text", F.when(F.length("text") % 2 == 1, F.regexp_replace("text", r"\.$", ",")).otherwise(F.col("text"))).withColumn("cached", F.col("idx") % 5 == 0)
    return folds.sentence_groups(s, chars=700, row_chars=300, ends=".")


@query("f7_narration_units", f"""WITH RECURSIVE {T.SEGMENTS}, o AS (SELECT job_id, idx, start_ms, end_ms, trim(t) AS b, length(t) + 1 AS size, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS n FROM (SELECT *, CASE WHEN length(text) % 3 > 0 THEN regexp_replace(text, '\\.$', ',') ELSE text END AS t FROM segments)),
p AS (SELECT *, coalesce(regexp_matches(lag(b) OVER w, '[.!?…。！？]["”’)\\]]*$') OR start_ms - lag(end_ms) OVER w >= 1500, true) AS must FROM o WINDOW w AS (PARTITION BY job_id ORDER BY idx)),
f AS (SELECT job_id, n, 1 AS u, size AS held FROM p WHERE n = 1
  UNION ALL SELECT job_id, n, CASE WHEN k THEN u + 1 ELSE u END, CASE WHEN k THEN size ELSE held + size END FROM (SELECT p.job_id, p.n, p.size, f.u, f.held, p.must OR f.held + length(p.b) > 900 AS k FROM f JOIN p ON p.job_id = f.job_id AND p.n = f.n + 1)),
g AS (SELECT job_id, u, min(idx) AS index, CAST(count(*) AS INT) AS rows, string_agg(b, ' ' ORDER BY idx) FILTER (b <> '') AS text, min(start_ms) AS start_ms, arg_max(end_ms, idx) AS end_ms FROM f JOIN p USING (job_id, n) GROUP BY 1, 2)
SELECT job_id, index, rows, text, CAST(CASE WHEN nxt IS NULL THEN 0 WHEN nxt - end_ms >= 1500 OR regexp_matches(text, '(?:[!?…！？]|\\.\\.\\.)["”’)\\]]*$') THEN 1000 ELSE 420 END AS INT) AS gap_after_ms, start_ms, end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY job_id ORDER BY index) AS nxt FROM g)""")
def f7(spark, d):
    s = T.segments(spark, d).withColumn("text", F.when(F.length("text") % 3 > 0, F.regexp_replace("text", r"\.$", ",")).otherwise(F.col("text")))
    return folds.narration_units(s, (420, 1000, False), most=900)


@query("f8_unit_offsets", f"WITH {T.FILES} SELECT job_id, pos AS index, CAST(coalesce(sum(length_ms + gap_ms) OVER (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, CAST(coalesce(sum(length_ms + gap_ms) OVER (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length_ms AS BIGINT) AS end_ms FROM files")
def f8(spark, d):
    return folds.unit_offsets(T.files(spark, d).withColumnRenamed("pos", "index")).select("job_id", "index", "start_ms", "end_ms")


def _unknown(spark, d):
    f = T.files(spark, d)
    return f.select("job_id", F.col("pos").alias("index"), F.repeat(F.col("type"), (F.col("supplier") % 9).cast("int")).alias("text"), F.when(F.col("status") == "F", F.col("length_ms")).alias("length_ms"), "gap_ms", F.lit(20_000).cast("long").alias("total_ms"))


@query("f9_share_unknown_lengths", f"""WITH {T.FILES}, u AS (SELECT job_id, pos AS index, greatest(1, supplier % 9) AS w, CASE WHEN status = 'F' THEN length_ms END AS l, gap_ms FROM files),
s AS (SELECT *, greatest(0, 20000 - coalesce(sum(l) OVER j, 0) - sum(gap_ms) OVER j) AS rest, sum(CASE WHEN l IS NULL THEN w END) OVER j AS weight FROM u WINDOW j AS (PARTITION BY job_id))
SELECT job_id, index, coalesce(l, CAST(round_even(rest * w / weight, 0) AS BIGINT)) AS length_ms FROM s""")
def f9(spark, d):
    return folds.share_unknown_lengths(_unknown(spark, d)).select("job_id", "index", "length_ms")


@query("f10_build_cues", f"""WITH {T.SEGMENTS}, {_pieces(84)}, p AS (SELECT *, end_ms - start_ms AS len FROM pieces),
u AS (SELECT job_id, idx, end_ms - start_ms AS len, coalesce(sum(end_ms - start_ms + 300) OVER (PARTITION BY job_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM segments),
s AS (SELECT p.job_id, p.idx, p.piece, p.n, p.text, u.since, u.len, CAST(round_even(u.len * length(p.text) / sum(length(p.text)) OVER (PARTITION BY p.job_id, p.idx), 0) AS BIGINT) AS part FROM p JOIN u ON u.job_id = p.job_id AND u.idx = p.idx),
e AS (SELECT *, since + coalesce(sum(part) OVER (PARTITION BY job_id, idx ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s),
t AS (SELECT *, CASE WHEN piece = n - 1 THEN since + len ELSE a + part END AS b, lead(a) OVER (PARTITION BY job_id ORDER BY idx, piece) AS nxt FROM e),
c AS (SELECT *, CASE WHEN b >= a + 1000 THEN b ELSE greatest(b, least(a + 1000, coalesce(nxt, a + 1000))) END AS z FROM t),
k AS (SELECT job_id, idx, piece, a, z, text, length(text) AS m, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) = ' ') AS sp FROM c WHERE z > a),
l AS (SELECT *, list_sort(list_transform(sp, lambda i: [abs((i - 1) * 2 - m), i]))[1][2] AS mid FROM k)
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY idx, piece) AS INT) AS cue_no, CAST(a AS BIGINT) AS start_ms, CAST(z AS BIGINT) AS end_ms, CASE WHEN m > 42 AND mid IS NOT NULL THEN substr(text, 1, mid - 1) || chr(10) || substr(text, mid + 1) ELSE text END AS text FROM l""")
def f10(spark, d):
    s = T.segments(spark, d)
    return folds.build_cues(s.select("job_id", F.col("idx").alias("index"), "text", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"), F.lit(300).alias("gap_ms")))


@query("f11_rolling_context", f"""WITH {T.SEGMENTS}, s AS (SELECT job_id, idx, CASE WHEN idx % 3 = 0 THEN '' ELSE text END AS text FROM segments)
SELECT job_id, idx, right(coalesce((SELECT string_agg(b.text, '' ORDER BY b.idx) FROM s b WHERE b.job_id = a.job_id AND b.idx < a.idx), ''), 512) AS context FROM s a""")
def f11(spark, d):
    s = T.segments(spark, d).withColumn("text", F.when(F.col("idx") % 3 == 0, "").otherwise(F.col("text")))
    return folds.rolling_context(s).select("job_id", "idx", "context")


@query("f12_contiguous_prefix", f"WITH {T.FILES} SELECT job_id, pos FROM files a WHERE NOT EXISTS (SELECT 1 FROM files b WHERE b.job_id = a.job_id AND b.pos <= a.pos AND b.type = 'R')")
def f12(spark, d):
    return folds.contiguous_prefix(T.files(spark, d).withColumn("idx", F.col("pos")).withColumn("done", F.col("type") != "R")).select("job_id", "pos")


@query("f13_assign_numbers", f"""WITH {T.JOBS}, j AS (SELECT *, CASE WHEN id % 4 = 0 THEN id + 5 END AS no FROM jobs), m AS (SELECT scope, max(no) AS m FROM j GROUP BY 1)
SELECT id, coalesce(no, coalesce(m, 0) + row_number() OVER (PARTITION BY j.scope, no IS NULL ORDER BY created_at, id)) AS workflow_no FROM j JOIN m USING (scope)""")
def f13(spark, d):
    return folds.assign_numbers(T.jobs(spark, d).withColumn("workflow_no", F.when(F.col("id") % 4 == 0, F.col("id") + 5))).select("id", "workflow_no")


@query("f14_chunk_rows", f"WITH {T.DOC_LINES} SELECT job_id, line AS idx, CAST(floor((row_number() OVER (PARTITION BY job_id ORDER BY line) - 1) / 10) AS INT) AS chunk_no FROM doc_lines WHERE trim(value) <> ''")
def f14(spark, d):
    return folds.chunk_rows(T.doc_lines(spark, d).withColumnRenamed("line", "idx").withColumnRenamed("value", "text"), 10).select("job_id", "idx", "chunk_no")


@query("f15_attempt_cutoff", f"WITH {T.FILES} SELECT job_id, pos FROM files a WHERE NOT EXISTS (SELECT 1 FROM files b WHERE b.job_id = a.job_id AND b.pos < a.pos AND b.type = 'R')")
def f15(spark, d):
    return folds.attempt_cutoff(T.files(spark, d).withColumn("attempt_no", F.col("pos")).withColumn("final", F.col("type") == "R")).select("job_id", "pos")


@query("f16_lru_keep", f"""WITH {T.FILES}, e AS (SELECT job_id % 100 AS scope, created_at AS used_at, job_id || '-' || pos AS name, size FROM files),
r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (PARTITION BY scope ORDER BY used_at DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM e WINDOW w AS (PARTITION BY scope ORDER BY used_at DESC, name))
SELECT scope, name, size FROM r WHERE n <= 300 AND b <= 20000000""")
def f16(spark, d):
    e = T.files(spark, d).select((F.col("job_id") % 100).alias("scope"), F.col("created_at").alias("used_at"), F.concat_ws("-", F.col("job_id").cast("string"), F.col("pos").cast("string")).alias("name"), "size")
    return folds.lru_keep(e, most_bytes=20_000_000, most=300).select("scope", "name", "size")


@query("f17_last_state", f"""WITH {T.TRANSITIONS} SELECT job_id, step, arg_max(state, tm) AS state, CAST(sum(CASE WHEN state = 'RUNNING' THEN 1 ELSE 0 END) AS BIGINT) AS attempt, CAST(greatest(sum(CASE WHEN state = 'RUNNING' THEN 1 ELSE 0 END) - 1, 0) AS BIGINT) AS retry_count FROM transitions GROUP BY 1, 2""")
def f17(spark, d):
    return folds.last_state(T.transitions(spark, d))


@query("f17_first_unfinished", f"""WITH {T.TRANSITIONS}, l AS (SELECT job_id, step, arg_max(state, tm) AS state FROM transitions GROUP BY 1, 2) SELECT job_id, min(CASE WHEN state <> 'COMPLETED' THEN step END) AS next_step FROM l GROUP BY 1""")
def f17b(spark, d):
    return folds.first_unfinished(folds.last_state(T.transitions(spark, d)), ["S0", "S1", "S2", "S3"])


@query("f18_phase_view", f"""WITH {T.JOBS}, c AS (SELECT id AS job_id, status, id % 10 AS done, CASE WHEN status = 'F' THEN 5 WHEN id % 5 = 0 THEN 4 WHEN id % 3 = 0 THEN 3 WHEN id % 2 = 0 THEN 2 ELSE 1 END AS cur, CASE WHEN status = 'P' THEN 'PENDING' ELSE 'RUNNING' END AS st FROM jobs),
p AS (SELECT *, unnest([1, 2, 3, 4]) AS phase FROM c), s AS (SELECT *, CASE WHEN phase < cur THEN 'COMPLETED' WHEN phase = cur AND st <> 'PENDING' THEN st ELSE 'PENDING' END AS state FROM p)
SELECT job_id, CAST(phase AS INT) AS phase, state, CASE WHEN state = 'COMPLETED' THEN 100.0 WHEN state = 'PENDING' THEN 0.0 WHEN phase = 3 THEN 100.0 * done / 10 END AS progress FROM s""")
def f18(spark, d):
    j = T.jobs(spark, d)
    state = F.when(F.col("status") == "F", "COMPLETED").when(F.col("status") == "P", "PENDING").otherwise("RUNNING")
    rows = j.select(F.col("id").alias("job_id"), F.when(F.col("id") % 5 == 0, "MERGING").otherwise("OTHER").alias("status"), state.alias("state"), (F.col("id") % 2 == 0).alias("has_vad"), (F.col("id") % 3 == 0).alias("has_chunks"), (F.col("id") % 10).alias("chunks_done"), F.when((F.col("id") % 3 == 0), 10).alias("chunks_total"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("long").alias("processed_ms"))
    return folds.phase_view(rows)


@query("f19_failure_history", f"""WITH {T.TRANSITIONS}, e AS (SELECT job_id, seq % 50 AS idx, tm, step FROM transitions WHERE state = 'FAILED'), r AS (SELECT DISTINCT job_id, seq % 50 AS idx FROM transitions WHERE state = 'COMPLETED' AND seq % 3 = 0)
SELECT job_id, idx, count(*) AS failure_count, arg_max(step, tm) AS detail FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.job_id = e.job_id AND r.idx = e.idx) GROUP BY 1, 2""")
def f19(spark, d):
    t = T.transitions(spark, d).withColumn("idx", F.col("seq") % 50)
    return folds.failure_history(t.filter("state = 'FAILED'").select("job_id", "idx", F.col("at").alias("failed_at"), F.col("step").alias("detail")), t.filter("state = 'COMPLETED' AND seq % 3 = 0"))


# Sorts and limits


@query("g1_history", f"WITH {T.JOBS} SELECT id, name, status FROM jobs WHERE contains(lower(id || ' ' || name), '1-urg') AND status = 'F' ORDER BY created_at DESC, id LIMIT 25 OFFSET 25")
def g1(spark, d):
    j = T.jobs(spark, d).withColumn("workflow_no", F.col("id")).withColumn("url", F.lit(None).cast("string"))
    page, _ = relations.history(j, "1-URG", "F", "newest", 2, 25)
    return page.select("id", "name", "status")


@query("g1_history_total", f"WITH {T.JOBS} SELECT count(*) AS total FROM jobs WHERE contains(lower(id || ' ' || name), '1-urg')")
def g1b(spark, d):
    j = T.jobs(spark, d).withColumn("workflow_no", F.col("id")).withColumn("url", F.lit(None).cast("string"))
    return relations.history(j, "1-URG")[1]


def _places(df, *value: str):
    """Where a row comes in its job as the rows are given out; those of equal `value` share the first place."""
    given = df.withColumn("_given", F.monotonically_increasing_id())
    numbered = given.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy("_given")))
    return numbered.withColumn("place", F.min("_n").over(Window.partitionBy("job_id", *value)))


@query("g2_merge_sorted", f"WITH {T.SPANS} SELECT job_id, seq, start_ms, end_ms, rank() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms)::INT AS place FROM spans")
def g2(spark, d):
    return _places(relations.merge_sorted(T.spans(spark, d)), "start_ms", "end_ms").select("job_id", "seq", "start_ms", "end_ms", "place")


@query("g3_latest_errors", f"WITH {T.TRANSITIONS} SELECT job_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY tm DESC, seq DESC) AS n FROM transitions WHERE state = 'FAILED') WHERE n <= 10")
def g3(spark, d):
    return relations.latest_errors(T.transitions(spark, d).filter("state = 'FAILED'").withColumn("failed_at", F.col("at")), 10).select("job_id", "seq")


@query("g4_top_names", f"WITH {T.FILES}, c AS (SELECT supplier AS job_id, CAST(size % 97 AS VARCHAR) AS source, count(*) AS count FROM files GROUP BY 1, 2) SELECT job_id, source, count FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY count DESC, source) AS n FROM c) WHERE n <= 40")
def g4(spark, d):
    c = T.files(spark, d).groupBy(F.col("supplier").alias("job_id"), (F.col("size") % 97).cast("string").alias("source")).agg(F.count("*").alias("count"))
    return relations.top_names(c)


@query("g5_first_pending", f"WITH {T.JOBS} SELECT scope, id FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY created_at, id) AS n FROM jobs WHERE status = 'P' OR (status = 'O' AND id % 2 = 0)) WHERE n = 1")
def g5(spark, d):
    j = T.jobs(spark, d).withColumn("auto_paused", F.col("id") % 2 == 0).withColumn("status", F.when(F.col("status") == "P", "PENDING").when(F.col("status") == "O", "PAUSED").otherwise("DONE"))
    return relations.first_pending(j)


@query("g6_manifest_order", f"WITH {T.FILES} SELECT job_id, pos AS index, length_ms, rank() OVER (PARTITION BY job_id ORDER BY pos)::INT AS place FROM files")
def g6(spark, d):
    units = relations.manifest_order(T.files(spark, d).withColumnRenamed("pos", "index"))
    return _places(units, "index").select("job_id", "index", "length_ms", "place")


# Sets


@query("h1_union_runs", f"WITH {T.JOBS} SELECT id, CASE WHEN id % 2 = 0 THEN 'w' ELSE 't' END AS kind FROM jobs WHERE id % 2 = 0 OR id % 3 = 0")
def h1(spark, d):
    j = T.jobs(spark, d).select("id")
    return relations.union_runs(j.filter("id % 2 = 0").withColumn("kind", F.lit("w")), j.filter("id % 3 = 0").withColumn("kind", F.lit("t")))


@query("h2_same_ids", f"WITH {T.SEGMENTS} SELECT job_id, idx, 'missing' AS side FROM segments WHERE idx % 4 = 0 UNION ALL SELECT job_id, idx + 100, 'extra' FROM segments WHERE idx = 1")
def h2(spark, d):
    s = T.segments(spark, d).select("job_id", "idx")
    return relations.same_ids(s, s.filter("idx % 4 <> 0").union(s.filter("idx = 1").select("job_id", F.col("idx") + 100)))


@query("h3_merge_glossaries", f"WITH {T.FILES} SELECT job_id, type AS source, CASE WHEN bool_or(status = 'F') THEN 'F' ELSE 'O' END AS target FROM files GROUP BY 1, 2")
def h3(spark, d):
    f = T.files(spark, d).select("job_id", F.col("type").alias("source"), F.col("status").alias("target"))
    return relations.merge_glossaries(f.filter("target = 'F'"), f.filter("target = 'O'"))


@query("h4_keep_latest_output", f"WITH {T.FILES} SELECT job_id, pos FROM files WHERE NOT (type = 'A' AND job_id % 2 = 0)")
def h4(spark, d):
    f = T.files(spark, d).withColumn("step", F.col("type"))
    return relations.keep_latest_output(f, f.filter("type = 'A' AND job_id % 2 = 0").select("job_id", "step").distinct()).select("job_id", "pos")


@query("h5_voice_catalog", "WITH v AS (SELECT p_name AS name, max(p_brand) AS brand FROM part GROUP BY 1), n AS (SELECT c_mktsegment AS name, 'c' AS brand FROM customer GROUP BY 1), b AS (SELECT * FROM n UNION ALL SELECT * FROM v WHERE name NOT IN (SELECT name FROM n)) SELECT name, brand, name = 'BUILDING' AS is_default FROM b")
def h5(spark, d):
    v = T.read(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.max("p_brand").alias("brand"))
    c = T.read(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("c").alias("brand")).distinct()
    return relations.voice_catalog("BUILDING", v, c)


@query("h6_initial_card", f"WITH {T.FILES}, g AS (SELECT job_id, type AS name, max(status) AS t FROM files GROUP BY 1, 2), c AS (SELECT job_id, type AS name FROM files WHERE pos = 2) SELECT coalesce(g.job_id, c.job_id) AS job_id, coalesce(g.name, c.name) AS name, CASE WHEN c.name IS NOT NULL THEN 'sheet' ELSE coalesce(g.t, '') END AS target, CASE WHEN c.name IS NOT NULL THEN 'male' ELSE 'unknown' END AS gender FROM g FULL JOIN c ON g.job_id = c.job_id AND g.name = c.name")
def h6(spark, d):
    f = T.files(spark, d)
    g = f.groupBy("job_id", F.col("type").alias("source")).agg(F.max("status").alias("target"))
    return relations.initial_card(g, f.filter("pos = 2").select("job_id", F.col("type").alias("source"), F.lit("sheet").alias("target"), F.lit("male").alias("gender")))


# Streams: the tables are read as streams to their end, and the result is what the stream has written


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table as a stream; event times become timestamps."""
    s = spark.readStream.schema(T.read(spark, d, name).schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")  # a pattern may match a file or a folder
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def _run(writer, spark: SparkSession) -> None:
    """Run a stream's writer over what is there now, with its state in a folder that store.clear() knows."""
    writer.option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream appends to a table in the shared folder."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    _run(stream.writeStream.format("parquet").option("path", out), spark)
    return spark.read.schema(stream.schema).parquet(out)


def _complete(stream: DataFrame) -> DataFrame:
    """What a stream in complete mode holds at its end; each batch writes it anew."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    _run(stream.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)), spark)
    return spark.read.schema(stream.schema).parquet(out)


def _kept(stream: DataFrame, keys: list[str]):
    """The keyed table that a stream in update mode keeps."""
    from ..streaming import streams, tables

    spark = stream.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    table = tables.KeyedTable(spark, new_path(spark, "kept"), keys, schema, 8)
    _run(streams.upsert_writer(stream, table), spark)
    return table


def _parts(spark: SparkSession, rows: DataFrame, name: str, part, n: int) -> DataFrame:
    """Rows as a stream of n files in order of `part`, a file for each batch."""
    path = new_path(spark, name)
    for k in range(n):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _as_transitions(e: DataFrame) -> DataFrame:
    state = F.create_map(*[F.lit(x) for kv in T.STATES.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("user_id").alias("job_id"), F.concat(F.lit("S"), (F.col("event_id") % 4).cast("string")).alias("step"), "ts", F.col("event_id").alias("seq"), state.alias("state"), F.col("value").alias("percent"))


@query("i1_ordered_release", "SELECT conv_id AS job_id, turn + 1 AS idx, text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn <= c.turn AND b.turn = 5 AND b.conv_id % 3 = 0)")
def i1(spark, d):
    from ..streaming import streams

    s = _stream(spark, d, "conversations").filter("NOT (turn = 5 AND conv_id % 3 = 0)")
    return _drained(streams.ordered_release(s.select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).alias("idx"), "text")))


@query("i2_stream_speech_intervals", f"""WITH {T.SPANS}, m AS (SELECT job_id, seq, CASE WHEN event_type IN ('view', 'signup') THEN start_ms ELSE -1 END AS s, CASE WHEN event_type IN ('click', 'view') THEN end_ms ELSE -1 END AS e FROM spans),
g AS (SELECT *, coalesce(sum(CASE WHEN e >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM m),
o AS (SELECT *, last_value(CASE WHEN s >= 0 THEN s END IGNORE NULLS) OVER (PARTITION BY job_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM g)
SELECT job_id, seq, coalesce(o, greatest(0, e - 30000)) AS start_ms, e AS end_ms FROM o WHERE e >= 0 AND e > coalesce(o, greatest(0, e - 30000))""")
def i2(spark, d):
    from ..streaming import streams

    e = _stream(spark, d, "events")
    at = F.floor((F.unix_millis("ts") - 1704067200000) / 100).cast("long")
    end = at + F.floor(F.col("value") * 40).cast("long")
    s = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("view", "signup"), at).otherwise(-1).alias("start_ms"), F.when(F.col("event_type").isin("click", "view"), end).otherwise(-1).alias("end_ms"))
    return _drained(streams.stream_speech_intervals(s))


@query("i3_stream_pronouns", "SELECT conv_id AS job_id, count(*) AS n, CAST(0 AS BIGINT) AS differ FROM conversations GROUP BY 1")
def i3(spark, d):
    """Rows come in no order and are released, then rewritten, in one query; rows of each job, and how many differ from the batch form."""
    from ..operators import address
    from ..streaming import streams

    said, people = _said(spark, d), _people(spark, d)
    rows = _parts(spark, said, "pronouns-in", F.pmod(F.xxhash64("idx"), 3), 3)
    sheets = people.groupBy("job_id").agg(F.collect_list(F.struct(*[c for c in people.columns if c != "job_id"])).alias("people"))
    opened = _parts(spark, sheets, "pronouns-sheets", F.pmod("job_id", F.lit(2)), 2)
    got = _drained(streams.stream_pronouns(streams.ordered_release(rows), opened, "survival"))
    want = address.rewrite_pronouns(said, people, "survival").select("job_id", "idx", F.struct("text", "changes").alias("want"))
    both = got.join(want, ["job_id", "idx"], "full")
    return both.groupBy("job_id").agg(F.count("*").alias("n"), F.sum((~F.struct("text", "changes").eqNullSafe(F.col("want"))).cast("long")).alias("differ"))


@query("i4_stream_moderate", f"""WITH {_REPLACED} SELECT job_id, idx, CASE WHEN job_id % 2 = 0 THEN text ELSE replace(before, 'the', '(t+)') END AS text,
  CAST(CASE WHEN job_id % 2 = 0 THEN len(h) ELSE len(string_split(before, 'the')) - 1 END AS BIGINT) AS n_hits, 1 + job_id % 2 AS snapshot_id FROM replaced""")
def i4(spark, d):
    """Jobs open with one of two versions of the rules, and again with the other, which changes nothing for them."""
    from ..streaming import streams

    first = T.read(spark, d, "conversations").select(F.col("conv_id").alias("job_id")).distinct()
    opens = first.select("job_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select("job_id", (1 + (F.col("job_id") + F.col("n")) % 2).alias("snapshot_id"), "n")
    opened = _parts(spark, opens, "opens", F.col("n"), 2)
    versions = [(i, s, t, 1) for i, s, t in RULES] + [("x1", "the", "(t+)", 2)]
    rules = new_path(spark, "rules")
    spark.createDataFrame(versions, "rule_id string, source string, replacement string, snapshot_id long").write.partitionBy("snapshot_id").parquet(rules)
    s = T.segments(spark, d).select("job_id", "idx", "text")
    out = new_path(spark, "moderated-out")
    _run(streams.stream_moderate(_parts(spark, s, "moderate-in", F.pmod("idx", F.lit(3)), 3), opened, rules, out), spark)
    got = spark.read.schema("job_id long, idx long, text string, snapshot_id long, hits array<string>").parquet(out)
    return got.select("job_id", "idx", "text", F.size("hits").cast("long").alias("n_hits"), "snapshot_id")


def _progress(spark, d, whole: bool = False):
    from ..streaming import streams

    t = _as_transitions(_stream(spark, d, "events"))
    return _kept(streams.stream_progress(t.withColumn("percent", F.floor("percent").cast("double")) if whole else t), ["job_id", "step"])


@query("i5_stream_progress", f"WITH {T.TRANSITIONS} SELECT job_id, step, max(tm) AS ts, arg_max(state, tm) AS state, arg_max(percent, tm) AS percent FROM transitions GROUP BY 1, 2")
def i5(spark, d):
    return _progress(spark, d).read()


@query("i5_job_progress", f"""WITH {T.TRANSITIONS}, l AS (SELECT job_id, step, arg_max(state, tm) AS state, arg_max(floor(percent), tm) AS percent FROM transitions GROUP BY 1, 2)
SELECT job_id, CASE WHEN bool_or(state <> 'COMPLETED' AND percent IS NULL) THEN NULL ELSE round_even(avg(CASE WHEN state = 'COMPLETED' THEN 100.0 ELSE percent END), 2)::DOUBLE END AS progress FROM l GROUP BY 1""")
def i5b(spark, d):
    from ..streaming import streams

    return streams.job_progress(_progress(spark, d, whole=True))


@query("i6_stream_throughput", """WITH w AS (SELECT user_id AS job_id, value, ts, unnest([0, 600, 1200]) AS back FROM events), s AS (SELECT job_id, value, make_timestamp((epoch_us(ts) // 600000000) * 600000000 - back * 1000000) AS start FROM w)
SELECT job_id, start, start + INTERVAL 1800 SECONDS AS "end", sum(value) AS amount, count(*) AS n FROM s GROUP BY 1, 2""")
def i6(spark, d):
    from ..streaming import streams

    e = _stream(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("value").alias("amount"))
    return _kept(streams.stream_throughput(e, "30 minutes", "10 minutes"), ["job_id", "start"]).read()


@query("i7_stale_heartbeats", """WITH g AS (SELECT user_id AS job_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY job_id ORDER BY ts) AS k FROM g)
SELECT job_id, min(ts) AS first, max(ts) AS last, max(ts) + INTERVAL 3600 SECONDS AS stale_at, count(*) AS beats FROM s GROUP BY job_id, k""")
def i7(spark, d):
    from ..streaming import streams

    return _complete(streams.stale_heartbeats(_stream(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts"), "3600 seconds", late=None))


@query("i8_incremental_apply", f"WITH {_KEYED} SELECT job_id, idx, fingerprint, text || '?' AS output FROM keyed JOIN segments USING (job_id, idx)")
def i8(spark, d):
    """Half of the rows have outputs, a third of which are of other texts; the table ends with one of every row's own text."""
    from ..streaming import streams

    _, old = _keyed(spark, d)
    table = streams.checkpoint_table(spark, new_path(spark, "checkpoints"), 8)
    table.upsert(old, 0)
    s = _stream(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.lit("translation").alias("stage"), (F.col("turn") + 1).alias("idx"), F.sha2("text", 256).alias("fingerprint"), "text")
    made = lambda df: df.select("job_id", "stage", "idx", "fingerprint", F.concat("text", F.lit("?")).alias("output"))
    _run(streams.incremental_apply(s, table, made, first_epoch=1), spark)
    return table.read().select("job_id", "idx", "fingerprint", "output")


_STREAK = f"""{T.TRANSITIONS}, r AS (SELECT job_id, seq AS idx, state NOT IN ('FAILED', 'PAUSED', 'RUNNING') AS ok FROM transitions),
s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY idx) AS run FROM r), n AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, run ORDER BY idx) AS n FROM s)"""


@query("i9_streak_guard", f"WITH {_STREAK} SELECT job_id, min(idx) AS idx FROM n WHERE n = 3 AND NOT ok GROUP BY job_id")
def i9(spark, d):
    from ..streaming import streams

    t = _as_transitions(_stream(spark, d, "events"))
    return _drained(streams.streak_guard(t.select("job_id", F.col("seq").alias("idx"), (~F.col("state").isin("FAILED", "PAUSED", "RUNNING")).alias("ok")), 3))


@query("i9_streak_guard_batch", f"WITH {_STREAK} SELECT job_id, min(idx) AS idx FROM n WHERE n = 3 AND NOT ok GROUP BY job_id")
def i9b(spark, d):
    from ..streaming import streams

    t = T.transitions(spark, d)
    return streams.streak_guard_batch(t.select("job_id", F.col("seq").alias("idx"), (~F.col("state").isin("FAILED", "PAUSED", "RUNNING")).alias("ok")), 3)


# A caller's model


@query("j1_map_batches", f"WITH {T.SEGMENTS} SELECT job_id, idx, CASE WHEN trim(text) = '' THEN '' ELSE text || '!' END AS output FROM segments")
def j1(spark, d):
    from ..operators import model

    s = T.segments(spark, d).select("job_id", "idx", "text")
    return model.map_batches(s, lambda texts: [t + "!" for t in texts]).select("job_id", "idx", "output")


@query("j2_map_groups", f"""WITH {T.SEGMENTS} SELECT job_id, idx, CASE WHEN job_id % 3 <> 0 THEN trim(regexp_replace(text || '!', '\\s+', ' ', 'g')) END AS output FROM segments""")
def j2(spark, d):
    """Groups whose job is divisible by three come back without a marker, and their rows are left for another try."""
    from ..operators import model

    g = T.segments(spark, d).groupBy("job_id", F.floor((F.col("idx") - 1) / 3).cast("int").alias("group_no")).agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("r"))
    marked = F.transform("r", lambda x: F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("LOSE "), x["text"])).otherwise(x["text"]))
    g = g.select("job_id", "group_no", F.transform("r", lambda x: x["idx"]).alias("ids"), marked.alias("texts"))
    reply = lambda t: "lost" if "LOSE " in t else t.replace("</s", "!</s")
    good, bad = model.map_groups(g, lambda texts: [reply(t) for t in texts])
    return good.select("job_id", "idx", "output").unionByName(bad.select("job_id", "idx", F.lit(None).cast("string").alias("output")))


_LOST = "CASE WHEN job_id % 3 = 0 THEN 'LOSE ' || text ELSE text END"


@query("j2_map_groups_fallback", f"""WITH {T.SEGMENTS} SELECT job_id, idx, CASE WHEN job_id % 3 <> 0 THEN trim(regexp_replace(text || '!', '\\s+', ' ', 'g')) ELSE {_LOST} || '?' END AS output, job_id % 3 = 0 AS alone FROM segments""")
def j2b(spark, d):
    """Rows of groups that come back without a marker are sent again, each on its own."""
    from ..operators import model

    g = T.segments(spark, d).groupBy("job_id", F.floor((F.col("idx") - 1) / 3).cast("int").alias("group_no")).agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("r"))
    marked = F.transform("r", lambda x: F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("LOSE "), x["text"])).otherwise(x["text"]))
    g = g.select("job_id", "group_no", F.transform("r", lambda x: x["idx"]).alias("ids"), marked.alias("texts"))
    reply = lambda t: "lost" if "LOSE " in t else t.replace("</s", "!</s")
    done, _, _ = model.map_groups_with_fallback(g, lambda texts: [reply(t) for t in texts], [lambda t, seed: "" if len(t) % 2 else t + "?", lambda t, seed: t + "?"])
    return done.select("job_id", "idx", "output", "alone")


@query("j3_with_retries", f"WITH {T.SEGMENTS} SELECT job_id, idx, text || '?' AS output, CAST(length(text) % 2 AS INT) AS attempt FROM segments")
def j3(spark, d):
    from ..operators import model

    s = T.segments(spark, d).select("job_id", "idx", "text")
    done, _ = model.with_retries(s, [lambda t, seed: "" if len(t) % 2 else t + "?", lambda t, seed: t + "?"])
    return done.select("job_id", "idx", "output", "attempt")


@query("j4_translate_chunks", f"WITH {T.SEGMENTS}, c AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1) / 3) AS INT) AS chunk_no FROM segments WHERE trim(text) <> '') SELECT job_id, idx, chunk_no, trim(text) || '/' || CASE WHEN chunk_no = 0 THEN 0 ELSE 2 END AS output, false AS flagged FROM c")
def j4(spark, d):
    from ..operators import model

    s = T.segments(spark, d).select("job_id", "idx", F.trim("text").alias("text"))
    done = model.translate_chunks(s, lambda rows, before: {r["idx"]: f"{r['text']}/{len(before)}" for r in rows}, 3, 2)
    return done.select("job_id", "idx", "chunk_no", "output", "flagged")


@query("j4_translate_chunks_card", f"""WITH {T.SEGMENTS}, c AS (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1) // 3 AS k FROM segments WHERE trim(text) <> ''),
f AS (SELECT job_id, k, list_prepend('seed', list('c' || i) OVER (PARTITION BY job_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS card FROM (SELECT job_id, k, min(idx) AS i FROM c GROUP BY 1, 2)),
o AS (SELECT c.job_id, idx, c.k, text || '/' || array_to_string(coalesce(card, ['seed'])[-3:], '+') || '/' || least(2, 3 * c.k) AS t FROM c JOIN f ON c.job_id = f.job_id AND c.k = f.k)
SELECT job_id, idx, CAST(k AS INT) AS chunk_no, CASE WHEN idx % 4 = 0 THEN trim(regexp_replace(t, '\\s+', ' ', 'g')) ELSE trim(t, ' ' || chr(9) || chr(10) || chr(13)) END AS output, idx % 4 = 0 AS flagged FROM o""")
def j4b(spark, d):
    """Each chunk answers with the names on its card, and puts its own first row on it for the next one."""
    from ..operators import model

    s = T.segments(spark, d).select("job_id", "idx", "text")
    people = s.select("job_id").distinct().select("job_id", F.lit("seed").alias("source"), F.lit("S").alias("target"), F.lit(None).cast("string").alias("gender"))
    cards = relations.initial_card(people.drop("gender"), people.limit(0))

    def reply(rows, before, card):
        names = "+".join(c["name"] for c in card)
        return {"rows": [{"id": r["id"], "text": f"{r['text']}/{names}/{len(before)}", "ok": r["id"] % 4 != 0} for r in rows], "characters": [{"name": f"c{rows[0]['id']}"}], "billed": len(rows)}

    done = model.translate_chunks_with_card(s, cards, reply, new_path(spark, "chunks"), 3, 2, 3)
    return done.select("job_id", "idx", "chunk_no", "output", "flagged")


@query("j5_split_text_sql", f"WITH {T.SEGMENTS}, {_pieces(40)} SELECT job_id, idx, piece, text FROM pieces")
def j5(spark, d):
    from ..functions import tables

    tables.register(spark)
    return spark.sql("SELECT s.job_id, s.idx, t.piece, t.text FROM {s} s, LATERAL split_text(s.text, 40) t", s=T.segments(spark, d))


@query("j5_split_source_sql", f"WITH {_PARTS} SELECT job_id, idx, CAST(part - 1 AS INT) AS part, text FROM cuts WHERE part > 0")
def j5b(spark, d):
    from ..functions import tables

    tables.register(spark)
    return spark.sql("SELECT s.job_id, s.idx, t.part, t.text FROM {s} s, LATERAL split_source(s.text, 120) t", s=T.segments(spark, d))


@query("j5_ngrams_sql", f"WITH {T.SEGMENTS}, g AS (SELECT job_id, substr(text, i, 4) AS gram FROM (SELECT job_id, text, unnest(range(1, length(text) - 2)) AS i FROM segments)) SELECT job_id, gram, count(*) AS n FROM g GROUP BY 1, 2")
def j5c(spark, d):
    from ..functions import tables

    tables.register(spark)
    return spark.sql("SELECT s.job_id, t.gram, count(*) AS n FROM {s} s, LATERAL ngrams(s.text, 4) t GROUP BY 1, 2", s=T.segments(spark, d))


@query("j6_overall_progress_sql", f"WITH {T.FILES} SELECT job_id, CASE WHEN bool_or(gap_ms % 50 = 0) THEN NULL ELSE round_even(avg(CASE WHEN status = 'F' THEN 100.0 ELSE gap_ms % 100 END), 2)::DOUBLE END AS progress FROM files GROUP BY job_id")
def j6(spark, d):
    from ..functions import tables

    tables.register(spark)
    percent = F.when(F.col("gap_ms") % 50 != 0, F.when(F.col("status") == "F", 100.0).otherwise((F.col("gap_ms") % 100).cast("double")))
    return spark.sql("SELECT job_id, overall_progress(percent) AS progress FROM {f} GROUP BY job_id", f=T.files(spark, d).select("job_id", percent.alias("percent")))


@query("j6_rule_counts", f"WITH {_REPLACED} SELECT job_id, CAST(sum(len(list_filter(h, lambda x: x = 'the'))) AS BIGINT) AS r1, CAST(sum(len(list_filter(h, lambda x: x = 'é'))) AS BIGINT) AS r7, CAST(sum(len(list_filter(h, lambda x: x = 'a.b'))) AS BIGINT) AS r4 FROM replaced GROUP BY 1")
def j6b(spark, d):
    done = rewrite.replace_terms(T.segments(spark, d), "text", RULES)
    counts = done.groupBy("job_id").agg(relations.rule_counts(F.col("hits"), [r[0] for r in RULES]).alias("c"))
    return counts.select("job_id", *[F.col("c")[r].alias(r) for r in ("r1", "r7", "r4")])


# Names and forms of address over turns whose words stand for names and pronouns


_STANDS = {"the": "他", "and": "她", "of": "张倩倩", "der": "李强", "la": "倩倩"}


def _word(w: str) -> str:
    """A word that no letter, digit or underscore of ASCII touches, in SQL's sense of a word boundary."""
    return rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"


def _said(spark, d) -> DataFrame:
    text = F.col("text")
    for word, sign in _STANDS.items():
        text = F.regexp_replace(text, _word(word), sign)
    target = F.regexp_replace(F.regexp_replace("text", _word("the"), "anh ấy"), _word("and"), "cô ấy")
    return T.segments(spark, d).select("job_id", "idx", text.alias("text_zh"), target.alias("text_vi"))


_SAID = r"""said AS (SELECT conv_id AS job_id, turn + 1 AS idx, text, len(regexp_extract_all(text, '\bthe\b')) AS he, len(regexp_extract_all(text, '\band\b')) AS she, regexp_matches(text, '\b(of|la)\b') AS f, regexp_matches(text, '\bder\b') AS m,
  regexp_matches(text, '\bof\b') AS full_name, replace(regexp_replace(regexp_replace(text, '\bthe\b', 'anh ấy', 'g'), '\band\b', 'cô ấy', 'g'), 'en', 'cô ấy ') AS vi FROM conversations)"""
_ALONE = r"(^|[^\p{L}\p{M}\p{N}_])"


def _people(spark, d) -> DataFrame:
    from ..operators import address

    people = [("a", "张倩倩", ["张倩倩", "倩倩"], "x", "female", "antagonist", "peer", "", "", False, False), ("b", "李强", ["李强"], "y", "male", "friend", "peer", "", "", False, False)]
    names = [f.split(" ")[0] for f in address.CHARACTER.split(", ")]
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    sheet = F.array(*[F.struct(*[value(v).alias(n) for n, v in zip(names, p)]) for p in people])
    jobs = T.read(spark, d, "conversations").select(F.col("conv_id").alias("job_id")).distinct()
    return jobs.select("job_id", F.inline(sheet))


@query("c5_rewrite_pronouns")
def c5(spark, d):
    from ..operators import address

    return address.rewrite_pronouns(_said(spark, d), _people(spark, d), "survival")


@query("c6_repair_source_pronouns")
def c6(spark, d):
    from ..operators import address

    return address.repair_source_pronouns(_said(spark, d).withColumnRenamed("text_zh", "text"), _people(spark, d))


_CUT = """SELECT job_id, idx, before, CASE WHEN NOT regexp_matches(fixed, '(?i)tion|sion') OR n > 80 THEN fixed WHEN regexp_matches(g, '[^\\s，,。．.！!？?、；;：:…“”"''‘’（）()]') THEN
    CASE WHEN contains('。！？!?…，,', right(fixed, 1)) AND NOT contains('。！？!?…，,', right(ltrim(g, '，,。 '), 1)) THEN ltrim(g, '，,。 ') || right(fixed, 1) ELSE ltrim(g, '，,。 ') END ELSE '' END AS text
  FROM (SELECT *, regexp_replace(fixed, '(?i)tion[.?]?|sion[.?]?', '', 'g') AS g FROM fixed)"""
_MARKED = "CASE WHEN idx % 2 = 0 THEN regexp_replace(text, '\\.$', '?') ELSE text END"


def _marked(s: DataFrame) -> DataFrame:
    return s.withColumn("text", F.when(F.col("idx") % 2 == 0, F.regexp_replace("text", r"\.$", "?")).otherwise(F.col("text")))


@query("c2_remove_boilerplate", f"WITH {T.SEGMENTS}, fixed AS (SELECT job_id, idx, {_MARKED} AS before, {_MARKED} AS fixed, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS n FROM segments) SELECT job_id, idx, text FROM ({_CUT}) WHERE text <> before")
def c2(spark, d):
    return rewrite.remove_boilerplate(_marked(T.segments(spark, d)), [r"tion[.?]?|sion[.?]?"])


@query("c3_clean_source", f"WITH {T.SEGMENTS}, fixed AS (SELECT job_id, idx, {_MARKED} AS before, replace(replace(replace({_MARKED}, 'the', 'he'), 'her', 'HER'), 'tion', 'sion') AS fixed, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS n FROM segments) SELECT job_id, idx, text FROM ({_CUT}) WHERE text <> before")
def c3(spark, d):
    return rewrite.clean_source(_marked(T.segments(spark, d)), PAIRS, [r"tion[.?]?", r"sion[.?]?"])


@query("c8_moderate")
def c8(spark, d):
    from ..operators import address

    done = address.moderate(_said(spark, d), RULES, _people(spark, d), "drama")
    return done.select("job_id", "idx", "text_vi", F.col("text_vi_moderated").alias("text"), F.col("address_changes").alias("changes"), F.size("hits").cast("long").alias("n_hits"))


@query("c7_forms", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'hắn' ELSE 'anh ấy' END AS form_third, CASE WHEN c_custkey % 2 = 0 THEN 'mày' ELSE 'anh' END AS form_you FROM customer""")
def c7(spark, d):
    from ..operators import address

    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "antagonist").otherwise("lover").alias("role"), F.lit("male").alias("gender"), F.lit("peer").alias("rank"), F.lit("").alias("third"), F.lit("").alias("you"), F.lit(True).alias("auto"))
    return address.forms(c, "survival").select("id", "form_third", "form_you")


_GIVEN = "abcdefghilmnoprstuvwy"
_SPELLED = "array_to_string(list_transform(string_split({}, ''), lambda x: upper(x)), ' ')"
_TIMES = "((length(text) - length(replace(text, {0}, ''))) // length({0}))"


@query("e2_mine_names", f"""WITH {T.SEGMENTS}, places AS (SELECT job_id, text, unnest(range(1, length(text))) AS i FROM segments),
grams AS (SELECT job_id, substr(text, i, n) AS gram FROM (SELECT *, unnest([2, 3, 4]) AS n FROM places WHERE substr(text, i, 1) IN ('t', 'q') OR substr(text, i, 2) = 'ei') WHERE i + n - 1 <= length(text)),
counts AS (SELECT job_id, gram, count(*) AS c, left(gram, 2) = 'ei' AS double FROM grams WHERE NOT contains(gram, chr(10)) GROUP BY 1, 2),
spelled AS (SELECT *, CASE WHEN double AND length(gram) > 2 THEN CASE WHEN regexp_full_match(substr(gram, 3), '[{_GIVEN}]+') THEN 'EI ' || {_SPELLED.format("substr(gram, 3)")} END
  WHEN left(gram, 1) IN ('t', 'q') THEN CASE WHEN regexp_full_match(substr(gram, 2), '[{_GIVEN}]+') THEN {_SPELLED.format("gram")} END END AS target FROM counts),
found AS (SELECT * FROM spelled WHERE target IS NOT NULL AND c >= 3 AND (double OR (length(gram) <> 4 AND left(gram, 1) <> 'q'))),
taken AS (SELECT job_id, left(gram, k) AS gram, sum(c) AS t FROM (SELECT *, unnest(range(2, length(gram))) AS k FROM found) GROUP BY 1, 2),
own AS (SELECT f.* FROM found f LEFT JOIN taken t ON f.job_id = t.job_id AND f.gram = t.gram WHERE t IS NULL OR c - t >= 3),
whole AS (SELECT o.* FROM own o LEFT JOIN own h ON h.job_id = o.job_id AND length(o.gram) = 3 AND h.gram = left(o.gram, 2) WHERE h.c IS NULL OR h.c < 4 * o.c),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY c DESC, gram) AS n, CASE WHEN double THEN substr(gram, 3) ELSE substr(gram, 2) END AS given FROM whole) WHERE n <= 40),
alone AS (SELECT t.job_id, gram, given, n, sum({_TIMES.format("given")} - {_TIMES.format("gram")}) AS c FROM top t JOIN segments s ON s.job_id = t.job_id AND length(given) >= 2 AND contains(text, given) GROUP BY 1, 2, 3, 4),
aliases AS (SELECT job_id, given, min(n) AS n, arg_min(c, n) AS c FROM alone a WHERE c >= 2 AND NOT EXISTS (SELECT 1 FROM top t WHERE t.job_id = a.job_id AND t.gram = a.given) GROUP BY 1, 2),
both_ AS (SELECT job_id, gram AS source, target, c, n FROM top UNION ALL SELECT job_id, given, {_SPELLED.format("given")}, c, n + 1000 FROM aliases)
SELECT job_id, source, target, CAST(c AS BIGINT) AS count, true AS auto, CAST(row_number() OVER (PARTITION BY job_id ORDER BY length(source) DESC, c DESC, n) AS INT) AS place FROM both_""")
def e2(spark, d):
    from ..operators import names

    given = {c: c.upper() for c in _GIVEN}
    return names.mine_names(T.segments(spark, d).select("job_id", "text"), {"ei": "EI"}, {"t": "T", "q": "Q"}, given, ["q"])


@query("e3_kinship_counts", f"""WITH {T.SEGMENTS}, n AS (SELECT job_id, CAST(sum((length(text) - length(replace(text, 'tion', ''))) // 4 + (length(text) - length(replace(text, 'ung', ''))) // 3) AS BIGINT) AS a, CAST(sum((length(text) - length(replace(text, 'est', ''))) // 3) AS BIGINT) AS b FROM segments GROUP BY 1)
SELECT job_id, 'tion' AS source, a AS n FROM n WHERE a >= 3 UNION ALL SELECT job_id, 'est', b FROM n WHERE b >= 3""")
def e3(spark, d):
    from ..operators import address

    kin = [(["tion", "ung"], "x", "female", "peer", "", ""), (["est"], "y", "male", "peer", "", "")]
    return address.kinship_counts(T.segments(spark, d), kin)


_GENDER = f"""{_SAID}, v AS (SELECT *, 1.5 * (she - he) AS voice FROM said), near AS (SELECT *, voice + coalesce(lead(voice) OVER (PARTITION BY job_id ORDER BY idx), 0) AS score FROM v),
people AS (SELECT job_id, 'a' AS id, 12 AS name_score, coalesce(sum(CASE WHEN f THEN score END), 0) + 12 AS total FROM near GROUP BY 1 UNION ALL SELECT job_id, 'b', -4, coalesce(sum(CASE WHEN m THEN score END), 0) - 4 FROM near GROUP BY 1),
graded AS (SELECT job_id, id, name_score, CASE WHEN total >= 3 THEN 'female' WHEN total <= -3 THEN 'male' END AS gender FROM people)"""


@query("e4_infer_gender", f"WITH {_GENDER} SELECT job_id, id, gender, name_score FROM graded")
def e4(spark, d):
    from ..operators import address

    return address.infer_gender(_people(spark, d), _said(spark, d)).select("job_id", "id", "gender", "name_score")


@query("e5_draft_characters", f"WITH {_GENDER} SELECT job_id, CASE id WHEN 'a' THEN '张倩倩' ELSE '李强' END AS source, CASE id WHEN 'a' THEN '张倩倩,倩倩' ELSE '李强' END AS aliases, gender, 'other' AS role, coalesce(gender = 'female' AND name_score >= 8, false) AS sure FROM graded")
def e5(spark, d):
    from ..operators import address

    said = _said(spark, d)
    found = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("张倩倩", "X"), ("倩倩", "Y"), ("李强", "Z"))])
    return address.draft_characters(said.select("job_id").distinct().select("job_id", F.inline(found)), said).select("job_id", "source", F.array_join("aliases", ",").alias("aliases"), "gender", "role", "sure")


@query("b8_gender_problem", f"WITH {_SAID} SELECT job_id, idx, CASE WHEN he + she = 1 AND NOT full_name AND (he > 0) AND regexp_matches(vi, '{_ALONE}cô ấy($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') THEN 'pronoun genders disagree' END AS problem FROM said")
def b8(spark, d):
    both = F.regexp_replace("text_vi", "en", "cô ấy ")
    return _said(spark, d).select("job_id", "idx", X.gender_problem(F.col("text_zh"), both, F.array(F.lit("张倩倩"))).alias("problem"))


def _whole(text: str, words: str, to: str) -> str:
    """SQL: whole words replaced, twice, since neighbours share the sign between them."""
    once = lambda x: f"regexp_replace({x}, '{_ALONE}({words})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{to}\\3', 'g')"
    return once(once(text))


@query("b9_harmonize_gender", f"WITH {_SAID} SELECT job_id, idx, CASE WHEN he = 1 AND she = 0 THEN {_whole('vi', 'cô ấy', 'anh ấy')} WHEN she = 1 AND he = 0 THEN {_whole('vi', 'anh ấy', 'cô ấy')} ELSE vi END AS text FROM said")
def b9(spark, d):
    return _said(spark, d).select("job_id", "idx", X.harmonize_gender(F.col("text_zh"), F.regexp_replace("text_vi", "en", "cô ấy ")).alias("text"))


@query("b18_apply_glossary", f"WITH {T.SEGMENTS} SELECT job_id, idx, CASE WHEN contains(text, 'der') THEN {_whole('t', 'und|die', 'DER')} ELSE t END AS text FROM (SELECT *, CASE WHEN contains(text, 'the') THEN {_whole('text', 'is|of the|of', 'THE')} ELSE text END AS t FROM segments)")
def b18(spark, d):
    entries = [("the", "THE", ["is", "of", "of the"]), ("der", "DER", ["und", "die"])]
    return T.segments(spark, d).select("job_id", "idx", X.apply_glossary(F.col("text"), F.col("text"), entries).alias("text"))


def _once(text: str, words: str, cue: str) -> str:
    """SQL: the first standalone interjection replaced."""
    return f"regexp_replace({text}, '(?is)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\[])' || '{words}' || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\]])', '\\1{cue}\\2')"


@query("b19_add_cues", f"""WITH {T.SEGMENTS}, t AS (SELECT job_id, idx, regexp_replace(regexp_replace(text, '\\bthe\\b', 'Ha ha', 'g'), '\\bla\\b', 'haizz', 'g') AS x FROM segments), l AS (SELECT *, {_once("x", V.LAUGHS, "[cười]")} AS y FROM t)
SELECT job_id, idx, CASE WHEN x <> y THEN y ELSE {_once("x", V.SIGHS, "[thở dài]")} END AS text FROM l""")
def b19(spark, d):
    said = F.regexp_replace(F.regexp_replace("text", _word("the"), "Ha ha"), _word("la"), "haizz")
    return T.segments(spark, d).select("job_id", "idx", X.add_cues(said).alias("text"))
