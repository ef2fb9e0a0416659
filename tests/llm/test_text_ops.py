"""Operators that look at each text alone, against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lingolake.llm import bpe, decontaminate, pii, secrets
from lingolake.llm import quality as Q

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = {i: i + 32 for i in range(65, 91)}


def contaminated(text, items):
    words = re.findall(WORD, (text or "").translate(LOW))
    hit, names = set(), set()
    for item, body in items:
        w = re.findall(WORD, (body or "").translate(LOW))
        for i in range(max(1, len(w) - 12) if w else 0):
            part = w[i : i + 13]
            for k in range(len(words) - len(part) + 1):
                if words[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    names.add(item)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("lane", [500, 3])
def test_decontaminate(spark, docs, odd, lane, monkeypatch):
    monkeypatch.setattr(decontaminate, "LANE", lane)
    rng = random.Random(1)
    vocabulary = ["Alpha", "beta", "γάμμα", "delta", "eps-1", "zeta"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), say(rng.choice([3, 12, 13, 14, 20]))) for i in range(12)] + [("n", None), ("e", ""), ("p", "...")]
    texts = [f"{say(rng.randint(0, 30))} {rng.choice(items[:12])[1].upper() if k % 2 else say(30)}! {say(5)}" for k in range(60)] + odd
    bench = spark.createDataFrame(items, "item_id string, text string")
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["__body"])
    made = decontaminate.automaton([b for _, b in items if b])
    near = [x.to_pylist() for x in decontaminate._judged(batch, made, [i for i, b in items if b])]
    rows = decontaminate.find_contamination(docs(texts), bench).collect()
    assert [[list(map(tuple, r.hits)) for r in sorted(rows, key=lambda r: r.doc_id)], [r["items"] for r in sorted(rows, key=lambda r: r.doc_id)]] == [[[(x["start"], x["end"]) for x in h] for h in near[1]], near[2]]
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, names = contaminated(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        found = "".join(texts[r.doc_id][a.start : a.end] for a in r.spans)
        assert len(re.findall(WORD, " ".join((texts[r.doc_id] or "")[a.start : a.end] for a in r.spans).translate(LOW))) == hit or not found
    empty = decontaminate.find_contamination(docs(texts[:3]), bench.limit(0)).collect()
    assert [r.n_hit for r in empty] == [0, 0, 0] and not decontaminate.find_contamination(docs([]), bench).count()


def test_decontaminate_without_ids_and_with_a_large_benchmark(spark, docs):
    bench = spark.createDataFrame([(None, "one two three"), ("a", "three four"), ("b", None)], "item_id string, text string")
    r = decontaminate.find_contamination(docs(["zero one two three four"]), bench).first()
    assert (r.n_hit, r["items"], r.contaminated) == (4, ["a"], True)
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(n))
    many = [(str(i), say(400)) for i in range(2000)]  # 5 MB
    found = decontaminate.find_contamination(docs([say(100), f"{say(50)} {' '.join(many[77][1].split()[30:60])} {say(50)}", many[1999][1]]), spark.createDataFrame(many, "item_id string, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(x.n_hit, x["items"]) for x in found.orderBy("doc_id").collect()] == [(0, []), (30, ["77"]), (400, ["1999"])]


def test_decontaminate_stage(spark, docs, odd, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    table = docs([*odd, item, item]).selectExpr("*", "array('keep') as items", "1 as n_hit")
    kept = decontaminate.drop_contaminated(spark, table, sf_dir)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == list(range(len(odd)))
    assert {(tuple(r["items"]), r.n_hit, r.spans) for r in kept.collect()} == {(("keep",), 1, "y")}
    assert decontaminate.drop_contaminated(spark, table.limit(0), sf_dir).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text) if good(k, m[0])]


BITS = ["1", "2", "9", "255", ".", ".", "@", "-", " ", "+", "(", ")", "a", "b", "x.y", "é", "😀", "\n", "4111 1111 1111 1111", "token", "=", '"', ":", "PASSWORD", "abcdef12", "0123456789abcdef01234567", "AKIA", "QWERTYUIOP123456", "api_key", "_"]


def test_personal_data(docs, odd):
    rng = random.Random(2)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(400)] + odd + ["a@b.c " * 700, "IBAN DE89 3704 0044 0532 0130 00, my ssn 123-45-6789, DE88370400440532013000"]
    for r in pii.find_personal_data(docs(texts)).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.found if s.kind in pii.BASE] == personal(texts[r.doc_id] or "")
    last = max(pii.find_personal_data(docs(texts[-1:], [1]), keep=["doc_id"]).first().found, key=lambda s: s.kind == "iban")
    assert last.text == "DE89 3704 0044 0532 0130 00"
    kinds = [s.kind for s in pii.find_personal_data(docs(texts[-1:])).first().found]
    assert kinds.count("iban") == 1 and kinds.count("ssn") == 1 and not pii.find_personal_data(docs([])).count()


def test_words_on_either_side_confirm(docs):
    rows = {r.doc_id: [s.kind for s in r.found] for r in pii.find_personal_data(docs(["123-45-6789 (SSN)", "ssn: 123-45-6789", "123-45-6789", "123-45-6789" + " x" * 30 + " ssn"])).collect()}
    assert rows == {0: ["ssn"], 1: ["ssn"], 2: [], 3: []}


def test_account_numbers_before_other_words(docs):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00 2024", "GB82WEST12345698765432 A", "NO93 8601 1117 947 X1", "DE89 3704 0044 0532 0130 01 BIC", "DE89370400440532013000X"]
    rows = {r.doc_id: [s.text for s in r.found if s.kind == "iban"] for r in pii.find_personal_data(docs(texts)).collect()}
    assert rows == {0: ["DE89 3704 0044 0532 0130 00"], 1: ["DE89 3704 0044 0532 0130 00"], 2: ["GB82WEST12345698765432"], 3: ["NO93 8601 1117 947"], 4: [], 5: []}


SECRETS = [
    ("assign", r"""(?a:(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def secret_spans(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(SECRETS) for m in re.finditer(p, text) if ok(m)]
    return [x[2] for x in sorted(found)]


def test_secrets_and_ledger(spark, docs, odd):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(300)] + odd + ["-----BEGIN RSA PRIVATE KEY-----"]
    first, ledger = secrets.scan_versions(docs(texts[:200]))
    assert first.count() == 200
    rows, gained = secrets.scan_versions(docs(texts), ledger)
    seen, new = {r.blob for r in ledger.collect()}, [r.blob for r in gained.collect()]
    assert not seen & set(new) and len(set(new)) == len(new)
    assert seen | set(new) == {hashlib.sha256((t or "").encode()).hexdigest() for t in texts}
    for r in rows.collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.found if s.kind in secrets.BASE] == secret_spans(texts[r.doc_id] or "")
    _, again = secrets.scan_versions(docs(texts), ledger.unionByName(gained))
    assert again.count() == 0
    newer = tuple(secrets.Rule(r.kind, 2, r.pattern, r.check, r.needs) if r.kind == "hex" else r for r in secrets.RULES)
    _, rescanned = secrets.scan_versions(docs(texts), ledger.unionByName(gained), rules=newer)
    assert {tuple(r.rules) for r in rescanned.collect()} == {("hex@2",)}


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = {}, set()
    for w in windows:
        count[w] = count.get(w, 0) + 1
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_statistics(docs, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "#", "| ", "a b c d e f g h ", "é\t"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + odd
    for r in Q.judge(docs(texts), Q.Model([], ("a", "é"))).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == statistics(texts[r.doc_id])
        assert r.kept == (not r.base_failed) and r.n_listed == sum(w in ("a", "é") for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))


def test_decision_list(spark, docs):
    good = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(60)]
    bad = [" ".join(f"w{i}###{k}" for k in range(40)) for i in range(60)]
    table = docs(good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(table, labels)
    kept = {r.doc_id for r in Q.judge(table, model).filter("kept").collect()}
    assert kept == set(range(60))
    none = Q.Model([], ())
    assert Q.fit(table, labels.limit(0)) == none and Q.fit(table, labels.filter("quality = 1")) == none
    assert Q.fit(table, labels.drop("toxic")) == model and Q.fit(table.limit(0), labels) == none


def test_toxic_words(spark, docs):
    rng = random.Random(6)
    say = lambda *more: " ".join(rng.sample([*(f"w{chr(97 + rng.randint(0, 25))}x" for _ in range(40)), *more], 40 + len(more)))
    texts = [say("Fiend,", "(ogre)") if k % 4 == 0 else say("friend", "ogres") for k in range(480)] + [None, "", "fiend ogre"]
    table = docs(texts)
    labels = spark.createDataFrame([(k, 1 if k % 3 else None, int(k % 4 == 0)) for k in range(240)] + [(1, 1, None), (481, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(table, labels)
    assert set(model.listed) == {"fiend", "ogre"} and model.rules
    out = {r.doc_id: r for r in Q.judge(table, model).collect()}
    assert all(out[k].kept == (k % 4 > 0) and out[k].n_listed == 2 * (k % 4 == 0) for k in range(480))
    assert not any(out[k].kept for k in (480, 481, 482))
    assert Q.fit(table, labels.filter("toxic = 0")) == Q.Model([], ())


def test_toxic_documents_are_found_on_held_out_labels(spark):
    """A third of the labels is held out; figures by language, of documents that the base test passes."""
    tables = {n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels")}
    known = tables["labels"].groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0
    model = Q.fit(tables["documents"], tables["labels"].filter(~held))
    part = tables["documents"].join(known.filter(held & (F.col("quality") == 1)), "doc_id")
    seen = [r for r in Q.judge(part, model, keep=["doc_id", "lang", "toxic"]).collect() if not r.base_failed]
    share = lambda rows: sum(not r.kept for r in rows) / len(rows)
    figures = {lang: [share([r for r in seen if r.lang == lang and r.toxic == t]) for t in (1, 0)] for lang in ("en", "de", "fr", "es")}
    assert all(toxic >= 0.9 and clean <= 0.03 for toxic, clean in figures.values()), figures


def test_hints(docs):
    """Heads stand for words that go on after them; a word counts once."""
    hinted = ("bad", "awf*", "awful*", "horr*", "él")
    texts = ["Bad badly awf awfu awfully, horrible horr él éla hor", None, ""]
    got = {r.doc_id: r.n_hinted for r in Q.judge(docs(texts), Q.Model([], (), hinted)).collect()}
    assert got == {0: 5, 1: 0, 2: 0}
    assert {r.u for r in docs(["badness"]).selectExpr("text").select(Q.units(F.col("text")).alias("u")).selectExpr("explode(u) as u").collect()} == {"badness", "bad*", "badn*", "badne*", "badnes*"}


def test_a_repeated_id_counts_once(spark, docs):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    twice = docs(["a # b", "z", "c d", None], [1, 1, 2, 2])
    assert Q.fit(twice, labels) == Q.fit(docs(["a # b", "c d"], [1, 2]), labels) == Q.Model([])


def test_bpe(docs, odd):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_str(bpe.vocabulary().decode())
    rng = random.Random(5)
    bits = list("abcXYZ  \n\t\r\x1c\x85  　'stremlvd0129%#€éßñ漢字한😀́​") + ["<|endoftext|>", "'re", "  ", "ing", "tion"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(500)] + odd[:4] + ["a" * 3000, "ab" * 2000, *odd[6:]]
    table = docs(texts)
    for r in bpe.encode(table, bpe.vocabulary()).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in want)
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(want), hashlib.sha256(raw).hexdigest(), raw)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert not bpe.encode(docs([]), bpe.vocabulary()).count()
