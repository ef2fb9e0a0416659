import gzip
import hashlib
import base64
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lingolake.llm import resample, shared, spelling, warc

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(texts, shortest=6, least=5, factor=5):
    counts = Counter()
    for id_, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in vocab if one_apart(w, v)] for w in vocab}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= factor * vocab[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), vocab[w], len(near[w]), vocab[form[w]] if form[w] else -1) for w in vocab)


def variants_of(spark, docs, block, **kw):
    vocab = shared.materialize(spelling.vocabulary(docs, **{k: v for k, v in kw.items() if k != "factor"}), "vocabulary")
    found = spelling.variants(vocab, block=block, **kw)
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in found.collect())


@pytest.mark.parametrize("block", [4, 4096])
def test_variants_equal_brute_force(spark, docs, block):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(50)]
    texts = []
    for _ in range(150):
        words = []
        for w in rng.choices(base, [2.0 ** -(k % 12) for k in range(50)], k=60):
            k = rng.random()
            at = rng.randrange(len(w))
            words.append(w[:at] + w[at + 1 :] if k < 0.1 else w[:at] + rng.choice("abÀ") + w[at + (k < 0.2) :] if k < 0.3 else w.upper() if k < 0.4 else w)
        texts.append(rng.choice(["; ", "1", "\n"]).join(words))
    ids = [None, None, *range(148)]
    want = spelled(list(zip(ids, texts)))
    assert sum(r[1] != "" for r in want) > 20
    assert variants_of(spark, docs(texts, ids), block) == want


def test_variants_of_one_hot_group(spark, docs):
    """Most words share their first letters, so that their group is cut into many blocks."""
    words = [f"prefix{a}{b}" for a in "abcdefgh" for b in "abcdefgh"] + ["prefixa", "prefixaaa", "prefix"]
    texts = [" ".join(words)] * 5 + ["prefixaa " * 60]
    assert variants_of(spark, docs(texts), 8) == spelled(list(enumerate(texts)))


def test_variants_of_odd_rows(spark, docs, odd):
    texts = odd + ["x" * 20_000 + " " + "x" * 19_999, "x" * 20_000] * 5
    assert variants_of(spark, docs(texts), 4096) == spelled(list(enumerate(texts)))
    assert variants_of(spark, docs([]), 4096) == []


def test_ties_go_to_the_smaller_word(spark, docs):
    texts = ["abcdef " * 5 + "abcdeg " * 25 + "abcdea " * 25 + "abcdé " * 30]
    assert dict((r[0], r[1]) for r in variants_of(spark, docs(texts, [1]), 4096))["abcdef"] == "abcdea"


def test_root_of_a_long_chain(spark, docs):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    texts = [" ".join([w] * 2 * 3**k) for k, w in enumerate(words)]
    got = variants_of(spark, docs(texts), 4096, least=2, factor=3)
    assert {r[0]: r[2] for r in got} == dict.fromkeys(words, words[-1]) and got == spelled(list(enumerate(texts)), least=2, factor=3)


# importance resampling


def test_composed_checksums():
    rng = random.Random(3)
    parts = [bytes(rng.choices(range(256), k=rng.randint(0, 300))) for _ in range(200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = resample.compose(crc(parts[:-1]), crc(parts[1:]), np.array([len(x) for x in parts[1:]]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]


def runs_of(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


TEXTS = ["The cat, the CAT; Straße 9", "", None, "é" * 300 + " a b", "cat the", "x" * 5000, "一二 three\x00four"]


@pytest.mark.parametrize("entries", [[], ["the", "cat", "straße"], ["a", "b", "the", "four", "一二", "zz"]])
@pytest.mark.parametrize("most", [1, 3])
def test_features_whatever_the_dictionary(entries, most):
    raw, offsets = shared.utf8(pa.array(TEXTS, pa.string()))
    crc, row = resample.features(*resample.Dictionary(entries).payloads(raw, offsets), most)
    got = sorted(zip(row.tolist(), crc.tolist()))
    assert got == sorted((k, zlib.crc32(f.encode())) for k, t in enumerate(TEXTS) for f in runs_of(t, most)[1])


def drawn(rows, target, percent, least, most, buckets):
    s, t = Counter(), Counter()
    for out, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            out.update(zlib.crc32(f.encode()) % buckets for f in runs_of(text, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, fit = [], []
    for k, (id_, text) in enumerate(rows):
        words, feats = runs_of(text, most)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in feats)
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        fit += [k] * (len(words) >= least)
    fit.sort(key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0]))
    for place, k in enumerate(fit[: percent * len(fit) // 100], 1):
        out[k][4] = place
    return out


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 64)])
def test_resample_equals_brute_force(spark, docs, odd, most, buckets):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma", "Δέλτα", "12", "epsilon-zeta"]
    texts = odd + [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    texts += [texts[-1]] * 5
    ids = [None, *range(1, len(texts) - 5), *[len(texts)] * 5]
    target = ["gamma Beta", None, "", "12 12 alpha"]
    bench = docs(target)
    got = resample.resample(docs(texts, ids), bench, percent=40, least=5, most=most, buckets=buckets).collect()
    want = drawn(list(zip(ids, texts)), target, 40, 5, most, buckets)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 40 * sum(len(runs_of(t, 1)[0]) >= 5 for t in texts) // 100 + 1))


def test_resample_of_empty_tables(spark, docs):
    assert resample.resample(docs([]), docs(["a"])).count() == 0
    got = resample.resample(docs(["a b"]), docs([])).first()
    assert tuple(got)[:2] == (0, 2) and got["rank"] is None


def test_a_dictionary_is_bounded_by_share(spark, docs):
    found = resample.frequent_words(docs(["a A a b " + "c" * 60, "D"]), rare=5, longest=10)
    assert found == ["a"]


# archives

PAGES = "page_id long, url string, html string, record_type string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    for id_, _, html, _ in rows:
        if id_ is not None:
            first[html or ""] = min(id_, first.get(html or "", id_))
    out = []
    for id_, _, html, _ in rows:
        body = html or ""
        refers = first.get(body) if len(body.encode()) >= least and first.get(body) != id_ else None
        out.append((id_, len(body.encode()), sha(body), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def archived(df, split=1 << 20, **kw):
    records = warc.outermost(warc.read_warc(warc.write_warc(df, **kw), split))
    got = records.select(warc.page_of(records.record_id).cast("long"), "payload_bytes", "payload_digest", "record_type", warc.page_of(records.refers_to_id).cast("long"))
    return sorted((tuple(r) for r in got.collect()), key=str)


ROWS = [(3, "http://a/é b?x=1&y=%20", "<p>é</p>", "z"), (1, None, "<p>é</p>", "z"), (2, "u\r\nX: y", None, "z"), (4, "", "", "z"), (None, "n", "<p>é</p>", "z"), (5, "big", "漢字 " * 300_000, "z"), (1, None, "<p>é</p>", "z"), (None, "m", "only null", "z"), (None, "m", "only null", "z"), (6, "o", "one", "z"), (7, "o", "\r\n\r\nWARC/1.1\r\n", "z")]


@pytest.mark.parametrize("split", [97, 4096, 1 << 20])
def test_archive_round_trip(spark, split):
    assert archived(spark.createDataFrame(ROWS, PAGES), split) == expected(ROWS)


def test_short_payloads_are_all_responses(spark):
    assert archived(spark.createDataFrame(ROWS, PAGES), least=5) == expected(ROWS, 5)


def test_small_files_and_payloads(spark):
    rows = [(k, f"http://h/{k}", f"page {k % 40} " * 50, "z") for k in range(200)]
    files = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), file_bytes=3000)
    records = warc.read_warc(files, 1000).collect()
    assert files.count() > 3 and files.agg({"records": "sum"}).first()[0] == 200 and len(records) == 200
    bodies = {r.record_id.split(":")[2]: bytes(r.payload).decode() for r in records if r.record_type == "response"}
    assert bodies == {str(k): rows[k][2] for k in range(40)}
    assert all(r.stated_digest == r.payload_digest and r.target_uri == f"http://h/{r.record_id.split(':')[2]}" for r in records)


def test_files_are_plain_gzip_members(spark):
    file = warc.write_warc(spark.createDataFrame(ROWS[:2], PAGES).coalesce(1)).first().file.removeprefix("file://")
    text = gzip.open(file).read()
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:x-page:1:" in text and text.endswith(b"\r\n\r\n")


def test_ids_of_any_text(spark):
    rows = [("a:b/c+d %é", "u", "x"), ("b", "u", "x"), ("", "u", "y")]
    records = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id string, url string, html string")))
    got = records.select(warc.page_of(records.record_id), warc.page_of(records.refers_to_id)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a:b/c+d %é", None), ("b", "a:b/c+d %é"), (None, None)], key=str)


def one(key, payload):
    return warc.record("response", key, "u", sha(""), None, payload, len(payload))


def test_an_archive_inside_a_record(spark, tmp_path):
    """A stored payload shows the members of the archive in it; ranges that begin there find them, and they go by their place."""
    inner = b"".join(warc.member(one(f"in{k}", b"i" * k)) for k in range(30))
    data = warc.member(one("1", b"a")) + warc.member(one("2", inner), 0) + b"\x1f\x8b\x08 no member" + warc.member(one("3", b"b"))
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = warc.list_warc(spark, str(tmp_path))
    for split in (60, 1000, 1 << 20):
        records = warc.read_warc(files, split)
        assert sorted(r.record_id.split(":")[2] for r in warc.outermost(records).collect()) == ["1", "2", "3"]
    assert warc.read_warc(files, 60).count() > 3


def test_every_member_has_one_owner():
    rng = random.Random(1)
    data, places = b"", []
    for k in range(40):
        places.append(len(data))
        data += warc.member(one(str(k), bytes(rng.choices(range(256), k=rng.randint(0, 500)))), rng.choice([0, 1, 9])) + b"\x1f\x8b\x08\x00" * (k % 3)
    for split in (1, 2, 3, 50, 333, len(data)):
        found = [p for start in range(0, len(data), split) for p, _, _ in warc.members(io.BytesIO(data), len(data), start, min(start + split, len(data)))]
        assert found == places


def test_damaged_members_are_reported():
    data = warc.member(one("1", b"a" * 50_000), 0)
    for bad in (data[:-9], data[:30_000] + b"\xff\xff\xff" + data[30_003:]):
        with pytest.raises(ValueError):
            list(warc.members(io.BytesIO(bad), len(bad), 0, len(bad)))


def test_empty_archive(spark):
    assert archived(spark.createDataFrame([], PAGES)) == []
