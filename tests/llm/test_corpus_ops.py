"""Operators that weigh documents against each other, against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lingolake.llm import langid, lines, near, sharding
from lingolake.llm import language_model as lm


def removed_lines(rows):
    """Lines that stay of each (doc_id, text): windows of three lines that occur earlier go."""
    first, cut = {}, {}
    for doc, text in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        parts = text.split("\n")
        keys = [x if x.strip(" \t\x0b\x0c\r") else "" for x in parts]
        gone = set()
        for i in range(max(1, len(parts) - 2)):
            w = tuple(keys[i : i + 3])
            if any(w):
                if w in first and first[w] != (doc, i):
                    gone.update(range(i, min(i + 3, len(parts))))
                first.setdefault(w, (doc, i))
        cut[doc] = "\n".join(x for i, x in enumerate(parts) if i not in gone)
    return cut


def test_line_dedup(docs, odd):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", " ", "d"]) for _ in range(rng.randint(1, 12))) for _ in range(150)] + odd
    want = removed_lines(list(enumerate(texts)))
    rows = lines.dedup_lines(docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text == want.get(r.doc_id, texts[r.doc_id])
    assert lines.dedup_lines(docs([])).count() == 0
    twice = docs(["x\ny\nz"] * 3, [7, 7, None])
    assert sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(twice).collect()) == [(0, "x\ny\nz"), (7, ""), (7, "")]


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    for a, b in (({1: 1, 2: 3, 3: 10}, {1: 2, 2: 3, 3: 7, 4: 1}), ({1: 5}, {1: 100}), ({k: 1 for k in range(50)}, {k: 1 + k % 3 for k in range(10, 50)})):
        names = {k: np.uint64(rng.integers(1 << 62)) for k in {*a, *b}}
        found = np.array([names[k] for x in (a, b) for k in x], np.uint64)
        rows, counts = np.repeat([0, 1], [len(a), len(b)]), np.array([*a.values(), *b.values()])
        s = near.signatures(found, rows, counts, 2, 20_000)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in names) / sum(max(a.get(k, 0), b.get(k, 0)) for k in names)
        assert abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 20_000)


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    sizes = [1, 3, 40, 200, 900, 2500]
    found = rng.integers(1 << 62, size=sum(sizes)).astype(np.uint64)
    rows, counts = np.repeat(np.arange(len(sizes)), sizes), rng.integers(1, 5, sum(sizes))
    whole = near.signatures(found, rows, counts, len(sizes), near.BANDS * near.ROWS)
    part = near.signatures(found[rows < 4], rows[rows < 4], counts[rows < 4], 4, near.BANDS * near.ROWS)
    assert (part.view(np.uint64) == whole[:4].view(np.uint64)).all()
    for i in range(len(sizes)):
        mine = rows == i
        alone = near.signatures(found[mine], np.zeros(sizes[i], np.int64), counts[mine], 1, near.BANDS * near.ROWS)
        assert (alone[0].view(np.uint64) == whole[i].view(np.uint64)).all()


def classes(rows):
    texts = {}
    for i, t in rows:
        if w := [x.lower() for x in (t or "").encode().split()]:
            texts.setdefault(tuple(w), []).append(i)
    keys = list(texts)
    bags = [collections.Counter(k[i : i + 5] for i in range(len(k) - 4)) if len(k) > 4 else collections.Counter([k]) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both, most = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if 5 * both >= 4 * most:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for k in range(len(keys)):
        groups[find(k)] += texts[keys[k]]
    return {i: min(g) for g in groups.values() for i in g}


def test_near_duplicates(docs, odd, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = list(odd)
    for _ in range(12):
        base = say(rng.randint(6, 150))
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"z{rng.random()}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    want = classes(rows)
    got = {r.doc_id: r.class_id for r in near.near_classes(docs(texts)).collect()}
    assert len(got) == len(texts) and all(got[i] == i for i in got if i not in want)
    assert {i: got[i] for i in want} == want


def test_large_mixed_buckets_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    monkeypatch.setattr(near, "LARGE", 4, raising=False)
    rng = np.random.default_rng(6)
    words = lambda k: [f"w{k}x{i}" for i in range(100)]
    texts = {i: " ".join(words(i)) for i in range(40)}
    pairs = [(3, 29), (20, 38), (39, 5)]  # the last one lies in the largest class and outside
    for a, b in pairs:
        texts[b] = " ".join([*words(a)[:-1], f"z{b}"])
    brief = rng.integers(1 << 16, size=(40, near.BANDS, near.ROWS)).astype(np.uint16)
    for a, b in pairs:  # alike in all components of one band and in all but one of the others
        brief[b] = brief[a]
        brief[b, 1:, 0] ^= 1
    bands = [[7, *(1000 * i + k for k in range(1, near.BANDS))] for i in range(40)]
    roots = spark.createDataFrame([(i, 0) for i in [*range(10, 18), 39]], "id long, root long")
    member = spark.createDataFrame([(i, bands[i], brief[i].tobytes()) for i in range(40)], "id long, bands array<long>, brief binary")
    buckets = spark.createDataFrame([(7, 0, i) for i in range(40)], "key long, band int, id long")
    table = spark.createDataFrame(list(texts.items()), "id long, text string")
    links = near._cross_links(buckets, roots, member, table).collect()
    assert {(r.a, r.b) for r in links} == {(min(p), max(p)) for p in pairs}


def test_near_stage(spark, docs):
    table = docs(["a b c d e f", "a b c d e f", "A b c d  e f", "", None, "other"], [5, 3, 4, 6, 7, None]).select("doc_id", "text")
    table = table.union(table.filter("doc_id = 3"))
    kept = near.keep_one(spark, table, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == [(0, "other"), (3, "a b c d e f")] and len(kept) == 4
    assert near.near_classes(docs([])).count() == 0


def test_texts_that_share_an_id_are_kept_apart(docs):
    """No text goes but copies of one that stays, whatever ids repeat."""
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    table = docs([a, b, a, b, a, c, None, None, "", c], [1, 1, 2, 3, 1, 4, 4, 4, None, None])
    kept = near.keep_one(None, table, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (1, b), (4, c), (4, ""), (4, ""), (0, ""), (0, c)])
    assert kept[0].__fields__ == table.columns


def test_shards(docs, odd):
    rng = random.Random(3)
    texts = odd + ["hot" * 20] * 300 + ["x" * rng.randint(0, 400) for _ in range(700)]
    rows = sharding.shard_documents(docs(texts), shards=10, rows_per_range=30).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    whole = sum(len((t or "").encode()) + 16 for t in texts)
    assert max(sum(r.size for r in v) for v in by.values()) <= whole / 10 + max(r.size for r in rows)
    assert sharding.shard_documents(docs([])).count() == 0
    even = sharding.shard_documents(docs(["y" * rng.randint(50, 150) for _ in range(4000)]), shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in even]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.012 * sum(sizes) / 8 + 332
    same = sharding.shard_documents(docs(["z"] * 400, [1] * 400), shards=4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in same) == [100] * 4


def test_shards_by_a_sorted_running_sum(docs, odd):
    """Shards and slots against all rows in order: a boundary is within the tolerance, or no row boundary is nearer to its target."""
    rng = random.Random(8)
    texts = odd + ["hot" * 20] * 400 + ["w" * rng.choice([3, 50, 700, 9000]) for _ in range(300)] + [f"t{rng.randint(0, 300)}" for _ in range(500)]
    table = docs(texts, [*range(len(texts) - 60), *[7] * 60])
    order = sorted((r.h, r.d, r.size, r.text_crc32, r.doc_id) for r in sharding.keyed(table).collect())
    for shards, per in ((7, 20), (16, 1000)):
        found = collections.defaultdict(list)
        for r in sharding.shard_documents(table, shards=shards, rows_per_range=per).collect():
            found[r.shard].append((r.slot, r.size, r.text_crc32, r.doc_id))
        flat = [x for k in range(shards) for x in sorted(found[k])]
        assert [x[1:] for x in flat] == [x[2:] for x in order]  # shards one after the other, slots in order, are the sorted table
        assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in found.values())
        sums = np.cumsum([0, *[x[2] for x in order]])
        cut = max(1, -(-len(order) // (shards * per)))
        ends = np.cumsum([len(found[k]) for k in range(shards)])[:-1]
        for i, end in enumerate(ends, 1):
            target = sums[-1] * i / shards
            assert abs(sums[end] - target) <= max(sharding.TOLERANCE * sums[-1] / (shards * cut), abs(sums - target).min())


def test_write_shards(spark, docs, tmp_path):
    table = docs(["abc" * (k % 50) for k in range(200)]).withColumn("shard", F.lit("mine"))
    sharding.write_shards(table, str(tmp_path / "out"), shards=4, rows_per_range=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
    want = sharding.shard_documents(table, shards=4, rows_per_range=10).orderBy("shard", "slot").select("doc_id").collect()
    got = []
    for folder in sorted((tmp_path / "out").glob("shard=*")):
        files = sorted(folder.glob("*.parquet"))
        assert len(files) == 5
        got += [r for f in files for r in spark.read.parquet(str(f)).select("doc_id").collect()]
    assert got == want


def test_language_model(spark, docs, odd):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "cat", "The", "sat", "on", "mat", f"r{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + odd + [None, "new r1 the words new r1", "q1 q2 q1 q2"]
    table = docs(texts)
    tokens = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    train = [i for i in range(len(texts)) if i % 5 != 1]
    known = collections.Counter(w for i in train for w in tokens(texts[i]))
    both = collections.Counter(p for i in train for p in zip(["<s>", *tokens(texts[i])], tokens(texts[i])))
    total, kinds = sum(known.values()), len(known)
    p = lambda w: (known[w] + 0.5) / (total + 0.5 * (kinds + 1))
    times = known + collections.Counter({"<s>": len(train)})

    def p2(v, w):
        if not times[v]:
            return p(w)
        m = lm.SCALE * times[v] ** lm.POWER
        return (both[v, w] + m * p(w)) / (times[v] + m)

    for v in ["<s>", "the", "r5", "nobody"]:
        assert math.isclose(sum(p2(v, w) for w in known) + p2(v, "unknown"), 1, rel_tol=1e-9)
    # all words held in tasks, some, the frequent ones, none; arcs met in tasks or all dealt
    for head, hot in ((lm.HEAD, 2), (lm.HEAD, 10**6), (2e-3, 3), (0.03, 3), (0.9, 10**6)):
        scored, model = lm.language_model_scores(table, F.col("doc_id") % 5 != 1, ["doc_id", "n_words"], head=head, hot=hot)
        assert (model.n, model.v) == (total, kinds) and (hot == 10**6) == (len(model.codes) == 0)
        rows = scored.collect()
        assert len(rows) == len(texts) and {r.n_words for r in rows} == {"x"}
        for r in rows:
            w = tokens(texts[r.doc_id])
            assert (r.n_tokens, r.n_known) == (len(w), sum(known[x] > 0 for x in w))
            assert math.isclose(r.base_score, sum(math.log10(p(x)) for x in w), rel_tol=1e-9)
            assert math.isclose(r.score, sum(math.log10(p2(*x)) for x in zip(["<s>", *w], w)), rel_tol=1e-9)


def test_bigrams_travel_as_arrays(spark, docs, monkeypatch):
    """No row for each bigram: those of a bucket stay arrays up to the task that weighs them, also where batches cut a bucket."""
    rng = random.Random(7)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.randint(0, 80))) for _ in range(60)]
    table = docs(texts + [None])
    plans, write = [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or write(df, name))
    monkeypatch.setattr(lm, "DEALT_BYTES", 500, raising=False)
    got, rows = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        for most in (before, "2"):
            spark.conf.set(rows, most)
            got.append({r.doc_id: r for r in lm.language_model_scores(table, F.col("doc_id") % 5 != 1, ["doc_id"], head=5e-3, hot=4)[0].collect()})
    finally:
        spark.conf.set(rows, before)
    assert len(got[0]) == 61 and got[0].keys() == got[1].keys()
    for k, r in got[0].items():
        assert r[:3] == got[1][k][:3] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(r[3:], got[1][k][3:]))
    scores = [plan for name, plan in plans if name == "lm-scores"]
    assert len(scores) == 2 and not any("Generate" in plan for plan in scores)
    parts = -(-sum(map(len, texts)) // 500)  # tasks grow in number also with texts that are only scored
    assert parts > 4 and all(re.search(rf"RepartitionByExpression \[bucket#\d+\], {parts}\b", plan) for plan in scores)


def test_language_model_without_training_or_rows(docs):
    table = docs(["a b", "a b", None, ""], [1, 1, None, 4])
    scored, _ = lm.language_model_scores(table, F.lit(False))
    rows = scored.collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 3] and all(r.n_known == 0 and abs(r.base_score) + abs(r.score) < 1e-9 for r in rows)
    assert set(scored.columns) == {*table.columns, "n_tokens", "n_known", "base_score", "score"} and {r.text for r in rows} == {"a b", None, ""}
    same = lm.language_model_scores(table, F.lit(True))[0].collect()
    assert len(same) == 4 and len({r.score for r in same if r.text == "a b"}) == 1
    assert lm.language_model_scores(table.limit(0), F.lit(True))[0].count() == 0


def test_held_out_perplexity(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored, _ = lm.language_model_scores(table, lm.training_part(F.col("doc_id"), 1), ["doc_id"])
    held = scored.join(table.filter(~lm.training_part(F.col("doc_id"), 1)).select("doc_id"), "doc_id")
    base, full = held.agg(F.expr("pow(10, -sum(base_score) / sum(n_tokens))"), F.expr("pow(10, -sum(score) / sum(n_tokens))")).first()
    assert full < 0.6 * base


def test_language_id(spark, sf_dir, docs, odd):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(table.filter("doc_id % 5 <> 0"))
    rows = langid.identify(table, model).filter("doc_id % 5 = 0").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in langid.identify(docs(odd + ["123 .,!"]), model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 4, len(odd)))
    assert all(found[i].lang_pred in model.langs for i in (3, 5, 6, 7, 8, 9))
    assert langid.train(table.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs(odd), None).collect()} == {"und"}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, sf_dir), f"test-{name}")
        assert after.columns == columns and 0 < after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    done = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in done.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_pipeline_stages_against_brute_force(spark, docs):
    """A small corpus through the stages that have an exact answer: lines, near copies, encoding; odd rows and clashing names stay whole."""
    from lingolake.llm import bpe
    from lingolake.llm.lines import drop_repeated_lines

    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    header = "licence line one\nlicence line two\nlicence line three"
    texts = [f"{header}\n{say(20)}\n{say(20)}" if k % 3 else say(60) for k in range(60)]
    texts += [texts[1], texts[0] + " tail", header, None, "", "one"]
    table = docs(texts).selectExpr("*", "array('keep') as removed", "7 as rule")
    want = removed_lines([(i, t) for i, t in enumerate(texts) if t])
    stay = {i: want.get(i, t) for i, t in enumerate(texts) if not (want.get(i, t) != t and not (want.get(i) or "").strip())}
    cut = drop_repeated_lines(spark, table, "")
    rows = cut.collect()
    assert cut.columns == table.columns and {r.doc_id: r.text for r in rows} == stay
    assert all((r.removed, r.rule, r.n_words, r.spans) == (["keep"], 7, "x", "y") and r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    found = classes([(i, t) for i, t in stay.items()])
    kept = near.keep_one(spark, cut, "")
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i in stay if found.get(i, i) == i}
    ids = bpe.encode_stage(spark, kept, "")
    assert ids.count() == kept.count() and ids.columns[0] == "doc_id"
    for stage in (drop_repeated_lines, near.keep_one, bpe.encode_stage):
        assert stage(spark, table.limit(0), "").count() == 0


def test_ids_of_other_kinds(spark):
    table = spark.createDataFrame([("a", "x y z"), ("b", "x y z"), (None, "q"), ("a", None)], "doc_id string, text string")
    rows = sharding.shard_documents(table, shards=2).collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {"a", "b", None}
    assert lines.dedup_lines(table).count() == 4
    import pytest

    with pytest.raises(ValueError, match="integer"):
        near.near_classes(table)


def test_aggregates_that_hot_keys_meet_are_tables(docs):
    """What a hot key is joined with is read from a written table, so that Spark can split the join."""
    texts = docs(["a\nb\nc\nd"] * 20 + ["x\ny\nz"])
    plan = lines.later_windows(lines.materialize(lines.occurrences(texts), "t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the one that gathers windows by document, above the join


def test_language_id_repeats_and_calibration(docs):
    texts = ["le chat dort sur la table " * 3, "der hund schläft unter dem tisch " * 3] * 30
    table = docs(texts, [1] * 60).withColumn("lang", F.when(F.col("text").startswith("le"), "fr").otherwise("de"))
    first, again = langid.train(table), langid.train(table.repartition(3))
    assert first.langs == ["de", "fr"] and (first.table == again.table).all()
    rng = np.random.default_rng(3)
    rows = [(np.array([k % 7, 7 + rng.integers(50)]), np.array([3.0, 1.0]), "ab"[(k % 7) > 3] if rng.random() < 0.9 else "ab"[rng.integers(2)]) for k in range(400)]
    model = langid.fit(rows)
    assert 0.2 <= model.temperature <= 20 and 0 <= model.reject <= 1
    # the softmax of the mean of embedded features, by hand
    raw, offsets = langid.utf8(langid.pa.array(["le chat", "", "12"]))
    bucket, row = langid.features(raw, offsets)
    logits = first.table[bucket[row == 0]].mean(0) + first.bias
    e = np.exp((logits - logits.max()) / first.temperature)
    best, p = first.predict(raw, offsets)
    assert math.isclose(p[0], (e / e.sum()).max(), rel_tol=1e-5) and best[0] == int(logits.argmax())
