import unicodedata

import pytest
from pyspark.sql import functions as F

from lingolake.functions import jobs as J
from lingolake.functions import text as X
from lingolake.functions import values as V

GIVEN = {"倩": "Thiến", "强": "Cường", "轩": "Hiên", "婉": "Uyển"}
SURNAMES = {"张": "Trương", "李": "Lý", "宋": "Tống"}
COMPOUND = {"欧阳": "Âu Dương"}


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def pairs(spark, values, make):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("a"), F.col("b"))).collect()]


def test_spaces_and_foreign(spark):
    assert column(spark, ["  a　 b\n", None, ""], X.clean_ws) == ["a b", None, ""]
    given = ["Anh ấy tên là 李明 và nói xin chào.", "Lý Minh (李明) đến, 他 cười.", "Xin chào 世界.", "你好世界", None]
    assert column(spark, given, X.strip_foreign) == ["Anh ấy tên là và nói xin chào.", "Lý Minh đến, cười.", "Xin chào.", "…", None]
    assert column(spark, ["你好", "a 你 b"], X.readable) == ["…", "a b"]
    assert column(spark, ["é", None], X.nfc) == ["é", None]


def test_output_problem(spark):
    cases = [("", "a"), ("ok", "a"), ("漢", "a"), ("[Source Text] x", "a"), ("x" * 81, "abc"), ("a\nb", "c"), ("[x] y", "[z] w"), ("<think>", "a")]
    got = pairs(spark, cases, X.output_problem)
    extra = "additional prompt/explanation content"
    assert got == ["empty text or reasoning/control tokens", None, "untranslated Chinese", extra, "output much longer than the source", extra, None, "empty text or reasoning/control tokens"]


def test_genders(spark):
    names = F.array(F.lit("张倩倩"))
    cases = [("可能是和她男朋友在一起吧。", "Có lẽ anh ấy ở với bạn trai của cô ấy."), ("他看她。", "Anh ấy nhìn cô ấy."), ("张倩倩和她。", "Anh ấy và cô ấy.")]
    assert pairs(spark, cases, lambda a, b: X.gender_problem(a, b, names)) == ["pronoun genders disagree", None, None]
    assert pairs(spark, [("她来了。", "Anh ta tới, Cô ấy cười."), ("他和她", "Anh ta, cô ấy")], X.harmonize_gender) == ["Cô ta tới, Cô ấy cười.", "Anh ta, cô ấy"]


def test_cues(spark):
    got = column(spark, ["Ha ha, cô ta thua rồi.", "Haizz, lại nữa.", "Hà Nội và Hải Phòng.", "ha ha haizz"], X.add_cues)
    assert got == ["[cười], cô ta thua rồi.", "[thở dài], lại nữa.", "Hà Nội và Hải Phòng.", "[cười] haizz"]


def test_pieces(spark):
    texts = ["Gió nổi lên. Mây kéo về, trời tối; rồi mưa. " * 12, "x" * 25, "một " + "y" * 23 + " hai", " \n", None, "", "A. B. C. D. E.", "e\u0301" * 9]
    for limit in (10, 25, 84):
        got = column(spark, texts, lambda c: X.split_text(c, limit))
        for text, pieces in zip(texts, got):
            flat = " ".join(unicodedata.normalize("NFC", text or "").split())
            assert all(0 < len(p) <= limit for p in pieces) and "".join(pieces).replace(" ", "") == flat.replace(" ", "")
            assert all(len(a) + 1 + len(b) > limit for a, b in zip(pieces, pieces[1:]) if len(b) < limit)
    assert column(spark, ["x" * 25, "Một câu dài. Hai câu ngắn hơn, nhé. Ba."], lambda c: X.split_text(c, 20)) == [["x" * 20, "x" * 5], ["Một câu dài.", "Hai câu ngắn hơn,", "nhé. Ba."]]
    with_words = column(spark, ["một hai ba bốn năm sáu"], lambda c: X.split_text(c, 11))
    assert with_words == [["một hai ba", "bốn năm sáu"]]


def test_parts_lose_nothing(spark):
    texts = ["一二三，四五六。七八", "没有标点的一行字" * 9, "a, b; c: d " * 8, "", None, "。。。。。。"]
    for limit in (1, 5, 7, 30):
        for text, parts in zip(texts, column(spark, texts, lambda c: X.split_source(c, limit))):
            assert "".join(parts) == (text or "") and all(len(p) <= limit for p in parts)
    assert X.budget_parts("一二三，四五六", 5) == ["一二三，", "四五六"] and X.budget_parts("一，三四五六", 5) == ["一，", "三四五六"] and X.budget_parts("，二三四五六", 5) == ["，二三四五", "六"]
    assert X.budget_parts("aabb", 4, cost=lambda t: 2 * len(t)) == ["aa", "bb"]
    with pytest.raises(ValueError):
        X.budget_parts("ab", 0)


def test_two_lines_of_random_texts(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choices("ab  é𝄞", k=rng.randrange(120))) for _ in range(400)] + ["x" * 60, "a" * 50 + " ", " " * 50, "a b" * 20, None]

    def broken(t):
        spaces = [(abs(2 * i - len(t)), i) for i, c in enumerate(t or "") if c == " "]
        return f"{t[:min(spaces)[1]]}\n{t[min(spaces)[1] + 1:]}" if spaces and len(t) > 42 else t

    assert column(spark, texts, X.two_lines) == [broken(t) for t in texts]


def test_parts_are_found_near_their_length():
    seen = []

    def cost(t):
        seen.append(len(t))
        return len(t) // 3

    text = "một hai, ba. " * 4000
    parts = X.budget_parts(text, 20, cost)
    assert "".join(parts) == text and all(len(x) // 3 <= 20 for x in parts) and max(seen) <= 2 * 63
    assert parts == X.budget_parts(text, 62)  # 62 characters are the most that cost 20


def test_two_lines_and_stamp(spark):
    long_ = "abcdefghij " * 5
    assert column(spark, ["short one", long_.strip()], X.two_lines) == ["short one", "abcdefghij abcdefghij abcdefghij\nabcdefghij abcdefghij"]
    assert column(spark, [4160, 3723599], X.srt_timestamp, "long") == ["00:00:04,160", "01:02:03,599"]


def test_reading(spark):
    got = column(spark, ["张倩倩", "李强", "宋轩", "欧阳婉", "张嘛", "他们", "张"], lambda c: X.reading(c, COMPOUND, SURNAMES, GIVEN))
    assert got[:6] == ["Trương Thiến Thiến", "Lý Cường", "Tống Hiên", "Âu Dương Uyển", None, None]


def test_split_group(spark):
    texts = F.array(F.lit("一"), F.lit("二"), F.lit("三"))
    good = "<target><s1>a b</s1><s2>c</s2><s3>d</s3></target>"
    replies = [good, good.replace("<s2>c</s2>", ""), good.replace("</target>", "<s4>x</s4></target>"), good.replace("a b", "漢"), good.replace("<s2>", "more <s2>")]
    got = column(spark, replies, lambda r: X.split_group(r, texts))
    assert got[0]["values"] == ["a b", "c", "d"] and got[0]["problem"] is None
    assert [g["problem"] for g in got[1:]] == ["missing segment marker", "extra segment marker", "untranslated Chinese", "text outside segment markers"]


def test_terms_and_glossary(spark):
    terms = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in [("张倩倩", "Thiến Thiến"), ("张倩倩", "other"), ("倩倩", "Thiến")]])
    got = column(spark, ["张倩倩来了", "张倩倩和倩倩"], lambda c: X.terms_in(c, terms))
    assert [[t["target"] for t in g] for g in got] == [["Thiến Thiến"], ["Thiến Thiến", "Thiến"]]
    entries = [("甲", "Giáp", ["Giap", "Ông Giap"])]
    assert pairs(spark, [("甲来", "Ông Giap đến, Giapx"), ("乙", "Giap")], lambda a, b: X.apply_glossary(a, b, entries)) == ["Giáp đến, Giapx", "Giap"]
    with pytest.raises(ValueError):
        X.apply_glossary(F.lit(""), F.lit(""), [("a", "x", ["v"]), ("b", "y", ["v"])])


def test_errors(spark):
    cases = [("ModuleNotFoundError", "no module", "DEPENDENCY_MISSING"), ("RuntimeError", "CUDA out of memory", "CUDA_OOM"), ("RuntimeError", "model not found", "MODEL_MISSING"), ("RuntimeError", "YouTube needs cookies", "YOUTUBE_AUTH"), ("RuntimeError", "HTTP 429", "RATE_LIMIT"), ("ValueError", "invalid batch environment", "ENV_CONFIG"), ("KeyError", "x", "STEP_FAILED")]
    got = pairs(spark, [c[:2] for c in cases], lambda a, b: J.classify_error(a, F.lit(None).cast("string"), b, F.lit(None).cast("int")))
    assert got == [c[2] for c in cases]
    assert column(spark, ["see https://a.b/c now\nCookie: abc\nx=yes key=1"], J.redact) == ["see [URL] now\n[Sensitive detail removed]\nx=yes [REDACTED]"]


def test_progress_and_urls(spark):
    df = spark.createDataFrame([(200.0, 100.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(J.percent(F.col("a"), F.col("b"))).collect()] == [100.0, 33.33, None]
    urls = ["https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk&t=1", "http://youtu.be/abcdefghijk", "https://evil.com/watch?v=abcdefghijk", "https://u@youtu.be/abcdefghijk", "https://youtube.com/shorts/abcdefghijk", None]
    assert column(spark, urls, J.valid_video_url) == [True, True, False, False, False, True, False]


def test_rules_are_compared_in_nfc(spark):
    df = spark.createDataFrame([(1, "é", "x"), (2, "e\u0301", "y"), (3, " ", "z"), (4, "a", None), (5, "b", ""), (6, None, "x")], "i int, source string, replacement string")
    got = [r.problem for r in J.validate_rules(df).orderBy("i").collect()]
    assert got == ["duplicate source", "duplicate source", "empty source", "no replacement", None, "empty source"]


def test_sql_functions(spark):
    from lingolake.functions import tables

    tables.register(spark)
    texts = ["Gió nổi lên. Mây kéo về, trời tối; rồi mưa. " * 5, "x" * 25, "", None, "short", "một " + "y" * 23 + " hai"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for limit in (10, 30):
        rows = spark.sql("SELECT d.i, t.piece, t.text FROM {d} d, LATERAL split_text(d.text, {n}) t ORDER BY 1, 2", d=df, n=limit).collect()
        want = column(spark, texts, lambda c: X.split_text(c, limit))
        assert [[r.text for r in rows if r.i == i] for i in range(len(texts))] == want
    assert [tuple(r) for r in spark.sql("SELECT * FROM ngrams('abcd', 3)").collect()] == [(1, "abc"), (2, "bcd")]
    got = spark.sql("SELECT overall_progress(x) FROM VALUES (10.0D), (20.0D) v(x)").first()[0], spark.sql("SELECT overall_progress(x) FROM VALUES (10.0D), (NULL) v(x)").first()[0]
    assert got == (15.0, None)


def test_settings():
    assert J.validate_subtitle_settings(84, 1) == (84, 1.0)
    with pytest.raises(ValueError):
        J.validate_subtitle_settings(10)
    with pytest.raises(ValueError):
        J.validate_style("none")
    assert J.validate_style(None) is None and J.validate_style("rebirth") == V.STYLES["rebirth"]
    assert unicodedata.is_normalized("NFC", "".join(V.MALE_FORMS + V.FEMALE_FORMS))
