import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string"


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, with columns whose names clash with those of results."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en" if t else None, None, len(t or ""), "x", "y") for i, t in zip(ids, texts)], SCHEMA)

    return make


ODD = [None, "", " \n\t ", "a", "\x00", "x" * 20_000, "one two three four five six seven eight\n" * 2_000, "é😀 漢字", "same text here", "same text here"]


@pytest.fixture
def odd():
    return list(ODD)
