import random
import time

import pytest

from lingolake.operators.terms import Terms, match_job_terms


def test_terms_equal_a_plain_search():
    rng = random.Random(2)
    for _ in range(300):
        terms = list({"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))})
        text = "".join(rng.choice("abéc") for _ in range(rng.randint(0, 40)))
        assert sorted(Terms(terms).found(text)) == sorted(t for t in terms if t in text)


@pytest.mark.parametrize("long", [10**9, 5])
def test_lists_by_job(spark, long):
    rng = random.Random(4)
    rows = [(j, i, "".join(rng.choice("abc ") for _ in range(30))) for j in (1, 1, 1, 2, 3) for i in range(20)] + [(1, 99, None), (2, 98, ""), (None, 1, "abc")]
    rows = [(j, k, t) for k, (j, _, t) in enumerate(rows)]
    terms = [(1, "ab"), (1, "ab"), (1, "abc"), (1, "bc a"), (2, "c"), (2, None), (2, ""), (4, "a"), (None, "a")]
    got = match_job_terms(spark.createDataFrame(rows, "job_id long, idx long, text string"), spark.createDataFrame(terms, "job_id long, term string"), long=long)
    want = {(j, k, t) for j, k, text in rows for i, t in terms if j is not None and i == j and t and text and t in text}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_terms_cost_no_more_than_few():
    """Time for a character with 100,000 terms stays within a few times that with ten; testing each would be 10,000 times."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    text = " ".join(word() for _ in range(20_000))
    took = []
    for n in (10, 100_000):
        trie = Terms([word() for _ in range(n)])
        began = time.perf_counter()
        trie.found(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0]
