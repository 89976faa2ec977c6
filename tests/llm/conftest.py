import random

import pytest

SYLLABLES = {"en": "the an ing tion er st wh on ed re ly".split(), "fr": "la ou eau ment que ch è é ai tre".split(), "de": "sch ein ung keit zu er ü ö ach".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make():
    return sentence


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns with names that operators might use."""
    rng = random.Random(5)
    long_ = sentence(rng, "en", 30_000)
    base = sentence(rng, "en", 60)
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, None, "en"), (4, "", "fr"), (5, " \n\t ", None), (None, base, "en"), (6, long_, "en"),
        (7, "!!! ... ???", "de"), (8, "word", "en"), (9, "word", "en"), (10, sentence(rng, "fr", 50), "fr"), (11, sentence(rng, "de", 50), "de"), (12, "a" * 100_000, "en"), (13, "日本語 テキスト 😀 ́", "ja"),
    ]
    data = [(i, t, k, None if t is None else len(t), "x", 1, "y", 2.0, "z", 3) for i, t, k in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars long, component string, bucket int, t string, token double, `group` string, size int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
