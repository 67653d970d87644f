import random

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string, ids string, key string"


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7)))
    prose = " ".join(word() for _ in range(120))
    texts = [None, "", " \n\t ", "x", "word " * 3, prose, prose, prose.upper(), prose + " end", " ".join(word() for _ in range(60_000)), "a" * 150_000, "ü日本 é\nü日本 é\n" * 5, "line one here\nline one here\n" * 30]
    rows = [(k, t, "en" if k % 2 else None, None if k == 3 else "s", None, "clash", "clash", "clash", None) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, prose, None, None, None, None, None, None, None), (-7, prose[:200], "en", "s", 3, "c", "c", "c", "c")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


def lower_words(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def shingles(text, n=5):
    w = lower_words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
