from __future__ import annotations

import random

import pytest

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa", "vo", "ne") for b in ("n", "r", "st", "pel", "dim", "ga", "")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang): nulls in any column, empty and very long texts, ties and repeated rows."""
    base = prose(60, 1)
    return [
        (1, base, "en"),
        (2, base, "en"),
        (3, base + " extra end", None),
        (4, prose(60, 2), "de"),
        (5, None, "en"),
        (6, "", None),
        (7, " \n\t ", "fr"),
        (8, "one two", "en"),
        (9, "one two", "en"),
        (10, prose(30_000, 3), "en"),
        (None, base, "en"),
        (None, None, None),
        (11, prose(40, 4), "es"),
        (11, prose(40, 4), "es"),
        (12, "日本語 のテキスト 🙂 é̃ x y", "ja"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows, with extra columns whose names the operators use themselves."""
    rows = [(*r, "x", 7, "y", None) for r in odd_rows]
    names = "doc_id long, text string, lang string, source string, start long, rep string, stem string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
