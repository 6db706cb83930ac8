"""Fixtures of the operators' tests: tables with every awkward case."""

from __future__ import annotations

import random

import pytest

from tianguis.llm.common import ship_package

LONG = "Thonere wh the " * 20_000
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, n int, node string, kept string, "
           "score string, ids string, key long, slot long, a string, root string")


def doc(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src0", None if text is None else len(text), 7, "x", "y", "z", "w", 3, 4, None, "r")


@pytest.fixture(scope="session")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(shipped):
    """Null ids, texts and languages, empty and blank and very long texts, repeated rows,
    one id with two texts, and extra columns named like those the operators make."""
    rows = [doc(1, None), doc(2, ""), doc(3, " \t\n "), doc(4, LONG), doc(5, "same text here again and again"),
            doc(5, "same text here again and again"), doc(6, "same text here again and again", None), doc(7, "one"),
            doc(7, "another text under the same id"), doc(None, "a text without an id"), doc(None, None, None),
            doc(8, "é ß 漢字 \U0001f600 á"), doc(9, "<|endoftext|> x 1.2.3.4 a@b.co +1 222 333 4444")]
    return shipped.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(shipped):
    return shipped.createDataFrame([(1, 1, 0), (4, 1, 0), (5, None, 1), (5, 0, 0), (None, 1, 1), (999, 1, 1), (8, 1, 0)],
                                   "doc_id long, quality int, toxic int")


def words(rng: random.Random, n: int, size: int = 4000) -> list[str]:
    return [f"w{int(size * rng.random() ** 2)}" for _ in range(n)]
