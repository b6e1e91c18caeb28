"""Documents with every odd case, for all operators of this folder."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double"

ODD = [
    None,
    "",
    " \t\n ",
    "one",
    "one two three",
    "The Quick brown fox\njumps over\n\nthe lazy dog again and again",
    "the quick BROWN fox jumps over the lazy dog again and again",
    "Ünïcode wörds – naïve café 日本語 текст 🙂 don't it's <|endoftext|> x",
    "a b c d e " * 3,
    "#hash $5 & <b> 100% | * pipe " * 4,
    "x" * 3000,
    " ".join(f"w{i % 977}" for i in range(30_000)),
    "same line here\nsame line here\n\nsame line here \nother",
]


def rows_of(texts, source="web"):
    return [(i, t, "en", source if i % 3 else None, len(t or ""), 1, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts; a repeated row, a null id, ids with several texts, and columns named like the operators' own."""
    rows = rows_of(ODD)
    rows += [rows[5], rows[5], (None, "a null id with some words in it, eleven or more of them here", None, "web", 5, None, None), (3, "another text of document three", "en", "web", 9, 0, 0.1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
