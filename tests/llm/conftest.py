"""Rows with every awkward case, and the tokenizer files."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from llm_rows import DOCS, prose  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = prose(1, 40_000)
    near = prose(2, 100)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, 0),
        (3, "   \n\t\n", "en", "a", 6),
        (4, long, "en", "b", len(long)),
        (5, near, "en", "a", len(near)),
        (6, near.upper(), "fr", None, len(near)),
        (7, near + " tail", "fr", "b", 0),
        (7, near + " tail", "fr", "b", 0),
        (8, "don't  stop'S <|endoftext|> İstanbul ΣΑΣ é 你好 😀 x y", "en", "a", 1),
        (9, "a", "de", "c", 1),
        (9, "b", "de", "c", 1),
        (None, "no id here", "en", "a", 1),
        (None, near, "en", "a", 1),
        (10, "line one here\nline two here\nline three here\n\nown", None, "a", 1),
        (11, "start\nline one here\nline two here\nline three here", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clashing = ["kept", "ids", "run", "size", "start", "token", "label", "host", "grp", "score", "n_words", "deleted", "id", "part"]
    return df.withColumns({name: F.lit("extra") for name in clashing}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def byte_bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
