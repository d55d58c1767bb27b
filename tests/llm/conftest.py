import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

EDGES = "doc_id long, text string, lang string, source string, n_chars long, part string, block string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and white texts, ties, repeated rows, a very long text and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, base, "en", "a", 5, "x", None),
        (2, base, "en", "a", 5, "x", "y"),
        (2, base, "en", "a", 5, "x", "y"),
        (3, base + " tail", None, None, None, None, None),
        (4, None, "en", "b", 0, None, None),
        (5, "", "de", "b", 0, None, None),
        (6, " \t\n", None, "b", 3, None, None),
        (7, "lone", "en", None, 4, None, None),
        (None, "null id text here", "en", "a", 9, None, None),
        (9, "x" * 70_000 + " " + "lang wort " * 3_000, "de", "c", 1, None, None),
        (10, "straße ÉCLAIR 漢字 🙂 \x1c <|endoftext|> don't", "fr", "c", 1, None, None),
    ]
    return spark.createDataFrame(rows, EDGES)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGES)


sys.dont_write_bytecode = True
