import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) rows."""
    return lambda *rows: spark.createDataFrame([doc(*r) for r in rows], DOCS)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables for a query and returns their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.repartition(3).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, white space of all kinds."""
    return docs(
        (None, None, None, None), (1, "", "en", "s"), (2, None, "en", None), (None, "one two three four five", None, "s"), (3, LONG, "en", "s"), (4, LONG, "de", "t"), (5, " \t\n\x0b\x0c\r ", "en", "s"),
        (6, "same text here", "en", "s"), (6, "same text here", "en", "s"), (7, "same text here", "en", "t"), (8, "   Straße ÄÖ \U0001f600 x", "xx", "t"), (8, "other text of id eight", "en", "s"), (9, "a" * 50_000, "en", "s"), (10, "x\x00y \x1f z", "en", "s"),
    )
