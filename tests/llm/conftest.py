from __future__ import annotations

import pytest

from tests.conftest import SMALL

#: Columns that a user may have and that operators use inside.
CLASHING = "lang string, source string, n_chars long, d long, row long, score double, n_words long, set_id long, digest binary, bucket int, _norm string, _score double, copies long"

LONG = " ".join(f"w{i % 701} x{i % 13}" for i in range(30_000))


def frame(spark, rows, schema="doc_id long, text string"):
    """Documents with extra columns whose names clash, given as (doc_id, text) pairs."""
    docs = spark.createDataFrame(rows, schema)
    extra = [f"cast(null as {kind}) as {name}" for name, kind in (c.strip().split() for c in CLASHING.split(","))]
    return docs.selectExpr("*", *extra)


def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [
        (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "One"), (6, LONG), (7, LONG),
        (8, "zwei Wörter"), (8, "zwei Wörter"), (9, "ß É 漢字 🙂 ab"), (None, "no id here at all"),
        (None, None), (10, "one two three four five six seven"), (11, "ONE two three four five six seven"),
    ]


@pytest.fixture(scope="session")
def small(spark):
    """The smallest test documents as (doc_id, text) pairs."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in docs.collect()]
