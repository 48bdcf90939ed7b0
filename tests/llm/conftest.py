from __future__ import annotations

import pytest
from pyspark.sql import functions as F

PROSE = (
    "The harbour lay quiet under a grey sky while the boats turned slowly on the tide. "
    "An old man mended nets beside the wall and two children counted gulls.\n"
    "Nobody had expected the ferry before noon. It came at ten, half empty and very loud."
)

#: Columns that documents may have beside the known ones, with names the operators use.
CLASHING = ["row", "words", "lines", "key", "fp", "n", "spans", "block", "size", "queue", "kept"]


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text, lang, source) rows -> documents, with columns of clashing names."""

    def make(*rows):
        schema = "doc_id long, text string, lang string, source string"
        docs = spark.createDataFrame(list(rows), schema)
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
        return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING})

    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    other = PROSE.replace("harbour", "station").replace("boats", "trains").replace("ferry", "express")
    return documents(
        (1, PROSE, "en", "a"),
        (1, PROSE, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, other, "en", None),
        (None, None, None, None),
        (4, " \n\t ", "fr", "b"),
        (5, "\n".join([other] * 400), "en", "b"),
        (6, "x" * 300_000, None, "b"),
        (7, "— 12 * § 🙂", "fr", "c"),
    )


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents().limit(0)
