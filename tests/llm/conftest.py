from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, source=None):
        full = [(i, t, "en", source[k] if source else f"s{(i or 0) % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        frame = spark.createDataFrame(full, DOCS)
        for name in ("id", "line", "line_no", "words", "kept", "size", "score", "cut", "component_id"):
            frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated and very long texts."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "the same few words here again"), (6, "the same few words here again"),
        (7, "A éß 中文 text, with MANY kinds of Letters!"), (8, "word " * 60000), (None, "a row without id and some words"),
    ]
