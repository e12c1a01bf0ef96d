from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs, nulls included."""

    def build(rows, extra=None):
        columns = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, None, None, None if t is None else len(t)) for i, t in rows]
        frame = spark.createDataFrame(full, columns)
        for name, value in (extra or {}).items():
            frame = frame.withColumn(name, value)
        return frame

    return build
