from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows of (doc_id, text)) -> DataFrame with the columns of documents."""
    def make(rows, source="s"):
        full = [(i, t, "en", source, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return make
