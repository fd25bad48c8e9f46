import datetime

import pytest
from pyspark.sql import types as T

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table, with extra columns that clash with the operators' own names."""

    def make(texts, ids=None, extra=False):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
        ddl = DOCUMENT
        if extra:
            rows = [(*r, "x", 7, 0.5, datetime.date(2024, 1, 1)) for r in rows]
            ddl += ", spans string, sequence_id int, score double, n_words date"
        return spark.createDataFrame(rows, T.StructType.fromDDL(ddl))

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"
