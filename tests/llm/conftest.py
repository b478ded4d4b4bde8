import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import ODD  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, path string, spans string, blob string, size long, at int"


def documents_of(spark, texts, start=0):
    """Documents with further columns whose names the operators use themselves; texts may be (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 7, "p", "x", "y", 3, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, start=0: documents_of(spark, texts, start)


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
