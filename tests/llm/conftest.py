from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, root string, score double, topic int,"
    " rate string, copies string, spans string, item_ids string, n_tokens string, weight double, tokens int, mark int, rejected int"
)


def rows(*texts, start=0):
    return [(n, t, "en", "src0", len(t) if t is not None else None, *[None] * 13) for n, t in enumerate(texts, start)]


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty, blank and very long texts, repeated rows and ids, columns with clashing names."""
    texts = (None, "", "   \n\t ", "one", "one two three four", "one two three four", LONG, "...!!!", "Ünï ñ ж 中文", "x" * 50_000)
    data = rows(*texts)
    data += [data[4], (None, "one two three four", None, None, None, *[None] * 13), (None, None, None, None, None, *[None] * 13)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda *texts: spark.createDataFrame(rows(*texts), SCHEMA)
