import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from llm_cases import prose  # noqa: E402

EDGE = [
    (None, "a null id", "en", "s1", 9), (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "   \n\t ", "en", "s1", 6), (4, "one", "en", "s1", 3),
    (5, prose(1, 300), "en", "s1", 0), (5, prose(1, 300), "en", "s1", 0), (6, prose(1, 300), "de", "s2", 0), (7, prose(1, 299) + " other", "de", "s2", 0),
    (8, prose(2, 30_000), "fr", "s2", 0), (9, "\n".join(prose(s, 12) for s in (3, 4, 5, 3)), "fr", None, 0), (10, "é́ \U0001f600 word " + prose(6, 80), None, "s2", 0),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"uid": F.lit("mine"), "KEY": F.lit(1), "line": F.lit("x"), "topic": F.lit("t"), "class": F.lit(2.5), "kept": F.lit(True), "unit": F.lit("u")})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
