"""What follows a label on its line."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs that may stand between a label and its value.
SEPARATORS = " \t:：;,-—–=. "
#: Words of a label: letters and dots.
LABEL = re.compile(r"(?:[^\W\d_]|\.)+")
MOST_WORDS = 4


def rest_of_line(text: str) -> str:
    """The value in what follows a label: without the signs before it, and up to a further `Label :`, whose words are counted back from each colon."""
    value = text.lstrip(SEPARATORS)
    end = value.find(":")
    while end >= 0:
        at, n = len(value[:end].rstrip()), 0
        cut = at
        for word in reversed(value[:end].split()):
            start = value.rindex(word, 0, at)
            if n == MOST_WORDS or not start or not LABEL.fullmatch(word):
                break
            at = len(value[:start].rstrip())
            cut, n = start, n + 1
        if n:
            return value[:cut].strip()
        end = value.find(":", end + 1)
    return value.strip()


def following(text: Column) -> Column:
    """`rest_of_line` of a column."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else rest_of_line(t))

    return rest(text)
