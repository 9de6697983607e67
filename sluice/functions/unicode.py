"""Unicode normal forms, the one text function that Spark has no expression for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_form(text: Column, form: str = "NFKC") -> Column:
    @F.pandas_udf(T.StringType())
    def normalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalised(text)
