"""Integrity rules in place of database constraints: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def not_one_parent(rows: DataFrame, *parents: str) -> DataFrame:
    """Rows that have no parent or more than one."""
    return rows.filter(sum((F.col(p).isNotNull().cast("int") for p in parents), F.lit(0)) != 1)


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is set and has no parent."""
    known = parents.select(F.col(parent_key).alias("__known")).distinct()
    return rows.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__known"), "left_anti")


#: What a definition may say.
METHODS, AUTH_TYPES, ON_FAILURE, TIMEOUTS, DEFAULT_TIMEOUT = ("GET", "POST"), ("none", "header", "query"), ("skip", "error"), (1, 30), 5


def definition_faults() -> Column:
    """What is wrong with an enrichment definition, as an array of codes; missing values are taken as the defaults.

    Columns: name, url, method, auth_type, auth_key, on_failure, timeout_s (text), target (`@doctype:field`), and nth (which of its name it is).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    auth = F.lower(F.coalesce("auth_type", F.lit("none")))
    timeout = F.coalesce(F.col("timeout_s").try_cast("int"), F.lit(DEFAULT_TIMEOUT))
    checks = {
        "name": blank("name"),
        "name_repeated": ~blank("name") & (F.col("nth") > 1),
        "url": ~F.coalesce(F.col("url"), F.lit("")).rlike("^https?://"),
        "method": ~F.upper(F.coalesce("method", F.lit("GET"))).isin(*METHODS),
        "auth_type": ~auth.isin(*AUTH_TYPES),
        "auth_key": auth.isin(*AUTH_TYPES[1:]) & blank("auth_key"),
        "on_failure": ~F.lower(F.coalesce("on_failure", F.lit("skip"))).isin(*ON_FAILURE),
        "timeout": ~timeout.between(*TIMEOUTS),
        "target": ~F.coalesce(F.trim("target"), F.lit("")).rlike(r"^@*\s*[^:\s][^:]*:\s*\S"),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks.items()]), lambda x: x.isNotNull())


def bad_definitions(definitions: DataFrame) -> DataFrame:
    """Definitions with faults. Of equal names all but the first by position are repeats."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("position"))
    return definitions.withColumn("nth", nth).withColumn("faults", definition_faults()).filter(F.size("faults") > 0)
