"""Tables written by version: whole or not at all, once, with the newest one pointed to.

A version is written to a folder of its own, which nothing points to yet. Then one row is appended to the manifest: that file appears in one step when its job commits, and
the version is there from then on. A writer that dies before leaves a folder that no reader looks at, and the older version stays the latest. Writing a
version that the manifest already has does nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "sequence long, version string, folder string, n_rows long, note string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each version, the latest with the highest sequence; empty where nothing was written yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def commit(df: DataFrame, root: str, version: str, *, partition_by: tuple[str, ...] = (), fmt: str = "parquet", note: str = "") -> bool:
    """Write df as this version and point to it; False if the version is there already, and nothing is written."""
    spark = df.sparkSession
    found = manifest(spark, root).agg(F.max("sequence"), F.coalesce(F.bool_or(F.col("version") == version), F.lit(False))).first()
    if found[1]:
        return False
    folder = f"{root}/data/{version}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).format(fmt).save(folder)
    n = spark.read.schema(df.schema).format(fmt).load(folder).count()
    row = spark.createDataFrame([(1 + (found[0] or 0), version, folder, n, note)], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{root}/manifest")  # one row
    return True


def latest(spark: SparkSession, root: str) -> str | None:
    """The newest version."""
    found = manifest(spark, root).agg(F.max_by("version", "sequence")).first()
    return found[0]


def load(spark: SparkSession, root: str, schema: str, version: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The rows of a version (the latest, if none is named); none before the first."""
    rows = manifest(spark, root)
    found = (rows.filter(F.col("version") == version) if version else rows).agg(F.max_by("folder", "sequence")).first()[0]
    return spark.read.schema(schema).format(fmt).load(found) if found else spark.createDataFrame([], schema)


def load_all(spark: SparkSession, root: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The rows of all versions together."""
    folders = [r.folder for r in manifest(spark, root).select("folder").collect()]  # one a version
    if not folders:
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).format(fmt).load(folders[0])
    for folder in folders[1:]:
        out = out.unionByName(spark.read.schema(schema).format(fmt).load(folder))
    return out
