"""Export of validated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources import versions

EXPORTED = "document_id string, payload string, account_id string"


def payloads(documents: DataFrame, indexes: DataFrame) -> DataFrame:
    """JSON of each document: extracted values as indexes, metadata as transaction fields, in order of position."""
    listed = lambda kind, *cols: F.transform(F.array_sort(F.collect_list(F.when(F.col("index_type") == kind, F.struct("position", *cols)))), lambda x: F.struct(*[x[c].alias(c.removeprefix("index_")) for c in cols]))
    grouped = indexes.groupBy("document_id").agg(listed("extracted", "index_name", "index_value", "index_score").alias("indexes"), listed("metadata", "index_name", "index_value").alias("transaction_fields"))
    out = documents.join(grouped.hint("merge"), "document_id", "left")
    body = F.struct(
        F.col("document_id").alias("doc_id"), F.coalesce("doctype", F.lit("")).alias("doctype"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("creation_date"),
        F.coalesce("indexes", F.array()).alias("indexes"), F.coalesce("transaction_fields", F.array()).alias("transaction_fields"),
    )
    return out.select("document_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def pending_writes(documents: DataFrame, listed: DataFrame, prefix: str) -> DataFrame:
    """Documents of which the file or the JSON is not yet among the listed keys."""
    key = F.concat(F.lit(f"{prefix.rstrip('/')}/"), F.col("document_id").cast("string"))
    wanted = documents.withColumn("key", key).select("*", F.explode(F.array(F.concat("key", F.lit(".pdf")), F.concat("key", F.lit(".json")))).alias("object"))
    missing = wanted.join(listed.select(F.col("key").alias("object")).hint("merge"), "object", "left_anti")
    return missing.drop("object").dropDuplicates(["document_id"])


def write_new(documents: DataFrame, root: str, run: str) -> bool:
    """Write the JSON of documents (document_id, payload, account_id) that no earlier run has written, by account; whole or not at all. A run that is started again writes nothing.

    False if this run is there already.
    """
    before = versions.load_all(documents.sparkSession, root, EXPORTED, "json").select("document_id")
    fresh = documents.select(F.col("document_id").cast("string").alias("document_id"), "payload", F.col("account_id").cast("string").alias("account_id"))
    fresh = fresh.join(before.hint("merge"), "document_id", "left_anti").groupBy("document_id").agg(F.max_by("payload", "payload").alias("payload"), F.max_by("account_id", "payload").alias("account_id"))
    return versions.commit(fresh, root, run, partition_by=("account_id",), fmt="json")


def exported(spark, root: str) -> DataFrame:
    """All that runs have written."""
    return versions.load_all(spark, root, EXPORTED, "json")


def gate(documents: DataFrame) -> DataFrame:
    """decision and reason, in order. documents: status, object_key, config_known, complete, override, way_out."""
    s = F.col("status")
    reason = (
        F.when(s == "EXPORTED", "already_exported")
        .when(s != "VALIDATED", F.concat(F.lit("invalid_status:"), s))
        .when(F.coalesce(F.col("object_key"), F.lit("")) == "", "no_file")
        .when(~F.col("config_known"), "unknown_config")
        .when(~F.col("complete") & ~F.col("override"), "incomplete")
        .when(F.coalesce(F.col("way_out"), F.lit("")) == "", "no_way_out")
        .otherwise("")
    )
    decision = F.when(F.col("reason") == "", "export").when(F.col("reason") == "already_exported", "skip").otherwise("refuse")
    return documents.withColumn("reason", reason).withColumn("decision", decision)


def outcome(documents: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Documents after their export, and exported_at of transactions whose active documents all are exported now.

    documents: transaction_id, document_id, status, exported_at (of the transaction). results: document_id, ok.
    """
    done = documents.join(results, "document_id", "left")
    done = done.withColumn("status", F.when(F.col("ok"), "EXPORTED").when(~F.col("ok"), "VALIDATED").otherwise(F.col("status"))).drop("ok")
    active = done.filter(~F.col("status").isin("DEPRECATED", "DISCARDED"))
    whole = active.groupBy("transaction_id").agg(F.bool_and(F.col("status") == "EXPORTED").alias("all_exported"), F.max("exported_at").alias("before"))
    return done.drop("exported_at"), whole.select("transaction_id", F.coalesce("before", F.when(F.col("all_exported"), now)).alias("exported_at"))


def backlog(documents: DataFrame, transactions: DataFrame, configs: DataFrame, most: int = 200) -> DataFrame:
    """Validated documents whose config has a destination, the oldest first; the limit is one sweep's portion."""
    ready = documents.filter("status = 'VALIDATED'").join(transactions.select("transaction_id", "config_id"), "transaction_id").join(configs.filter("way_out <> ''").select("config_id"), "config_id", "left_semi")
    return ready.orderBy("updated_at", "document_id").limit(most)
