"""Status, completeness and lifecycle of transactions and documents.

Every operator takes DataFrames and returns one; the present time is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from sluice.operators.beside import if_few

#: Statuses of documents that no longer count, at which work rests, and that need nothing more.
TECHNICAL = ("DEPRECATED", "DISCARDED")
TERMINAL = ("VALIDATED", "EXPORTED", "FAILED", "PENDING_VALIDATION", "UNRECOGNIZED")
FINISHED = ("VALIDATED", "EXPORTED", "FAILED")

#: The order of processing steps, and two names that the journal uses for steps of the list.
STEPS = (
    "NEWDOC", "DOC_CREATED", "FILEEXTRACTOR", "DOC_EXTRACTED", "DETECT_FILE_TYPE", "UNLOCK_PDF", "OFFICE_CONVERTER", "IMAGECONVERTER",
    "TEXTCONVERTER", "FILE_CONVERTED", "PDF_TRUNCATED", "CAB_READER", "OCR_READER", "OCR_DONE", "DETECT_MULTI_DOC", "DOC_SPLITTER", "AI_DISPATCHED",
    "DISPATCH_DONE", "AI_PROCESSING", "CLASSIFIER", "FIELD_EXTRACTOR", "DATA_EXTRACTED", "VALIDATED", "EXPORTED",
)
STEP_NAMES = {"CLASSIFY": "CLASSIFIER", "EXTRACT": "FIELD_EXTRACTOR"}


def is_active(status: Column) -> Column:
    return ~status.isin(*TECHNICAL)


def active_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(is_active(F.col("status")))


def active_counts(documents: DataFrame) -> DataFrame:
    """Documents in all and active ones for each transaction."""
    return documents.groupBy("transaction_id").agg(F.count("*").alias("n_documents"), F.count_if(is_active(F.col("status"))).alias("n_active"))


def _facts(documents: DataFrame) -> DataFrame:
    s = F.col("status")
    return active_documents(documents).groupBy("transaction_id").agg(
        F.count("*").alias("n_active"),
        F.bool_or(s == "FAILED").alias("any_failed"),
        F.bool_or(~s.isin(*TERMINAL)).alias("any_open"),
        F.bool_and(s == "EXPORTED").alias("all_exported"),
        F.bool_or(s == "PENDING_VALIDATION").alias("any_pending"),
        F.bool_and(s.isin("VALIDATED", "EXPORTED")).alias("all_done"),
    )


def reconciled(transactions: DataFrame, documents: DataFrame) -> DataFrame:
    """Transactions with the status that their active documents imply; documents are aggregated before the join."""
    joined = transactions.join(_facts(documents), "transaction_id", "left")
    status = (
        F.when(F.col("n_active").isNull(), F.col("status"))
        .when(F.col("any_failed"), "FAILED")
        .when(F.col("any_open"), "WORKING")
        .when(F.col("all_exported"), "EXPORTED")
        .when(F.col("any_pending"), "PENDING_VALIDATION")
        .when(F.col("all_done"), "VALIDATED")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("reconciled", status).withColumn("n_active", F.coalesce("n_active", F.lit(0))).drop("any_failed", "any_open", "all_exported", "any_pending", "all_done")


def document_facts(documents: DataFrame) -> DataFrame:
    """All that the board asks of a transaction's documents, in one aggregate: what `reconciled` needs, counts by state, the last change, and the types that active ones carry."""
    s, on = F.col("status"), is_active(F.col("status"))
    any_ = lambda c: F.coalesce(F.bool_or(on & c), F.lit(False))
    return documents.groupBy("transaction_id").agg(
        F.count_if(on).alias("n_active"), any_(s == "FAILED").alias("any_failed"), any_(~s.isin(*TERMINAL)).alias("any_open"), (~any_(s != "EXPORTED")).alias("all_exported"),
        any_(s == "PENDING_VALIDATION").alias("any_pending"), (~any_(~s.isin("VALIDATED", "EXPORTED"))).alias("all_done"),
        F.count_if(on & s.isin("VALIDATED", "EXPORTED")).alias("validated"), F.count_if(on & (s == "PENDING_VALIDATION")).alias("pending"), F.count_if(on & (s == "FAILED")).alias("error"),
        F.max("updated_at").alias("touched_at"), F.collect_set(F.when(on, F.col("doctype"))).alias("have"),
    )


def implied(facts: str = "n_active") -> Column:
    """The status that the facts of active documents imply; without any, the stored one."""
    return (
        F.when(F.coalesce(F.col(facts), F.lit(0)) == 0, F.col("status")).when(F.col("any_failed"), "FAILED").when(F.col("any_open"), "WORKING").when(F.col("all_exported"), "EXPORTED")
        .when(F.col("any_pending"), "PENDING_VALIDATION").when(F.col("all_done"), "VALIDATED").otherwise(F.col("status"))
    )


def in_progress(documents: DataFrame) -> DataFrame:
    return documents.withColumn("in_progress", ~F.col("status").isin(*FINISHED))


def validation_summary(documents: DataFrame) -> DataFrame:
    s = F.col("status")
    return active_documents(documents).groupBy("transaction_id").agg(
        F.count_if(s.isin("VALIDATED", "EXPORTED")).alias("validated"),
        F.count_if(s == "PENDING_VALIDATION").alias("pending"),
        F.count_if(s == "FAILED").alias("error"),
        F.count("*").alias("total"),
    )


def validation_list(documents: DataFrame) -> DataFrame:
    s = F.col("status")
    state = F.when(s.isin("VALIDATED", "EXPORTED"), "validated").when(s == "FAILED", "error").when(s.isin("PENDING_VALIDATION", "DATA_EXTRACTED_AI"), "pending").otherwise("other")
    return active_documents(documents).select("transaction_id", "document_id", state.alias("state"), state.isin("pending", "validated").alias("validatable")).orderBy("document_id")


def completeness(transactions: DataFrame, expected: DataFrame, documents: DataFrame) -> DataFrame:
    """For each transaction of a config that expects types: required types present and missing, optional ones present.

    transactions: transaction_id, config_id; expected: config_id, doctype_id, doctype_name, required. A type is present if an active document
    carries its id, or its name (trimmed, case ignored). A config's types are one list, which is compared with the set of types that the transaction
    carries, so there is no row for each transaction and type.
    """
    carried = active_documents(documents).groupBy("transaction_id").agg(F.collect_set("doctype").alias("have"))
    return compared(transactions.select("transaction_id", "config_id").join(carried, "transaction_id", "left"), expected)


def compared(carried: DataFrame, expected: DataFrame) -> DataFrame:
    """`completeness` for rows transaction_id, config_id and have, the set of types that it carries (null: none)."""
    lists = expected.groupBy("config_id").agg(F.collect_list(F.struct("doctype_id", "doctype_name", "required")).alias("types"))
    rows = carried.select("transaction_id", "config_id", "have").join(if_few(lists), "config_id")
    rows = rows.withColumn("have", F.coalesce("have", F.array().cast("array<string>"))).withColumn("names", F.transform("have", lambda d: F.lower(F.trim(d))))
    there = lambda t: F.array_contains("have", t["doctype_id"]) | F.array_contains("names", F.lower(F.trim(t["doctype_name"])))
    marked = F.transform("types", lambda t: F.struct(t["doctype_name"].alias("name"), t["required"].alias("required"), F.coalesce(there(t), F.lit(False)).alias("present")))
    rows = rows.select("transaction_id", marked.alias("t"))
    named = lambda cond: F.array_sort(F.array_distinct(F.transform(F.filter("t", cond), lambda t: t["name"])))
    out = rows.select(
        "transaction_id", F.size(F.filter("t", lambda t: t["required"])).cast("long").alias("n_required"),
        named(lambda t: t["required"] & t["present"]).alias("present"), named(lambda t: t["required"] & ~t["present"]).alias("missing"), named(lambda t: ~t["required"] & t["present"]).alias("optional"),
    )
    return out.withColumn("complete", (F.col("n_required") == 0) | (F.size("missing") == 0))


def expected_ids(entries: DataFrame) -> DataFrame:
    """Sorted distinct ids of the expected types of each config."""
    return entries.groupBy("config_id").agg(F.array_sort(F.collect_set("doctype_id")).alias("expected"))


def stuck(transactions: DataFrame, documents: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Working transactions whose documents have not been touched for some minutes, and whether each may be deleted."""
    last = documents.groupBy("transaction_id").agg(F.max("updated_at").alias("touched_at"))
    board = reconciled(transactions, documents).join(last, "transaction_id", "left")
    idle = F.coalesce(F.col("touched_at"), F.col("created_at")) < now - F.make_dt_interval(mins=F.lit(minutes))
    is_stuck = (F.col("reconciled") == "WORKING") & idle
    return board.select("transaction_id", "reconciled", is_stuck.alias("stuck"), ((F.col("reconciled") != "WORKING") | is_stuck).alias("deletable"))


def retry_set(documents: DataFrame, key: str = "object_key") -> DataFrame:
    return documents.filter(~F.col("status").isin("VALIDATED", "EXPORTED", *TECHNICAL) & (F.coalesce(F.col(key), F.lit("")) != ""))


def step_rank(step: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STEP_NAMES.items() for x in pair])
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(STEPS) for x in (s, i)])
    return ranks[F.coalesce(names[step], step)]


def step_skips(progress: DataFrame, target: str = "target") -> DataFrame:
    """A step is skipped when the current one comes strictly after it; unknown steps never are."""
    return progress.withColumn("skip", F.coalesce(step_rank(F.col("current")) > step_rank(F.col(target)), F.lit(False)))


def step_journal(marks: DataFrame, *, detail_chars: int = 2_000) -> DataFrame:
    """One row for each run of a step, from start and end marks: transaction_id, process, mark_id, kind, at, ok, detail.

    A start begins a run, and the first end after it closes it; ends without a run and starts that were never closed leave no row, but for the last run of a step, which is still RUNNING.
    """
    steps = Window.partitionBy("transaction_id", "process").orderBy("at", "mark_id")
    numbered = marks.withColumn("run_no", F.sum((F.col("kind") == "start").cast("int")).over(steps.rowsBetween(Window.unboundedPreceding, 0))).filter("run_no > 0")
    when = F.struct("at", "mark_id")
    first_end = lambda c: F.min_by(c, F.when(F.col("kind") == "end", when))
    # at most one start is in a run
    runs = numbered.groupBy("transaction_id", "process", "run_no").agg(
        F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started_at"), first_end("at").alias("ended_at"), first_end("ok").alias("ok"), first_end("detail").alias("detail")
    )
    last = F.max("run_no").over(Window.partitionBy("transaction_id", "process"))
    runs = runs.withColumn("last", F.col("run_no") == last).filter("ended_at IS NOT NULL OR last")
    took = F.greatest(F.lit(0), F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")))
    status = F.when(F.col("ended_at").isNull(), "RUNNING").when(F.col("ok"), "OK").otherwise("ERROR")
    return runs.select(
        "transaction_id", "process", "run_no", "started_at", "ended_at", status.alias("status"), F.when(F.col("ended_at").isNotNull(), F.floor(took / 1000).cast("long")).alias("duration_ms"),
        F.substring(F.when(status == "ERROR", F.col("detail")), 1, detail_chars).alias("detail"),
    )


def advanced(entities: DataFrame, journal: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Entities (transactions or documents) with process and process_time of their last run that went well; failed and running ones move nothing."""
    last = journal.filter("status = 'OK'").groupBy(key).agg(F.max_by(F.struct("process", "ended_at"), F.struct("ended_at", "started_at", "process")).alias("last"))
    moved = entities.join(last, key, "left")
    new = {"process": F.coalesce("last.process", "process"), "process_time": F.coalesce("last.ended_at", "process_time")}
    return moved.withColumns(new).drop("last")


def retention_due(transactions: DataFrame, configs: DataFrame, now: Column, default_days: int = 30) -> DataFrame:
    """Exported transactions (by the status that their documents imply, as `reconciled` gives it) whose time is over; a config's days count if they read as a number from 0 up."""
    days = F.col("retention_days").try_cast("int")
    own = F.when(days >= 0, days)
    joined = transactions.filter((F.col("reconciled") == "EXPORTED") & F.col("exported_at").isNotNull()).join(configs.select("config_id", own.alias("days")), "config_id", "left")
    joined = joined.withColumn("days", F.coalesce("days", F.lit(default_days)))
    return joined.filter(F.col("exported_at") + F.make_dt_interval(days=F.col("days")) < now)


def cascade_delete(tables: dict[str, DataFrame], costs: DataFrame, gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of transactions in `gone`; costs stay, with their id emptied."""
    keys = gone.select("transaction_id").distinct()
    left = {name: t.join(keys, "transaction_id", "left_anti") for name, t in tables.items()}
    marked = costs.join(keys.withColumn("gone", F.lit(True)), "transaction_id", "left")
    return left, marked.withColumn("transaction_id", F.when(F.col("gone").isNull(), F.col("transaction_id"))).drop("gone")


def orphan_prefixes(keys: DataFrame, transactions: DataFrame) -> DataFrame:
    """Folders `__transactions__/<account>/<config>/<transaction>/...` of unknown transactions, with their objects."""
    parts = F.split("key", "/")
    found = keys.filter((F.element_at(parts, 1) == "__transactions__") & (F.size(parts) >= 5)).withColumn("transaction_id", F.element_at(parts, 4))
    folders = found.groupBy(F.concat_ws("/", F.slice(parts, 1, 4)).alias("prefix"), "transaction_id").agg(F.count("*").alias("objects"))
    known = transactions.select(F.col("transaction_id").cast("string").alias("transaction_id")).distinct()
    return folders.join(known, "transaction_id", "left_anti").select("prefix", "objects")


def document_list(documents: DataFrame) -> DataFrame:
    return active_documents(documents).select("transaction_id", "document_id", "status", "doctype")


def lineage(documents: DataFrame) -> DataFrame:
    """Roots (no parent), their children, and whether a parent has been replaced by them."""
    children = documents.filter("parent_id is not null").groupBy(F.col("parent_id").alias("document_id")).agg(F.count("*").alias("children"))
    out = documents.join(children, "document_id", "left")
    return out.select("document_id", F.col("parent_id").isNull().alias("is_root"), F.coalesce("children", F.lit(0)).alias("children"), (F.col("children").isNotNull() & (F.col("status") == "DEPRECATED")).alias("replaced"))


def state_upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest change of each known id wins; a process of null leaves the old one; unknown ids are ignored.

    state: id, status, process. changes: id, status, process, at, change_id (breaks ties).
    """
    order = F.struct("at", "change_id")
    last = changes.groupBy("id").agg(F.max_by("status", order).alias("new_status"), F.max_by("process", F.when(F.col("process").isNotNull(), order)).alias("new_process"))
    return state.join(last, "id", "left").select("id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_process", "process").alias("process"))
