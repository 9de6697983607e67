"""Volumes, costs, durations and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators import status as S

METHODS = ("lexical", "embedding", "llm")
#: What users read for an origin.
ORIGIN_LABELS = {"MAIL": "Mail", "WS": "Web service", "UI_IMPORT": "Upload manuel", "FTP": "FTP", "S3": "S3", "API": "API", "UNKNOWN": "Inconnu", "": "—"}
PERIODS = (7, 30, 365)


def period_days(asked: int | None) -> int:
    return asked if asked in PERIODS else 30


def scoped(rows: DataFrame, *, account: Column | None, now: Column, days: int) -> DataFrame:
    """Rows of a tenant (all, if none is given) created in the last days."""
    kept = rows.filter(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return kept if account is None else kept.filter(F.col("account_id") == account)


def volumes(transactions: DataFrame, documents: DataFrame) -> DataFrame:
    """Transactions by status, and documents by status through their transaction; a blank status is `?`."""
    named = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("?"))
    t = transactions.groupBy(named(F.col("status")).alias("status")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("transaction"))
    d = documents.join(transactions.select("transaction_id"), "transaction_id", "left_semi").groupBy(named(F.col("status")).alias("status")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("document"))
    return t.unionByName(d).select("kind", "status", "n")


def cost_totals(costs: DataFrame) -> DataFrame:
    """Total, by process and by provider, in one pass over the costs."""
    sets = costs.groupingSets([["process"], ["provider"], []], "process", "provider").agg(F.sum("amount_u").alias("amount_u"), F.grouping("process").alias("gp"), F.grouping("provider").alias("gv"))
    kind = F.when(F.col("gp") == 0, "process").when(F.col("gv") == 0, "provider").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("process", "provider", F.lit("")).alias("name"), "amount_u")


def cost_months(costs: DataFrame, months: int = 12) -> DataFrame:
    """The newest months with costs, oldest first."""
    by = costs.groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month")).agg(F.sum("amount_u").alias("amount_u"))
    return by.orderBy(F.desc("year"), F.desc("month")).limit(months).orderBy("year", "month")


def _within(costs: DataFrame, since: Column | None) -> DataFrame:
    return costs if since is None else costs.filter(F.col("created_at") >= since)


def cost_projection(costs: DataFrame, since: Column | None = None, volumes: tuple[int, ...] = (1_000, 5_000, 10_000, 50_000, 100_000)) -> DataFrame:
    """Cost for each document that cost something in the period, and what it comes to at other volumes; the floor leaves out the model's classification.

    costs: document_id (null: of no document; its amount counts all the same), process, source, amount_u, created_at.
    """
    model = (F.col("process") == "CLASSIFY") & F.col("source").startswith("llm_")
    one = _within(costs, since).agg(
        F.count_distinct("document_id").alias("units"), F.coalesce(F.sum("amount_u"), F.lit(0)).alias("amount_u"),
        F.coalesce(F.sum(F.when(model, F.col("amount_u"))), F.lit(0)).alias("model_u"),
    )
    each = F.coalesce(F.try_divide(F.col("amount_u") / 100.0, F.col("units")), F.lit(0.0))
    floor = F.coalesce(F.try_divide((F.col("amount_u") - F.col("model_u")) / 100.0, F.col("units")), F.lit(0.0))
    share = F.coalesce(F.try_divide(100.0 * F.col("model_u"), F.col("amount_u")), F.lit(0.0))
    out = one.withColumn("volume", F.explode(F.array(*[F.lit(v) for v in volumes])))
    return out.select(
        "units", F.round(F.col("amount_u") / 100.0, 4).alias("total"), F.round(each, 5).alias("unit_cost"), F.round(floor, 5).alias("unit_floor"), F.round(share, 1).alias("model_share"),
        "volume", F.round(each * F.col("volume"), 2).alias("projected"), F.round(floor * F.col("volume"), 2).alias("projected_floor"),
    )


def process_averages(costs: DataFrame, since: Column | None = None) -> DataFrame:
    """Each step's cost in the period for each document that cost something in any step; nothing where there is no such document. A step without a name is `?`."""
    found = _within(costs, since)
    by = found.groupBy(F.coalesce(F.nullif("process", F.lit("")), F.lit("?")).alias("process")).agg(F.sum("amount_u").alias("amount_u"))
    units = found.agg(F.count_distinct("document_id").alias("units")).filter("units > 0")
    return by.crossJoin(F.broadcast(units)).select("process", F.round(F.col("amount_u") / 100.0 / F.col("units"), 5).alias("unit_cost"))  # one row


def step_durations(steps: DataFrame) -> DataFrame:
    known = steps.filter("duration_ms is not null")
    return known.groupBy("process").agg(F.floor(F.avg("duration_ms")).cast("long").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.count("*").alias("n")).orderBy(F.desc("avg_ms"), "process")


def recent_activity(transactions: DataFrame, documents: DataFrame, accounts: DataFrame, n: int = 10) -> DataFrame:
    """The transactions whose documents changed last, with labels."""
    last = documents.groupBy("transaction_id").agg(F.max("updated_at").alias("updated_at"))
    top = transactions.join(last, "transaction_id").orderBy(F.desc("updated_at"), "transaction_id").limit(n)
    labels = F.create_map(*[F.lit(x) for pair in ORIGIN_LABELS.items() for x in pair])
    # a handful of rows against the dimension
    named = top.join(accounts, "account_id", "left")
    return named.select("transaction_id", F.coalesce("account_name", F.lit("—")).alias("account"), F.coalesce(labels[F.coalesce("origin", F.lit(""))], F.col("origin")).alias("origin"), "updated_at").orderBy(F.desc("updated_at"), "transaction_id")


def classification_method(source: Column) -> Column:
    """The text before `_v`, if it is a known stage, else the empty text."""
    name = F.lower(F.element_at(F.split(F.coalesce(source, F.lit("")), "_v", 2), 1))
    return F.when(name.isin(*METHODS), name).otherwise("")


def classification_mix(costs: DataFrame, details: str | None = None) -> DataFrame:
    """Count, cost and share of each stage, zeros included; method from the source, else from the details' token."""
    method = classification_method(F.col("source"))
    if details:
        method = F.when(method != "", method).otherwise(classification_method(F.regexp_extract(details, r"source=(\S+)", 1)))
    counted = costs.filter(F.col("process") == "CLASSIFY").groupBy(method.alias("method")).agg(F.count("*").alias("n"), F.sum("amount_u").alias("amount_u"))
    fixed = costs.sparkSession.createDataFrame([(m,) for m in METHODS], "method string")
    out = fixed.join(counted, "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount_u", F.lit(0)).alias("amount_u"))
    total = out.agg(F.sum("n").alias("all"))
    share = F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("all")), F.lit(0.0)), 1)
    return out.crossJoin(F.broadcast(total)).select("method", "n", "amount_u", share.alias("percent"), (F.col("method") == "llm").alias("paid"))


def credit_forecast(costs: DataFrame, balances: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Daily spend of the last days and how long the balance lasts; null where nothing was spent. costs: account_id, amount_u."""
    spent = costs.filter((F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days))) & (F.col("created_at") < now)).groupBy("account_id").agg(F.sum("amount_u").alias("spent_u"))
    out = balances.join(spent, "account_id", "left")
    daily = F.col("spent_u") / F.lit(100.0 * days)
    left = F.when(daily > 0, F.round(F.col("credits") / daily, 1) + 0.0)
    return out.select("account_id", F.round(daily, 6).alias("daily"), left.alias("days_left"), F.when(left >= 0, F.date_add(now.cast("date"), F.floor(F.least(left, F.lit(36_500.0))).cast("int"))).alias("empty_on"))


def board(transactions: DataFrame, documents: DataFrame, costs: DataFrame, expected: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """One row for each transaction: status, counts, what is missing of the types its config expects, whether it is stuck, and its cost.

    Documents are aggregated once for all of it, and costs once. A transaction whose config expects nothing is complete.
    """
    facts = transactions.join(S.document_facts(documents), "transaction_id", "left").withColumn("reconciled", S.implied())
    complete = S.compared(facts, expected).select("transaction_id", "n_required", "missing", "complete")
    spent = costs.groupBy("transaction_id").agg(F.sum("amount_u").alias("cost_u"))
    out = facts.join(complete, "transaction_id", "left").join(spent, "transaction_id", "left")
    idle = F.coalesce("touched_at", "created_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "transaction_id", "reconciled", zero("n_active"), zero("validated"), zero("pending"), zero("error"), ((F.col("reconciled") == "WORKING") & idle).alias("stuck"), zero("cost_u"),
        zero("n_required"), F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"), F.coalesce("complete", F.lit(True)).alias("complete"),
    )


def page(rows: DataFrame, column: str, *, allowed: tuple[str, ...], descending: bool = True, number: int = 1, size: int = 25, default: str = "created_at", key: str = "transaction_id") -> DataFrame:
    """One page of rows in the order of an allowed column; has_next tells whether another follows. One row more than a page is fetched."""
    by = column if column in allowed else default
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    shown = rows.orderBy(order, key).offset((number - 1) * size).limit(size + 1)
    numbered = shown.select("*", F.row_number().over(Window.orderBy(order, key)).alias("place"))
    more = numbered.agg((F.max("place") > size).alias("has_next"))
    return numbered.filter(F.col("place") <= size).crossJoin(F.broadcast(more))


def cost_rows(calls: DataFrame) -> DataFrame:
    """Cost rows of calls: details from source, time and pages, month in two digits; free calls are kept."""
    details = F.concat_ws(" ", F.concat(F.lit("source="), F.nullif("source", F.lit(""))), F.concat(F.col("duration_ms").cast("string"), F.lit("ms")), F.concat(F.col("pages").cast("string"), F.lit("p")))
    return calls.select("transaction_id", "process", "amount_u", details.alias("details"), F.date_format("created_at", "MM").alias("month"), F.date_format("created_at", "yyyy").alias("year"))


def transaction_costs(costs: DataFrame) -> DataFrame:
    return costs.groupBy("transaction_id").agg(F.sum("amount_u").alias("amount_u"), F.count("*").alias("n"))


def latest_messages(messages: DataFrame, n: int = 3) -> DataFrame:
    """The newest n messages of each parent, newest first."""
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("at"), F.desc("message_id")))
    return messages.withColumn("place", rank).filter(F.col("place") <= n)
