"""Queries on status, lifecycle, reports and integrity, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import quality as Q
from sluice.operators import report as R
from sluice.operators import status as S
from sluice.operators.beside import beside
from sluice.plans.binding import Book, case_sql
from sluice.sources.adapters import view

BOOK = Book()
NOW = "1998-06-01 00:00:00"
now = lambda: F.lit(NOW).cast("timestamp_ntz")
TX = lambda s, d: view(s, d, "v_transactions")
DOCS = lambda s, d: view(s, d, "v_documents")
COSTS = lambda s, d: view(s, d, "v_costs")

FACTS = """
facts AS (
  SELECT transaction_id, count(*) AS n_active, bool_or(status = 'FAILED') AS any_failed,
         bool_or(status NOT IN ('VALIDATED', 'EXPORTED', 'FAILED', 'PENDING_VALIDATION', 'UNRECOGNIZED')) AS any_open,
         bool_and(status = 'EXPORTED') AS all_exported, bool_or(status = 'PENDING_VALIDATION') AS any_pending,
         bool_and(status IN ('VALIDATED', 'EXPORTED')) AS all_done
  FROM v_documents WHERE status NOT IN ('DEPRECATED', 'DISCARDED') GROUP BY transaction_id),
reconciled AS (
  SELECT t.*, coalesce(n_active, 0) AS n_active,
         CASE WHEN n_active IS NULL THEN t.status WHEN any_failed THEN 'FAILED' WHEN any_open THEN 'WORKING' WHEN all_exported THEN 'EXPORTED'
              WHEN any_pending THEN 'PENDING_VALIDATION' WHEN all_done THEN 'VALIDATED' ELSE t.status END AS reconciled
  FROM v_transactions t LEFT JOIN facts f ON t.transaction_id = f.transaction_id)"""


@BOOK.query("SELECT transaction_id, count(*) AS n_documents, count(*) FILTER (status NOT IN ('DEPRECATED', 'DISCARDED')) AS n_active FROM v_documents GROUP BY transaction_id")
def s1_active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.active_counts(DOCS(spark, sf_dir))


@BOOK.query(f"WITH {FACTS} SELECT reconciled AS status, count(*) AS n, sum(n_active)::BIGINT AS n_active FROM reconciled GROUP BY reconciled")
def s2_transaction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.reconciled(TX(spark, sf_dir), DOCS(spark, sf_dir))
    return found.groupBy(F.col("reconciled").alias("status")).agg(F.count("*").alias("n"), F.sum("n_active").alias("n_active"))


@BOOK.query("SELECT document_id, status NOT IN ('VALIDATED', 'EXPORTED', 'FAILED') AS in_progress FROM v_documents")
def s3_in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.in_progress(DOCS(spark, sf_dir)).select("document_id", "in_progress")


@BOOK.query("""
SELECT transaction_id, count(*) FILTER (status IN ('VALIDATED', 'EXPORTED')) AS validated, count(*) FILTER (status = 'PENDING_VALIDATION') AS pending,
       count(*) FILTER (status = 'FAILED') AS error, count(*) AS total
FROM v_documents WHERE status NOT IN ('DEPRECATED', 'DISCARDED') GROUP BY transaction_id""")
def s4_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validation_summary(DOCS(spark, sf_dir))


@BOOK.query("""
SELECT transaction_id, document_id, state, state IN ('pending', 'validated') AS validatable
FROM (SELECT transaction_id, document_id, CASE WHEN status IN ('VALIDATED', 'EXPORTED') THEN 'validated' WHEN status = 'FAILED' THEN 'error'
             WHEN status IN ('PENDING_VALIDATION', 'DATA_EXTRACTED_AI') THEN 'pending' ELSE 'other' END AS state
      FROM v_documents WHERE status NOT IN ('DEPRECATED', 'DISCARDED'))""")
def s5_validation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validation_list(DOCS(spark, sf_dir))


EXPECTED = """
types AS (SELECT DISTINCT p_type AS doctype_name FROM part),
required AS (
  SELECT c.config_id, t.doctype_name, abs(length(t.doctype_name) - length(c.config_id)) % 5 = 0 AS required
  FROM v_configs c, types t WHERE length(t.doctype_name) % 3 = length(c.config_id) % 3),
expected AS (
  SELECT t.transaction_id, upper(doctype_name) || '#' AS doctype_id, '  ' || lower(doctype_name) AS doctype_name, required
  FROM v_transactions t JOIN required r ON t.config_id = r.config_id)"""


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that each config expects."""
    types = view(spark, sf_dir, "part").select(F.col("p_type").alias("doctype_name")).distinct()
    configs = view(spark, sf_dir, "v_configs").select("config_id")
    n, m = F.length("doctype_name"), F.length("config_id")
    rows = beside(configs, types).filter(n % 3 == m % 3).withColumn("required", F.abs(n - m) % 5 == 0)
    return rows.select("config_id", F.concat(F.upper("doctype_name"), F.lit("#")).alias("doctype_id"), F.concat(F.lit("  "), F.lower("doctype_name")).alias("doctype_name"), "required")


@BOOK.query(f"""
WITH {EXPECTED},
carried AS (SELECT DISTINCT transaction_id, doctype FROM v_documents WHERE status NOT IN ('DEPRECATED', 'DISCARDED')),
marked AS (
  SELECT e.*, EXISTS (SELECT 1 FROM carried c WHERE c.transaction_id = e.transaction_id AND (c.doctype = e.doctype_id OR lower(trim(c.doctype)) = lower(trim(e.doctype_name)))) AS present
  FROM expected e)
SELECT transaction_id, count(*) FILTER (required) AS n_required,
       array_to_string(list_sort(list(DISTINCT doctype_name) FILTER (required AND present)), ',') AS present,
       array_to_string(list_sort(list(DISTINCT doctype_name) FILTER (required AND NOT present)), ',') AS missing,
       count(DISTINCT doctype_name) FILTER (NOT required AND present) AS n_optional,
       count(*) FILTER (required) = 0 OR count(*) FILTER (required AND NOT present) = 0 AS complete
FROM marked GROUP BY transaction_id""", blank=("present", "missing"))
def s6_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.completeness(TX(spark, sf_dir), expected(spark, sf_dir), DOCS(spark, sf_dir))
    return out.select("transaction_id", "n_required", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), F.size("optional").cast("long").alias("n_optional"), "complete")


@BOOK.query(f"WITH {EXPECTED} SELECT config_id, array_to_string(list_sort(list(DISTINCT upper(doctype_name) || '#')), ',') AS expected FROM required GROUP BY config_id")
def s7_expected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expected_ids(expected(spark, sf_dir)).select("config_id", F.array_join("expected", ",").alias("expected"))


@BOOK.query(f"""
WITH {FACTS},
last AS (SELECT transaction_id, max(updated_at) AS touched_at FROM v_documents GROUP BY transaction_id),
flags AS (
  SELECT r.transaction_id, reconciled, reconciled = 'WORKING' AND coalesce(touched_at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS stuck
  FROM reconciled r LEFT JOIN last l ON r.transaction_id = l.transaction_id)
SELECT transaction_id, reconciled, stuck, reconciled <> 'WORKING' OR stuck AS deletable FROM flags""")
def s8_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stuck(TX(spark, sf_dir), DOCS(spark, sf_dir), now())


@BOOK.query("SELECT document_id FROM v_documents WHERE status NOT IN ('VALIDATED', 'EXPORTED', 'DISCARDED', 'DEPRECATED') AND position % 4 <> 0")
def s9_retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = DOCS(spark, sf_dir).withColumn("object_key", F.when(F.col("position") % 4 != 0, F.col("document_id")))
    return S.retry_set(docs).select("document_id")


@BOOK.query(f"""
SELECT event_id, coalesce(c.r > t.r, false) AS skip
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CLASSIFY' WHEN 1 THEN 'OCR_READER' WHEN 2 THEN 'NEWDOC' WHEN 3 THEN 'EXPORTED' ELSE event_type END AS cur,
             CASE user_id % 3 WHEN 0 THEN 'EXTRACT' WHEN 1 THEN 'DOC_SPLITTER' ELSE 'CAB_READER' END AS target FROM events) e
LEFT JOIN (VALUES {case_sql(S.STEPS)}, ('CLASSIFY', {S.STEPS.index('CLASSIFIER')}), ('EXTRACT', {S.STEPS.index('FIELD_EXTRACTOR')})) c(name, r) ON e.cur = c.name
LEFT JOIN (VALUES {case_sql(S.STEPS)}, ('CLASSIFY', {S.STEPS.index('CLASSIFIER')}), ('EXTRACT', {S.STEPS.index('FIELD_EXTRACTOR')})) t(name, r) ON e.target = t.name""")
def s10_step_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, who = F.col("event_id") % 5, F.col("user_id") % 3
    rows = view(spark, sf_dir, "events").select(
        "event_id", F.when(kind == 0, "CLASSIFY").when(kind == 1, "OCR_READER").when(kind == 2, "NEWDOC").when(kind == 3, "EXPORTED").otherwise(F.col("event_type")).alias("current"),
        F.when(who == 0, "EXTRACT").when(who == 1, "DOC_SPLITTER").otherwise("CAB_READER").alias("target"),
    )
    return S.step_skips(rows).select("event_id", "skip")


MARKS = """
marks AS (SELECT user_id AS transaction_id, event_type AS process, event_id AS mark_id, CASE WHEN event_id % 5 < 3 THEN 'start' ELSE 'end' END AS kind, ts AS moment, value >= 50 AS ok, props AS detail FROM events),
numbered AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY transaction_id, process ORDER BY moment, mark_id) AS run_no FROM marks),
runs AS (
  SELECT transaction_id, process, run_no::BIGINT AS run_no, min(moment) FILTER (kind = 'start') AS a, arg_min(moment, (moment, mark_id)) FILTER (kind = 'end') AS b,
         arg_min(ok, (moment, mark_id)) FILTER (kind = 'end') AS ok, arg_min(detail, (moment, mark_id)) FILTER (kind = 'end') AS detail
  FROM numbered WHERE run_no > 0 GROUP BY ALL),
journal AS (
  SELECT *, CASE WHEN b IS NULL THEN 'RUNNING' WHEN ok THEN 'OK' ELSE 'ERROR' END AS status
  FROM (SELECT *, run_no = max(run_no) OVER (PARTITION BY transaction_id, process) AS last FROM runs) WHERE b IS NOT NULL OR last)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("event_id") % 5 < 3, "start").otherwise("end")
    marks = view(spark, sf_dir, "events").select(F.col("user_id").alias("transaction_id"), F.col("event_type").alias("process"), F.col("event_id").alias("mark_id"), mark.alias("kind"), F.col("ts").alias("at"), (F.col("value") >= 50).alias("ok"), F.col("props").alias("detail"))
    return S.step_journal(marks)


@BOOK.query(f"""
WITH {MARKS}
SELECT transaction_id, process, run_no, status, CASE WHEN b IS NOT NULL THEN greatest(0, (epoch_us(b) - epoch_us(a)) // 1000) END AS duration_ms, CASE WHEN status = 'ERROR' THEN substr(detail, 1, 2000) ELSE '' END AS detail FROM journal""", blank=("detail",))
def s11_step_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).drop("started_at", "ended_at").withColumn("detail", F.coalesce("detail", F.lit("")))


@BOOK.query(f"""
WITH {MARKS}, good AS (SELECT transaction_id, arg_max(process, (b, a, process)) AS process FROM journal WHERE status = 'OK' GROUP BY transaction_id)
SELECT t.transaction_id, coalesce(g.process, 'NEWDOC') AS process FROM v_transactions t LEFT JOIN good g ON g.transaction_id = t.transaction_id""")
def s11_process_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TX(spark, sf_dir).select("transaction_id", F.lit("NEWDOC").alias("process"), F.col("created_at").alias("process_time"))
    return S.advanced(rows, journal(spark, sf_dir)).select("transaction_id", "process")


@BOOK.query(f"""
WITH {FACTS}
SELECT t.transaction_id, coalesce(c.retention_days, 30) AS days FROM reconciled t LEFT JOIN v_configs c ON t.config_id = c.config_id
WHERE t.reconciled = 'EXPORTED' AND t.created_at + to_days(coalesce(c.retention_days, 30)) < TIMESTAMP '{NOW}'""")
def s12_retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = S.reconciled(TX(spark, sf_dir), DOCS(spark, sf_dir)).withColumn("exported_at", F.col("created_at"))
    configs = view(spark, sf_dir, "v_configs").withColumn("retention_days", F.col("retention_days").cast("string"))
    return S.retention_due(tx, configs, now()).select("transaction_id", "days")


@BOOK.query("""
WITH gone AS (SELECT transaction_id FROM v_transactions WHERE status = 'EXPORTED' AND origin = 'MAIL')
SELECT 'documents' AS part, count(*) AS n FROM v_documents WHERE transaction_id NOT IN (SELECT transaction_id FROM gone)
UNION ALL SELECT 'steps', count(*) FROM v_steps WHERE transaction_id NOT IN (SELECT transaction_id FROM gone)
UNION ALL SELECT 'costs', count(*) FROM v_costs
UNION ALL SELECT 'costs without id', count(*) FROM v_costs WHERE transaction_id IN (SELECT transaction_id FROM gone)""")
def s13_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = TX(spark, sf_dir).filter("status = 'EXPORTED' and origin = 'MAIL'")
    left, costs = S.cascade_delete({"documents": DOCS(spark, sf_dir), "steps": view(spark, sf_dir, "v_steps")}, COSTS(spark, sf_dir), gone)
    counted = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, t in left.items()]
    counted += [costs.agg(F.count("*").alias("n")).select(F.lit("costs").alias("part"), "n"), costs.agg(F.count_if(F.col("transaction_id").isNull()).alias("n")).select(F.lit("costs without id").alias("part"), "n")]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@BOOK.query("""
SELECT '__transactions__/a/c/' || (user_id * (1 + event_id % 20))::VARCHAR AS prefix, count(*) AS objects FROM events
WHERE user_id * (1 + event_id % 20) NOT IN (SELECT transaction_id FROM v_transactions) GROUP BY ALL""")
def s14_orphan_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = view(spark, sf_dir, "events").select(F.format_string("__transactions__/a/c/%d/%d.pdf", F.col("user_id") * (1 + F.col("event_id") % 20), "event_id").alias("key"))
    return S.orphan_prefixes(keys, TX(spark, sf_dir))


@BOOK.query("SELECT transaction_id, document_id, status, doctype FROM v_documents WHERE status NOT IN ('DEPRECATED', 'DISCARDED')")
def s15_document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_list(DOCS(spark, sf_dir))


@BOOK.query("""
WITH d AS (SELECT document_id, status, CASE WHEN position > 1 THEN transaction_id::VARCHAR || '_1' END AS parent_id FROM v_documents),
c AS (SELECT parent_id, count(*) AS n FROM d WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT d.document_id, d.parent_id IS NULL AS is_root, coalesce(n, 0) AS children, n IS NOT NULL AND status = 'DEPRECATED' AS replaced FROM d LEFT JOIN c ON c.parent_id = d.document_id""")
def s16_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = DOCS(spark, sf_dir).withColumn("parent_id", F.when(F.col("position") > 1, F.concat(F.col("transaction_id").cast("string"), F.lit("_1"))))
    return S.lineage(docs)


@BOOK.query("""
WITH ch AS (SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'FAILED' ELSE upper(event_type) END AS status, CASE WHEN event_id % 3 = 0 THEN 'P' || (event_id % 7)::VARCHAR END AS process, ts AS moment, event_id FROM events),
a AS (SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment DESC, event_id DESC) AS r FROM ch) WHERE r = 1),
b AS (SELECT id, process FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment DESC, event_id DESC) AS r FROM ch WHERE process IS NOT NULL) WHERE r = 1)
SELECT t.transaction_id AS id, coalesce(a.status, t.status) AS status, coalesce(b.process, 'NEWDOC') AS process
FROM v_transactions t LEFT JOIN a ON a.id = t.transaction_id LEFT JOIN b ON b.id = t.transaction_id""")
def s17_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = view(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "FAILED").otherwise(F.upper("event_type")).alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("P"), (F.col("event_id") % 7).cast("string"))).alias("process"), F.col("ts").alias("at"), F.col("event_id").alias("change_id"),
    )
    return S.state_upsert(TX(spark, sf_dir).select(F.col("transaction_id").alias("id"), "status", F.lit("NEWDOC").alias("process")), changes)


# --- reports ----------------------------------------------------------------------------------------------


@BOOK.query(f"SELECT account_id, status, count(*) AS n FROM v_transactions WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY GROUP BY account_id, status")
def r1_scope_and_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every account sees of the period; `account` narrows it to one."""
    return R.scoped(TX(spark, sf_dir), account=None, now=now(), days=R.period_days(365)).groupBy("account_id", "status").agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT 'transaction' AS kind, coalesce(nullif(trim(status), ''), '?') AS status, count(*) AS n FROM v_transactions GROUP BY 2
UNION ALL SELECT 'document', coalesce(nullif(trim(d.status), ''), '?'), count(*) FROM v_documents d JOIN v_transactions t ON d.transaction_id = t.transaction_id GROUP BY 2""")
def r2_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.volumes(TX(spark, sf_dir), DOCS(spark, sf_dir))


@BOOK.query("""
SELECT 'total' AS kind, '' AS name, sum(amount_u)::BIGINT AS amount_u FROM v_costs
UNION ALL SELECT 'process', process, sum(amount_u)::BIGINT FROM v_costs GROUP BY process
UNION ALL SELECT 'provider', provider, sum(amount_u)::BIGINT FROM v_costs GROUP BY provider""")
def r3_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cost_totals(COSTS(spark, sf_dir))


@BOOK.query("SELECT year(created_at)::INTEGER AS year, month(created_at)::INTEGER AS month, sum(amount_u)::BIGINT AS amount_u FROM v_costs GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 12")
def r3_cost_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cost_months(COSTS(spark, sf_dir))


SPENT = """
spent AS (SELECT *, CASE WHEN provider <> 'Brand#11' THEN transaction_id::VARCHAR || '/' || provider END AS document_id FROM v_costs WHERE created_at >= TIMESTAMP '1994-01-01')"""


def spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs with the document they are for; one provider's are for none."""
    return COSTS(spark, sf_dir).withColumn("document_id", F.when(F.col("provider") != "Brand#11", F.concat(F.col("transaction_id").cast("string"), F.lit("/"), F.col("provider"))))


SINCE = lambda: F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")


@BOOK.query(f"""
WITH {SPENT}, one AS (SELECT count(DISTINCT document_id) AS units, sum(amount_u) AS a, sum(CASE WHEN process = 'CLASSIFY' AND source LIKE 'llm\\_%' ESCAPE '\\' THEN amount_u ELSE 0 END) AS m FROM spent)
SELECT units, round(a / 100.0, 4) AS total, round(a / 100.0 / units, 5) AS unit_cost, round((a - m) / 100.0 / units, 5) AS unit_floor, round(100.0 * m / a, 1) AS model_share, volume,
       round(a / 100.0 / units * volume, 2) AS projected, round((a - m) / 100.0 / units * volume, 2) AS projected_floor
FROM one, (VALUES (1000), (5000), (10000), (50000), (100000)) v(volume)""")
def r4_cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cost_projection(spent(spark, sf_dir), SINCE())


@BOOK.query(f"WITH {SPENT} SELECT process, round(sum(amount_u) / 100.0 / (SELECT count(DISTINCT document_id) FROM spent), 5) AS unit_cost FROM spent GROUP BY process")
def r4_process_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.process_averages(spent(spark, sf_dir), SINCE())


@BOOK.query("SELECT process, floor(avg(duration_ms))::BIGINT AS avg_ms, max(duration_ms) AS max_ms, count(*) AS n FROM v_steps WHERE duration_ms IS NOT NULL GROUP BY process")
def r5_step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.step_durations(view(spark, sf_dir, "v_steps"))


@BOOK.query("""
WITH last AS (SELECT transaction_id, max(updated_at) AS updated_at FROM v_documents GROUP BY transaction_id)
SELECT t.transaction_id, coalesce(a.account_name, '—') AS account, CASE origin WHEN 'MAIL' THEN 'Mail' WHEN 'WS' THEN 'Web service' WHEN 'UNKNOWN' THEN 'Inconnu' ELSE origin END AS origin, updated_at
FROM v_transactions t JOIN last l ON t.transaction_id = l.transaction_id LEFT JOIN v_accounts a ON t.account_id = a.account_id ORDER BY updated_at DESC, t.transaction_id LIMIT 10""")
def r6_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent_activity(TX(spark, sf_dir), DOCS(spark, sf_dir), view(spark, sf_dir, "v_accounts"))


@BOOK.query("""
WITH c AS (SELECT split_part(source, '_v', 1) AS method, count(*) AS n, sum(amount_u)::BIGINT AS amount_u FROM v_costs WHERE process = 'CLASSIFY' GROUP BY 1),
f AS (SELECT m.method, coalesce(n, 0) AS n, coalesce(amount_u, 0) AS amount_u FROM (VALUES ('lexical'), ('embedding'), ('llm')) m(method) LEFT JOIN c ON c.method = m.method)
SELECT method, n, amount_u, round(100.0 * n / (SELECT sum(n) FROM f), 1) AS percent, method = 'llm' AS paid FROM f""")
def r7_classification_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classification_mix(COSTS(spark, sf_dir))


@BOOK.query(f"""
WITH s AS (SELECT t.account_id, sum(amount_u) AS u FROM v_costs c JOIN v_transactions t ON c.transaction_id = t.transaction_id
           WHERE c.created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND c.created_at < TIMESTAMP '{NOW}' GROUP BY t.account_id),
f AS (SELECT a.account_id, credits, u::DOUBLE / 700.0 AS daily FROM v_accounts a LEFT JOIN s ON s.account_id = a.account_id),
g AS (SELECT *, CASE WHEN daily > 0 THEN round(credits / daily, 1) + 0 END AS days_left FROM f)
SELECT account_id, round(daily, 6) AS daily, days_left, CASE WHEN days_left >= 0 THEN DATE '{NOW[:10]}' + floor(least(days_left, 36500))::INTEGER END AS empty_on FROM g""")
def r8_credit_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = COSTS(spark, sf_dir).join(TX(spark, sf_dir).select("transaction_id", "account_id"), "transaction_id")
    return R.credit_forecast(owned, view(spark, sf_dir, "v_accounts"), now())


@BOOK.query(f"""
WITH {FACTS},
v AS (SELECT transaction_id, count(*) FILTER (status IN ('VALIDATED', 'EXPORTED')) AS validated, count(*) FILTER (status = 'PENDING_VALIDATION') AS pending, count(*) FILTER (status = 'FAILED') AS error
      FROM v_documents WHERE status NOT IN ('DEPRECATED', 'DISCARDED') GROUP BY transaction_id),
last AS (SELECT transaction_id, max(updated_at) AS touched_at FROM v_documents GROUP BY transaction_id),
c AS (SELECT transaction_id, sum(amount_u)::BIGINT AS cost_u FROM v_costs GROUP BY transaction_id),
{EXPECTED.strip()},
carried AS (SELECT DISTINCT transaction_id, doctype FROM v_documents WHERE status NOT IN ('DEPRECATED', 'DISCARDED')),
marked AS (
  SELECT e.*, EXISTS (SELECT 1 FROM carried c WHERE c.transaction_id = e.transaction_id AND (c.doctype = e.doctype_id OR lower(trim(c.doctype)) = lower(trim(e.doctype_name)))) AS present
  FROM expected e),
m AS (SELECT transaction_id, count(*) FILTER (required) AS n_required, coalesce(array_to_string(list_sort(list(DISTINCT doctype_name) FILTER (required AND NOT present)), ','), '') AS missing,
             count(*) FILTER (required AND NOT present) = 0 AS complete FROM marked GROUP BY transaction_id)
SELECT r.transaction_id, reconciled, n_active, coalesce(validated, 0) AS validated, coalesce(pending, 0) AS pending, coalesce(error, 0) AS error,
       reconciled = 'WORKING' AND coalesce(touched_at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS stuck, coalesce(cost_u, 0) AS cost_u,
       coalesce(m.n_required, 0) AS n_required, coalesce(m.missing, '') AS missing, coalesce(m.complete, true) AS complete
FROM reconciled r LEFT JOIN m ON m.transaction_id = r.transaction_id LEFT JOIN v ON v.transaction_id = r.transaction_id LEFT JOIN last ON last.transaction_id = r.transaction_id LEFT JOIN c ON c.transaction_id = r.transaction_id""")
def r9_transaction_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.board(TX(spark, sf_dir), DOCS(spark, sf_dir), COSTS(spark, sf_dir), expected(spark, sf_dir), now())


@BOOK.query("SELECT transaction_id, status, created_at, true AS has_next FROM v_transactions ORDER BY status DESC, transaction_id LIMIT 25 OFFSET 25")
def r10_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(TX(spark, sf_dir), "status", allowed=("status", "origin", "created_at"), number=2).select("transaction_id", "status", "created_at", "has_next")


@BOOK.query("""
SELECT event_id, 'source=' || event_type || ' ' || duration_ms::VARCHAR || 'ms ' || (event_id % 9)::VARCHAR || 'p' AS details, strftime(ts, '%m') AS month, strftime(ts, '%Y') AS year
FROM (SELECT event_id, event_type, ts, CAST(round(value * 1000) AS BIGINT) AS duration_ms FROM events)""")
def r11_cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "events")
    calls = e.select(F.col("event_id").alias("transaction_id"), F.lit("OCR").alias("process"), F.lit(0).alias("amount_u"), F.col("event_type").alias("source"), F.round(F.col("value") * 1000).cast("long").alias("duration_ms"), (F.col("event_id") % 9).alias("pages"), F.col("ts").alias("created_at"))
    return R.cost_rows(calls).select(F.col("transaction_id").alias("event_id"), "details", "month", "year")


@BOOK.query("SELECT transaction_id, sum(amount_u)::BIGINT AS amount_u, count(*) AS n FROM v_costs GROUP BY transaction_id")
def r12_transaction_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transaction_costs(COSTS(spark, sf_dir))


@BOOK.query("SELECT parent, message_id FROM (SELECT user_id AS parent, event_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def r12_latest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "events").select(F.col("user_id").alias("parent"), F.col("event_id").alias("message_id"), F.col("ts").alias("at"))
    return R.latest_messages(e).select("parent", "message_id")


# --- integrity --------------------------------------------------------------------------------------------


@BOOK.query("SELECT key, count(*) AS n FROM (SELECT CASE WHEN event_id % 10 > 0 THEN event_type || '/' || (event_id % 1000)::VARCHAR ELSE '' END AS key FROM events) WHERE key <> '' GROUP BY key HAVING count(*) > 1")
def q1_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("event_id") % 10 > 0, F.concat(F.col("event_type"), F.lit("/"), (F.col("event_id") % 1000).cast("string"))).otherwise("")
    return Q.repeated(view(spark, sf_dir, "events").select(key.alias("key")).filter("key <> ''"), "key")


@BOOK.query("SELECT event_id FROM events WHERE (event_id % 3 = 0) = (event_id % 4 = 0)")
def q2_one_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("transaction_id"), F.when(F.col("event_id") % 4 == 0, F.col("user_id")).alias("document_id"))
    return Q.not_one_parent(e, "transaction_id", "document_id").select("event_id")


@BOOK.query("SELECT config_id, source_key, count(*) AS n FROM v_deposits GROUP BY config_id, source_key HAVING count(*) > 1")
def q3_unique_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.repeated(view(spark, sf_dir, "v_deposits"), "config_id", "source_key")


@BOOK.query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT c_custkey FROM customer)")
def q4_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dangling(view(spark, sf_dir, "events"), "event_id", view(spark, sf_dir, "customer"), "c_custkey").select("event_id")
