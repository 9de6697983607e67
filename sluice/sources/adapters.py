"""Document-flow views over the star-schema tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "v_accounts": "SELECT c_custkey AS account_id, c_name AS account_name, c_acctbal AS credits FROM customer",
    "v_configs": """
        SELECT DISTINCT c_mktsegment AS config_id,
               c_mktsegment IN ('BUILDING', 'MACHINERY') AS need_validation,
               CASE c_mktsegment WHEN 'BUILDING' THEN 30 WHEN 'FURNITURE' THEN 90 END AS retention_days,
               CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'S3' ELSE '' END AS way_out
        FROM customer""",
    "v_transactions": """
        SELECT o.o_orderkey AS transaction_id, o.o_custkey AS account_id, c.c_mktsegment AS config_id,
               CASE o.o_orderstatus WHEN 'F' THEN 'EXPORTED' WHEN 'O' THEN 'WORKING' ELSE 'COMPLETED' END AS status,
               CASE o.o_orderpriority WHEN '1-URGENT' THEN 'MAIL' WHEN '2-HIGH' THEN 'WS' WHEN '3-MEDIUM' THEN 'FTP'
                    WHEN '5-LOW' THEN 'S3' ELSE 'UNKNOWN' END AS origin,
               o.o_orderdate AS created_at
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v_documents": """
        SELECT l_orderkey AS transaction_id,
               concat(CAST(l_orderkey AS VARCHAR(20)), '_', CAST(rn AS VARCHAR(20))) AS document_id,
               CASE WHEN l_quantity >= 49 THEN 'FAILED'
                    WHEN l_quantity <= 2 THEN 'DEPRECATED'
                    WHEN l_quantity <= 3 THEN 'DISCARDED'
                    WHEN l_quantity <= 6 AND l_linestatus = 'O' THEN 'OCR_DONE'
                    WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'PENDING_VALIDATION'
                    WHEN l_linestatus = 'F' THEN 'EXPORTED' ELSE 'VALIDATED' END AS status,
               p.p_type AS doctype, d.l_shipdate AS updated_at,
               d.l_quantity AS quantity, d.l_discount AS discount, rn AS position
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem) d
        JOIN part p ON d.l_partkey = p.p_partkey""",
    "v_costs": """
        SELECT l_orderkey AS transaction_id,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_u,
               CASE l_linenumber % 3 WHEN 0 THEN 'OCR' WHEN 1 THEN 'CLASSIFY' ELSE 'EXTRACT' END AS process,
               CASE l_linenumber WHEN 1 THEN 'lexical_v2' WHEN 4 THEN 'embedding_v3'
                    WHEN 7 THEN 'llm_vbootstrap' ELSE '' END AS source,
               p.p_brand AS provider, l_shipdate AS created_at
        FROM lineitem JOIN part p ON l_partkey = p.p_partkey""",
    "v_deposits": "SELECT event_id, user_id AS config_id, event_type AS source_key, ts AS seen_at, value FROM events",
    "v_steps": """
        SELECT event_id, user_id AS transaction_id, event_type AS process,
               CAST(round(value * 1000) AS BIGINT) AS duration_ms, ts AS started_at
        FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a driver table, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    import re

    used = [t for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])]
    text = VIEWS[name]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """The SQL, with the views that it names in front as common table expressions."""
    import re

    ctes = ",\n".join(f"{n} AS ({v})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql))
    body = sql.strip()
    if not ctes:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        return f"WITH {m[1] or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
