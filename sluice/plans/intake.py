"""Queries on admission and export, with their SQL equivalents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import admission as A
from sluice.operators import export as X
from sluice.operators import quality as Q
from sluice.plans.binding import Book
from sluice.sources import landing
from sluice.sources.adapters import view
from sluice.sources.scratch import kept, scratch
from sluice.streaming import admission as stream

BOOK = Book()
NOW = "1998-06-01 00:00:00"

KEYS = """
deposits AS (
  SELECT event_id, user_id, ts,
         CASE event_id % 7 WHEN 0 THEN '__uploads__/' || user_id::VARCHAR || '/c1' WHEN 1 THEN '__uploads__/x/a/b/c/d'
              ELSE '__uploads__/' || user_id::VARCHAR || '/c' || (event_id % 5)::VARCHAR || '/' || (CASE event_id % 4 WHEN 0 THEN 'FTP' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'web' ELSE 'API' END)
                   || '/f' || (event_id % 1000)::VARCHAR || (CASE event_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' ELSE '' END) END AS key
  FROM events),
parsed AS (SELECT *, string_split(key, '/') AS parts FROM deposits),
fields AS (
  SELECT event_id, user_id, ts, key, CASE WHEN len(parts) = 5 THEN parts[2] END AS account_id, CASE WHEN len(parts) = 5 THEN parts[3] END AS config_id,
         CASE WHEN len(parts) = 5 THEN CASE WHEN parts[4] IN ('UI_IMPORT', 'FTP', 'S3', 'API', 'MAIL', 'WS') THEN parts[4] ELSE 'UNKNOWN' END END AS origin,
         CASE WHEN len(parts) = 5 THEN parts[5] END AS filename
  FROM parsed)"""


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "events")
    n, who = F.col("event_id"), F.col("user_id").cast("string")
    origin = F.when(n % 4 == 0, "FTP").when(n % 4 == 1, "MAIL").when(n % 4 == 2, "web").otherwise("API")
    tail = F.when(n % 3 == 0, ".PDF").when(n % 3 == 1, ".tar.gz").otherwise("")
    full = F.concat(F.lit("__uploads__/"), who, F.lit("/c"), (n % 5).cast("string"), F.lit("/"), origin, F.lit("/f"), (n % 1000).cast("string"), tail)
    key = F.when(n % 7 == 0, F.concat(F.lit("__uploads__/"), who, F.lit("/c1"))).when(n % 7 == 1, "__uploads__/x/a/b/c/d").otherwise(full)
    return e.select("event_id", "user_id", "ts", key.alias("key"))


@BOOK.query("SELECT source, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, true AS once FROM documents GROUP BY source")
def a1_polled_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of their sources, put down in two portions with a run of the polling job after each: every object is listed once."""
    folder = scratch(spark, "landing")
    texts = view(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "text")
    for half in (0, 1):
        texts.filter(F.col("doc_id") % 2 == half).drop("doc_id").write.mode("append").partitionBy("source").option("lineSep", "\n").text(f"{folder}/in")
        stream.write_once(landing.polled(spark, f"{folder}/in", pattern="*.txt"), f"{folder}/out", f"{folder}/state").awaitTermination()
    listed = spark.read.parquet(f"{folder}/out").withColumn("source", F.regexp_extract("key", "/source=([^/]+)/", 1))
    return listed.groupBy("source").agg(F.sum("size").alias("bytes"), (F.count("*") == F.count_distinct("key")).alias("once"))


#: Bytes of containers that a batch has at most, but for a single one.
BATCH_BYTES = 4_000_000


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zip files nested id % 7 deep, with a text, a program and the next zip file in each; every 11th is broken."""

    def zipped(text: bytes, below: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("p.txt", text)
            z.writestr("q.exe", b"no")
            if below:
                z.writestr("in.zip", zipped(text, below - 1))
        return out.getvalue()

    def batch_of(ids: list[int], made: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids], pa.string()), pa.array([""] * len(ids), pa.string()), pa.array(made, pa.binary())], names=["root", "name", "content"])

    for batch in batches:
        ids, made, size = [], [], 0
        for n in range(batch.num_rows):
            i, text = batch["doc_id"][n].as_py(), batch["text"][n].as_py()
            ids.append(i)
            made.append(b"PK broken" if i % 11 == 0 else zipped((text or "").encode(), i % 7))
            size += len(made[-1])
            if size >= BATCH_BYTES:
                yield batch_of(ids, made)
                ids, made, size = [], [], 0
        if ids:
            yield batch_of(ids, made)


@BOOK.query("""
WITH opened AS (SELECT doc_id, d AS depth, octet_length(encode(text)) AS n FROM (SELECT *, unnest(range(1, least(doc_id % 7, 4) + 2)) AS d FROM documents WHERE doc_id % 11 <> 0)),
names AS (SELECT * FROM (VALUES (0, 'p.txt'), (1, 'q.exe'), (2, 'in.zip')) m(position, name))
SELECT doc_id::VARCHAR AS root, depth, repeat('/in.zip', (depth - 1)::INTEGER) || '/' || name AS path, position,
       CASE name WHEN 'p.txt' THEN 'ok' WHEN 'q.exe' THEN 'unsupported' ELSE CASE WHEN depth = 5 THEN 'too_deep' ELSE 'ok' END END AS state, CASE name WHEN 'p.txt' THEN n WHEN 'q.exe' THEN 2 END AS size
FROM opened, names WHERE name <> 'in.zip' OR depth <= doc_id % 7
UNION ALL SELECT doc_id::VARCHAR, 1, '/', 0, 'error:BadZipFile', 0 FROM documents WHERE doc_id % 11 = 0""")
def a14_container_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of containers made of the documents, down to the fifth level."""
    made = view(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_containers, "root string, name string, content binary")
    found = landing.expand(made, allowed="txt, pdf")
    size = F.when(~F.col("path").endswith(".zip"), F.col("size"))
    return found.select("root", "depth", "path", "position", "state", size.alias("size"))


@BOOK.query(f"WITH {KEYS} SELECT event_id, account_id, config_id, origin, filename FROM fields")
def a2_upload_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deposits(spark, sf_dir).withColumn("p", A.parsed_key(F.col("key"))).select("event_id", "p.*")


@BOOK.query(f"WITH {KEYS} SELECT event_id, sha256('work:' || key) AS transaction_key FROM deposits")
def a3_transaction_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deposits(spark, sf_dir).select("event_id", A.transaction_key(F.lit("work"), F.col("key")).alias("transaction_key"))


CONFIGS = "configs AS (SELECT * FROM (VALUES ('c0', true, ''), ('c1', true, 'pdf; .gz'), ('c2', false, ''), ('c3', true, 'PDF, docx')) c(config_id, is_active, filter_extensions))"
ALLOWED = """(len(list_filter(list_transform(string_split_regex(lower(filter_extensions), '[,;\\s]+'), lambda x: ltrim(x, '.')), lambda x: x <> '')) = 0
   OR list_contains(list_transform(string_split_regex(lower(filter_extensions), '[,;\\s]+'), lambda x: ltrim(x, '.')), CASE WHEN filename LIKE '%.%' THEN lower(string_split(filename, '.')[-1]) ELSE '' END))"""


def config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four configs for each customer, who owns them; c4 is unknown."""
    base = view(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_id"))
    fixed = [("c0", True, ""), ("c1", True, "pdf; .gz"), ("c2", False, ""), ("c3", True, "PDF, docx")]
    made = F.explode(F.array(*[F.struct(F.lit(a).alias("suffix"), F.lit(b).alias("is_active"), F.lit(c).alias("filter_extensions")) for a, b, c in fixed]))
    return base.withColumn("c", made).select(F.concat("account_id", F.lit("/"), "c.suffix").alias("config_id"), "account_id", "c.is_active", "c.filter_extensions")


@BOOK.query(f"""
WITH {KEYS}, {CONFIGS},
known AS (SELECT c_custkey::VARCHAR AS owner, config_id, is_active, filter_extensions FROM customer, configs),
judged AS (
  SELECT event_id, CASE WHEN f.filename IS NULL THEN 'invalid_key' WHEN k.config_id IS NULL THEN 'unknown_config' WHEN event_id % 11 = 0 THEN 'account_mismatch'
                        WHEN NOT is_active THEN 'inactive_config' WHEN NOT {ALLOWED} THEN 'extension_refused' ELSE '' END AS reason
  FROM fields f LEFT JOIN known k ON k.config_id = f.config_id AND k.owner = f.account_id)
SELECT event_id, reason, CASE reason WHEN '' THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision FROM judged""")
def a4_admission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deposits(spark, sf_dir)
    parts = F.split("key", "/", -1)
    # configs are per customer here, so the key's config part is made unique, and every 11th deposit claims another account
    claimed = F.when(F.col("event_id") % 11 == 0, F.lit("other")).otherwise(F.element_at(parts, 2))
    key = F.when(F.size(parts) == 5, F.array_join(F.array(F.element_at(parts, 1), claimed, F.concat(F.element_at(parts, 2), F.lit("|"), F.element_at(parts, 3)), F.element_at(parts, 4), F.element_at(parts, 5)), "/")).otherwise(F.col("key"))
    configs = config_rows(spark, sf_dir).withColumn("config_id", F.replace("config_id", F.lit("/"), F.lit("|")))
    return A.admission(rows.withColumn("key", key), configs).select("event_id", "reason", "decision")


@BOOK.query(f"WITH {KEYS}, {CONFIGS} SELECT event_id, config_id AS allowed_by, {ALLOWED} AS allowed FROM (SELECT event_id, coalesce(filename, '') AS filename, c.* FROM fields f, configs c)")
def a5_extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deposits(spark, sf_dir).withColumn("filename", F.coalesce(A.parsed_key(F.col("key"))["filename"], F.lit("")))
    fixed = [("c0", ""), ("c1", "pdf; .gz"), ("c2", ""), ("c3", "PDF, docx")]
    rows = rows.withColumn("c", F.explode(F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("ext")) for a, b in fixed])))
    return rows.select("event_id", F.col("c.id").alias("allowed_by"), A.extension_allowed(F.col("filename"), F.col("c.ext")).alias("allowed"))


@BOOK.query(f"""
WITH {KEYS}, keyed AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE key END AS transaction_key FROM deposits)
SELECT min(event_id) AS event_id, transaction_key FROM keyed WHERE transaction_key <> '' AND transaction_key NOT IN (SELECT transaction_key FROM keyed WHERE event_id < 500) GROUP BY transaction_key
UNION ALL SELECT event_id, transaction_key FROM keyed WHERE transaction_key = ''""")
def a6_idempotent_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deposits(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("key")).alias("transaction_key"))
    return A.idempotent(rows, rows.filter("event_id < 500"), "event_id")


ADMITTED = """
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY config_id, source_key ORDER BY seen_at, event_id) AS rn FROM v_deposits),
f AS (
  SELECT config_id, source_key, rn, event_id, seen_at AS last, true AS taken FROM s WHERE rn = 1
  UNION ALL
  SELECT s.config_id, s.source_key, s.rn, s.event_id, CASE WHEN s.seen_at - f.last >= INTERVAL 24 HOUR THEN s.seen_at ELSE f.last END, s.seen_at - f.last >= INTERVAL 24 HOUR
  FROM f JOIN s ON s.config_id = f.config_id AND s.source_key = f.source_key AND s.rn = f.rn + 1)
SELECT config_id, source_key, event_id FROM f WHERE taken"""


@BOOK.query(ADMITTED)
def a7_temporal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accepted(view(spark, sf_dir, "v_deposits"), 86_400)


@BOOK.query(ADMITTED)
def a10_streaming_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits up to a moment were admitted by the batch operator; the continuous job starts from the registry that this left, and reads the later ones from a folder of many files."""
    folder = scratch(spark, "admission")
    rows = view(spark, sf_dir, "v_deposits").select("event_id", F.col("config_id").cast("string").alias("config_id"), "source_key", F.col("seen_at").cast("timestamp").alias("seen_at"), F.lit("0").alias("size"))
    middle = rows.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("seen_at")) + F.unix_micros(F.max("seen_at"))) / 2).cast("long")).alias("middle"))
    rows = rows.crossJoin(F.broadcast(middle))  # one row
    early = kept(A.accepted(rows.filter("seen_at < middle"), 86_400), "early")
    # the batch operator's last accepted deposit of each path is what the registry has
    times = rows.filter("seen_at < middle").select("event_id", F.col("seen_at").alias("last_seen_at")).join(early.hint("merge"), "event_id")
    registry = A.registry_upsert(times.limit(0), times, ("config_id", "source_key"), ())
    rows.filter("seen_at >= middle").drop("middle").write.json(f"{folder}/in")
    job = stream.write_once(stream.accepted(stream.deposits(spark, f"{folder}/in", files_per_batch=1_000_000), 86_400, registry), f"{folder}/out", f"{folder}/state")
    job.awaitTermination()
    types = view(spark, sf_dir, "v_deposits").schema
    found = early.unionByName(spark.read.schema(early.schema).parquet(f"{folder}/out"))
    return found.select(F.col("config_id").cast(types["config_id"].dataType).alias("config_id"), "source_key", "event_id")


@BOOK.query("""
SELECT config_id, source_key, arg_max(origin, (seen_at, event_id)) FILTER (origin <> '') AS origin, arg_max(size, (seen_at, event_id)) FILTER (size <> '') AS size, max(seen_at) AS last_seen_at
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'o' || event_id::VARCHAR ELSE '' END AS origin, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS size FROM v_deposits) GROUP BY ALL""")
def a8_registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_deposits").select("config_id", "source_key", F.col("seen_at").alias("last_seen_at"), "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("o"), F.col("event_id").cast("string"))).otherwise("").alias("origin"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("size"))
    return A.registry_upsert(rows.filter("event_id % 5 = 0"), rows.filter("event_id % 5 <> 0"), ("config_id", "source_key"), ("origin", "size"))


@BOOK.query("""
WITH r AS (SELECT config_id, source_key, max(seen_at) AS last_seen_at FROM v_deposits GROUP BY ALL), n AS (SELECT max(seen_at) AS now FROM v_deposits)
SELECT config_id, source_key, (SELECT count(*) FROM r, n WHERE last_seen_at < now - INTERVAL 7 DAY) AS purged FROM r, n WHERE last_seen_at >= now - INTERVAL 7 DAY""")
def a9_registry_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_deposits")
    registry = rows.groupBy("config_id", "source_key").agg(F.max("seen_at").alias("last_seen_at"))
    latest = rows.agg(F.max("seen_at").alias("now"))
    return A.purge(registry.crossJoin(F.broadcast(latest)), F.col("now"), 7 * 24 * 60).select("config_id", "source_key", "purged")


@BOOK.query("""
SELECT event_id, list_bool_or(list_transform(['*@example.com', 'bob?@*.org', 'alice@x.net'], lambda p: regexp_matches(address, '^' || replace(replace(replace(p, '.', '\\.'), '*', '.*'), '?', '.') || '$'))) AS allowed
FROM (SELECT event_id, lower(CASE event_id % 4 WHEN 0 THEN event_type || '@Example.com' WHEN 1 THEN 'bob' || (user_id % 10)::VARCHAR || '@a.org' WHEN 2 THEN 'alice@x.net' ELSE 'bob' || user_id::VARCHAR || '@b.net' END) AS address FROM events)""")
def a11_sender_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, who = F.col("event_id"), F.col("user_id")
    sender = F.when(n % 4 == 0, F.concat(F.lit("Some One <"), F.col("event_type"), F.lit("@Example.com>"))).when(n % 4 == 1, F.concat(F.lit(" bob"), (who % 10).cast("string"), F.lit("@a.org "))).when(n % 4 == 2, "Alice <ALICE@x.net>").otherwise(F.concat(F.lit("bob"), who.cast("string"), F.lit("@b.net")))
    return view(spark, sf_dir, "events").select("event_id", A.sender_allowed(sender, F.lit("*@example.com, bob?@*.org\nalice@X.net")).alias("allowed"))


@BOOK.query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN m <> 'attachments' ELSE m <> 'body' AND event_id % 5 IN (1, 2) END AS kept
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'attachments' ELSE 'all' END AS m FROM events)""")
def a12_mail_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    mode = F.when(n % 4 == 0, "body").when(n % 4 == 1, "attachments").when(n % 4 == 2, "all").otherwise("whatever")
    name = F.when(n % 5 == 1, "a.PDF").when(n % 5 == 2, "b.c.png").when(n % 5 == 3, "noext").otherwise("x.exe")
    return view(spark, sf_dir, "events").select("event_id", A.mail_part_kept(mode, n % 3 == 0, name, F.lit(".pdf png")).alias("kept"))


@BOOK.query("""
SELECT doc_id, '["' || 'src' || (doc_id % 9)::VARCHAR || '@mail.example.com"]' AS sender, substr(text, 1, 200) AS subject, substr(text, 1, 300) AS date FROM documents""")
def a13_mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.concat(F.lit("Name <SRC"), (F.col("doc_id") % 9).cast("string"), F.lit("@Mail.example.com>"))
    headers = F.create_map(F.lit("from"), sender, F.lit("subject"), F.col("text"), F.lit("date"), F.col("text"), F.lit("x-other"), F.lit("gone"))
    kept = view(spark, sf_dir, "documents").select("doc_id", A.mail_headers(headers).alias("h"))
    return kept.select("doc_id", F.col("h")["from"].alias("sender"), F.col("h")["subject"].alias("subject"), F.col("h")["date"].alias("date"))


@BOOK.query("SELECT page_id, 'text' AS kind, CASE WHEN page_id % 3 = 0 THEN 'EML' WHEN regexp_matches(lower(substr(html, 1, 2048)), 'from:|received:|subject:|message-id:') THEN 'EML' ELSE 'FILE' END AS category FROM pages")
def a15_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 3 == 0, "m.eml").otherwise("page.html")
    content = F.col("html").cast("binary")
    return view(spark, sf_dir, "pages").select("page_id", A.content_kind(content, F.lit("page.html")).alias("kind"), A.container_category(content, name).alias("category"))


@BOOK.query("""
WITH m AS (SELECT l_orderkey AS root, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position, l_quantity > 5 AS ok FROM lineitem),
p AS (SELECT root, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM m GROUP BY root)
SELECT root::VARCHAR AS document_id, CASE WHEN good = 1 AND bad = 0 THEN 'CREATED' ELSE 'DEPRECATED' END AS status, CASE WHEN good = 1 AND bad = 0 THEN 0 ELSE bad END AS n_discarded FROM p
UNION ALL SELECT m.root::VARCHAR || '_' || lpad(position::VARCHAR, 5, '0'), CASE WHEN ok THEN 'CREATED' ELSE 'DISCARDED' END, 0 FROM m JOIN p ON m.root = p.root WHERE NOT (good = 1 AND bad = 0)""")
def a16_member_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_documents").select(F.col("transaction_id").cast("string").alias("root"), "position", (F.col("quantity") > 5).alias("ok"), F.lit("unsupported").alias("reason"))
    return A.member_documents(rows).select("document_id", "status", "n_discarded")


@BOOK.query("SELECT c_custkey::VARCHAR AS account_id, c_name AS account_name, c_custkey % 3 = 0 AS active, '{\"k\":' || c_custkey::VARCHAR || '}' AS settings, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_address FROM customer")
def a17_reference_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))
    raw = c.select(
        F.concat(F.lit("﻿"), k.cast("string")).alias("account_id"), F.col("c_name").alias("account_name"), F.when(k % 3 == 0, " Yes").otherwise("0").alias("active"),
        F.when(k % 5 == 0, body).otherwise(F.base64(body.cast("binary"))).alias("settings"), F.lit("1 road").alias("address1"), F.when(k % 2 == 0, "x").otherwise(" ").alias("address2"), *[F.lit(None).cast("string").alias(f"address{i}") for i in (3, 4, 5)],
    )
    return A.reference_rows(raw).select("account_id", "account_name", "active", "settings", F.size("address").alias("n_address"))


@BOOK.query("""
SELECT p_partkey, i - 1 AS field_no, 'f' || i::VARCHAR AS field_name, (p_partkey + i) % 2 = 0 AS required, i = 2 AS use_ia
FROM part, (VALUES (1), (2), (3)) v(i) WHERE p_partkey % 10 <> 0 AND i <= 1 + p_partkey % 3""")
def a18_doctype_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    field = lambda i: F.struct(F.lit(f"f{i}").alias("field_name"), F.when((k + i) % 2 == 0, F.lit("on")).otherwise("0").alias("required"), F.lit("yes" if i == 2 else "").alias("use_ia"))
    body = F.to_json(F.struct(F.col("p_type").alias("document_type"), F.slice(F.array(field(1), field(2), field(3)), F.lit(1), (1 + k % 3).cast("int")).alias("fields")))
    rows = view(spark, sf_dir, "part").select("p_partkey", F.when(k % 10 == 0, "{not json").otherwise(body).alias("json_content"))
    return A.doctype_fields(rows).select("p_partkey", "field_no", "field_name", "required", "use_ia")


@BOOK.query("""
SELECT c_custkey AS config_id, 'd' || i::VARCHAR AS doctype_id, CASE WHEN i = 1 THEN c_custkey % 2 = 0 ELSE true END AS required FROM customer, (VALUES (1), (2)) v(i)""")
def a19_expected_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.concat(F.lit('[{"doctype_id":"d1","required":"'), F.when(k % 2 == 0, "1").otherwise("no"), F.lit('"},"d2",{"doctype_id":" d1 ","required":"true"},"d2",{"other":1}]'))
    return A.expected_entries(view(spark, sf_dir, "customer").select(k.alias("config_id"), body.alias("expected"))).drop("n")


@BOOK.query("""
WITH x AS (SELECT o_orderkey AS transaction_id, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE '' END AS transaction_key FROM orders WHERE o_orderkey % 3 <> 0),
d AS (SELECT o_orderkey AS transaction_id, 'k' || o_orderkey::VARCHAR AS transaction_key FROM orders WHERE o_orderkey % 5 <> 0)
SELECT x.transaction_id, coalesce(nullif(x.transaction_key, ''), d.transaction_key) AS transaction_key, 'DONE' AS status FROM x LEFT JOIN d ON d.transaction_id = x.transaction_id
UNION ALL SELECT d.transaction_id, d.transaction_key, 'WORKING' FROM d WHERE d.transaction_id NOT IN (SELECT transaction_id FROM x)""")
def a20_new_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"))
    k = F.col("transaction_id")
    old = o.filter(k % 3 != 0).select(k, F.when(k % 2 == 0, "old").otherwise("").alias("transaction_key"), F.lit("DONE").alias("status"))
    new = o.filter(k % 5 != 0).select(k, F.concat(F.lit("k"), k.cast("string")).alias("transaction_key"), F.lit("FTP").alias("origin"))
    return A.new_transactions(old, new)[0].select("transaction_id", "transaction_key", "status")


@BOOK.query("""
SELECT coalesce(event_type, 'all') AS source, count(*) AS listed, count(*) FILTER (event_id % 3 = 0) AS ingested, count(*) FILTER (event_id % 3 = 1) AS skipped, count(*) FILTER (event_id % 6 = 0) AS moved, count(*) FILTER (event_id % 3 = 2) AS error
FROM events GROUP BY ROLLUP (event_type)""")
def a21_intake_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = view(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(n % 3 == 0, "ingested").when(n % 3 == 1, "skipped").otherwise("error").alias("outcome"), (n % 6 == 0).alias("moved"))
    return A.intake_summary(rows).withColumn("source", F.coalesce("source", F.lit("all")))


# --- export -----------------------------------------------------------------------------------------------


@BOOK.query("""
SELECT document_id, '{"doc_id":"' || document_id || '","doctype":"' || doctype || '","creation_date":"' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S')
  || '","indexes":[{"name":"quantity","value":"' || quantity::INTEGER::VARCHAR || '","score":"1"}],"transaction_fields":[{"name":"position","value":"' || position::VARCHAR || '"}]}' AS payload FROM v_documents""")
def b1_export_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents")
    row = lambda kind, name, value, n: F.struct(F.lit(kind).alias("index_type"), F.lit(name).alias("index_name"), value.alias("index_value"), F.lit("1").alias("index_score"), F.lit(n).alias("position"))
    rows = docs.select("document_id", F.explode(F.array(row("extracted", "quantity", F.col("quantity").cast("int").cast("string"), 1), row("metadata", "position", F.col("position").cast("string"), 2))).alias("i")).select("document_id", "i.*")
    return X.payloads(docs.select("document_id", "doctype", F.col("updated_at").alias("created_at")), rows)


@BOOK.query("SELECT document_id FROM v_documents WHERE status = 'VALIDATED' AND position % 3 <> 0")
def b2_idempotent_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents").filter("status = 'VALIDATED'")
    done = docs.filter("position % 3 = 0")
    keys = done.select(F.concat(F.lit("out/"), "document_id", F.lit(".pdf")).alias("key")).union(docs.filter("position % 2 = 0 or position % 3 = 0").select(F.concat(F.lit("out/"), "document_id", F.lit(".json"))))
    return X.pending_writes(docs, keys, "out").select("document_id")


@BOOK.query("""
SELECT document_id, payload, account_id FROM (
  SELECT document_id, '{"id":"' || document_id || '"}' AS payload, (transaction_id % 10)::VARCHAR AS account_id FROM v_documents WHERE status = 'VALIDATED')""")
def b2_export_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over growing sets, of which the second is started twice: read back, each document is there once."""
    root = scratch(spark, "export")
    docs = view(spark, sf_dir, "v_documents").filter("status = 'VALIDATED'")
    docs = docs.select("document_id", "position", F.concat(F.lit('{"id":"'), "document_id", F.lit('"}')).alias("payload"), (F.col("transaction_id") % 10).alias("account_id"))
    for rows, run in ((docs.filter("position % 3 = 0"), "r1"), (docs.filter("position % 3 < 2"), "r2"), (docs.filter("position % 3 < 2"), "r2"), (docs, "r3")):
        X.write_new(rows, root, run)
    return X.exported(spark, root)


@BOOK.query("""
SELECT document_id, reason, CASE reason WHEN '' THEN 'export' WHEN 'already_exported' THEN 'skip' ELSE 'refuse' END AS decision FROM (
  SELECT d.document_id, CASE WHEN d.status = 'EXPORTED' THEN 'already_exported' WHEN d.status <> 'VALIDATED' THEN 'invalid_status:' || d.status WHEN d.position % 5 = 0 THEN 'no_file'
         WHEN c.config_id IS NULL THEN 'unknown_config' WHEN t.account_id % 2 = 0 AND t.account_id % 3 <> 0 THEN 'incomplete' WHEN way_out = '' THEN 'no_way_out' ELSE '' END AS reason
  FROM v_documents d JOIN v_transactions t ON d.transaction_id = t.transaction_id LEFT JOIN v_configs c ON c.config_id = t.config_id)""")
def b3_export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents").join(view(spark, sf_dir, "v_transactions").select("transaction_id", "config_id", "account_id"), "transaction_id")
    docs = docs.join(view(spark, sf_dir, "v_configs").select("config_id", "way_out", F.lit(True).alias("k")), "config_id", "left")
    docs = docs.withColumns({"object_key": F.when(F.col("position") % 5 != 0, F.col("document_id")), "config_known": F.col("k").isNotNull(), "complete": F.col("account_id") % 2 != 0, "override": F.col("account_id") % 3 == 0})
    return X.gate(docs).select("document_id", "reason", "decision")


@BOOK.query("""
WITH d AS (SELECT transaction_id, CASE WHEN status = 'VALIDATED' AND position % 4 <> 0 THEN 'EXPORTED' ELSE status END AS status FROM v_documents)
SELECT transaction_id, bool_and(status = 'EXPORTED') AS exported FROM d WHERE status NOT IN ('DEPRECATED', 'DISCARDED') GROUP BY transaction_id""")
def b4_export_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents").withColumn("exported_at", F.lit(None).cast("timestamp_ntz"))
    results = docs.filter("status = 'VALIDATED'").select("document_id", (F.col("position") % 4 != 0).alias("ok"))
    return X.outcome(docs, results, F.lit(NOW).cast("timestamp_ntz"))[1].select("transaction_id", F.col("exported_at").isNotNull().alias("exported"))


@BOOK.query("""
SELECT d.document_id FROM v_documents d JOIN v_transactions t ON d.transaction_id = t.transaction_id JOIN v_configs c ON c.config_id = t.config_id
WHERE d.status = 'VALIDATED' AND way_out <> '' ORDER BY d.updated_at, d.document_id LIMIT 200""")
def b5_export_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.backlog(view(spark, sf_dir, "v_documents"), view(spark, sf_dir, "v_transactions"), view(spark, sf_dir, "v_configs")).select("document_id")


@BOOK.query("""
WITH d AS (SELECT s_suppkey AS k, row_number() OVER (PARTITION BY s_suppkey % 2 ORDER BY s_suppkey) AS nth FROM supplier)
SELECT k AS s_suppkey, array_to_string(list_filter([
  CASE WHEN k % 2 = 0 AND nth > 1 THEN 'name_repeated' END, CASE WHEN k % 3 = 0 THEN 'url' END, CASE WHEN k % 5 = 0 THEN 'method' END, CASE WHEN k % 13 = 0 THEN 'auth_key' END,
  CASE WHEN k % 11 = 0 THEN 'on_failure' END, CASE WHEN k % 7 = 0 THEN 'timeout' END, CASE WHEN k % 17 = 0 THEN 'target' END], lambda x: x IS NOT NULL), ',') AS faults
FROM d WHERE (k % 2 = 0 AND nth > 1) OR k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0""")
def q5_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = view(spark, sf_dir, "supplier").select(
        "s_suppkey", k.alias("position"), F.when(k % 2 == 0, "same").otherwise(F.col("s_name")).alias("name"), F.when(k % 3 == 0, "ftp://x").otherwise("https://x").alias("url"), F.when(k % 5 == 0, "PUT").otherwise("get").alias("method"),
        F.when(k % 13 == 0, "Header").when(k % 2 == 0, "query").alias("auth_type"), F.when(k % 13 != 0, "key").alias("auth_key"), F.when(k % 17 == 0, "@type:").otherwise("@type:field").alias("target"),
        F.when(k % 11 == 0, "abort").when(k % 2 == 0, "ERROR").alias("on_failure"), F.when(k % 7 == 0, "31").when(k % 2 == 0, "soon").otherwise("30").alias("timeout_s"),
    )
    return Q.bad_definitions(rows).select("s_suppkey", F.array_join("faults", ",").alias("faults"))
