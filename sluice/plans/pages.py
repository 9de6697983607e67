"""Queries on line tables and page splitting, with their SQL equivalents.

Lines are the lines of documents, five to a page. A page's barcode and number are made from the digest of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import split as P
from sluice.operators import text as T
from sluice.plans.binding import Book
from sluice.sources.adapters import view

BOOK = Book()

LINES = """
v_lines AS (
  SELECT doc_id AS document_id, line_no, line_no // 5 + 1 AS page, text, 0.0::DOUBLE AS x0, 20.0 * (line_no % 5) AS y0, least(100, length(text))::DOUBLE AS x1, 20.0 * (line_no % 5) + 15 AS y1
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents))"""
PAGES = f"""{LINES},
v_pages AS (
  SELECT document_id, page, string_agg(text, chr(10) ORDER BY line_no) AS text, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS h FROM v_lines GROUP BY document_id, page),
marked AS (
  SELECT document_id, page, h, ('0x' || h[1])::INTEGER AS a, ('0x' || h[2])::INTEGER AS b, ('0x' || h[3])::INTEGER AS c, row_number() OVER (PARTITION BY document_id ORDER BY page) AS n FROM v_pages),
signs AS (
  SELECT document_id, page, n, h, CASE WHEN a < 8 THEN h[1] END AS bar, CASE WHEN a < 8 THEN CASE WHEN c < 8 THEN 'QR@' ELSE 'C128@' END || 'top-left' END AS sig,
         CASE WHEN b = 0 THEN 1 WHEN b < 6 THEN b END AS num FROM marked)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return rows.select("document_id", "line_no", (F.floor(F.col("line_no") / 5) + 1).cast("int").alias("page"), "text", F.lit(0.0).alias("x0"), (20.0 * (F.col("line_no") % 5)).alias("y0"), F.least(F.lit(100), F.length("text")).cast("double").alias("x1"), (20.0 * (F.col("line_no") % 5) + 15).alias("y1"))


#: Characters of a task that makes lines into words: some 1.5 million words, which are sorted in memory before they are lines again.
CHARS_EACH = 8_000_000


def dealt(rows: DataFrame, each: int = CHARS_EACH) -> DataFrame:
    """Lines dealt by pages before they are words, which then are grouped where they are: a text is sent once, and not as a row for each word.

    There are as many parts as the texts' size asks for, so that no task's words outgrow its memory.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows.repartition(max(-(-chars // each), rows.sparkSession.sparkContext.defaultParallelism), "document_id", "page")


def page_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lines(spark, sf_dir).groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    h = F.sha2("text", 256)
    digit = lambda i: F.conv(F.substring("h", i, 1), 16, 10).cast("int")
    rows = joined.withColumn("h", h)
    signature = F.concat(F.when(digit(3) < 8, "QR@").otherwise("C128@"), P.barcode_zone(F.lit(10.0), F.lit(10.0)))
    return rows.select(
        "document_id", "page", "text", "h", F.when(digit(1) < 8, F.struct(F.substring("h", 1, 1).alias("value"), signature.alias("signature"))).alias("barcode"),
        F.when(digit(2) == 0, 1).when(digit(2) < 6, digit(2)).alias("number"),
    )


@BOOK.query(f"WITH {LINES} SELECT document_id, page, line_no % 5 AS line_no, trim(text) AS text, x1 FROM v_lines WHERE trim(text) <> '' AND (document_id + line_no) % 11 <> 0")
def t1_flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    coded = F.when((F.col("document_id") + F.col("line_no")) % 11 == 0, "*").otherwise(F.base64(F.col("text").cast("binary")))
    line = F.struct(F.col("line_no").alias("n"), F.struct(coded.alias("text"), F.struct("x0", "y0", "x1", "y1").alias("position")).alias("l"))
    pages = rows.groupBy("document_id", "page").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]).alias("lines"))
    nested = pages.groupBy("document_id").agg(F.collect_list(F.struct("page", "lines")).alias("pages"))
    return T.flat_lines(nested).select("document_id", "page", "line_no", "text", "x1")


@BOOK.query(rf"WITH {LINES}, c AS (SELECT document_id, line_no, trim(regexp_replace(regexp_replace(replace(text, 'a', '  '), '[\x09-\x0D\x20]+', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g')) AS text FROM v_lines) SELECT * FROM c WHERE length(text) >= 2")
def t2_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean_lines(lines(spark, sf_dir).withColumn("text", F.replace("text", F.lit("a"), F.lit("  ")))).select("document_id", "line_no", "text")


@BOOK.query(f"""
WITH {LINES}, p AS (SELECT document_id, page, string_agg(text, chr(10) ORDER BY line_no) FILTER (text <> '') AS l FROM v_lines GROUP BY document_id, page)
SELECT document_id, sha256(string_agg('[PAGE ' || page::VARCHAR || ']' || chr(10) || CASE WHEN (document_id + page) % 3 = 0 THEN 'own text' ELSE coalesce(l, '') END, chr(10) || chr(10) ORDER BY page)) AS digest FROM p GROUP BY document_id""")
def t3_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    own = rows.select("document_id", "page").distinct().withColumn("markdown", F.when((F.col("document_id") + F.col("page")) % 3 == 0, " own text ").otherwise(" "))
    return T.markdown(rows, own).select("document_id", F.sha2("markdown", 256).alias("digest"))


@BOOK.query(f"WITH {LINES} SELECT document_id, line_no, text, 25.0::DOUBLE AS x0, 75.0::DOUBLE AS x1 FROM v_lines WHERE text <> '' AND line_no % 3 <> 1 AND line_no % 7 <> 0")
def t4_block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    box = F.when(n % 7 != 0, F.struct(F.struct(F.lit(0.25).alias("Left"), F.lit(0.1).alias("Top"), F.lit(0.5).alias("Width"), F.lit(0.02).alias("Height")).alias("BoundingBox")))
    block = F.struct(n.alias("n"), F.struct(F.when(n % 3 == 1, "WORD").otherwise("LINE").alias("BlockType"), F.col("text").alias("Text"), F.lit(1).alias("Page"), box.alias("Geometry")).alias("b"))
    answers = lines(spark, sf_dir).groupBy("document_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("Blocks"))).alias("answer"))
    return T.block_lines(answers).select("document_id", "line_no", "text", "x0", "x1")


@BOOK.query(f"WITH {PAGES} SELECT document_id, page, trim('A' || chr(10) || chr(10) || text) AS markdown FROM v_pages")
def t5_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("A![img](x.png)\n\n\n\n\n"), "text")
    item = F.struct((F.col("page") - 1).alias("index"), text.alias("markdown"))
    answers = page_signs(spark, sf_dir).filter(F.trim("text") != "\x00").groupBy("document_id").agg(F.to_json(F.struct(F.collect_list(item).alias("pages"))).alias("answer"))
    return T.page_markdown(answers)


@BOOK.query(rf"""
WITH {LINES}, w AS (SELECT document_id, page, line_no, unnest(string_split_regex(trim(text), '[\x09-\x0D\x20]+')) AS word, generate_subscripts(string_split_regex(trim(text), '[\x09-\x0D\x20]+'), 1) AS i FROM v_lines)
SELECT document_id, page, line_no AS line, string_agg(word, ' ' ORDER BY i) AS text, min(i)::DOUBLE AS x0, max(i + length(word))::DOUBLE AS x1 FROM w WHERE (i * 7 + line_no) % 100 >= 30 AND trim(word) <> '' GROUP BY document_id, page, line_no""")
def t6_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dealt(lines(spark, sf_dir).select("document_id", "page", "line_no", "text")).select("document_id", "page", "line_no", F.posexplode(F.split(F.trim("text"), r"[\x09-\x0D\x20]+")).alias("i", "w")).withColumn("i", F.col("i") + 1)
    rows = words.select("document_id", "page", F.lit(1).alias("block"), F.lit(1).alias("paragraph"), F.col("line_no").alias("line"), F.col("i").alias("position"), F.col("w").alias("text"), ((F.col("i") * 7 + F.col("line_no")) % 100).alias("confidence"), F.col("i").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("i") + F.length("w")).cast("double").alias("x1"), F.lit(1.0).alias("y1"))
    return T.word_lines(rows).select("document_id", "page", "line", "text", "x0", "x1")


@BOOK.query(f"""
WITH {LINES}, s AS (SELECT document_id, coalesce(sum(length(text)) FILTER (line_no % 2 = 0), 0)::BIGINT AS local, coalesce(sum(length(text)) FILTER (line_no % 2 = 1), 0)::BIGINT AS remote FROM v_lines GROUP BY document_id)
SELECT document_id, local, remote, CASE WHEN local >= 500 THEN 'local' WHEN remote >= local THEN CASE WHEN document_id % 7 = 0 THEN 'local' ELSE 'remote' END ELSE 'local' END AS engine FROM s""")
def t7_engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lines(spark, sf_dir).withColumn("engine", F.when(F.col("line_no") % 2 == 0, "local").otherwise("remote"))
    return T.choose_engine(read, failed=read.filter("document_id % 7 = 0").select("document_id"))


@BOOK.query(f"WITH {PAGES} SELECT document_id, page, CASE WHEN length(text) < 20 AND i THEN 'SCAN' WHEN length(text) >= 200 THEN 'NATIVE' WHEN i THEN 'HYBRID' ELSE 'NATIVE' END AS kind FROM (SELECT *, (document_id + page) % 2 = 0 AS i FROM v_pages)")
def t8_page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_signs(spark, sf_dir).select("document_id", "page", T.page_kind(F.length("text"), (F.col("document_id") + F.col("page")) % 2 == 0).alias("kind"))


@BOOK.query(f"""
WITH {LINES}, l AS (SELECT *, (y1 - y0) / 100 * x1 / 100 AS area FROM v_lines WHERE length(text) % 3 <> 0),
r AS (SELECT *, coalesce(max(y1) OVER (PARTITION BY document_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(area) OVER (PARTITION BY document_id, page) AS covered FROM l),
b AS (SELECT document_id, page, above AS top, y0 AS bottom, covered FROM r WHERE y0 > above UNION ALL SELECT document_id, page, max(y1), 100, max(covered) FROM r GROUP BY document_id, page HAVING max(y1) < 100)
SELECT document_id, page, top::DOUBLE AS top, bottom::DOUBLE AS bottom FROM b WHERE covered <= 0.7""")
def t9_empty_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).filter(F.length("text") % 3 != 0).withColumn("area", (F.col("y1") - F.col("y0")) / 100 * F.col("x1") / 100)
    return T.empty_bands(rows)


def _barcodes(rows: DataFrame) -> DataFrame:
    n = F.col("line_no")
    return rows.select("document_id", "page", (n % 5).alias("n"), F.when(n % 4 != 3, F.concat(F.lit("V"), (n % 2).cast("string"))).alias("value"), F.lit("QR").alias("format"), F.when(n % 5 != 4, F.col("x0")).alias("x0"), "y0", "x1", "y1")


@BOOK.query(f"""
WITH {LINES}, b AS (SELECT document_id, page, line_no % 5 AS n, 'V' || (line_no % 2)::VARCHAR AS value FROM v_lines WHERE line_no % 4 <> 3 AND line_no % 5 <> 4),
f AS (SELECT document_id, page, value, min(n) AS n FROM b GROUP BY ALL), m AS (SELECT document_id, page, max(line_no) AS last FROM v_lines GROUP BY ALL)
SELECT document_id, page, line_no, text FROM v_lines UNION ALL SELECT f.document_id, f.page, last + 1 + n, '[BARCODE] ' || value FROM f JOIN m ON f.document_id = m.document_id AND f.page = m.page""")
def t10_barcode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return T.barcode_lines(rows, _barcodes(rows)).select("document_id", "page", "line_no", "text")


@BOOK.query(f"WITH {LINES} SELECT document_id, page, string_agg(CASE WHEN line_no % 4 <> 3 THEN 'V' || (line_no % 2)::VARCHAR ELSE '-' END, ',' ORDER BY line_no) AS codes FROM v_lines GROUP BY document_id, page")
def t11_barcodes_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.barcodes_by_page(_barcodes(lines(spark, sf_dir)))
    return found.select("document_id", "page", F.array_join(F.transform("barcodes", lambda b: F.coalesce(b["value"], F.lit("-"))), ",").alias("codes"))


@BOOK.query(r"""
WITH n AS (SELECT doc_id, doc_id::VARCHAR || chr(13) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'fi ABC 12 ' ELSE '' END || nfc_normalize(text) AS t FROM documents),
s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), E' \n\t') AS t FROM n),
c AS (SELECT doc_id, '  ' || t AS t, substr('  ' || t, 1, 400) AS cut FROM s),
k AS (SELECT *, greatest(CASE WHEN strpos(reverse(cut), '.') > 0 THEN length(cut) - strpos(reverse(cut), '.') ELSE 0 END, CASE WHEN strpos(reverse(cut), chr(10)) > 0 THEN length(cut) - strpos(reverse(cut), chr(10)) ELSE 0 END) AS last FROM c)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN last > 240 THEN substr(cut, 1, last) ELSE cut END AS text FROM k""")
def t12_normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text begins with a ligature, wide letters and a small digit, which NFKC makes plain."""
    odd = F.when(F.col("doc_id") % 3 == 0, "ﬁ ＡＢＣ 1² ").otherwise("")
    raw = F.concat(F.lit("[PAGE 1] "), F.col("doc_id").cast("string"), F.lit("\r\n"), odd, "text")
    return view(spark, sf_dir, "documents").select("doc_id", T.for_vectors(raw, 400).alias("text"))


@BOOK.query("""
SELECT doc_id AS document_id, i // 3200 AS chunk_no, sha256(substr(text, i + 1, 3200)) AS chunk_id FROM (SELECT doc_id, text, unnest(range(0, length(text), 3200)) AS i FROM documents)""")
def t13_plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.plain_chunks(view(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")).select("document_id", "chunk_no", "chunk_id")


@BOOK.query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id AS document_id, i // 680 AS chunk_no, sha256(array_to_string(w[i + 1 : i + 800], ' ')) AS chunk_id FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 120, 1)::BIGINT, 680)) AS i FROM w WHERE len(w) > 0)""")
def t13_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.token_chunks(view(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")).select("document_id", "chunk_no", "chunk_id")


@BOOK.query("SELECT doc_id, regexp_replace(regexp_replace(translate(lower(text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM documents")
def t14_snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", T.snake_case(F.col("text")).alias("name"))


@BOOK.query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN '{}' ELSE props END AS answer FROM events")
def t15_tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("event_id"), F.col("props")
    raw = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("Here it is: "), p, F.lit(" done"))).when(n % 4 == 2, p).otherwise(F.concat(F.lit("{"), p))
    return view(spark, sf_dir, "events").select("event_id", T.tolerant_json(raw).alias("answer"))


@BOOK.query(f"""
WITH {LINES}, w AS (SELECT document_id, page, line_no % 3 AS profile, length(text) % 101 AS confidence FROM v_lines WHERE length(trim(text)) >= 2),
s AS (SELECT document_id, page, p.profile, coalesce((SELECT sum(confidence) FROM w WHERE w.document_id = d.document_id AND w.page = d.page AND w.profile = p.profile AND confidence >= 40), 0)::BIGINT AS score
      FROM (SELECT DISTINCT document_id, page, line_no % 3 AS profile FROM v_lines) d JOIN (VALUES (0), (1), (2)) p(profile) ON p.profile = d.profile)
SELECT document_id, page, 'p' || arg_max(profile, score * 10 - profile)::VARCHAR AS profile, max(score) AS score FROM s GROUP BY document_id, page""")
def t16_best_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("document_id", "page", "text", (F.col("line_no") % 3).alias("profile_no"), F.concat(F.lit("p"), (F.col("line_no") % 3).cast("string")).alias("profile"), (F.length("text") % 101).alias("confidence"))
    return T.word_table_score(rows)


# --- splitting --------------------------------------------------------------------------------------------


@BOOK.query(f"WITH {PAGES} SELECT document_id, page, ((n - 1) // 2 + 1)::INTEGER AS group_no FROM marked")
def p1_fixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fixed(page_signs(spark, sf_dir), 2).select("document_id", "page", "group_no")


SEPARATOR = """
c AS (SELECT *, last_value(bar IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM signs),
sep AS (SELECT *, bar IS NOT NULL AND (prev IS NULL OR bar <> prev) AND n > 1 AS cut FROM c)"""
PHYSICAL = """
q AS (SELECT *, last_value(bar IGNORE NULLS) OVER w AS pb, last_value(sig IGNORE NULLS) OVER w AS ps, last_value(num IGNORE NULLS) OVER w AS pn FROM signs
      WINDOW w AS (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
phy AS (SELECT *, (coalesce(bar <> pb, false) OR coalesce(sig <> ps, false) OR coalesce(num = 1 AND pn <> 0, false)) AND n > 1 AS cut FROM q)"""


@BOOK.query(f"WITH {PAGES}, {SEPARATOR} SELECT document_id, page, (sum(cut::INTEGER) OVER (PARTITION BY document_id ORDER BY page) + 1)::INTEGER AS group_no FROM sep")
def p2_separator_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.by_separator(page_signs(spark, sf_dir).withColumn("separator", F.col("barcode.value"))).select("document_id", "page", "group_no")


@BOOK.query(f"WITH {PAGES}, {PHYSICAL} SELECT document_id, page, (sum(cut::INTEGER) OVER (PARTITION BY document_id ORDER BY page) + 1)::INTEGER AS group_no FROM phy")
def p3_physical_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.physical(page_signs(spark, sf_dir)).select("document_id", "page", "group_no")


PRIORITY = f"""{PAGES}, {SEPARATOR}, {PHYSICAL},
cuts AS (SELECT sep.document_id, sep.page, sep.n, CASE sep.document_id % 3 WHEN 0 THEN sep.n > 1 AND (sep.n - 1) % 3 = 0 WHEN 1 THEN sep.cut ELSE phy.cut END AS cut FROM sep JOIN phy ON sep.document_id = phy.document_id AND sep.page = phy.page),
grouped AS (SELECT document_id, page, (sum(cut::INTEGER) OVER (PARTITION BY document_id ORDER BY page) + 1)::INTEGER AS group_no FROM cuts)"""


def _prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("document_id")
    rows = page_signs(spark, sf_dir).withColumns({"separator": F.col("barcode.value"), "fixed_pages": F.when(d % 3 == 0, 3).otherwise(0), "uses_separator": d % 3 < 2})
    return P.by_priority(rows)


@BOOK.query(f"WITH {PRIORITY} SELECT * FROM grouped")
def p4_split_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prioritised(spark, sf_dir).select("document_id", "page", "group_no")


@BOOK.query("""
SELECT c_custkey AS config_id, p_type AS doctype_id, p_name AS field_name FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 3 = 1 AND p_size % 2 = 0""")
def p5_separator_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    configs = view(spark, sf_dir, "customer").select(k.alias("config_id"), F.when(k % 3 == 1, F.array(k)).when(k % 3 == 2, F.array(k, k + 1)).otherwise(F.array().cast("array<bigint>")).alias("expected"))
    fields = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("doctype_id"), F.col("p_name").alias("field_name"), (F.col("p_size") % 2 == 0).alias("is_separator"), "p_type")
    found = P.separator_scope(configs, fields)
    return found.join(fields.select("doctype_id", "p_type"), "doctype_id").select("config_id", F.col("p_type").alias("doctype_id"), "field_name")


@BOOK.query(f"""
WITH {PRIORITY}, s AS (SELECT document_id, max(group_no) AS n, count(*) AS pages FROM grouped GROUP BY document_id)
SELECT document_id::VARCHAR AS document_id, CASE WHEN n > 1 THEN 'DEPRECATED' ELSE 'OCR_DONE' END AS status, pages FROM s
UNION ALL SELECT g.document_id::VARCHAR || '_split_' || lpad(group_no::VARCHAR, 5, '0'), 'OCR_DONE', count(*) FROM grouped g JOIN s ON s.document_id = g.document_id WHERE n > 1 GROUP BY g.document_id, group_no""")
def p6_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_documents(_prioritised(spark, sf_dir)).select("document_id", "status", "pages")


@BOOK.query("""
WITH i AS (
  SELECT event_id, k, CASE k WHEN 0 THEN 'Passeport' WHEN 1 THEN 'face' WHEN 2 THEN 'ID Card (back)' ELSE 'Visa' END AS label,
         CASE k WHEN 2 THEN 1.0 ELSE (event_id % 10) / 10.0 END::DOUBLE AS confidence, CASE WHEN k = 2 AND event_id % 5 = 0 THEN 0 ELSE 40 END::DOUBLE AS w, CASE WHEN k = 3 THEN 100.5 ELSE 12.34 END AS x
  FROM events, (VALUES (0), (1), (2), (3)) v(k))
SELECT event_id AS document_id, label, confidence, 12.3::DOUBLE AS x, w, count(*) OVER (PARTITION BY event_id) > 1 AS is_multi FROM i WHERE label <> 'face' AND confidence >= 0.4 AND w > 0 AND x <= 100""")
def p7_detected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four boxes for each event one is a face, one sometimes has no width, one lies off the page."""
    e = F.col("event_id")
    conf = ((e % 10) / 10.0).cast("string")
    item = lambda label, c, x, w: F.concat(F.lit(f'{{"type":"{label}","confidence":'), c, F.lit(f',"bbox":{{"x":{x},"y":"5","w":'), w, F.lit(',"h":50}}'))
    some = F.lit("40")
    items = F.concat_ws(",", item("Passeport", conf, 12.34, some), item("face", conf, 12.34, some), item("ID Card (back)", F.lit('"high"'), 12.34, F.when(e % 5 == 0, "0").otherwise("40")), item("Visa", conf, 100.5, some))
    answer = F.concat(F.lit('{"documents":['), items, F.lit("]}"))
    return P.detected(view(spark, sf_dir, "events").select(e.alias("document_id"), answer.alias("answer"))).select("document_id", "label", "confidence", "x", "w", "is_multi")


@BOOK.query("SELECT transaction_id FROM v_transactions WHERE config_id IN (SELECT c_mktsegment FROM customer JOIN part ON p_partkey = c_custkey WHERE p_size > 49 AND c_custkey % 7 = 0)")
def p8_barcode_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = view(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_mktsegment").alias("config_id"), F.col("c_custkey").alias("doctype_id"))
    fields = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("doctype_id"), F.when(F.col("p_size") > 49, "QR").otherwise(" ").alias("bcr_type"))
    return P.needs_barcodes(view(spark, sf_dir, "v_transactions"), configs, fields).select("transaction_id")
