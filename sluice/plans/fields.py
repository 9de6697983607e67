"""Queries on field extraction and classification, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import classify as L
from sluice.operators import definitions as D
from sluice.operators import extract as E
from sluice.operators.beside import if_few
from sluice.plans.binding import Book
from sluice.plans.pages import LINES, lines
from sluice.sources import versions
from sluice.sources.adapters import view
from sluice.sources.scratch import scratch

BOOK = Book()

MAIL = "[a-z]+[.][0-9]+@[a-z0-9.]+"
ADDRESS = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
LICENCE = "(Apache|MIT|GNU)[A-Za-z ]*"


def _candidates(reg: str) -> str:
    return f"(SELECT document_id, page, line_no, x0, x1, y0, y1, text, regexp_extract(text, '{reg}') AS value FROM v_lines WHERE regexp_matches(text, '{reg}'))"


@BOOK.query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'model' WHEN p_size % 3 = 0 OR p_size % 7 = 0 THEN 'rules' ELSE 'skipped' END AS strategy FROM part")
def e1_field_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    rows = view(spark, sf_dir, "part").select("p_partkey", (n % 5 == 0).alias("use_ia"), F.when(n % 3 == 0, "x+").otherwise(" ").alias("regexp"), F.lit("").alias("anchors"), F.when(n % 7 == 0, "QR").alias("bcr_type"), F.lit(None).cast("string").alias("zone"), F.lit("").alias("page_zone"))
    return E.route(rows).select("p_partkey", "strategy")


@BOOK.query(f"""
WITH {LINES}, h AS (SELECT 'mail' AS field_name, * FROM {_candidates('(?i)' + MAIL)} UNION ALL SELECT 'ip', * FROM {_candidates(ADDRESS)} UNION ALL SELECT 'licence', * FROM {_candidates(LICENCE)})
SELECT document_id, field_name, arg_min(value, page * 1000000 + line_no) AS value FROM h GROUP BY document_id, field_name""")
def e2_regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regex_fields(lines(spark, sf_dir), {"mail": f"/{MAIL}/i", "ip": ADDRESS, "licence": f"/{LICENCE}/"})


@BOOK.query(f"WITH {LINES} SELECT document_id, arg_min(value, page * 1000000 + line_no) AS value FROM {_candidates('[A-Z][a-z]+')} WHERE x1 BETWEEN 20 AND 90 AND y0 BETWEEN 20 AND 60 GROUP BY document_id")
def e3_zone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.zone_match(lines(spark, sf_dir), "[A-Z][a-z]+", (20, 20, 90, 60))


@BOOK.query(rf"""
WITH {LINES},
l AS (SELECT document_id, page, line_no, string_split_regex(text, '[A-Z][a-z]+') AS gaps, regexp_extract_all(text, '[A-Z][a-z]+') AS found, text FROM v_lines),
m AS (SELECT document_id, page, line_no, found[i] AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS st
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM l)),
k AS (SELECT document_id, page, line_no, term, length(w) AS n, list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * length(w) AS mark
      FROM (SELECT *, unnest(range(1, len(parts))) AS j FROM (SELECT l.*, term, w, string_split(lower(text), w) AS parts FROM l, (VALUES (0, 'under the'), (1, 'the')) a(term, w)))),
p AS (SELECT k.document_id, k.page, value, row_number() OVER (PARTITION BY k.document_id, k.page ORDER BY term, st - mark - n, k.line_no, mark, st) AS r
      FROM k JOIN m ON k.document_id = m.document_id AND k.line_no = m.line_no WHERE st >= mark + n AND st - mark - n <= 60)
SELECT document_id, page, value FROM p WHERE r = 1""")
def e4_anchor_same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.same_line(lines(spark, sf_dir), "[A-Z][a-z]+", "the, under the", "right", 20)


@BOOK.query(f"""
WITH {LINES}, a AS (SELECT document_id, page, line_no AS a_no, x0 AS ax0, x1 AS ax1, y0 AS ay0, y1 AS ay1 FROM v_lines WHERE contains(lower(text), 'license') OR contains(lower(text), 'and or')),
p AS (SELECT i.document_id, i.page, value, a_no, line_no, (x0 + x1 - ax0 - ax1) / 2 AS dx, (y0 + y1 - ay0 - ay1) / 2 AS dy, y0, ay1 FROM a JOIN {_candidates('[A-Z][a-z]+')} i ON a.document_id = i.document_id AND a.page = i.page WHERE a_no <> line_no),
s AS (SELECT *, round(sqrt(dx * dx + dy * dy) + CASE WHEN y0 <= ay1 THEN 1000 ELSE 0 END + abs(dy) * 5, 6) AS score FROM p WHERE sqrt(dx * dx + dy * dy) <= 70),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY score, a_no, line_no) AS r FROM s)
SELECT document_id, page, value FROM r WHERE r = 1""")
def e5_anchor_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nearest_line(lines(spark, sf_dir), "[A-Z][a-z]+", "license|and or", "below", 70)


@BOOK.query(rf"""
WITH {LINES}, t AS (SELECT document_id, page, line_no, term, substr(text, strpos(lower(text), w) + length(w)) AS rest FROM v_lines, (VALUES (0, 'apache license'), (1, 'reserved.')) a(term, w) WHERE strpos(lower(text), w) > 0),
v AS (SELECT *, trim(regexp_replace(trim(ltrim(rest, ' ' || chr(9) || ':：;,-—–=.' || chr(160)), E' \n\r\t'), '(?s)\s+(?:[\p{{L}}.]+\s+){{0,3}}[\p{{L}}.]+\s*:.*', '')) AS value FROM t),
own AS (SELECT document_id, page, arg_min(value, term * 1000000 + line_no) AS value FROM v WHERE value <> '' GROUP BY document_id, page),
i AS (SELECT *, trim(ltrim(text, ' ' || chr(9) || ':：;,-—–=.' || chr(160)), E' \n\r\t') AS value FROM v_lines),
near AS (
  SELECT i.document_id, i.page, i.value, row_number() OVER (PARTITION BY i.document_id, i.page ORDER BY round(sqrt(pow((i.x0 + i.x1 - a.x0 - a.x1) / 2, 2) + pow((i.y0 + i.y1 - a.y0 - a.y1) / 2, 2)) + CASE WHEN i.y0 <= a.y1 THEN 1000 ELSE 0 END
         + abs((i.y0 + i.y1 - a.y0 - a.y1) / 2) * 5, 6), a.line_no, i.line_no) AS r
  FROM v_lines a JOIN i ON a.document_id = i.document_id AND a.page = i.page AND a.line_no <> i.line_no
  WHERE (contains(lower(a.text), 'apache license') OR contains(lower(a.text), 'reserved.')) AND i.value <> '' AND (a.document_id, a.page) NOT IN (SELECT (document_id, page) FROM own))
SELECT * FROM own UNION ALL SELECT document_id, page, value FROM near WHERE r = 1""")
def e6_anchor_rest_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.after_anchor(lines(spark, sf_dir), "reserved.|Apache License", "below")


@BOOK.query(f"""
WITH {LINES}, b AS (SELECT document_id, page, line_no % 5 AS n, CASE WHEN length(text) % 2 = 0 THEN 'Code 128' ELSE 'QR_CODE' END AS f, CASE WHEN length(text) % 3 = 0 THEN '' ELSE 'V' || length(text)::VARCHAR END AS value FROM v_lines)
SELECT document_id, page, arg_min(value, CASE WHEN f = 'Code 128' THEN n ELSE n + 100 END) AS value FROM b WHERE value <> '' AND value <> 'V1' GROUP BY document_id, page""")
def e7_barcode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    codes = lines(spark, sf_dir).select("document_id", "page", (F.col("line_no") % 5).alias("n"), F.when(n % 2 == 0, "Code 128").otherwise("QR_CODE").alias("format"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("V"), n.cast("string"))).alias("value"))
    return E.barcode_value(codes, "CODE_128", "V([02-9]|1.)")


def _field_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields, the same at every scale: the words that are looked for."""
    one = view(spark, sf_dir, "region").filter("r_regionkey < 3")
    k = F.col("r_regionkey")
    return one.select(F.concat(F.lit("f"), k.cast("string")).alias("field_name"), F.when(k == 1, "th|zz").alias("black_words"), F.when(k == 1, "blocked").when(k == 2, "none").alias("default_value"), (k < 2).alias("required"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three fields: first capitalised word, first word of the zone, first long word of each page."""
    rows = lines(spark, sf_dir)
    of = lambda field, strategy, reg, cond: rows.filter(cond).select("document_id", "page", "line_no", F.lit(field).alias("field_name"), F.lit(strategy).alias("strategy"), F.regexp_extract("text", reg, 0).alias("value")).filter("value <> ''").groupBy("document_id", "page", "field_name", "strategy").agg(F.min_by("value", "line_no").alias("value"))
    return of("f0", "regex", "[A-Z][a-z]+", "true").unionByName(of("f0", "zone", "[a-z]+", "x1 < 40")).unionByName(of("f1", "anchor", "[a-z]{9,}", "true")).unionByName(of("f2", "barcode", "[0-9]+", "true"))


VALUES = f"""{LINES},
cand AS (
  SELECT document_id, page, 'f0' AS field_name, 3 AS s, arg_min(regexp_extract(text, '[A-Z][a-z]+'), line_no) AS value FROM v_lines WHERE regexp_matches(text, '[A-Z][a-z]+') GROUP BY ALL
  UNION ALL SELECT document_id, page, 'f0', 2, arg_min(regexp_extract(text, '[a-z]+'), line_no) FROM v_lines WHERE regexp_matches(text, '[a-z]+') AND x1 < 40 GROUP BY ALL
  UNION ALL SELECT document_id, page, 'f1', 1, arg_min(regexp_extract(text, '[a-z]{{9,}}'), line_no) FROM v_lines WHERE regexp_matches(text, '[a-z]{{9,}}') GROUP BY ALL
  UNION ALL SELECT document_id, page, 'f2', 0, arg_min(regexp_extract(text, '[0-9]+'), line_no) FROM v_lines WHERE regexp_matches(text, '[0-9]+') GROUP BY ALL),
win AS (
  SELECT document_id, page, field_name, CASE WHEN field_name = 'f1' AND (contains(lower(v), 'th') OR contains(lower(v), 'zz')) THEN 'blocked' ELSE v END AS value
  FROM (SELECT document_id, page, field_name, arg_min(value, s) AS v FROM cand GROUP BY document_id, page, field_name))"""
ACROSS = f"""{VALUES},
fld AS (SELECT * FROM (VALUES ('f0', '', true), ('f1', 'blocked', true), ('f2', 'none', false)) f(field_name, d, required)),
acr AS (
  SELECT doc_id AS document_id, f.field_name, coalesce((SELECT arg_min(value, page) FROM win w WHERE w.document_id = doc_id AND w.field_name = f.field_name AND value <> '' AND value <> d), d) AS value FROM documents, fld f)"""


DEFINED = f"""{LINES},
d AS (SELECT * FROM (VALUES
  ('en', 'mail', '(?i){MAIL}', '', '', 0, '', '', ''), ('en', 'owner', '[A-Z][a-z]+', 'license|and or', 'below', 70, '', 'the', 'nobody'), ('en', 'word', '[A-Z][a-z]+', '', '', 0, '20,20,90,60', '', ''),
  ('de', 'ip', '{ADDRESS}', '', '', 0, '', '', '0.0.0.0'), ('de', 'mail', '{MAIL}', 'der, und', 'right', 20, '', '', ''), ('fr', 'number', '[0-9]+', 'les|la', 'left', 0, '', '55', 'none')
) t(doctype, field_name, regexp, anchors, direction, reach, zone, black_words, default_value)),
l AS (SELECT v.*, lang AS doctype FROM v_lines v JOIN documents ON doc_id = document_id WHERE trim(v.text) <> ''),
hit AS (SELECT l.*, d.* EXCLUDE (doctype), regexp_extract(text, regexp) AS value FROM l JOIN d ON l.doctype = d.doctype WHERE regexp_matches(text, regexp)),
terms AS (SELECT *, row_number() OVER (PARTITION BY doctype, field_name ORDER BY length(term) DESC) AS no FROM (SELECT doctype, field_name, trim(lower(unnest(string_split(replace(anchors, '|', ','), ',')))) AS term FROM d WHERE anchors <> '')),
m AS (SELECT document_id, page, line_no, field_name, direction, reach, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT hit.*, string_split_regex(text, regexp) AS gaps, regexp_extract_all(text, regexp) AS found FROM hit)),
matches AS (SELECT *, found[i] AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS st FROM m),
k AS (SELECT document_id, page, line_no, field_name, no, length(term) AS n, list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * length(term) AS mark
      FROM (SELECT *, unnest(range(1, len(parts))) AS j FROM (SELECT l.document_id, l.page, l.line_no, terms.*, string_split(lower(text), term) AS parts FROM l JOIN terms ON terms.doctype = l.doctype))),
same AS (
  SELECT document_id, page, field_name, value, row_number() OVER (PARTITION BY document_id, page, field_name ORDER BY no, abs(st - mark - n), line_no, mark, st) AS r
  FROM k JOIN matches USING (document_id, page, line_no, field_name)
  WHERE CASE direction WHEN 'right' THEN st >= mark + n WHEN 'left' THEN st < mark WHEN '' THEN st >= mark + n ELSE true END AND (reach = 0 OR abs(st - mark - n) <= 3 * reach)),
anchored AS (SELECT DISTINCT l.document_id, l.page, l.line_no AS a_no, field_name, x0 AS ax0, x1 AS ax1, y0 AS ay0, y1 AS ay1 FROM l JOIN terms ON terms.doctype = l.doctype WHERE contains(lower(text), term)),
near AS (
  SELECT document_id, page, field_name, value, row_number() OVER (PARTITION BY document_id, page, field_name ORDER BY round(far + CASE WHEN direction = 'below' AND y0 <= ay1 OR direction = 'right' AND x0 <= ax1 OR direction = 'left' AND x1 >= ax0 THEN 1000 ELSE 0 END + abs(dy) * 5, 6), a_no, line_no) AS r
  FROM (SELECT *, sqrt(dx * dx + dy * dy) AS far FROM (SELECT hit.*, a_no, ax0, ax1, ay0, ay1, (x0 + x1 - ax0 - ax1) / 2 AS dx, (y0 + y1 - ay0 - ay1) / 2 AS dy FROM hit JOIN anchored USING (document_id, page, field_name) WHERE a_no <> line_no)) WHERE reach = 0 OR far <= reach),
cand AS (
  SELECT document_id, page, field_name, 1 AS s, value FROM same WHERE r = 1
  UNION ALL SELECT document_id, page, field_name, 2, value FROM near WHERE r = 1
  UNION ALL SELECT document_id, page, field_name, 3, arg_min(value, line_no) FROM hit WHERE zone <> '' AND x1 BETWEEN 20 AND 90 AND y0 BETWEEN 20 AND 60 GROUP BY ALL
  UNION ALL SELECT document_id, page, field_name, 4, arg_min(value, line_no) FROM hit GROUP BY ALL),
values_ AS (
  SELECT c.document_id, c.page, c.field_name, CASE WHEN black_words <> '' AND contains(lower(v), black_words) THEN default_value ELSE v END AS value
  FROM (SELECT document_id, page, field_name, arg_min(value, s) AS v FROM cand GROUP BY ALL) c JOIN documents ON doc_id = document_id JOIN d ON d.doctype = lang AND d.field_name = c.field_name)"""


def definitions(spark: SparkSession) -> DataFrame:
    """Fields of three types, as the catalogue of types would give them."""
    rows = [
        ("en", "mail", f"/{MAIL}/i", "", "", "", "", "", "", ""), ("en", "owner", "[A-Z][a-z]+", "license|and or", "below", "70", "", "", "the", "nobody"), ("en", "word", "[A-Z][a-z]+", "", "", "x", "20,20,90,60", "", "", ""),
        ("de", "ip", ADDRESS, "", "", "", "1,2,3", "", "", "0.0.0.0"), ("de", "mail", MAIL, "der, und", "right", "20", "", "", "", ""), ("fr", "number", "[0-9]+", "les|la", "left", "0", "", "", "55", "none"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in D.DEFINITION))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("doctype"))


@BOOK.query(f"WITH {DEFINED} SELECT document_id, page, field_name, value FROM values_")
def e8_defined_page_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_values(lines(spark, sf_dir), _typed(spark, sf_dir), definitions(spark))


@BOOK.query(f"""
WITH {DEFINED}
SELECT doc_id AS document_id, d.field_name, coalesce((SELECT arg_min(value, page) FROM values_ w WHERE w.document_id = doc_id AND w.field_name = d.field_name AND value <> '' AND value <> default_value), default_value) AS value
FROM documents JOIN d ON d.doctype = lang""")
def e9_defined_document_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = _typed(spark, sf_dir), definitions(spark)
    return D.document_values(D.page_values(lines(spark, sf_dir), docs, fields), docs, fields)


@BOOK.query(f"WITH {VALUES} SELECT document_id, page, field_name, value FROM win")
def e8_strategy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.winners(_values(spark, sf_dir), _field_frame(spark, sf_dir))


def _across(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _field_frame(spark, sf_dir)
    return E.across_pages(E.winners(_values(spark, sf_dir), fields), fields, view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")))


@BOOK.query(f"WITH {ACROSS} SELECT document_id, field_name, value FROM acr")
def e9_page_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _across(spark, sf_dir)


@BOOK.query("""
SELECT c_custkey AS document_id, CASE c_custkey % 3 WHEN 0 THEN 'TD3' WHEN 1 THEN 'TD1' ELSE 'TD2' END AS format, CASE c_custkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'I' ELSE 'V' END AS document_type, 'UTO' AS country,
       lpad(c_custkey::VARCHAR, 9, '0') AS number, 'FRA' AS nationality, '740812' AS born, 'F' AS sex, '320415' AS expires, 'CUSTOMER' AS surname, 'ANNA MARIA' AS given, c_custkey % 7 <> 0 AS valid FROM customer""")
def e10_machine_readable_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of all three formats are made from customers, as a reader might give them: with spaces, one line too long; every seventh has a wrong check digit."""
    k = F.col("c_custkey")
    digit = lambda c: E.check_digit(c).cast("string")
    number = F.lpad(k.cast("string"), 9, "0")
    checked = F.concat(number, ((E.check_digit(number) + F.when(k % 7 == 0, 1).otherwise(0)) % 10).cast("string"))
    born, till = F.concat(F.lit("740812"), digit(F.lit("740812"))), F.concat(F.lit("320415"), digit(F.lit("320415")))
    names = F.concat(F.upper(F.regexp_replace("c_name", "[^A-Za-z]", "")), F.lit("<<ANNA MARIA"))
    td3 = F.concat(checked, F.lit("FRA"), born, F.lit("F"), till, F.lit("<" * 14), F.lit("0"))
    td2 = F.concat(checked, F.lit("FRA"), born, F.lit("F"), till, F.lit("<" * 7))
    td1, two = F.concat(F.lit("I<UTO"), checked, F.lit("<" * 15)), F.concat(born, F.lit("F"), till, F.lit("FRA"), F.lit("<" * 11))
    full = lambda c, n: F.rpad(c, n, "<")
    rows = (
        F.when(k % 3 == 0, F.array(F.lit("noise"), full(F.concat(F.lit("P<UTO"), names), 46), F.concat(td3, digit(F.concat(checked, born, till, F.lit("<" * 14), F.lit("0"))))))
        .when(k % 3 == 1, F.array(td1, F.concat(two, digit(F.concat(checked, F.lit("<" * 15), born, till, F.lit("<" * 11)))), full(names, 30), F.lit("noise")))
        .otherwise(F.array(full(F.concat(F.lit("V<UTO"), names), 36), F.concat(td2, digit(F.concat(checked, born, till, F.lit("<" * 7))))))
    )
    read = view(spark, sf_dir, "customer").select(k.alias("document_id"), F.lit(1).alias("page"), F.posexplode(rows).alias("line_no", "text"))
    return E.mrz(read).drop("optional")


@BOOK.query("""
SELECT event_id AS document_id, f AS field_name, CASE f WHEN 'a' THEN event_type WHEN 'b' THEN CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE '' END ELSE '' END AS value,
       CASE f WHEN 'a' THEN 0.5 WHEN 'b' THEN CASE WHEN event_id % 2 = 0 THEN 0.75 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS score FROM events, (VALUES ('a'), ('b'), ('c')) v(f)""")
def e11_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"value":"'), F.col("user_id").cast("string"), F.lit('","score":"0.75"}'))).otherwise('""')
    answers = view(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.concat(F.lit('{"a":"'), "event_type", F.lit('","b":'), b, F.lit("}")).alias("answer"))
    names = view(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.substring(F.lit("abc"), F.col("r_regionkey") + 1, F.lit(1)).alias("field_name"))
    return E.model_answers(answers, names)


@BOOK.query(f"WITH {ACROSS} SELECT document_id, field_name, CASE WHEN field_name = 'f0' AND document_id % 2 = 0 THEN 'model' ELSE value END AS value, CASE WHEN field_name = 'f0' AND document_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM acr")
def e12_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _across(spark, sf_dir).select("document_id", "field_name", "value", F.lit(1.0).alias("score"), F.lit(0).alias("position"))
    docs = view(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"))
    model = docs.select("document_id", F.lit("f0").alias("field_name"), F.explode(F.array(F.struct(F.lit("early").alias("value"), F.lit(0.1).alias("score"), F.lit(0).alias("position")), F.struct(F.lit("model").alias("value"), F.lit(0.5).alias("score"), F.lit(1).alias("position")))).alias("m")).select("document_id", "field_name", "m.*")
    return E.merged(rules, model)


@BOOK.query(f"""
WITH {ACROSS}, v AS (SELECT document_id, field_name, value, CASE field_name WHEN 'f0' THEN 0.95 WHEN 'f1' THEN CASE WHEN document_id % 3 = 0 THEN 0 ELSE 1 END ELSE 0.91 END AS s FROM acr WHERE trim(value) <> '')
SELECT d.doc_id AS document_id, 3::BIGINT AS total_fields, 2 AS required_fields, count(v.value) AS extracted_fields,
       array_to_string(list_filter(['f0', 'f1'], lambda f: NOT list_contains(coalesce(list(v.field_name), []), f)), ',') AS missing_required,
       round(coalesce(min(s), 0), 3)::DOUBLE AS min_score, round(coalesce(avg(s), 0), 3)::DOUBLE AS avg_score,
       len(list_filter(['f0', 'f1'], lambda f: NOT list_contains(coalesce(list(v.field_name), []), f))) = 0 AND count(v.value) > 0 AND coalesce(min(s), 0) >= 0.9 AS extraction_ok
FROM documents d LEFT JOIN v ON v.document_id = d.doc_id GROUP BY d.doc_id""")
def e13_extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("field_name") == "f0", "0.95").when(F.col("field_name") == "f1", F.when(F.col("document_id") % 3 == 0, "n/a").otherwise("1")).otherwise("0.91")
    return E.summary(_across(spark, sf_dir).withColumn("score", score), _field_frame(spark, sf_dir), view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")))


@BOOK.query("""
SELECT d.document_id, CASE WHEN c.need_validation THEN 'PENDING_VALIDATION' WHEN d.position % 3 = 0 THEN 'VALIDATED' WHEN d.position % 4 = 1 AND discount < 0.05 THEN 'PENDING_VALIDATION' ELSE 'VALIDATED' END AS status
FROM v_documents d JOIN v_transactions t ON t.transaction_id = d.transaction_id JOIN v_configs c ON c.config_id = t.config_id""")
def e14_auto_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents").join(view(spark, sf_dir, "v_transactions").select("transaction_id", "config_id"), "transaction_id").join(view(spark, sf_dir, "v_configs").select("config_id", "need_validation"), "config_id")
    p = F.col("position")
    rows = docs.select("document_id", "need_validation", F.when(p % 3 == 0, "0").otherwise("0.05").alias("threshold"), F.when(p % 4 == 0, "").when(p % 4 == 1, F.col("discount").cast("string")).when(p % 4 == 2, "high").alias("score"))
    return E.validation_status(rows, rows.select("document_id", "score"))


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extracted and one metadata row for each document."""
    made = F.explode(F.array(F.struct(F.lit("extracted").alias("index_type"), F.lit("quantity").alias("index_name"), F.col("quantity").cast("int").cast("string").alias("index_value")), F.struct(F.lit("metadata").alias("index_type"), F.lit("doctype").alias("index_name"), F.col("doctype").alias("index_value"))))
    return view(spark, sf_dir, "v_documents").select("document_id", "position", made.alias("i")).select("document_id", "position", "i.*")


INDEXES = """
ind AS (SELECT document_id, position, 'extracted' AS index_type, 'quantity' AS index_name, quantity::INTEGER::VARCHAR AS index_value FROM v_documents
        UNION ALL SELECT document_id, position, 'metadata', 'doctype', doctype FROM v_documents)"""


@BOOK.query(f"""
WITH {INDEXES} SELECT document_id, index_type, index_name, index_value FROM ind WHERE index_type <> 'extracted' OR position % 2 <> 0
UNION ALL SELECT document_id, 'extracted', 'again', 'v' FROM v_documents WHERE position % 4 = 0""")
def e15_index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _indexes(spark, sf_dir)
    news = old.filter("index_type = 'extracted' and position % 2 = 0").select("document_id", F.lit("again").alias("index_name"), F.when(F.col("position") % 4 == 0, "v").otherwise(" ").alias("index_value"))
    return E.replace_indexes(old.select("document_id", "index_type", "index_name", "index_value"), news)


@BOOK.query("""
WITH r AS (SELECT document_id, quantity::INTEGER AS q FROM v_documents),
w AS (SELECT document_id, q, q % 9 AS k FROM r WHERE NOT (q % 9 = 0 AND q % 2 = 0))
SELECT document_id, 'quantity__consolidation_status' AS index_name, CASE WHEN k = 0 THEN 'ERROR' WHEN k IN (1, 2, 5, 6) THEN 'VALID' ELSE 'INVALID' END AS index_value FROM w
UNION ALL SELECT document_id, 'name', 'n' || q::VARCHAR FROM w WHERE k > 0""")
def e16_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies yes, found, no, not_found, later (a value that is not a no), true, false and none at all; of the failures, those of even values stop their document."""
    q = F.col("value").cast("int")
    rows = _indexes(spark, sf_dir).filter("index_type = 'extracted'").select("document_id", F.concat(F.lit("t"), (F.col("index_value").cast("int") % 2).cast("string")).alias("doctype"), F.col("index_name").alias("field_name"), F.col("index_value").alias("value"))
    k = F.col("r_regionkey")
    definition = view(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.lit("check").alias("name"), F.concat(F.lit("t"), k.cast("string")).alias("doctype"), F.lit("quantity").alias("field_name"), F.lit("state").alias("status_key"), F.create_map(F.lit("name"), F.lit("n"), F.lit("gone"), F.lit("x")).alias("mapping"), F.when(k == 0, "error").otherwise("skip").alias("on_failure"))
    words = {1: '"yes"', 2: '" Found"', 3: '"no"', 4: '"not_found"', 5: '"later"', 6: "true", 7: "false", 8: '""'}
    told = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[q % 9]
    replies = rows.select("value").distinct().filter(q % 9 != 0).select(F.lit("check").alias("name"), "value", F.concat(F.lit('{"state":'), told, F.lit(',"n":"n'), "value", F.lit('"}')).alias("reply"))
    return E.enrich(rows, definition, replies)


@BOOK.query("""
SELECT o_orderkey AS transaction_id, f AS field_name, CASE f WHEN 'f0' THEN '2024_03_31' WHEN 'f1' THEN o_orderkey::VARCHAR WHEN 'f2' THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'dflt' END WHEN 'f3' THEN '31/03/2024 03:30:00' ELSE 'none' END AS value
FROM orders, (VALUES ('f0'), ('f1'), ('f2'), ('f3'), ('f4')) v(f)""")
def e17_propagated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.create_map(F.lit("Prio"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" "), F.lit("@today"), F.col("o_orderstatus"))
    tx = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.lit("cfg").alias("config_name"), context.alias("context"))
    k = F.col("r_regionkey")
    source = F.when(k == 0, "@Today ").when(k == 1, "@transaction_id").when(k == 2, "PRIO").when(k == 3, "@now").otherwise("@today")
    kind = F.when(k == 2, "Context").when(k == 4, "other").otherwise("computed")
    fields = view(spark, sf_dir, "region").filter("r_regionkey < 5").select(F.concat(F.lit("f"), k.cast("string")).alias("field_name"), kind.alias("source_type"), source.alias("source"), F.when(k == 2, "dflt").when(k == 4, "none").alias("default_value"))
    return E.propagated(tx, fields, F.lit("2024-03-31 01:30:00").cast("timestamp"))


@BOOK.query(f"""
WITH {INDEXES}, m AS (SELECT document_id, index_name, index_value, position FROM ind WHERE index_type = 'metadata')
SELECT document_id, index_name, CASE WHEN position % 2 = 0 THEN 'new' ELSE index_value END AS index_value FROM m""")
def e18_metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _indexes(spark, sf_dir).filter("index_type = 'metadata'")
    items = F.array(F.struct(F.lit("first").alias("index_value"), F.lit(1).alias("position")), F.struct(F.lit("new").alias("index_value"), F.lit(2).alias("position")), F.struct(F.lit("").alias("index_value"), F.lit(3).alias("position")))
    news = old.filter("position % 2 = 0").select("document_id", "index_name", F.explode(items).alias("i")).select("document_id", "index_name", "i.*")
    return E.metadata_upsert(old, news)


@BOOK.query(f"""
WITH {INDEXES}, c AS (SELECT document_id, transaction_id::VARCHAR || '_1' AS parent_id FROM v_documents WHERE position > 1)
SELECT c.document_id, index_type, index_name, index_value, '1' AS index_score FROM c JOIN ind ON ind.document_id = c.parent_id
UNION ALL SELECT document_id, 'extracted', 'own', document_id, '0.7' FROM c""")
def e19_index_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents").filter("position > 1").select("document_id", F.concat(F.col("transaction_id").cast("string"), F.lit("_1")).alias("parent_id"), "position")
    odd = F.col("position") % 2 == 1
    own = docs.select("document_id", F.lit("extracted").alias("index_type"), F.when(odd, "own").alias("index_name"), F.when(odd, F.col("document_id")).alias("index_value"), F.when(~odd, "own").alias("name"), F.when(~odd, F.col("document_id")).alias("value"), F.lit("0.7").alias("index_score"))
    return E.inherited(docs, _indexes(spark, sf_dir).select("document_id", "index_type", "index_name", "index_value"), own)


@BOOK.query("SELECT 'd' || transaction_id::VARCHAR AS document_id FROM v_transactions WHERE transaction_id % 3 = 0")
def e20_parent_deprecation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = view(spark, sf_dir, "v_transactions").select("transaction_id")
    base = F.concat(F.lit("d"), F.col("transaction_id").cast("string"))
    docs = tx.select(base.alias("document_id"), F.lit(False).alias("is_new"))
    news = tx.filter("transaction_id % 3 = 0").select(F.concat(base, F.lit("_00001")).alias("document_id"))
    return E.deprecated_parents(news, docs.unionByName(news.withColumn("is_new", F.lit(True))))


@BOOK.query(f"""
WITH {INDEXES} SELECT document_id, index_type, index_name, index_value, '0.4' AS index_score FROM ind WHERE index_type = 'metadata' OR position % 3 <> 0
UNION ALL SELECT document_id, 'extracted', 'fixed', 'x', '1.0' FROM v_documents WHERE position % 3 = 0""")
def e21_human_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents")
    old = _indexes(spark, sf_dir).select("document_id", "index_type", "index_name", "index_value", F.lit("0.4").alias("index_score"))
    items = F.array(F.struct(F.lit("fixed").alias("index_name"), F.lit("x").alias("index_value")), F.struct(F.lit(" ").alias("index_name"), F.lit("y").alias("index_value")))
    news = docs.filter("position % 3 = 0").select("document_id", F.explode(items).alias("i")).select("document_id", "i.*")
    return E.corrected(docs, old, news)[1]


@BOOK.query("""
SELECT document_id, f AS field_name, CASE f WHEN 'quantity' THEN quantity::INTEGER::VARCHAR WHEN 'doctype' THEN doctype ELSE '' END AS value, f <> 'doctype' AS defined, CASE f WHEN 'zip' THEN 1 WHEN 'quantity' THEN 2 ELSE 3 END AS place
FROM v_documents, (VALUES ('zip'), ('quantity'), ('doctype')) v(f)""")
def e22_validation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "v_documents")
    fields = docs.select("document_id", F.explode(F.array(F.struct(F.lit("zip").alias("field_name"), F.lit(1).alias("position")), F.struct(F.lit("quantity").alias("field_name"), F.lit(2).alias("position")))).alias("f")).select("document_id", "f.*")
    return E.sheet(fields, _indexes(spark, sf_dir))


@BOOK.query(f"WITH {INDEXES} SELECT document_id, index_name, index_value FROM ind WHERE index_type = 'extracted'")
def e23_extracted_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extracted_only(_indexes(spark, sf_dir)).select("document_id", "index_name", "index_value")


# --- classification ---------------------------------------------------------------------------------------

RE_WORD = "[a-zàâäéèêëïîôöùûüç0-9]{3,}"
WORDS = f"""
dw AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '{RE_WORD}'))) AS word FROM documents),
st AS (SELECT lang AS label, word, count(*) AS n FROM dw GROUP BY lang, word),
wt AS (SELECT word, label, (CASE WHEN n >= 8 THEN 2.0 ELSE 0.25 END) * (CASE WHEN length(word) % 2 = 0 THEN 1 ELSE -0.5 END) AS weight FROM st WHERE n >= 3),
sc AS (SELECT doc_id, label, sum(weight)::DOUBLE AS score FROM dw JOIN wt ON dw.word = wt.word GROUP BY doc_id, label),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM sc),
lx AS (
  SELECT d.doc_id, max(label) FILTER (r = 1) AS label, coalesce(least(1.0, abs(max(score) FILTER (r = 1)) / 10), 0.0)::DOUBLE AS confidence,
         coalesce(max(score) FILTER (r = 1) - coalesce(max(score) FILTER (r = 2), 0), 0)::DOUBLE AS delta
  FROM documents d LEFT JOIN rk ON rk.doc_id = d.doc_id AND r <= 2 GROUP BY d.doc_id)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", F.col("lang").alias("label"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight table derived from the statistics; exact in binary, so sums do not depend on their order."""
    st = L.lexical_statistics(_labelled(spark, sf_dir)).filter("word is not null and n >= 3")
    return st.select("word", "label", (F.when(F.col("n") >= 8, 2.0).otherwise(0.25) * F.when(F.length("word") % 2 == 0, 1.0).otherwise(-0.5)).alias("weight"))


@BOOK.query(f"WITH {WORDS} SELECT doc_id AS document_id, label, confidence, delta FROM lx")
def l1_lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lexical(_labelled(spark, sf_dir), _weights(spark, sf_dir))


@BOOK.query(f"WITH {WORDS} SELECT label, word, n FROM st UNION ALL SELECT lang, NULL, count(*) FROM documents GROUP BY lang")
def l2_lexical_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lexical_statistics(_labelled(spark, sf_dir))


CENTRES = """
cen AS (SELECT label, embedding AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 2),
vs AS (SELECT vec_id, cen.label, max(round(list_dot_product(embedding::DOUBLE[], c::DOUBLE[]), 9)) AS score FROM embeddings, cen GROUP BY vec_id, cen.label),
vr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM vs),
vt AS (SELECT vec_id, max(label) FILTER (r = 1) AS label, max(score) FILTER (r = 1) AS score, max(score) FILTER (r = 1) - max(score) FILTER (r = 2) AS delta FROM vr WHERE r <= 2 GROUP BY vec_id)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two vectors of each of the ten labels."""
    rows = view(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    # twice a minimum, which is pre-aggregated, so that no label's vectors gather in one row
    one = rows.groupBy("label").agg(F.min("vec_id").alias("first"))
    two = rows.join(if_few(one.withColumnRenamed("label", "of"), other="merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("vec_id") > F.col("first"))).groupBy("label").agg(F.min("vec_id").alias("first"))
    firsts = one.union(two).withColumnRenamed("label", "of")
    return rows.join(if_few(firsts, other="merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("vec_id") == F.col("first"))).select("label", F.col("embedding").alias("vector"))


@BOOK.query(f"WITH {CENTRES} SELECT vec_id AS document_id, label, round(score, 6) AS score, round(delta, 6) AS delta FROM vt")
def l3_vector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.vector(_vectors(spark, sf_dir), _centres(spark, sf_dir))
    return found.select("document_id", "label", F.round("score", 6).alias("score"), F.round("delta", 6).alias("delta"))


@BOOK.query(f"""
WITH {CENTRES}, b AS (SELECT vec_id // 5 AS document_id, vec_id % 5 AS chunk_no, label, score FROM vt WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_no) AS r FROM b)
SELECT document_id, chunk_no, label FROM r WHERE r = 1""")
def l4_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = L.vector(_vectors(spark, sf_dir), _centres(spark, sf_dir)).withColumnRenamed("document_id", "vec_id")
    return L.best_chunk(scored.select(F.floor(F.col("vec_id") / 5).alias("document_id"), (F.col("vec_id") % 5).alias("chunk_no"), "label", "score", "delta")).select("document_id", "chunk_no", "label")


CASCADE = f"""{WORDS}, {CENTRES},
one AS (SELECT doc_id, label, confidence, 'lexical_v2' AS source FROM lx WHERE confidence >= 0.6 AND delta >= 0.2),
two AS (SELECT vec_id AS doc_id, 'v' || label::VARCHAR AS label, score AS confidence, 'embedding_v3' AS source FROM vt WHERE score >= 0.3 AND delta >= 0.02 AND vec_id NOT IN (SELECT doc_id FROM one) AND vec_id IN (SELECT doc_id FROM documents)),
cas AS (
  SELECT * FROM one UNION ALL SELECT * FROM two
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END, CASE WHEN doc_id % 2 = 0 THEN 0.81 ELSE 0 END, 'llm_vbootstrap' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM one) AND doc_id NOT IN (SELECT doc_id FROM two))"""


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labelled(spark, sf_dir)
    vectors, centres = _vectors(spark, sf_dir), _centres(spark, sf_dir).withColumn("label", F.concat(F.lit("v"), F.col("label").cast("string")))
    answers = view(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"), F.col("source").alias("label"), F.lit(0.81).alias("confidence"))
    return L.cascade(
        docs.select("document_id"), L.lexical(docs, _weights(spark, sf_dir)), vectors, centres, answers,
        versions={"lexical": "2", "embedding": "3", "llm": "bootstrap"}, vector_min=(0.3, 0.02),
    )


@BOOK.query(f"WITH {CASCADE} SELECT doc_id AS document_id, label, round(confidence, 4)::DOUBLE AS confidence, source FROM cas")
def l5_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir)


@BOOK.query(f"WITH {CASCADE} SELECT doc_id AS document_id, label, CASE WHEN round(confidence, 4) < 0.7 AND doc_id % 3 <> 0 THEN 'UNRECOGNIZED' ELSE 'CLASSIFIED' END AS status FROM cas")
def l6_recognition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recognition(_cascade(spark, sf_dir), F.lit(0.7), F.col("document_id") % 3 == 0).select("document_id", "label", "status")


@BOOK.query("""
WITH n AS (SELECT p_type AS name, p_brand AS description FROM part UNION ALL SELECT lang, NULL FROM documents UNION ALL SELECT event_type, NULL FROM events)
SELECT name, coalesce(max(description), '') AS description FROM n GROUP BY name""")
def l7_category_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = view(spark, sf_dir, "part").select(F.col("p_type").alias("doctype_name"), F.col("p_brand").alias("description"))
    return L.categories(types, view(spark, sf_dir, "documents").select(F.col("lang").alias("label")), view(spark, sf_dir, "events").select(F.col("event_type").alias("label")))


@BOOK.query("""
SELECT c_custkey AS config_id, p_partkey AS doctype_id FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, p_partkey FROM customer JOIN part ON p_partkey = c_custkey + 1 WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, p_partkey FROM customer JOIN part ON p_size = c_nationkey WHERE c_custkey % 3 = 2""")
def l8_doctype_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.array().cast("array<bigint>")
    configs = view(spark, sf_dir, "customer").select(k.alias("config_id"), F.col("c_nationkey").alias("account_id"), F.when(k % 3 == 0, F.array(k)).otherwise(none).alias("expected"), F.when(k % 3 < 2, F.array(k + 1)).otherwise(none).alias("old"))
    types = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("doctype_id"), F.col("p_size").alias("account_id"))
    return L.scope(configs, types, more=())


@BOOK.query("""
SELECT lang AS doctype, sha256(text) AS log_key, min(doc_id) AS document_id FROM documents WHERE lang <> 'unknown' AND trim(text) <> '' GROUP BY lang, sha256(text)""")
def l9_learning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.learning_log(_labelled(spark, sf_dir).withColumnRenamed("label", "doctype"))


@BOOK.query("""
WITH l AS (SELECT lang AS doctype, sha256(text) AS log_key, min(doc_id) AS document_id FROM documents WHERE trim(text) <> '' GROUP BY lang, sha256(text))
SELECT * FROM l WHERE log_key NOT IN (SELECT log_key FROM l WHERE document_id % 3 = 0)""")
def l10_incremental_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = L.learning_log(_labelled(spark, sf_dir).withColumnRenamed("label", "doctype"))
    return L.unprocessed(log, log.filter("document_id % 3 = 0"))


@BOOK.query()
def l11_centroid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "embeddings").select("label", F.format_string("%012d", "vec_id").alias("log_key"), F.col("embedding").alias("vector"))
    return L.centroids(log)


@BOOK.query("""
WITH v AS (SELECT * FROM (VALUES ('v1', 1), ('v2', 2)) v(version, sequence)),
l AS (SELECT v.version, v.sequence, label FROM embeddings, v WHERE v.sequence = 2 OR vec_id % 3 <> 0)
SELECT version, sequence::BIGINT AS sequence, array_to_string(list_sort(list(DISTINCT label::VARCHAR)), ',') AS classes, count(DISTINCT label) AS n_centroids, sequence = 2 AS latest FROM l GROUP BY ALL""")
def l12_model_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, the second from the log rows that the first has not seen; writing the second again changes nothing."""
    root = scratch(spark, "model")
    log = view(spark, sf_dir, "embeddings").select("label", F.format_string("%012d", "vec_id").alias("log_key"), F.col("embedding").alias("vector"))
    for rows, version in ((log.filter("vec_id % 3 <> 0"), "v1"), (log, "v2"), (log, "v2")):
        L.model_version(rows, root, version)
    pointer = versions.latest(spark, f"{root}/centroids")
    return versions.manifest(spark, f"{root}/centroids").select("version", "sequence", F.col("note").alias("classes"), F.col("n_rows").alias("n_centroids"), (F.col("version") == pointer).alias("latest"))


@BOOK.query("SELECT label, count(*) AS n_seen, 2 AS n_runs FROM embeddings GROUP BY label")
def l11_incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log in two portions: each row is folded once, in the run that first sees it."""
    root = scratch(spark, "model")
    log = view(spark, sf_dir, "embeddings").select("label", F.format_string("%012d", "vec_id").alias("log_key"), F.col("embedding").alias("vector"))
    middle = log.agg(F.percentile_approx(F.col("log_key").cast("long"), 0.5)).first()[0] or 0
    for rows, version in ((log.filter(F.col("log_key").cast("long") <= middle), "v1"), (log, "v2")):
        L.model_version(rows, root, version)
    seen = versions.load_all(spark, f"{root}/seen", L.SEEN.format(t=log.schema["label"].dataType.simpleString()) + ", version string")
    runs = versions.manifest(spark, f"{root}/centroids").agg(F.count("*").cast("int").alias("n_runs"))
    return seen.groupBy("label").agg(F.count("*").alias("n_seen")).crossJoin(F.broadcast(runs))  # one row


@BOOK.query("SELECT transaction_id, amount_u, CASE WHEN source = '' THEN '' ELSE split_part(source, '_v', 1) END AS method FROM v_costs")
def l13_classification_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.operators.report import classification_method

    return view(spark, sf_dir, "v_costs").select("transaction_id", "amount_u", classification_method(F.col("source")).alias("method"))


CATALOGUE = """
types AS (SELECT s_suppkey::VARCHAR AS doctype_id, 'type ' || (s_suppkey % 13)::VARCHAR AS doctype_name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS account_id, s_suppkey % 5 = 0 AS is_public FROM supplier),
configs AS (
  SELECT c_custkey AS config_id, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS account_id,
         CASE WHEN c_custkey % 4 = 0 THEN [(c_custkey % 10 + 3)::VARCHAR, (c_custkey % 10 + 1)::VARCHAR] ELSE [] END AS expected,
         CASE WHEN c_custkey % 4 = 1 THEN [(c_custkey % 10)::VARCHAR, 'gone'] ELSE [] END AS old FROM customer)"""


def catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Configs of each customer, of which some have no account, expect types or have an old list; and types of suppliers, with names that many share."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    types = view(spark, sf_dir, "supplier").select(s.cast("string").alias("doctype_id"), F.concat(F.lit("type "), (s % 13).cast("string")).alias("doctype_name"), F.when(s % 3 > 0, F.col("s_nationkey")).alias("account_id"), (s % 5 == 0).alias("is_public"))
    none, of = F.array().cast("array<string>"), lambda n: (c % 10 + n).cast("string")
    configs = view(spark, sf_dir, "customer").select(
        c.alias("config_id"), F.when(c % 7 > 0, F.col("c_nationkey")).alias("account_id"), F.when(c % 4 == 0, F.array(of(3), of(1))).otherwise(none).alias("expected"), F.when(c % 4 == 1, F.array(of(0), F.lit("gone"))).otherwise(none).alias("old")
    )
    return configs, types


@BOOK.query(f"""
WITH {CATALOGUE},
docs AS (SELECT o_orderkey AS document_id, o_custkey AS config_id, CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE 'type ' || (o_orderkey % 15)::VARCHAR END AS doctype FROM orders),
lists AS (SELECT config_id, unnest(w) AS doctype_id, generate_subscripts(w, 1) AS place FROM (SELECT config_id, CASE WHEN len(expected) > 0 THEN expected ELSE old END AS w FROM configs)),
candidates AS (
  SELECT d.document_id, t.doctype_id, 1 AS rank, l.place AS place FROM docs d JOIN lists l USING (config_id) JOIN types t ON t.doctype_id = l.doctype_id AND t.doctype_name = d.doctype WHERE d.doctype <> 'unknown'
  UNION ALL
  SELECT d.document_id, t.doctype_id, 2, 0 FROM docs d JOIN configs c USING (config_id) JOIN types t ON t.doctype_name = d.doctype
  WHERE d.doctype <> 'unknown' AND (c.account_id IS NULL OR t.is_public OR t.account_id = c.account_id))
SELECT document_id, doctype_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank, place, doctype_id) AS n FROM candidates) WHERE n = 1""")
def l8_resolved_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    docs = view(spark, sf_dir, "orders").select(k.alias("document_id"), F.col("o_custkey").alias("config_id"), F.when(k % 17 == 0, "unknown").otherwise(F.concat(F.lit("type "), (k % 15).cast("string"))).alias("doctype"))
    configs, types = catalogue(spark, sf_dir)
    return L.resolved(docs, configs, types)


@BOOK.query(f"""
WITH {CATALOGUE},
chosen AS (
  SELECT c.config_id, t.doctype_name || '/' || t.doctype_id AS item, t.doctype_name, t.doctype_id FROM configs c JOIN types t ON
    CASE WHEN len(c.expected) > 0 THEN list_contains(c.expected, t.doctype_id) WHEN c.account_id IS NULL THEN true ELSE t.is_public OR t.account_id = c.account_id END)
SELECT c.config_id, coalesce(string_agg(item, ',' ORDER BY doctype_name, doctype_id), '') AS choices FROM configs c LEFT JOIN chosen USING (config_id) GROUP BY c.config_id""", blank=("choices",))
def l14_reclassification_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs, types = catalogue(spark, sf_dir)
    joined = lambda c: F.array_join(F.transform(c, lambda t: F.concat(t["doctype_name"], F.lit("/"), t["doctype_id"])), ",")
    return L.choices(configs.drop("old"), types, joined)


@BOOK.query("""
WITH picks AS (SELECT event_id AS pick_id, user_id AS document_id, event_type AS name, event_id % 3 = 0 AS guess FROM events),
last AS (SELECT document_id, arg_max(name, pick_id) AS name, arg_max(guess, pick_id) AS guess FROM picks GROUP BY document_id)
SELECT o_orderkey AS document_id, CASE WHEN l.guess = false THEN l.name ELSE 'old' END AS doctype, CASE WHEN l.guess THEN 'OCR_READER' WHEN l.guess = false THEN 'CLASSIFIER' ELSE 'FIELD_EXTRACTOR' END AS process,
       CASE WHEN o_orderstatus = 'O' THEN CASE WHEN l.guess IS NULL THEN 'UNRECOGNIZED' ELSE 'OCR_DONE' END ELSE 'FAILED' END AS status
FROM orders LEFT JOIN last l ON l.document_id = o_orderkey""")
def l14_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = view(spark, sf_dir, "events").select(F.col("event_id").alias("pick_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("doctype_name"), (F.col("event_id") % 3 == 0).alias("guess"))
    docs = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit("old").alias("doctype"), F.lit("FIELD_EXTRACTOR").alias("process"), F.when(F.col("o_orderstatus") == "O", "UNRECOGNIZED").otherwise("FAILED").alias("status"))
    return L.reclassified(docs, picks)


@BOOK.query("""
SELECT p_partkey AS document_id, 0 AS n, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS field_name, CASE WHEN p_size % 2 = 0 THEN 'object' ELSE 'string' END AS field_type,
       CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN '' ELSE 'Total' END AS anchors, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN '' WHEN p_size % 3 = 0 THEN 'any' WHEN p_size % 3 = 1 THEN 'block' ELSE '' END AS direction,
       CASE WHEN p_size % 5 = 0 THEN '' ELSE 'x+' END AS regexp, p_size % 5 = 0 AS use_ia FROM part""")
def l15_proposed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    field = lambda name, kind, anchors, direction, ia: F.struct(name.alias("field_name"), kind.alias("field_type"), anchors.alias("anchors"), direction.alias("direction"), F.lit(" x+").alias("regexp"), ia.alias("use_ia"))
    one = field(F.col("p_name"), F.when(n % 2 == 0, "object").otherwise("amount"), F.when(n % 7 == 0, " ").otherwise("Total "), F.when(n % 3 == 0, "ANY").when(n % 3 == 1, "block").otherwise("up"), n % 5 == 0)
    two = field(F.lit(" - "), F.lit("date"), F.lit(""), F.lit(""), F.lit(False))
    answer = F.to_json(F.struct(F.array(one, two).alias("fields")))
    fenced = F.when(n % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```\nDone."))).otherwise(answer)
    return L.proposed_fields(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), fenced.alias("answer"))).drop("field_description")
