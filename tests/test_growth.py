"""Work that must not grow faster than its input, or gather in one task."""

from pyspark.sql import functions as F


def test_choices_are_put_together_once_for_a_scope(spark):
    from sluice.operators import classify as L

    configs = spark.range(60).select(F.col("id").alias("config_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("account_id"), F.when(F.col("id") % 4 == 0, F.array(F.lit("2"), F.lit("1"), F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("expected"))
    types = spark.range(12).select(F.col("id").cast("string").alias("doctype_id"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("doctype_name"), (F.col("id") % 4).alias("account_id"), (F.col("id") % 6 == 0).alias("is_public"))
    found = L.choices(configs, types)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "collect_list" not in plan  # what is joined with configs is put together and in order
    rows, every = types.collect(), {r.config_id: [(x.doctype_name, x.doctype_id) for x in r.choices] for r in found.collect()}
    for c in configs.collect():
        ok = lambda t: t.doctype_id in c.expected if c.expected else c.account_id is None or t.is_public or t.account_id == c.account_id  # noqa: B023, E731
        assert every[c.config_id] == sorted((t.doctype_name, t.doctype_id) for t in rows if ok(t))
    assert len(every) == 60


def test_types_of_one_account_are_dealt(spark):
    from sluice.operators import classify as L

    none = F.array().cast("array<bigint>")
    configs = spark.range(4_000).select(F.col("id").alias("config_id"), F.lit(1).alias("account_id"), none.alias("expected"), none.alias("old"))
    types = spark.range(50).select(F.col("id").alias("doctype_id"), F.col("id").cast("string").alias("doctype_name"), F.when(F.col("id") < 45, 1).otherwise(2).alias("account_id"))
    found = L.scope(configs, types)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4_000 * 45 and max(sizes) < 0.9 * sum(sizes)
    assert found.distinct().count() == 4_000 * 45 and found.filter("doctype_name <> cast(doctype_id as string)").isEmpty()


def test_copies_of_wide_rows_are_bounded(spark, monkeypatch):
    from sluice.operators import beside as B

    made, held = [], B.if_few
    monkeypatch.setattr(B, "if_few", lambda df, **k: (made.append(df.agg(F.sum("parts")).first()[0]), held(df, **k))[1])
    rows, wide = spark.range(30_000).select("id", (F.col("id") % 3).alias("k")), spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    found = B.spread(rows, wide, ["k"], "id", each=10)
    assert made[0] <= B.MOST_TASKS + 3 and found.rdd.getNumPartitions() <= B.MOST_TASKS
    assert found.count() == 30_000 and found.filter("w <> 2 * k").isEmpty()


def test_configs_meet_all_arrays_of_their_account(spark, monkeypatch):
    """A config is sent once for many arrays, and gets each type once."""
    from sluice.operators import classify as L

    monkeypatch.setattr(L, "TYPES_EACH", 2)
    asked, spread = [], L.spread
    monkeypatch.setattr(L, "spread", lambda rows, *a, **k: (asked.append(rows.count()), spread(rows, *a, **k))[1])
    none = F.array().cast("array<bigint>")
    configs = spark.range(30).select(F.col("id").alias("config_id"), (F.col("id") % 2).alias("account_id"), none.alias("expected"), none.alias("old"))
    types = spark.range(100).select(F.col("id").alias("doctype_id"), (F.col("id") % 2).alias("account_id"))
    found = L.scope(configs, types, more=())
    assert {tuple(r) for r in found.collect()} == {(c, t) for c in range(30) for t in range(100) if c % 2 == t % 2} and found.count() == 30 * 50
    assert asked[0] <= 30 * 2


def test_small_choices_meet_configs_without_copies(spark, monkeypatch):
    from sluice.operators import classify as L

    none = F.array().cast("array<string>")
    configs = spark.range(3_000).select(F.col("id").alias("config_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("account_id"), F.when(F.col("id") % 4 == 0, F.array(F.lit("2"))).otherwise(none).alias("expected"))
    types = spark.range(12).select(F.col("id").cast("string").alias("doctype_id"), F.lit("t").alias("doctype_name"), (F.col("id") % 4).alias("account_id"), (F.col("id") % 6 == 0).alias("is_public"))
    rows = lambda df: sorted((r.config_id, [tuple(x) for x in r.choices]) for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = L.choices(configs, types)
    assert "strategy=broadcast" in plan(small) and "lot" not in plan(small) and small.rdd.getNumPartitions() == 3
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    large = L.choices(configs, types)
    assert "lot" in plan(large) and rows(large) == rows(small)


def test_replies_are_joined_where_the_rows_are(spark):
    from sluice.operators import extract as E

    rows = spark.range(1_000).select((F.col("id") % 999).alias("document_id"), F.lit("t").alias("doctype"), F.lit("f").alias("field_name"), F.when(F.col("id") < 999, "7").otherwise("8").alias("value"))
    defined = spark.createDataFrame([("check", "t", "f", "state", {"n": "n", " ": "n", "gone": "x"}, "error")], "name string, doctype string, field_name string, status_key string, mapping map<string,string>, on_failure string")
    replies = spark.createDataFrame([("check", "7", '{"state":"yes","n":"n7"}')], "name string, value string, reply string")
    found = E.enrich(rows, defined, replies)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" not in plan and "Union" not in plan
    # document 0 has a value without a reply, which stops it
    assert {tuple(r) for r in found.collect()} == {(i, *x) for i in range(1, 999) for x in (("f__consolidation_status", "VALID"), ("n", "n7"))}
    assert [r.document_id for r in E.enrichment_failures(rows, defined, replies).filter("stops").collect()] == [0]


def test_containers_come_in_bounded_batches():
    import pyarrow as pa
    from sluice.plans import intake

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": ["x" * 50_000] * 600})
    made = list(intake._containers(iter([batch])))
    assert [r for b in made for r in b["root"].to_pylist()] == [str(i) for i in range(600)]
    assert max(b.nbytes for b in made) < intake.BATCH_BYTES + 1_000_000


def test_hits_come_in_portions():
    import json

    import pyarrow as pa
    from sluice.operators import definitions as D

    n = 3_500
    rule = json.dumps([{"field_name": "f", "regexp": "[a-z]+"}])
    columns = {"document_id": list(range(n)), "page": [1] * n, "line_no": [0] * n, "text": ["abc 1"] * n, "definitions": [rule] * n} | {c: [0.0] * n for c in ("x0", "y0", "x1", "y1")}
    made = list(D._hits(iter([pa.RecordBatch.from_pydict(columns)])))
    assert max(b.num_rows for b in made) <= 1_000
    assert [x for b in made for x in b["document_id"].to_pylist()] == list(range(n)) and {v for b in made for v in b["value"].to_pylist()} == {"abc"}


def _plain_same_line(rows, terms, direction, reach):
    """Every pair of a mark and a match of each page."""
    import re

    best = {}
    for page, line, text in rows:
        for i, term in enumerate(sorted(terms, key=len, reverse=True)):
            for mark in re.finditer(re.escape(term), text.lower()):
                for m in re.finditer("[A-Z][a-z]+", text):
                    if direction == "right" and m.start() < mark.end() or direction == "left" and m.start() >= mark.start():
                        continue
                    if not reach or abs(m.start() - mark.end()) <= 3 * reach:
                        place = (i, abs(m.start() - mark.end()), line, mark.start(), m.start(), m.group())
                        best[page] = min(best.get(page, place), place)
    return {page: x[-1] for page, x in best.items()}


def test_anchor_and_match_are_neighbours_in_their_order(spark):
    import numpy as np
    from sluice.operators import definitions as D
    from sluice.operators import extract as E

    r = np.random.default_rng(7)
    words = np.array(["the", "Theo", "Under the", "under", "x", "Abc", "é", "Then", " ", "of"])
    rows = [(int(p), n, " ".join(words[r.integers(0, len(words), int(r.choice([1, 2, 5, 30, 400])))])) for p in range(60) for n in range(3)]
    lines = spark.createDataFrame([(1, *x) for x in rows], "document_id int, page int, line_no int, text string")
    for direction in ("right", "left", "any"):
        for reach in (0, 2):
            expected = _plain_same_line(rows, ["the", "under the"], direction, reach)
            assert {x.page: x.value for x in E.same_line(lines, "[A-Z][a-z]+", "the, under the", direction, reach).collect()} == expected
            field = D.Field({"field_name": "f", "regexp": "[A-Z][a-z]+", "anchors": "the, under the", "direction": direction, "max_distance": str(reach)})
            found = {}
            for page, line, text in rows:
                if own := D.same_line(field, text, text.lower(), [(m.start(), m.group()) for m in field.pattern.finditer(text)], line):
                    found[page] = min(found.get(page, own), own)
            assert {page: value for page, (_, value) in found.items()} == expected


def test_a_line_of_many_anchors_and_matches(spark):
    import time

    from sluice.operators import definitions as D
    from sluice.operators import extract as E

    n = 25_000
    text = "the Abcd " * n + "the Last"
    lines = spark.createDataFrame([(1, 1, 0, text)], "document_id int, page int, line_no int, text string")
    field = D.Field({"field_name": "f", "regexp": "[A-Z][a-z]+", "anchors": "the", "direction": "right"})
    t = time.time()
    assert [x.value for x in E.same_line(lines, "[A-Z][a-z]+", "the", "right").collect()] == ["Abcd"]
    assert D.same_line(field, text, text, [(m.start(), m.group()) for m in field.pattern.finditer(text)], 0)[1] == "Abcd"
    assert time.time() - t < 30  # all pairs of a mark and a match, 625 million, take minutes


def test_words_are_grouped_where_their_lines_are(spark):
    from sluice.plans import pages

    plan = pages.t6_word_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    exchanges = [line for line in initial.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]  # lines are sent, words are not
    rows = spark.range(50).select(F.col("id").alias("document_id"), F.lit(1).alias("page"), F.lit("x" * 100).alias("text"))
    assert pages.dealt(rows, 250).rdd.getNumPartitions() == 20 and pages.dealt(rows).count() == 50
    assert pages.dealt(rows.limit(0)).count() == 0


def test_lines_are_read_once_for_anchors(spark, monkeypatch):
    from sluice.operators import extract as E

    n = F.col("id") % 3
    text = F.when((F.col("id") % 6 == 0), "Net Total").when(F.col("id") % 30 == 3, F.concat(F.lit("total: net total "), F.col("id").cast("string"))).when(n == 1, F.concat(F.lit("- v"), F.col("id").cast("string"))).otherwise("")
    lines = spark.range(300).select(F.floor(F.col("id") / 6).cast("int").alias("document_id"), (F.floor(F.col("id") / 3) % 2).cast("int").alias("page"), n.cast("int").alias("line_no"), text.alias("text"), F.lit(0.0).alias("x0"), (n * 20.0).alias("y0"), F.lit(9.0).alias("x1"), (n * 20.0 + 15).alias("y1"))
    # page 0 of every document has an anchor that stands alone, page 1 of every fifth one with a value on its line
    expected = {(d, 0, f"v{6 * d + 1}") for d in range(50)} | {(d, 1, f"{6 * d + 3}") for d in range(0, 50, 5)}
    for most in (E.FEW_PAGES, 0):  # sent, or met by their key
        monkeypatch.setattr(E, "FEW_PAGES", most)
        found = E.after_anchor(lines, "total, net total", "below")
        assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()  # lines are not read again by what comes after
        assert {tuple(r) for r in found.collect()} == expected
