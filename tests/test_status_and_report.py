"""Cases of status, journal and cost operators whose results are known."""

from datetime import datetime

from pyspark.sql import functions as F

from sluice.operators import classify as L
from sluice.operators import report as R
from sluice.operators import status as S


def at(minute, second=0):
    return datetime(2024, 1, 1, 10, minute, second)


def test_each_run_of_a_step_is_a_row(spark):
    marks = [
        ("t", "OCR", 1, "start", at(0), None, None), ("t", "OCR", 2, "end", at(1), False, "x" * 3_000), ("t", "OCR", 3, "start", at(2), None, None), ("t", "OCR", 4, "end", at(2, 30), True, "fine"),
        ("t", "OCR", 5, "start", at(5), None, None), ("t", "OCR", 6, "end", at(5, 5), True, None), ("t", "OCR", 7, "end", at(6), False, "nothing runs"),
        ("t", "SPLIT", 8, "start", at(7), None, None), ("t", "SPLIT", 9, "start", at(8), None, None), ("u", "OCR", 10, "end", at(9), True, None),
    ]
    rows = spark.createDataFrame(marks, "transaction_id string, process string, mark_id long, kind string, at timestamp, ok boolean, detail string")
    journal = S.step_journal(rows)
    found = {(r.transaction_id, r.process, r.run_no): (r.status, r.duration_ms, len(r.detail or "")) for r in journal.collect()}
    assert found == {("t", "OCR", 1): ("ERROR", 60_000, 2_000), ("t", "OCR", 2): ("OK", 30_000, 0), ("t", "OCR", 3): ("OK", 5_000, 0), ("t", "SPLIT", 2): ("RUNNING", None, 0)}
    things = spark.createDataFrame([("t", "NEWDOC", at(0)), ("u", "NEWDOC", at(0))], "transaction_id string, process string, process_time timestamp")
    assert {r.transaction_id: (r.process, r.process_time) for r in S.advanced(things, journal).collect()} == {"t": ("OCR", at(5, 5)), "u": ("NEWDOC", at(0))}


def test_cost_by_document(spark):
    """Two documents in the period: 0.05 each; an amount of no document counts, an old one does not."""
    rows = [("d1", "OCR", "", 4, at(1)), ("d1", "CLASSIFY", "llm_v1", 2, at(1)), ("d2", "OCR", "", 3, at(2)), (None, "", "", 1, at(2)), ("d3", "OCR", "", 500, datetime(2020, 1, 1))]
    costs = spark.createDataFrame(rows, "document_id string, process string, source string, amount_u long, created_at timestamp")
    since = F.lit("2024-01-01").cast("timestamp")
    first = R.cost_projection(costs, since).filter("volume = 1000").first()
    assert (first.units, first.total, first.unit_cost, first.unit_floor, first.model_share, first.projected, first.projected_floor) == (2, 0.1, 0.05, 0.04, 20.0, 50.0, 40.0)
    assert {r.process: r.unit_cost for r in R.process_averages(costs, since).collect()} == {"OCR": 0.035, "CLASSIFY": 0.01, "?": 0.005}
    none = costs.filter("document_id = 'nobody'")
    assert [(r.units, r.unit_cost, r.projected) for r in R.cost_projection(none, since).filter("volume = 1000").collect()] == [(0, 0.0, 0.0)] and R.process_averages(none, since).count() == 0


def test_board_of_a_transaction(spark):
    tx = spark.createDataFrame([("a", "c1", "WORKING", at(0)), ("b", "c2", "WORKING", at(0))], "transaction_id string, config_id string, status string, created_at timestamp")
    docs = spark.createDataFrame([("a", "1", "VALIDATED", " Invoice", at(1)), ("a", "2", "DEPRECATED", "letter", at(2)), ("b", "3", "DISCARDED", "x", at(1))], "transaction_id string, document_id string, status string, doctype string, updated_at timestamp")
    expected = spark.createDataFrame([("c1", "i", "invoice", True), ("c1", "l", "letter", True), ("c1", "o", "other", False)], "config_id string, doctype_id string, doctype_name string, required boolean")
    costs = spark.createDataFrame([("a", 7), ("a", 5)], "transaction_id string, amount_u long")
    found = {r.transaction_id: r for r in R.board(tx, docs, costs, expected, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()}
    a, b = found["a"], found["b"]
    assert (a.reconciled, a.n_active, a.validated, a.cost_u, a.n_required, a.missing, a.complete, a.stuck) == ("VALIDATED", 1, 1, 12, 2, "letter", False, False)
    assert (b.reconciled, b.n_active, b.cost_u, b.missing, b.complete, b.stuck) == ("WORKING", 0, 0, "", True, True)


def test_types_by_name_and_by_hand(spark):
    types = spark.createDataFrame([("p", "invoice", None, True), ("q", "invoice", "acc", False), ("r", "invoice", "other", False), ("s", "letter", "other", False)], "doctype_id string, doctype_name string, account_id string, is_public boolean")
    configs = spark.createDataFrame([("c1", "acc", ["s", "r"], []), ("c2", "acc", [], ["q"]), ("c3", "acc", [], []), ("c4", None, [], [])], "config_id string, account_id string, expected array<string>, old array<string>")
    docs = spark.createDataFrame([("d1", "c1", "invoice"), ("d2", "c2", "invoice"), ("d3", "c3", "invoice"), ("d4", "c3", "letter"), ("d5", "c4", "letter"), ("d6", "c4", "unknown"), ("d7", "c1", None)], "document_id string, config_id string, doctype string")
    assert {r.document_id: (r.doctype_id, r["rank"]) for r in L.resolved(docs, configs, types).collect()} == {"d1": ("r", 1), "d2": ("q", 1), "d3": ("p", 2), "d5": ("s", 2)}
    found = {r.config_id: [t.doctype_id for t in r.choices] for r in L.choices(configs.drop("old"), types).collect()}
    assert found == {"c1": ["r", "s"], "c2": ["p", "q"], "c3": ["p", "q"], "c4": ["p", "q", "r", "s"]}
    state = spark.createDataFrame([("d1", "x", "EXPORTED", "UNRECOGNIZED"), ("d2", "x", "EXPORTED", "FAILED")], "document_id string, doctype string, process string, status string")
    picks = spark.createDataFrame([("d1", 1, "letter", False), ("d1", 2, None, True), ("zz", 3, "a", False)], "document_id string, pick_id long, doctype_name string, guess boolean")
    assert {r.document_id: tuple(r)[1:] for r in L.reclassified(state, picks).collect()} == {"d1": ("x", "OCR_READER", "OCR_DONE"), "d2": ("x", "EXPORTED", "FAILED")}
