"""Field definitions as a table, crowded pages, labels."""

import numpy as np
import pytest

from sluice.functions.labels import rest_of_line
from sluice.operators import definitions as D
from sluice.operators import nearby


@pytest.mark.parametrize(
    "text, value",
    [
        (" : 12.03.2024 ", "12.03.2024"), ("No 7 Name : x", "No 7"), ("a b c d e f : x", "a b"), ("Total : 5", "Total : 5"), ("12:30 Fin de : x", "12:30"), ("x : y z : w", "x :"), ("", ""), (" - ", ""), ("a1 b2: c", "a1 b2: c"),
        ("v St. Nr. : 3", "v"), ("one two:", "one"), ("é ü : x", "é"),
    ],
)
def test_rest_of_line(text, value):
    assert rest_of_line(text) == value


def _page(n, seed):
    r = np.random.default_rng(seed)
    x, y = r.integers(0, 20_000, n), r.integers(0, 20_000, n)
    return [(1, 1, i, float(a), float(b), float(a + 30), float(b + 8)) for i, (a, b) in enumerate(zip(x, y))]


def _plain(marks, items, direction, reach):
    best = None
    i = np.array([m[3:] for m in items])
    no = np.array([m[2] for m in items])
    for m in marks:
        ax0, ay0, ax1, ay1 = m[3:]
        dx, dy = (i[:, 0] + i[:, 2] - ax0 - ax1) / 2, (i[:, 1] + i[:, 3] - ay0 - ay1) / 2
        far = np.sqrt(dx * dx + dy * dy)
        wrong = {"right": i[:, 0] <= ax1, "below": i[:, 1] <= ay1, None: np.zeros(len(i), bool)}[direction]
        score = np.round(far + 1_000 * wrong + np.abs(dy) * 5, 6)
        score[(no == m[2]) | ((far > reach) if reach else False)] = np.inf
        k = int(np.lexsort((no, score))[0])
        if score[k] < np.inf:
            best = min(best, (score[k], m[2], no[k])) if best else (score[k], m[2], no[k])
    return None if best is None else int(best[2])


@pytest.mark.parametrize("direction, reach, n, step", [("right", 0, 1_500, 7), (None, 400, 1_500, 7), ("below", 0, 50_000, 25), ("right", 3, 1_500, 7)])
def test_crowded_page(spark, direction, reach, n, step):
    """Some marks and all lines of one page, a few lines of another: the same as comparing all pairs."""
    lines = _page(n, n + reach)
    marks = lines[::step]
    few = [(2, 1, i, 10.0 * i, 0.0, 10.0 * i + 5, 5.0) for i in range(4)]
    m = spark.createDataFrame([(*x, direction, reach) for x in [*marks, few[0]]], "document_id int, page int, a_no long, ax0 double, ay0 double, ax1 double, ay1 double, direction string, max_distance int")
    i = spark.createDataFrame([(*x, str(x[2])) for x in lines + few], "document_id int, page int, line_no long, x0 double, y0 double, x1 double, y1 double, value string")
    found = {r.document_id: r.value for r in nearby.nearest(m, i, ["document_id", "page"]).collect()}
    want = {1: _plain(marks, lines, direction, reach), 2: _plain(few[:1], few, direction, reach)}
    assert found == {k: str(v) for k, v in want.items() if v is not None}


def test_definitions(spark):
    fields = [
        ("A", "date", r"[0-9]{2}\.[0-9]{2}", "Due", "below", None, None, None, None, ""), ("A", "code", "/[a-z][0-9]/i", "", "", "", "", "QR Code", "zz|x", "none"), ("A", "owner", "", "Owner, Owner name", "right", "0", "", "", "", ""),
        ("B", "broken", "([", "", "", "", "", "", "", "d"), ("B", None, "x", "", "", "", "", "", "", ""),
    ]
    rows = [
        (1, 1, 0, "Due 01.01 and Due 02.02", 0, 0, 10, 1), (1, 1, 1, "owner name: Ann Lee  City : Rome", 0, 5, 10, 6), (1, 1, 2, "A7", 0, 9, 5, 10), (1, 2, 0, "Due", 0, 0, 10, 1), (1, 2, 1, "31.12", 0, 2, 10, 3), (1, 2, 2, "30.11", 0, -2, 10, -1), (1, 2, 3, "Owner :", 0, 20, 10, 21),
        (1, 2, 4, "Bob", 11, 20, 14, 21), (2, 1, 0, "b9 01.01 ([", 0, 0, 1, 1), (3, 1, 0, "no type 01.01", 0, 0, 1, 1), (1, 3, 0, None, 0, 0, 1, 1),
    ]
    lines = spark.createDataFrame([(*x[:4], *map(float, x[4:])) for x in rows], "document_id int, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    docs = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "A")], "document_id int, doctype string")
    defined = spark.createDataFrame(fields, ", ".join(f"{c} string" for c in D.DEFINITION))
    codes = spark.createDataFrame([(1, 2, 0, "zz1", "QR_CODE"), (1, 3, 0, "q5", "ean"), (1, 3, 1, "q6", "qrcode"), (1, 3, 2, "??", "qrcode")], "document_id int, page int, n int, value string, format string")
    values = D.page_values(lines, docs, defined, codes)
    found = {(r.document_id, r.page, r.field_name): r.value for r in values.collect()}
    assert found == {(1, 1, "date"): "01.01", (1, 2, "date"): "31.12", (1, 1, "code"): "A7", (1, 2, "code"): "none", (1, 3, "code"): "q6", (1, 1, "owner"): "Ann", (1, 2, "owner"): "Bob"}
    every = {(r.document_id, r.field_name): r.value for r in D.document_values(values, docs, defined.filter("field_name IS NOT NULL")).collect()}
    assert every[1, "code"] == "A7" and every[1, "owner"] == "Ann" and every[2, "broken"] == "d" and every[4, "code"] == "none" and every[4, "date"] == "" and (3, "date") not in every
