"""Every operator on the awkward table and on an empty one."""

import pytest
from llm_cases import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_awkward_rows(spark, edge, name):
    rows = CASES[name](spark, edge).collect()
    assert len(rows) == edge.count()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge.collect())


@pytest.mark.parametrize("name", sorted(CASES))
def test_empty_table(spark, empty, name):
    assert CASES[name](spark, empty).count() == 0


def test_stages_keep_columns(spark, edge, empty):
    from sluice.llm import linededup, mixing, ngramjoin, quality, unitdedup

    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (edge, empty):
        for out in (quality.keep_good(table, labels), linededup.dedup(table), ngramjoin.unique(table), mixing.sample(table)):
            assert out.columns == table.columns
            out.count()
        assert unitdedup.dedup(table).columns == [*table.columns, "removed_spans"]
        assert unitdedup.dedup(table).count() == table.count()


def test_awkward_values(spark, edge):
    """What the docstrings say of nulls, empty texts, ties and repeated rows."""
    of = lambda name: {(r.doc_id, i): r for i, r in enumerate(sorted(CASES[name](spark, edge).collect(), key=str))}
    by = lambda name, doc: [r for (d, _), r in of(name).items() if d == doc]
    assert all(r.n_words == 0 and r.base_failed and not r.kept for d in (1, 2, 3) for r in by("quality", d))
    assert [r.n_removed for r in by("linededup", 1)] == [0] and [r.n_lines for r in by("linededup", 1)] == [0]
    # of five copies and near copies all are one group; rows that repeat are the same set
    assert {r.class_id for d in (5, 6, 7) for r in by("ngramjoin", d)} == {5} and {r.n_links for r in by("ngramjoin", 5)} == {1}
    assert [(r.class_id, r.n_links) for r in by("ngramjoin", 2)] == [(2, 0)]
    one, two = by("katz", 5)
    assert one == two and [r.n_tokens for d in (1, 2, 3) for r in by("katz", d)] == [1, 1, 1] and by("katz", 4)[0].n_tokens == 2
    assert all(r.spans == "" for d in (1, 2, 3) for r in by("secrets", d))
    # equal rows: one keeps its text, as do the first of copies; the rest lose it
    gone = sorted(r.n_removed_chars for r in by("unitdedup", 5))
    assert gone[0] == 0 and gone[1] > 1_000 and by("unitdedup", 6)[0].n_removed_chars > 1_000
    assert [r.length for d in (1, 2) for r in by("packing", d)] == [1, 1]
    assert all(0 <= r.probability <= 1 for r in CASES["mixing"](spark, edge).collect())


def test_unique_whatever_the_ids(spark):
    """One row of a group stays, also where ids repeat or are null."""
    from llm_cases import prose
    from sluice.llm import ngramjoin

    near = lambda n: " ".join([*prose(50, 200).split()[:-1], f"end{n}"])
    for ids in ([1, 1, 1], [1, 1, 2], [None, None, None], [None, 3, 3]):
        rows = [(d, near(n), "x") for n, d in enumerate(ids)] + [(9, "", "x"), (9, "", "x"), (None, None, "x")]
        stays = ngramjoin.unique(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
        assert sum(bool(r.text) for r in stays) == 1 and sum(not r.text for r in stays) == 3, ids
        assert next(r.doc_id for r in stays if r.text) == next((d for d in sorted(d for d in ids if d is not None)), None)


def test_awkward_pages(spark):
    from sluice.llm import html

    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(5_000)) + "</article>"
    rows = [(None, "http://a.example/", "<p>No id"), (1, None, "<p>No url"), (2, "http://a.example/", None), (3, "http://a.example/", ""), (4, "http://b.example/", long), (4, "http://b.example/", long), (5, "", "<b>"), (5, "x", "a&amp;b")]
    frame = spark.createDataFrame([(*r, "h", 1, 2, [3]) for r in rows], "page_id long, url string, html string, host string, page long, Token long, constant array<long>")
    found = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(frame).collect()]
    want = [None if h is None else t for (_, _, h), t in zip(rows, ["No id", "No url", "", "", None, None, "", "a&b"])]
    want = [(p, u, t or "", len(t or "")) for (p, u, _), t in zip(rows, want)]
    blocks = "\n\n".join(f"Paragraph {i} of a long page." for i in range(5_000))
    want = [w if w[0] != 4 else (*w[:2], blocks, len(blocks)) for w in want]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert html.extract(frame.limit(0)).count() == 0


def test_awkward_vectors(spark):
    from sluice.llm import ann

    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 2), (20, [1.0, 0.0], 3), (7, [1.0, 0.0], 4), (3, [], 5), (None, None, 6), (40, None, 7)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int").withColumnsRenamed({"list": "unit"})).collect()
    # ties go to the smaller id, repeated rows are candidates each, no row is its own
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 7, 1.0), (0, 2, 20, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 7, 1.0)]
