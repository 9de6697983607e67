"""Recall of the index with many lists, of which few are probed, and of one hot list, against brute force."""

import numpy as np
import pytest

from sluice.llm import ann


def recall(spark, x, **options):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in ann.nearest(frame, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), ann.EVERY):
        score = x @ x[q]
        score[q] = -np.inf
        true = set(np.argsort(-score, kind="stable")[: ann.K].tolist())
        mine = found[q]
        assert len(mine) == ann.K and all(abs(s - x[i] @ x[q]) < 1e-12 for i, s in mine) and [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        hits += len(true & {i for i, _ in mine})
    return hits / (ann.K * -(-len(x) // ann.EVERY))


@pytest.mark.parametrize("kind", ["clusters", "noise", "hot"])
def test_recall(spark, kind):
    r = np.random.default_rng(4)
    n, d = 8_000, 24
    if kind == "noise":
        x = r.standard_normal((n, d))
    else:
        centres = r.standard_normal((60, d)) * 3
        at = r.integers(0, 60, n) if kind == "clusters" else np.where(np.arange(n) % 3 == 0, 0, r.integers(0, 60, n))
        x = centres[at] + r.standard_normal((n, d)) * 0.3
    index = ann.fit(ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")))
    assert len(index.centroids) >= 15 and (kind == "noise" or index.probes < len(index.centroids))
    assert recall(spark, x) >= 0.9


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e6])
def test_scan_of_many_queries(scale):
    """What a block gives many queries at once is what each would find by brute force among the rows it may meet, ties by id."""
    r = np.random.default_rng(0)
    for m in (1, 25, 70, 1_500):
        x = r.standard_normal((m, 24)) * scale
        x[m // 2 : m // 2 + 3] = x[0]
        index = ann.Index(np.linalg.qr(r.standard_normal((25, 25)))[0], np.zeros((1, 25)), float((x**2).sum(1).max()), 1)
        q, ids = x[:7], r.permutation(m)
        may = r.random((len(q), m)) < 0.6
        may[0] = False
        at, row, scores = ann.scan(q, x, index.placed(q, True), index.placed(x, False), ids, may, ann.K)
        for j in range(len(q)):
            mine = np.flatnonzero(may[j])
            true = np.einsum("ij,j->i", x[mine], q[j])
            assert len(scores[at == j]) == min(ann.K, len(mine)) and np.allclose(scores[at == j], -np.sort(-true)[: ann.K], rtol=1e-12)
            assert len(set(row[at == j])) == (at == j).sum() and set(row[at == j]) <= set(mine)
            assert ids[row[at == j]].tolist() == ids[row[at == j]][np.lexsort((ids[row[at == j]], -scores[at == j]))].tolist()


def test_a_query_comes_to_a_unit_once():
    """However many of a unit's lists a query probes, its vector is sent there once; a large list is met in all its blocks."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    index = ann.Index(np.eye(5), r.standard_normal((40, 5)), 1.0, 30)
    units = ann.grouped_lists({n: 9_000 if n == 7 else 300 for n in range(40)}, 40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(r.standard_normal((9, 4)).tolist())], names=["vec_id", "vector"])
    sent = [x for b in ann._dealt(index, 4, 30, units)([batch]) for x in b.to_pylist()]
    assert len({(x["vec_id"], x["unit"]) for x in sent}) == len(sent) < 9 * 30
    at = {n: set(range(first, first + blocks)) for n, first, blocks in units}
    for q, v in zip(batch["vec_id"].to_pylist(), index.order(index.placed(np.array(batch["vector"].to_pylist()), True), 30)):
        assert {(n, x["unit"]) for x in sent if x["vec_id"] == q for n in x["lists"]} == {(n, u) for n in v.tolist() for u in at[n]}
