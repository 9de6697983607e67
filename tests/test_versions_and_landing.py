"""Versioned writes, the model that grows by versions, and what landing zones and containers give."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import classify as L
from sluice.operators import export as X
from sluice.sources import landing, versions
from sluice.streaming import admission as stream

DIR = "/root/testdata/sf0.001"


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.latest(spark, root) is None and versions.load(spark, root, "id long").count() == 0
    assert versions.commit(spark.range(5), root, "v1") and not versions.commit(spark.range(9), root, "v1")
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 90, F.raise_error("killed").cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        versions.commit(broken, root, "v2")
    assert versions.latest(spark, root) == "v1" and versions.load(spark, root, "id long").count() == 5
    assert versions.commit(spark.range(7), root, "v2") and versions.latest(spark, root) == "v2"
    assert versions.load(spark, root, "id long").count() == 7 and versions.load(spark, root, "id long", "v1").count() == 5 and versions.load_all(spark, root, "id long").count() == 12
    assert [(r.sequence, r.version, r.n_rows) for r in versions.manifest(spark, root).orderBy("sequence").collect()] == [(1, "v1", 5), (2, "v2", 7)]


def test_export_runs(spark, tmp_path):
    root = str(tmp_path / "e")
    docs = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("b", "2", "y"), ("c", "3", None)], "document_id string, payload string, account_id string")
    assert X.write_new(docs.filter("document_id = 'a'"), root, "r1") and X.write_new(docs, root, "r2") and not X.write_new(docs, root, "r2") and X.write_new(docs, root, "r3")
    assert sorted((r.document_id, r.payload, r.account_id or "") for r in X.exported(spark, root).collect()) == [("a", "1", "x"), ("b", "2", "y"), ("c", "3", "")]
    assert [r.n_rows for r in versions.manifest(spark, root).orderBy("sequence").collect()] == [1, 2, 0]


def test_two_portions_give_what_one_gives(spark, tmp_path):
    """The model after two halves in key order is that of a plain fold over all; a run that died before its model was written has marked nothing."""
    log = spark.read.parquet(f"{DIR}/embeddings.parquet").select("label", F.format_string("%012d", "vec_id").alias("log_key"), F.col("embedding").alias("vector"))
    root, half = str(tmp_path / "m"), log.count() // 2
    first = log.orderBy("log_key").limit(half)
    assert L.model_version(first, root, "v1")
    versions.commit(log.select("label", "log_key", F.lit("v2").alias("version")), f"{root}/seen", "v2-died")
    assert L.model_version(log, root, "v2") and not L.model_version(log, root, "v2")
    found = {r.label: np.array(r.vector) for r in versions.load(spark, f"{root}/centroids", L.MODEL.format(t="int")).collect()}
    for label, rows in log.toPandas().sort_values("log_key").groupby("label"):
        c = None
        for v in rows.vector:
            v = np.asarray(v, np.float32)
            c = v / np.linalg.norm(v) if c is None else (c + v) / np.linalg.norm(c + v)
        assert np.abs(found[label] - c).max() < 1e-6
    assert versions.latest(spark, f"{root}/centroids") == "v2"
    assert L.model_version(log, root, "v3") and versions.load(spark, f"{root}/centroids", L.MODEL.format(t="int")).count() == len(found)


def test_polled_objects(spark, tmp_path):
    (tmp_path / "in" / "a" / "b").mkdir(parents=True)
    for n, name in enumerate(("a/x.pdf", "a/b/y.pdf", "a/skip.txt")):
        (tmp_path / "in" / name).write_bytes(b"1" * (n + 1))
        stream.write_once(landing.polled(spark, str(tmp_path / "in"), pattern="*.pdf", content=True), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    found = [(r.key.rsplit("/", 1)[1], r["size"], bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == [("x.pdf", 1, b"1"), ("y.pdf", 2, b"11")]


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_member_states(spark):
    nested = _zip([("d/one.PDF", b"x" * 40), ("two.pdf", b"y" * 40), ("n.exe", b"z")])
    rows = spark.createDataFrame([("r", "o.zip", _zip([("a.pdf", b"a" * 50), ("in.zip", bytes(nested))])), ("e", "empty.zip", _zip([])), ("f", "plain.pdf", bytearray(b"%PDF"))], "root string, name string, content binary")
    found = {r.path: (r.depth, r.state, None if r.content is None else len(r.content)) for r in landing.expand(rows, allowed="pdf", most_bytes=100 + len(nested)).collect()}
    assert found == {"o.zip/a.pdf": (1, "ok", 50), "o.zip/in.zip": (1, "ok", len(nested)), "o.zip/in.zip/d/one.PDF": (2, "ok", 40), "o.zip/in.zip/two.pdf": (2, "too_large", None), "o.zip/in.zip/n.exe": (2, "unsupported", None)}
    shallow = {r.path: r.state for r in landing.expand(rows, depth=1).collect()}
    assert shallow == {"o.zip/a.pdf": "ok", "o.zip/in.zip": "too_deep"}
    assert json.dumps(sorted(found)) and landing.expand(rows.limit(0)).count() == 0
