"""What reads files: landing zones, containers, streams; and properties of ordered rules."""

import io
import json
import zipfile
from datetime import datetime, timedelta
from email.message import EmailMessage

import numpy as np
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_landing_zone_scan(spark, tmp_path):
    from sluice.sources import landing

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "a" / "y.txt").write_bytes(b"hello")
    found = {r.key.rsplit("/", 1)[1]: r["size"] for r in landing.scan(spark, str(tmp_path)).collect()}
    assert found == {"x.pdf": 8, "y.txt": 5}


def test_nested_containers(spark):
    from sluice.sources import landing

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    mail = EmailMessage()
    mail["From"], mail["Subject"] = "a@b.c", "s"
    mail.set_content("body")
    mail.add_attachment(inner.getvalue(), maintype="application", subtype="zip", filename="in.zip")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("m.eml", mail.as_bytes())
        z.writestr("plain.txt", "text")
    rows = spark.createDataFrame([("r1", "o.zip", bytearray(outer.getvalue())), ("r2", "bad.zip", bytearray(b"PKnope"))], "root string, name string, content binary")
    found = {(r.root, r.depth, r.path, r.state) for r in landing.expand(rows).collect()}
    assert ("r1", 3, "o.zip/m.eml/in.zip/deep.txt", "ok") in found
    assert ("r1", 1, "o.zip/plain.txt", "ok") in found
    assert any(r == "r2" and s.startswith("error:") for r, _, _, s in found)


def test_member_limits(spark):
    from sluice.operators import admission as A

    rows = spark.createDataFrame([("c", i, 1 if i else 6, 40) for i in range(4)], "container string, position int, depth int, size long")
    assert [r.state for r in A.limited_members(rows, most_bytes=100).orderBy("position").collect()] == ["too_deep", "ok", "too_large", "too_large"]
    assert {r.state for r in A.limited_members(rows, most_members=3).collect()} == {"too_many_members"}


def _deposits(spark):
    return spark.read.parquet(f"{DIR}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("config_id"), F.col("event_type").alias("source_key"), F.col("ts").cast("timestamp").alias("seen_at"))


def test_stream_admits_what_the_batch_admits(spark, tmp_path):
    from sluice.operators import admission as A
    from sluice.streaming import admission as S

    rows = _deposits(spark)
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    job = S.write_once(S.accepted(S.deposits(spark, str(tmp_path / "in")), 86_400), str(tmp_path / "out"), str(tmp_path / "check"))
    job.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(A.accepted(rows, 86_400).collect())


def test_stream_goes_on_where_it_was(spark, tmp_path):
    from sluice.streaming import admission as S

    folder = tmp_path / "log"
    folder.mkdir()
    for n, key in enumerate(("z", "a")):  # the second key sorts before the first
        (folder / f"{n}.json").write_text(json.dumps({"doctype": "t", "log_key": key}))
        S.write_once(S.new_log_rows(spark, str(folder), "doctype string, log_key string"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n + 1


def test_accepted_deposits_lie_a_window_apart(spark):
    from sluice.operators import admission as A

    rows = _deposits(spark)
    kept = A.accepted(rows, 86_400).join(rows, ["config_id", "source_key", "event_id"]).orderBy("seen_at").collect()
    last = {}
    for r in kept:
        k = (r.config_id, r.source_key)
        assert k not in last or r.seen_at - last[k] >= timedelta(days=1)
        last[k] = r.seen_at
    at = [datetime(2024, 1, 1) + timedelta(minutes=m) for m in (0, 30, 59, 60, 90, 120)]
    one = spark.createDataFrame([(i, "c", "k", t) for i, t in enumerate(at)], "event_id long, config_id string, source_key string, seen_at timestamp")
    assert sorted(r.event_id for r in A.accepted(one).collect()) == [0, 3, 5]


def test_pages_split_by_changing_barcode(spark):
    from sluice.operators import split as P

    rows = [("d", i + 1, "AABBCCDDEE"[i]) for i in range(10)]
    pages = spark.createDataFrame(rows, "document_id string, page int, separator string")
    assert [r.group_no for r in P.by_separator(pages).orderBy("page").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    made = P.children(P.by_separator(pages)).filter("child_id = 'd_split_00002'").orderBy("page").collect()
    assert [(r.page, r.parent_page) for r in made] == [(1, 3), (2, 4)]


def test_centroids_are_unit_vectors_in_order(spark):
    from sluice.operators import classify as L

    log = spark.read.parquet(f"{DIR}/embeddings.parquet").select("label", F.format_string("%012d", "vec_id").alias("log_key"), F.col("embedding").alias("vector"))
    mine = {r.label: np.array(r.vector) for r in L.centroids(log).collect()}
    for label, rows in log.toPandas().sort_values("log_key").groupby("label"):
        c = None
        for v in rows.vector:
            v = np.asarray(v, np.float32)
            c = v / np.linalg.norm(v) if c is None else (c + v) / np.linalg.norm(c + v)
        assert abs(np.linalg.norm(mine[label]) - 1) < 1e-5
        assert np.allclose(mine[label], c, atol=1e-5)


def test_unicode_normal_form(spark):
    from sluice.functions.unicode import normal_form

    assert spark.range(1).select(normal_form(F.lit("ﬁé")).alias("t")).first().t == "fié"


def test_machine_readable_zone(spark):
    from sluice.operators import extract as E

    good = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    rows = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(["noise", *good])], "document_id string, page int, line_no int, text string")
    r = E.mrz(rows).first()
    assert (r.number, r.born, r.expires, r.country, r.surname, r.given) == ("L898902C3", "740812", "120415", "UTO", "ERIKSSON", "ANNA MARIA")


def test_mixed_extraction_and_summary(spark):
    from sluice.operators import extract as E

    fields = spark.createDataFrame([("date", True), ("client", False)], "field_name string, required boolean")
    docs = spark.createDataFrame([("d",), ("e",)], "document_id string")
    values = spark.createDataFrame([("d", "date", "2024-01-02", "1.0"), ("d", "client", "ACME", "0.95"), ("e", "client", "X", "n/a")], "document_id string, field_name string, value string, score string")
    found = {r.document_id: r for r in E.summary(values, fields, docs).collect()}
    assert found["d"].extraction_ok and found["d"].min_score == 0.95
    assert not found["e"].extraction_ok and found["e"].missing_required == "date"


def test_stream_over_many_files_and_a_pause(spark, tmp_path):
    """Deposits of six days in files of their own, a few a trigger and a run for each half, give what the batch gives."""
    from sluice.operators import admission as A
    from sluice.streaming import admission as S

    rows = _deposits(spark)
    days = rows.withColumn("day", F.to_date("seen_at"))
    first = sorted(r.day for r in days.select("day").distinct().collect())[:6]
    some = days.filter(F.col("day").isin(first)).drop("day")
    want = sorted(A.accepted(some, 7_200).collect())
    for half in (first[:3], first[3:]):
        for day in half:
            rows.filter(F.to_date("seen_at") == F.lit(day)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            job = S.write_once(S.accepted(S.deposits(spark, str(tmp_path / "in"), files_per_batch=2), 7_200), str(tmp_path / "out"), str(tmp_path / "check"))
            job.awaitTermination(120)
    assert want and sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_stream_orders_rows_of_several_frames(spark, tmp_path):
    """A key's rows in several frames, out of order between them, are judged in order."""
    from datetime import datetime as D

    from sluice.streaming import admission as S

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        (tmp_path / "in").mkdir()
        times = [D(2024, 1, 1, h) for h in (9, 7, 5, 3, 1)]
        (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"event_id": i, "config_id": "c", "source_key": "k", "seen_at": t.isoformat() + "Z", "size": "1"}) for i, t in enumerate(times)))
        S.write_once(S.accepted(S.deposits(spark, str(tmp_path / "in")), 3 * 3_600), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        # 1, 5 and 9 o'clock
        assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stream_starts_from_a_registry(spark, tmp_path):
    """What a registry has seen counts; a deposit without a time and a key that the registry alone has give nothing."""
    from sluice.streaming import admission as S

    (tmp_path / "in").mkdir()
    at = lambda h: f"2024-01-01T{h:02d}:00:00Z"
    rows = [(1, "c", "k", at(5)), (2, "c", "k", at(8)), (3, "c", "new", at(5)), (4, "c", "k", None), (5, None, "k", at(1))]
    for n, (i, c, k, t) in enumerate(rows):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"event_id": i, "config_id": c, "source_key": k, "seen_at": t, "size": "1"}))
    registry = spark.sql("SELECT 'c' AS config_id, 'k' AS source_key, timestamp'2024-01-01 04:00:00' AS last_seen_at UNION ALL SELECT 'd', 'k', NULL")
    for _ in range(2):  # the second run finds nothing new
        S.write_once(S.accepted(S.deposits(spark, str(tmp_path / "in")), 3 * 3_600, registry), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3, 5]
    assert all(spark.conf.get(k, None) != v for k, v in S.SETTINGS.items())
