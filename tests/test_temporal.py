"""The splittable temporal rule against a plain fold."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from sluice.operators import temporal

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, seconds):
    last, out = {}, []
    for i, c, k, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if (c, k) not in last or (t - last[c, k]).total_seconds() >= seconds:
            last[c, k] = t
            out.append((c, k, i))
    return sorted(out, key=str)


@pytest.fixture
def split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def times(how, n, r):
    if how == "dense":  # all within few windows
        return [r.randrange(6_000) for _ in range(n)]
    if how == "sparse":
        return [r.randrange(3_000_000) for _ in range(n)]
    if how == "ties":
        return [r.choice((0, 1_800, 3_600, 3_601, 9_000)) for _ in range(n)]
    return [r.randrange(20) * 86_400 + r.randrange(3_000) for _ in range(n)]  # bursts


@pytest.mark.parametrize("how", ["dense", "sparse", "ties", "bursts"])
def test_one_key_holds_half(spark, split, how, monkeypatch):
    r = random.Random(how)
    hot = [("c", "hot", s) for s in times(how, 1_500, r)]
    rest = [(r.choice(["a", "b", "c", None]), f"k{r.randrange(200)}", s) for s in times("sparse", 1_500, r)]
    rows = [(i, c, k, START + timedelta(seconds=s)) for i, (c, k, s) in enumerate(r.sample(hot + rest, 3_000))]
    stored, real = {}, temporal.kept
    monkeypatch.setattr(temporal, "kept", lambda df, name: stored.setdefault(name, real(df, name)) if name == "segments" else real(df, name))
    frame = spark.createDataFrame(rows, "event_id long, config_id string, source_key string, seen_at timestamp")
    assert sorted((tuple(x) for x in temporal.accepted(frame).collect()), key=str) == plain(rows, 3_600)
    sizes = [x["count"] for x in stored["segments"].groupBy("segment").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * np.median(sizes)


def test_windows_by_key_and_rows_without_time(spark, split):
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [(i, r.choice("ab"), "k", START + timedelta(seconds=r.randrange(200_000))) for i in range(2_000)]
    frame = spark.createDataFrame([*rows, (9_999, "a", "k", None)], "event_id long, config_id string, source_key string, seen_at timestamp")
    found = temporal.accepted(frame, F.when(F.col("config_id") == "a", 600).otherwise(7_200)).collect()
    want = plain([x for x in rows if x[1] == "a"], 600) + plain([x for x in rows if x[1] == "b"], 7_200)
    assert sorted((tuple(x) for x in found), key=str) == sorted(want, key=str)
    assert temporal.accepted(frame.limit(0)).count() == 0


def test_chains_and_clocks():
    run = lambda s, p, k, a, b, c: temporal.Run(s, p, k, a, b, c, 10)
    runs = [run(0, temporal.LAST, "x", 0, 5, 0), run(1, temporal.WHOLE, "x", 5, 9, 5), run(2, temporal.FIRST, "x", 12, 30, 22), run(2, temporal.LAST, "y", 0, 1, 0), run(4, temporal.WHOLE, "z", 0, 1, 0)]
    (chain,) = temporal.chains(runs[::-1])
    assert [r.segment for r in chain] == [0, 1, 2]
    assert temporal.walked(chain) == [None, 0, 0]
    assert temporal.walked([*chain, run(3, temporal.FIRST, "x", 31, 32, 31)]) == [None, 0, 0, 22]
    assert temporal.walked([chain[0], run(1, temporal.WHOLE, "x", 5, 19, 15), chain[2]]) == [None, 0, None]
