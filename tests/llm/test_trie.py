"""The prefix trie against SQL and against a trie of rebuilt texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from sluice.llm import oracles, trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every node by a dictionary of whole prefixes."""
    ref = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, ref(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = (*own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h], *turns[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [out[p + (t,)] for t in {q[len(p)] for q in members if len(q) == len(p) + 1 and q[: len(p)] == p}] if len(members) < 2_000 else None
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
    return sorted(out.values(), key=str)


def found(spark, rows, extra=False):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        from pyspark.sql import functions as F

        frame = frame.withColumns({n: F.lit("mine") for n in ("depth", "ref", "pos", "h", "BASE", "q0", "members")})
    return sorted((tuple(r[n] for n in NAMES) for r in trie.trie(frame).collect()), key=str)


def some(seed, n=120, most=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 800), n):
        for turn in range(r.randint(1, most)):
            rows.append((c, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(["", "a", "bb", None, "é\U0001f600"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rows = some(seed) + [(None, 1, "user", "no conversation")] + some(seed)[:9]
    assert found(spark, rows, extra=True) == plain(rows)


def test_long_and_shared(spark):
    """A conversation that lies in several tasks, a copy of it, and many that end in one node."""
    long = [(c, t, "user", f"text {t % 50}") for c in (1_000_000, 1_000_001) for t in range(700)]
    rows = long + [(c, 0, "user", "hello") for c in range(400)]
    ours = found(spark, rows)
    assert [r for r in ours if r[0] >= 1_000_000 and r[1] > 0 and r[3] > 1] != []
    one = duckdb.connect()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas()  # noqa: F841
    one.sql("create table conversations as select * from frame")
    assert ours == sorted(one.execute(f"SELECT {', '.join(NAMES)} FROM ({oracles.ORACLES['op12_prefix_trie']})").fetchall(), key=str)


def test_empty_and_turnless(spark):
    assert found(spark, [(None, 0, "user", "x")]) == []
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(frame).count() == 0
    # conversations without a base whose own turns are all cut away stay as members of the root
    cut = [c for c in range(100, 1_000) if c % 100 and zlib.crc32(str(c).encode()) % 6 == 5][:4]
    rows = [(c, 0, "user", "gone") for c in cut]
    assert found(spark, rows) == plain(rows) == [(cut[0], 0, None, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, cut)).encode()).hexdigest())]


def test_borders(spark, monkeypatch):
    """Runs of one conversation in many tasks are combined."""
    rows = some(7) + [(300, t, "user", f"t{t}") for t in range(50, 400)]
    real = trie._turns
    seen = []

    def many(conversations, attempt):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        try:
            out = real(conversations, attempt)
            seen.extend(trie._borders(out, attempt))
            return out
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    monkeypatch.setattr(trie, "_turns", many)
    assert found(spark, rows) == plain(rows)
    assert sum(b[0] == 300 for b in seen) > 2


def test_collisions_are_seen(spark, monkeypatch):
    """Fingerprints that are all equal fail the check of references; other numbers settle it."""
    real, tried = trie.bases, []

    def weak(attempt):
        tried.append(attempt)
        return [0] * trie.LANES if attempt == 0 else real(attempt)

    monkeypatch.setattr(trie, "bases", weak)
    rows = some(1, n=30)
    assert found(spark, rows) == plain(rows) and max(tried) == 1
    monkeypatch.setattr(trie, "bases", lambda attempt: [0] * trie.LANES)
    with pytest.raises(RuntimeError, match="attempts"):
        found(spark, rows)
