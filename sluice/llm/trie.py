"""Prefix trie of rebuilt conversations, from monoid fingerprints; the rebuilt texts are never made.

A turn's reference is the SHA-256 of its role and text. A sequence of turns has the fingerprint (sum of a_j * B**j, B**n) modulo a prime, in
four lanes; two sequences one after another have (Q1 + B**n1 * Q2, B**(n1 + n2)). That is a monoid in which heads can also be taken off
again, so the prefix of a rebuilt conversation follows from two numbers that are there anyway: the fingerprint of its base's
head and the difference of two prefixes of its own turns. Prefixes inside heads are counted once a base, not once a conversation.

The scan over turns is a scan in two steps: turns are dealt by ranges of (conversation, place), so that one long conversation lies in many
tasks; each task works out the prefixes of its runs; runs that a border cuts (two a task at most) are combined at the driver.

Prefixes of equal depth and fingerprint are one node. That is verified: the members of every group must have the same reference
of their last turn and the same parent group, from which equality of the whole prefixes follows. If a group fails, all is done again with other
numbers. A node is named by its smallest member and depth. Sums over subtrees are found by doubling: in round k every node adds up
what the nodes 2**k below it have, so a trie of depth d takes log2(d) rounds; nodes with one member have a chain below
them and need none. The members that end in a node are joined to short lists in order, in many tasks, and only
these lists run through the digest, which is a running one.

Edge cases: a null conv_id is no conversation; null roles and texts are empty; turns with equal numbers stand in the order of their references;
equal rows are turns each; the remainder of a negative conv_id is that of SQL (towards zero); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import stored

PRIME, LANES, HEAD = (1 << 31) - 1, 4, 5
#: The bases for the first attempt; for further ones they are squared (modulo PRIME).
BASES = (1_103_515_245, 747_796_405, 1_664_525_007, 1_812_433_253)
ATTEMPTS, LISTED = 3, 512
Q, T, FP, UP = ([f"{x}{k}" for k in range(LANES)] for x in ("q", "t", "f", "p"))


def bases(attempt: int) -> list[int]:
    return [pow(b, 1 << attempt, PRIME) for b in BASES]


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo PRIME."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out[:n]


def _scan(attempt: int):
    """From sorted rows (conv_id, ref, chars, two hashes of ref): place in the run, fingerprint of the run so far (q), and what the turn adds to it (t)."""
    lanes = bases(attempt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, place, sums, powers = TaskContext.get().partitionId(), None, 0, np.zeros(LANES, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["conv_id"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            before = np.where(np.arange(len(first)) == 0, place if ids[0] == conv else 0, 0)
            sizes = np.diff(np.append(first, len(ids)))
            at = np.arange(len(ids)) - np.repeat(first - before, sizes) + 1
            if powers is None or at.max() >= powers.shape[1]:
                powers = np.stack([_powers(b, 2 * int(at.max()) + 2) for b in lanes])
            columns = {}
            for k in range(LANES):
                h = batch["h0" if k < 2 else "h1"].to_numpy().astype(np.uint64)
                a = ((h >> np.uint64(31 * (k % 2))) % np.uint64(PRIME)).astype(np.int64)
                term = a * powers[k, at] % PRIME
                total = np.concatenate([[0], np.cumsum(term)])
                start = np.where(np.arange(len(first)) == 0, sums[k] if ids[0] == conv else 0, 0)
                columns[T[k]] = term
                columns[Q[k]] = (total[1:] - np.repeat(total[first] - start, sizes)) % PRIME
                sums[k] = columns[Q[k]][-1]
            conv, place = ids[-1], int(at[-1])
            names = ["conv_id", "task", "place", "ref", "chars", *Q, *T]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(np.full(len(ids), task, np.int64)), pa.array(at), batch["ref"], batch["chars"], *(pa.array(columns[n]) for n in Q + T)], names=names)

    return run


def _turns(conversations: DataFrame, attempt: int) -> DataFrame:
    """The stored turns with the fingerprints of their runs."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    ref = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    # the last key only spreads equal rows, which are interchangeable
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", ref.alias("ref"), F.length(text).cast("long").alias("chars"), F.rand(7).alias("spread"))
    order = ["conv_id", F.asc_nulls_first("turn"), "ref", "spread"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = [F.xxhash64("ref", F.lit(2 * attempt + k)).alias(f"h{k}") for k in (0, 1)]
    schema = "conv_id long, task long, place long, ref binary, chars long, " + ", ".join(f"{n} long" for n in Q + T)
    return stored(rows.select("conv_id", "ref", "chars", *hashes).mapInArrow(_scan(attempt), schema), "turns")


def _borders(turns: DataFrame, attempt: int) -> list[tuple]:
    """(conv_id, task, turns before it, powers, fingerprint before it) of runs that go on from an earlier task: one a task at most."""
    runs = turns.groupBy("conv_id", "task").agg(F.max("place").alias("n"), F.max_by(F.array(*Q), "place").alias("q"))
    cut = runs.groupBy("conv_id").agg(F.count("*").alias("tasks"), F.array_sort(F.collect_list(F.struct("task", "n", "q"))).alias("runs")).filter("tasks > 1")
    out = []
    for row in cut.collect():
        n, q = 0, [0] * LANES
        for run in row.runs:
            powers = [pow(b, n, PRIME) for b in bases(attempt)]
            if n:
                out.append((row.conv_id, run.task, n, *powers, *q))
            q = [(x + p * y) % PRIME for x, p, y in zip(q, powers, run.q)]
            n += run.n
    return out


def _placed(turns: DataFrame, attempt: int) -> DataFrame:
    """Turns with places and fingerprints in the whole conversation."""
    borders = _borders(turns, attempt)
    if not borders:
        return turns.withColumnRenamed("place", "pos").drop("task")
    names = [f"{x}{k}" for x in ("power", "before") for k in range(LANES)]
    cut = turns.sparkSession.createDataFrame(borders, "conv_id long, task long, n long, " + ", ".join(f"{n} long" for n in names))
    out = turns.join(F.broadcast(cut), ["conv_id", "task"], "left").withColumn("pos", F.col("place") + F.coalesce("n", F.lit(0)))
    moved = {n: F.coalesce(F.col(f"power{k}"), F.lit(1)) * F.col(n) % PRIME for x in (Q, T) for k, n in enumerate(x)}
    return out.withColumns({n: (c + F.coalesce(F.col(f"before{n[1:]}"), F.lit(0))) % PRIME if n in Q else c for n, c in moved.items()}).drop("place", "task", "n", *names)


def _plan(placed: DataFrame, attempt: int) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns; and how each is rebuilt: own turns n, cut h, turns m of the base's head, that head's fingerprint (head0...), own fingerprint up to the cut (cut0...), and the whole's (f0...)."""
    head = F.when(F.col("pos") <= HEAD, F.struct("pos", F.array(*Q).alias("q"), F.array(*T).alias("t"), "ref", "chars"))
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(head)).alias("heads"), F.max_by(F.array(*Q), "pos").alias("q"))
    convs = stored(convs, "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1))
    out = own.join(base.hint("merge"), "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    at = lambda heads, i, k: F.when(F.col(i) > 0, F.element_at(heads, F.col(i).cast("int"))["q"][k]).otherwise(0)
    out = out.withColumn("own_cut", F.least("h", "n"))
    out = out.withColumns({f"head{k}": at("base_heads", "m", k) for k in range(LANES)} | {f"cut{k}": at("heads", "own_cut", k) for k in range(LANES)})
    out = out.withColumns({FP[k]: F.when(F.col("n") > F.col("h"), _joined(k, F.col("q")[k], attempt)).otherwise(F.col(f"head{k}")) for k in range(LANES)})
    out = out.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    return convs, stored(out.select("conv_id", "base", "n", "h", "m", "length", *FP, *(f"{x}{k}" for x in ("head", "cut") for k in range(LANES))), "plan")


def _back(k: int, attempt: int) -> Column:
    """B**(m - h): own turns move from behind their first h to behind the head's m."""
    inverse = pow(bases(attempt)[k], PRIME - 2, PRIME)
    return F.element_at(F.array(*(F.lit(pow(inverse, s, PRIME)) for s in range(HEAD + 1))), (F.col("h") - F.col("m") + 1).cast("int"))


def _joined(k: int, q: Column, attempt: int) -> Column:
    """The fingerprint of the head and of the own turns from the cut to where their prefix is q."""
    return (F.col(f"head{k}") + _back(k, attempt) * ((q - F.col(f"cut{k}") + PRIME) % PRIME)) % PRIME


def _prefixes(placed: DataFrame, convs: DataFrame, plan: DataFrame, attempt: int) -> DataFrame:
    """Rows (depth, fingerprint, the parent's, reference and length of the last turn, members, smallest member), several for a node."""
    own = placed.join(plan.drop(*FP, "base", "length", "n").hint("merge"), "conv_id").filter("pos > h")
    own = own.withColumns({FP[k]: _joined(k, F.col(Q[k]), attempt) for k in range(LANES)})
    own = own.withColumns({UP[k]: (F.col(FP[k]) - _back(k, attempt) * F.col(T[k]) % PRIME + PRIME) % PRIME for k in range(LANES)})
    own = own.select((F.col("pos") - F.col("h") + F.col("m")).alias("depth"), *FP, *UP, "ref", "chars", F.lit(1).cast("long").alias("members"), "conv_id")
    deep = range(1, HEAD + 1)
    taken = plan.filter("m > 0").groupBy("base").agg(F.array(*(F.count(F.when(F.col("m") >= d, 1)) for d in deep)).alias("members"), F.array(*(F.min(F.when(F.col("m") >= d, F.col("conv_id"))) for d in deep)).alias("least"))
    taken = taken.join(convs.select(F.col("conv_id").alias("base"), "heads").hint("merge"), "base").select("members", "least", F.inline("heads"))
    at = F.col("pos").cast("int")
    heads = taken.select(
        F.col("pos").alias("depth"), *(F.col("q")[k].alias(FP[k]) for k in range(LANES)), *(((F.col("q")[k] - F.col("t")[k] + PRIME) % PRIME).alias(UP[k]) for k in range(LANES)),
        "ref", "chars", F.element_at("members", at).alias("members"), F.element_at("least", at).alias("conv_id"),
    )
    return own.unionByName(heads.filter("members > 0"))


def _nodes(placed: DataFrame, convs: DataFrame, plan: DataFrame, attempt: int) -> tuple[DataFrame, bool]:
    """A row for each node; whether all groups are verified."""
    up = F.struct(*UP)
    grouped = _prefixes(placed, convs, plan, attempt).groupBy("depth", *FP).agg(
        F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.min(up).alias("up"),
        ((F.min("ref") != F.max("ref")) | (F.min(up) != F.max(up))).alias("mixed"),
    )
    root = plan.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    nothing = F.lit(None).cast("long")
    root = root.select(F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(n) for n in FP), *(nothing.alias(n) for n in UP), "n_convs", "conv_id", F.lit(0).cast("long").alias("chars"), F.lit(False).alias("mixed"))
    nodes = stored(grouped.select("depth", *FP, "up.*", "n_convs", "conv_id", "chars", "mixed").unionByName(root), "nodes")
    return nodes.drop("mixed"), nodes.filter("mixed").isEmpty()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows (node, depth, conv_id): lists of up to LISTED conv_ids of a node, comma-joined, with their first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, depth, conv = (batch[n].to_numpy() for n in ("node", "depth", "conv_id"))
        new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])]))
        ends = np.append(new[1:], len(node))
        cuts = [(s, min(s + LISTED, e)) for a, e in zip(new.tolist(), ends.tolist()) for s in range(a, e, LISTED)]
        start = np.array([s for s, _ in cuts])
        yield pa.RecordBatch.from_arrays([pa.array(node[start]), pa.array(depth[start]), pa.array(conv[start]), pa.array([",".join(map(str, conv[s:e].tolist())) for s, e in cuts])], names=["node", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted lists: the running digest of each node's."""
    at, digest = None, None
    for batch in batches:
        out = []
        for key, ids in zip(zip(batch["node"].to_pylist(), batch["depth"].to_pylist()), batch["ids"].to_pylist()):
            if key == at:
                digest.update(b",")
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _rows(out)
    if at is not None:
        yield _rows([(*at, digest.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["node", "depth", "ends_sha256"])


def _ends(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the nodes in which conversations end."""
    ends = plan.select("conv_id", F.col("length").alias("depth"), *FP).join(nodes.select("depth", *FP, F.col("conv_id").alias("node")).hint("merge"), ["depth", *FP])
    order = ["node", "depth", "conv_id"]
    lists = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_listed, "node long, depth long, first long, ids string")
    return lists.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_digests, "node long, depth long, ends_sha256 string")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of nodes with several members, by doubling."""
    shared = nodes.filter("n_convs > 1").select(
        "conv_id", "depth", F.col("parent_conv_id").alias("above"), (F.col("singles") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    at, reach = stored(shared, "subtrees"), 1
    deepest = at.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        below = at.filter(F.col("depth") >= reach)
        sums = below.groupBy(F.col("above").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        higher = at.filter(F.col("depth") >= reach).select(F.col("conv_id").alias("above"), (F.col("depth") + reach).alias("depth"), F.col("above").alias("higher"))
        out = at.join(sums.hint("merge"), ["conv_id", "depth"], "left").join(higher.hint("merge"), ["above", "depth"], "left")
        total = {c: F.col(c) + F.coalesce(F.col(m), F.lit(0)) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))}
        at, reach = stored(out.withColumns(total).select("conv_id", "depth", F.col("higher").alias("above"), "n_leaves", "saved_tokens"), "subtrees"), 2 * reach
    return at.drop("above")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: smallest member, depth, the parent's smallest member, members, children, leaves, saved tokens, digest of the members that end there."""
    for attempt in range(ATTEMPTS):
        placed = _placed(_turns(conversations, attempt), attempt)
        convs, plan = _plan(placed, attempt)
        nodes, verified = _nodes(placed, convs, plan, attempt)
        if verified:
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes were equal in {ATTEMPTS} attempts")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(f).alias(p) for f, p in zip(FP, UP)), F.col("conv_id").alias("parent_conv_id"))
    named = stored(nodes.join(parents.hint("merge"), ["depth", *UP], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "chars"), "named")
    below = named.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("singles"))
    named = named.join(below.hint("merge"), ["conv_id", "depth"], "left").fillna(0, ["n_children", "singles"])
    named = stored(named, "children")
    ends = _ends(plan, nodes).withColumnRenamed("node", "conv_id")
    out = named.join(_subtrees(named).hint("merge"), ["conv_id", "depth"], "left").join(ends.hint("merge"), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
