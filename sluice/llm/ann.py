"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors get one more component that turns the largest inner product into the least distance, are rotated by a fixed random
orthogonal matrix, and are assigned to the list of their nearest centroid. Centroids are fitted to a bounded
sample; every row is in the index. A query goes to its `probes` nearest lists, a number that is raised on the sample until
recall against brute force reaches its target. Lists are dealt into blocks of bounded size, so a hot list
is many tasks.

In a block, many queries are scanned together; each comes to a block once, with the lists that it probes there. The distances in the first columns come
from one matrix product. A query ranks the few candidates that are nearest there exactly, which gives a distance to beat. The others are scanned column block
by column block: after d of D rotated columns, the partial distance times D / d estimates the distance, and a candidate is abandoned when even with the
tolerance (1 + EPSILON / sqrt(d)) the estimate is too large, which rejects wrongly with a chance that falls as exp(-EPSILON^2). While many candidates are left,
further columns come from a product too, later for the open pairs alone. The nearest are scored by the inner product of the original vectors in
double precision, and the best of all blocks are merged. A query whose lists hold fewer than k candidates is searched again in all lists.

Edge cases: vectors that are null, empty, zero, of another length than most or with null or non-finite components
take no part, neither as queries nor as candidates; fewer candidates than k give fewer rows; equal scores rank by smaller vec_id;
rows that repeat a vec_id are candidates each, but never of their own id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import partitions, stored
from sluice.llm.ngramjoin import runs

K, EVERY, EPSILON, COLUMNS, FIRST = 20, 20, 2.1, 16, 64
#: Bound on the rows that the centroids and the number of probes are fitted to, rows a list and rows a block.
SAMPLE, LIST_ROWS, BLOCK_ROWS, MOST_LISTS = 20_000, 400, 4_096, 4_096
#: Recall that the number of probes is fitted to, queries for that.
TARGET, TRIALS = 0.97, 200
#: Queries that are scanned together; while one of so many distances or more is still open, the next columns come from one product for all.
TOGETHER, FEW = 64, 8


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    norm2: float
    probes: int

    def placed(self, vectors: np.ndarray, as_query: bool) -> np.ndarray:
        """Rotated vectors with the extra component (0 for queries)."""
        extra = np.zeros(len(vectors)) if as_query else np.sqrt(np.maximum(0.0, self.norm2 - (vectors**2).sum(1)))
        return np.concatenate([vectors, extra[:, None]], axis=1) @ self.rotation

    def order(self, placed: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row."""
        score = (self.centroids**2).sum(1)[None, :] - 2 * placed @ self.centroids.T
        if n >= score.shape[1]:
            return np.argsort(score, axis=1)
        if n == 1:
            return score.argmin(1)[:, None]
        return np.argpartition(score, n - 1, axis=1)[:, :n]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", vector.alias("vector"))
    good = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter((F.size("vector") > 0) & F.coalesce(good, F.lit(False)))


def fit(vectors: DataFrame, *, seed: int = 3, target: float = TARGET) -> Index | None:
    """Centroids, largest norm and probes. The sample is the SAMPLE rows with the least hash of vec_id."""
    usual = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not usual:
        return None
    d = usual[0].d
    stats = vectors.filter(F.size("vector") == d).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")).first()
    rows = vectors.filter(F.size("vector") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    sample = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, d)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0]
    index = Index(rotation, np.zeros((1, d + 1)), float(stats.norm2), 1)
    placed = index.placed(sample, False)
    lists = int(min(MOST_LISTS, max(1, len(sample) // 40), max(1, stats.n // LIST_ROWS)))
    index.centroids = placed[rng.choice(len(placed), lists, replace=False)]
    for _ in range(8):
        own = index.order(placed, 1)[:, 0]
        sizes = np.bincount(own, minlength=lists)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, own, placed)
        index.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], index.centroids)
    own = index.order(placed, 1)[:, 0]
    at = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    scores = sample[at] @ sample.T
    scores[np.arange(len(at)), at] = -np.inf
    k = min(K, len(sample) - 1)
    if k > 0:
        true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = index.order(index.placed(sample[at], True), lists)
        place = np.argsort(order, axis=1)  # list -> how many lists are nearer
        needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
        index.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    return index


def _dealt(index: Index, d: int, probes: int = 1, units: list[tuple[int, int, int]] | None = None):
    """Each row with its list, or, where the lists' units are given, each query once for each unit of the lists that it probes, with those lists."""
    place = {n: (first, blocks) for n, first, blocks in units or ()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["vector"].value_lengths().to_numpy()
            batch = batch.filter(pa.array(lengths == d))
            for at in range(0, batch.num_rows, 2_000 if units is None else 200):
                part = batch.slice(at, 2_000 if units is None else 200)
                vectors = part["vector"].flatten().to_numpy().reshape(-1, d)
                own = index.order(index.placed(vectors, units is not None), probes)
                if units is None:
                    yield pa.RecordBatch.from_arrays([part["vec_id"], part["vector"], pa.array(own[:, 0].astype(np.int32))], names=["vec_id", "vector", "list"])
                    continue
                rows, lists, to = [], [], []
                for i, probed in enumerate(own.tolist()):
                    met: dict[int, list[int]] = {}
                    for n in probed:
                        for unit in range(place[n][0], sum(place[n])):
                            met.setdefault(unit, []).append(n)
                    rows += [i] * len(met)
                    lists += met.values()
                    to += met
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken["vec_id"], taken["vector"], pa.array(lists, pa.list_(pa.int32())), pa.array(to, pa.int32())], names=["vec_id", "vector", "lists", "unit"])

    return run


def scan(q: np.ndarray, x: np.ndarray, pq: np.ndarray, px: np.ndarray, ids: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block's rows x for each of many queries q: positions of queries and rows, scores. px and pq are the rotated forms, `may` (queries x rows) tells which rows a query may meet."""
    total, done = px.shape[1], min(COLUMNS, px.shape[1])
    #: what rounding may add to a squared distance
    slack = 1e-12 * (1 + (pq**2).sum(1) + (px**2).sum(1).max())[:, None]

    def apart(a: int, b: int) -> np.ndarray:
        return (px[:, a:b] ** 2).sum(1)[None, :] - 2 * pq[:, a:b] @ px[:, a:b].T + (pq[:, a:b] ** 2).sum(1)[:, None]

    near, still, limit = apart(0, done), may, np.full((len(q), 1), np.inf)
    if len(x) > max(FIRST, 2 * k):
        # those that are nearest in the first columns are ranked exactly; the k-th of them is to beat
        split = np.argpartition(np.where(may, near, np.inf), FIRST - 1, axis=1)[:, :FIRST]
        exact = np.where(np.take_along_axis(may, split, 1), ((px[split] - pq[:, None, :]) ** 2).sum(2), np.inf)
        limit = np.partition(exact, k - 1, axis=1)[:, k - 1 : k]
        first = np.zeros_like(may)
        np.put_along_axis(first, split, True, axis=1)
    else:
        first = may
    while done < total:
        still = still & (first | (near <= (limit * (1 + EPSILON / np.sqrt(done)) ** 2 + slack) * (done / total)))
        end = min(total, done + COLUMNS)
        if np.count_nonzero(still) * FEW > near.size:
            near += apart(done, end)
        else:
            at, row = np.divmod(np.flatnonzero(still), len(x))
            near[at, row] += ((px[row, done:end] - pq[at, done:end]) ** 2).sum(1)
        done = end
    near[~still] = np.inf
    # by now distances are whole, and only the k nearest can be the k best
    if len(x) > k:
        limit = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
    at, row = np.divmod(np.flatnonzero(still & (near <= limit * (1 + 1e-9) + slack)), len(x))
    scores = np.einsum("ij,ij->i", q[at], x[row])
    order = np.lexsort((ids[row], -scores, at))
    at, row, scores = at[order], row[order], scores[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[best], row[best], scores[best]


def _searched(index: Index, d: int, k: int):
    """The best of a unit for each query, over those of the unit's lists that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "unit"):
            is_query = np.asarray(group["is_query"])
            vectors = group["vector"].flatten().to_numpy().reshape(-1, d)
            ids, lists, many = group["vec_id"].to_numpy(), group["lists"].flatten().to_numpy(), group["lists"].value_lengths().to_numpy()
            starts = np.cumsum(many) - many
            mine, asked = np.flatnonzero(~is_query), np.flatnonzero(is_query)
            if not len(mine) or not len(asked):
                continue
            x, xid = vectors[mine], ids[mine]
            px = index.placed(x, False)
            kinds, kind = np.unique(lists[starts[mine]], return_inverse=True)
            for start in range(0, len(asked), TOGETHER):
                some = asked[start : start + TOGETHER]
                probed = np.array([np.isin(kinds, lists[starts[n] : starts[n] + many[n]]) for n in some])
                q = vectors[some]
                at, row, scores = scan(q, x, index.placed(q, True), px, xid, probed[:, kind] & (xid[None, :] != ids[some][:, None]), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some[at]]), pa.array(xid[row]), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def grouped_lists(sizes: dict[int, int], lists: int, rows: int = BLOCK_ROWS) -> list[tuple[int, int, int]]:
    """(list, first unit, blocks): small lists share a unit of up to about `rows` rows, a large one has several units."""
    out, unit, held = [], 0, 0
    for n in range(lists):
        size = sizes.get(n, 0)
        if size > rows:
            unit += held > 0
            blocks = -(-size // rows)
            out.append((n, unit, blocks))
            unit, held = unit + blocks, 0
        else:
            if held + size > rows:
                unit, held = unit + 1, 0
            out.append((n, unit, 1))
            held += size
    return out


def nearest(embeddings: DataFrame, *, k: int = K, every: int = EVERY, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    index = fit(vectors, target=target)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = len(index.rotation) - 1
    members = stored(vectors.mapInArrow(_dealt(index, d), "vec_id long, vector array<double>, list int"), "lists")
    queries = vectors.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    # one row for each list: at most MOST_LISTS
    sizes = {r["list"]: r["n"] for r in members.groupBy("list").agg(F.count("*").alias("n")).collect()}
    grouped = grouped_lists(sizes, len(index.centroids))
    units = F.broadcast(spark.createDataFrame(grouped, "list int, first int, blocks int"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks"))
    dealt = members.join(units, "list").withColumn("unit", F.xxhash64(F.col("first") + block.cast("int")))
    dealt = dealt.select("vec_id", "vector", F.array("list").alias("lists"), "unit", F.lit(False).alias("is_query"))

    def search(some: DataFrame, probes: int) -> DataFrame:
        asked = some.mapInArrow(_dealt(index, d, probes, grouped), "vec_id long, vector array<double>, lists array<int>, unit int")
        both = dealt.union(asked.select("vec_id", "vector", "lists", F.xxhash64("unit").alias("unit"), F.lit(True).alias("is_query")))
        found = both.repartition(partitions(spark), "unit").sortWithinPartitions("unit").mapInArrow(_searched(index, d, k), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")

    found = search(queries, index.probes)
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(queries.join(full.hint("merge"), "vec_id", "left_anti"), "short-queries")
    if index.probes < len(index.centroids) and not short.isEmpty():
        found = found.join(full.withColumnRenamed("vec_id", "query_id").hint("merge"), "query_id", "left_semi").union(search(short, len(index.centroids)))
    return found
