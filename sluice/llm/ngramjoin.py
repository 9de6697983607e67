"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A text's set is its windows of five words (lower case; a shorter text is one window). Each tree of the forest is a prefix trie
over labels of minimum hashes; a label is as long as the target recall allows, which is the prefix at which
pairs at the threshold still meet in some tree with that recall. From the full label, each text's prefix is
shortened, hash by hash, for as long as the node above holds at most WIDTH texts: where the forest is
sparse, texts meet at short prefixes, and recall is close to 1; in crowded parts they meet at the full label. The sizes
of a node's ancestors are the same for all texts in it, so all of them stop at the same node, and texts in one node
are candidates of each other.

Texts with equal sets are one class and counted once. A pair of classes is verified only in the first tree where it
meets. A node with many classes or words is dealt into blocks, and each pair of blocks is a unit of work of bounded size;
units exchange signatures first, and only classes with a pair to verify in a unit send their text there. Units give
numbers of links and a spanning forest of the verified pairs, never the pairs themselves. Groups are the connected components.
Where thousands of different texts share a full label, the work grows with the square of their number, as do their links.

Edge cases: null, empty and wordless texts have no set, no links and are their own group; repeated doc_ids are
ordinary rows; ties do not arise; a group's id is its least doc_id (null, if all are null); an empty table gives an empty result;
other columns are passed on by `unique` and may have any names. `unique` keeps one row of a group, whatever the ids: that of the least
doc_id, null ids last, then of the least hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import words as W
from sluice.llm.common import free_name, identity, partitions, stored
from sluice.llm.components import connected

NGRAM, SIMILARITY, TREES, LABEL, RECALL = 5, 0.8, 16, 8, 0.9995
#: Texts that a node may hold for prefixes to be shortened to it; texts and words of a block.
WIDTH, BLOCK, BLOCK_WORDS = 6, 1_500, 1_500_000


def depth(similarity: float = SIMILARITY, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of that similarity meet in one of the trees with the recall asked for."""
    at = label
    while at > 1 and 1 - (1 - similarity**at) ** trees < recall:
        at -= 1
    return at


def ngrams(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the windows of n words."""
    cp = W.codepoints(text, lower=True)
    h = W.mix(W.hashes(cp, *W.spans(cp)))
    return np.unique(W.windows(h, min(n, len(h)))) if len(h) else h


def labels(grams: np.ndarray, trees: int, length: int) -> np.ndarray:
    """The nodes on each tree's path to the text's label, top down: a number for each prefix of `length` minimum hashes."""
    seeds = W.mix(np.arange(1, trees * length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    least = np.full(trees * length, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 4_096):
        part = grams[at : at + 4_096] >> np.uint64(3)
        for k, seed in enumerate(seeds):
            least[k] = min(least[k], (part * seed ^ (part >> np.uint64(29))).min())
    out = least.reshape(trees, length)
    node = np.arange(trees, dtype=np.uint64)
    for level in range(length):
        out[:, level] = node = W.mix(node ^ out[:, level]) + np.uint64(1)
    return out.ravel()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signatures(n: int, trees: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, sizes = [], [], []
            for text in batch["text"]:
                grams = ngrams(text.as_py() or "", n)
                keys.append(_signed(xxhash.xxh3_64_intdigest(grams.tobytes())) if len(grams) else None)
                sets.append(labels(grams, trees, length).view(np.int64) if len(grams) else None)
                sizes.append(len(grams))
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["uid"], *columns], names=["doc_id", "uid", "class", "words", "labels"])

    return run


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of `key` in turn, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(values)]):
            if held and values[a] != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.concat_batches(held)


def _first_meets(nodes: np.ndarray, tree: int, block: np.ndarray, other: bool) -> np.ndarray:
    """Which pairs are to be verified here: they meet in no earlier tree, and lie in different blocks where two are given."""
    m = len(nodes)
    mask = np.triu(np.ones((m, m), bool), 1)
    if other:
        mask &= block[:, None] != block[None, :]
    for t in range(tree):
        mask &= nodes[:, t, None] != nodes[None, :, t]
    return mask


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch["nodes"]
    return column.flatten().to_numpy().reshape(batch.num_rows, -1)


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[pa.RecordBatch] = []
    rows = 0
    for group in runs(batches, "unit"):
        tree, two = group["tree"][0].as_py(), group["two"][0].as_py()
        mask = _first_meets(_matrix(group), tree, group["block"].to_numpy(), two)
        busy = np.flatnonzero(mask.any(0) | mask.any(1))
        if len(busy):
            out.append(group.take(pa.array(busy)))
            rows += len(busy)
        if rows > 5_000:
            yield pa.concat_batches(out)
            out, rows = [], 0
    if out:
        yield pa.concat_batches(out)


def overlaps(sets: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the pairs of the mask: their places and how many elements they share."""
    left, right = np.nonzero(mask)
    if len(left) <= 4 * len(sets):
        return left, right, np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    posting, starts = owner[order], np.searchsorted(ids[order], np.arange(len(values) + 1))
    ends = np.cumsum(sizes)
    shared = np.zeros(len(left), np.int64)
    bounds = np.searchsorted(left, np.arange(len(sets) + 1))
    for i in range(len(sets)):
        if bounds[i] < bounds[i + 1]:
            mine = ids[ends[i] - sizes[i] : ends[i]]
            lengths = starts[mine + 1] - starts[mine]
            at = np.repeat(starts[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            counts = np.bincount(posting[at], minlength=len(sets))
            shared[bounds[i] : bounds[i + 1]] = counts[right[bounds[i] : bounds[i + 1]]]
    return left, right, shared


def _verified(n: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for group in runs(batches, "unit"):
            tree, two = group["tree"][0].as_py(), group["two"][0].as_py()
            sets = [ngrams(unpack(x.as_py()).decode("utf-8", "surrogatepass"), n) for x in group["packed"]]
            mask = _first_meets(_matrix(group), tree, group["block"].to_numpy(), two)
            left, right, shared = overlaps(sets, mask)
            sizes = np.array([len(s) for s in sets])
            ok = shared >= similarity * (sizes[left] + sizes[right] - shared) - 1e-9
            left, right = left[ok], right[ok]
            if not len(left):
                continue
            links = np.bincount(left, minlength=len(sets)) + np.bincount(right, minlength=len(sets))
            root = np.arange(len(sets))
            while True:  # labels go down until they settle
                low = np.minimum(root[left], root[right])
                new = root.copy()
                np.minimum.at(new, left, low)
                np.minimum.at(new, right, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            at, keys = np.flatnonzero(links), group["class"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(keys[root[at]]), pa.array(links[at])], names=["u", "v", "links"])

    return run


def _packed(text: str) -> Column:
    @F.pandas_udf(T.BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=1).compress
        return texts.map(lambda x: pack(x.encode("utf-8", "surrogatepass")))

    return packed(text)


def meeting_nodes(labelled: DataFrame, trees: int, length: int, width: int = WIDTH) -> DataFrame:
    """class, words, tree, node and m: where each class's prefix ends in each tree, and the classes there; only nodes with company.

    labelled: class, words, labels of each class. A class goes up from its full label while the node above has at most `width` classes.
    """
    paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("labels", t * length + 1, F.lit(length)))
    members = labelled.select("class", "words", F.posexplode(paths).alias("tree", "path")).withColumn("top", F.col("path")[0])
    tops = members.groupBy("top").agg(F.count("*").alias("m")).filter("m > 1")
    members = stored(members.join(tops.hint("merge"), "top").select("class", "words", "tree", "path", "m"), "trie-members")
    sparse = members.filter(F.col("m") <= width).select("class", "words", "tree", F.col("path")[0].alias("node"), "m")
    if length == 1:
        return members.select("class", "words", "tree", F.col("path")[0].alias("node"), "m")
    below = members.filter(F.col("m") > width).select("class", "words", "tree", F.posexplode("path").alias("depth", "node")).filter("depth > 0")
    sizes = below.groupBy("node").agg(F.count("*").alias("m"))
    ends = below.join(sizes.hint("merge"), "node").filter((F.col("m") <= width) | (F.col("depth") == length - 1))
    ends = ends.groupBy("class", "words", "tree").agg(F.min(F.struct("depth", "node", "m")).alias("end"))
    return sparse.union(ends.select("class", "words", "tree", "end.node", "end.m")).filter("m > 1")


def join(documents: DataFrame, *, n: int = NGRAM, similarity: float = SIMILARITY, trees: int = TREES, label: int = LABEL, recall: float = RECALL, width: int = WIDTH, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, uid (hash of the row's id and text), class, copy_of, group_id, kept_uid and n_links for each row of documents.

    copy_of is the least doc_id with the same set, group_id the least in the connected component of links, kept_uid the
    row that stands for it, and n_links the number of other sets that are similar enough.
    """
    spark = documents.sparkSession
    length = depth(similarity, trees, label, recall)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", identity(F.col("doc_id"), F.col("text")).alias("uid"), "text")
    signed = stored(texts.mapInArrow(_signatures(n, trees, length), f"doc_id {id_type}, uid long, class long, words long, labels array<long>"), "signatures")
    known = signed.filter("class is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    classes = known.groupBy("class").agg(F.min(rank).alias("first"), F.min("uid").alias("rep"))

    met = stored(meeting_nodes(known.dropDuplicates(["class"]).select("class", "words", "labels"), trees, length, width), "trie-nodes")
    # the nodes of a class in all trees; alone in a tree, its own number stands there
    own = met.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("by_tree"))
    own = own.select("class", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("by_tree", t), F.col("class"))).alias("nodes"))
    sizes = met.groupBy("node").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("words") / block_words)).cast("int").alias("blocks"))
    sized = met.select("class", "tree", "node").join(sizes.hint("merge"), "node")
    sized = sized.withColumn("block", F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = sized.withColumn("other", other).select(
        "class", "tree", "block", (F.col("block") != F.col("other")).alias("two"),
        F.xxhash64("tree", "node", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
    )
    fields = "class long, tree int, block int, two boolean, unit long, nodes array<long>"
    parts = partitions(spark)
    dealt = units.join(own.hint("merge"), "class").select("class", "tree", "block", "two", "unit", "nodes")
    needs = stored(dealt.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_needs, fields), "units")

    # the texts of classes with something to verify go to their units
    wanted = needs.select("class").distinct().join(classes.select("class", "rep").hint("merge"), "class")
    reps = texts.filter("text is not null").join(wanted.hint("merge"), F.col("uid") == F.col("rep")).dropDuplicates(["class"]).select("class", _packed("text").alias("packed"))
    loaded = needs.join(reps.hint("merge"), "class").repartition(parts, "unit").sortWithinPartitions("unit")
    linked = stored(loaded.mapInArrow(_verified(n, similarity), "u long, v long, links long"), "links")

    groups = stored(connected(linked.select("u", "v")), "groups")
    counts = linked.groupBy("u").agg(F.sum("links").alias("n_links"))
    about = classes.join(groups.withColumnRenamed("id", "class").hint("merge"), "class", "left").join(counts.withColumnRenamed("u", "class").hint("merge"), "class", "left")
    about = about.withColumn("component", F.coalesce("component", "class"))
    least = about.groupBy("component").agg(F.min("first").alias("kept"))
    about = about.join(least.hint("merge"), "component")
    about = stored(about.select("class", "first.doc_id", "kept.uid", F.col("kept.doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).toDF("class", "copy_of", "kept_uid", "group_id", "n_links"), "classes")
    out = signed.select("doc_id", "uid", "class").join(about.hint("merge"), "class", "left")
    alone = F.col("class").isNull()
    return out.select(
        "doc_id", "uid", "class", F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("kept_uid", "uid").alias("kept_uid"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def report(documents: DataFrame, **options) -> DataFrame:
    """Every document's group (class_id), the first document of the same set, and its number of links."""
    return join(documents, **options).select("doc_id", F.col("group_id").alias("class_id"), "copy_of", "n_links")


def unique(documents: DataFrame, **options) -> DataFrame:
    """One document of each group, the first by doc_id; documents without words all stay. Columns stay as they came."""
    found = join(documents.select("doc_id", "text"), **options)
    stays = found.filter("uid = kept_uid").select("uid", "class").distinct()
    uid, cls, rank = (free_name(documents, x) for x in ("__uid", "__class", "__rank"))
    stays = stays.select(F.col("uid").alias(uid), F.col("class").alias(cls))
    out = documents.withColumn(uid, identity(F.col("doc_id"), F.col("text"))).join(stays.hint("merge"), uid)
    # rows that repeat a kept row wholly have its uid: one of them stays, unless they have no set
    key = F.coalesce(F.col(cls), F.monotonically_increasing_id())
    return out.withColumn(rank, key).dropDuplicates([uid, rank]).select(*documents.columns)
