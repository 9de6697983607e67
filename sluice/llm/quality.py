"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into a fixed number of buckets. One multinomial is fitted to trusted
documents (a bounded sample of the labelled rows with quality 1 and toxic 0), another to every document of
the corpus. A document's score is the mean log ratio of its n-grams; it is kept if that mean reaches the
threshold. Weights are integers (millionths), so sums do not depend on the order of rows.

Edge cases: a null or empty text has no words, fails the base rules and gets a null mean; null or repeated
doc_ids are ordinary rows; without any trusted row all weights are 0, so only the base rules decide; an
empty table gives an empty result; other columns of `documents` may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.common import free_name

BUCKETS = 65_536
#: Bound on the labelled rows that the target multinomial is fitted to.
TARGET_ROWS = 50_000
#: Least mean log ratio, in millionths.
THRESHOLD_U = -160_000
#: Word hash: from 0, h = (h * BASE + code point) modulo 2**32.
BASE = 1_000_003
FIELDS = "n_words long, n_dup_lines long, n_repeat_words long, llr_sum_u long, n_grams long"


def grams(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the words (32-bit hashes) and of the word pairs."""
    h = h.astype(np.int64)
    return np.concatenate([h % buckets, (h[:-1] * 1_000_003 + h[1:] * 7 + 1) % buckets])


def _hash32(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return W.hashes(cp, starts, ends, BASE) & np.uint64(0xFFFFFFFF)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, buckets), np.int64)
        for batch in batches:
            pending: tuple[list, list] = ([], [])
            size = 0
            for text, trusted in zip(batch["text"], batch["trusted"].to_pylist()):
                cp = W.codepoints(text.as_py() or "")
                starts, ends = W.spans(cp)
                if len(starts):
                    found = grams(_hash32(cp, starts, ends), buckets)
                    for row in (0, 1) if trusted else (0,):
                        pending[row].append(found)
                    size += len(found)
                if size > 2_000_000:
                    _add(table, pending)
                    size = 0
            _add(table, pending)
        for at in range(0, buckets, 16_384):
            part = np.arange(at, min(at + 16_384, buckets))
            part = part[table[0, part] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[0, part]), pa.array(table[1, part])], names=["bucket", "raw", "target"])

    return run


def _add(table: np.ndarray, pending: tuple[list, list]) -> None:
    for row, found in enumerate(pending):
        if found:
            table[row] += np.bincount(np.concatenate(found), minlength=table.shape[1])
            found.clear()


def fit(documents: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Weight of each bucket in millionths: ln of its smoothed share in the target over that in the corpus.

    What reaches the driver is one row for each bucket, however large the corpus is, and the sample of
    trusted ids (at most target_rows, those with the least md5) is what the first join broadcasts.
    """
    trusted = (
        labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(target_rows)
        .withColumn("trusted", F.lit(True))
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counted = rows.mapInArrow(_counts(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = np.zeros((2, buckets), np.int64)
    for row in counted.collect():
        table[:, row.bucket] = row.raw, row.target
    if not table[1].any():
        return np.zeros(buckets, np.int64)
    shares = (table + 1) / (table.sum(axis=1, keepdims=True) + buckets)
    return np.rint(np.log(shares[1] / shares[0]) * 1e6).astype(np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(h) < 4:
        return 0
    _, inverse, counts = np.unique(W.windows(h, 3), return_inverse=True, return_counts=True)
    if len(counts) == len(inverse):
        return 0
    hit = counts[inverse] > 1
    covered = np.zeros(len(h), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str, weights: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, n_dup_lines, n_repeat_words, sum of weights, number of n-grams."""
    cp = W.codepoints(text)
    starts, ends = W.spans(cp)
    if not len(starts):
        return 0, 0, 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    found = grams(_hash32(cp, starts, ends), len(weights))
    return len(starts), len(lines) - len(set(lines)), repeated_words(W.hashes(cp, starts, ends)), int(weights[found].sum()), len(found)


def _measures(weights: np.ndarray):
    @F.pandas_udf(FIELDS)
    def measures(texts: pd.Series) -> pd.DataFrame:
        rows = [measure(text, weights) for text in texts]
        return pd.DataFrame(rows, columns=["n_words", "n_dup_lines", "n_repeat_words", "llr_sum_u", "n_grams"], dtype="int64")

    return measures


def scored(documents: DataFrame, weights: np.ndarray, *, threshold_u: int = THRESHOLD_U, into: str = "quality") -> DataFrame:
    """Adds one struct column: the measures, base_failed and kept."""
    m = free_name(documents, "__measures")
    out = documents.withColumn(m, _measures(weights)(F.coalesce(F.col("text"), F.lit(""))))
    failed = (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))
    kept = ~failed & (F.col(f"{m}.llr_sum_u") >= F.lit(threshold_u) * F.col(f"{m}.n_grams"))
    return out.withColumn(into, F.struct(f"{m}.*", failed.alias("base_failed"), kept.alias("kept"))).drop(m)


def report(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every document's measures and verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(
        "doc_id", "text",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    q = scored(base, fit(documents, labels, **options))
    return q.select(
        "doc_id", "quality.n_words", "word_chars", "n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        "quality.base_failed", "quality.kept", "quality.llr_sum_u", "quality.n_grams",
    )


def keep_good(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their columns as they came."""
    q = free_name(documents, "__quality")
    return scored(documents, fit(documents, labels, **options), into=q).filter(F.col(f"{q}.kept")).drop(q)
