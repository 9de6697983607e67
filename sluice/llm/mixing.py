"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are counted for each cell of source, language and topic. Raking scales the cells, one
dimension after the other, until the shares of every source, language and topic meet their targets (to TOLERANCE, or for ROUNDS
rounds, should targets contradict each other). Cells are few: up to DRIVER_CELLS of them are raked where they are read, more by Spark. A
document is then kept with probability proportional to fitted over present tokens of its cell, scaled so
that the largest probability is 1: expected token shares are the targets, and no document is repeated.

Targets are given as weights for each value, or come from the present shares raised to `temper` (1 keeps
them, 0 makes them equal). A topic column may be named; without one, a document's topic is the hash class of
its longest word (of equals the last in order), which near copies share and which needs no fitted model.

Edge cases: null is a value of its own in each dimension; texts without words count as one token, so that
every document has a probability; ties do not arise, as the random number of a document depends on doc_id
only; repeated doc_ids are kept or left together; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import WORD_SPLIT, free_name, stored, uniform

TEMPER, ROUNDS, TOLERANCE, TOPICS, SEED = 0.7, 100, 1e-12, 8, 20
DIMENSIONS = ("source", "lang", "topic")
#: A cell table of at most this many rows is broadcast; a larger one meets the documents in a salted join.
BROADCAST_CELLS, SALTS = 100_000, 32
#: Cells up to which the raking runs at the driver; one has some 100 bytes.
DRIVER_CELLS = 50_000


def n_tokens(text: Column) -> Column:
    words = F.size(F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")), " +"))
    return F.greatest(words, F.lit(1)).cast("long")


def lexical_topic(text: Column, topics: int = TOPICS) -> Column:
    """Hash class of the longest word."""
    longest = F.array_max(F.transform(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    first = F.conv(F.substring(F.md5(longest["word"].cast("binary")), 1, 8), 16, 10).cast("long")
    return (first % topics).cast("int")


def described(documents: DataFrame, *, topic: str | None = None, topics: int = TOPICS) -> DataFrame:
    """doc_id, the three dimensions and tokens of each document; no text."""
    return documents.select("doc_id", "source", "lang", (F.col(topic) if topic else lexical_topic(F.col("text"), topics)).alias("topic"), n_tokens(F.col("text")).alias("tokens"))


def _targets(cells: DataFrame, dimension: str, given: dict | None, temper: float) -> Column:
    """The target share of a cell's value in one dimension, as a column on the cells."""
    mine = Window.partitionBy(dimension)
    if given is None:
        weight = F.pow(F.sum("tokens").over(mine), F.lit(temper))
    else:
        weight = F.coalesce(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(dimension)], F.lit(0.0))
    return weight / F.count("*").over(mine)


def rake(cells: DataFrame, *, targets: dict[str, dict] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `fitted`: the cell's tokens after raking, and each dimension's goal; the targets of values that occur add up to 1."""
    at = cells.select(*DIMENSIONS, "tokens")
    for d in DIMENSIONS:
        at = at.withColumn(f"w_{d}", _targets(at, d, (targets or {}).get(d), temper))
    everything = at.agg(F.sum("tokens").alias("all_tokens"), *[F.sum(f"w_{d}").alias(f"sum_{d}") for d in DIMENSIONS])
    at = at.crossJoin(F.broadcast(everything))  # one row
    for d in DIMENSIONS:
        goal = F.sum(f"w_{d}").over(Window.partitionBy(d)) / F.col(f"sum_{d}") * F.col("all_tokens")
        at = at.withColumn(f"goal_{d}", goal).drop(f"w_{d}", f"sum_{d}")
    at = stored(at.drop("all_tokens").withColumn("fitted", F.col("tokens").cast("double")), "cells")
    if at.count() <= DRIVER_CELLS:
        return _raked_here(at, rounds, tolerance)
    return _raked(at, rounds, tolerance)


def _raked(at: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """By Spark: every scaling is a sum over one dimension. The cells are written out after every fourth round, so plans stay short."""
    for i in range(rounds):
        for d in DIMENSIONS:
            total = F.sum("fitted").over(Window.partitionBy(d))
            at = at.withColumn("fitted", F.when(total > 0, F.col("fitted") * F.col(f"goal_{d}") / total).otherwise(F.lit(0.0)))
        if i % 4 == 3 or i == rounds - 1:
            at = stored(at, "cells")
            off = [at.groupBy(d).agg(F.sum("fitted").alias("t"), F.first(f"goal_{d}").alias("g")).agg(F.max(F.abs(F.col("t") - F.col("g")) / F.greatest("g", F.lit(1.0)))).first()[0] for d in DIMENSIONS]
            if max(off) <= tolerance:
                break
    return at


def _raked_here(at: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    rows = at.orderBy(*DIMENSIONS).collect()
    fitted = np.array([r.fitted for r in rows])
    of, goals = {}, {}
    for d in DIMENSIONS:
        numbers: dict = {}
        of[d] = np.array([numbers.setdefault(r[d], len(numbers)) for r in rows], np.int64)
        goals[d] = np.zeros(len(numbers))
        goals[d][of[d]] = [r[f"goal_{d}"] for r in rows]
    total = lambda d: np.bincount(of[d], weights=fitted, minlength=len(goals[d]))
    for _ in range(rounds if rows else 0):
        for d in DIMENSIONS:
            now = total(d)
            fitted = fitted * np.divide(goals[d], now, out=np.zeros_like(now), where=now > 0)[of[d]]
        if max(np.max(np.abs(total(d) - goals[d]) / np.maximum(goals[d], 1.0)) for d in DIMENSIONS) <= tolerance:
            break
    return at.sparkSession.createDataFrame([(*r[:-1], float(x)) for r, x in zip(rows, fitted)], at.schema)


def probabilities(cells: DataFrame) -> DataFrame:
    """Each cell's sampling probability."""
    ratio = F.col("fitted") / F.col("tokens")
    most = cells.agg(F.max(ratio).alias("most"))
    return cells.crossJoin(F.broadcast(most)).select(*DIMENSIONS, F.coalesce(F.try_divide(ratio, F.col("most")), F.lit(0.0)).alias("probability"))  # one row


def _chances(rows: DataFrame, **options) -> DataFrame:
    """Each cell's sampling probability, from the documents' dimensions and tokens."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    return stored(probabilities(rake(cells, **options)), "chances")


def _with_chances(rows: DataFrame, chances: DataFrame, topic: str, into: str) -> DataFrame:
    """The rows with their cell's probability as `into`."""
    names = {d: free_name(rows, f"__{d}") for d in DIMENSIONS}
    chances = chances.select(*[F.col(d).alias(n) for d, n in names.items()], F.col("probability").alias(into))
    on = F.col("source").eqNullSafe(F.col(names["source"])) & F.col("lang").eqNullSafe(F.col(names["lang"])) & F.col(topic).eqNullSafe(F.col(names["topic"]))
    if chances.count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(chances), on, "left").drop(*names.values())
    salt, other = free_name(rows, "__salt"), free_name(rows, "__salt_of")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = chances.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread.hint("merge"), on & (F.col(salt) == F.col(other)), "left").drop(salt, other, *names.values())


def report(documents: DataFrame, *, topic: str | None = None, topics: int = TOPICS, seed: int = SEED, **options) -> DataFrame:
    """Every document's cell, probability and whether it is sampled. Texts are read once."""
    rows = stored(described(documents, topic=topic, topics=topics), "described")
    out = _with_chances(rows, _chances(rows, **options), "topic", "probability")
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample(documents: DataFrame, *, topic: str | None = None, topics: int = TOPICS, seed: int = SEED, **options) -> DataFrame:
    """The sampled documents, with their columns as they came."""
    chances = _chances(described(documents, topic=topic, topics=topics), **options)
    mine, p = free_name(documents, "__topic_of"), free_name(documents, "__chance")
    rows = documents.withColumn(mine, F.col(topic) if topic else lexical_topic(F.col("text"), topics))
    return _with_chances(rows, chances, mine, p).filter(uniform(F.col("doc_id"), seed) < F.col(p)).select(*documents.columns)
