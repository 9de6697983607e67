"""Every row of a large table beside every row of a small one, whose size is checked; or beside the wide row of its key, in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import kept

#: Rows up to which the small side is sent to all executors; beyond that it is dealt out like the large one.
MOST = 10_000


def if_few(rows: DataFrame, most: int = MOST, other: str | None = None) -> DataFrame:
    """The rows with the hint to broadcast them, if there are no more than `most`; else with the hint `other`, if there is one.

    They are worked out once: what is counted is written, and read again by the join.
    """
    first = kept(rows.limit(most + 1), "few")
    if first.count() <= most:
        return F.broadcast(first)
    return rows.hint(other) if other else rows


def beside(rows: DataFrame, few: DataFrame, most: int = MOST) -> DataFrame:
    return rows.crossJoin(if_few(few, most))


#: Rows of a key that meet one copy of its wide row, as long as that makes no more copies, beside one for each key, than MOST_TASKS; and tasks that such a join has at most.
ROWS_EACH, MOST_TASKS = 1_000, 200


def spread(rows: DataFrame, wide: DataFrame, key: list[str], by: str, *, each: int = ROWS_EACH, most: int = MOST_TASKS) -> DataFrame:
    """Inner join with a table that has one or few wide rows for a key, which are copied for portions of the key's rows: no key gathers in one task, and nothing is sent to all.

    There are as many tasks as parts, since what the join makes is much larger than what it reads, but no more than `most`: beyond that portions grow, not the
    number of copies. by: the column by whose hash a key's rows are dealt to its parts.
    """
    counts = kept(rows.groupBy(*key).agg(F.count("*").alias("n")), "parts")
    each = max(each, -(-(counts.agg(F.sum("n")).first()[0] or 0) // most))
    sizes = counts.select(*key, F.ceil(F.col("n") / each).cast("int").alias("parts"))
    tasks = min(most, sizes.agg(F.sum("parts")).first()[0] or 1)
    held = if_few(sizes, other="merge")
    # one column is the key of the join, so that both sides stay as they are dealt
    lot = F.to_json(F.struct(*key, "part")).alias("lot")
    dealt = rows.join(held, key).withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).select(lot, *rows.columns)
    copies = wide.join(held, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(lot, *(c for c in wide.columns if c not in key))
    return dealt.repartition(tasks, "lot").join(copies.repartition(tasks, "lot").hint("merge"), "lot").drop("lot")
