"""The nearest item to a mark on a page, in bounded work.

A page with few pairs of marks and items is compared as it is. A crowded one is laid under a grid: marks meet the items of their own and the eight cells around,
and what lies outside is farther than a cell is wide. If the best score found is at most that width, it is final, since no score is below its
distance; otherwise the page goes into the next round with cells four times as wide, until they hold the page or the greatest distance asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import kept

BOX = ("x0", "y0", "x1", "y1")
#: Pairs of a page that are compared without a grid, and items that a cell of the first grid holds on average.
FEW_PAIRS, IN_CELL = 10_000, 4


def _penalty() -> Column:
    d = F.coalesce(F.col("direction"), F.lit(""))
    wrong = F.when(d == "right", F.col("x0") <= F.col("ax1")).when(d == "left", F.col("x1") >= F.col("ax0")).when(d == "below", F.col("y0") <= F.col("ay1")).when(d == "above", F.col("y1") >= F.col("ay0"))
    return F.when(F.coalesce(wrong, F.lit(False)), 1_000).otherwise(0)


def _best(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Score and value of the best pair of each page: distance, 1000 for the wrong side, five times the vertical gap; of equal ones the first mark, then the first line."""
    dx = (F.col("x0") + F.col("x1") - F.col("ax0") - F.col("ax1")) / 2
    dy = (F.col("y0") + F.col("y1") - F.col("ay0") - F.col("ay1")) / 2
    far = F.sqrt(dx * dx + dy * dy)
    scored = pairs.filter("a_no <> line_no").withColumn("far", far).filter((F.col("max_distance") == 0) | (F.col("far") <= F.col("max_distance")))
    scored = scored.withColumn("score", F.round(F.col("far") + _penalty() + F.abs(dy) * 5, 6))
    return scored.groupBy(*key).agg(F.min("score").alias("score"), F.min_by("value", F.struct("score", "a_no", "line_no")).alias("value"))


def nearest(marks: DataFrame, items: DataFrame, key: list[str], *, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """The value of the item nearest to any mark, for each page (key) that has one within reach.

    marks: key, a_no, box as ax0, ay0, ax1, ay1, direction (null: any side), max_distance (0: any). items: key, line_no, box, value.
    """
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    marks = marks.select(*key, "a_no", *(F.col(f"a{c}") for c in BOX), "direction", F.coalesce("max_distance", F.lit(0)).alias("max_distance"))
    items = items.select(*key, "line_no", *BOX, "value")
    sizes = items.groupBy(*key).agg(F.count("*").alias("n"), F.min(middle("x0", "x1")).alias("l"), F.max(middle("x0", "x1")).alias("r"), F.min(middle("y0", "y1")).alias("t"), F.max(middle("y0", "y1")).alias("b"))
    lefts = marks.groupBy(*key).agg(F.count("*").alias("m"), F.min(middle("ax0", "ax1")).alias("ml"), F.max(middle("ax0", "ax1")).alias("mr"), F.min(middle("ay0", "ay1")).alias("mt"), F.max(middle("ay0", "ay1")).alias("mb"), F.max(F.when(F.col("max_distance") == 0, float("inf")).otherwise(F.col("max_distance"))).alias("limit"))
    crowded = sizes.join(lefts.hint("merge"), key).filter(F.col("n") * F.col("m") > few_pairs)
    extent = F.greatest(F.greatest("r", "mr") - F.least("l", "ml"), F.greatest("b", "mb") - F.least("t", "mt"), F.lit(1e-6))
    open_ = kept(crowded.select(*key, (extent * F.sqrt(IN_CELL / F.col("n"))).alias("cell"), F.least(extent, F.col("limit")).alias("whole")), "crowded")
    if open_.isEmpty():
        return _best(marks.join(items.hint("merge"), key), key).drop("score")
    found = [_best(marks.join(open_.select(*key).hint("merge"), key, "left_anti").join(items.hint("merge"), key), key).drop("score")]
    while not open_.isEmpty():
        at = lambda a, b: F.floor(middle(a, b) / F.col("cell"))
        around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        near = marks.join(open_.hint("merge"), key).withColumns({"gx": at("ax0", "ax1"), "gy": at("ay0", "ay1")}).withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
        near = near.withColumns({"gx": F.col("gx") + F.col("i"), "gy": F.col("gy") + F.col("j")}).drop("i", "j", "cell", "whole")
        laid = items.join(open_.hint("merge"), key).withColumns({"gx": at("x0", "x1"), "gy": at("y0", "y1")}).drop("cell", "whole")
        best = kept(open_.join(_best(near.join(laid.hint("merge"), [*key, "gx", "gy"]), key).hint("merge"), key, "left"), "nearest")
        done = (F.coalesce(F.col("score") <= F.col("cell"), F.lit(False))) | (F.col("cell") >= F.col("whole"))
        found.append(best.filter(done & F.col("value").isNotNull()).select(*key, "value"))
        open_ = kept(best.filter(~done).select(*key, (F.col("cell") * 4).alias("cell"), "whole"), "crowded")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
