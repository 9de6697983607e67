"""Temporal deduplication as a fold that can be split: one key may hold any part of the rows.

A deposit passes if its key was never seen, or if its last passed deposit is at least a window ago; so the state of a key is one clock, and a
stretch of its deposits is a function from the clock at its start to the clock at its end. Deposits are dealt by ranges of (key, time), so each
task holds a segment. A task works out, for its runs at the borders, the end clock that follows from starting at each of their rows. Clocks are joined
across segments by pointer jumping: a possible end clock points to the end clock of the segment in which the next deposit passes.
What is reached from a key's first row gives every segment its start clock (one number a segment at the driver), and the segments
that needed one are replayed side by side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.sources.scratch import kept

#: Where a run of one key lies in its segment: inside, at its start, at its end, or all of it.
INSIDE, FIRST, LAST, WHOLE = range(4)


def _passed(t: list[int], width: int, at: int, end: int) -> list[int]:
    """The rows that pass from row `at` on, which passes."""
    out = []
    while at < end:
        out.append(at)
        at = bisect_left(t, t[at] + width, at + 1, end)
    return out


def _end_clocks(t: np.ndarray, width: int) -> np.ndarray:
    """For each row of a run the clock at the run's end if that row passes."""
    n = len(t)
    root = np.maximum(np.searchsorted(t, t + width, side="left"), np.arange(n) + 1)
    root = np.where(root < n, root, np.arange(n))
    while not np.array_equal(root, higher := root[root]):
        root = higher
    return t[root]


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    a, b = column.slice(1).combine_chunks(), column.slice(0, len(column) - 1).combine_chunks()
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _segment(n_key: int):
    """A task's rows, sorted: whether each passes if its run starts here, and for runs at the borders the end clocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        table = pa.Table.from_batches(rows)
        n, t, widths = table.num_rows, table["t"].to_numpy(), table["width"].to_numpy()
        change = np.zeros(n - 1, bool)
        for i in range(n_key):
            change |= _changes(table.column(i))
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        ends = np.append(starts[1:], n)
        taken, place, clocks = np.zeros(n, bool), np.full(n, INSIDE, np.int32), np.zeros(n, np.int64)
        times = t.tolist()
        for s, e in zip(starts.tolist(), ends.tolist()):
            taken[_passed(times, int(widths[s]), s, e)] = True
            if s == 0 or e == n:
                place[s:e] = WHOLE if e - s == n else FIRST if s == 0 else LAST
                clocks[s:e] = _end_clocks(t[s:e], int(widths[s]))
        task = np.full(n, TaskContext.get().partitionId(), np.int64)
        extra = {"segment": task, "place": place, "taken": taken, "clock": clocks}
        for name, values in extra.items():
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(max_chunksize=10_000)

    return run


@dataclass
class Run:
    """A run at a border: its first and last time, and the end clock if its first row passes."""

    segment: int
    place: int
    key: Row
    first: int
    last: int
    clock: int
    width: int


def chains(runs: list[Run]) -> list[list[Run]]:
    """Runs of one key that go on from segment to segment, at least two."""
    found: list[list[Run]] = []
    open_: list[Run] = []
    for run in sorted(runs, key=lambda r: (r.segment, r.place)):
        if run.place == LAST or not open_ or open_[-1].key != run.key:
            found.append(open_ := [run])
        else:
            open_.append(run)
    return [c for c in found if len(c) > 1]


def walked(chain: list[Run]) -> list[int | None]:
    """The clock at the start of each run as far as first and last times tell it: None where it depends on a run's inside."""
    out: list[int | None] = [None]
    clock: int | None = chain[0].clock
    for run in chain[1:]:
        out.append(clock)
        if clock is not None and clock + run.width <= run.last:
            clock = run.clock if clock + run.width <= run.first else None
    return out


def _targets(of: dict[int, list[Run]]):
    """For end clocks (chain, segment, clock): the segment in which the next deposit passes, from which time on, and the end clock if that is its first row."""
    arrays = {c: tuple(np.array([getattr(r, f) for r in runs], np.int64) for f in ("segment", "first", "last", "clock")) for c, runs in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain, segment, clock = (batch[n].to_numpy() for n in ("chain", "segment", "clock"))
            to, after, known, ok = (np.zeros(len(chain), np.int64) for _ in range(4))
            for c in np.unique(chain):
                segments, first, last, clocks = arrays[int(c)]
                on = np.flatnonzero(chain == c)
                q = clock[on] + of[int(c)][0].width
                at = np.maximum(np.searchsorted(segments, segment[on]) + 1, np.searchsorted(last, q, side="left"))
                ok[on] = at < len(segments)
                at = np.minimum(at, len(segments) - 1)
                to[on], after[on], known[on] = segments[at], q, np.where(q <= first[at], clocks[at], np.iinfo(np.int64).min)
            keep = np.flatnonzero(ok)
            names = ["chain", "segment", "clock", "to_segment", "after", "to_clock"]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (chain, segment, clock, to, after)] + [pa.array(known[keep], mask=known[keep] == np.iinfo(np.int64).min)], names=names)

    return run


def _reached(rows: DataFrame, deep: dict[int, list[Run]]) -> dict[int, dict[int, int]]:
    """For each chain the end clocks (by segment) that its first row leads to, by pointer jumping."""
    spark = rows.sparkSession
    members = spark.createDataFrame([(c, r.segment, r.place) for c, runs in deep.items() for r in runs], "chain long, segment long, place int")
    inside = rows.join(F.broadcast(members), ["segment", "place"]).select("chain", "segment", "t", "clock").distinct()
    nodes = inside.select("chain", "segment", "clock").distinct().mapInArrow(_targets(deep), "chain long, segment long, clock long, to_segment long, after long, to_clock long")
    nodes = kept(nodes, "clocks")
    # the others look for the first row from that time on: rows and questions of a segment in falling order, the last row seen answers
    asked = nodes.filter("to_clock IS NULL").select("chain", F.col("to_segment").alias("at"), F.col("after").alias("t"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("answer"), "segment", "clock")
    told = inside.select("chain", F.col("segment").alias("at"), "t", F.lit(0).alias("asks"), F.col("clock").alias("answer"), F.lit(None).cast("long").alias("segment"), F.lit(None).cast("long").alias("clock"))
    falling = Window.partitionBy("chain", "at").orderBy(F.desc("t"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    answered = asked.unionByName(told).withColumn("to_clock", F.last("answer", ignorenulls=True).over(falling)).filter("asks = 1")
    point = kept(nodes.filter("to_clock IS NOT NULL").select("chain", "segment", "clock", "to_segment", "to_clock").unionByName(answered.select("chain", "segment", "clock", F.col("at").alias("to_segment"), "to_clock")), "pointers")
    found = {c: {runs[0].segment: runs[0].clock} for c, runs in deep.items()}
    while True:
        start = spark.createDataFrame([(c, s, x) for c, clocks in found.items() for s, x in clocks.items()], "chain long, segment long, clock long")  # one a segment at most
        new = [r for r in point.join(F.broadcast(start), ["chain", "segment", "clock"]).collect() if r.to_segment not in found[r.chain]]
        if not new:
            return found
        for r in new:
            found[r.chain][r.to_segment] = r.to_clock
        further = point.select("chain", F.col("segment").alias("to_segment"), F.col("clock").alias("to_clock"), F.col("to_segment").alias("then"), F.col("to_clock").alias("then_clock"))
        twice = point.join(further.hint("merge"), ["chain", "to_segment", "to_clock"])
        point = kept(twice.select("chain", "segment", "clock", F.col("then").alias("to_segment"), F.col("then_clock").alias("to_clock")), "pointers")


def _replayed(names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), (names[-1], "ascending")])
        times, width, start = table["t"].to_pylist(), table["width"][0].as_py(), table["start"][0].as_py()
        rows = _passed(times, width, bisect_left(times, start + width), len(times))
        return table.select(names).take(pa.array(rows, pa.int64()))

    return run


def accepted(deposits: DataFrame, window_seconds: Column | int = 3_600, key: tuple[str, ...] = ("config_id", "source_key"), at: str = "seen_at", tie: str = "event_id") -> DataFrame:
    """Deposits that pass the temporal rule: never seen, or last accepted at least a window ago. A skipped one does not refresh the clock.

    The window may differ from key to key. Deposits of one time go by `tie`; those without a time take no part. A task holds its segment of the rows, whose size is that of a shuffle partition.
    """
    width = window_seconds if isinstance(window_seconds, Column) else F.lit(window_seconds)
    rows = deposits.select(*key, F.col(tie).cast("bigint").alias(tie), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), (width.cast("long") * 1_000_000).alias("width")).filter("t IS NOT NULL")
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*key, tie)]
    order = [*key, "t", tie]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = kept(dealt.mapInArrow(_segment(len(key)), ", ".join([*fields, "t long, width long, segment long, place int, taken boolean, clock long"])), "segments")
    border = found.filter(F.col("place") != INSIDE).groupBy("segment", "place").agg(
        F.any_value(F.struct(*key)).alias("key"), F.min("t").alias("first"), F.max("t").alias("last"), F.min_by("clock", F.struct("t", tie)).alias("clock"), F.any_value("width").alias("width")
    )
    linked = chains([Run(**r.asDict()) for r in border.collect()])  # two runs a segment at most
    starts = [walked(c) for c in linked]
    deep = {i: c for i, (c, s) in enumerate(zip(linked, starts)) if None in s[1:]}
    reached = _reached(found, deep) if deep else {}
    clocks = []
    for i, (chain, start) in enumerate(zip(linked, starts)):
        clock = chain[0].clock
        for run, told in zip(chain[1:], start[1:]):
            clocks.append((run.segment, run.place, clock if i in reached else told))
            clock = reached.get(i, {}).get(run.segment, clock)
    if not clocks:
        return found.filter("taken").select(*key, tie)
    begun = found.join(F.broadcast(found.sparkSession.createDataFrame(clocks, "segment long, place int, start long")), ["segment", "place"], "left")
    replayed = begun.filter("start IS NOT NULL").groupBy("segment").applyInArrow(_replayed([*key, tie]), ", ".join(fields))
    return begun.filter("start IS NULL AND taken").select(*key, tie).unionByName(replayed)
