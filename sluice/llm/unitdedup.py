"""Substring deduplication by hashing the lines and sentences of every text.

By default a unit is a sentence within a line, since passages repeat inside lines as well: words up to one that ends in a full
stop, question or exclamation mark, or up to the line's end; one of over LONG words is cut further after words whose
hash says so, which are the same words wherever the passage stands. With `by` units are whole lines or paragraphs. Units are normalised
(lower case, white space between words does not count) and hashed to 128 bits. Over the whole corpus, all but the earliest occurrence of
a digest (by doc_id, then by place) are repeats. Runs of neighbouring repeats with at least `min_run` words are removed; by default
these are passages of MIN_RUN words, while shorter ones are ordinary language and stay, unless words of at least UNIT_CHARS
characters make up RUN_CHARS of them (text without spaces). Units under both `min_unit` words and UNIT_CHARS characters are not
compared and go with the repeats around them. With min_unit and min_run of 1, every repeat but the first goes.

Units alone lose the words at both ends of a passage that begins or ends inside one. With `windows`, passages of min_run + STEP - 1 words and
more that stand in another document too are found wherever they begin: of all stretches of min_run - STEP words, the least hash of each
2 * STEP neighbours is a mark (winnowing), so that equal passages have a mark in common. At marks that occur again, the windows of min_run words
that begin there and STEP words before are compared by 64-bit hashes, and of equal ones all but those in the earliest document are
repeats, as are the units beside them. Of such a passage up to STEP - 1 words may stay at each end.

Edge cases: a null text has no units and stays null; an empty text stays empty; repeated doc_ids with different texts
are ranked by a hash of their text; of wholly equal rows one is the first, and the units of all others are repeats; null doc_ids
rank first; an empty table gives an empty result; other columns pass through `dedup` as they came, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm import words as W
from sluice.llm.common import free_name, identity, stored

MIN_UNIT, MIN_RUN, LONG = 3, 40, 24
#: How far apart the two windows of a mark begin.
STEP = 11
#: What a unit is: a sentence within a line, a line, or the lines up to an empty one.
KINDS = ("sentence", "line", "paragraph")
#: A unit of fewer words counts if it has so many characters, and so does a run: text without spaces is one word, whatever its length.
UNIT_CHARS, RUN_CHARS = 24, 64
#: The inverse of W.MIX modulo 2**64, and the bits for a mark's place while the least are looked for.
INVERSE, PLACES = pow(W.MIX, -1, 1 << 64), (1 << 24) - 1
STOPS = np.array([ord(c) for c in ".!?"], np.uint32)


def units(cp: np.ndarray, by: str = "sentence") -> tuple[np.ndarray, ...]:
    """Starts and ends of the words; first word of each unit, and the end (exclusive)."""
    starts, ends = W.spans(cp)
    if not len(starts):
        return starts, ends, starts, ends
    lines = np.cumsum(np.concatenate([[0], cp == 10]))
    last = np.isin(cp[ends - 1], STOPS) if by == "sentence" else np.zeros(len(ends), bool)
    last[:-1] |= lines[starts[1:]] - lines[ends[:-1]] > (by == "paragraph")
    last[-1] = True
    stop = np.flatnonzero(last) + 1
    if by != "sentence":
        return starts, ends, np.concatenate([[0], stop[:-1]]), stop
    lengths = np.diff(stop, prepend=0)
    if lengths.max() > LONG:
        low = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint32)
        last |= (np.repeat(lengths, lengths) > LONG) & (W.mix(W.hashes(low, starts, ends)) % np.uint64(8) == 0)
        stop = np.flatnonzero(last) + 1
    return starts, ends, np.concatenate([[0], stop[:-1]]), stop


def counted(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, stop: np.ndarray, min_unit: int = MIN_UNIT) -> np.ndarray:
    """Which units are compared: those with enough words or characters."""
    return (stop - first >= min_unit) | (ends[stop - 1] - starts[first] >= UNIT_CHARS)


def hashed(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's hash, in lower case."""
    low = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint32)
    return W.mix(W.hashes(low, starts, ends))


def digests(word: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return W.hashes(word, first, stop).view(np.int64), W.hashes(W.mix(word ^ np.uint64(0x5851F42D4C957F2D)), first, stop, 0x2545F4914F6CDD1D).view(np.int64)


def marks(word: np.ndarray, min_run: int = MIN_RUN) -> tuple[np.ndarray, ...]:
    """Places of the marks, how many next to each other are alike, their hashes, and those of the windows there and STEP words before (0: none)."""
    size, n = min_run - STEP, len(word)
    if n < min_run:
        return (np.zeros(0, np.int64),) * 5
    # sums of word * MIX**-i: a stretch's hash is a difference, brought to one power
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * W.powers(INVERSE, n))])

    def at(places: np.ndarray, length: int) -> np.ndarray:
        return W.mix((sums[places + length] - sums[places]) * W.powers(W.MIX, n)[places])

    every = np.arange(n - size + 1)
    # the place in the low bits makes the last one of equal hashes the least
    low, width = at(every, size) & ~np.uint64(PLACES) | (PLACES - every % PLACES).astype(np.uint64), min(2 * STEP, len(every))
    done = 1
    while done < width:
        step = min(done, width - done)
        low, done = np.minimum(low[:-step], low[step:]), done + step
    chosen = np.zeros(len(every), bool)
    chosen[np.arange(len(low)) + (PLACES - (low & np.uint64(PLACES)).astype(np.int64) - np.arange(len(low))) % PLACES] = True
    place = np.flatnonzero(chosen)
    h, here, before = at(place, size), np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    fits, back = place + min_run <= n, place >= STEP
    here[fits], before[back] = at(place[fits], min_run), at(place[back] - STEP, min_run)
    same = (np.diff(place) == 1) & (np.diff(h) == 0) & (np.diff(here) == 0) & (np.diff(before) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return place[first], np.diff(np.append(first, len(place))), *(x[first].view(np.int64) for x in (h, here, before))


def _units(by: str, min_unit: int, windows: int | None = None):
    """Rows of units (alike: 0), and with `windows` of marks, whose windows have that many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def out() -> pa.RecordBatch:
                lengths = [len(r[1]) for r in rows]
                at = pa.array(np.repeat([r[0] for r in rows], lengths))
                columns = [pa.array(np.concatenate([r[k] for r in rows]), pa.int64()) for k in (1, 2, 3, 4, 5)]
                return pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["uid"].take(at), *columns], names=["doc_id", "uid", "unit", "h1", "h2", "h3", "alike"])

            for i, text in enumerate(batch["text"]):
                cp = W.codepoints(text.as_py() or "")
                starts, ends, first, stop = units(cp, by)
                at = np.flatnonzero(counted(starts, ends, first, stop, min_unit)) if len(first) else first
                word = hashed(cp, starts, ends)
                if len(at):
                    h1, h2 = digests(word, first, stop)
                    rows.append((i, at, h1[at], h2[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)))
                    held += len(at)
                # also of texts whose words are each a unit, of which none is compared
                if windows and len(starts) >= windows:
                    place, alike, h, here, before = marks(word, windows)
                    rows.append((i, place, h, here, before, alike))
                    held += len(place)
                if held > 100_000:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return run


def _unspaced(starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bool:
    """Whether a run of few words is long for its words that are themselves as long as a unit."""
    lengths = ends[a:b] - starts[a:b]
    return bool(lengths[lengths >= UNIT_CHARS].sum() >= RUN_CHARS)


def removed_spans(text: str, repeats: list[int] | None, by: str = "sentence", min_unit: int = MIN_UNIT, min_run: int = MIN_RUN, windows: Sequence = ()) -> list[tuple[int, int]]:
    """Code point spans to remove, given the numbers of the units that are repeats (None: all are) and windows of words that are, too."""
    cp = W.codepoints(text)
    starts, ends, first, stop = units(cp, by)
    if not len(first) or repeats is not None and not len(repeats) and not len(windows):
        return []
    short = ~counted(starts, ends, first, stop, min_unit)
    hit = ~short if repeats is None else np.isin(np.arange(len(first)), repeats)
    index = np.arange(len(first))
    before = np.maximum.accumulate(np.where(short, -1, index))
    after = np.minimum.accumulate(np.where(short, len(first), index)[::-1])[::-1]
    inner = short & (before >= 0) & (after < len(first))
    hit[inner] = hit[before[inner]] & hit[after[inner]]
    gone = np.repeat(hit.astype(np.int8), stop - first)
    for a, b in windows:
        gone[a:b] = 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
    out = []
    for a, b in zip(edges[0::2], edges[1::2]):
        if b - a < min_run and not _unspaced(starts, ends, int(a), int(b)):
            continue
        end = ends[b - 1]
        while end < len(cp) and cp[end] != 10 and (cp[end] == 32 or 9 <= cp[end] <= 13):
            end += 1
        out.append((int(starts[a]), int(end)))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def repeats(documents: DataFrame, *, by: str = "sentence", min_unit: int = MIN_UNIT, windows: int | None = None) -> DataFrame:
    """uid with the numbers of its units that are not the earliest of their digest, and its windows that an earlier document has."""
    if by not in KINDS:
        raise ValueError(f"units are one of {KINDS}")
    if windows is not None and windows < 2 * STEP:
        raise ValueError(f"windows need a least run of {2 * STEP} words")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    uid = identity(F.col("doc_id"), F.col("text"))
    every = documents.select("doc_id", uid.alias("uid"), "text").mapInArrow(_units(by, min_unit, windows), f"doc_id {id_type}, uid long, unit long, h1 long, h2 long, h3 long, alike long")
    every = stored(every, "units")
    rows = every.filter("alike = 0").select("doc_id", "uid", "unit", "h1", "h2")
    firsts = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "uid", "unit")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("h1", "h2", F.col("first.uid").alias("first_uid"), F.col("first.unit").alias("first_unit"))
    later = rows.join(firsts.hint("merge"), ["h1", "h2"]).filter("uid <> first_uid or unit <> first_unit").select("uid", "unit", F.lit(None).cast("struct<a: long, b: long>").alias("window"))
    if windows:
        later = later.union(_windows(every, windows).select("uid", F.lit(None).cast("long").alias("unit"), "window"))
    return stored(later.groupBy("uid").agg(F.array_sort(F.collect_set("unit")).alias("repeats"), F.collect_set("window").alias("windows")), "repeats")


def _windows(every: DataFrame, size: int) -> DataFrame:
    """uid and window (a, b: words) of all windows at marks that occur again, but those in the earliest document that has them."""
    found = every.filter("alike > 0").select("doc_id", "uid", F.col("unit").alias("place"), F.col("h1").alias("mark"), "h2", "h3", "alike")
    again = found.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    both = F.array(F.struct(F.col("place").alias("a"), F.col("h2").alias("h")), F.struct((F.col("place") - STEP).alias("a"), F.col("h3").alias("h")))
    held = found.join(again.hint("merge"), "mark").select("doc_id", "uid", "alike", F.inline(both)).filter("h <> 0")
    held = stored(held, "windows")
    firsts = held.groupBy("h").agg(F.min(F.struct("doc_id", "uid")).alias("first")).select("h", F.col("first.uid").alias("first_uid"))
    return held.join(firsts.hint("merge"), "h").filter("uid <> first_uid").select("uid", F.struct("a", (F.col("a") + size - 1 + F.col("alike")).alias("b")).alias("window"))


def _with_repeats(documents: DataFrame, columns: list[str], by: str, min_unit: int, windows: int | None) -> tuple[DataFrame, str, str, str]:
    """The columns, with repeated units, repeated windows and whether the row wholly repeats another one, and these three's names."""
    uid, found, held, again = (free_name(documents, x) for x in ("__uid", "__repeats", "__windows", "__again"))
    marked = repeats(documents, by=by, min_unit=min_unit, windows=windows).select(F.col("uid").alias(uid), F.col("repeats").alias(found), F.col("windows").alias(held))
    rows = documents.select(*columns, identity(F.col("doc_id"), F.col("text")).alias(uid)).join(marked.hint("merge"), uid, "left")
    # the join has sorted the rows by uid already
    copy = F.row_number().over(Window.partitionBy(uid).orderBy(uid))
    return rows.withColumn(again, copy > 1).drop(uid), found, held, again


def _reported(by: str, min_unit: int, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found, held, again in zip(*(batch[x].to_pylist() for x in ("text", "found", "held", "again"))):
                spans = removed_spans(text or "", None if again else found or [], by, min_unit, min_run, [(w["a"], w["b"]) for w in held or []])
                kept = without(text or "", spans)
                rows.append((len(spans), sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_spans", "n_removed_chars", "removed_spans", "kept_sha256"])

    return run


def report(documents: DataFrame, *, by: str = "sentence", min_unit: int = MIN_UNIT, min_run: int = MIN_RUN, windows: bool = False) -> DataFrame:
    """Every document's removed spans (code points of the original) and the digest of what is left."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows, found, held, again = _with_repeats(documents, ["doc_id", "text"], by, min_unit, min_run if windows else None)
    rows = rows.select("doc_id", "text", F.col(found).alias("found"), F.col(held).alias("held"), F.col(again).alias("again"))
    return rows.mapInArrow(_reported(by, min_unit, min_run), f"doc_id {id_type}, n_spans long, n_removed_chars long, removed_spans string, kept_sha256 string")


def dedup(documents: DataFrame, *, by: str = "sentence", min_unit: int = MIN_UNIT, min_run: int = MIN_RUN, windows: bool = False) -> DataFrame:
    """The documents with their text deduplicated and the removed spans in a column of their own, `removed_spans` or a like name."""

    @F.pandas_udf("kept string, removed array<struct<start:int,end:int>>")
    def cleaned(texts: pd.Series, found: pd.Series, held: pd.Series, again: pd.Series) -> pd.DataFrame:
        out = []
        for text, numbers, more, whole in zip(texts, found, held, again):
            spans = removed_spans(text or "", None if whole else [] if numbers is None else list(numbers), by, min_unit, min_run, [] if more is None else [(w["a"], w["b"]) for w in more])
            out.append((None if text is None else without(text, spans), [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["kept", "removed"])

    rows, found, held, again = _with_repeats(documents, documents.columns, by, min_unit, min_run if windows else None)
    clean, removed = free_name(documents, "__clean"), free_name(documents, "removed_spans")
    out = rows.withColumn(clean, cleaned("text", found, held, again)).withColumns({"text": F.col(f"{clean}.kept"), removed: F.col(f"{clean}.removed")})
    return out.select(*documents.columns, removed)
