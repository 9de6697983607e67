"""Best-fit packing: bin completion by branch and bound over the histogram of piece lengths.

A document is its tokens and an end id. Only longer ones than a sequence are cut, into full pieces; what is
left over is their first piece. Pieces of one length are interchangeable, so the packing problem is fully
described by how many pieces there are of each length: at most `capacity` numbers, whatever the size of
the corpus. The search runs on these; its answer, a list of fillings with how often each is used, is
dealt back to the pieces by their rank within their length, which needs one small join and no sort.

The search keeps the best-fit-decreasing packing as incumbent. It takes the largest piece left, lists
the undominated fillings around it in order of waste, uses one as often as counts allow, and goes deeper; a branch is
dropped when the waste it has shows that it can't beat the incumbent. It ends when a bound is met or after
`nodes` nodes, with the best packing seen. By default it looks at TRIES fillings a node, follows the WIDTH best, and uses each as often as it
can, which settles a corpus of any size in seconds; with exact=True it does none of this and has no limit of nodes, so that its
answer is an optimum, in a time that can grow exponentially: a choice for small histograms.

Edge cases: a null or empty text is one piece that holds the end id only; null and repeated doc_ids are
ordinary rows, each packed once; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import stored

CAPACITY, END_ID, NODES, WIDTH, TRIES = 1024, 2, 2_000, 6, 400

# --- tokens -----------------------------------------------------------------------------------------------

#: In the byte-level BPE no token spans a place where a space or line feed follows another character, so a regular
#: text is the chunks " word" and "\\nword", each encoded once for a worker. Other texts are encoded whole.
IRREGULAR = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Beyond these letters, the faster of the two libraries is not relied on.
OTHER_LETTERS = re.compile("[^\x00-\u024f]")
KEPT_CHUNKS = 250_000
_encoders: dict[tuple, "_Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def regular(text: str) -> bool:
    return not (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "<|" in text
        or "\t" in text or "\r" in text or "\v" in text or "\f" in text or IRREGULAR.search(text)
    )


class _Encoder(dict):
    """Chunk -> number; the ids of all chunks lie one after another in a pool."""

    def __init__(self, path: str, ranks: str | None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast, self.bytes_of = None, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
            for token, number in table.items():
                self.bytes_of[number] = len(token)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.n = np.zeros(1 << 14, np.int64), 0

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.fresh.append(chunk if chunk[:1] == "\n" else " " + chunk)
        return number

    def _learn(self) -> None:
        """Encode the new chunks and append their ids to the pool."""
        if not self.fresh:
            return
        joined = "".join(self.fresh)
        if self.fast is not None and not OTHER_LETTERS.search(joined):
            ids = np.array(self.fast.encode_ordinary(joined), "<u4")
            ends = np.cumsum(np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in self.fresh), np.int64, len(self.fresh)))
            stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        else:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(self.fresh, add_special_tokens=False)]
            ids = np.array([i for x in each for i in x], "<u4")
            stops = np.cumsum([len(x) for x in each])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        while self.n + len(stops) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.start[self.n + 1 : self.n + 1 + len(stops)] = self.used + stops
        self.used, self.n = self.used + len(ids), self.n + len(stops)
        self.fresh = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > KEPT_CHUNKS:
            self.reset()
        out: list = []
        for text in texts:
            if not text:
                out.append(np.zeros(0, "<u4"))
            elif regular(text):
                chunks = ("\n" + text.replace("\n", " \n")).split(" ")
                out.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
            else:
                out.append(None)
        self._learn()
        for i, (text, chunks) in enumerate(zip(texts, out)):
            if chunks is None:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            elif len(chunks):
                first, lengths = self.start[chunks], self.start[chunks + 1] - self.start[chunks]
                at = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                out[i] = self.pool[at[1:]]  # without the line feed that was put in front
        return out


def encode(texts: list[str], path: str | None = None) -> list[np.ndarray]:
    """The ids of each text, without special tokens."""
    key = (path or default_tokenizer(), None if path else default_ranks())
    if key not in _encoders:
        _encoders[key] = _Encoder(*key)
    return _encoders[key].encode(texts)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(capacity: int, end_id: int, path: str | None, run_chars: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        tail = np.array([end_id], "<u4")
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < run_chars:
                    chars += len(texts[end] or "")
                    end += 1
                rows: list[tuple] = []
                for i, ids_of in enumerate(encode([x or "" for x in texts[at:end]], path), at):
                    data = np.concatenate([ids_of, tail])
                    for piece, (start, length) in enumerate(cut(len(data), capacity)):
                        rows.append((i, piece, start, length, zlib.crc32(data[start : start + length]), seen[length]))
                        seen[length] += 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:]), pa.array([task] * len(rows), pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
                )
                at = end

    return run


# --- the search -------------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing, worked out for all equal pieces and equal bins at once."""
    groups: dict[int, list] = {}  # room left -> [filling, bins]
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, filling: tuple[int, ...], bins: int) -> None:
        if bins:
            if room:
                groups.setdefault(room, []).append((filling, bins))
            else:
                done.append((filling, bins))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in groups if r >= size), default=None)
            if room is None:
                filling, bins, room = (), -(-left // (capacity // size)), capacity
            else:
                filling, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            each = room // size
            full = min(bins, left // each)
            put(room - each * size, filling + (size,) * each, full)
            left -= full * each
            bins -= full
            if left and bins:
                put(room - left * size, filling + (size,) * left, 1)
                left, bins = 0, bins - 1
            if filling or bins and room < capacity:
                put(room, filling, bins)
    return done + [g for same in groups.values() for g in same]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: pieces over half a bin sit apart; the rest must fit beside them."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in range(0, capacity // 2 + 1):
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        room = sum(n for _, n in half) * capacity - sum(s * n for s, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces can be put into places as large as a's pieces."""

    def place(rest: tuple[int, ...], rooms: list[int]) -> bool:
        if not rest:
            return True
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            if place(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]]):
                return True
        return False

    return a != b and sum(b) <= sum(a) and len(a) <= len(b) and place(b, list(a))


def fillings(counts: dict[int, int], room: int, width: int | None = WIDTH, tries: int | None = TRIES) -> list[tuple[int, ...]]:
    """Undominated fillings of the room, those with the least waste first; up to `tries` are looked at and `width` given (None: all)."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []
    smallest = sizes[-1] if sizes else 0
    looked = 0

    def go(i: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal looked
        if tries is not None and looked >= tries:
            return
        if not left or left < smallest:
            looked += 1
            found.append((left, chosen))
            return
        fits = False
        for j in range(i, len(sizes)):
            s = sizes[j]
            if s <= left and (chosen.count(s) if chosen and chosen[-1] == s else 0) < counts[s]:
                fits = True
                go(j, left - s, (*chosen, s))
                if tries is not None and looked >= tries:
                    return
        if not fits:
            looked += 1
            found.append((left, chosen))

    # two pieces that fill the room exactly, found by looking rather than by luck of the order
    for s in sizes:
        o = room - s
        if o <= s and (o == 0 or counts.get(o, 0) > (o == s)):
            found.append((0, (s, o) if o else (s,)))
    go(0, room, ())
    best = sorted(set(found), key=lambda x: (x[0], len(x[1]), [-s for s in x[1]]))[: 4 * width if width is not None else None]
    kept: list[tuple[int, ...]] = []
    for _, b in best:
        if (width is None or len(kept) < width) and not any(dominated(a, b) for a in kept):
            kept.append(b)
    return kept or [()]


def search(counts: dict[int, int], capacity: int, nodes: int = NODES, exact: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times) of the best packing found; exact: of a packing with the fewest bins."""
    limits = (None, None) if exact else (WIDTH, TRIES)
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    bound = least_bins(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    spent = 0
    stack: list[tuple[dict[int, int], list, int, int]] = [(counts, [], 0, 0)]
    while stack and bins > bound and (exact or spent < nodes):
        left, used, n_used, waste = stack.pop()
        spent += 1
        if not left:
            if n_used < bins:
                best, bins = used, n_used
            continue
        if waste > (bins - 1) * capacity - total:
            continue
        tail = best_fit(left, capacity)
        if (n := n_used + sum(k for _, k in tail)) < bins:
            best, bins = used + tail, n
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        for f in reversed(fillings(rest, capacity - largest, *limits)):
            need = Counter((largest, *f))
            times = 1 if exact else min(left[s] // k for s, k in need.items())
            child = {s: n for s, n in ((s, n - times * need.get(s, 0)) for s, n in left.items()) if n}
            wasted = waste + times * (capacity - largest - sum(f))
            if wasted <= (bins - 1) * capacity - total:
                stack.append((child, [*used, ((largest, *f), times)], n_used + times, wasted))
    return best


def schedule(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For every length and run of ranks: key (length and first rank), pieces a sequence, first sequence, first offset."""
    rows, given, sequence = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for size, each in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, given[size], each, sequence, offset))
            given[size] += times * each
            offset += size * each
        sequence += times
    rows.sort()
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
    return (columns[0] << 40) | columns[1], columns[1], *columns[2:]


def _dealt(table: tuple[np.ndarray, ...]):
    key, first, each, sequence, offset = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[n].to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(key, (length << 40) | rank, side="right") - 1
            place = rank - first[at]
            extra = [sequence[at] + place // each[at], offset[at] + place % each[at] * length]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")), *map(pa.array, extra)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, nodes: int = NODES, exact: bool = False) -> DataFrame:
    """One row for each piece, with its sequence and its place there."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    cols = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(documents.select("doc_id", "text").mapInArrow(_pieces(capacity, end_id, tokenizer), f"{cols}, rank long, task long"), "pieces")
    by_task = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = schedule(search(counts, capacity, nodes, exact))
    ranked = pieces.join(offsets.hint("merge"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_dealt(table), f"{cols}, sequence_id long, offset long")
