"""Language-model scoring by Katz backoff: word pairs with Good-Turing discounts, exactly normalised.

    P(w | v) = d(c(v w)) c(v w) / c(v)                    if v w was seen in training
             = alpha(v) P(w)                               if not
    P(w)     = d(c(w)) c(w) / N, and the rest for any unknown word

Counts up to KMAX are discounted by Katz's form of Good-Turing, on the counts of counts or, where copies make these
uneven, on their log-log line. Should neither be valid (very small corpora), and in contexts in which all counts are
larger, 1/2 is taken off each count instead. alpha(v) makes
every context's probabilities add up to 1 over the training words and the unknown one.

How it runs: word counts make one table. The HEAD most frequent words' counts (a bound, not a limit on what is scored) go
to all tasks; all other words' counts are found where their pairs meet. Documents are taken in blocks of about RUN tokens,
stored as numbers. Each block asks for its distinct pairs: all pairs with one first word meet in a partition,
which adds up their counts and what the first word's backoff weight is made of, and answers each block that asked. Very frequent first
words (over 1 / HOT of all tokens) are dealt by pair, and only their sums are put together. Answers are stored by partition; once the
counts of counts are known, each block is joined with its answers and every token is evaluated: its pair's discounted
count, or else the backoff weight times its word's. What is sent grows with distinct pairs of blocks, both ways, and not with documents
times partitions. Words are 64-bit hashes of their lower-cased code points.

Edge cases: a null or empty text is the end token only; a null doc_id is split as the empty text; repeated rows
count as often as they occur, and each gets its own score; without training rows every word is unknown and
probabilities are those of one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.common import partitions, stored
from sluice.llm.ngramjoin import runs

KMAX, HEAD, HOT, RUN = 5, 1 << 20, 2_048, 300_000
END = np.uint64(0x454E44)
#: Words are numbered in blocks: those of the head by their place in it, others by their hash with the top bit set.
TOP = np.uint64(1 << 63)
START = TOP | np.uint64(0x5354415254)


def tokens(text: str) -> np.ndarray:
    """Hashes of the words, then the end."""
    cp = W.codepoints(text, lower=True)
    return np.concatenate([W.mix(W.hashes(cp, *W.spans(cp))), [END]])


class Discount:
    """Discounted counts, from how many types occur 1, 2, ... KMAX + 1 times."""

    def __init__(self, of: list[int]):
        self.d = None
        r = np.arange(1, KMAX + 2)
        n = np.array(of, np.float64)
        if (n > 0).sum() < 2:
            return
        slope, level = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)
        for counts in (n, np.exp(level) * r**slope):
            if (counts > 0).all():
                a = (KMAX + 1) * counts[KMAX] / counts[0]
                d = ((r[:-1] + 1) * counts[1:] / (r[:-1] * counts[:-1]) - a) / (1 - a) if a != 1 else np.zeros(KMAX)
                if ((d > 0) & (d < 1)).all():
                    self.d = np.concatenate([[1.0], d])
                    return

    def __call__(self, c: np.ndarray, halves: np.ndarray | bool = False) -> np.ndarray:
        """Discounted counts; halves: where 1/2 is taken off instead. 0 stays 0."""
        c = np.asarray(c, np.float64)
        less = np.where(c > 0, c - 0.5, 0.0)
        if self.d is None:
            return less
        kept = np.where(c <= KMAX, c * self.d[np.minimum(c, KMAX).astype(np.int64)], c)
        return np.where(halves, less, kept)


class Unigram:
    """P(w) as a function of the word's count (0: unknown)."""

    def __init__(self, n: int, v: int, of: list[int]):
        self.n, self.v = n, v
        self.discount = Discount(of)
        if self.discount.d is None:
            taken = 0.5 * v
        else:
            taken = sum(k * r * (1 - self.discount.d[r]) for r, k in enumerate(of[:KMAX], 1))
        self.unknown = taken / n if n else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(np.asarray(c) > 0, self.discount(c) / max(1, self.n), self.unknown)


# --- arrays as bytes --------------------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def packed(*arrays: np.ndarray) -> bytes:
    """Several arrays of numbers, compressed; bytes of equal weight lie together, since high ones are mostly 0."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], np.int64)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays if len(a)]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:], 8 * (1 + 2 * n), []
    for kind, size in zip(head[0::2], head[1::2]):
        dtype = np.dtype(chr(int(kind)))
        planes = np.frombuffer(raw, np.uint8, int(size), at).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += int(size)
    return out


def _coded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes as steps between the head's and the others as they are."""
    k = int(np.searchsorted(codes, TOP))
    return _narrow(np.diff(codes[:k], prepend=np.uint64(0))), codes[k:]


def _decoded(steps: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return np.concatenate([np.cumsum(steps.astype(np.uint64), dtype=np.uint64), rest])


class Head:
    """The most frequent words, known to all tasks: hashes (sorted) with places by falling count, and counts by place.

    A word's code is its place, or its hash with the top bit set. Hot first words are the first places and START.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int):
        order = np.lexsort((keys, -counts))
        self.counts = counts[order]
        by_key = np.argsort(keys)
        self.keys, self.places = keys[by_key], np.argsort(order)[by_key].astype(np.uint32)
        self.n_hot = int((self.counts * HOT >= max(1, tokens)).sum()) + 1

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes | TOP
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            out = np.where(self.keys[at] == hashes, self.places[at].astype(np.uint64), out)
        return out

    def hot_numbers(self, codes: np.ndarray) -> np.ndarray:
        """1 and up for hot first words, 0 for others."""
        return np.where(codes == START, self.n_hot, np.where(codes < np.uint64(self.n_hot - 1), codes + np.uint64(1), np.uint64(0))).astype(np.int64)

    def route(self, v: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
        at = W.mix(v)
        return (np.where(self.hot_numbers(v) > 0, W.mix(at ^ w), at) >> np.uint64(8)) % np.uint64(parts)


# --- blocks of documents ----------------------------------------------------------------------------------


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], pa.Array, np.ndarray]]:
    """Runs of documents: their tokens' hashes, their ids, and whether they are for training."""
    for batch in batches:
        held, size, at = [], 0, 0
        train = np.asarray(batch["train"].to_numpy(zero_copy_only=False)).astype(bool)
        for i, text in enumerate(batch["text"]):
            held.append(tokens(text.as_py() or ""))
            size += len(held[-1])
            if size > RUN or i == batch.num_rows - 1:
                yield held, batch["doc_id"].slice(at, i + 1 - at), train[at : i + 1]
                held, size, at = [], 0, i + 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for held, _, train in _collected(batches):
        mine = [h for h, t in zip(held, train) if t]
        if mine:
            u, c = np.unique(np.concatenate(mine), return_counts=True)
            both, inverse = np.unique(np.concatenate([keys, u]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, c]), minlength=len(both)).astype(np.int64)
            keys = both
            if len(keys) > 2_000_000:
                yield out()
                keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield out()


def _blocks(head: Head):
    """One row for each run of documents: their ids and their tokens as numbers in the block's own list of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for held, ids, train in _collected(batches):
            u, inverse = np.unique(np.concatenate(held), return_inverse=True)
            codes = head.codes(u)
            order = np.argsort(codes)
            place = np.argsort(order)
            data = packed(_narrow(np.array([len(h) for h in held])), train.astype(np.uint8), *_coded(codes[order]), _narrow(place[inverse]))
            docs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), docs, pa.array([data], pa.binary())], names=["block", "docs", "data"])
            number += 1

    return run


class Block:
    """A stored block: uw (codes of its words, then START), iv and iw (places in uw of each token and the one before), sizes, train."""

    def __init__(self, data: bytes):
        sizes, train, steps, rest, iw = unpacked(data)
        self.sizes, self.train = sizes.astype(np.int64), train.astype(bool)
        self.uw = np.concatenate([_decoded(steps, rest), [START]])
        self.n_frequent = int(np.searchsorted(self.uw[:-1], TOP))
        self.iw = iw.astype(np.uint64)
        self.iv = np.concatenate([[np.uint64(0)], self.iw[:-1]])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.iv[self.starts] = len(self.uw) - 1

    def pairs(self, rare: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (place of the first word << 32 | of the second) in order, and their training counts."""
        keys = (self.iv << np.uint64(33)) | (self.iw << np.uint64(1)) | np.repeat(self.train, self.sizes).astype(np.uint64)
        keys = np.sort(keys[(self.iw >= self.n_frequent) == rare])
        pairs = keys >> np.uint64(1)
        first = np.flatnonzero(np.diff(pairs, prepend=np.uint64((1 << 64) - 1)))
        return pairs[first], np.add.reduceat(keys & np.uint64(1), first).astype(np.int64) if len(first) else np.zeros(0, np.int64)

    def words_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.uw[pairs >> np.uint64(32)], self.uw[pairs & np.uint64(0xFFFFFFFF)]


# --- pairs on their way -----------------------------------------------------------------------------------

EMPTY = np.zeros(0, np.int64)


def _message(v: np.ndarray, w: np.ndarray, n: np.ndarray, count: np.ndarray, block: np.ndarray, at: np.ndarray) -> bytes:
    """Pairs with training counts, in order of first words; count: of rare second words; block and at: where each is asked from."""
    first = np.flatnonzero(np.diff(v, prepend=v[:1] ^ TOP))
    if len(block) == 1:
        at = np.diff(at, prepend=0)
    return packed(*_coded(v[first]), _narrow(np.diff(first, append=len(v))), _narrow(w), _narrow(n), _narrow(count), block, _narrow(at))


def _read(messages: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """First words and how many pairs each has; second words, counts, counts of rare second words, block and place of each pair."""
    for data in messages:
        steps, rest, times, w, n, count, block, at = unpacked(data.as_py())
        yield _decoded(steps, rest), times, w, n, count, block, np.cumsum(at, dtype=np.uint32) if len(block) == 1 else at.astype(np.uint32)


def _dealt(p: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(p.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
    cuts = np.flatnonzero(np.diff(p[order], prepend=p[order[:1]] + 1)) if len(p) else []
    for a, b in zip(cuts, [*cuts[1:], len(p)]):
        yield int(p[order[a]]), order[a:b]


def _rows(rows: Iterator[tuple[int, bytes]], size: int = 32) -> Iterator[pa.RecordBatch]:
    for held in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], names=["p", "data"])


def _asked(head: Head, parts: int, rare: bool):
    """Each block's distinct pairs, to where their first words are counted, or if the second is rare, to where that is."""

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for number, data in zip(batch["block"].to_pylist(), batch["data"]):
                block = Block(data.as_py())
                pairs, n = block.pairs(rare)
                v, w = block.words_of(pairs)
                p = (W.mix(w) >> np.uint64(8)) % np.uint64(parts) if rare else head.route(v, w, parts)
                for k, at in _dealt(p.astype(np.int64), parts):
                    yield k, _message(v[at], w[at], n[at], EMPTY, np.array([number]), at)

    return lambda batches: _rows(messages(batches))


def _counted_words(head: Head, parts: int):
    """Rare words meet by hash, so that their count is known; on to where the first word is counted."""

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for group in runs(batches, "p"):
            found = list(_read(group["data"]))
            v = np.concatenate([np.repeat(f[0], f[1]) for f in found])
            w, n, at = (np.concatenate([f[i] for f in found]) for i in (2, 3, 6))
            block = np.repeat([f[5][0] for f in found], [len(f[2]) for f in found])
            del found
            _, inverse = np.unique(w, return_inverse=True)
            count = np.bincount(inverse, weights=n).astype(np.int64)[inverse]
            order = np.argsort(v, kind="stable")
            v, w, n, at, block, count = v[order], w[order], n[order], at[order], block[order], count[order]
            for k, i in _dealt(head.route(v, w, parts).astype(np.int64), parts):
                # two blocks at least, so that places are not taken for steps
                blocks = block[i] if len(i) > 1 else np.repeat(block[i], 2)
                yield k, _message(v[i], w[i], n[i], count[i], blocks, at[i])

    return lambda batches: _rows(messages(batches))


STATS = [f"n{r}" for r in range(1, KMAX + 2)]
ANSWERS = f"hot int, block long, data binary, {', '.join(f'{s} long' for s in STATS)}, total long, types long, mass double"


def _answer(v: np.ndarray, seen: np.ndarray, at: np.ndarray, count: np.ndarray, facts_of: np.ndarray, mass: np.ndarray) -> bytes:
    """For pairs in the block's order: counts, and what is known of each first word: its total, and where needed the rest."""
    first = np.flatnonzero(np.diff(v, prepend=v[:1] + np.uint32(1)))
    mine = v[first]
    more = np.add.reduceat((seen == 0).astype(np.int64), first) > 0
    rest = facts_of[:, mine[more]]
    return packed(_narrow(np.diff(at, prepend=np.uint32(0))), _narrow(seen), _narrow(count), _narrow(facts_of[0, mine] * 2 + (facts_of[2:, mine].sum(0) == 0)), more.astype(np.uint8), *map(_narrow, rest[1:]), mass[mine[more]])


def _counted_pairs(head: Head, unigram: Unigram):
    """Answers for each block, and the sums that must be put together: of all pairs (hot null), of hot first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "p"):
            found = list(_read(group["data"]))
            del group
            lengths = [len(f[2]) for f in found]
            plain = np.repeat([len(f[5]) == 1 for f in found], lengths)
            uv, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            v = np.repeat(place.astype(np.uint32), np.concatenate([f[1] for f in found]))
            odd = np.concatenate([np.zeros(0, np.uint64), *(f[2] for f in found if len(f[5]) > 1)])
            odd_count = np.concatenate([EMPTY, *(f[4] for f in found if len(f[5]) > 1)])
            w = np.zeros(len(v), np.uint32)
            w[plain] = np.concatenate([np.zeros(0, np.uint32), *(f[2] for f in found if len(f[5]) == 1)])
            w[~plain] = np.unique(odd, return_inverse=True)[1] + len(head.counts)
            n = np.concatenate([f[3] for f in found])
            key = (v.astype(np.uint64) << np.uint64(32)) | w
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            pair_seen = np.add.reduceat(n[order], first, dtype=np.int64)
            seen = np.zeros(len(w), np.uint32)
            seen[order] = np.repeat(pair_seen, np.diff(first, append=len(key)))
            count = np.zeros(len(first), np.int64)  # of each pair's second word
            whose = order[first]
            rare = ~plain[whose]
            count[~rare] = head.counts[w[whose[~rare]]]
            count[rare] = odd_count[np.cumsum(~plain)[whose[rare]] - 1]
            of = (key[first] >> np.uint64(32)).astype(np.int64)
            per = lambda x: np.bincount(of, weights=x, minlength=len(uv))
            facts_of = np.stack([per(pair_seen), per(pair_seen > 0), *(per(pair_seen == r) for r in range(1, KMAX + 1))]).astype(np.int64)
            mass = per(np.where(pair_seen > 0, unigram(count), 0.0))
            del key, w, n, order, whose, count

            out = [(None, None, None, *(int((pair_seen == r).sum()) for r in range(1, KMAX + 2)), 0, 0, 0.0)]
            which = head.hot_numbers(uv)
            out += [(int(which[k]), None, None, *map(int, facts_of[2:, k]), 0, int(facts_of[0, k]), int(facts_of[1, k]), float(mass[k])) for k in np.flatnonzero(which)]
            none = (0,) * (KMAX + 1)
            ends = np.cumsum(lengths)
            for f, b in zip(found, ends):
                a = b - len(f[2])
                if len(f[5]) == 1:
                    out.append((None, int(f[5][0]), _answer(v[a:b], seen[a:b], f[6], EMPTY, facts_of, mass), *none, 0, 0, 0.0))
            if len(odd):
                v, seen = v[~plain], seen[~plain]
                block, at = (np.concatenate([f[i][: len(f[2])] for f in found if len(f[5]) > 1]) for i in (5, 6))
                order = np.lexsort((at, block))
                cuts = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    i = order[a:b]
                    out.append((None, int(block[i[0]]), _answer(v[i], seen[i], at[i], odd_count[i] + 1, facts_of, mass), *none, 0, 0, 0.0))
            del found
            types = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * (KMAX + 3), pa.float64()]
            for part in batched(out, 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=["hot", "block", "data", *STATS, "total", "types", "mass"])

    return run


def context_weights(total: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """alpha: the probability that the discounts left, over that of what was not seen."""
    left = 1 - np.divide(kept, total, out=np.zeros_like(kept), where=total > 0)
    return np.where(total > 0, left / (1 - mass), 1.0)


def _scored(head: Head, unigram: Unigram, pair: Discount, hot_total: np.ndarray, hot_alpha: np.ndarray, hot_halves: np.ndarray):
    def sums(block: Block, answers: list[bytes]) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of each document."""
        n = len(block.uw)
        total, halves, alpha = np.zeros(n), np.zeros(n, bool), np.ones(n)
        count = np.zeros(n, np.int64)
        count[: block.n_frequent] = head.counts[block.uw[: block.n_frequent].astype(np.int64)]
        pairs = [block.pairs(False)[0], block.pairs(True)[0]]
        seen = [np.zeros(len(p), np.int64) for p in pairs]
        for data in answers:
            at, n_seen, rare, facts, more, types, *few, mass = unpacked(data)
            at, kind = np.cumsum(at.astype(np.int64)), int(len(rare) > 0)
            seen[kind][at] = n_seen
            v, w = (pairs[kind][at] >> np.uint64(32)).astype(np.int64), (pairs[kind][at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            if kind:
                count[w] = rare.astype(np.int64) - 1
            v = v[np.flatnonzero(np.diff(v, prepend=-1))]
            total[v], halves[v] = facts.astype(np.int64) >> 1, facts & 1
            v = v[more.astype(bool)]
            few = np.stack(few).astype(np.float64)
            r = np.arange(1, KMAX + 1)[:, None]
            less = 0.5 * types if pair.d is None else np.where(halves[v], 0.5 * types, (few * r * (1 - pair.d[1:, None])).sum(0))
            alpha[v] = context_weights(total[v], total[v] - less, mass)
        hot = head.hot_numbers(block.uw)
        here = hot > 0
        total[here], alpha[here], halves[here] = hot_total[hot[here] - 1], hot_alpha[hot[here] - 1], hot_halves[hot[here] - 1]
        every, order = np.concatenate(pairs), np.argsort(np.concatenate(pairs))
        every, seen = every[order], np.concatenate(seen)[order]
        v, w = (every >> np.uint64(32)).astype(np.int64), (every & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = unigram(count)
        chance = np.log10(np.where(seen > 0, pair(seen, halves[v]) / np.maximum(total[v], 1), alpha[v] * p[w]))
        base = np.log10((count + 1) / (unigram.n + unigram.v + 1))
        iw = block.iw.astype(np.int64)
        of = np.searchsorted(every, (block.iv << np.uint64(32)) | block.iw)
        return [np.add.reduceat(x, block.starts) for x in ((count > 0).astype(np.int64)[iw], base[iw], chance[of])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "block"):
            block = Block(group["data"][0].as_py())
            known, base, score = sums(block, group["data"].slice(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [group["docs"].slice(0, 1).flatten(), pa.array(~block.train), pa.array(block.sizes), pa.array(known), pa.array([unigram.n] * len(known), pa.int64()), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def facts(words: DataFrame, head: int = HEAD) -> tuple[Unigram, Head]:
    """The unigram model and the head."""
    one = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), *[F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, KMAX + 2)]).first()
    unigram = Unigram(one.tokens or 0, one.types, [one[s] for s in STATS])
    # the least count that leaves at most `head` words, from a histogram over eighths of powers of 2
    eighth = F.floor(F.log2("n") * 8).cast("int")
    room, least = head, None
    for row in sorted(words.groupBy(eighth.alias("e")).count().collect(), key=lambda r: -r.e):
        room -= row["count"]
        if room < 0:
            break
        least = row.e
    if least is None:
        return unigram, Head(np.zeros(0, np.uint64), np.zeros(0, np.int64), unigram.n)
    table = words.filter(eighth >= least).select("word", "n").toArrow()
    keys, counts = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(keys)
    return unigram, Head(keys[order], counts[order], unigram.n)


def score(documents: DataFrame, *, head: int = HEAD) -> DataFrame:
    """Every document's held_out flag, counts and scores."""
    spark = documents.sparkSession
    parts = 2 * partitions(spark)  # what a task holds at once is half as much
    rows = documents.select("doc_id", "text", (~held_out()).alias("train"))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    words = stored(rows.mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    unigram, known = facts(words, head)
    blocks = stored(rows.mapInArrow(_blocks(known), f"block long, docs array<{id_type}>, data binary"), "blocks")

    fields = "p int, data binary"
    texts = blocks.select("block", "data")
    rare = texts.mapInArrow(_asked(known, parts, True), fields).repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_counted_words(known, parts), fields)
    met = texts.mapInArrow(_asked(known, parts, False), fields).union(rare).repartition(parts, "p").sortWithinPartitions("p")
    answers = stored(met.mapInArrow(_counted_pairs(known, unigram), ANSWERS), "pair-counts")
    facts_of = pair_facts(answers, known.n_hot)
    replies = answers.filter("block is not null").select("block", F.lit(None).cast(f"array<{id_type}>").alias("docs"), "data")
    # a block comes before its answers
    both = blocks.union(replies).repartition(parts, "block").sortWithinPartitions("block", F.col("docs").isNull())
    return both.mapInArrow(_scored(known, unigram, *facts_of), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def pair_facts(pairs: DataFrame, n_hot: int) -> tuple[Discount, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs' discounts, and total, alpha and kind of discount of each hot context: at most HOT + 1 rows."""
    sums = pairs.filter("block is null").groupBy("hot").agg(*[F.sum(c).alias(c) for c in (*STATS, "total", "types", "mass")]).collect()
    pair = Discount(next(([r[s] for s in STATS] for r in sums if r.hot is None), [0] * (KMAX + 1)))
    total, kept, mass, halves = np.zeros(n_hot), np.zeros(n_hot), np.zeros(n_hot), np.ones(n_hot, bool)
    for r in sums:
        if r.hot is not None:
            k = r.hot - 1
            of = [r[s] for s in STATS[:KMAX]]
            total[k], mass[k], halves[k] = r.total, r.mass, not any(of)
            few = sum(n * c for c, n in enumerate(of, 1))
            if pair.d is None or halves[k]:
                kept[k] = r.total - 0.5 * r.types
            else:
                kept[k] = r.total - few + sum(n * c * pair.d[c] for c, n in enumerate(of, 1))
    return pair, total, context_weights(total, kept, mass), halves
