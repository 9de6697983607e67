"""Alignment of two tokenizers: a byte-level BPE (A) and a BPE with byte fallback (B) over the same bytes.

Both give a rising list of byte offsets at which their tokens end. Where both lists hold an offset, a group ends. The common
offsets are found by a galloping intersection: each end of the shorter list is looked for in the longer one from the last place on,
by steps that double and then by halving the last step. The indices of common ends slice the groups, and the differences of their ranks
in both lists are the ranges of tokens that overlap. The last tokens of a group end together: they are linked.

Neither tokenizer joins characters over a single space or line feed, so a regular text is its stretches (" word", "\\nword"), each
encoded and aligned once for a worker; other texts are encoded and aligned whole. (The first is packing's observation; for B it is checked
on the vocabulary.) Each task gives blocks of about BLOCK links, with the distinct id pairs of each document and of the block.
Blocks ask for their pairs' counts, as rows (block, pair), and get them back in one row, so no task holds the counts of all pairs and the
shuffle grows with distinct pairs of blocks, not with links.

Edge cases: null, empty and not reproducible texts have no tokens, zeros, and the empty string as groups; null and repeated doc_ids are
ordinary rows, and their links count each time; a very long text is a block of its own, which holds its distinct pairs; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import packing
from sluice.llm.common import stored

#: Links a block; stretches that a worker keeps.
BLOCK, KEPT = 131_072, 120_000
#: An id pair as one number: ids of B lie below 2**SHIFT.
SHIFT = 15
SPACE = "▁"

_aligners: dict[tuple[str, str], "_Aligner"] = {}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others come after 255 in order."""
    printable = lambda b: 33 <= b <= 126 or 161 <= b <= 255 and b != 173
    others = [b for b in range(256) if not printable(b)]
    return {chr(b): b for b in range(256) if printable(b)} | {chr(256 + i): b for i, b in enumerate(others)}


def gallop(wanted: np.ndarray, at: np.ndarray, end: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """The place of each wanted number in its part [at, end) of a list that rises there, or -1: steps double from `at` on, then the last one is halved. All numbers are looked for side by side."""
    step = np.ones(len(wanted), np.int64)
    while (on := (at + step < end) & (rising[np.minimum(at + step, len(rising) - 1)] < wanted)).any():
        step[on] *= 2
    low, high = np.where(step > 1, at + step // 2, at), np.minimum(at + step, end - 1)
    while (on := low < high).any():
        middle = (low + high) // 2
        less = on & (rising[middle] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(on & ~less, middle, high)
    return np.where(rising[low] == wanted, low, -1)


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists that lie one after another: the list of each entry, and the first and last place (exclusive) of each list."""
    last = np.cumsum(counts)
    return np.repeat(np.arange(len(counts)), counts), last - counts, last


def common_ends(ends_a: np.ndarray, n_a: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places (i, j) with ends_a[i] == ends_b[j] in the same text, in order. n_a, n_b: tokens of each text, which lie one after another; in each the shorter list drives."""
    (of_a, first_a, last_a), (of_b, first_b, last_b) = _within(n_a), _within(n_b)
    by_a = n_a <= n_b
    i, j = np.flatnonzero(by_a[of_a]), np.flatnonzero(~by_a[of_b])
    found_j = gallop(ends_a[i], first_b[of_a[i]], last_b[of_a[i]], ends_b)
    found_i = gallop(ends_b[j], first_a[of_b[j]], last_a[of_b[j]], ends_a)
    i, j = np.concatenate([i[found_j >= 0], found_i[found_i >= 0]]), np.concatenate([found_j[found_j >= 0], j[found_i >= 0]])
    order = np.argsort(i)
    return i[order], j[order]


class Vocabularies:
    """The bytes of all ids, and ids as written in groups."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes = bytes_a, bytes_b
        self.lengths = tuple(np.array([len(x) for x in v], np.int64) for v in self.bytes)
        numbers = [str(i) for i in range(max(map(len, self.bytes)))]
        self.written = {sign: np.array([n + sign for n in numbers], object) for sign in ",|;"}
        self.digits = np.array([len(n) for n in numbers], np.int64) + 1

    def reproduced(self, ids: list[np.ndarray], counts: list[np.ndarray], texts: list[str]) -> np.ndarray:
        """Whether both tokenizers' bytes are those of the text."""
        data = [t.encode() for t in texts]
        sizes = np.array([len(d) for d in data])
        ok = np.ones(len(texts), bool)
        joined = b"".join(data)
        for of, x, n in zip(self.bytes, ids, counts):
            parts = list(map(of.__getitem__, x.tolist()))
            in_text, first, last = _within(n)
            same = np.bincount(in_text, weights=np.array([len(p) for p in parts]), minlength=len(texts)) == sizes
            if not same.all() or b"".join(parts) != joined:
                ok &= [b"".join(parts[s:e]) == d for s, e, d in zip(first, last, data)]
        return ok

    def aligned(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each text its sums (tokens by A, by B, groups, 1 if not reproduced), its groups as text, and of all texts the links as pair numbers."""
        ok = self.reproduced([ids_a, ids_b], [n_a, n_b], texts)
        if not ok.all():  # they have no tokens
            ids_a, ids_b = ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)]
            n_a, n_b = n_a * ok, n_b * ok
        i, j = common_ends(np.cumsum(self.lengths[0][ids_a]), n_a, np.cumsum(self.lengths[1][ids_b]), n_b)
        links = (ids_a[i].astype(np.uint32) << np.uint32(SHIFT)) | ids_b[j].astype(np.uint32)
        n_groups = np.bincount(_within(n_a)[0][i], minlength=len(texts))
        # A's tokens of a group stand before B's: each token moves on by the other list's tokens of the groups before it (B's: and its own)
        group_a, group_b = np.searchsorted(i, np.arange(len(ids_a))), np.searchsorted(j, np.arange(len(ids_b)))
        place_a, place_b = np.arange(len(ids_a)) + np.concatenate([[0], j + 1])[group_a], np.arange(len(ids_b)) + (i + 1)[group_b]
        written, widths = np.empty(len(ids_a) + len(ids_b), object), np.zeros(len(ids_a) + len(ids_b), np.int64)
        for ids, place, last, sign in ((ids_a, place_a, i, "|"), (ids_b, place_b, j, ";")):
            part = self.written[","][ids]
            part[last] = self.written[sign][ids[last]]
            written[place], widths[place] = part, self.digits[ids]
        joined, ends = "".join(written.tolist()), np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return np.stack([n_a, n_b, n_groups, ~ok], axis=1), [joined[s : max(s, e - 1)] for s, e in zip(ends, ends[1:])], links


class _Aligner(packing._Encoder):
    """Stretch -> number; what each stretch gives stands in lists by number."""

    def __init__(self, path: str, pieces: str):
        super().__init__(path, packing.default_ranks() if path == packing.default_tokenizer() else None)
        import sentencepiece

        self.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        # added entries are written as they are, not by letters
        entries = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        names = [self.pieces.id_to_piece(i) for i in range(len(self.pieces))]
        self.both = Vocabularies(
            [bytes(map(letters.__getitem__, t)) if letters.keys() >= set(t) else t.encode() for t in entries],
            [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)],
        )
        plain = [p for i, p in enumerate(names) if not (self.pieces.is_byte(i) or self.pieces.is_control(i) or self.pieces.is_unknown(i))]
        self.stretches = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in plain) and len(names) <= 1 << SHIFT
        assert len(names) <= 1 << SHIFT, "pair numbers need a vocabulary of at most 2**SHIFT pieces"

    def reset(self) -> None:
        super().reset()
        self.given: list[str] = []
        self.sums = np.zeros((1 << 14, 4), np.int64)  # n_a, n_b, n_groups, not ok
        self.links, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.n_links = 0

    def _b(self, stretches: list[str]) -> list[list[int]]:
        """Ids by B, which puts a space before each text: it stands for that of " word"; before "\\nword" it is a piece of its own, which goes."""
        return [ids[1:] if s[0] == "\n" else ids for s, ids in zip(stretches, self.pieces.encode([s if s[0] == "\n" else s[1:] for s in stretches], num_threads=1))]

    def _learn(self) -> None:
        fresh, at = self.fresh, self.n
        super()._learn()
        if not fresh:
            return
        found = self._b(fresh)
        n_b = np.array([len(x) for x in found], np.int64)
        sums, groups, links = self.both.aligned(self.pool[self.start[at] : self.used].astype(np.int64), np.diff(self.start[at : self.n + 1]), np.array([i for x in found for i in x], np.int64), n_b, fresh)
        self.given += groups
        while self.n + 1 > len(self.sums):
            self.sums, self.first = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.first, np.zeros_like(self.first)])
        self.sums[at : self.n] = sums
        while self.n_links + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.n_links : self.n_links + len(links)] = links
        self.first[at + 1 : self.n + 1] = self.n_links + np.cumsum(sums[:, 2])
        self.n_links += len(links)

    def whole(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        a, b = (np.array(x, np.int64) for x in (self.tokenizer.encode(" " + text, add_special_tokens=False).ids, self.pieces.encode(text)))
        sums, groups, links = self.both.aligned(a, np.array([len(a)]), b, np.array([len(b)]), [" " + text])
        return (*sums[0, :3].tolist(), groups[0], links)

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """(tokens by A, by B, groups, groups as text, links) of each text."""
        if len(self) > KEPT:
            self.reset()
        numbers: list = []
        for text in texts:
            if text and self.stretches and packing.regular(text):
                chunks = ("\n" + text.replace("\n", " \n")).split(" ")
                chunks[0] = chunks[0][1:]  # the first word follows the space that is put before the text
                numbers.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
            else:
                numbers.append(None)
        self._learn()
        out = []
        for text, k in zip(texts, numbers):
            if not text:
                out.append((0, 0, 0, "", np.zeros(0, np.uint32)))
                continue
            sums = None if k is None else self.sums[k].sum(axis=0).tolist()
            if sums is None or sums[3]:
                out.append(self.whole(text))
                continue
            first, lengths = self.first[k], self.first[k + 1] - self.first[k]
            at = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            out.append((*sums[:3], ";".join(map(self.given.__getitem__, k.tolist())), self.links[at]))
        return out


def align(texts: list[str], path: str | None = None, pieces: str | None = None) -> list[tuple[int, int, int, str, np.ndarray]]:
    key = (path or packing.default_tokenizer(), pieces or default_pieces())
    if key not in _aligners:
        _aligners[key] = _Aligner(*key)
    return _aligners[key].align(texts)


DOCUMENT = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, n_pairs array<int>, pair array<int>, times array<int>"


def _lists(arrays: list[np.ndarray]) -> list[pa.Array]:
    """One row with these arrays as lists of int."""
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.asarray(x, np.int32))) for x in arrays]


def _blocks(path: str | None, pieces: str | None, run_chars: int = 1_000_000):
    """A row for each block: its documents with their distinct pairs (as places in the block's list), and the block's distinct pairs with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_blocks, docs, links, total = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            sizes = [len(x) for x in links]
            codes, place, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            own, n = np.unique(np.repeat(np.arange(len(docs)), sizes) * max(len(codes), 1) + place, return_counts=True)
            per_doc = np.bincount(own // max(len(codes), 1), minlength=len(docs))
            columns = [pa.array([list(c)], pa.list_(pa.string() if i == 4 else pa.int64())) for i, c in enumerate(zip(*docs))]
            numbers = _lists([per_doc, own % max(len(codes), 1), n, codes, times])
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | n_blocks]), *columns, *numbers], names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_pairs", "pair", "times", "codes", "code_times"])

        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"]
            at = 0
            while at < len(ids):
                end, chars, run_texts = at, 0, []
                while end < len(ids) and chars < run_chars:
                    run_texts.append(texts[end].as_py() or "")
                    chars += len(run_texts[-1])
                    end += 1
                for doc, (n_a, n_b, n_groups, groups, found) in zip(ids[at:end], align(run_texts, path, pieces)):
                    docs.append((doc, n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
                    links.append(found)
                    total += len(found)
                    if total >= BLOCK or len(docs) >= BLOCK:
                        yield block()
                        n_blocks, docs, links, total = n_blocks + 1, [], [], 0
                at = end
        if docs:
            yield block()

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block's documents, once the counts of its pairs are known."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name: batch[name][row].values  # noqa: E731,B023
            count, best = (np.asarray(get("answers").field(f)) if batch["answers"][row].is_valid else np.zeros(0, np.int64) for f in ("n", "best"))
            per_doc, pair, times = (np.asarray(get(n)).astype(np.int64) for n in ("n_pairs", "pair", "times"))
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            sums = []
            for value in (np.ones(len(pair), np.int64), best[pair].astype(np.int64) if len(pair) else pair, count[pair] if len(pair) else pair):
                total = np.zeros(len(per_doc), np.int64)
                np.add.at(total, doc, times * value)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("n_a"), get("n_b"), get("n_groups"), *sums, get("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Every linked id pair as `code` with its links in the corpus, and whether no pair of its B id has more."""
    counts = blocks.select(F.inline(F.arrays_zip("codes", "code_times"))).groupBy(F.col("codes").alias("code")).agg(F.sum(F.col("code_times").cast("long")).alias("n"))
    counts = stored(counts.withColumn("b", F.col("code").bitwiseAND((1 << SHIFT) - 1)), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most.hint("merge"), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def report(documents: DataFrame, *, tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row for each document: tokens, groups and links of the two tokenizers, and how frequent its linked pairs are in the corpus."""
    blocks = stored(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(tokenizer, pieces), f"block long, {DOCUMENT}, codes array<int>, code_times array<int>"), "aligned")
    asked = blocks.select("block", F.explode("codes").alias("code"))
    told = asked.join(pair_counts(blocks).hint("merge"), "code")
    answers = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "n", "best"))).alias("answers"))
    rows = blocks.drop("codes", "code_times").join(answers.hint("merge"), "block", "left")
    return rows.mapInArrow(_told, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
