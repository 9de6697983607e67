"""Two tokenizers' alignment against sets of offsets and counters."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sluice.llm import align

TEXTS = [
    "hello world\nfoo bar", "naïve éöü  x\n", "a ▁ b", "", None, " lead", "x<|endoftext|>y </s> <s>", "日本語 テキスト", "é \U0001f600 word", "a\x00b", " ", "\n", "tab\there\r\n",
    "the same text twice", "the same text twice", "\xa0wide spaces　here", "word " * 3_000 + "end", "x" * 20_000, "<0x41> <unk>", "a\nb\nc", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def own():
    return align._Aligner(align.packing.default_tokenizer(), align.default_pieces())


def plain(own, text):
    """(n_a, n_b, groups, links) by sets."""
    if not text:
        return 0, 0, "", []
    sides = []
    for ids, of in zip((own.tokenizer.encode(" " + text, add_special_tokens=False).ids, own.pieces.encode(text)), own.both.bytes):
        if b"".join(of[i] for i in ids) != (" " + text).encode():
            return 0, 0, "", []
        sides.append((ids, {int(e): k for k, e in enumerate(np.cumsum([len(of[i]) for i in ids]))}))
    (a, ends_a), (b, ends_b) = sides
    i = j = 0
    groups, links = [], []
    for end in sorted(ends_a.keys() & ends_b.keys()):
        i_, j_ = ends_a[end] + 1, ends_b[end] + 1
        groups.append(",".join(map(str, a[i:i_])) + "|" + ",".join(map(str, b[j:j_])))
        links.append((a[i_ - 1], b[j_ - 1]))
        i, j = i_, j_
    return len(a), len(b), ";".join(groups), links


def check(own, rows, found):
    want = [plain(own, t) for _, t in rows]
    counts = Counter(k for w in want for k in w[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    expected = [
        (d, a, b, g.count(";") + 1 if a else 0, len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(g.encode()).hexdigest() if a else "")
        for (d, _), (a, b, g, k) in zip(rows, want)
    ]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted(expected, key=str)


def test_awkward_texts(spark, own):
    rows = list(enumerate(TEXTS)) + [(None, "a null id"), (3, "a repeated id")]
    frame = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, block int, codes string")
    check(own, rows, align.report(frame).collect())


def test_documents(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(own, [tuple(r) for r in docs.collect()], align.report(docs).collect())


def test_small_blocks(spark, own, monkeypatch):
    """Blocks that hold parts of the documents give the same counts."""
    rows = [(i, f"some words {i % 7} again and again {i % 3}\nanother line") for i in range(60)]
    monkeypatch.setattr(align, "BLOCK", 50)
    blocks = align._blocks(None, None)

    class Task:
        @staticmethod
        def get():
            return Task

        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(align, "TaskContext", Task)
    import pyarrow as pa

    found = list(blocks(iter([pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})])))
    assert len(found) > 10 and len({b["block"][0].as_py() for b in found}) == len(found)
    assert sum((b["doc_id"][0].as_py() for b in found), []) == list(range(60))
    links = Counter()
    for b in found:
        links.update(dict(zip(b["codes"][0].as_py(), b["code_times"][0].as_py())))
    assert links == Counter(a << align.SHIFT | b for _, t in rows for a, b in plain(own, t)[3])


@given(st.lists(st.tuples(st.sets(st.integers(1, 60), max_size=25), st.sets(st.integers(1, 60), max_size=8)), min_size=1, max_size=4))
def test_common_ends(texts):
    """The galloping intersection is the sets' intersection, text by text, whichever list is shorter."""
    sides = [[sorted(pair[k]) for pair in texts] for k in (0, 1)]
    flat = [np.array([e for x in side for e in x], np.int64) for side in sides]
    sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
    i, j = align.common_ends(flat[0], sizes[0], flat[1], sizes[1])
    firsts = [np.cumsum(n) - n for n in sizes]
    want = [(firsts[0][t] + sides[0][t].index(e), firsts[1][t] + sides[1][t].index(e)) for t in range(len(texts)) for e in sorted(set(sides[0][t]) & set(sides[1][t]))]
    assert list(zip(i.tolist(), j.tolist())) == want
