"""Alignment of two tokenizations against the libraries and a plain merge."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from __spark_entry__ import queries
from shelfwise.llm import align

BYTES, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SIGNS = ["a", "B", "word", "the", " ", "  ", "   ", "\n", "\t", ".", "é", "ß", "中", "😀", "'s", "7", "\u00a0", "\0", "<s>",
         "<|endoftext|>", "<0x41>", "\u3000", "ﬁ", "e\u0301", "\x85"]


def texts(count=2500):
    draw = random.Random(7)
    odd = ["", None, " ", "  ", "   a", "a   ", " a", "a  b   c", "\n", "one ▁ two", "▁", "x" * 3000, "word " * 4000]
    return odd + ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(30))) for _ in range(count)]


def plain(rows):
    """The contract, word for word, with both libraries."""
    tokenizer, processor = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer.encode_special_tokens = True
    bytes_a, bytes_b = align.byte_tokens(BYTES), align.piece_tokens(PIECES)
    made, counts = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, processor.encode(text)
            whole = (" " + text).encode()
            if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
                a, b = [], []
            i = j = end_a = end_b = 0
            own_a, own_b = [], []
            while i < len(a) or j < len(b):
                if end_a <= end_b:
                    end_a, i = end_a + len(bytes_a[a[i]]), i + 1
                    own_a.append(a[i - 1])
                else:
                    end_b, j = end_b + len(bytes_b[b[j]]), j + 1
                    own_b.append(b[j - 1])
                if end_a == end_b:
                    groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                    links.append((a[i - 1], b[j - 1]))
                    own_a, own_b = [], []
        else:
            a, b = [], []
        counts.update(links)
        made.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (-1 if doc_id is None else doc_id, n_a, n_b, len(groups), len(links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
         sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links))
        for doc_id, n_a, n_b, groups, links in made
    )


def got(frame):
    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    return sorted((-1 if r.doc_id is None else r.doc_id, *(r[n] for n in names)) for r in frame.collect())


def test_pieces_equal_the_library():
    processor, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), align.SentenceEncoder(PIECES)
    every = [t for t in texts(6000) if t]
    ids, counts = own.encode([" " + t for t in every])
    wanted = processor.encode(every)
    spelling = [i for i, t in enumerate(every) if align.BLANK not in t]
    ends = np.cumsum(counts)
    for i in spelling:
        assert ids[ends[i] - counts[i] : ends[i]].tolist() == wanted[i], repr(every[i])


def test_merge_equals_a_plain_one(monkeypatch):
    draw = np.random.default_rng(2)
    for lane in (1, 7, 256):
        monkeypatch.setattr(align, "LANE_BYTES", lane)
        for total in (0, 1, 50, 4000):
            a, b = (np.unique(np.append(draw.integers(1, total + 1, total // 3), total)) if total else np.zeros(0, np.int64) for _ in "ab")
            both = np.intersect1d(a, b)
            left, right = align.merged(a, b, total)
            assert a[left].tolist() == both.tolist() == b[right].tolist()


@pytest.mark.parametrize("chunk", [5, 1 << 21])
def test_alignment_equals_the_plain_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK_LINKS", chunk)
    count = 300 if chunk == 5 else 2500
    rows = [(2**60 + i if i % 9 else None, t) for i, t in enumerate(texts(count))] + [(4, "the same text"), (4, "the same text")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string").repartition(3)
    assert got(align.alignment(docs, BYTES, PIECES)) == plain(rows)


def test_no_documents_give_no_row(spark):
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries()["op13_tokenizer_alignment"](spark, folder)) == plain(rows)
