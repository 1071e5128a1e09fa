"""Cutting-stock packing: the program against exhaustive search, the places against plain layouts."""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from __spark_entry__ import queries
from shelfwise.llm import stock

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def histogram(lengths, capacity):
    return np.bincount(np.array(lengths, np.int64), minlength=capacity)


def checked(pieces, items, capacity, unpadded):
    """The padding of ``(item, start, length, sequence, offset)``, which must cover every item once."""
    by_item, by_sequence = {}, {}
    for item, start, length, sequence, offset in pieces:
        by_item.setdefault(item, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for item, length in enumerate(items):
        assert run(by_item[item]) == length
    fills = [run(parts) for parts in by_sequence.values()]
    assert max(fills, default=0) <= capacity
    return sum(capacity - f for f in fills if f != capacity and f not in unpadded)


def run(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


@pytest.mark.parametrize("unpadded", [(), (1, 2, 4, 8, 16)])
def test_places_cover_every_item_without_padding(unpadded):
    draw = random.Random(4)
    for lengths in ([], [15], [9] * 40, [3, 3, 5, 7, 9, 15, 15, 1], [draw.randrange(1, 16) for _ in range(500)]):
        counts = histogram(lengths, 16)
        places = stock.Places(stock.plan(counts, 16, unpadded), counts, 16, unpadded)
        items = np.repeat(np.arange(16), counts)
        ranks = np.concatenate([np.arange(n) for n in counts])
        padding = checked(list(zip(*(c.tolist() for c in places.of(items, ranks)), strict=True)), items.tolist(), 16, unpadded)
        assert padding == (0 if unpadded else -sum(lengths) % 16)


def test_the_knapsack_finds_the_best_pattern():
    """Against the best multiset of lengths, by a plain recursion, at random dual values."""
    draw = np.random.default_rng(3)
    for _ in range(20):
        counts = histogram(draw.integers(1, 20, 30), 20)
        program = stock.Program(counts, 20, (1, 2, 4, 8, 16))
        dual = draw.uniform(-0.2, 1.5, len(program.lengths))

        @functools.cache
        def best(fill, program=program, dual=dual):
            if not fill:
                return 0.0
            return max((best(fill - r) + v for r, v in zip(program.lengths.tolist(), dual.tolist(), strict=True) if r <= fill), default=-np.inf)

        wanted = max(best(fill) - program.price(fill) for fill in range(1, 21))
        found, _ = program._improving(dual)
        worth = dict(zip(program.lengths.tolist(), dual.tolist(), strict=True))
        if wanted > 1e-9:
            got = sum(worth[r] * c for r, c in found[0].takes.items()) - program.price(found[0].fill)
            assert got == pytest.approx(wanted)
        else:
            assert not found


def test_the_program_packs_what_can_be_packed_whole(monkeypatch):
    """Sequences that were cut into known items can be filled again with few cuts."""
    monkeypatch.setattr(stock, "PIVOTS", 50)
    draw, lengths = random.Random(6), []
    for _ in range(3000):
        cut = sorted(draw.sample(range(1, 32), draw.randrange(1, 4)))
        lengths += [b - a for a, b in zip([0, *cut], [*cut, 32], strict=True)]
    counts = histogram(lengths, 32)
    patterns = stock.plan(counts, 32, (1, 2, 4, 8, 16, 32))
    on_tape = sum(lengths) - sum(p.fill * p.times for p in patterns)
    assert on_tape <= 0.02 * sum(lengths)
    assert all(p.fill in (1, 2, 4, 8, 16, 32) for p in patterns)


def test_the_program_reaches_the_optimum_of_a_small_case():
    # 7 + 5 + 4 twice fills 16; greedy takes 7 + 7 first and cannot.
    counts = histogram([7, 7, 5, 5, 4, 4] * 50, 16)
    amounts = stock.Program(counts, 16, (16,)).solve()
    assert sum(p.fill * a for p, a in amounts) >= 0.999 * float(counts @ np.arange(16))


def docs(spark):
    rows = [(5, "five words are in here", "x"), (2, None, "x"), (9, "", "x"), (1, "long " * 30000, "x"),
            (2, "twice", "x"), (None, "no id", "x"), (5, "five words are in here", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")


@pytest.mark.parametrize("unpadded", [(), stock.powers_of_two(64)])
def test_pieces_hold_the_ids_of_the_library(spark, unpadded):
    out = stock.packed_documents(docs(spark), BYTES, 0, 64, unpadded).collect()
    library = Tokenizer.from_file(BYTES)
    wanted = sorted([*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs(spark).collect())
    held = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        held.setdefault((r.doc_id is None, r.doc_id or 0, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = []
    for (_, _, tokens), parts in held.items():
        ids = [i for _, part in sorted(parts) for i in part]
        copies = len(ids) // tokens
        if copies == 1:
            got.append(ids)
        else:  # rows that repeat are packed each for itself
            got += [[i for _, part in sorted(parts)[::copies] for i in part]] * copies
    assert sorted(got) == wanted
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = [run(parts) for parts in sequences.values()]
    assert max(fills) <= 64 and sum(fills) == sum(map(len, wanted))
    padding = sum(64 - f for f in fills if f != 64 and f not in unpadded)
    assert padding == (0 if unpadded else -sum(fills) % 64)


def test_no_documents_give_no_row(spark):
    assert stock.packed_documents(docs(spark).limit(0), BYTES, 0, 64).count() == 0


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    out = queries()["op11_cutting_stock_packing"](spark, folder).collect()
    library, held, fills = Tokenizer.from_file(BYTES), {}, {}
    for r in out:
        held.setdefault(r.doc_id, []).append(r)
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids, at = np.array([*library.encode(doc.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(held.pop(doc.doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not held
    assert all(run(parts) in stock.powers_of_two(1024) for parts in fills.values())
