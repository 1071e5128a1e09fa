"""Ranked search against scoring every document plainly."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from shelfwise.llm import ranking

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, limit=10):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    documents, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, own), n in zip(counted, sizes, strict=True):
            score = 0
            for t in terms(text):
                if t in own:
                    weight = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += weight * ((1000000000 * own[t]) // (1000 * own[t] + 8 * (25 + (75 * n * documents) // length)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def tables(seed, documents=600, queries=25):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "中文", "the", "THE", "a1"]
    weights = [1 / (1 + i) for i in range(len(words))]

    def text(n):
        return draw.choice([" ", ", ", "\n"]).join(draw.choices(words, weights, k=n))

    docs = [(2**60 + i, text(draw.choice([1, 5, 40, 200]))) for i in range(documents)]
    items = [(i, text(draw.randrange(1, 30))) for i in range(queries)]
    docs += [(7, items[0][1])] * 3 + [(9, items[1][1] + " more")] * 14 + [(None, items[0][1]), (None, None), (3, ""), (4, "?!")]
    items += [(0, items[0][1]), (90, None), (91, ""), (92, "unknown"), (None, "the w1"), (93, "w1 " * 500)]
    return docs, items


@pytest.mark.parametrize("first", [1, 4096])
def test_ranks_equal_plain_scoring(spark, monkeypatch, first):
    monkeypatch.setattr(ranking, "FIRST_ROWS", first)
    docs, items = tables(first)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranking.ranked(frame, queries)) == plain(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = tables(3, 120, 12)
    frame, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(ranking.ranked(frame, queries, 3, block_entries=90)) == plain(docs, items, 3)


def test_buckets_that_cannot_matter_are_not_searched(spark, monkeypatch):
    """Long vectors answer the query; the thousands of short ones are never compared."""
    docs = [(i, "rare words stand together here") for i in range(12)] + [(100 + i, f"here filler{i} " * 60) for i in range(3000)]
    frame, seen = spark.createDataFrame(docs, "doc_id long, text string"), []
    search = ranking.searched

    def watched(rows, block, limit):
        seen.append(rows.count())
        return search(rows, block, limit)

    monkeypatch.setattr(ranking, "searched", watched)
    monkeypatch.setattr(ranking, "FIRST_ROWS", 12)
    items = [(1, "rare words stand together here")]
    out = got(ranking.ranked(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert out == plain(docs, items) and sum(seen) <= 12


def test_empty_tables_give_no_row(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.ranked(docs.limit(0), items).count() == 0
    assert ranking.ranked(docs, items.limit(0)).count() == 0
