"""Best-fit packing and the quality ranking against plain versions of themselves."""

from __future__ import annotations

import functools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from __spark_entry__ import queries
from shelfwise.llm import packing, quality

FOLDER = "/root/testdata/sf0.001"


def plain_best_fit(sizes, capacity):
    """Every item, largest first, into the fullest bin that takes it; of equals the last one filled."""
    fills, touched, places = [], [], {}
    for turn, item in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        fitting = [b for b in range(len(fills)) if fills[b] + sizes[item] <= capacity]
        if fitting:
            number = max(fitting, key=lambda b: (fills[b], touched[b]))
        else:
            fills.append(0)
            touched.append(0)
            number = len(fills) - 1
        places[item] = (number, fills[number])
        fills[number] += sizes[item]
        touched[number] = turn
    return [places[i] for i in range(len(sizes))]


def fewest_bins(sizes, capacity):
    sizes = tuple(sorted(sizes, reverse=True))

    @functools.cache
    def best(left, rooms):
        if not left:
            return len(rooms)
        tries = {tuple(sorted((*rooms[:i], room - left[0], *rooms[i + 1 :]))) for i, room in enumerate(rooms) if room >= left[0]}
        return min([best(left[1:], t) for t in tries] + [best(left[1:], tuple(sorted((*rooms, capacity - left[0]))))])

    return best(sizes, ())


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_a_plain_loop(seed):
    draw = random.Random(seed)
    sizes = [draw.randrange(1, draw.choice([20, 101])) for _ in range(400)]
    bins, offsets = packing.best_fit(np.array(sizes), 100)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == plain_best_fit(sizes, 100)


def test_best_fit_is_near_the_optimum_of_small_cases():
    draw = random.Random(9)
    for _ in range(25):
        sizes = [draw.randrange(1, 12) for _ in range(draw.randrange(1, 9))]
        bins, _ = packing.best_fit(np.array(sizes), 12)
        assert bins.max() + 1 <= math.floor(11 / 9 * fewest_bins(sizes, 12) + 6 / 9)


def test_registered_packing_holds_the_ids_of_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = {}, {}
    for r in queries()["op8_best_fit_packing"](spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for doc in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = np.array([*library.encode(doc.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for number, r in enumerate(sorted(pieces.pop(doc.doc_id), key=lambda r: r.piece)):
            own = ids[4096 * number : 4096 * (number + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (number, 4096 * number, len(own), zlib.crc32(own.tobytes()))
    assert not pieces
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * total / 4096 + 1


def test_weights_equal_gradient_descent_on_the_same_pairs():
    draw = np.random.default_rng(5)
    good, bad = draw.normal(0.4, 1, (30, 3)) * [1, 2, 0.5], draw.normal(0, 1, (20, 3)) * [1, 2, 0.5]
    got = quality.bradley_terry(good, bad, 80, 0.01, 30, 3)
    choice = np.random.default_rng(3)
    left = np.resize(choice.permutation(30), 80)
    right = np.resize(choice.permutation(20), 80)[choice.permutation(80)]
    scale = np.concatenate([good, bad]).std(axis=0)
    weights = [0.0] * 3
    for _ in range(6000):
        slope = [-0.01 * w for w in weights]
        for a, b in zip(left, right, strict=True):
            ahead = [(good[a][k] - bad[b][k]) / scale[k] for k in range(3)]
            lost = 1 / (1 + math.exp(sum(w * x for w, x in zip(weights, ahead, strict=True))))
            slope = [s + lost * x / 80 for s, x in zip(slope, ahead, strict=True)]
        weights = [w + 0.5 * s for w, s in zip(weights, slope, strict=True)]
    assert (got * scale).tolist() == pytest.approx(weights, abs=1e-4)


def test_figures_by_hand(spark):
    row = quality.figures(spark.createDataFrame([(1, "The cat SAT.\nthe the 12")], "doc_id long, text string")).first()
    f = dict(enumerate(row.figures))
    letters, chars = 15, 18  # THE cat SAT the the, a full stop, two digits
    assert f[0] == pytest.approx(math.log1p(6) / 10) and f[1] == pytest.approx(letters / chars)
    assert f[2] == pytest.approx(4 / letters) and f[4] == pytest.approx(2 / chars)
    assert f[11] == pytest.approx(5 / 6) and f[14] == pytest.approx(1 / 6) and f[15] == 1.0 and f[16] == 0.5


def test_registered_scores_rank_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries()["op9_quality_ranking"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    pairs = [(a, b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert not pairs or sum(a > b for a, b in pairs) >= 0.9 * len(pairs)
