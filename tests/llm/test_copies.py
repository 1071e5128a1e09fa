"""SimHash, embeddings and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from shelfwise.llm import simhash, vectors
from shelfwise.llm.components import connected_components


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    draw = random.Random(1)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)]
    links += [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(40)]
    links += [(1, None), links[0]]
    out = connected_components(spark.createDataFrame(links, "a long, b long"))
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert {r.node: r.component for r in out.collect()} == groups({n for x in real for n in x}, real)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_follow_the_contract():
    text = "A  bC d É\x0b x"
    words = ["a", "bc d", "É", "x"]
    expected = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(2)]
    assert simhash.shingle_hashes(text, 3).tolist() == expected
    assert simhash.shingle_hashes("One two", 3).tolist() == [xxhash.xxh64_intdigest(b"one two", 42)]
    assert simhash.simhash(simhash.shingle_hashes(" \n", 3)) == 0
    assert simhash.simhash(np.array([3, 1], np.uint64)) == 1  # over half, not half


@pytest.mark.parametrize("leaf_rows", [8, 4096])
def test_partition_finds_every_link(spark, leaf_rows):
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        for _ in range(4):
            prints.add(p ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    found = [(r.a, r.b) for r in simhash.linked_prints(frame, 2, leaf_rows, 100 if leaf_rows == 8 else None).collect()]
    every = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert groups(range(len(prints)), found) == groups(range(len(prints)), every)


def test_near_duplicates_of_odd_rows(spark):
    long = "many words of one text " * 20000
    rows = [(1, None, "a"), (2, "", "b"), (3, "same text of words", "c"), (4, "Same  TEXT of words", "d"),
            (4, "Same  TEXT of words", "d"), (None, "same text of words", "e"), (7, long, "f"), (8, long, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(out, key=str) == sorted(
        [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (None, 3), (7, 7), (8, 7)], key=str
    )
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_vectors(rows, cosine):
    links = {i: set() for i in range(len(rows))}
    for i, (_, label, v) in enumerate(rows):
        for j, (_, other, w) in enumerate(rows):
            if i != j and label is not None and label == other and v is not None and w is not None and len(v) == len(w):
                a, b = np.array([x if x is not None else np.nan for x in v]), np.array([x if x is not None else np.nan for x in w])
                if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any():
                    if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                        links[i].add(j)
    root = groups(range(len(rows)), [(i, j) for i in links for j in links[i]])
    least = {}
    for i, (name, _, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], name), name)
    return sorted((rows[i][0], len(links[i]), least[root[i]]) for i in links)


def test_every_close_pair_meets_in_a_shard_and_in_a_leaf(monkeypatch):
    """Against all pairs; prints are random, or near each other, or all within a few bits."""
    draw = np.random.default_rng(4)
    near = draw.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (40, 30), dtype=np.uint64)
    sets = [draw.integers(0, 2**64, 3000, dtype=np.uint64), np.unique(near[:, None] ^ flips), np.arange(1500, dtype=np.uint64)]
    for fps in sets:
        fps = np.unique(fps)
        close = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1}
        tree = simhash.VantageTree(fps[::2], len(fps), 200, 2)
        row, shard = tree.shards(fps)
        members = [set(row[shard == s].tolist()) for s in np.unique(shard)]
        assert set().union(*members) == set(range(len(fps)))
        assert all(any(i in m and j in m for m in members) for i, j in close)
        # Links of the inner tree connect what all pairs connect.
        a, b = simhash.shard_links(fps, 2, 50)
        assert components(len(fps), zip(a.tolist(), b.tolist(), strict=True)) == components(len(fps), close)


def components(size, pairs):
    head = list(range(size))

    def top(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, j in pairs:
        i, j = sorted((top(i), top(j)))
        head[j] = i
    return [top(i) for i in range(size)]


def test_work_grows_slowly_and_leaves_stay_small(monkeypatch):
    """Comparisons a row for random prints: 16 times the rows cost less than 16 ** 0.45 as much."""
    work = []
    monkeypatch.setattr(simhash, "tree_links", lambda fps, bits: (work.append(len(fps)), np.zeros((2, 0), np.int64))[1])
    spent = []
    for rows in (1 << 15, 1 << 19):
        fps = np.random.default_rng(rows).integers(0, 2**64, rows, dtype=np.uint64)
        tree = simhash.VantageTree(fps[: 64 * (rows >> 14)], rows, 1 << 14, 2)
        row, shard = tree.shards(fps)
        work.clear()
        some = np.unique(shard)[::4]
        for s in some.tolist():
            simhash.shard_links(fps[row[shard == s]], 2)
        assert max(work) <= simhash.LEAF_ROWS
        read = int(np.isin(shard, some).sum())
        spent.append(sum(n * n for n in work) / read * len(row) / rows)
    assert spent[1] <= spent[0] * 16**0.45


@pytest.mark.parametrize("leaf_rows", [4, 1024])
@pytest.mark.parametrize("dimensions", [5, 24])
def test_vector_links_equal_brute_force(spark, leaf_rows, dimensions):
    draw = np.random.default_rng(dimensions)
    rows = []
    for centre in draw.standard_normal((12, dimensions)):
        for _ in range(8):
            near = centre + draw.standard_normal(dimensions) * draw.choice([0.02, 0.15])
            rows.append([float(np.float32(x)) for x in near * draw.uniform(0.5, 2)])
    rows = [(i, i % 2, v) for i, v in enumerate(rows)]
    rows += [(100, 0, rows[0][2]), (101, 0, rows[0][2]), (102, 1, rows[0][2]), (103, None, rows[0][2]), (104, 0, None),
             (105, 0, [0.0] * dimensions), (106, 0, [float("nan")] * dimensions), (107, 0, [None] * dimensions),
             (108, 0, [1.0, 2.0]), (109, 0, [2.0, 4.0]), (110, 0, [])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    out = vectors.near_duplicates(frame, 0.98, leaf_rows).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute_vectors(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vectors.near_duplicates(frame).count() == 0
