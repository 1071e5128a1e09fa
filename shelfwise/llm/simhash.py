"""SimHash near-duplicates, joined by vantage-point trees.

Null and empty texts have the fingerprint zero and are linked like any other. Rows that repeat, or
share a ``doc_id``, count as rows. A null ``doc_id`` gets a fingerprint and the smallest non-null id
of its fingerprint's component (null if there is none). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare, staged
from shelfwise.llm.components import connected_components
from shelfwise.llm.leaves import in_blocks

SEED = 42
LEAF_ROWS = 512  # prints compared with each other
SHARDS, LEAST_SHARD, MOST_SHARD = 4096, 1 << 14, 1 << 20  # about so many shards, of so many prints
SAMPLE_A_SHARD, MOST_SAMPLE = 64, 1 << 22  # prints of the sample the first tree is made of
TRIES = 6  # vantage points tried for a node
SPLITS = 0.9  # a node must save a tenth of the comparisons


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of a text, A-Z lower-cased; repeats stay."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first = (ends - lengths).tolist()
    last = ends[width - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(first, last, strict=False)), np.uint64, len(last)
    )


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and the 64-bit ``fp`` of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(shingle_hashes(t or "", width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, fp long")


def vantage(fps: np.ndarray, bits: int) -> tuple[np.uint64, int, float]:
    """A vantage point among the prints, the radius that parts them best, and the share of all pairs
    that is left to compare then. Prints on either side within ``bits`` of the radius are on both."""
    best = (np.uint64(0), 0, np.inf)
    for place in np.linspace(0, len(fps) - 1, TRIES).astype(np.int64).tolist():
        away = np.bincount(np.bitwise_count(fps ^ fps[place]), minlength=65 + bits)
        within = np.cumsum(away).astype(float)
        inner, outer = within[bits : 64 + bits], len(fps) - within[:64]
        work = inner**2 + outer**2
        radius = int(work.argmin())
        if work[radius] < best[2]:
            best = (fps[place], radius, float(work[radius]))
    return best[0], best[1], best[2] / len(fps) ** 2


class VantageTree:
    """Vantage points and radii by node; a leaf's number is a shard.

    By the triangle bound two prints within ``bits`` are both within a node's radius, or both beyond
    it, or the outer one is at most ``bits`` beyond; such a print goes down both branches, so every
    two close prints meet in a shard.
    """

    def __init__(self, sample: np.ndarray, rows: int, shard_rows: int, bits: int) -> None:
        points, radii, children = [], [], []
        waiting = [(np.sort(sample), -1, 0)]
        while waiting:
            own, parent, side = waiting.pop()
            number = len(points)
            if parent >= 0:
                children[parent][side] = number
            points.append(np.uint64(0))
            radii.append(0)
            children.append([-1, -1])
            if len(own) < 8 or len(own) * rows <= shard_rows * len(sample):
                continue
            point, radius, left = vantage(own, bits)
            if left > SPLITS:
                continue
            points[number], radii[number] = point, radius
            away = np.bitwise_count(own ^ point)
            waiting += [(own[away <= radius + bits], number, 0), (own[away > radius], number, 1)]
        self.bits = bits
        self.points, self.radii = np.array(points, np.uint64), np.array(radii, np.int64)
        self.children = np.array(children, np.int64)

    def shards(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prints, by place, and the shards they go to; all go down a level at once."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        rows, shards = [], []
        while len(row):
            leaf = self.children[node, 0] < 0
            rows.append(row[leaf])
            shards.append(node[leaf])
            row, node = row[~leaf], node[~leaf]
            away = np.bitwise_count(fps[row] ^ self.points[node]).astype(np.int64)
            inner, outer = away <= self.radii[node] + self.bits, away > self.radii[node]
            row, node = (
                np.concatenate([row[inner], row[outer]]),
                np.concatenate([self.children[node[inner], 0], self.children[node[outer], 1]]),
            )
        return np.concatenate(rows), np.concatenate(shards)


def linked_prints(
    prints: DataFrame, bits: int = 2, leaf_rows: int = LEAF_ROWS, shard_rows: int | None = None
) -> DataFrame:
    """Links ``(a, b)`` that join every two prints at ``bits`` or fewer differing bits.

    ``prints`` has a distinct ``fp`` and an ``id`` per row. A vantage-point tree of a sample, so many
    prints a shard, parts them into shards, and each shard's task parts its own with a tree of its
    own, down to leaves of ``leaf_rows`` that are compared. A leaf yields a tree per set of prints
    that its links connect, not all pairs. A shard far larger than meant is cut into block pairs.
    """
    rows = prints.count()
    shard_rows = shard_rows or min(max(rows // SHARDS, LEAST_SHARD), MOST_SHARD)
    wanted = min(-(-rows // shard_rows) * SAMPLE_A_SHARD, MOST_SAMPLE)
    sample = prints.select("fp").orderBy(F.xxhash64(F.lit("vantage"), "fp"), "fp").limit(wanted).toPandas()
    tree = VantageTree(sample["fp"].to_numpy(np.int64).view(np.uint64), rows, shard_rows, bits)
    shared = prints.sparkSession.sparkContext.broadcast(tree)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, shard = shared.value.shards(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(ids[row]), pa.array(fps[row])], names=["leaf", "id", "fp"]
            )

    def link(pdf):
        order = np.argsort(pdf["id"].to_numpy(), kind="stable")
        ids, fps = pdf["id"].to_numpy()[order], pdf["fp"].to_numpy()[order].view(np.uint64)
        a, b = shard_links(fps, bits, leaf_rows)
        return type(pdf)({"a": ids[a], "b": ids[b]})

    routed = prints.select("id", "fp").mapInArrow(leaves, "leaf long, id long, fp long")
    blocks = in_blocks(routed, ["leaf"], "id", 4 * shard_rows)
    return (
        blocks.select("leaf", "block_i", "block_j", "id", "fp")
        .groupBy("leaf", "block_i", "block_j")
        .applyInPandas(link, "a long, b long")
    )


def shard_links(fps: np.ndarray, bits: int, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard's prints, by place: a vantage-point tree down to leaves, which are compared."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting = [np.arange(len(fps))]
    while waiting:
        own = waiting.pop()
        point, radius, left = vantage(fps[own], bits) if len(own) > leaf_rows else (None, 0, np.inf)
        if left > SPLITS:
            a, b = tree_links(fps[own], bits)
            found_a.append(own[a])
            found_b.append(own[b])
            continue
        away = np.bitwise_count(fps[own] ^ point)
        waiting += [own[away <= radius + bits], own[away > radius]]
    return np.concatenate(found_a), np.concatenate(found_b)


def tree_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of connected prints, links of its members to the first of them."""
    left = np.arange(len(fps))
    members, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        head, left = left[0], left[1:]
        waiting = [head]
        while waiting and len(left):
            close = np.bitwise_count(fps[left] ^ fps[waiting.pop()]) <= bits
            if close.any():
                found, left = left[close], left[~close]
                waiting.extend(found)
                members.append(found)
                heads.append(np.full(len(found), head))
    return np.concatenate(members), np.concatenate(heads)


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the smallest ``doc_id`` reachable by links."""
    prepare(docs.sparkSession)
    prints = staged(fingerprints(docs, width), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    firsts = staged(firsts.where("id is not null"), "firsts")
    groups = connected_components(linked_prints(firsts, bits, leaf_rows))
    named = firsts.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")
    )
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
