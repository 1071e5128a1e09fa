"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of a label and length are scaled to length one and rotated, and cut into blocks of a few
dimensions. A pair within squared distance ``2 - 2 * cosine`` is, in at least one block, within that
block's share of it. Each block is range-joined: levels halve the rows at the median of one of its
coordinates and copy those within the block's radius over the border. Every candidate is verified
by its cosine in double precision.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label,
link with nothing. Equal vectors of a label are one class, compared once; each of its members
counts as a vector, also where a ``vec_id`` repeats. A null ``vec_id`` in a class of its own has a
null component. Other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare, staged
from shelfwise.llm.components import connected_components
from shelfwise.llm.leaves import in_blocks, levels_for, route

LEAF_ROWS = 1024
BLOCK_DIMENSIONS = 8
# Cuts of a coordinate, in the order in which levels use them: the median first, then the quarters.
QUANTILES = (0.5, 0.25, 0.75)


@functools.lru_cache(maxsize=8)
def rotation(dimensions: int) -> np.ndarray:
    drawn = np.random.default_rng(dimensions).standard_normal((dimensions, dimensions))
    return np.linalg.qr(drawn)[0]


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors after the rotation. Summed in a fixed order: a vector has the same coordinates
    whatever other rows stand beside it, so all tasks decide alike."""
    turn = rotation(vectors.shape[1])
    unit = vectors / np.sqrt(_ordered_sum(vectors * vectors))[:, None]
    result = np.zeros_like(unit)
    for place in range(unit.shape[1]):
        result += unit[:, place, None] * turn[place]
    return result


def _ordered_sum(values: np.ndarray) -> np.ndarray:
    total = np.zeros(values.shape[0])
    for place in range(values.shape[1]):
        total += values[:, place]
    return total


def _blocks(dimensions: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMENSIONS, dimensions)) for a in range(0, dimensions, BLOCK_DIMENSIONS)]


def _budget(block: slice, dimensions: int, cosine: float) -> float:
    """The block's share of the squared distance, with room for rounding."""
    return (2 - 2 * cosine) * (block.stop - block.start) / dimensions * (1 + 1e-9) + 1e-12


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``embedding`` of the vectors that can link."""
    value = F.col("embedding").cast("array<double>")
    wrong = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(value, lambda x: x != 0)
    return vectors.where("label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", value.alias("embedding")
    ).where(~wrong & nonzero)


def _cuts(classes: DataFrame, levels: int) -> dict[int, list[list[tuple[int, float]]]]:
    """For each length of vectors and block, the (coordinate, value) at which each level cuts.

    The values are quantiles over all vectors of the length, read coordinate by coordinate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows in _by_length(batch.column(0).to_pylist()):
                turned = rotated(rows[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(turned), pa.int64()), pa.array(list(turned), pa.list_(pa.float64()))],
                    names=["size", "turned"],
                )

    cuts: dict[int, list[list[tuple[int, float]]]] = {}
    coordinates = classes.select("embedding").mapInArrow(run, "size long, turned array<double>")
    for row in classes.select(F.size("embedding").alias("size")).distinct().collect():
        size = row["size"]
        order = [
            [(c, q) for q in QUANTILES for c in range(b.start, b.stop)][:levels] for b in _blocks(size)
        ]
        wanted = sorted({c for block in order for c, _ in block})
        if not wanted:
            cuts[size] = [[] for _ in order]
            continue
        values = coordinates.where(F.col("size") == size).agg(
            *[F.percentile_approx(F.col("turned")[c], list(QUANTILES), 1000).alias(f"c{c}") for c in wanted]
        ).first()
        cuts[size] = [
            [(c, values[f"c{c}"][QUANTILES.index(q)]) for c, q in block] for block in order
        ]
    return cuts


def _by_length(vectors: list[list[float]]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    sizes = np.array([len(v) for v in vectors], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), (rows, np.array([vectors[i] for i in rows], float))


ROUTED = "label long, size long, dim_block int, leaf long, home long, cls long, members long, vector binary"


def linked_classes(classes: DataFrame, cosine: float, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``cls``, ``links`` and ``head`` from classes ``(cls, label, members, embedding)``.

    ``links`` counts the members of other classes linked to a class, in parts to be added; ``head``
    is a class it is connected with. A pair is counted once: in the first block whose budget it
    meets, and there in the leaf of the levels at which both are outside.
    """
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    levels = min(levels_for(largest, leaf_rows), len(QUANTILES) * BLOCK_DIMENSIONS)
    cuts = _cuts(classes, levels)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, label, members, vectors = (batch.column(i) for i in range(4))
            for size, (rows, values) in _by_length(vectors.to_pylist()):
                turned = rotated(values)
                binary = np.array([v.tobytes() for v in values], dtype=object)
                for number, block in enumerate(_blocks(size)):
                    radius = _budget(block, size, cosine) ** 0.5
                    outer = [turned[:, c] > cut for c, cut in cuts[size][number]]
                    near = [(turned[:, c] > cut) & (turned[:, c] <= cut + radius) for c, cut in cuts[size][number]]
                    row, leaf = route(outer, near, len(rows))
                    home = sum((o.astype(np.int64) << i for i, o in enumerate(outer)), np.zeros(len(rows), np.int64))
                    at = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays(
                        [label.take(at), pa.array(np.full(len(row), size, np.int64)),
                         pa.array(np.full(len(row), number, np.int32)), pa.array(leaf), pa.array(home[row]),
                         cls.take(at), members.take(at), pa.array(binary[row].tolist(), pa.binary())],
                        names=["label", "size", "dim_block", "leaf", "home", "cls", "members", "vector"],
                    )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return _linked(pdf, cosine)

    keys = ["label", "size", "dim_block", "leaf"]
    source = classes.select("cls", F.col("label").cast("long").alias("label"), "members", "embedding")
    routed = in_blocks(source.mapInArrow(leaves, ROUTED), keys, "cls", 4 * leaf_rows)
    return routed.groupBy(*keys, "block_i", "block_j").applyInPandas(join, "cls long, links long, head long")


def _linked(pdf: pd.DataFrame, cosine: float, rows_at_once: int = 256) -> pd.DataFrame:
    pdf = pdf.sort_values("cls")
    cls, members, home, part = (pdf[c].to_numpy() for c in ("cls", "members", "home", "block"))
    vectors = np.array([np.frombuffer(v) for v in pdf["vector"]])
    number, leaf = int(pdf["dim_block"].iloc[0]), int(pdf["leaf"].iloc[0])
    across = pdf["block_i"].iloc[0] != pdf["block_j"].iloc[0]
    dimensions, turned = vectors.shape[1], rotated(vectors)
    blocks = _blocks(dimensions)
    own = np.ascontiguousarray(turned[:, blocks[number]])
    squares, lengths = (own * own).sum(axis=1), np.sqrt((vectors * vectors).sum(axis=1))
    budget = _budget(blocks[number], dimensions, cosine)
    links, heads = np.zeros(len(cls), np.int64), np.arange(len(cls))

    def close(a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        part = blocks[block]
        return _ordered_sum((turned[a, part] - turned[b, part]) ** 2) <= _budget(part, dimensions, cosine)

    for start in range(0, len(cls), rows_at_once):
        rows = slice(start, start + rows_at_once)
        apart = squares[rows, None] + squares[None, start:] - 2 * (own[rows] @ own[start:].T)
        a, b = np.nonzero(np.triu(apart <= budget + 1e-9, 1))
        a, b = a + start, b + start
        for test in (
            lambda a, b: (home[a] & home[b]) == leaf,
            lambda a, b: (part[a] != part[b]) | (not across),
            lambda a, b: close(a, b, number),
            lambda a, b: np.einsum("ij,ij->i", vectors[a], vectors[b]) / (lengths[a] * lengths[b]) >= cosine,
            *[lambda a, b, block=block: ~close(a, b, block) for block in range(number)],
        ):
            kept = test(a, b)
            a, b = a[kept], b[kept]
        np.add.at(links, a, members[b])
        np.add.at(links, b, members[a])
        for at in np.unique(a):
            joined = np.unique(np.concatenate([heads[b[a == at]], heads[[at]]]))
            heads[np.isin(heads, joined)] = joined[0]
    some = links > 0
    return pd.DataFrame({"cls": cls[some], "links": links[some], "head": cls[heads[some]]})


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors``."""
    prepare(vectors.sparkSession)
    members = usable(vectors)
    classes = members.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("cls"), F.count("*").alias("members")
    )
    classes = staged(classes.where("cls is not null"), "classes")
    # A vec_id that names two different vectors heads two classes; their links are then added up.
    found = staged(linked_classes(classes, cosine, leaf_rows), "links")
    groups = connected_components(found.select(F.col("cls").alias("a"), F.col("head").alias("b")))
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = (
        classes.join(counted, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "label", "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "cls").alias("component_id"),
        )
    )
    linking = members.join(named, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    value = F.col("embedding").cast("array<double>")
    wrong = F.coalesce(
        F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(value, lambda x: x != 0)
        | F.col("label").isNull(), F.lit(True),
    )
    alone = vectors.where(wrong).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"),
    )
    every = linking.unionByName(alone)
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
