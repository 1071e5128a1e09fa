"""Best-fit packing of tokenized documents into sequences, by merging underfull bins in a tree.

A document is its ids and an end id; only one longer than a sequence is cut. Null and empty texts
are the end id alone. Rows that repeat, or share a ``doc_id`` (null too), are packed each for itself.
Other columns are not read. An empty table gives no row.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare, staged
from shelfwise.llm.tokens import encoder, gathered

GROUP_BINS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, fill long, done boolean"


def token_pieces(docs: DataFrame, vocabulary: str, end: int, capacity: int) -> DataFrame:
    """The pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in gathered(batches):
            ids, lengths = encode(batch.column(1), end)
            rows: list[list] = [[], [], [], [], []]
            data, at = ids.astype("<u4").tobytes(), 0
            for doc_id, length in zip(batch.column(0).to_pylist(), lengths.tolist(), strict=True):
                for piece, start in enumerate(range(0, length, capacity)):
                    size = min(capacity, length - start)
                    check = zlib.crc32(data[4 * (at + start) : 4 * (at + start + size)])
                    for column, value in zip(rows, (doc_id, piece, start, size, check), strict=True):
                        column.append(value)
                at += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, PIECES)


def best_fit(fills: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item: largest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(fills), np.int64), np.zeros(len(fills), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has r tokens of room
    for item in np.argsort(-fills, kind="stable").tolist():
        size = int(fills[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, number, count = capacity, count, count + 1
        bins[item], offsets[item] = number, capacity - room
        by_room[room - size].append(number)
        rooms |= 1 << (room - size)
    return bins, offsets


def _merger(capacity: int, close: int, smallest: int):
    """Packs the bins of a group; a bin with ``close`` tokens, or too little room for any, is done."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="part")
        own = pdf.drop_duplicates("sequence_id").sort_values(["fill", "sequence_id"], ascending=[False, True])
        numbers, offsets = best_fit(own["fill"].to_numpy(), capacity)
        heads = own["sequence_id"].to_numpy()[offsets == 0]
        heads = heads[np.argsort(numbers[offsets == 0], kind="stable")]
        totals = np.bincount(numbers, own["fill"].to_numpy(), len(heads)).astype(np.int64)
        place = pd.Index(own["sequence_id"]).get_indexer(pdf["sequence_id"])
        number = numbers[place]
        return pdf.assign(
            sequence_id=heads[number], offset=pdf["offset"].to_numpy() + offsets[place], fill=totals[number],
            done=(totals[number] >= close) | (capacity - totals[number] < smallest),
        )

    return packed


def pack(pieces: DataFrame, capacity: int, group_bins: int = GROUP_BINS, nearly_full: float = 0.999) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; the ids are any numbers, offsets leave no gap.

    Groups of about ``group_bins`` bins are packed by best fit. Bins that are nearly full, or have
    less room than the smallest bin left, are done; the others are the items of the next round, with
    as many fewer groups, until one group holds them all. After a round that merges less than a
    tenth of them only bins of at most half a sequence go on, of which a group has one at most, with
    as many of the others, those with the most room: no two of the others fit together.
    """
    first = pieces.withColumn("sequence_id", F.monotonically_increasing_id())
    first = first.withColumn("offset", F.lit(0).cast("long")).withColumn("fill", F.col("length"))
    left = staged(first.withColumn("done", F.col("length") >= capacity), "pieces")
    finished = [left.where("done")]
    left, groups = left.where("not done"), None
    while True:
        bins, smallest = left.where("offset = 0").agg(F.count("*"), F.min("fill")).first()
        if not bins:
            break
        # Always fewer groups, so that bins that did not fit meet others.
        groups = max(1, min(-(-bins // group_bins), groups - 1)) if groups else -(-bins // group_bins)
        packed = _merger(capacity, int(capacity * nearly_full), smallest)
        part = F.pmod(F.xxhash64(F.lit(groups), "sequence_id"), F.lit(groups))
        merged = staged(
            left.withColumn("part", part).groupBy("part").applyInPandas(packed, PACKED), "packed"
        )
        after = merged.where("offset = 0").count()
        if groups == 1:
            finished.append(merged)
            break
        finished.append(merged.where("done"))
        left = merged.where("not done")
        if after > 0.9 * bins:
            small = F.col("fill") * 2 <= capacity
            roomy = left.where(~small & (F.col("offset") == 0)).orderBy("fill", "sequence_id")
            roomy = roomy.limit(left.where(small & (F.col("offset") == 0)).count()).select("sequence_id")
            roomy = staged(roomy, "roomy")
            finished.append(left.where(~small).join(roomy, "sequence_id", "left_anti").select(*left.columns))
            others = left.where(~small).join(roomy, "sequence_id", "left_semi").select(*left.columns)
            left = left.where(small).unionByName(others)
    return functools.reduce(DataFrame.unionByName, finished).drop("fill", "done")


def packed_documents(docs: DataFrame, vocabulary: str, end: int, capacity: int) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` tokens."""
    prepare(docs.sparkSession)
    return pack(token_pieces(docs, vocabulary, end, capacity), capacity)
