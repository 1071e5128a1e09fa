"""Token ids in wavelet matrices: one compressed file per shard, readable without decoding it whole.

A shard holds whole documents in ascending ``doc_id`` order. Its ids are bit planes from the highest
bit down; each plane holds the ids in the order that the planes above leave, zeros first. With
sampled ranks a token is read, an id counted or its k-th place found in a step per plane.

Null and empty texts are one end id. Rows that share a ``doc_id`` stand next to each other, by text;
rows with a null ``doc_id`` come first. Other columns are not read. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare
from shelfwise.llm.tokens import encoder, gathered

SAMPLE = 512  # bits between two stored ranks
SHARD_TOKENS = 1 << 20
_HEADER = struct.Struct("<4sBQI")
_MAGIC = b"WVM1"
SHARDS = "part int, shard int, n_docs long, n_tokens long, file binary"


class WaveletMatrix:
    """Planes of packed bits with ranks sampled every ``SAMPLE`` bits."""

    def __init__(self, length: int, planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.length, self.planes, self.ranks = length, planes, ranks
        self.zeros = [length - int(r[-1]) for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        rest = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ranks = [], []
        for level in range(width - 1, -1, -1):
            ones = (rest & rest.dtype.type(1 << level)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            ranks.append(_sampled_ranks(planes[-1]))
            if level:
                rest = np.concatenate([rest[~ones], rest[ones]])
        return cls(len(ids), planes, ranks)

    def _rank(self, plane: int, place: int) -> int:
        """Ones before ``place``."""
        block = place // SAMPLE
        part = self.planes[plane][block * SAMPLE // 8 : (place + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[: place - block * SAMPLE]
        return int(self.ranks[plane][block]) + int(bits.sum())

    def access(self, place: int) -> int:
        value = 0
        for plane, zeros in enumerate(self.zeros):
            one = int(self.planes[plane][place // 8]) >> (place % 8) & 1
            value, ones = value << 1 | one, self._rank(plane, place)
            place = zeros + ones if one else place - ones
        return value

    def _interval(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id between two places stand below the last plane."""
        if symbol >> len(self.planes):
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self._rank(plane, start), self._rank(plane, end)
            if symbol >> (len(self.planes) - 1 - plane) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        first, last = self._interval(symbol, start, self.length if end is None else end)
        return last - first

    def select(self, symbol: int, number: int) -> int:
        """The place of occurrence ``number`` (from 0) of an id."""
        first, last = self._interval(symbol, 0, self.length)
        if not 0 <= number < last - first:
            raise IndexError(number)
        place = first + number
        for plane in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - plane) & 1
            place = self._select(plane, place - self.zeros[plane] if one else place, one)
        return place

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def _select(self, plane: int, number: int, one: int) -> int:
        before = self.ranks[plane].astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * SAMPLE, self.length) - before
        block = int(np.searchsorted(before, number, side="right")) - 1
        start = block * SAMPLE
        bits = np.unpackbits(self.planes[plane][start // 8 : start // 8 + SAMPLE // 8], bitorder="little")
        return start + int(np.flatnonzero(bits == one)[number - int(before[block])])

    def ids(self) -> np.ndarray:
        """All ids in order: each plane is undone, from the lowest bit up."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        below = np.zeros(self.length, kind)
        for plane in range(width - 1, -1, -1):
            ones = np.unpackbits(self.planes[plane], count=self.length, bitorder="little").astype(bool)
            here = np.empty(self.length, kind)
            here[~ones] = below[: self.zeros[plane]]
            here[ones] = below[self.zeros[plane] :] | kind(1 << (width - 1 - plane))
            below = here
        return below

    def to_bytes(self) -> bytes:
        packer = zstandard.ZstdCompressor(level=1)
        parts = [packer.compress(x.tobytes()) for pair in zip(self.planes, self.ranks, strict=True) for x in pair]
        sizes = np.array([len(p) for p in parts], "<u4").tobytes()
        return _HEADER.pack(_MAGIC, len(self.planes), self.length, SAMPLE) + sizes + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, width, length, sample = _HEADER.unpack_from(data)
        if magic != _MAGIC or sample != SAMPLE:
            raise ValueError("not a wavelet matrix of this format")
        sizes = np.frombuffer(data, "<u4", 2 * width, _HEADER.size)
        ends = np.cumsum(sizes.astype(np.int64)) + _HEADER.size + 8 * width
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [unpack(data[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
        planes = [np.frombuffer(p, np.uint8) for p in parts[::2]]
        return cls(length, planes, [np.frombuffer(p, "<u4") for p in parts[1::2]])


def _sampled_ranks(packed: np.ndarray) -> np.ndarray:
    """Ones before each multiple of ``SAMPLE``, and in all."""
    step = SAMPLE // 8
    padded = np.zeros(-(-len(packed) // step) * step, np.uint8)
    padded[: len(packed)] = packed
    ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: its documents and their lengths, then the wavelet matrix of all ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = zstandard.ZstdCompressor(level=1).compress(
        known.tobytes() + numbers.tobytes() + lengths.astype("<i8").tobytes()
    )
    return struct.pack("<II", len(doc_ids), len(head)) + head + WaveletMatrix.of(ids).to_bytes()


def open_shard(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    count, size = struct.unpack_from("<II", file)
    head = zstandard.ZstdDecompressor().decompress(file[8 : 8 + size])
    known = np.frombuffer(head, np.uint8, count)
    numbers = np.frombuffer(head, "<i8", count, count)
    lengths = np.frombuffer(head, "<i8", count, 9 * count)
    doc_ids = [int(n) if k else None for n, k in zip(numbers, known, strict=True)]
    return doc_ids, lengths, WaveletMatrix.from_bytes(file[8 + size :])


def shards(docs: DataFrame, vocabulary: str, end: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard with its ``file``. Shards are in ascending ``doc_id`` order by ``(part, shard)``.

    Documents are range-partitioned and sorted; a task closes a shard once it holds ``shard_tokens``.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        held, tokens, shard = [], 0, 0

        def closed() -> pa.RecordBatch:
            doc_ids = [d for ids, _, _ in held for d in ids]
            lengths = np.concatenate([x for _, x, _ in held])
            file = pack_shard(doc_ids, lengths, np.concatenate([x for _, _, x in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(doc_ids)]),
                 pa.array([tokens]), pa.array([file], pa.binary())],
                names=["part", "shard", "n_docs", "n_tokens", "file"],
            )

        for batch in gathered(batches):
            ids, lengths = encode(batch.column(1), end)
            held.append((batch.column(0).to_pylist(), lengths, ids))
            tokens += len(ids)
            if tokens >= shard_tokens:
                yield closed()
                held, tokens, shard = [], 0, shard + 1
        if held:
            yield closed()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS)


def write_shards(docs: DataFrame, vocabulary: str, end: int, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write every shard as a file of its own below ``path``. The planes are compressed already."""
    (
        shards(docs, vocabulary, end, shard_tokens).write.option("compression", "uncompressed")
        .option("maxRecordsPerFile", 1).parquet(path)
    )


def read_shards(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, read from shard files.

    ``start`` is the number of ids in all shards and documents before it: running sums of the shards
    within their part, and of the parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, lengths, matrix = open_shard(file)
                data = matrix.ids().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc_ids), pa.int32()), pa.array([shard] * len(doc_ids), pa.int32()),
                     pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    schema = "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long"
    documents = files.select("part", "shard", "file").mapInArrow(run, schema)
    sizes = files.select("part", "shard", "n_tokens")
    before = (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("in_part")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    starts = sizes.select("part", "shard", before).join(parts, "part")
    return documents.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("in_part") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
