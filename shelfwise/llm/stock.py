"""Packing as a cutting-stock problem: a linear program over the histogram of lengths, by column
generation.

A document is its ids and an end id. Pieces of a whole sequence are cut from its front; what remains,
shorter than a sequence, is an item. Only the histogram of item lengths, as many numbers as a
sequence has tokens, reaches the driver, whatever the number of documents. There a linear program
chooses patterns: which lengths share a sequence, and how often. New patterns are priced by a knapsack
over the dual values. The program is rounded down, and the ranked documents of each length take the
places of the plan. Items that no pattern holds lie one after the other on a tape, cut where a
sequence ends; the program's price is the number of those cuts.

A sequence is padded to the capacity unless its fill is one of ``unpadded``. Only the tape's last
sequence can be padded where no pattern is; with 1 among ``unpadded`` it is not.

Null and empty texts are the end id alone. Rows that repeat, or share a ``doc_id`` (null too), are
packed each for itself. Other columns are not read. An empty table gives no row.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare, staged
from shelfwise.llm.tokens import encoder, gathered, ragged

PADDING_PRICE = 2.0  # of a token of padding, in cuts
SHORT_PRICE = 1.0  # of a sequence shorter than the capacity, in cuts, by the share it lacks
GAP = 1e-3  # the program ends this near, in cuts a sequence, to the least possible
CANDIDATES = 200  # columns tried after one knapsack
PIVOTS = 0.5  # steps of the simplex method at most, by row; the plan is complete at any of them
ITEMS = "row long, part int, rank long, doc_id long, doc_tokens long, start long, length int, ids binary"
PLACED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def powers_of_two(capacity: int) -> tuple[int, ...]:
    return tuple(1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity)


@dataclasses.dataclass(frozen=True)
class Pattern:
    """Sequences that hold so many items of each length in ``takes``, ``times`` of them."""

    takes: dict[int, int]
    times: int = 0

    @property
    def fill(self) -> int:
        return sum(length * count for length, count in self.takes.items())


class Program:
    """The linear program. Every item is in a pattern or on the tape: items one after the other, cut
    wherever a sequence ends. The price of a pattern is its padding, that of the tape its cuts."""

    def __init__(self, histogram: np.ndarray, capacity: int, unpadded: tuple[int, ...]) -> None:
        """``histogram[r]`` is the number of items of length ``r``, from 0 to ``capacity - 1``."""
        self.capacity = capacity
        self.fills = np.array(sorted({*unpadded, capacity}))
        self.lengths = np.flatnonzero(histogram)
        self.rows = {length: row for row, length in enumerate(self.lengths.tolist())}
        # Small differences keep the steps from stalling on equal ratios; rounding down removes them.
        self.demand = histogram[self.lengths] + np.random.default_rng(0).uniform(1e-4, 1e-3, len(self.lengths))
        self.columns: list[Pattern | None] = [None] * len(self.lengths)  # None: the length on the tape
        self.prices = self.lengths / capacity

    def price(self, fill: int) -> float:
        if fill in self.fills:
            return SHORT_PRICE * (1 - fill / self.capacity)
        return PADDING_PRICE * (self.capacity - fill)

    def _vector(self, pattern: Pattern) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array([self.rows[length] for length in pattern.takes])
        return rows, np.array(list(pattern.takes.values()), float)

    def _first_basis(self) -> np.ndarray:
        """Full patterns of the largest lengths that are left, each used until one of them runs out,
        and the tape for the others: a triangular basis, which cannot be singular."""
        basis, left = np.eye(len(self.lengths)), self.demand.copy()
        held = np.zeros(self.capacity + 1)
        held[self.lengths] = left
        while held.any():
            takes = greedy(held, self.capacity)
            pattern = Pattern(takes)
            if pattern.fill < self.capacity:
                held[max(takes)] = 0.0  # stays on the tape
                continue
            uses = {length: held[length] / count for length, count in takes.items()}
            out = min(uses, key=uses.__getitem__)
            for length, count in takes.items():
                held[length] = max(held[length] - count * uses[out], 0.0)
            held[out] = 0.0
            rows, counts = self._vector(pattern)
            column = self.rows[out]
            basis[:, column] = 0.0
            basis[rows, column] = counts
            self.columns[column], self.prices[column] = pattern, 0.0
        return basis

    def _improving(self, dual: np.ndarray) -> tuple[list[Pattern], float]:
        """Patterns worth more than their price at the dual values, best first: the knapsack's best
        for each fill, and for each length the best that holds it. Also the factor by which the dual
        values, with a sequence for its tokens, exceed the prices: a bound of what is left to gain."""
        capacity, lengths = self.capacity, self.lengths
        worth, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
        worth[0] = 0.0
        padded = np.full(capacity + 1, -np.inf)
        padded[lengths] = dual
        for fill in range(int(lengths[0]), capacity + 1):
            values = worth[fill - 1 :: -1] + padded[1 : fill + 1]
            last[fill] = best = int(values.argmax())
            worth[fill] = values[best]

        def pattern(fill: int, takes: dict[int, int]) -> Pattern:
            while fill:
                length = int(last[fill]) + 1
                takes[length] = takes.get(length, 0) + 1
                fill -= length
            return Pattern(takes)

        prices = np.array([np.inf, *map(self.price, range(1, capacity + 1))])
        gains = worth - prices
        through = dual + worth[capacity - lengths] - prices[capacity]
        found = [(float(gains[fill]), fill, 0) for fill in np.argsort(-gains)[:CANDIDATES].tolist()]
        found += [
            (float(through[row]), capacity - int(lengths[row]), int(lengths[row]))
            for row in np.argsort(-through)[:CANDIDATES].tolist()
        ]
        found = sorted((f for f in found if f[0] > 1e-9), reverse=True)
        share = np.arange(1, capacity + 1) / capacity
        factor = float(np.max((worth[1:] + share) / (prices[1:] + share)))
        return [pattern(fill, {length: 1} if length else {}) for _, fill, length in found], factor

    def solve(self) -> list[tuple[Pattern, float]]:
        """Patterns of the last basis and how often each is used; the rest is on the tape."""
        if not len(self.lengths):
            return []
        basis = self._first_basis()
        inverse = np.linalg.inv(basis)
        amounts = np.maximum(inverse @ self.demand, 0.0)
        pivots = 0
        sequences = float(self.lengths @ self.demand) / self.capacity
        while (cuts := self.prices @ amounts) > GAP * sequences and pivots < PIVOTS * len(self.lengths):
            improved = False
            found, factor = self._improving(self.prices @ inverse)
            if (sequences + cuts) * (1 - 1 / max(factor, 1.0)) < GAP * sequences:
                break
            for pattern in found:
                rows, counts = self._vector(pattern)
                direction, price = inverse[:, rows] @ counts, self.price(pattern.fill)
                if self.prices @ direction - price <= 1e-9:
                    continue  # no longer, after the columns before it
                usable = direction > 1e-9
                ratios = np.where(usable, amounts / np.where(usable, direction, 1.0), np.inf)
                out = int(ratios.argmin())
                amounts = np.maximum(amounts - ratios[out] * direction, 0.0)
                amounts[out] = ratios[out]
                scaled = inverse[out] / direction[out]
                direction[out] = 0.0
                inverse -= np.outer(direction, scaled)
                inverse[out] = scaled
                basis[:, out] = 0.0
                basis[rows, out] = counts
                self.columns[out], self.prices[out] = pattern, price
                improved, pivots = True, pivots + 1
                if pivots % 200 == 0:  # undo rounding errors
                    inverse = np.linalg.inv(basis)
                    amounts = np.maximum(inverse @ self.demand, 0.0)
            if not improved:
                break
        return [(p, a) for p, a in zip(self.columns, amounts.tolist(), strict=True) if p]


def greedy(held: np.ndarray, capacity: int) -> dict[int, int]:
    """A sequence of the largest lengths held, the last two of which fill it exactly if any two do."""
    takes: dict[int, int] = {}
    room = capacity
    while len(lengths := np.flatnonzero(held[: room + 1] > 0)):
        length = int(lengths[-1])
        if takes and 2 * length >= room > length and len(pairs := lengths[np.isin(room - lengths, lengths)]):
            length = int(pairs[-1])
        if takes.get(length, 0) + 1 > np.ceil(held[length]):  # no more of this length
            held = np.where(np.arange(len(held)) == length, 0, held)
            continue
        takes[length] = takes.get(length, 0) + 1
        room -= length
    return takes


def plan(histogram: np.ndarray, capacity: int, unpadded: tuple[int, ...]) -> list[Pattern]:
    """Patterns and how often each is used: the program rounded down, then full patterns of what is
    left. What they leave is for the tape."""
    patterns, left = [], np.append(histogram.astype(np.int64), 0)

    def use(pattern: Pattern, most: int | None = None) -> None:
        times = min(int(left[length]) // count for length, count in pattern.takes.items())
        times = times if most is None else min(times, most)
        if times > 0:
            for length, count in pattern.takes.items():
                left[length] -= count * times
            patterns.append(dataclasses.replace(pattern, times=times))

    for pattern, amount in Program(histogram, capacity, unpadded).solve():
        use(pattern, int(amount + 1e-6))
    open_lengths = left.copy()
    while open_lengths.any():
        pattern = Pattern(greedy(open_lengths, capacity))
        if pattern.fill == capacity:
            use(pattern)
            open_lengths = np.minimum(open_lengths, left)
        else:
            open_lengths[max(pattern.takes)] = 0
    return patterns


class Places:
    """The plan as ranges of ranks: where the item of a length with a rank lies."""

    def __init__(self, patterns: list[Pattern], histogram: np.ndarray, capacity: int, unpadded: tuple[int, ...]) -> None:
        self.capacity = capacity
        taken, rows, sequences = np.zeros(len(histogram), np.int64), [], 0
        for pattern in patterns:
            offset = 0
            for length, count in sorted(pattern.takes.items(), reverse=True):
                rows.append((length, int(taken[length]), count, sequences, offset))
                taken[length] += count * pattern.times
                offset += count * length
            sequences += pattern.times
        self.first_on_tape, at = sequences, 0
        for length in np.flatnonzero(histogram > taken).tolist():
            rows.append((length, int(taken[length]), 0, 0, at))
            at += length * int(histogram[length] - taken[length])
        # The tape's last sequences: unpadded fills from the largest down, or one padded sequence.
        self.full, rest = divmod(at, capacity)
        ends = [self.full * capacity]
        while rest:
            fill = max((f for f in unpadded if f <= rest), default=rest)
            ends.append(ends[-1] + fill)
            rest -= fill
        self.ends = np.array(ends, np.int64)
        self.sequences = sequences + self.full + len(ends) - 1
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = (table[:, 0] << 42) + table[:, 1]
        self.first, self.count, self.base, self.offset = table[:, 1:].T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of the items: the item, the start in it, length, sequence and offset of each."""
        use = np.searchsorted(self.keys, (length << 42) + rank, side="right") - 1
        after, count = rank - self.first[use], self.count[use]
        kept, taped = np.flatnonzero(count > 0), np.flatnonzero(count == 0)
        turn, slot = np.divmod(after[kept], count[kept])
        kept_places = (
            kept, np.zeros(len(kept), np.int64), length[kept], self.base[use[kept]] + turn,
            self.offset[use[kept]] + slot * length[kept],
        )
        size = length[taped]
        begin = self.offset[use[taped]] + after[taped] * size
        first, last = self._sequence(begin), self._sequence(begin + size - 1)
        pieces = last - first + 1
        number = np.repeat(first, pieces) + np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low, high = self._bounds(number)
        item, begin, end = np.repeat(taped, pieces), np.repeat(begin, pieces), np.repeat(begin + size, pieces)
        start = np.maximum(begin, low)
        tape_places = (item, start - begin, np.minimum(end, high) - start, self.first_on_tape + number, start - low)
        return tuple(np.concatenate(pair) for pair in zip(kept_places, tape_places, strict=True))

    def _sequence(self, place: np.ndarray) -> np.ndarray:
        """The number of the tape's sequence that holds a token."""
        tail = self.full + np.searchsorted(self.ends, place, side="right") - 1
        return np.where(place < self.full * self.capacity, place // self.capacity, tail)

    def _bounds(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tail = np.clip(number - self.full, 0, max(len(self.ends) - 2, 0))
        low = np.where(number < self.full, number * self.capacity, self.ends[tail])
        after = self.ends[np.minimum(tail + 1, len(self.ends) - 1)]
        return low, np.where(number < self.full, low + self.capacity, after)


def items(docs: DataFrame, vocabulary: str, end: int, capacity: int) -> DataFrame:
    """Whole sequences and the items of every document, with their ids.

    ``row`` is a number of its own; ``rank`` counts the items of one length within their ``part``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        seen, row = np.zeros(capacity + 1, np.int64), 0
        for batch in gathered(batches):
            ids, tokens = encode(batch.column(1), end)
            count = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), count)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = number * capacity
            length = np.minimum(tokens[doc] - start, capacity)
            # The rank of each piece among those of its length.
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            bounds = pa.array(np.concatenate([[0], 4 * np.cumsum(length)]), pa.int64())
            data = pa.Array.from_buffers(
                pa.large_binary(), len(doc), [None, bounds.buffers()[1], pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 33) + row + np.arange(len(doc))), pa.array(np.full(len(doc), part, np.int32)),
                 pa.array(rank), batch.column(0).take(pa.array(doc)), pa.array(tokens[doc]), pa.array(start),
                 pa.array(length.astype(np.int32)), data.cast(pa.binary())],
                names=["row", "part", "rank", "doc_id", "doc_tokens", "start", "length", "ids"],
            )
            row += len(doc)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ITEMS)


def pack(pieces: DataFrame, capacity: int, unpadded: tuple[int, ...]) -> DataFrame:
    """Place the rows of ``items``: pieces with their ids, ``sequence_id`` and ``offset``.

    Sequence ids are any numbers; offsets leave no gap.
    """
    kept = staged(pieces, "items")
    counts = staged(kept.where(F.col("length") < capacity).groupBy("part", "length").count(), "counts")
    histogram = np.zeros(capacity, np.int64)
    for length, count in counts.groupBy("length").agg(F.sum("count")).collect():  # fewer rows than the capacity
        histogram[length] = count
    places = Places(plan(histogram, capacity, unpadded), histogram, capacity, unpadded)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    ranked = kept.join(counts.select("part", "length", before.alias("before")), ["part", "length"], "left")
    ranked = ranked.select(
        "row", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "doc_id", "doc_tokens", "start", "length", "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rank, start, length = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 4, 5))
            whole = np.flatnonzero(length == capacity)
            rest = np.flatnonzero(length < capacity)
            item, inside, size, sequence, offset = places.of(length[rest], rank[rest])
            item = np.concatenate([whole, rest[item]])
            inside = np.concatenate([np.zeros(len(whole), np.int64), inside])
            size = np.concatenate([length[whole], size])
            sequence = np.concatenate([places.sequences + row[whole], sequence])
            offset = np.concatenate([np.zeros(len(whole), np.int64), offset])
            data = batch.column(6).cast(pa.large_binary())
            bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            values = np.frombuffer(data.buffers()[2], "<u4")
            ids = ragged(values, bounds[:-1][item] // 4 + inside, size)
            cuts = pa.array(np.concatenate([[0], 4 * np.cumsum(size)]), pa.int64())
            out = pa.Array.from_buffers(
                pa.large_binary(), len(item), [None, cuts.buffers()[1], pa.py_buffer(np.ascontiguousarray(ids))]
            )
            take = pa.array(item)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(take), pa.array(start[item] + inside), pa.array(size), out.cast(pa.binary()),
                 batch.column(3).take(take), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, PLACED)


def packed_documents(
    docs: DataFrame, vocabulary: str, end: int, capacity: int, unpadded: tuple[int, ...] = ()
) -> DataFrame:
    """Every document's pieces with their ids and their places in sequences of ``capacity`` tokens."""
    prepare(docs.sparkSession)
    return pack(items(docs, vocabulary, end, capacity), capacity, unpadded)
