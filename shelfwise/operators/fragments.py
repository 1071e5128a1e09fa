"""Which names hold which fragments, through a sorted table of the names' suffixes.

A name holds a fragment if one of its suffixes starts with it. The suffixes of all names are dealt
out by range and sorted, and a fragment, which is a range of prefixes, is sent to the ranges it
touches and found there by binary search. So a name is one row per letter, whatever the fragments.

Only suffixes that start with a fragment, by flags of the fragments' hashes and lengths, are sorted
and sent; a flag may be set by chance, so the search itself decides.

A name that holds a fragment several times must count once. Of a name's own sorted suffixes each
knows how many letters it ``shared`` with the next one, and counts for longer fragments only: of all
its suffixes that start with a fragment exactly the last one counts, wherever the others are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import cut_lineage

GROUP_ROWS = 1_000_000  # suffixes that one task sorts
SAMPLE_NAMES = 2_000  # names whose suffixes set the borders of the ranges
SAMPLE_SUFFIXES = 50  # of each of them
FLAGS_EACH = 16  # flags for one fragment of a length
MOST_FLAGS = 2**26  # of one length: 8 MB
PIECE = 2**16  # bytes of flags in one row
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))


def suffixes(name: str, longest: int, starts: list[int] | None = None) -> list[tuple[str, int]]:
    """The suffixes that can count, cut to ``longest`` letters, and what each shares with the next.

    With ``starts`` only the suffixes from there; all that start with a fragment must be among them.
    """
    places = range(len(name)) if starts is None else starts
    own = sorted(name[at : at + longest] for at in places) or [""]
    out = []
    for text, after in zip(own, own[1:], strict=False):
        shared, most = 0, min(len(text), len(after))
        while shared < most and text[shared] == after[shared]:
            shared += 1
        if shared < len(text):
            out.append((text, shared))
    out.append((own[-1], -1))
    return out


class Letters:
    """The letters of several texts in one array, with the hash of any run of them.

    A run's hash is a polynomial of its letters: a difference of two running sums, moved to its place.
    """

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(text) for text in texts], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        powers = np.full(len(codes) + 1, BASE)
        powers[0] = 1
        back = np.full(len(codes) + 1, UNBASE)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * np.cumprod(powers)[:-1], out=self.sums[1:])
        self.end = np.repeat(self.first + self.sizes, self.sizes)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        found = (self.sums[at + size] - self.sums[at]) * self.back[at]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(32))


def _both(hashes: np.ndarray, flags: int) -> tuple[np.ndarray, np.ndarray]:
    """The two flags of each hash; ``flags`` is a power of two."""
    mask = np.uint64(flags - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


class Flags:
    """For each length of a fragment which hashes there may be: two of its flags are set."""

    def __init__(self, sizes: dict[int, int], pieces: list[tuple[int, int, bytes]]) -> None:
        self.packed = {size: np.zeros(flags // 8, np.uint8) for size, flags in sizes.items()}
        for size, piece, text in pieces:
            self.packed[size][piece * PIECE : piece * PIECE + len(text)] |= np.frombuffer(text, np.uint8)

    def _set(self, size: int, flag: np.ndarray) -> np.ndarray:
        return (self.packed[size][flag >> 3] >> (flag & 7).astype(np.uint8)) & 1 == 1

    def starts(self, texts: list[str]) -> list[list[int]]:
        """Where in each text a fragment may start; an empty one does so anywhere, once."""
        letters = Letters(texts)
        kept = np.zeros(len(letters.end), bool)
        for size, packed in self.packed.items():
            if size == 0:
                kept[letters.first[letters.sizes > 0]] = True
                continue
            at = np.flatnonzero(letters.end - np.arange(len(kept)) >= size)
            one, other = _both(letters.hashes(at, size), 8 * len(packed))
            at, other = at[hit := self._set(size, one)], other[hit]
            kept[at[self._set(size, other)]] = True
        places = np.flatnonzero(kept)
        cuts = np.searchsorted(places, letters.first[1:])
        return [(part - first).tolist() for part, first in zip(np.split(places, cuts), letters.first, strict=True)]


def _flags(fragments: DataFrame) -> Flags:
    """The flags of all fragments: set by the tasks that read them, at most ``MOST_FLAGS`` a length."""
    counts = fragments.groupBy(F.length("_fragment").alias("size")).agg(F.count("*").alias("n")).collect()
    sizes = {r["size"]: min(max(2 ** (int(r["n"]) * FLAGS_EACH - 1).bit_length(), 64), MOST_FLAGS) for r in counts}

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = {}
        for batch in batches:
            by_size = batch["_fragment"].groupby(batch["_fragment"].str.len())
            for size, texts in by_size:
                own = packed.setdefault(size, np.zeros(sizes[size], bool))
                letters = Letters(texts.tolist())
                if size:
                    for flag in _both(letters.hashes(letters.first, size), sizes[size]):
                        own[flag] = True
        for size, own in packed.items():
            text = np.packbits(own, bitorder="little").tobytes()
            pieces = [(size, n, text[n * PIECE : (n + 1) * PIECE]) for n in range(-(-len(text) // PIECE))]
            yield pd.DataFrame([p for p in pieces if any(p[2])], columns=["size", "piece", "flags"])

    def united(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.bitwise_or.reduce([np.frombuffer(text, np.uint8) for text in rows["flags"]])
        return rows.head(1).assign(flags=[flags.tobytes()])

    schema = "size int, piece int, flags binary"
    pieces = fragments.select("_fragment").mapInPandas(bits, schema).groupBy("size", "piece")
    return Flags(sizes, [tuple(row) for row in pieces.applyInPandas(united, schema).collect()])


class Ranges:
    """Borders between ranges of suffixes, and in how many groups the names of a range are dealt."""

    def __init__(self, sample: list[str], rows: int, group_rows: int) -> None:
        sample = sorted(sample) or [""]
        wanted = -(-rows // group_rows)
        self.borders = sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)})
        held = np.bincount([self.place(text) for text in sample], minlength=len(self.borders) + 1)
        # A suffix that many names end with cannot be parted by range.
        self.groups = np.maximum(1, np.ceil(held / len(sample) * wanted)).astype(int).tolist()

    def place(self, text: str) -> int:
        return bisect_right(self.borders, text)

    def touched(self, fragment: str) -> range:
        last = bisect_right(self.borders, fragment, key=lambda border: border[: len(fragment)])
        return range(self.place(fragment), last + 1)


def _dealt(names: DataFrame, fragments: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes with the other columns of ``names``, and fragments, by ``range`` and ``group``."""
    longest, rows = fragments.agg(F.max(F.length("_fragment"))).first()[0] or 0, 0
    rows = names.agg(F.sum(F.length("_name") + 1)).first()[0] or 0
    some = names.select("_name").orderBy(F.xxhash64("_name"), "_name").limit(SAMPLE_NAMES).collect()
    some = [row[0] for row in some]
    flags = _flags(fragments)
    own = flags.starts(some)
    sample = [
        name[at : at + longest]
        for name, starts in zip(some, own, strict=True)
        for at in starts[:: max(1, -(-len(starts) // SAMPLE_SUFFIXES))] or [0]
    ]
    # Of the letters of the names, those that a fragment starts at.
    letters = sum(map(len, some)) + len(some)
    rows = int(rows * sum(max(1, len(starts)) for starts in own) / max(1, letters)) + 1
    ranges = Ranges(sample, rows, group_rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_name"].tolist()
            own = [suffixes(t, longest, at) for t, at in zip(texts, flags.starts(texts), strict=True)]
            row = np.repeat(np.arange(len(batch)), [len(s) for s in own])
            texts = [text for s in own for text, _ in s]
            place = np.array([ranges.place(text) for text in texts], np.int64)
            out = batch.iloc[row].reset_index(drop=True)
            out["_suffix"], out["_shared"] = texts, [shared for s in own for _, shared in s]
            out["_range"] = place
            out["_group"] = out["_deal"] % np.array(ranges.groups)[place]
            yield out.drop(columns="_deal")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (place, group, fragment)
                for fragment in batch["_fragment"]
                for place in ranges.touched(fragment)
                for group in range(ranges.groups[place])
            ]
            yield pd.DataFrame(rows, columns=["_range", "_group", "_fragment"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema)
    dealt = names.withColumn("_deal", F.pmod(F.xxhash64("_name"), F.lit(2**31)))
    return (
        dealt.mapInPandas(cut, f"{columns}, _suffix string, _shared int, _range long, _group long"),
        fragments.select("_fragment").mapInPandas(spread, "_range long, _group long, _fragment string"),
    )


def _found(texts: pd.DataFrame, fragments: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """Each fragment with the rows of the suffixes that count for it."""
    order = sorted(range(len(texts)), key=texts["_suffix"].tolist().__getitem__)
    places = np.array(order, np.int64)
    ordered = texts["_suffix"].to_numpy()[places].tolist() if order else []
    shared = texts["_shared"].to_numpy()[places] if order else places
    for fragment in fragments["_fragment"]:
        size = len(fragment)
        first = bisect_left(ordered, fragment)
        # Behind the last text that starts with the fragment.
        last = bisect_right(ordered, fragment, lo=first, key=lambda text: text[:size])
        rows = places[first:last][shared[first:last] < size]
        if len(rows):
            yield fragment, rows


def holders(names: DataFrame, fragments: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``_fragment`` and ``_name`` of every name that holds a fragment: a row per pair."""
    names, fragments = cut_lineage(names.select("_name")), cut_lineage(fragments.select("_fragment"))
    texts, wanted = _dealt(names, fragments, group_rows)

    def pairs(texts: pd.DataFrame, fragments: pd.DataFrame) -> pd.DataFrame:
        found = list(_found(texts, fragments))
        rows = np.concatenate([r for _, r in found]) if found else np.zeros(0, np.int64)
        return pd.DataFrame({
            "_fragment": np.repeat(np.array([f for f, _ in found], object), [len(r) for _, r in found]),
            "_name": texts["_name"].to_numpy()[rows],
        })

    groups = texts.groupBy("_range", "_group").cogroup(wanted.groupBy("_range", "_group"))
    return groups.applyInPandas(pairs, "_fragment string, _name string")


def counts(names: DataFrame, fragments: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``n_matches`` of each fragment, the sum of ``_n`` of its names, and the ``_name`` of one.

    The pairs of fragments and names are never made: a group adds its names up.
    """
    names = cut_lineage(names.select("_name", "_n"))
    fragments = cut_lineage(fragments.select("_fragment"))
    texts, wanted = _dealt(names, fragments, group_rows)

    def added(texts: pd.DataFrame, fragments: pd.DataFrame) -> pd.DataFrame:
        held, own = texts["_n"].to_numpy(), texts["_name"].to_numpy()
        found = [(f, int(held[rows].sum()), own[rows[0]]) for f, rows in _found(texts, fragments)]
        return pd.DataFrame(found, columns=["_fragment", "n_matches", "_name"])

    groups = texts.groupBy("_range", "_group").cogroup(wanted.groupBy("_range", "_group"))
    part = groups.applyInPandas(added, "_fragment string, n_matches long, _name string")
    return part.groupBy("_fragment").agg(F.sum("n_matches").alias("n_matches"), F.min("_name").alias("_name"))
