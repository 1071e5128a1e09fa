"""Benchmark decontamination: rare n-gram seeds find candidates, Smith-Waterman alignment scores them.

Texts are words of letters and digits, lower-cased, read whole. A seed is a run of ``WIDTH`` words of
a test item (all words of a shorter item). A seed is rare if it is in at most ``COMMON`` times as
many documents as the median seed of its item, so at least half of an item's seeds are rare, however
often the item leaked; a document that holds a rare one is aligned with the item around it. One that
holds only frequent ones is aligned too unless it has too few of the item's words for the least
score, so what is found does not depend on other documents. The score is the best local alignment of the item's words, as a share of aligning all of them, so edited
and paraphrased copies score below 1.

Null texts, and texts and items without a word, match nothing. Equal items are separate items, each
document is aligned with both. Rows that share a ``doc_id`` or ``item_id`` give the best score of
any of them. Other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import chunks, prepare, staged

WIDTH = 4
COMMON = 4
FILTER_BITS = 24  # the seeds' filter is 2 ** FILTER_BITS flags, whatever the benchmark's size
BLOCKS = 8  # words of 64 flags that tell which words a window or an item holds
CHUNK = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """The lower case of letters and digits; 0 for what parts words."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalnum():
            low = letter.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    ahead, back = np.full(CHUNK + 2, _BASE, np.uint64), np.full(CHUNK + 2, inverse, np.uint64)
    ahead[0] = back[0] = 1
    return np.multiply.accumulate(ahead), np.multiply.accumulate(back)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def word_hashes(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of the words of the texts, in parts: the range of texts, their words, words per text.

    Texts of ordinary length share a part; one that is longer than a chunk is a part of its own.
    """
    for a, b in chunks((len(t) + 1 for t in texts), CHUNK):
        joined = "\0".join(texts[a:b]) + "\0"
        pieces, words = [joined], []
        if len(joined) > CHUNK:
            pieces = _cut_between_words(joined)
        for piece in pieces:
            codes = _lowered()[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], codes > 0, [False]]).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            if len(codes) > CHUNK + 1:  # a single word longer than a chunk
                words.append((starts, np.array([_long_hash(codes[s:e]) for s, e in zip(starts, ends, strict=True)], np.uint64)))
                continue
            ahead, back = _powers()
            sums = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * ahead[: len(codes)])])
            words.append((starts, _mixed((sums[ends] - sums[starts]) * back[starts])))
        if len(pieces) > 1:
            whole = np.concatenate([w for _, w in words])
            yield a, b, whole, np.array([len(whole)])
        else:
            sizes = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
            counts = np.diff(np.searchsorted(words[0][0], np.concatenate([[0], np.cumsum(sizes)])))
            yield a, b, words[0][1], counts


def _cut_between_words(text: str) -> list[str]:
    pieces, at = [], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and text[end].isalnum():
            end += 1
        pieces.append(text[at:end])
        at = end
    # A long text is one document, so only its last piece may end with the mark.
    return pieces if len(pieces) > 1 else [text, ""]


def _long_hash(codes: np.ndarray) -> np.uint64:
    total, power = 0, 1
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK].astype(np.uint64)
        total += power * int((part * _powers()[0][: len(part)]).sum(dtype=np.uint64))
        power = power * pow(int(_BASE), len(part), 1 << 64) % (1 << 64)
    return _mixed(np.array([total % (1 << 64)], np.uint64))[0]


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for place in range(width):
        total = total * _BASE + words[place : place + len(total)]
    return _mixed(total + np.uint64(width))


def _flags(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (seeds >> np.uint64(64 - bits)).astype(np.int64), (seeds & np.uint64((1 << bits) - 1)).astype(np.int64)


def word_flags(words: np.ndarray) -> np.ndarray:
    """One flag for each word, in ``BLOCKS`` integers; different words may share a flag."""
    flags = np.zeros(64 * BLOCKS, bool)
    flags[(words & np.uint64(64 * BLOCKS - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64)


def item_words(items: DataFrame) -> DataFrame:
    """``item_id``, ``words``, the word hashes of each item that has a word, and their ``flags``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for _, _, words, counts in word_hashes(texts):
                rows.extend(np.split(words, np.cumsum(counts)[:-1]))
            columns = [[row.view(np.int64) for row in rows], [word_flags(row) for row in rows]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in columns)],
                names=["item_id", "words", "flags"],
            )

    source = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    schema = "item_id long, words array<long>, flags array<long>"
    return source.mapInArrow(run, schema).where("size(words) > 0")


def item_seeds(items: DataFrame) -> DataFrame:
    """``seed``, ``width`` and ``item_id`` of the different seeds of each item, from its ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(words, np.int64).view(np.uint64)
                width = min(WIDTH, len(own))
                seeds = np.unique(runs(own, width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), width, np.int32)),
                     pa.array(np.full(len(seeds), item, np.int64))],
                    names=["seed", "width", "item_id"],
                )

    return items.select("item_id", "words").mapInArrow(run, "seed long, width int, item_id long").distinct()


def seeded_windows(docs: DataFrame, seeds: DataFrame, reach: int, bits: int = FILTER_BITS) -> DataFrame:
    """Parts of documents around words that may start a seed: ``doc_id``, ``first`` (place of the
    first word), ``words``, their ``flags`` and ``seeds``.

    Hits closer than twice ``reach`` words share a window. The filter has false hits, no misses.
    """
    slots = [F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))]
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for number, slot in enumerate(slots):
        rows = seeds.select("width", slot.cast("int").alias("slot")).distinct().toPandas()
        for width, own in rows.groupby("width"):
            pair = filters.setdefault(int(width), (np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)))
            pair[number][own["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast({w: [np.packbits(f) for f in p] for w, p in filters.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = {w: [np.unpackbits(f).view(bool) for f in pair] for w, pair in shared.value.items()}
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for a, b, words, counts in word_hashes(texts):
                ends = np.cumsum(counts)
                places, found = [], []
                for width, pair in flags.items():
                    grams = runs(words, width)
                    high, low = _flags(grams, bits)
                    at = np.flatnonzero(pair[0][high])
                    at = at[pair[1][low[at]]]
                    # A run must not cross the end of its document.
                    at = at[at + width <= ends[np.searchsorted(ends, at, side="right")]] if len(at) else at
                    places.append(at)
                    found.append(grams[at])
                place, seed = np.concatenate(places), np.concatenate(found)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                doc = np.searchsorted(ends, place, side="right")
                new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(place, prepend=-1) > 2 * reach))
                for first, last in zip(new.tolist(), [*new[1:].tolist(), len(place)], strict=True):
                    number = int(doc[first])
                    begin = max(int(ends[number] - counts[number]), int(place[first]) - reach)
                    end = min(int(ends[number]), int(place[last - 1]) + WIDTH + reach)
                    rows.append((
                        doc_ids[a + number], begin - int(ends[number] - counts[number]),
                        words[begin:end].view(np.int64), word_flags(words[begin:end]),
                        np.unique(seed[first:last]).view(np.int64),
                    ))
            if rows:
                doc, first, *lists = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(first, pa.int64()),
                     *(pa.array(c, pa.list_(pa.int64())) for c in lists)],
                    names=["doc_id", "first", "words", "flags", "seeds"],
                )

    schema = "doc_id long, first long, words array<long>, flags array<long>, seeds array<long>"
    if not filters:
        return docs.sparkSession.createDataFrame([], schema)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, schema)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of an item with each row of ``windows`` (padded with -1 rows' ends).

    Returns the score and the places, in the item and in the window, of the last aligned words. Gaps
    along the window are a running maximum, so each word of the item is one step for all windows.
    """
    count, width = windows.shape
    slope = GAP * np.arange(width + 1)
    above = np.zeros((count, width + 1), np.int32)
    best = np.zeros(count, np.int32)
    last_item, last_word = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for number, word in enumerate(item):
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(above[:, :-1] + np.where(windows == word, MATCH, MISMATCH), above[:, 1:] + GAP)
        np.maximum(here, 0, out=here)
        here = (np.maximum.accumulate(here - slope, axis=1) + slope).astype(np.int32)
        at = here.argmax(axis=1)
        score = here[np.arange(count), at]
        better = score > best
        best, last_item, last_word = (
            np.where(better, score, best), np.where(better, number, last_item), np.where(better, at - 1, last_word)
        )
        above = here
    return best, last_item, last_word


def _aligned(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scores of the rows (doc_id, first, words, item_id, item), the rows of an item together."""
    share, first, last = (np.zeros(len(pdf)), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64))
    sizes = pdf["words"].map(len).to_numpy()
    for _, rows in pdf.groupby("item_id").indices.items():
        item = np.asarray(pdf["item"].iloc[rows[0]], np.int64)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        for a, b in chunks(sizes[rows].tolist(), 200_000):
            some = rows[a:b]
            # Word hashes may have any value, so padding is told apart by its place.
            windows = np.full((len(some), int(sizes[some].max())), item[0] ^ -1, np.int64)
            known = set(item.tolist())
            while int(windows[0, 0]) in known:
                windows -= 1
            for at, row in enumerate(some):
                windows[at, : sizes[row]] = pdf["words"].iloc[row]
            score, end_item, end = align(item, windows)
            for at, row in enumerate(some):
                back = windows[at : at + 1, : end[at] + 1][:, ::-1]
                _, _, length = align(item[: end_item[at] + 1][::-1], back)
                share[row] = score[at] / (MATCH * len(item))
                last[row] = pdf["first"].iloc[row] + end[at]
                first[row] = pdf["first"].iloc[row] + end[at] - length[0]
    return pd.DataFrame({
        "doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "score": share, "first_word": first, "last_word": last
    })


def _sharing_frequent(windows: DataFrame, frequent: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """``window`` and ``item_id`` of windows with a frequent seed that may score ``least`` or more.

    Every flag of the item that the window lacks is a word that cannot match, and no score is above
    that of the words that can. The join compares flags, so only the pairs that may score are rows.
    """
    own = items.select("item_id", F.size("words").alias("size"), F.col("flags").alias("item_flags"))
    hits = windows.select("window", "flags", F.explode("seeds").alias("seed"))
    lacking = sum(
        F.bit_count(F.col("item_flags")[k].bitwiseAND(F.bitwise_not(F.col("flags")[k]))) for k in range(BLOCKS)
    )
    both = hits.join(frequent.join(own, "item_id"), "seed")
    return both.where((F.col("size") - lacking) / F.col("size") >= least).select("window", "item_id")


def leaked(docs: DataFrame, items: DataFrame, least: float = 0.5, bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``first_word`` and ``last_word`` of the leaks of ``least`` or more.

    One row for each document and item it holds, with the best alignment.
    """
    prepare(docs.sparkSession)
    own = staged(item_words(items), "items")
    seeds = staged(item_seeds(own), "seeds")
    reach = own.agg(F.max(F.size("words"))).first()[0] or 0
    windows = seeded_windows(docs, seeds, reach, bits).withColumn("window", F.monotonically_increasing_id())
    windows = staged(windows, "windows")
    hits = windows.select("window", "doc_id", F.explode("seeds").alias("seed"))
    spread = hits.select("doc_id", "seed").distinct().groupBy("seed").agg(F.count("*").alias("documents"))
    # Seeds that no document holds find nothing and do not count.
    counted = seeds.join(spread, "seed").select("seed", "item_id", "documents")
    middle = counted.groupBy("item_id").agg(F.percentile_approx("documents", 0.5, 10000).alias("middle"))
    counted = counted.join(middle, "item_id").withColumn("rare", F.col("documents") <= COMMON * F.col("middle"))
    rare, frequent = (counted.where(which).select("seed", "item_id") for which in ("rare", "not rare"))
    pairs = hits.select("window", "seed").join(rare, "seed").select("window", "item_id")
    pairs = pairs.unionByName(_sharing_frequent(windows, frequent, own, least)).distinct()
    held = pairs.join(windows.select("window", "doc_id", "first", "words"), "window")
    both = held.join(own.select("item_id", F.col("words").alias("item")), "item_id")

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield _aligned(pdf.reset_index(drop=True))

    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    scores = both.select("doc_id", "first", "words", "item_id", "item").mapInPandas(score, schema)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "first_word", "last_word")).alias("best")
    return (
        scores.where(F.col("score") >= least).groupBy("doc_id", "item_id").agg(best)
        .select("doc_id", "item_id", "best.score", "best.first_word", "best.last_word")
    )
