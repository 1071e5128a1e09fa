"""Alignment of two tokenizations of the same texts, by lockstep merging.

Both vocabularies spell a text as bytes; a blank stands before it in both. Byte places where a token
of A and one of B end together cut the tokens into groups, and link the two tokens. Each text is cut
into lanes of equal bytes, and one state vector holds the A and B pointers of all lanes of a batch:
a step compares the ends they point at, emits links where they are equal and advances the smaller,
or both; finished lanes are dropped from the vector. A text of any length is many lanes, so no text
makes the others wait.

A pair's count is the number of links of all texts that join its two ids. Counts are made per chunk
of documents, added up by pair and brought back to the chunks that hold the pair; links themselves are
written once, as numbers into their chunk's list of pairs.

Null and empty texts, and texts that either vocabulary does not spell back exactly, have no tokens.
Rows that repeat, or share a ``doc_id`` (null too), are rows of their own. Other columns are not
read. An empty table gives no row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare, staged
from shelfwise.llm.tokens import PieceEncoder, WordEncoder, gathered, sums

LANE_BYTES = 256
CHUNK_LINKS = 1 << 20  # links counted together; a longer document is a chunk of its own
BATCH_BYTES = 2 << 20  # texts aligned at once
HELD = 300_000  # words of a generation, in each of the two encoders
BLANK = "▁"
ALIGNED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links binary, pairs array<long>, counts array<long>"
)
SCORED = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


class SentenceEncoder(PieceEncoder):
    """Ids of a sentence-piece vocabulary, whose encoder puts a blank before every text.

    No piece has its blank mark behind another sign, so no merge crosses the blank before a word."""

    def __init__(self, path: str, held: int | None = None) -> None:
        import sentencepiece

        super().__init__(held)
        self._processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._processor.id_to_piece(i) for i in range(self._processor.get_piece_size())]
        self._whole = any(BLANK in piece.lstrip(BLANK) for piece in pieces)

    def _encode(self, words: list[str]) -> list[list[int]]:
        # Words start with the blank that the library adds by itself.
        return self._processor.encode([word[1:] for word in words], num_threads=1)

    _encoded = _encode

    def _cut(self, texts: pa.Array, mark: str) -> pa.Array:
        # Of several blanks in a row the last may merge with the others.
        return pc.replace_substring(super()._cut(texts, mark), f" {mark} ", "  ")

    def _words(self, pieces: pa.Array, mark: str) -> None:
        return None


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    own = WordEncoder(path)
    tokenizer, bytes_of = own.tokenizer, {sign: byte for byte, sign in own.signs.items()}
    entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(bytes_of[s] for s in e) if all(s in bytes_of for s in e) else b"" for e in entries]


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a sentence-piece vocabulary."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return [
        bytes([int(entry[3:-1], 16)]) if processor.is_byte(i) else entry.replace(BLANK, " ").encode()
        for i, entry in enumerate(entries)
    ]


@functools.lru_cache(maxsize=1)
def _tools(path_a: str, path_b: str):
    """The worker's encoders, the sizes of their tokens, and the texts of ids with a sign behind."""
    tokens_a, tokens_b = byte_tokens(path_a), piece_tokens(path_b)
    sizes = [np.fromiter(map(len, tokens), np.int64, len(tokens)) for tokens in (tokens_a, tokens_b)]
    names = [f"{i}," for i in range(len(tokens_a))] + [f"{i}|" for i in range(len(tokens_a))]
    names += [f"{i}," for i in range(len(tokens_b))] + [f"{i};" for i in range(len(tokens_b))]
    return WordEncoder(path_a, held=HELD), SentenceEncoder(path_b, HELD), tokens_a, tokens_b, sizes, names, (len(tokens_a), len(tokens_b))


def merged(ends_a: np.ndarray, ends_b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, j)`` of tokens that end at the same byte, in ascending order.

    Ends ascend. A lane covers ``LANE_BYTES`` bytes; its pointers start behind the ends before it.
    """
    borders = np.arange(0, total + LANE_BYTES, LANE_BYTES)
    starts_a, starts_b = np.searchsorted(ends_a, borders, "right"), np.searchsorted(ends_b, borders, "right")
    at_a, stop_a, at_b, stop_b = starts_a[:-1].copy(), starts_a[1:], starts_b[:-1].copy(), starts_b[1:]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        open_lanes = (at_a < stop_a) & (at_b < stop_b)
        if not open_lanes.all():  # finished lanes leave the state
            at_a, stop_a, at_b, stop_b = (x[open_lanes] for x in (at_a, stop_a, at_b, stop_b))
        if not len(at_a):
            break
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        both = end_a == end_b
        found_a.append(at_a[both])
        found_b.append(at_b[both])
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
    links_a = np.concatenate(found_a)
    order = np.argsort(links_a, kind="stable")
    return links_a[order], np.concatenate(found_b)[order]


def spelled(ids: np.ndarray, counts: np.ndarray, tokens: list[bytes], sizes: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Which texts the tokens spell exactly."""
    same = sums(sizes[ids], counts) == pc.binary_length(texts).to_numpy(zero_copy_only=False)
    data = memoryview(texts.buffers()[2] or b"").cast("B")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values, ends = ids.tolist(), np.cumsum(counts)
    for i in np.flatnonzero(same).tolist():
        made = b"".join(map(tokens.__getitem__, values[ends[i] - counts[i] : ends[i]]))
        same[i] = made == data[bounds[i] : bounds[i + 1]]
    return same


def kept(ids: np.ndarray, counts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids without those of texts that are not good, and how many each text has then."""
    return ids[np.repeat(good, counts)], np.where(good, counts, 0)


def sizes_of(last: np.ndarray) -> np.ndarray:
    """The sizes of groups that follow one another, from their last members."""
    return np.diff(last, prepend=-1)


def group_digests(
    ids_a: np.ndarray, ids_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray,
    last_a: np.ndarray, last_b: np.ndarray, names: list[str], widths: tuple[int, int],
) -> list[str]:
    """The digest of each text's groups, written as decimal ids; the last tokens of groups are given.

    ``names`` are A's ids with a comma, with a bar, then B's with a comma, with a semicolon."""
    group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group_a[last_a[:-1] + 1], group_b[last_b[:-1] + 1] = 1, 1
    group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
    name_a, name_b = ids_a.astype(np.int64), ids_b.astype(np.int64) + 2 * widths[0]
    name_a[last_a] += widths[0]
    name_b[last_b] += widths[1]
    # A's tokens stand behind B's of earlier groups, B's behind A's of earlier groups and their own.
    line = np.empty(len(ids_a) + len(ids_b), np.int64)
    line[np.arange(len(ids_a)) + (last_b[group_a] + 1 - sizes_of(last_b)[group_a])] = name_a
    line[np.arange(len(ids_b)) + last_a[group_b] + 1] = name_b
    words = list(map(names.__getitem__, line.tolist()))
    out, at = [], 0
    for count in (counts_a + counts_b).tolist():
        text = "".join(words[at : at + count])[:-1]
        out.append(hashlib.sha256(text.encode()).hexdigest() if count else "")
        at += count
    return out


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its links as numbers of pairs, and one per chunk with its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b, tokens_a, tokens_b, (sizes_a, sizes_b), names, widths = _tools(path_a, path_b)
        chunk, held, links_held = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            """The rows held, their links numbered by the chunk's different pairs."""
            pairs, numbers, counts = np.unique(
                np.concatenate([row[-1] for row in held]), return_inverse=True, return_counts=True
            )
            numbers, rows, at = numbers.astype("<i4"), [], 0
            for *columns, links in held:
                rows.append([chunk, *columns, numbers[at : at + len(links)].tobytes(), None, None])
                at += len(links)
            if len(pairs):
                rows.append([chunk, *[None] * 7, pairs.tolist(), counts.tolist()])
            kinds = (*[pa.int64()] * 6, pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            fields = [c.strip().split(" ")[0] for c in ALIGNED.split(",")]
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields
            )

        for batch in gathered(batches, limit=BATCH_BYTES):
            doc_ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            blank, empty = pa.scalar(" ", texts.type), pa.scalar("", texts.type)
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), empty, pc.binary_join_element_wise(blank, texts, empty))
            ids_a, count_a = encode_a.encode(texts)
            ids_b, count_b = encode_b.encode(texts)
            good = spelled(ids_a, count_a, tokens_a, sizes_a, texts) & spelled(ids_b, count_b, tokens_b, sizes_b, texts)
            (ids_a, count_a), (ids_b, count_b) = kept(ids_a, count_a, good), kept(ids_b, count_b, good)
            ends_a, ends_b = np.cumsum(sizes_a[ids_a]), np.cumsum(sizes_b[ids_b])
            last_a, last_b = merged(ends_a, ends_b, int(ends_a[-1]) if len(ends_a) else 0)
            digests = group_digests(ids_a, ids_b, count_a, count_b, last_a, last_b, names, widths)
            pairs = (ids_a[last_a].astype(np.int64) << 32) | ids_b[last_b]
            bounds = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(count_a)]))
            for i, doc_id in enumerate(doc_ids):
                links = pairs[bounds[i] : bounds[i + 1]]
                # All tokens have bytes, so a cut is one link and closes one group.
                held.append((doc_id, int(count_a[i]), int(count_b[i]), len(links), len(links), digests[i], links))
                links_held += len(links)
                if links_held >= CHUNK_LINKS:
                    yield closed()
                    chunk, held, links_held = chunk + 1, [], 0
        if held:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def _scored(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """Documents of a chunk with the sums of their links' counts; pairs by their number."""
    counts, best = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    counts[table["number"]], best[table["number"]] = table["count"], table["best"]
    links = [np.frombuffer(b, "<i4") for b in rows["links"]]
    return rows.drop(columns=["chunk", "links"]).assign(
        n_best=[int(best[own].sum()) for own in links], count_sum=[int(counts[own].sum()) for own in links]
    )


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every document's tokens, groups and links, and how its links stand among all documents'.

    ``n_best`` is the number of links whose pair is the most counted of its B id, ties included.
    """
    prepare(docs.sparkSession)
    rows = staged(aligned(docs, path_a, path_b), "aligned")
    listed = rows.where("pairs is not null").select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("number", "pair"))
    listed = listed.select("of", "number", F.col("pair.pairs").alias("pair"), F.col("pair.counts").alias("count"))
    totals = staged(listed.groupBy("pair").agg(F.sum("count").alias("count")), "totals")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    highest = totals.groupBy(b).agg(F.max("count").alias("highest"))
    judged = totals.withColumn("b", b).join(highest, "b")
    judged = judged.select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    table = listed.drop("count").join(judged, "pair").select("of", "number", "count", "best")
    # As text, an id that is next to a null keeps all its digits in pandas.
    documents = rows.where("pairs is null").drop("pairs", "counts").withColumn("doc_id", F.col("doc_id").cast("string"))
    scored = documents.groupBy("chunk").cogroup(table.groupBy("of")).applyInPandas(_scored, SCORED)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
