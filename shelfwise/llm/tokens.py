"""Token ids of whole texts. A batch is cut and its words numbered in Arrow; each different word is
encoded once per worker.

A piece starts at a blank before a printable character, a word inside it at a border that no
pre-token of either vocabulary crosses, so the ids of a text are those of its words in a row.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

HELD = 400_000  # words of a generation; two generations are kept per worker
BATCH_BYTES = 4 << 20  # texts encoded at once
_PRINTABLE = "!-~À-ɏ"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
# A blank before a printable character starts a pre-token.
_CUT, _UNSURE = f" ([{_PRINTABLE}])", f" ([^{_PRINTABLE}]|$)"
# So do a printable character after a line end that follows one, and an ASCII mark after a Latin
# letter, unless it is the apostrophe, which may start a contraction.
_INNER = ((f"([{_PRINTABLE}]\n)([{_PRINTABLE}])", 2), (rf"([{_LATIN}])([!-&(-/:-@\[-`{{-~])", 1))
_LETTERS = re.compile(f" ?[{_LATIN}]+").fullmatch  # one pre-token for certain
_MARKS = [chr(c) for c in (0, 1, 2, 3, 4, 5, 6, 7, 14, 15, 16)]


def _byte_signs() -> dict[int, str]:
    """The sign a byte-level vocabulary writes for each byte: itself if it is visible, else the
    next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = itertools.count(256)
    return {b: chr(b if b in visible else next(free)) for b in range(256)}


class _Runs:
    """Runs of ids by the word they belong to."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self._used, self._count = 0, 0
        self._starts, self._sizes = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self._ids = np.zeros(1 << 12, np.uint32)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append the runs of new words, of ``sizes``, one after the other in ``ids``."""
        first, last, end = self._count, self._count + len(words), self._used + len(ids)
        while last > len(self._starts):
            self._starts, self._sizes = np.tile(self._starts, 2), np.tile(self._sizes, 2)
        while end > len(self._ids):
            self._ids = np.tile(self._ids, 2)
        self._ids[self._used : end] = ids
        self._sizes[first:last] = sizes
        self._starts[first:last] = self._used + np.cumsum(sizes) - sizes
        self.numbers.update(zip(words, range(first, last), strict=True))
        self._count, self._used = last, end

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs ``numbers`` in a row, and the size of each."""
        sizes = self._sizes[numbers]
        return ragged(self._ids, self._starts[numbers], sizes), sizes


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``values`` from ``starts`` with ``sizes``, in a row."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of the next ``counts`` values each."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


class PieceEncoder:
    """Encodes texts by their words; a vocabulary says how words are cut and encoded."""

    _names: list[str] = []
    _whole = False

    def __init__(self, held: int | None = None) -> None:
        self._held = held
        self._now, self._before = _Runs(), _Runs()

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Running numbers of different words; those of the older generation are taken over."""
        now, before = self._now, self._before
        if new := [word for word in words if word not in now.numbers]:
            old = [word for word in new if word in before.numbers]
            now.add(old, *before.joined(np.array([before.numbers[word] for word in old], np.int64)))
            if new := [word for word in new if word not in before.numbers]:
                ids = self._encoded(new)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                now.add(new, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        return np.fromiter(map(now.numbers.__getitem__, words), np.int64, len(words))

    def _pieces(self, texts: pa.Array, mark: str) -> pa.Array:
        """Lists of pieces; a special token's name is a piece of its own."""
        for name in self._names:
            if pc.any(pc.match_substring(texts, name)).as_py():
                texts = pc.replace_substring(texts, name, mark + name + mark)
        return pc.split_pattern(self._cut(texts, mark), mark)

    def _cut(self, texts: pa.Array, mark: str) -> pa.Array:
        """The texts with a mark before each blank that a printable character follows."""
        if pc.any(pc.match_substring_regex(texts, _UNSURE)).as_py():
            return pc.replace_substring_regex(texts, _CUT, f"{mark} \\1")
        return pc.replace_substring(texts, " ", f"{mark} ")

    def encode(self, texts: list[str] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text; ``end`` is appended to every text.
        A null text is an empty one."""
        if len(self._now.numbers) > (self._held or HELD):
            self._now, self._before = _Runs(), self._now
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        column = column.cast(pa.large_string())
        mark = next((m for m in _MARKS if not pc.any(pc.match_substring(column, m)).as_py()), None)
        if not len(column) or self._whole or mark is None:
            made = self._encode(column.to_pylist())
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(lengths.sum()))
        else:
            pieces = self._pieces(column, mark)
            piece = pc.dictionary_encode(pieces.flatten())
            words = self._words(piece.dictionary, mark)
            if words is None:  # the pieces are words, all different already
                numbers, sizes = self._numbers(piece.dictionary.to_pylist()), np.ones(len(piece.dictionary), np.int64)
            else:
                word, sizes = pc.dictionary_encode(words.flatten()), _sizes(words)
                numbers = self._numbers(word.dictionary.to_pylist())[word.indices.to_numpy()]
            runs = self._now
            # Ids of each different piece, then of each piece of each text.
            of_pieces, word_sizes = runs.joined(numbers)
            piece_sizes = sums(word_sizes, sizes)
            places = piece.indices.to_numpy()
            ids = ragged(of_pieces, (np.cumsum(piece_sizes) - piece_sizes)[places], piece_sizes[places])
            lengths = sums(piece_sizes[places], _sizes(pieces))
        if end is not None:
            ids = np.insert(ids, np.cumsum(lengths), end)
            lengths = lengths + 1
        return ids, lengths


class WordEncoder(PieceEncoder):
    """A vocabulary of the tokenizers library. Names of special tokens inside a text are ordinary
    text; with ``special`` they are their tokens, as the library has it by default."""

    def __init__(self, path: str, special: bool = False, held: int | None = None) -> None:
        from tokenizers import Tokenizer

        super().__init__(held)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        self._names = sorted((token.content for token in added), key=len, reverse=True)
        # Names that hold one another or a blank could be cut; texts are then encoded whole.
        self._whole = any(" " in a or any(a in b for b in self._names if a != b) for a in self._names)
        self._suffix = bool(self.tokenizer.model.end_of_word_suffix)  # lower case, no blanks
        self.signs = _byte_signs()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, words: list[str]) -> list[list[int]]:
        """Ids of words that are one pre-token each: only the merges are left to the library."""
        joined = "\n".join(words)
        if self._suffix:
            joined = joined.replace(" ", "").lower()
        signs = joined.encode().decode("latin-1").translate(self.signs)
        tokenize = self.tokenizer.model.tokenize
        return [[token.id for token in tokenize(word)] for word in signs.split(self.signs[10])]

    def _encoded(self, words: list[str]) -> list[list[int]]:
        letters = [word for word in words if _LETTERS(word)]
        known = dict(zip(letters, self._of_letters(letters), strict=True)) if letters else {}
        rest = [word for word in words if word not in known]
        known.update(zip(rest, self._encode(rest), strict=True))
        return [known[word] for word in words]

    def _words(self, pieces: pa.Array, mark: str) -> pa.Array:
        cut = pieces
        for border, times in _INNER:
            for _ in range(times):
                cut = pc.replace_substring_regex(cut, border, f"\\1{mark}\\2")
        if self._names:
            cut = pc.if_else(pc.is_in(pieces, pa.array(self._names, pieces.type)), pieces, cut)
        return pc.split_pattern(cut, mark)


@functools.lru_cache(maxsize=2)
def encoder(path: str, special: bool = True) -> WordEncoder:
    """The worker's encoder of a vocabulary file."""
    return WordEncoder(path, special)


def gathered(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut, to about ``limit`` bytes of ``column``; a larger row is alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, before + limit - size, side="right")), start)
            if stop == start:
                if held:
                    yield pa.concat_batches(held)
                    held, size = [], 0
                    continue
                stop = start + 1
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
    if held:
        yield pa.concat_batches(held)
