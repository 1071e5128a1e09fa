"""Token files, packing and the encoder against the tokenizers library and plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing, tokens, wavelet

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "a", "Two words", "a  b", "a \n b\t c ", "tab\t x", "é ü ñ", "nul\0 x \0", " lead", "trail ", "it's  we'll",
       "  x  y", "<|endoftext|> <|startoftext|> a", "日本 語 　 x", "a ​x", "ñ o ̃p", "x" * 5000,
       "123 4,5 !!  ##", "\r\n \r\n a", "a \x1c b \x85 c"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library_on_whole_texts(path):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    draw = random.Random(5)
    mixed = ["".join(draw.choice([" ", "  ", "\n", "a", "B!", "é", "'s", "7", "\t", "word"]) for _ in range(40)) for _ in range(60)]
    texts = ODD + mixed
    ids, lengths = tokens.WordEncoder(path).encode(texts, 9)
    at = 0
    for text, length in zip(texts, lengths.tolist(), strict=True):
        assert ids[at : at + length].tolist() == [*library.encode(text, add_special_tokens=False).ids, 9], repr(text)
        at += length


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_pieces_end_where_the_library_ends_them(path):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    draw = random.Random(8)
    signs = ["a", "B", "é", "ß", "ÿ", "×", "÷", "İ", "\u0307", "\u0301", "\u0338", "'", "’", ".", ",", "=", "<", "|",
             "\n", "\r\n", " ", "\u00a0", "\x1c", "\x85", "7", "中", "ſ", "Σ", "'s", "<|endoftext|>", "\0", "😀", "_", "`"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(25))) for _ in range(8000)]
    ids, lengths = tokens.WordEncoder(path).encode(texts)
    wanted = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_names_of_special_tokens_are_their_tokens(path):
    library, draw = Tokenizer.from_file(path), random.Random(9)
    signs = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "a", "É", "'s", "7", "e\u0301", "\0"]
    texts = ODD + ["".join(draw.choice(signs) for _ in range(draw.randrange(15))) for _ in range(4000)]
    ids, lengths = tokens.encoder(path).encode(texts, 9)
    wanted = [[*e.ids, 9] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


def test_encoder_forgets_without_a_difference(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 3)
    encoder = tokens.WordEncoder(BYTES)
    first = [encoder.encode([f"some words {i}", "and more"])[0].tolist() for i in range(5)]
    monkeypatch.setattr(tokens, "HELD", 10**6)
    assert first == [encoder.encode([f"some words {i}", "and more"])[0].tolist() for i in range(5)]


@pytest.mark.parametrize("size,top", [(0, 1), (1, 1), (7, 3), (1500, 40), (3000, 70000)])
def test_wavelet_matrix(size, top):
    ids = np.random.default_rng(size).integers(0, top, size).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids).to_bytes())
    assert matrix.ids().tolist() == ids.tolist()
    for place in range(0, size, max(1, size // 50)):
        assert matrix.access(place) == ids[place]
    for symbol in {0, 1, top + 5, *ids[:5].tolist()}:
        places = np.flatnonzero(ids == symbol).tolist()
        assert matrix.occurrences(symbol) == places and matrix.count(symbol) == len(places)
        assert matrix.count(symbol, size // 3, size // 2) == int((ids[size // 3 : size // 2] == symbol).sum())
    with pytest.raises(IndexError):
        matrix.select(top + 9, 0)


def docs(spark):
    rows = [(5, "five words are in here", "x"), (2, None, "x"), (9, "", "x"), (1, "long " * 30000, "x"),
            (2, "twice", "x"), (None, "no id", "x"), (5, "five words are in here", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_shards_hold_every_document_in_order(spark, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs(spark), BYTES, 0, path, shard_tokens=5)
    out = wavelet.read_shards(spark.read.schema(wavelet.SHARDS).parquet(path)).orderBy("start").collect()
    library, at = Tokenizer.from_file(BYTES), 0
    texts = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in docs(spark).collect())
    for row, (doc_id, text) in zip(out, texts, strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (row.doc_id if row.doc_id is not None else -1, row.start, row.n_tokens, row.ids_crc32) == (
            doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_no_documents_give_no_shard(spark, tmp_path):
    path = str(tmp_path / "none")
    wavelet.write_shards(docs(spark).limit(0), BYTES, 0, path)
    assert wavelet.read_shards(spark.read.schema(wavelet.SHARDS).parquet(path)).count() == 0


def checked(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packed_documents_have_gapless_places(spark):
    out = packing.packed_documents(docs(spark), WORDS, 1, 100).collect()
    assert {(r.doc_id, r.length) for r in out if r.doc_id in (9,)} == {(9, 1)}
    assert sum(r.length for r in out if r.doc_id == 1) == 30001 and len(out) == 301 + 6
    checked(out, 100)
    assert packing.packed_documents(docs(spark).limit(0), WORDS, 1, 100).count() == 0


def test_tree_of_merges_packs_tightly(spark):
    draw = random.Random(2)
    sizes = [draw.choice([3, 11, 25, 48, 60, 100]) for _ in range(900)]
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(sizes)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), 100, group_bins=50).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted(enumerate(sizes))
    assert checked(out, 100) <= 1.08 * sum(sizes) / 100


def test_few_small_bins_meet_after_a_round_without_gain(spark):
    sizes = [65] * 380 + [40] * 16 + [30]
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(sizes)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), 100, group_bins=20).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    assert checked(out, 100) == 388


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit(np.array([60, 50, 40, 30]), 100)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 60, 50]
