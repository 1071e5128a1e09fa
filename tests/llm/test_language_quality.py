"""Language ID and quality ranking: edge cases, a brute-force Kneser-Ney, held-out accuracy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import language, quality

SAMPLE = "doc_id long, text string, lang string"


def texts():
    english = ["the cat and the dog", "this is the thing of that day", "with the other then there"]
    german = ["der hund und die katze", "das ist nicht der tag von ihm", "ich bin auch noch sehr alt"]
    return [(i, f"{t} {i}", "en") for i, t in enumerate(english * 6)] + [
        (100 + i, f"{t} {i}", "de") for i, t in enumerate(german * 6)
    ]


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.createDataFrame(texts(), SAMPLE))


def normalised(text):
    out = []
    for c in text:
        if c.isalpha():
            out.append(c.lower())
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def brute(rows, lang):
    """Interpolated Kneser-Ney by the book, on dictionaries."""
    order = language.ORDER
    top = Counter()
    for _, text, own in rows:
        if own == lang:
            padded = "\1" * (order - 1) + normalised(text)
            top.update(padded[i : i + order] for i in range(len(padded) - order + 1))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        own = counts[n]
        once, twice = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = max(0.1, once / (once + 2 * twice) if once + 2 * twice else 0.5)
        after = {g: v for g, v in own.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        return max(after.get(gram, 0) - d, 0) / total + min(1, d * len(after) / total) * p(gram[1:])

    return p


def test_entropy_equals_brute_force(model):
    rows = texts()
    text = "the tag and der xq"
    nats, lengths = language.entropies(model, [text])
    for number, lang in enumerate(model.languages):
        p, padded = brute(rows, lang), "\1" * 3 + normalised(text)
        expected = -sum(math.log(p(padded[i : i + 4])) for i in range(len(padded) - 3)) / lengths[0]
        assert nats[0, number] == pytest.approx(expected, rel=1e-3)


def test_unseen_grams_back_off_beside_many_seen_ones(spark):
    draw = np.random.default_rng(3)
    rows = ["".join(map(chr, draw.integers(0x4E00, 0x5A00, 150))) for _ in range(2000)]
    model = language.train(spark.createDataFrame([(i, t, "zh") for i, t in enumerate(rows)], SAMPLE))
    seen = np.concatenate([language.gram_stream([t])[0] for t in rows])
    grams = language.gram_stream(["".join(map(chr, draw.integers(0x4E00, 0x5A00, 20000)))])[0]
    grams = grams[~np.isin(grams, seen)]
    tails = grams & np.uint64((1 << 48) - 1)
    assert len(grams) > 19000
    assert np.array_equal(language.log_p(model, grams), language.log_p(model, tails, 3) + language._backoff(model, grams, 4))


def test_long_text_in_pieces_equals_one_piece(model, monkeypatch):
    text = "the dog und die katze " * 40
    whole = language.entropies(model, [text])[0]
    monkeypatch.setattr(language, "CHUNK", 64)
    assert np.allclose(language.entropies(model, [text])[0], whole, rtol=1e-5)


def test_edge_cases_and_clashing_names(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "the dog and the cat", "x"),
            (None, "der hund und die katze", "x"), (4, "the dog and the cat", "x"), (5, "the dog " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = language.identify(docs, model).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "de", "en", "en"]
    assert all(0 <= r.score <= 1 for r in out) and not out[0].accepted
    assert language.identify(docs.limit(0), model).count() == 0


def test_no_training_rows_leave_every_text_undetermined(spark):
    empty = language.train(spark.createDataFrame([], SAMPLE))
    docs = spark.createDataFrame([(1, "the dog")], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(docs, empty).collect()] == ["und"]


def test_rejection_is_calibrated(spark, model):
    fitted = language.calibrated(model, spark.createDataFrame(texts(), SAMPLE))
    docs = spark.createDataFrame(
        [(1, "the cat and the dog"), (2, "qxz vvkq wqqz jjxq " * 20)], "doc_id long, text string"
    )
    assert [r.accepted for r in language.identify(docs, fitted).collect()] == [True, False]


def test_wrong_labels_do_not_loosen_the_rejection(spark):
    clean = [(i, f"{text} {text} {text}", lang) for i, text, lang in texts() * 20]
    wrong = [(1000, "der hund und die katze ist nicht der tag", "en"), (1001, "the cat and the dog of that day", "de")]
    fitted = language.calibrated(language.train(spark.createDataFrame(clean, SAMPLE)), spark.createDataFrame(clean + wrong, SAMPLE))
    good = "this is the thing of that day and the other dog "
    rows = [good * 4, "qxz vvkq wqqz jjxq " * 10, "kedi ile köpek bugün çok güzel değil mi " * 5,
            good * 2 + "qxz vvkq wqqz jjxq kzzv wqvj " * 3]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [r.accepted for r in language.identify(docs, fitted).orderBy("doc_id").collect()] == [True, False, False, False]


def labelled(spark):
    good = [(i, f"Some words of a plain text, number {i}. It goes on and ends here.", 1) for i in range(60)]
    bad = [(100 + i, f"SHOUT!! WORDS!! {'SAME ' * 20} {i}!!", 0) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + bad], "doc_id long, quality int")
    return docs, labels


def test_quality_ranks_held_out_documents(spark):
    docs, labels = labelled(spark)
    out = quality.scored(docs, labels, F.col("doc_id") % 3 != 0).join(labels, "doc_id").collect()
    assert all(r.predicted == r.quality for r in out if r.doc_id % 3 == 0)


def test_quality_edge_cases(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "word " * 100000), (None, "a text."), (900, None)],
                                "doc_id long, text string")
    more = labels.union(spark.createDataFrame([(None, 1), (5, None), (7, 1), (99999, 0)], "doc_id long, quality int"))
    out = quality.scored(docs.union(odd), more, F.lit(True)).collect()
    assert len(out) == 95 and all(0 <= r.score <= 1 for r in out)
    assert quality.scored(docs.limit(0), labels, F.lit(True)).count() == 0
    only = quality.scored(docs, labels.where("quality = 1"), F.lit(True)).collect()
    assert {r.predicted for r in only} == {1}


def test_figures_of_words():
    assert quality.text_figures("", np.zeros(quality.KINDS, int)) == [0.0] * quality.FIGURES
    assert len(quality.text_figures("a b a", np.array([3, 0, 0, 2, 0, 0, 0, 0]))) == quality.FIGURES
