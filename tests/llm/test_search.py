"""Leaks, personal data, URLs and chats against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import chat, leaks, personal, urls
from shelfwise.llm.queries import URL_LABELS, URL_RULES

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def smith_waterman(item, text):
    best = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            best[i, j] = max(0, best[i - 1, j - 1] + (2 if a == b else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
    return best.max()


def test_alignment_equals_the_table():
    draw = random.Random(4)
    for _ in range(40):
        item = np.array([draw.randrange(5) for _ in range(draw.randrange(1, 9))])
        text = np.array([draw.randrange(5) for _ in range(draw.randrange(1, 14))])
        score, _, _ = leaks.align(item, text[None, :])
        assert score[0] == smith_waterman(item.tolist(), text.tolist())


def test_leaks_and_clean_documents(spark):
    edited = ITEM.replace("zeta", "omega").replace("kappa", "kappa extra")
    rows = [(1, f"Before it. {ITEM.upper()}! And after"), (2, f"x {edited} y"), (3, "nothing of it at all here"), (4, None),
            (5, ""), (6, "word " * 300000 + ITEM), (None, ITEM), (1, ITEM), (8, "alpha beta gamma delta is all")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "..."), (13, "tiny one"), (10, ITEM)], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in leaks.leaked(docs, items).collect()}
    assert set(out) == {(1, 10), (2, 10), (6, 10), (None, 10)}
    assert out[1, 10].score == 1 and 0.5 < out[2, 10].score < 1
    words = re.findall(r"\w+", edited.lower())
    expected = smith_waterman(re.findall(r"\w+", ITEM.lower()), words) / (2 * len(ITEM.split()))
    assert out[2, 10].score == pytest.approx(expected)
    assert (out[6, 10].first_word, out[6, 10].last_word) == (300000, 300011)
    assert leaks.leaked(docs.limit(0), items).count() == 0 and leaks.leaked(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("copy", ["edited", "half"])
def test_copies_are_found_beside_a_verbatim_one(spark, copy):
    words = [f"w{i}" for i in range(40)]
    other = {"edited": [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(words)], "half": words[:21]}[copy]
    rows = [(0, " ".join(words))] + [(i, f"before {' '.join(other)} after{i}") for i in range(1, 7)]
    rows.append((7, " ".join(["no", *other[:4], "more"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(words))], "item_id long, text string")
    score = smith_waterman(words, other) / 80
    assert score >= 0.5
    for some in (docs, docs.where("doc_id > 0")):
        out = {r.doc_id: r.score for r in leaks.leaked(some, items).collect()}
        assert out == dict.fromkeys(range(1, 7), score) | ({0: 1.0} if some is docs else {})


def test_every_pair_with_a_seed_is_scored(spark):
    draw = random.Random(12)
    items = {i: [draw.choice("abcdefghijkl") for _ in range(draw.randrange(4, 16))] for i in range(12)}
    texts = {}
    for d in range(150):
        own = list(items[draw.randrange(3) if draw.random() < 0.7 else draw.randrange(12)])
        for _ in range(draw.randrange(5)):
            own[draw.randrange(len(own))] = draw.choice("abcdefghijklxyz")
        texts[d] = own
    expected = {}
    for d, text in texts.items():
        for i, item in items.items():
            seeds = {tuple(item[k : k + 4]) for k in range(len(item) - 3)}
            score = smith_waterman(item, text) / (2 * len(item))
            if score >= 0.5 and seeds & {tuple(text[k : k + 4]) for k in range(len(text) - 3)}:
                expected[d, i] = score
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    own = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in leaks.leaked(docs, own).collect()} == expected


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            kept = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and personal.luhn(digits), "phone": 10 <= len(digits) <= 15}
            if kept[kind]:
                spans.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(spans)]


def test_base_spans_equal_the_patterns():
    draw = random.Random(6)
    parts = ["a", "b.c", "@", "x@y.z", "@@", "1", "23", ".", "256", "0.0.0.0", "+1", " ", "-", "(", ")", "4512463504900732",
             "é", "_", "%", "555 123-4567", "1.2.3.4.5"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 14)))
        assert personal.base_spans(text) == plain_spans(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 300000, "1" * 300000, "1." * 100000, "+1" + "(" * 200000, "@" * 200000, "a@" * 100000, "0" * 9000 + ".1.2.3"])
def test_long_runs_are_one_pass(text):
    personal.base_spans(text)


def test_leading_zeros_of_any_number_are_read():
    text = "0" * 9000 + "25.1.2.3 and 256.1.1.1"
    assert personal.base_spans(text) == [(0, 9008, "ip")]


def best_tags(scores, steps):
    """Every sequence of tags, the best first."""
    from itertools import product

    def value(tags):
        whole = (0, *tags, 0)
        return sum(s[t] for s, t in zip(scores, tags, strict=True)) + sum(steps[a, b] for a, b in zip(whole, whole[1:], strict=False))

    return list(max(product(range(steps.shape[0]), repeat=len(scores)), key=value))


def test_viterbi_equals_every_sequence():
    draw = np.random.default_rng(8)
    steps = draw.standard_normal((3, 3))
    scores = [draw.standard_normal((n, 3)) * 2 for n in (1, 2, 4, 5, 3)]
    assert [t.tolist() for t in personal.viterbi(scores, steps)] == [best_tags(s, steps) for s in scores]


def test_marginals_equal_every_sequence():
    from itertools import product

    draw = np.random.default_rng(9)
    scores, steps = draw.standard_normal((1, 3, 2)), draw.standard_normal((2, 2))
    chance, pairs = personal._marginals(scores, steps, np.ones((1, 3), bool))
    weight, expected, expected_pairs = 0.0, np.zeros((3, 2)), np.zeros((2, 2))
    for tags in product(range(2), repeat=3):
        whole = (0, *tags, 0)
        w = np.exp(sum(scores[0, i, t] for i, t in enumerate(tags)) + sum(steps[a, b] for a, b in zip(whole, whole[1:], strict=False)))
        weight += w
        for i, t in enumerate(tags):
            expected[i, t] += w
        for a, b in zip(whole, whole[1:], strict=False):
            expected_pairs[a, b] += w
    assert np.allclose(chance[0], expected / weight) and np.allclose(pairs, expected_pairs / weight)


def test_split_decoding_equals_whole_texts():
    model = personal.default_model()
    assert model.exact_split
    whole = personal.Crf(model.tags, model.weights, model.steps, False)
    draw = random.Random(7)
    words = [w.partition("~")[0] for row in personal.LABELLED for w in row.split()]
    texts = [" ".join(draw.choice(words) for _ in range(30)) for _ in range(80)]
    assert personal.crf_spans(texts, model) == personal.crf_spans(texts, whole)


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 0), (3, "ask me@site.example.org or password=9f2c41aa07bb now", 50), (3, "plain words only.", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    model = personal.default_model()
    found = personal.find(docs.withColumn("spans", F.lit("old")), model).collect()
    assert [r.spans for r in found] == ["", "", "email:4:23,secret:36:48", ""]
    new = personal.redacted(docs, model).collect()
    assert [r.text for r in new] == [None, "", "ask [EMAIL] or password=[SECRET] now", "plain words only."]
    assert [r.n_chars for r in new] == [7, 0, len(new[2].text), 17]
    assert personal.find(docs.limit(0), model).count() == 0


def test_urls_rules_and_model(spark):
    labelled = spark.createDataFrame([*URL_LABELS, (None, 1), ("http://x.example.com", None)], "url string, label int")
    model = urls.train(labelled)
    rows = ["https://A.Example.ORG/es/1?q", "http://example.org/en/15", "http://x.example.com/de/1", "http://x.com/fr/2#top",
            "http://notexample.org?x/y", None, "no scheme/de/", "http://best-casino-win.example.net/en/3", "http://x.com",
            "http://com/de/", "https://the.example.net/en/5", "x" * 20000 + "://h.net/" + "p" * 20000, ""]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(rows)], "page_id long, url string, rule string")
    out = urls.judged(pages, model, URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in out[:5]] == [
        ("a.example.org", "/es/1"), ("example.org", "/en/15"), ("x.example.com", "/de/1"), ("x.com", "/fr/2"), ("notexample.org", "")]
    assert [r.rule for r in out[:10]] == [
        "example.org/es/", "example.org/en/1", "com/de/", "com/fr/", None, None, None, None, None, "com/de/"]
    assert [r.verdict for r in out] == ["block", "block", "block", "allow", out[4].verdict, out[5].verdict, out[6].verdict, "block",
                                        out[8].verdict, "block", "allow", out[11].verdict, out[12].verdict]
    assert out[5].host == "" and out[5].path == "" and out[11].host == "h.net" and len(out[11].path) == 20001
    assert urls.judged(pages.limit(0), model, URL_RULES).count() == 0
    assert urls.train(labelled.limit(0)).intercept == -1.0


def test_url_model_equals_plain_gradient_steps(spark):
    rows = [("http://spam.example.com/a", 1), ("http://good.example.org/b", 0), ("http://fine.example.net/c", 0)]
    frame = spark.createDataFrame(rows, "url string, label int")
    slots = [(set(r.s), r.label) for r in frame.select(
        urls.slots_of(urls.host_of(F.col("url")), urls.path_of(F.col("url")), 64).alias("s"), "label").collect()]
    model, weights, start = urls.train(frame, rounds=3, slots=64), np.zeros(64), np.log(1 / 2)
    for _ in range(3):
        step = np.zeros(64)
        for own, label in slots:
            miss = label - 1 / (1 + np.exp(-(start + weights[list(own)].sum())))
            step[list(own)] += 4.0 * miss / np.sqrt(len(own))
        weights = weights * (1 - 0.002 * 4.0) + step / 3
    assert np.allclose(model.weights, weights)


NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s> [\\INST]", "<s", "</", "[[INST]]", "\\", "", "plain", "a </s", "[INST] [/INST]text"]


def test_chats_round_trip(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, None, None), (None, 1, "user", "x"), (3, 1, "</s>", "odd role"), (3, 1, "</s>", "odd role"), (3, None, "user", "first")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.rendered(chat.messages(chat.turn_events(turns)))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.withColumn("turns", chat.parsed(F.col("formatted"))).collect()}
    assert got[1] == [(r[2], r[3]) for r in rows[: len(NASTY)]]
    assert got[2] == [("", "")] and got[None] == [("user", "x")]
    assert got[3] == [("user", "first"), ("</s>", "odd role"), ("</s>", "odd role")]
    learnt = {r.conv_id: r.t for r in out.select("conv_id", chat.learnt_text(F.col("formatted"), F.col("loss_mask")).alias("t")).collect()}
    assert learnt[1] == "".join(NASTY[::2]) and learnt[2] == ""
    assert chat.rendered(chat.messages(chat.turn_events(turns.limit(0)))).count() == 0


def test_events_are_folded(spark):
    rows = [(1, 0, "m1", "message", "user", "hi"), (1, 1, "m2", "message", "assistant", "a"), (1, 2, "m2", "delta", None, "b"),
            (1, 2, "m2", "delta", None, "b"), (1, 3, "m2", "regenerate", None, ""), (1, 4, "m2", "delta", None, "c"),
            (1, 5, "m1", "edit", None, "hello"), (1, 6, "m2", "delta", None, "d")]
    events = spark.createDataFrame(rows[::-1], "conv_id long, seq long, message string, kind string, role string, text string")
    out = {(r.seq, r.role, r.text) for r in chat.messages(events).collect()}
    assert out == {(0, "user", "hello"), (1, "assistant", "cd")}
