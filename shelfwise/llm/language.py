"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased, every run of other characters is one blank. A text is given the language
whose model codes it in the fewest nats per character. Texts that are null, empty or without a
letter have no language (``und``); texts of any length are read whole. Languages are tried in
alphabetical order, so the first wins a tie. With no training rows every text is ``und``. Columns
of the input that share a name with an added one are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import chunks, prepare, staged

ORDER = 4
CHARACTERS = 16  # bits of a character in an n-gram of ORDER characters
BLANK, START = 32, 1
CHUNK = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Rejection:
    """``rate`` of calibration texts lie above the threshold.

    Up to ``length`` characters the excess over a language's usual entropy is scaled by the root of
    the length, because short texts vary more. An excess of ``margin`` nats over ``length``
    characters is always allowed: a few calibration texts do not show how far clean texts go.
    """

    rate: float = 0.0005
    length: int = 256
    margin: float = 0.75


@dataclass(frozen=True)
class LanguageModel:
    """Per order, sorted n-grams with log probabilities by language, and sorted contexts with log
    back-off weights. An n-gram takes 8 bytes and 4 a language."""

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    log_p: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    log_backoff: tuple[np.ndarray, ...]
    unseen: np.ndarray
    usual: np.ndarray
    limit: np.ndarray
    length: int = 256


@functools.lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    table = np.full(0x110000, BLANK, np.uint16)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = max(ord(low if len(low) == 1 else letter) % 65521, 33)
    return table


def gram_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of the texts, the number of characters of each text,
    and whether a text has a letter."""
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "replace"), np.uint32)
    symbols = _alphabet()[codes]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    padding = (starts[:, None] - np.arange(1, ORDER)).ravel()
    symbols[padding] = START
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] != BLANK) | (symbols[:-1] > BLANK)
    before = np.concatenate([[0], np.cumsum(kept)])
    real = before[starts + sizes] - before[starts]
    letters = np.concatenate([[0], np.cumsum(symbols > BLANK)])
    has_letter = letters[starts + sizes] > letters[starts]
    symbols = symbols[kept]
    return _grams(symbols)[symbols != START], real, has_letter


def _grams(symbols: np.ndarray) -> np.ndarray:
    wide = symbols.astype(np.uint64)
    grams = wide.copy()
    for back in range(1, ORDER):
        grams[back:] |= wide[:-back] << np.uint64(CHARACTERS * back)
    return grams


def long_gram_stream(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """The n-grams of a text longer than a chunk, in parts, and whether a part has a letter."""
    before = np.full(ORDER - 1, START, np.uint16)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "replace"), np.uint32)
        symbols = np.concatenate([before, _alphabet()[codes]])
        kept = np.ones(len(symbols), bool)
        kept[1:] = (symbols[1:] != BLANK) | (symbols[:-1] > BLANK)
        kept[: ORDER - 1] = True
        symbols = symbols[kept]
        yield _grams(symbols)[ORDER - 1 :], bool((symbols[ORDER - 1 :] > BLANK).any())
        before = symbols[-(ORDER - 1) :]


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``gram`` and its count ``n`` over all rows ``(lang, text)``; summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for a, b in chunks(map(len, own), CHUNK):
                    if len(own[a]) > CHUNK:
                        parts = (grams for grams, _ in long_gram_stream(own[a]))
                    else:
                        parts = (gram_stream(own[a:b])[0],)
                    for grams in parts:
                        counted = np.unique(grams, return_counts=True)
                        held.setdefault(lang, []).append(counted)
                        size += len(counted[0])
            if size > 1 << 21:
                held = {lang: [_merged(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > 1 << 20:
                    yield from _count_batches(held)
                    held, size = {}, 0
        yield from _count_batches({lang: [_merged(parts)] for lang, parts in held.items()})

    partial = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(grams))
    return grams, counts.astype(np.int64)


def _count_batches(held: dict) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        for grams, counts in parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"],
            )


def _tail(gram: Column, order: int) -> Column:
    """The last ``order`` characters of an n-gram."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << (CHARACTERS * order)) - 1).cast("long"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated Kneser-Ney estimates from counts of the highest order, for all orders and languages.

    Returns the n-grams ``(order, lang, gram, log_p)`` and the contexts ``(order, lang, gram,
    log_backoff)``. Lower orders count the different characters seen before an n-gram. The discount
    of an order and language is n1 / (n1 + 2 n2) over its n-grams seen once and twice.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = (
            tables[order + 1].groupBy("lang", _tail(F.col("gram"), order).alias("gram"))
            .agg(F.count("*").alias("n"))
        )
    below, grams, contexts = None, [], []
    for order in range(1, ORDER + 1):
        once, twice = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        discounts = tables[order].groupBy("lang").agg(
            F.greatest(F.lit(0.1), F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5))).alias("d"),
            F.count("*").alias("vocabulary"),
        )
        context = F.shiftrightunsigned("gram", CHARACTERS)
        totals = tables[order].groupBy("lang", context.alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds")
        )
        weights = totals.join(discounts, "lang").withColumn(
            "backoff", F.least(F.lit(1.0), F.col("d") * F.col("kinds") / F.col("total"))
        )
        weights = staged(weights, "weights")
        own = tables[order].withColumn("context", context).join(weights, ["lang", "context"])
        own = own.withColumn("p", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total"))
        if below is None:
            lower = F.lit(1.0) / (F.col("vocabulary") + 1)
        else:
            own = own.withColumn("tail", _tail(F.col("gram"), order - 1)).join(
                below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"]
            )
            lower = F.col("lower")
        below = staged(own.select("lang", "gram", (F.col("p") + F.col("backoff") * lower).alias("p")), "order")
        number = F.lit(order).alias("order")
        grams.append(below.select(number, "lang", "gram", F.log("p").alias("value")))
        contexts.append(weights.select(number, "lang", F.col("context").alias("gram"), F.log("backoff").alias("value")))
    return functools.reduce(DataFrame.unionByName, grams), functools.reduce(DataFrame.unionByName, contexts)


def _sorted(estimates: DataFrame, order: int, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-grams of an order and a value by language (not a number where a language has
    none). An n-gram is one row on its way to the driver."""
    own = estimates.where(F.col("order") == order)
    values = [
        F.max(F.when(F.col("lang") == lang, F.col("value"))).cast("float").alias(f"value_{i}")
        for i, lang in enumerate(languages)
    ]
    table = own.groupBy("gram").agg(F.count("*").alias("n"), *values).drop("n").toArrow()
    keys = table["gram"].to_numpy().view(np.uint64)
    place = np.argsort(keys)
    matrix = np.empty((len(keys), len(languages)), np.float32)
    for i in range(len(languages)):
        matrix[:, i] = table[f"value_{i}"].to_numpy()[place]
    return keys[place], matrix


def train(rows: DataFrame) -> LanguageModel:
    """Models of all languages from all rows ``(lang, text)``; rows with a null are ignored."""
    prepare(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null")
    counts = staged(gram_counts(rows), "counts")
    languages = [row["lang"] for row in counts.select("lang").distinct().orderBy("lang").collect()]
    grams, contexts = kneser_ney(counts)
    weights = [_sorted(contexts, order, languages) for order in range(1, ORDER + 1)]
    model = LanguageModel(
        tuple(languages), (), (), tuple(keys for keys, _ in weights),
        tuple(np.nan_to_num(values, copy=False, nan=0.0) for _, values in weights),
        np.zeros(len(languages), np.float32), np.zeros(len(languages)), np.full(len(languages), np.inf),
    )
    for order in range(1, ORDER + 1):
        keys, values = _sorted(grams, order, languages)
        if order == 1 and languages:
            # A character never seen in a language gets the interpolation weight of its unigrams.
            sizes = np.maximum(1, np.count_nonzero(~np.isnan(values), axis=0))
            model = _replace(model, unseen=model.log_backoff[0][0] - np.log(sizes + 1).astype(np.float32))
        if len(keys):
            tails = keys & np.uint64((1 << (CHARACTERS * (order - 1))) - 1)
            lower = log_p(model, tails, order - 1) + _backoff(model, keys, order)
            values = np.where(np.isnan(values), lower, values)
        model = _replace(model, grams=(*model.grams, keys), log_p=(*model.log_p, values))
    return model


def _replace(model: LanguageModel, **changes) -> LanguageModel:
    return LanguageModel(**{**model.__dict__, **changes})


def _find(known: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
    return place, known[place] == grams if len(known) else np.zeros(len(grams), bool)


def _backoff(model: LanguageModel, grams: np.ndarray, order: int) -> np.ndarray:
    place, seen = _find(model.contexts[order - 1], grams >> np.uint64(CHARACTERS))
    weights = np.zeros((len(grams), len(model.languages)), np.float32)
    weights[seen] = model.log_backoff[order - 1][place[seen]]
    return weights


def log_p(model: LanguageModel, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Log probability of the last character of each n-gram after the others, by language."""
    if order == 0:
        return np.broadcast_to(model.unseen, (len(grams), len(model.languages)))
    place, seen = _find(model.grams[order - 1], grams)
    if seen.all() and len(grams):
        return model.log_p[order - 1][place]
    values = np.empty((len(grams), len(model.languages)), np.float32)
    values[seen] = model.log_p[order - 1][place[seen]]
    rest = grams[~seen]
    tails = rest & np.uint64((1 << (CHARACTERS * (order - 1))) - 1)
    # Order 1 has one context, the empty one, and `unseen` holds its weight already.
    weights = _backoff(model, rest, order) if order > 1 else 0
    values[~seen] = log_p(model, tails, order - 1) + weights
    return values


def entropies(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character of each text in each language (infinite without a letter), and lengths."""
    totals = np.zeros((len(texts), len(model.languages)))
    lengths, lettered = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for a, b in chunks(map(len, texts), CHUNK):
        if len(texts[a]) > CHUNK:
            for grams, letter in long_gram_stream(texts[a]):
                totals[a] += log_p(model, grams).sum(axis=0, dtype=np.float64)
                lengths[a] += len(grams)
                lettered[a] |= letter
            continue
        grams, lengths[a:b], lettered[a:b] = gram_stream(texts[a:b])
        scores = log_p(model, grams).astype(np.float64)
        sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
        ends = np.cumsum(lengths[a:b])
        totals[a:b] = sums[ends] - sums[ends - lengths[a:b]]
    return np.where(lettered[:, None], -totals / np.maximum(lengths, 1)[:, None], np.inf), lengths


def calibrated(model: LanguageModel, rows: DataFrame, rejection: Rejection = Rejection()) -> LanguageModel:
    """The model with a rejection threshold per language, from rows ``(lang, text)`` it was not fitted on.

    As in ``identify`` a text counts for its best language, so a wrong label does not raise a threshold.
    """
    languages, least_limit = list(model.languages), rejection.margin * rejection.length**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            known = [i for i, x in enumerate(langs) if x in languages]
            nats, lengths = entropies(model, [texts[i] for i in known])
            best = nats.argmin(axis=1) if known else []
            own = nats[np.arange(len(known)), best] if known else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([languages[i] for i in best], pa.string()), pa.array(own, pa.float64()), pa.array(lengths)],
                names=["lang", "nats", "length"],
            )

    scored = rows.select("lang", "text").mapInArrow(run, "lang string, nats double, length long")
    scored = staged(scored.where(F.col("nats") < float("inf")), "calibration")
    usual = scored.groupBy("lang").agg(F.percentile_approx("nats", 0.5, 10000).alias("usual"))
    excess = (F.col("nats") - F.col("usual")) * F.sqrt(F.least(F.col("length"), F.lit(rejection.length)))
    found = {
        row["lang"]: row
        for row in scored.join(usual, "lang").groupBy("lang")
        .agg(F.first("usual").alias("usual"), F.percentile_approx(excess, 1 - rejection.rate, 10000).alias("high"))
        .collect()
    }
    return _replace(
        model, length=rejection.length,
        usual=np.array([found[x]["usual"] if x in found else 0.0 for x in languages]),
        limit=np.array(
            [max(found[x]["high"], least_limit) if x in found else np.inf for x in languages]
        ),
    )


ADDED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("nats", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score``, ``nats`` and ``accepted``.

    ``score`` is the share of the chosen language when all are weighted by their likelihood over at
    most 50 characters of the text's average. ``accepted`` is false for ``und`` and for texts whose
    cross-entropy exceeds the calibrated limit of the language.
    """
    kept = [name for name in docs.columns if name not in ADDED.names]
    languages = np.array([*model.languages, UNDETERMINED], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            if model.languages:
                nats, lengths = entropies(model, texts)
                best = nats.argmin(axis=1)
                least = nats[np.arange(len(texts)), best]
                known = np.isfinite(least)
                gap = np.where(known[:, None], nats - np.where(known, least, 0)[:, None], 0)
                score = np.where(known, 1 / np.exp(-gap * np.minimum(lengths, 50)[:, None]).sum(axis=1), 0)
                excess = (least - model.usual[best]) * np.sqrt(np.minimum(lengths, model.length))
                accepted = known & (excess <= model.limit[best])
                best = np.where(known, best, len(model.languages))
            else:
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                known = accepted = np.zeros(len(texts), bool)
                least = np.zeros(len(texts))
            added = [
                pa.array(languages[best], pa.string()), pa.array(score),
                pa.array(least, mask=~known), pa.array(accepted),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, *ADDED.names])

    source = docs.select(*kept)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, *ADDED.fields]))


def trained_and_calibrated(rows: DataFrame, key: Column, parts: int = 10) -> LanguageModel:
    """Fit on nine parts of the rows by a hash of ``key``, calibrate on the tenth."""
    part = F.pmod(F.xxhash64(F.lit("calibration"), key), F.lit(parts))
    return calibrated(train(rows.where(part != 0)), rows.where(part == 0))
