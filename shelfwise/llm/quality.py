"""Quality scores by Bradley-Terry ranking of labelled documents.

Each document is a row of figures of its whole text. Pairs of a good and a bad document teach a
linear strength by logistic loss on the difference of their figures; the score is the logistic of
the strength, moved so that ``cut`` falls on the quantile of strengths that the share of bad labels
names. Null and empty texts have all figures zero and are scored like any other. Labels that repeat
count once each; labels that are null, or of no document, are ignored. If one of the labels is
missing every document gets the smoothed share of label 1 and that label as its prediction. Rows
that share a ``doc_id`` are scored each; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import chunks, prepare, staged

LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, BAR, OTHER = range(8)
KINDS = 8
FIGURES = 17
PIECE = 1 << 20


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            table[code] = UPPER if letter.isupper() else LOWER
        elif letter.isdigit():
            table[code] = DIGIT
        elif letter.isspace():
            table[code] = SPACE
    for letters, kind in ((".,;:?'\"()-", STOP), ("!", SHOUT), ("|", BAR)):
        for letter in letters:
            table[ord(letter)] = kind
    return table


def text_figures(text: str, counts: np.ndarray) -> list[float]:
    """Shares of kinds of characters, and how words and lines repeat. ``counts`` has each kind's."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    if not words:
        return [0.0] * FIGURES
    number, chars = len(words), max(int(counts.sum() - counts[SPACE]), 1)
    letters = max(int(counts[LOWER] + counts[UPPER]), 1)
    distinct = len(set(words)) / number
    again = sum(map(operator.eq, words, words[1:])) / number
    upper, other = counts[UPPER] / letters, counts[OTHER] / chars
    bar, shout, stop = counts[BAR] / chars, counts[SHOUT] / chars, counts[STOP] / chars
    closed = sum(x[-1] in ".!?:\"'" for x in lines) / len(lines)
    return [
        math.log1p(number) / 10, letters / chars, upper, min(upper, 0.3), counts[DIGIT] / chars, stop,
        min(shout, 0.05), min(bar, 0.05), min(other, 0.05), other, chars / number / 10,
        distinct, distinct * math.log1p(number) / 10, min(again, 0.1), again, len(set(lines)) / len(lines), closed,
    ]


def figures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``figures`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[list[float]] = []
            for a, b in chunks(map(len, texts), PIECE):
                codes = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "replace"), np.uint32)
                kinds, at = _kinds()[codes], 0
                for text in texts[a:b]:
                    rows.append(text_figures(text, np.bincount(kinds[at : at + len(text)], minlength=KINDS)))
                    at += len(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "figures"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, figures array<double>")


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    shift: float


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float, steps: int, seed: int) -> np.ndarray:
    """Weights that put the first of each (good, bad) pair ahead, by Newton steps on logistic loss."""
    choice = np.random.default_rng(seed)
    each = np.concatenate([good, bad])
    scale = each.std(axis=0)
    scale[scale < 1e-9] = 1.0
    # Every document is in a pair; the smaller side is used again and again.
    count = max(len(good), len(bad), pairs)
    left = np.resize(choice.permutation(len(good)), count)
    right = np.resize(choice.permutation(len(bad)), count)[choice.permutation(count)]
    ahead = (good[left] - bad[right]) / scale
    weights = np.zeros(ahead.shape[1])
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(ahead @ weights, -30, 30)))
        slope = ahead.T @ lost / count - ridge * weights
        curve = (ahead * (lost * (1 - lost))[:, None]).T @ ahead / count + ridge * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    return weights / scale


def train(
    labelled: DataFrame, cut: float = 0.3, sample: int = 20_000, pairs: int = 60_000,
    ridge: float = 1e-3, steps: int = 12, seed: int = 7,
) -> QualityModel:
    """Fit to rows ``(doc_id, figures, quality)``.

    The weights come from at most ``sample`` rows of each label, those with the smallest hash of
    their ``doc_id``; the quantile of the cut is over all labelled rows.
    """
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "figures"), F.lit(1 << 30))
    taken = []
    for label in (1, 0):
        rows = labelled.where(F.col("quality") == label).select("figures", place.alias("place"))
        # Only rows that can be among the first are sorted and sent; twice as many as are taken.
        share = min(1.0, 2 * sample / max(rows.count(), 1))
        rows = rows.where(F.col("place") <= int(share * (1 << 30))).orderBy("place", "figures").limit(sample)
        figures_of = rows.select("figures").toPandas()["figures"].tolist()
        taken.append(np.array(figures_of, float).reshape(-1, FIGURES))
    good, bad = taken
    if not len(good) or not len(bad):
        share = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return QualityModel((0.0,) * FIGURES, math.log(share / (1 - share)))
    weights = tuple(float(w) for w in bradley_terry(good, bad, pairs, ridge, steps, seed))
    strength = _strength(F.col("figures"), weights)
    share = labelled.agg(F.avg(F.when(F.col("quality") == 0, 1.0).otherwise(0.0))).first()[0]
    at = labelled.agg(F.percentile_approx(strength, float(share), 10000)).first()[0]
    # The cut lies between the strength at the quantile and the next one.
    above = labelled.where(strength > at).agg(F.min(strength)).first()[0]
    return QualityModel(weights, math.log(cut / (1 - cut)) - (at + (at if above is None else above)) / 2)


def _strength(figures: Column, weights: tuple[float, ...]) -> Column:
    total = F.lit(0.0)
    for place, weight in enumerate(weights):
        total = total + F.lit(weight) * figures[place]
    return total


def score(figures: Column, model: QualityModel) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_strength(figures, model.weights) + F.lit(model.shift))))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, cut: float = 0.3, sample: int = 20_000) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document; labels of documents where ``learn`` holds teach."""
    prepare(docs.sparkSession)
    all_figures = staged(figures(docs), "figures")
    known = labels.where("doc_id is not null and quality in (0, 1)").where(learn)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    labelled = staged(all_figures.join(known, "doc_id"), "labelled")
    model = train(labelled, cut, sample)
    result = all_figures.select("doc_id", score(F.col("figures"), model).alias("score"))
    return result.withColumn("predicted", (F.col("score") >= cut).cast("int"))
