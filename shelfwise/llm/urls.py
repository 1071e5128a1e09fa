"""URL filter: domain rules first, a logistic regression on hashed character n-grams for the rest.

Only DataFrame and SQL functions. The host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A null URL,
or one without ``://``, has an empty host and path, fits no rule and is judged by the intercept.
Repeated rows are judged each, URLs of any length whole. Other columns stay; added names replace
columns of the same name.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 2048
WIDTHS = (3, 4, 5)


@dataclass(frozen=True)
class UrlModel:
    """A weight per slot; ``slots`` of them bound the model's size."""

    intercept: float
    weights: tuple[float, ...]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def slots_of(host: Column, path: Column, slots: int = SLOTS) -> Column:
    """The different slots of the character n-grams of a host and of a path."""

    def grams(text: Column, name: str) -> Column:
        """All n-grams of a text, from its characters; these are an array, read once."""

        def run(letters: Column, width: int):
            return lambda i: F.concat(F.lit(name), *[letters[i + k] for k in range(width)])

        def of(letters: Column) -> Column:
            parts = []
            for width in WIDTHS:
                places = F.when(F.size(letters) >= width, F.sequence(F.lit(0), F.size(letters) - width))
                parts.append(F.transform(F.coalesce(places, F.array().cast("array<int>")), run(letters, width)))
            return F.concat(*parts)

        return F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), of)[0]

    # A host is read between dots; digits of a path say nothing about other paths.
    marked = F.concat(F.lit("."), host, F.lit("."))
    plain = F.regexp_replace(path, "[0-9]+", "0")
    every = F.concat(grams(marked, "h:"), grams(plain, "p:"))
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(slots)).cast("int")))


def train(labelled: DataFrame, rounds: int = 30, rate: float = 4.0, ridge: float = 0.002, slots: int = SLOTS) -> UrlModel:
    """Fit to a small table ``(url, label)``, label 1 for block; rows with a null are ignored.

    Each round is one aggregation of the gradient by slot over the labelled rows. With no rows of one
    of the labels the model says that of the other; with no rows, allow.
    """
    rows = labelled.where("url is not null and label is not null").select(
        F.col("label").cast("double").alias("label"), slots_of(host_of(F.col("url")), path_of(F.col("url")), slots).alias("slots")
    ).cache()
    try:
        count, positive = rows.agg(F.count("*"), F.sum("label")).first()
        if not count:
            return UrlModel(-1.0, (0.0,) * slots)
        share = min(max(positive / count, 0.5 / (count + 1)), 1 - 0.5 / (count + 1))
        model = UrlModel(math.log(share / (1 - share)), (0.0,) * slots)
        for _ in range(rounds):
            miss = F.col("label") - block_probability(F.col("slots"), model)
            # Texts of many n-grams must not outweigh others: steps are scaled by their number.
            step = rate * miss / F.sqrt(F.greatest(F.size("slots"), F.lit(1)))
            gradient = dict(
                rows.select(step.alias("step"), F.explode("slots").alias("slot"))
                .groupBy("slot").agg(F.sum("step")).collect()
            )
            model = UrlModel(
                model.intercept,
                tuple(w * (1 - ridge * rate) + gradient.get(i, 0.0) / count for i, w in enumerate(model.weights)),
            )
        return model
    finally:
        rows.unpersist()


def block_probability(slots: Column, model: UrlModel) -> Column:
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")
    total = F.aggregate(slots, F.lit(model.intercept), lambda s, i: s + F.element_at(weights, i + 1))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judged(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``block_probability`` and ``verdict``.

    ``rules`` are (verdict, ``host/path``): a rule fits its host and all subdomains where the path
    starts with the rule's. The longest wins, the first of two equally long ones.
    """
    url = F.col("url").cast("string")
    host, path = F.col("host"), F.col("path")
    names = ("host", "path", "rule", "block_probability", "verdict")
    kept = [c for c in pages.columns if c not in names]
    frame = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))

    def fits(rule: str) -> Column:
        domain, start = rule.split("/", 1)
        under = (host == domain) | F.endswith(host, F.lit("." + domain))
        return under & F.startswith(path, F.lit("/" + start))

    order = sorted(rules, key=lambda r: -len(r[1]))
    rule = F.coalesce(*[F.when(fits(r), F.lit(r)) for _, r in order], F.lit(None).cast("string"))
    given = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for v, r in order], F.lit(None).cast("string"))
    chance = block_probability(slots_of(host, path, len(model.weights)), model)
    frame = frame.withColumn("rule", rule).withColumn("block_probability", chance)
    own = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return frame.withColumn("verdict", F.coalesce(given, own))
