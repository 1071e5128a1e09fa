"""Dictionary terms in texts, found without a join or a shuffle.

A dictionary is a short fixed list ``[(kind, term, value, role)]``. It becomes one pattern and one
literal map in the plan, so a text table of any size is matched in one narrow projection.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Term(NamedTuple):
    kind: str
    term: str
    value: str
    role: str = ""


def spaced_words(text) -> Column:
    """Lower-case words with one space between; everything but letters and digits separates them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def trie_pattern(terms: list[str]) -> str:
    """One pattern for all terms, as a trie of their letters: the longest term at a place wins.

    A branch is left at its first wrong letter, so the cost of a place does not grow with the number
    of terms.
    """
    trie: dict = {}
    for term in terms:
        node = trie
        for letter in term:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(letter) + pattern(node[letter]) for letter in sorted(node) if letter]
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return joined + "?" if "" in node else joined

    return f"(?<![^ ]){pattern(trie)}(?![^ ])"


def with_found_terms(
    texts: DataFrame, text: str, dictionary: list[Term], name: str = "_found"
) -> DataFrame:
    """Add the distinct dictionary entries that occur in each text, as (kind, value, role) in order.

    The text is read once, from left to right. Of the terms that start at a word the longest counts,
    and the words it covers are not read again: "red cherry" does not also mean "red".
    """
    entries: dict[str, list[Term]] = {}
    for entry in dictionary:
        entries.setdefault(entry.term, []).append(entry)
    known = F.create_map(
        *[
            part
            for term in sorted(entries)
            for part in (
                F.lit(term),
                F.array(*[
                    F.struct(F.lit(e.kind).alias("kind"), F.lit(e.value).alias("value"), F.lit(e.role).alias("role"))
                    for e in sorted(set(entries[term]))
                ]),
            )
        ]
    )
    hits = F.array_distinct(
        F.regexp_extract_all(spaced_words(F.col(text)), F.lit(trie_pattern(sorted(entries))), F.lit(0))
    )
    found = F.flatten(F.transform(hits, lambda term: known[term]))
    return texts.withColumn(name, F.array_distinct(F.sort_array(found)))


def found_values(found, kind: str, role: str | None = None) -> Column:
    """Sorted distinct values of one kind (and role) among the entries ``found``, which are in order."""

    def wanted(entry: Column) -> Column:
        own = entry["kind"] == kind
        return own if role is None else own & (entry["role"] == role)

    values = F.transform(F.filter(found, wanted), lambda e: e["value"])
    return F.array_distinct(values) if role is None else values
