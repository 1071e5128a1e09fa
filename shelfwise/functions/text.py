"""Column helpers for titles, keys, labels and money."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(column) -> Column:
    """Null where the text is empty."""
    return F.nullif(column, F.lit(""))


def present(column) -> Column:
    """True where the text is neither null nor empty."""
    return F.coalesce(column != "", F.lit(False))


def title_case(column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    Unlike ``initcap`` a run also starts after ``_``, ``-`` and ``'``.
    """
    runs = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def strip(column) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def safe_title(column) -> Column:
    """Letters, digits, space, ``-`` and ``_`` only, trimmed."""
    return F.trim(F.regexp_replace(column, r"[^\p{L}\p{N} _-]", ""))


def first_line(column) -> Column:
    return strip(F.split(column, "\n")[0])


def contains_any(column, terms) -> Column:
    """True where the text holds one of the fragments, in any case; null for null text."""
    text = F.lower(column)
    return reduce(or_, (text.contains(term.lower()) for term in terms))


def csv_to_array(column) -> Column:
    """Comma text to array; null and empty text give an empty array."""
    return F.when(present(column), F.split(column, ",")).otherwise(
        F.array().cast("array<string>")
    )


def list_or_text(column) -> Column:
    """Join a JSON list that arrived in a text field with ``', '``; keep other text whole."""
    items = F.from_json(column, "array<string>")
    return F.when(column.startswith("["), F.coalesce(F.array_join(items, ", "), column)).otherwise(
        column
    )


def money_text(column) -> Column:
    """Two decimals without grouping marks."""
    return F.format_string("%.2f", column.cast("double"))


def day_text(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def type_label(flag) -> Column:
    """Display name of the three-valued single-origin flag."""
    return F.when(flag, "Single Origin").when(~flag, "Blend").otherwise("Unknown")


def varietals_text(varietals) -> Column:
    """Comma text of a varietal array, ``None`` when there is none."""
    return F.when(F.size(varietals) > 0, F.array_join(varietals, ", ")).otherwise("None")


def name_after_dash(column) -> Column:
    """Text after the first ``' - '``; null without one."""
    at = F.instr(column, " - ")
    return F.when(at > 0, F.substr(column, at + 3))


def parse_day(column) -> Column:
    """Read ``YYYY-MM-DD`` or ``YYYY-MM-DD HH:MM:SS.ffffff``; other texts give null."""
    return F.coalesce(
        F.try_to_timestamp(column, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
    )


def as_money(column) -> Column:
    """Exact two-decimal value for sums: doubles would add up differently per partitioning."""
    return column.cast("decimal(18,2)")


def sum_money(column) -> Column:
    return F.sum(as_money(column)).cast("double")
