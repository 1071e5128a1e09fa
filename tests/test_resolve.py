from __future__ import annotations

import itertools
import random
import re

import pytest

from shelfwise import session
from shelfwise.operators import catalog, fragments, resolve

CASES = {
    "[2,2] Roaster One - Kilo AA": (2, "ids"),
    "[2, 2,7] Roaster One - Kilo AA": (2, "ids"),
    "[999,999] Roaster One - Rwanda & Friends": (20, "title"),
    "[999,999] Rwanda & Friends": (20, "title"),
    "Rwanda & Friends": (20, "title"),
    "  Rwanda & Friends  \nwhy it is interesting": (20, "title"),
    "Kilo AA": (4, "title"),
}
UNRESOLVED = {
    "[x,1] Kilo AA": "malformed key",
    "[12": "malformed key",
    "[5] Kilo AA": "malformed key",
    "Sunrise Blend": "no such option",
}


def test_order_strings(golden, spark):
    options = catalog.available_options(golden.beans, golden.no_orders)
    texts = [*CASES, *UNRESOLVED]
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id INT, text STRING")
    resolved, rejects = resolve.resolve_order_strings(requests, options)
    got = {texts[r.request_id]: (r.variant_id, r.matched_by) for r in resolved.collect()}
    assert got == CASES
    assert {r.text: r.reason for r in rejects.collect()} == UNRESOLVED
    assert {r.price_paid for r in resolved.collect() if r.variant_id == 4} == {19.0}
    assert {r.quantity for r in resolved.collect()} == {1}


@pytest.mark.parametrize("few", [session.FEW_ROWS, 0])
def test_many_options_are_not_broadcast_to_order_strings(golden, spark, monkeypatch, few):
    monkeypatch.setattr(session, "FEW_ROWS", few)
    options = catalog.available_options(golden.beans, golden.no_orders)
    texts = [*CASES, *UNRESOLVED]
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id INT, text STRING")
    resolved, rejects = resolve.resolve_order_strings(requests, options)
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == (3 if few else 0)
    assert {texts[r.request_id]: (r.variant_id, r.matched_by) for r in resolved.collect()} == CASES
    assert {r.text: r.reason for r in rejects.collect()} == UNRESOLVED


def test_title_needs_the_default_form(golden, spark):
    options = catalog.available_options(golden.beans, golden.no_orders).replace(
        "Whole Bean", "Beans", ["option2"]
    )
    texts = [(1, "Kilo AA"), (2, "[2,2] x")]
    requests = spark.createDataFrame(texts, "request_id INT, text STRING")
    resolved, _ = resolve.resolve_order_strings(requests, options)
    assert [r.request_id for r in resolved.collect()] == [2]


def test_name_states(golden, spark):
    fragments = spark.createDataFrame(
        [("sunrise",), ("kilo",), ("zzz",), ("K",), ("kilo%a",), ("",)], "fragment STRING"
    )
    rows = {r.fragment: r for r in resolve.resolve_names(fragments, golden.beans).collect()}
    assert (rows["sunrise"].state, rows["sunrise"].variant_id) == ("unique", 1)
    assert (rows["kilo"].state, rows["kilo"].n_matches) == ("ambiguous", 2)
    assert rows["kilo%a"].n_matches == 2
    assert (rows["zzz"].state, rows["zzz"].product_id) == ("none", None)
    assert rows["K"].n_matches == 3
    assert rows[""].n_matches == 12


def like(fragment: str, name: str) -> bool:
    pattern = "".join(
        {"%": ".*", "_": "."}.get(char, re.escape(char)) for char in fragment.lower()
    )
    return re.search(pattern, name.lower(), re.S) is not None


def test_fragment_matching_against_brute_force(spark):
    names = ["ab", "abc", "ABCD", "b_d", "a%c", "xaby", "d\\e", "", "été", "aa aa"]
    fragments = [
        "a", "AB", "abc", "abcd", "b", "_", "__", "%", "a%c", "a_c", "bcd", "b%d", "\\", "d\\e",
        "é", "zz", "ab%", "%b%d", "a a", "_____",
    ]
    rows = spark.createDataFrame(
        [(n, n, 1.0, "r", name) for n, name in enumerate(names * 2)],
        "product_id INT, variant_id INT, price DOUBLE, roaster_name STRING, parent_title STRING",
    )
    wanted = spark.createDataFrame([(f,) for f in fragments], "fragment STRING")
    expected = {
        (f, n)
        for f, (n, name) in itertools.product(fragments, enumerate(names * 2))
        if like(f, name)
    }
    matched = resolve.match_fragments(wanted, rows).collect()
    assert len(matched) == len(expected)
    assert {(r.fragment, r.product_id) for r in matched} == expected
    counts = {r.fragment: r.n_matches for r in resolve.resolve_names(wanted, rows).collect()}
    assert counts == {f: sum(1 for g, _ in expected if g == f) for f in fragments}


@pytest.mark.parametrize("group_rows", [1, 7, 10**6])
def test_ranges_do_not_change_the_result(golden, spark, group_rows):
    wanted = spark.createDataFrame([("kilo",), ("an",), ("s%d",), (None,)], "fragment STRING")
    rows = resolve.resolve_names(wanted, golden.beans, group_rows=group_rows).collect()
    counts = {r.fragment: r.n_matches for r in rows}
    assert counts == {"kilo": 2, "an": 4, "s%d": 3, None: 0}


@pytest.mark.parametrize("group_rows", [20, 10**6])
def test_random_names_against_brute_force(spark, group_rows):
    """Names of few letters, so that most hold a fragment several times and share their ends."""
    draw = random.Random(group_rows)
    names = sorted({"".join(draw.choices("ab é", k=draw.randrange(9))) + draw.choice(["", " bab"]) for _ in range(150)})
    texts = sorted({"".join(draw.choices("abé _%", [4, 4, 1, 1, 0.3, 0.3], k=draw.randrange(1, 6))) for _ in range(80)} | {"", "zz"})
    rows = spark.createDataFrame([(n, n, 1.0, name) for n, name in enumerate(names)], "product_id LONG, variant_id LONG, price DOUBLE, parent_title STRING")
    wanted = spark.createDataFrame([(t,) for t in texts], "fragment STRING")
    expected = {t: [n for n, name in enumerate(names) if like(t, name)] for t in texts}
    for r in resolve.resolve_names(wanted, rows, group_rows=group_rows).collect():
        assert r.n_matches == len(expected[r.fragment]), r.fragment
        assert r.product_id == (expected[r.fragment][0] if r.n_matches == 1 else None)
    pairs = sorted((r.fragment, r.product_id) for r in resolve.match_fragments(wanted, rows, group_rows=group_rows).collect())
    assert pairs == sorted((t, n) for t, found in expected.items() for n in found)


def test_suffixes_count_a_name_once():
    for name in ("", "a", "aaaa", "abab", "banana", "été"):
        for longest in (1, 2, 9):
            rows = fragments.suffixes(name, longest)
            for size in range(longest + 1):
                for text in {name[at : at + size] for at in range(len(name) - size + 1)}:
                    assert sum(s.startswith(text) and shared < len(text) for s, shared in rows) == 1


def test_bulk_orders_report_what_was_not_found(golden, spark):
    fragments = spark.createDataFrame([("sunrise",), ("kilo",), ("zzz",)], "fragment STRING")
    resolved = resolve.resolve_names(fragments, golden.beans)
    requests, missing = resolve.order_requests_by_name(resolved)
    assert [(r.fragment, r.variant_id, r.quantity, r.price_paid) for r in requests.collect()] == [
        ("sunrise", 1, 1, 20.0)
    ]
    assert {r.fragment: r.state for r in missing.collect()} == {"kilo": "ambiguous", "zzz": "none"}


def test_only_suffixes_that_start_with_a_fragment_are_sent(spark):
    names = spark.createDataFrame([(f"red ring seller#{n:05d}", 1) for n in range(300)], "_name string, _n long")
    wanted = spark.createDataFrame([("ring",), ("zz",), ("red ring seller#00007",), ("",)], "_fragment string")
    texts, _ = fragments._dealt(names, wanted, 10**6)
    # Two places of each name, and what a flag set by chance lets through; 21 letters before.
    assert texts.count() < 3 * 300
    counts = {r["_fragment"]: r.n_matches for r in fragments.counts(names, wanted).collect()}
    assert counts == {"ring": 300, "red ring seller#00007": 1, "": 300}


def test_flags_keep_every_place_where_a_fragment_starts(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab é😀", k=draw.randrange(12))) for _ in range(60)]
    found = sorted({t[at : at + draw.randrange(1, 9)] for t in texts for at in range(len(t))})[::3]
    flags = fragments._flags(spark.createDataFrame([(t,) for t in found], "_fragment string"))
    for text, starts in zip(texts, flags.starts(texts), strict=True):
        assert {at for at in range(len(text)) if any(text.startswith(f, at) for f in found)} <= set(starts)


def test_a_wanted_pattern_is_compiled_for_likely_names_only(spark):
    """Names share the longest text of a fragment; the other texts are looked for first."""
    names = spark.createDataFrame([("red ring shop",), ("hot bolt shop",), ("hot ring shop",)], "_name string")
    wanted = spark.createDataFrame([("hot%ring%shop",), ("r%shop",), ("shop%",), ("ring%hot",)], "_fragment string")
    found = resolve._matches(names, wanted, 10**6)
    assert "Contains(_name" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(
        (f["_fragment"], n["_name"]) for f in wanted.collect() for n in names.collect() if like(f["_fragment"], n["_name"])
    )
