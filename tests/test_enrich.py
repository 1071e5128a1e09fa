from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as t
from shelfwise.functions.regions import region_text
from shelfwise.functions.terms import Term, found_values, with_found_terms
from shelfwise.operators import enrich


def column(spark, values, build):
    rows = spark.createDataFrame(list(enumerate(values)), "n INT, s STRING")
    out = rows.select("n", build(F.col("s")).alias("v")).orderBy("n").collect()
    return [r.v for r in out]


def test_region_text(spark):
    pages = {
        None: "", "": "", "<div class='x'>A</div><p class='desc'>B</p>": "",
        '<div class="Product-DESCription big">A<br>\n  B \n\n</div>': "A\nB",
        '<div class="desc">A\n<div class="desc-inner">B</div></div>': "A\nB\nB",
        '<div class="desc">A<script>x()</script><style>p{}</style></div>': "A",
        '<div class="desc">Tom &amp; Co</div>': "Tom & Co",
        '<div class="desc">A<p>B<!-- c -->D</div>E<div class="mydesc"/>': "ABD",
        '<div class="desc">a<b>x</b>  <i>y</i>&#8364;</div>': "ax y€",
        '<div class="desc">open\nto the end': "open\nto the end",
    }
    got = column(spark, list(pages), lambda s: region_text(s))
    assert got == list(pages.values())


def test_altitude(spark):
    cases = {
        "1.800 m": "1800", "1.500 - 1.800 masl": "1500-1800",
        "1600-1900 masl": "1600-1900", "1,750m": "1750", "5,200 - 6,000 ft": "1585-1829",
        "grown high": None, "Altitude: 1200 to 1400 metres": "1200-1400", None: None,
    }
    assert column(spark, list(cases), enrich.altitude) == list(cases.values())


def test_labels(spark):
    text = "Lot 7\n Farm: El Paraiso \r\nProducer: Ana Diaz"
    assert column(spark, [text], lambda s: enrich.labelled(s, "farm")) == ["El Paraiso"]
    assert column(spark, [text], lambda s: enrich.grower(s, F.lit("Shop"))) == ["Ana Diaz"]
    assert column(spark, [text], lambda s: enrich.grower(s, F.lit("ana diaz"))) == [None]


@pytest.mark.parametrize(
    ("process", "roast", "varietals", "metres", "expected"),
    [
        ("Washed", None, [], None, (7, 10, 8)),
        ("Natural", "Light", ["SL28"], 1700, (14, 21, 17)),
        ("Washed", "Dark", [], 900, (4, 8, 6)),
        ("Honey; Anaerobic", "Filter", ["Bourbon"], 1600, (12, 17, 14)),
        (None, "Light", [], 1700, (None, None, None)),
        ("Anaerobic", None, [], None, (None, None, None)),
    ],
)
def test_resting_period(spark, process, roast, varietals, metres, expected):
    rows = spark.createDataFrame(
        [(process, roast, varietals, metres)], "p STRING, r STRING, v ARRAY<STRING>, m INT"
    )
    low, high = enrich.resting_range(F.col("p"), F.col("r"), F.col("v"), F.col("m"))
    assert tuple(rows.select(low, high, enrich.resting_days(low, high)).first()) == expected


def test_attributes_of_a_text(spark):
    text = (
        "Kenya Nyeri AA\nLight roast, washed, double fermented. SL28 and Ruiru 11.\n"
        "Altitude 1700 masl\nFarm: Gatomboya\nProducer: Shop\nDark chocolate, Black tea and lemon"
    )
    rows = spark.createDataFrame(
        [(1, text, "shop"), (2, "House blend of Brazil", "x"), (3, "Brazil or Peru", "x"),
         (4, "", "x"), (5, None, "x"), (6, "Brazil Santos", "x"),
         (7, "Huila and Tolima lots, Colombia", "x"), (8, "Huila, Colombia", "x")],
        "product_id INT, text STRING, seller STRING",
    )
    found = enrich.extract_attributes(rows, roaster_name="seller")
    r = {row.product_id: row for row in found.collect()}
    assert r[1].is_single_origin is True
    assert (r[1].origin.country, r[1].origin.region) == ("Kenya", "Nyeri")
    assert r[1].processing_method == "Washed; Double Fermented"
    assert r[1].varietals == ["Ruiru 11", "SL28"] and r[1].altitude == "1700"
    assert (r[1].farm, r[1].producer, r[1].roast_level) == ("Gatomboya", None, "Light")
    assert r[1].tasting_notes.fruits == ["Lemon"]
    assert r[1].tasting_notes.sweets == ["Dark Chocolate"]
    assert r[1].tasting_notes.others == ["Black Tea"]
    assert r[1].resting_period_days == 14 and r[1].confidence_score == pytest.approx(0.8889)
    assert r[2].is_single_origin is False and r[3].is_single_origin is False
    for empty in (r[4], r[5]):
        assert empty.is_single_origin is None and empty.confidence_score == 0.0
        assert empty.varietals == [] and empty.resting_period_days is None
    assert r[6].is_single_origin is None and r[7].is_single_origin is False
    assert r[8].is_single_origin is True
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_payloads(spark):
    payloads = {
        "{}": "empty", '{"origin":null}': "empty", '{"farm":["x","y"]}': "ok",
        '{"varietals":"A, B"}': "ok", '{"varietals":["A","B"]}': "ok", "oops": "failed",
        None: "failed", '{"tasting_notes":{"fruits":["plum"]}}': "ok",
    }
    rows = spark.createDataFrame(list(enumerate(payloads)), "n INT, payload STRING")
    got = enrich.parse_payload(rows).orderBy("n").collect()
    assert [r.status for r in got] == list(payloads.values())
    assert got[0].extraction_confidence == 0.0 and got[0].tasting_notes.fruits == []
    assert got[1].origin_country is None and got[2].farm == "x, y"
    assert got[3].varietals == "A, B" and got[4].varietals == "A,B"
    assert got[5].tasting_notes.others == [] and got[7].tasting_notes.fruits == ["plum"]
    flat = enrich.notes_long(enrich.parse_payload(rows), "n").collect()
    assert [(r.n, r.category, r.note) for r in flat] == [(7, "fruits", "plum")]


def test_documents_leave_absent_sections_out(spark):
    products = spark.createDataFrame(
        [(1, "T", "", "<p>b</p>", "a,b", "u1"), (2, "T2", "Parent", None, "", "u2")],
        "id INT, title STRING, parent_title STRING, body_html STRING, tags STRING, url STRING",
    )
    pages = spark.createDataFrame(
        [("u1", 2, "<div class='desc'>later</div>"), ("u1", 1, "<div class='desc'>page</div>"),
         ("u2", 3, "")],
        "url STRING, page_id INT, html STRING",
    )
    texts = {r.product_id: r.text for r in enrich.assemble_documents(products, pages).collect()}
    assert texts[1] == "[title]\nT\n\n[description]\n<p>b</p>\n\n[page]\npage\n\n[tags]\na, b"
    assert texts[2] == "[title]\nParent"


def test_only_products_without_details_are_enriched(golden):
    todo = enrich.to_enrich(golden.beans, golden.products, golden.details)
    assert sorted(r.product_id for r in todo.collect()) == [5, 15, 17, 18, 19, 22, 25]
    failed = golden.details.withColumn(
        "status", F.when(F.col("product_id") == 2, "failed").otherwise("ok")
    )
    again = enrich.to_enrich(golden.beans, golden.products, failed, retry_failed=True)
    assert 2 in {r.product_id for r in again.collect()}


def test_re_enriching_replaces_and_reports_unknown_ids(golden, spark):
    documents = spark.createDataFrame(
        [(2, "Peru, washed"), (4, "Kenya")], "product_id BIGINT, text STRING"
    )
    ids = spark.createDataFrame([(2,), (77,)], "product_id BIGINT")
    stamp = datetime(2025, 1, 1)
    details, unknown = enrich.re_enrich(ids, documents, golden.details, stamp)
    rows = {r.product_id: r for r in details.collect()}
    assert len(rows) == golden.details.count()
    assert rows[2].origin_country == "Peru" and rows[2].resting_period_days == 8
    assert rows[4].origin_country == "Country 4"
    assert [r.product_id for r in unknown.collect()] == [77]
    again, _ = enrich.re_enrich(ids, documents, details, stamp)
    assert sorted(map(str, again.collect())) == sorted(map(str, details.collect()))


def test_unknown_ids_with_nulls_and_repeats(spark):
    ids = spark.createDataFrame([(1,), (1,), (5,), (5,), (None,), (None,)], "product_id int")
    held = spark.createDataFrame([(1,), (1,), (None,), (7,)], "product_id bigint")
    unknown = enrich._without(ids, held, "product_id")
    assert dict(unknown.dtypes) == {"product_id": "int"}
    assert sorted(map(str, (r.product_id for r in unknown.collect()))) == ["5", "None"]


def test_text_helpers(spark):
    assert column(spark, ["blue_kettle", "o'neil co", "ÉTÉ 7th"], t.title_case) == [
        "Blue_Kettle", "O'Neil Co", "Été 7Th",
    ]
    assert column(spark, [" a/b (c)_d-1! "], t.safe_title) == ["ab c_d-1"]
    assert column(spark, ["a,b", "", None], t.csv_to_array) == [["a", "b"], [], []]
    assert column(spark, ["\t a b\u00a0\r\nc", ""], t.first_line) == ["a b", ""]
    assert column(spark, ["x - y - z", "xy"], t.name_after_dash) == ["y - z", None]
    days = column(
        spark, ["2025-03-13", "2025-03-13 10:20:30.123456", "2025-03-13 10:20:30", "soon"],
        t.parse_day,
    )
    assert days == [datetime(2025, 3, 13), datetime(2025, 3, 13, 10, 20, 30, 123456), None, None]
    assert column(spark, ["1234567.5"], lambda s: t.money_text(s.cast("double"))) == ["1234567.50"]


def test_display_helpers(spark):
    rows = spark.createDataFrame(
        [(True, ["a", "b"]), (False, []), (None, None)], "f BOOLEAN, v ARRAY<STRING>"
    )
    got = rows.select(t.type_label(F.col("f")), t.varietals_text(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [
        ("Single Origin", "a, b"), ("Blend", "None"), ("Unknown", "None"),
    ]


def test_the_longest_term_at_a_place_wins(spark):
    """Against a plain reading, word by word, of a dictionary of overlapping terms."""
    terms = ["red", "red cherry", "cherry", "cherry jam", "jam", "black tea", "tea", "red cherry pie", "a", "ab", "c.d"]
    dictionary = [Term("others", t, t.title()) for t in terms] + [Term("fruits", "red", "Red Fruit", "r")]
    draw = random.Random(1)
    words = ["red", "cherry", "jam", "black", "tea", "pie", "a", "ab", "abc", "Red,", "tea.", "\n"]
    texts = ["", None, "red cherry", "Red Cherry jam", "red.cherry-pie", "tea red", "credit redcherry"]
    texts += [" ".join(draw.choices(words, k=draw.randrange(1, 12))) for _ in range(300)]

    def plain(text):
        left, found = re.sub(r"[^a-z]+", " ", (text or "").lower()).split(), set()
        while left:
            size = max((n for n in range(1, 4) if " ".join(left[:n]) in terms), default=0)
            if size:
                found.add(" ".join(left[:size]).title())
            left = left[max(size, 1):]
        return found

    rows = with_found_terms(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "text", dictionary)
    for r in rows.select("n", found_values(F.col("_found"), "others").alias("o"), found_values(F.col("_found"), "fruits", "r").alias("f")).collect():
        assert set(r.o) == plain(texts[r.n]) and r.o == sorted(r.o), texts[r.n]
        assert r.f == (["Red Fruit"] if "Red" in r.o else [])


def test_a_long_text_is_read_once(spark):
    text = "red cherry and nothing else " * 200_000
    rows = with_found_terms(spark.createDataFrame([(text,)], "text string"), "text", [Term("others", "red cherry", "x"), Term("others", "red", "y")])
    assert [e.value for e in rows.first()._found] == ["x"]


def test_places_imply_what_they_lie_in(spark):
    places = [
        Term("country", "kenya", "Kenya"), Term("country", "peru", "Peru"), Term("country", "chile", "Chile"),
        Term("region", "nyeri", "Nyeri", "Kenya"), Term("region", "kirinyaga", "Kirinyaga", "Kenya"),
        Term("area", "gichatha", "Gichatha", "Nyeri"), Term("area", "river hill", "River Hill", "Nyeri"),
        Term("area", "river hill", "River Hill", "Kirinyaga"),
        # One name in two countries.
        Term("region", "santa ana", "Santa Ana", "Peru"), Term("region", "santa ana", "Santa Ana", "Chile"),
        Term("area", "el sol", "El Sol", "Santa Ana"),
    ]
    expected = {
        "gichatha washed": (True, "Kenya", "Nyeri"), "nyeri": (True, "Kenya", "Nyeri"),
        "river hill": (True, "Kenya", None), "santa ana": (True, None, "Santa Ana"),
        "santa ana in chile": (True, "Chile", "Santa Ana"), "el sol": (True, None, "Santa Ana"),
        "kenya": (None, "Kenya", None), "gichatha and kirinyaga": (False, "Kenya", "Kirinyaga"),
        "gichatha, peru": (False, "Kenya", "Nyeri"), "no place": (None, None, None),
        "gichatha blend": (False, "Kenya", "Nyeri"),
    }
    rows = spark.createDataFrame([(t,) for t in expected], "text string")
    found = enrich.extract_attributes(rows, places).collect()
    assert {r.text: (r.is_single_origin, r.origin.country, r.origin.region) for r in found} == expected


def test_an_altitude_is_read_once(spark):
    """One search for the span, and one for each of its numbers."""
    rows = spark.createDataFrame([("1,200 - 1.400 masl",), ("5000 ft",), ("none",), ("at m",), (None,)], "text string")
    read = rows.select(enrich.altitude(F.col("text")).alias("a"))
    assert [r.a for r in read.collect()] == ["1200-1400", "1524", None, None, None]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 3
