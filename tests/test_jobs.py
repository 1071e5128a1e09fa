"""The batch jobs end to end, over a small landing zone."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ingest
from shelfwise.plans import jobs
from shelfwise.sources import landing, sinks

STAMP = datetime(2025, 1, 15)
REGISTRY = {
    "one": {"name": "first_cup", "description": "First Cup", "url": "https://first"},
    "two": {"name": "second_cup", "description": None, "url": "https://second"},
}


def product(number: int, title: str, body: str) -> dict:
    return {
        "id": number, "title": title, "url": f"https://shop/{number}", "body_html": body,
        "tags": ["filter", "new"], "updated_at": "2024-12-01T00:00:00Z",
        "options": [{"name": "Size", "values": ["250g"]}], "images": [{"src": f"{number}.jpg"}],
    }


def variant(number: int, parent: str, **other) -> dict:
    return {
        "parent_id": number, "title": "250g / Whole Bean", "available": "true", "grams": "250",
        "price": "20.00", "option1": "250g", "option2": "Whole Bean", "parent_title": parent,
        "vendor": "v", "position": "1", **other,
    }


@pytest.fixture
def zone(tmp_path):
    files = {
        "products/source=one": [
            product(1, "Nyeri AA", "Kenya Nyeri, washed, lemon and black tea"),
            product(2, "Huila", "Colombia, natural, caramel"),
            product(3, "Morning Blend", "Brazil and Peru"),
        ],
        "products/source=two": [product(1, "Guji", "Ethiopia Guji, natural. Jasmine")],
        "variants/source=one": [
            variant(1, "Nyeri AA"),
            variant(1, "Nyeri AA", title="1kg", option1="1kg (4x250g)", grams="1000", position="2"),
            variant(2, "Huila", price="24.50"),
            variant(3, "Morning Blend"),
            # Differs in the sku alone and stays; an exact repeat does not; a parent that is not there.
            variant(3, "Morning Blend", sku="other"), variant(3, "Morning Blend"),
            variant(99, "Nobody"),
        ],
        "products/source=three": [product(9, "Stranger", "Peru")],
        "variants/source=two": [variant(1, "Guji", price="110")],
    }
    for folder, rows in files.items():
        path = tmp_path / "landing" / folder
        path.mkdir(parents=True)
        lines = [json.dumps(row) for row in rows]
        if folder == "products/source=two":
            lines.append("<html>busy</html>")
        (path / "part.json").write_text("\n".join(lines) + "\n")
    return tmp_path


def table(spark, folder, name):
    return sorted(map(str, landing.read_table(spark, folder, name).collect()))


def test_from_landing_to_a_placed_order(spark, zone):
    registry = landing.registry_rows(spark, REGISTRY)
    first, second, enriched = (str(zone / name) for name in ("s1", "s2", "s3"))

    report, left_out = jobs.load_catalog(spark, str(zone / "landing"), registry, None, first, STAMP)
    assert {(r.kind, r.source): (r.n_rows, r.n_bad) for r in report.collect()} == {
        ("products", "one"): (3, 0), ("products", "two"): (2, 1),
        ("variants", "one"): (7, 0), ("variants", "two"): (1, 0), ("products", "three"): (1, 0),
    }
    assert {(r.kind, r.source, r.reason) for r in left_out.collect()} == {
        ("products", "three", "source not registered"), ("variants", "one", "no such product"),
        ("variants", "one", "equals another variant"),
    }
    sellers = landing.read_table(spark, first, "roasters").collect()
    assert {r.name: r.description for r in sellers} == {"first_cup": "First Cup", "second_cup": "Second_Cup"}

    # The same files again change nothing.
    jobs.load_catalog(spark, str(zone / "landing"), registry, first, second, STAMP)
    for name in jobs.CATALOG_TABLES:
        assert table(spark, first, name) == table(spark, second, name), name
    assert len(table(spark, second, "variants")) == 6

    pages = spark.createDataFrame(
        [(1, "https://shop/2", "<div class='description'>Producer: Ana Diaz\nSL28</div>")],
        "page_id INT, url STRING, html STRING",
    )
    added = jobs.enrich_catalog(spark, second, pages, enriched, STAMP)
    found = {r.origin_country: r for r in added.collect()}
    assert set(found) == {"Kenya", "Colombia", "Brazil", "Ethiopia"}
    assert found["Kenya"].tasting_notes.others == ["Black Tea"]
    assert found["Colombia"].varietals == "SL28" and found["Colombia"].producer == "Ana Diaz"
    assert found["Brazil"].is_single_origin is False

    nothing_left = jobs.enrich_catalog(spark, enriched, pages, str(zone / "s4"), STAMP)
    assert nothing_left.count() == 0

    users = spark.createDataFrame([(1,), (2,)], "user_id BIGINT")
    orders_folder = str(zone / "orders")
    no_orders = jobs.empty_table(spark, "order_history")
    _, picked = jobs.advise_buyers(spark, enriched, no_orders, users, STAMP)
    lines = {r.user_id: r.line for r in picked.collect()}
    assert lines[1] == lines[2] and "First Cup - Nyeri AA" in lines[1]

    requests = spark.createDataFrame(
        [(1, 1, lines[1].split(" | ")[0] + "\nbecause it is new"), (2, 2, "No such thing")],
        "request_id BIGINT, user_id BIGINT, text STRING",
    )
    rejects = jobs.place_orders(spark, enriched, requests, orders_folder, STAMP)
    assert [(r.user_id, r.reason) for r in rejects.collect()] == [(2, "no such option")]

    jobs.place_orders(spark, enriched, requests, orders_folder, STAMP)
    placed = sinks.read_orders(spark, orders_folder)
    assert placed.count() == 1
    row = placed.first()
    assert (row.user_id, row.price_paid, row.quantity) == (1, 20.0, 1)
    assert row.origin_country == "Kenya" and row.roaster_name == "first_cup"

    report, picked = jobs.advise_buyers(spark, enriched, placed, users, STAMP)
    spent = {r.user_id: (r.current_month, r.remaining) for r in report.collect()}
    assert spent == {1: (20.0, 80.0), 2: (0.0, 100.0)}
    lines = {r.user_id: r.line for r in picked.collect()}
    assert "Huila" in lines[1] and "Nyeri AA" in lines[2]
    # With a budget of 22 only the first buyer needs the ceiling: 2 are left, the offer costs 24.50.
    tight = jobs.advise_buyers(spark, enriched, placed, users, STAMP, budget=22.0)[1]
    assert {r.user_id: (r.tier, r.price) for r in tight.collect()} == {1: (1, 24.5), 2: (0, 20.0)}

    # Orders by ids and by name go to the same table.
    product_id = landing.read_table(spark, enriched, "products").filter("title = 'Guji'").first().id
    variant_id = (
        landing.read_table(spark, enriched, "variants").filter(f"product_id = {product_id}")
        .first().id
    )
    by_ids = spark.createDataFrame(
        [(3, 2, product_id, variant_id, 2, 200.0, datetime(2024, 11, 5), "gift"),
         (4, 2, -1, variant_id, 1, 1.0, None, None)],
        "request_id BIGINT, user_id BIGINT, product_id BIGINT, variant_id BIGINT, quantity INT, "
        "price_paid DOUBLE, order_date TIMESTAMP, notes STRING",
    )
    rejects = jobs.add_orders(spark, enriched, by_ids, orders_folder, STAMP)
    assert [(r.request_id, r.reason) for r in rejects.collect()] == [(4, "product not found")]
    by_name = spark.createDataFrame(
        [(5, 2, "HUILA", datetime(2024, 12, 24)), (6, 2, "u", None), (7, 2, "xyz", None)],
        "request_id BIGINT, user_id BIGINT, fragment STRING, order_date TIMESTAMP",
    )
    missing = jobs.add_orders_by_name(spark, enriched, by_name, orders_folder, STAMP)
    assert {r.request_id: r.state for r in missing.collect()} == {6: "ambiguous", 7: "none"}
    back = sinks.read_orders(spark, orders_folder)
    rows = {r.product_title: r for r in back.collect()}
    assert set(rows) == {"Nyeri AA", "Guji", "Huila"} and rows["Guji"].notes == "gift"
    assert (rows["Huila"].price_paid, rows["Huila"].order_date) == (24.5, datetime(2024, 12, 24))


def test_no_product_is_lost(spark, tmp_path, monkeypatch):
    """Products without a link, with one link, and with ids that a hash could have made equal."""
    monkeypatch.setattr(ingest, "stable_id", lambda *columns: F.lit(42).cast("bigint"))
    registry = landing.registry_rows(spark, {"one": REGISTRY["one"]})
    rows = [product(n, f"P{n}", "") for n in range(1, 5)] + [product(4, "P4", "") | {"updated_at": "2023-01-01T00:00:00Z"}]
    rows[0]["url"] = rows[1]["url"] = None
    rows[3]["url"] = rows[2]["url"]
    rows.append({"title": "no id", "url": None})
    parents = [variant(n, f"P{n}") for n in range(1, 5)]
    for name, lines in (("products", rows), ("variants", parents)):
        (tmp_path / f"landing/{name}/source=one").mkdir(parents=True)
        (tmp_path / f"landing/{name}/source=one/part.json").write_text("\n".join(map(json.dumps, lines)))
    first, second, third = (str(tmp_path / name) for name in ("s1", "s2", "s3"))
    _, rejects = jobs.load_catalog(spark, str(tmp_path / "landing"), registry, None, first, STAMP)
    assert [(r.kind, r.reason, r.n) for r in rejects.collect()] == [("products", "older or equal record of the product", 1)]
    titles = {r.title: r.id for r in landing.read_table(spark, first, "products").collect()}
    assert set(titles) == {"P1", "P2", "P3", "P4", "no id"} and len(set(titles.values())) == 5
    packages = landing.read_table(spark, first, "variants").collect()
    assert {(r.product_id, r.parent_title) for r in packages} == {(titles[f"P{n}"], f"P{n}") for n in range(1, 5)}
    assert len({r.id for r in packages}) == 4

    jobs.load_catalog(spark, str(tmp_path / "landing"), registry, first, second, STAMP)
    for name in jobs.CATALOG_TABLES:
        assert table(spark, first, name) == table(spark, second, name), name
    # A product that comes with a new link keeps its id; its children are replaced, no others.
    (tmp_path / "later/products/source=one").mkdir(parents=True)
    (tmp_path / "later/variants/source=one").mkdir(parents=True)
    moved = product(3, "P3", "") | {"url": "https://shop/new"}
    (tmp_path / "later/products/source=one/part.json").write_text(json.dumps(moved))
    (tmp_path / "later/variants/source=one/part.json").write_text(json.dumps(variant(3, "P3", price="30")))
    jobs.load_catalog(spark, str(tmp_path / "later"), registry, second, third, STAMP)
    after = {r.title: (r.id, r.url) for r in landing.read_table(spark, third, "products").collect()}
    assert after["P3"] == (titles["P3"], "https://shop/new") and len(after) == 5
    prices = {r.parent_title: (r.id, r.price) for r in landing.read_table(spark, third, "variants").collect()}
    assert {t: p for t, (_, p) in prices.items()} == {"P1": 20.0, "P2": 20.0, "P3": 30.0, "P4": 20.0}
    assert prices["P3"][0] > max(r.id for r in packages)
