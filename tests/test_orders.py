from __future__ import annotations

from datetime import date, datetime

import pytest

from shelfwise.operators import orders, spend


def by_id(df, column):
    return {row.id: row[column] for row in df.collect()}


def test_view_drops_orders_that_are_not_sellable(golden):
    view = orders.order_history_view(golden.orders, golden.beans, golden.roasters)
    assert by_id(view, "roaster_display_name") == {
        1: "Roaster One", 2: "Roaster One", 3: "Roaster Two",
    }
    assert len(view.columns) == len(set(view.columns))
    assert [r.id for r in orders.newest_first(view).collect()] == [1, 2, 3]


def test_status(golden):
    marked = orders.order_status(golden.orders, golden.variants)
    assert by_id(marked, "product_status") == {
        1: "Available", 2: "Available", 3: "Available", 4: "Out of Stock", 5: "Discontinued",
    }
    kept = orders.order_status(golden.orders, golden.variants, include_discontinued=False)
    assert 5 not in by_id(kept, "product_status")


def test_status_buckets_are_sorted_newest_first(golden):
    marked = orders.order_status(golden.orders, golden.variants)
    rows = orders.orders_by_status(marked).collect()
    assert [(r.bucket, r.id) for r in rows] == [
        ("available", 1), ("available", 2), ("available", 3), ("discontinued", 5),
        ("out_of_stock", 4),
    ]
    totals = {r.product_status: r.n_orders for r in orders.status_totals(marked).collect()}
    assert totals == {"Available": 3, "Out of Stock": 1, "Discontinued": 1}


def test_lookup_by_id(golden, spark):
    view = orders.order_history_view(golden.orders, golden.beans, golden.roasters)
    asked = spark.createDataFrame([(1,), (1,), (4,), (77,)], "id BIGINT")
    assert by_id(orders.orders_by_id(view, asked), "product_id") == {1: 2}
    assert sorted(r.id for r in orders.missing_order_ids(view, asked).collect()) == [4, 77]


def test_snapshot_freezes_attributes_and_reports_unknown_ids(golden, spark):
    requests = spark.createDataFrame(
        [
            (1, 2, 2, 1, 20.0, datetime(2025, 1, 3), "first"),
            (2, 5, 5, 2, 40.0, None, None),
            (3, 999, 2, 1, 1.0, None, None),
            (4, 2, 999, 1, 1.0, None, None),
        ],
        "request_id INT, product_id BIGINT, variant_id BIGINT, quantity INT, price_paid DOUBLE, "
        "order_date TIMESTAMP, notes STRING",
    )
    as_of = datetime(2025, 2, 1)
    placed, rejects = orders.order_snapshot(
        requests, golden.products, golden.variants, golden.roasters, golden.details, as_of
    )
    rows = {r.request_id: r for r in placed.collect()}
    assert rows[1].product_title == "Kilo AA" and rows[1].origin_country == "Country 2"
    assert rows[1].order_date == datetime(2025, 1, 3) and rows[1].roaster_name == "r_one"
    assert rows[2].order_date == as_of and rows[2].origin_country is None
    assert {r.request_id: r.reason for r in rejects.collect()} == {
        3: "product not found", 4: "variant not found",
    }


@pytest.mark.parametrize(
    ("all_lines", "expected"),
    [(False, (20.0, 30.0, 45.5 / 3)), (True, (20.0, 38.0, 60.5 / 3))],
)
def test_spending_summary(golden, spark, all_lines, expected):
    history = (
        spend.full_history(golden.orders)
        if all_lines
        else spend.purchase_history(golden.orders, golden.beans, golden.roasters)
    )
    users = spark.createDataFrame([(1,), (2,)], "user_id BIGINT")
    summary = spend.with_budget(spend.spending_summary(history, users, date(2025, 1, 15)))
    rows = {r.user_id: r for r in summary.collect()}
    got = (rows[1].current_month, rows[1].last_month, rows[1].three_month_average)
    assert got == pytest.approx(expected)
    assert (rows[1].remaining, rows[1].ceiling) == (80.0, 120.0)
    assert (rows[2].current_month, rows[2].three_month_average, rows[2].remaining) == (0, 0, 100.0)


def test_monthly_spend_is_not_multiplied_by_quantity(golden):
    doubled = golden.orders.withColumn("quantity", golden.orders.quantity * 2)
    rows = spend.monthly_spend(spend.full_history(doubled)).collect()
    assert {r.month: r.spend for r in rows}[date(2024, 12, 1)] == 38.0


def test_distribution_and_ties(spark):
    history = spark.createDataFrame(
        [
            (1, date(2025, 1, 1), "A", "X", ""), (1, date(2025, 1, 2), "B", None, "P"),
            (1, date(2025, 1, 3), "C", "X", "Q"), (1, date(2025, 1, 4), "D", "Y", "P"),
            (1, date(2025, 1, 5), "D", "Y", "R"), (1, date(2025, 1, 6), "E", "Z", "S"),
        ],
        "user_id INT, order_date DATE, roaster_name STRING, origin_country STRING, "
        "processing_method STRING",
    )
    distribution = spend.feature_distribution(history)
    counts = {(r.feature, r.value): r.n for r in distribution.collect()}
    assert counts[("roaster_name", "D")] == 2 and ("processing_method", "") not in counts
    top = spend.top_features(distribution).collect()
    named = {
        feature: [r.value for r in sorted(top, key=lambda r: r.position) if r.feature == feature]
        for feature in ("roaster_name", "origin_country", "processing_method")
    }
    assert named["roaster_name"] == ["D", "E", "C"]
    assert named["origin_country"] == ["Y", "X", "Z"]
    assert named["processing_method"] == ["P", "S", "R", "Q"]


def test_report_lines(golden, spark):
    history = spend.purchase_history(golden.orders, golden.beans, golden.roasters)
    users = spark.createDataFrame([(1,), (2,)], "user_id BIGINT")
    summary = spend.spending_summary(history, users, date(2025, 1, 15))
    rows = spend.spending_report(summary, spend.recent_orders(history, 2), 2).collect()
    report = {r.user_id: r.recent_orders for r in rows}
    assert report[2] == ""
    assert report[1].split("\n") == [
        "2025-01-03: Roaster One - Kilo AA ($20.00)", "2024-12-10: Roaster One - Kilo AA ($30.00)",
    ]


def test_order_strings_of_what_a_buyer_has(golden, spark):
    """Requests that share an id keep their own text; what is held already, or gone, is rejected."""
    requests = spark.createDataFrame(
        [(1, 1, "[2,2] Kilo AA"), (1, 1, "[20,20] Rwanda & Friends"), (1, 2, "[2,2] Kilo AA"), (3, 3, "nothing")],
        "request_id INT, user_id BIGINT, text STRING",
    )
    options = golden.beans.filter("coffee_type = 'Single Origin'")
    held = spark.createDataFrame([(1, 2, 2)] * 3, "user_id BIGINT, product_id BIGINT, variant_id BIGINT")
    rest = golden.products.filter("id <> 20")
    placed, rejects = orders.place_order_strings(
        requests, options, rest, golden.variants, golden.roasters, golden.details, datetime(2025, 1, 1), held
    )
    assert [(r.user_id, r.variant_id) for r in placed.collect()] == [(2, 2)]
    assert sorted((r.user_id, r.text, r.reason) for r in rejects.collect()) == [
        (1, "[2,2] Kilo AA", "already ordered"), (1, "[20,20] Rwanda & Friends", "product not found"),
        (3, "nothing", "no such option"),
    ]
