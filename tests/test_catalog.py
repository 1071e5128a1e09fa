from __future__ import annotations

import pytest
from conftest import EXPECTED_TYPES

from shelfwise.operators import catalog


def ids(df, column="variant_id"):
    return sorted(row[column] for row in df.select(column).collect())


def test_whole_beans_keeps_the_expected_variants_and_types(golden):
    rows = golden.beans.select("variant_id", "coffee_type").collect()
    assert {row.variant_id: row.coffee_type for row in rows} == EXPECTED_TYPES
    assert len(rows) == len(EXPECTED_TYPES)


def test_resting_days_double_and_stay_null(golden):
    days = {r.variant_id: r.adjusted_resting_period_days for r in golden.beans.collect()}
    assert days[2] == 20 and days[1] is None


def test_title_and_seller_are_unique(golden):
    keys = golden.beans.select("parent_title", "roaster_name")
    assert keys.distinct().count() == keys.count()


def test_options_without_orders(golden):
    assert ids(catalog.available_options(golden.beans, golden.no_orders)) == [2, 4, 20]


def test_variant_exclusion_then_product_exclusion(golden):
    options = catalog.available_options(golden.beans, golden.orders)
    assert ids(options) == [20]
    only_second = golden.orders.filter("id = 2")
    options = catalog.available_options(golden.beans, only_second)
    assert ids(options) == [2, 4, 20]
    assert ids(catalog.without_ordered_products(options, only_second)) == [4, 20]


def test_an_order_never_enlarges_the_options(golden):
    before = set(ids(catalog.available_options(golden.beans, golden.no_orders)))
    for order in (1, 2, 3, 4, 5):
        some = golden.orders.filter(f"id <= {order}")
        after = set(ids(catalog.available_options(golden.beans, some)))
        assert after <= before
        before = after


def test_listing_marks_one_heading_per_seller(golden):
    options = catalog.available_options(golden.beans, golden.no_orders)
    rows = catalog.options_by_roaster(options).collect()
    assert [(r.roaster_name, r.starts_group, r.n_options) for r in rows] == [
        ("r_one", True, 2), ("r_one", False, 2), ("r_two", True, 1),
    ]
    assert rows[0].line == "  - Kilo AA (Country 2) $20.00"


def test_option_rows_show_the_display_name(golden):
    options = catalog.available_options(golden.beans, golden.no_orders)
    rows = catalog.option_rows(options, golden.roasters).collect()
    assert {r.roaster_name for r in rows} == {"Roaster One", "Roaster Two"}


def test_counts_per_type(golden):
    counts = {r.coffee_type: r.n for r in catalog.catalog_count(golden.beans).collect()}
    assert counts == {"All": 12, "Blend": 4, "Single Origin": 3, "Unknown": 5}


def test_views_are_replaced(golden, spark):
    catalog.register_views(whole_beans=golden.beans)
    catalog.register_views(whole_beans=golden.beans.limit(1))
    assert spark.table("whole_beans").count() == 1


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_result_does_not_depend_on_the_partitioning(golden, spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert ids(golden.beans.repartition(int(partitions))) == sorted(EXPECTED_TYPES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rank_is_limited_before_the_shuffle(golden):
    plan = golden.beans._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
