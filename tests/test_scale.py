"""Plans and results under skew: one key holds a third of all rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import frame
from pyspark.sql import functions as F

from shelfwise.operators import catalog, orders, spend
from shelfwise.operators.catalog import whole_beans
from shelfwise.plans.queries import QUERIES
from shelfwise.plans.store import RULES, SELLERS, Store, product_key
from shelfwise.session import cut_lineage
from shelfwise.sources.schemas import TABLES


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which the fixture's hot key counts as skewed, and no broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 orders of 400 products; product 7 has a third of them."""
    product = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(400)))
    lines = spark.range(0, 60000, 1, 8).select(
        "id", (F.col("id") % 50).alias("user_id"), product.cast("bigint").alias("product_id")
    )
    order_columns = spark.createDataFrame([], TABLES["order_history"]).columns
    filled = lines.withColumns(
        {
            "variant_id": F.col("product_id"),
            "order_date": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")),
            "price_paid": F.lit(1.0),
        }
    )
    history = filled.select(
        *[F.col(c) if c in filled.columns else F.lit(None).alias(c) for c in order_columns]
    )
    variants = [
        {
            "id": n, "product_id": n, "parent_title": f"title {n}", "vendor": "v", "available": 1,
            "grams": 250, "price": 5.0, "option1": "250g", "option2": "Whole Bean",
        }
        for n in range(400)
    ]
    products = [{"id": n, "roaster_id": 1, "title": f"title {n}", "url": "u"} for n in range(400)]
    sellers = [{"id": 1, "name": "one", "description": "One", "url": "u"}]
    return {
        "orders": history,
        "variants": frame(spark, "variants", variants),
        "products": frame(spark, "products", products),
        "roasters": frame(spark, "roasters", sellers),
        "details": frame(spark, "product_extended_details", []),
    }


def beans(hot):
    return catalog.whole_beans(hot["variants"], hot["products"], hot["roasters"], hot["details"])


def test_hot_product_is_split_in_the_status_join(hot, small_partitions):
    marked = orders.order_status(hot["orders"], hot["variants"]).select("id", "product_status")
    assert "skew=true" in executed(marked)
    assert marked.distinct().count() == 60000


def test_hot_product_is_split_in_the_history_join(hot, small_partitions):
    view = orders.order_history_view(hot["orders"], beans(hot), hot["roasters"])
    assert "skew=true" in executed(view.select("id", "parent_title"))
    assert view.count() == 60000


def test_hot_title_is_limited_before_the_shuffle(hot, spark):
    """All variants share one title and seller: each task sends on one row."""
    copies = hot["variants"].crossJoin(spark.range(200).select(F.col("id").alias("copy")))
    same = copies.withColumns(
        {"parent_title": F.lit("same"), "id": F.col("id") * 1000 + F.col("copy")}
    ).drop("copy")
    picked = catalog.whole_beans(same, hot["products"], hot["roasters"], hot["details"])
    assert [r.variant_id for r in picked.collect()] == [0]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2


def test_hot_buyer_is_counted_before_the_shuffle(hot):
    history = spend.purchase_history(
        hot["orders"].withColumn("user_id", F.lit(1)), beans(hot), hot["roasters"]
    )
    counts = {
        (r.feature, r.value): r.n for r in spend.feature_distribution(history).collect()
    }
    assert counts == {("roaster_name", "One"): 60000}
    plan = spend.recent_orders(history)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sums_of_all_buyers_are_not_broadcast(hot, spark):
    """Whatever the size of the files that the lines come from."""
    lines = hot["orders"].withColumn("price", F.col("price_paid"))
    summary = spend.spending_summary(lines, lines.select("user_id").distinct(), datetime(2023, 11, 20))
    assert "BroadcastHashJoin" not in executed(summary)
    assert summary.count() == 50


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_plan_pairs_everything_or_leaves_the_cluster(spark, name):
    """No cross or nested-loop join, no window over a whole relation, no Python but for pages."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan or name in {"constraint_report", "candidate_counts"}
    reads_pages = name in {"page_region_text", "pages_without_region", "assemble_documents"}
    assert ("EvalPython" in plan) == reads_pages


@pytest.fixture()
def wide_keys(spark, tmp_path):
    """A data folder whose seller numbers lie around a million."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("region", [(0, "R")], "r_regionkey int, r_name string")
    write("nation", [(7, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    sellers = [999_999, 1_000_000, 1_000_001, 2_000_000]
    write("supplier", [(s, f"S{s}", 7, 0.0) for s in sellers], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    write("part", [(p, f"red bolt{p}", "Brand#1", "MEDIUM", 1, 10.0) for p in (1, 2)],
          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    # Part 1 from seller 1,000,000 and part 2 from seller 0 would share a number with a factor of a million.
    lines = [(n, p, s, 3, 1.0, 5.0, "N", "O") for n, (p, s) in enumerate((p, s) for p in (1, 2) for s in sellers)]
    write("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
          "l_extendedprice double, l_returnflag string, l_linestatus string")
    write("orders", [(n, 1, "O", datetime(2001, 1, 1)) for n in range(8)],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp")
    return str(tmp_path)


def test_listings_of_large_seller_numbers_keep_their_own_ids(spark, wide_keys):
    store = Store(spark, wide_keys)
    beans = store.beans().collect()
    assert len({r.product_id for r in beans}) == len(beans) == 8
    assert {r.roaster_name for r in beans} == {"S999999", "S1000000", "S1000001", "S2000000"}
    assert store.products().select("id").distinct().count() == 8
    # Size 3 was bought, size 4 never: every order counts, whatever its status.
    assert {r.grams for r in beans} == {150} and store.options().count() == 0


def test_seller_numbers_without_room_are_an_error(spark):
    rows = spark.createDataFrame([(1, SELLERS)], "l_partkey long, l_suppkey long")
    with pytest.raises(Exception, match="seller numbers reach"):
        rows.select(product_key().alias("id")).collect()


def test_the_catalog_is_one_pass_over_the_order_lines(spark):
    """The plan without broadcasts: one scan of the lines, no table of them joined to itself."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beans = Store(spark, "/root/testdata/sf0.001").beans()
        plan = beans._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("lineitem.parquet") == 1
    assert plan.count("Exchange hashpartitioning") <= 9
    assert plan.count("SortMergeJoin") <= 4


def test_one_pass_equals_the_joined_tables(spark):
    store = Store(spark, "/root/testdata/sf0.001")
    joined = whole_beans(store.variants(), store.products(), store.roasters(), store.details(), RULES)
    own = store.beans()
    columns = sorted(own.columns)
    assert columns == sorted(joined.columns)
    assert sorted(map(str, own.select(columns).collect())) == sorted(map(str, joined.select(columns).collect()))


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_cut_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    kept = cut_lineage(spark.range(100).mapInPandas(counted, "id long"))
    assert sorted(r.id for r in kept.collect()) == list(range(100)) and seen.value == 100


def test_records_travel_without_their_json(spark):
    """Equal records are counted, then one shuffle by key; the columns of both are the record's."""
    plan = plan_of(QUERIES["load_products"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning") == 2


def test_requests_meet_the_attributes_last(spark, no_broadcast):
    plan = plan_of(QUERIES["order_snapshot"](spark, "/root/testdata/sf0.001"))
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert "SortMergeJoin [product_id" in joins[0] and "SortMergeJoin [variant_id" in joins[1]


@pytest.mark.parametrize("name", ["order_status", "orders_by_status", "order_rejects", "cascade_orphans"])
def test_packages_are_shuffled_without_the_columns_of_their_part(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not [line for line in exchanges if "p_name" in line]


@pytest.fixture()
def odd_lines(spark, tmp_path):
    """Part 1 has two names and comes twice; keys, sizes and flags are null or repeat."""
    spark.createDataFrame(
        [(1, "red bolt", "B", "M", 1, 10.0), (1, "red bolt", "B", "M", 1, 10.0), (1, "old bolt", "B", None, 1, 10.0),
         (2, "new rod", None, "M", None, None), (3, "unsold", "B", "M", 1, 1.0)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    ).write.parquet(str(tmp_path / "part.parquet"))
    lines = [
        (1, 5, 3, 7.0, "N", "O"), (1, 5, 3, 6.0, "R", "F"), (1, 5, 4, 5.0, "R", "O"), (1, 5, 5, None, "A", "F"),
        (1, 5, 7, 4.0, "N", "O"), (2, 5, 1, 3.0, None, None), (2, 5, None, 2.0, "N", None), (2, None, 2, 1.0, "N", "O"),
        (None, 5, 3, 1.0, "N", "O"), (9, 5, 3, 1.0, "N", "O"), (2, 6, 1, 3.0, "N", "F"), (2, 6, 1, 3.0, "N", "F"),
    ]
    spark.createDataFrame(
        [(n, *line) for n, line in enumerate(lines)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
        "l_extendedprice double, l_returnflag string, l_linestatus string",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    return Store(spark, str(tmp_path))


def texts(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_packages_of_odd_lines(odd_lines):
    names = {1: ("old bolt", "red bolt"), 2: ("new rod",)}
    sizes = {
        (1, 5, 1): (10.0, 1), (1, 5, 3): (6.0, 1), (1, 5, 4): (5.0, 1), (1, 5, 5): (50.0, 0), (1, 5, 6): (60.0, 1),
        (1, 5, 7): (4.0, 1), (2, 5, 1): (3.0, 1), (2, 5, 2): (None, 1), (2, 5, None): (2.0, 1), (2, None, 2): (1.0, 1),
        (2, None, 3): (None, 1), (2, 6, 1): (3.0, 0), (2, 6, 2): (None, 1),
    }
    expected = sorted(str((*key, name, *value)) for key, value in sizes.items() for name in names[key[0]])
    for packages in (odd_lines.packages(), odd_lines.packages(few_parts=True)):
        rows = packages.select("l_partkey", "l_suppkey", "l_linenumber", "p_name", "price", "available")
        assert sorted(str(tuple(r)) for r in rows.collect()) == expected


def test_carried_variants_are_the_kept_packages(odd_lines):
    # A line without a seller has no number.
    kept, carried = odd_lines.packages().filter("kept"), odd_lines.carried_packages()
    assert texts(carried.select(kept.columns)) == texts(kept)
    sold = odd_lines.carried_packages().select("l_partkey", "l_suppkey", "l_linenumber").distinct().collect()
    assert sorted(map(str, map(tuple, sold))) == sorted(
        map(str, [(1, 5, 3), (1, 5, 5), (1, 5, 7), (2, 5, None), (2, None, 2), (2, 6, 1)])
    )


def test_the_lines_of_carried_packages_are_not_doubled(spark):
    plan = plan_of(QUERIES["order_status"](spark, "/root/testdata/sf0.001"))
    assert "Generate explode" not in plan


def test_orders_asked_about_are_looked_up_before_they_are_marked(spark, no_broadcast):
    plan = plan_of(QUERIES["orders_by_id_status"](spark, "/root/testdata/sf0.001"))
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert "SortMergeJoin [variant_id" in joins[0] and "SortMergeJoin [id" in joins[1]


def test_small_rows_are_not_merged_into_large_tasks(spark):
    plan = plan_of(QUERIES["re_enrich_unknown"](spark, "/root/testdata/sf0.001"))
    assert plan.count("REPARTITION_BY_NUM") >= 3


def test_unknown_ids_are_found_without_sorting_both_sides(spark, no_broadcast):
    plan = plan_of(QUERIES["re_enrich_unknown"](spark, "/root/testdata/sf0.001"))
    assert "LeftAnti" not in plan
