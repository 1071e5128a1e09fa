"""Spend per buyer and month, budgets, recent orders and what a buyer has tried."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import as_money, day_text, money_text, present, sum_money

# Monthly budget and the share it may be exceeded by for a special offer.
MONTHLY_BUDGET = 100.0
BUDGET_FLEXIBILITY = 0.2


def purchase_history(orders: DataFrame, beans: DataFrame, roasters: DataFrame) -> DataFrame:
    """Order lines whose product is still sellable, with its catalog attributes.

    The catalog meets the sellers first, so that the lines, the large side, are shuffled once.
    """
    names = roasters.select(
        F.col("id").alias("roaster_id"), F.col("description").alias("roaster_name")
    )
    catalog = beans.select(
        "product_id", "roaster_id", "parent_title", "processing_method", "origin_country",
        "tasting_notes", F.col("product_url").alias("url"),
    )
    lines = orders.select(
        "id", "user_id", "product_id", "variant_id", "order_date",
        F.col("price_paid").alias("price"),
    )
    return lines.join(catalog.join(names, "roaster_id"), "product_id")


def sellable_lines(orders: DataFrame, packages: DataFrame) -> DataFrame:
    """Order lines whose product is still sellable, without attributes: enough to sum spend."""
    lines = orders.select(
        "id", "user_id", "product_id", "order_date", F.col("price_paid").alias("price")
    )
    return lines.join(packages.select("product_id"), "product_id")


def full_history(orders: DataFrame) -> DataFrame:
    """All order lines as they were written, also those whose product has vanished since."""
    renamed = {"price_paid": "price", "product_title": "parent_title", "product_url": "url"}
    return orders.withColumnsRenamed(renamed)


def month_of(column) -> Column:
    return F.trunc(column, "month")


def monthly_spend(history: DataFrame) -> DataFrame:
    """Sum of prices paid per buyer and calendar month; not multiplied by the quantity."""
    return history.groupBy("user_id", month_of("order_date").alias("month")).agg(
        sum_money(F.col("price")).alias("spend")
    )


def spend_in_month(history: DataFrame, month: date) -> DataFrame:
    """Spend per buyer in the calendar month of one day."""
    start, end = _month_start(month, 0), _month_start(month, -1)
    bought = F.col("order_date")
    return monthly_spend(
        history.filter((bought >= F.lit(start)) & (bought < F.lit(end)))
    ).drop("month")


def _month_start(day: date, back: int) -> date:
    """First day of the month ``back`` months before that of ``day``."""
    months = day.year * 12 + day.month - 1 - back
    return date(months // 12, months % 12 + 1, 1)


def spending_summary(history: DataFrame, users: DataFrame, as_of: date) -> DataFrame:
    """Spend of the current and the last month and the mean of the three months before this one.

    One conditional aggregation. The four months are literal bounds on the date, so they reach the
    scan of the orders. Buyers without orders get zeros.
    """

    def within(first_back: int, last_back: int) -> Column:
        bought = F.col("order_date")
        return (bought >= F.lit(_month_start(as_of, first_back))) & (
            bought < F.lit(_month_start(as_of, last_back - 1))
        )

    def spent(first_back: int, last_back: int) -> Column:
        total = F.sum(F.when(within(first_back, last_back), as_money(F.col("price"))))
        return F.coalesce(total, F.lit(0)).cast("double")

    sums = history.filter(within(3, 0)).groupBy("user_id").agg(
        spent(0, 0).alias("current_month"),
        spent(1, 1).alias("last_month"),
        (spent(3, 1) / 3).alias("three_month_average"),
    )
    amounts = ("current_month", "last_month", "three_month_average")
    # There may be sums of every buyer: too many to broadcast, however small their lines were on disk.
    return users.select("user_id").join(sums.hint("merge"), "user_id", "left").na.fill(0.0, amounts)


def with_budget(
    summary: DataFrame,
    budget: float = MONTHLY_BUDGET,
    flexibility: float = BUDGET_FLEXIBILITY,
) -> DataFrame:
    """Add what is left of the month's budget and the ceiling for a special offer."""
    return summary.withColumn(
        "remaining", F.round(F.lit(budget) - F.col("current_month"), 2)
    ).withColumn("ceiling", F.round(F.lit(budget * (1 + flexibility)), 2))


def recent_orders(history: DataFrame, count: int = 5) -> DataFrame:
    """The newest lines of each buyer. The rank limits rows on the map side, before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("order_date"), "id")
    return history.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= count
    )


def recent_order_lines(recent: DataFrame) -> DataFrame:
    """Recent orders as text: date, seller, title and price."""
    return recent.select(
        "user_id", "position",
        F.concat(
            day_text("order_date"), F.lit(": "), "roaster_name", F.lit(" - "), "parent_title",
            F.lit(" ($"), money_text(F.col("price")), F.lit(")"),
        ).alias("line"),
    )


def spending_report(summary: DataFrame, recent: DataFrame, count: int = 5) -> DataFrame:
    """Spend figures beside the newest order lines, one row per buyer.

    At most ``count`` lines per buyer reach the list, so it cannot grow.
    """
    lines = (
        recent_order_lines(recent)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
        .select("user_id", F.array_join("lines.line", "\n").alias("recent_orders"))
    )
    return summary.join(lines, "user_id", "left").withColumn(
        "recent_orders", F.coalesce("recent_orders", F.lit(""))
    )


def feature_distribution(
    history: DataFrame, features: tuple[str, ...] = (
        "roaster_name", "origin_country", "processing_method",
    )
) -> DataFrame:
    """Order lines per buyer, feature and value; null and empty values are skipped.

    Lines are counted per value combination first, so each line is shuffled at most once and as
    part of a partial count, whatever the number of features.
    """
    combined = history.groupBy("user_id", *features).agg(
        F.count("*").alias("n"), F.max("order_date").alias("last_order")
    )
    pairs = F.array(
        *[F.struct(F.lit(name).alias("feature"), F.col(name).alias("value")) for name in features]
    )
    return (
        combined.select("user_id", F.explode(pairs).alias("pair"), "n", "last_order")
        .select("user_id", "pair.feature", "pair.value", "n", "last_order")
        .filter(present(F.col("value")))
        .groupBy("user_id", "feature", "value")
        .agg(F.sum("n").alias("n"), F.max("last_order").alias("last_order"))
    )


def top_features(
    distribution: DataFrame,
    count: int = 3,
    unbounded: tuple[str, ...] = ("processing_method",),
) -> DataFrame:
    """The most frequent values per buyer and feature; all values of the ``unbounded`` features.

    Ties go to the value ordered most recently, then to the value itself.
    """
    frequent = Window.partitionBy("user_id", "feature").orderBy(
        F.desc("n"), F.desc("last_order"), "value"
    )
    return distribution.withColumn("position", F.row_number().over(frequent)).filter(
        F.col("feature").isin(*unbounded) | (F.col("position") <= count)
    )
