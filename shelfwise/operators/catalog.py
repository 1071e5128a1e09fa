"""The sellable catalog and what is left of it after a purchase history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import contains_any
from shelfwise.session import cut_lineage

DETAIL_COLUMNS = (
    "origin_country", "origin_region", "processing_method", "roast_level", "varietals", "altitude",
    "farm", "producer", "tasting_notes", "extraction_confidence", "is_single_origin",
    "resting_period_days",
)


@dataclass(frozen=True)
class SellableRules:
    """Which variants are sold as whole beans in a household size. The defaults are fixed values."""

    form_terms: tuple[str, ...] = ("bean",)
    size_terms: tuple[str, ...] = ("250", "200g")
    excluded_titles: tuple[str, ...] = ("espresso", "subscription", "decaf", "voucher")
    excluded_vendor: str = "AAZ B2B"
    excluded_option3: str = "READY TO DRINK"
    blend_terms: tuple[str, ...] = ("blend",)
    pairing_terms: tuple[str, ...] = (" and ", " & ")

    def sellable(self) -> Column:
        """Rows with a null vendor, form or size are dropped; a null third option is kept."""
        option3 = F.col("option3")
        return (
            (F.col("available") == 1)
            & (F.col("vendor") != self.excluded_vendor)
            & (option3.isNull() | (option3 != self.excluded_option3))
            & contains_any(F.col("option2"), self.form_terms)
            & contains_any(F.col("option1"), self.size_terms)
            & ~contains_any(F.col("parent_title"), self.excluded_titles)
        )

    def coffee_type(self) -> Column:
        """The title decides first, then the extracted flag, then a paired title."""
        title, flag = F.col("parent_title"), F.col("is_single_origin")
        return (
            F.when(contains_any(title, self.blend_terms), "Blend")
            .when(flag, "Single Origin")
            .when(~flag, "Blend")
            .when(contains_any(title, self.pairing_terms), "Blend")
            .otherwise("Unknown")
        )


def adjusted_resting_days() -> Column:
    return F.col("resting_period_days") * 2


def smallest_packages(
    variants: DataFrame,
    products: DataFrame,
    roasters: DataFrame,
    rules: SellableRules = SellableRules(),
) -> DataFrame:
    """One row per product line and seller: the smallest sellable package, without attributes.

    The variant filter runs before any shuffle. Packages are ranked per seller key first, which
    keeps one row per group on the map side already, so a title or a seller that holds a third of
    all variants sends few rows on. Only the survivors meet the seller's name, on which the rank is
    defined.
    """
    package = variants.filter(rules.sellable()).select(
        "product_id", F.col("id").alias("variant_id"), "parent_title", "price", "grams",
        "option1", "option2", "option3", "available",
    )
    listing = products.select(
        F.col("id").alias("product_id"), "roaster_id", F.col("url").alias("product_url")
    )
    seller = roasters.select(F.col("id").alias("roaster_id"), F.col("name").alias("roaster_name"))
    return (
        package.join(listing, "product_id")
        .withColumn("rank", _smallest_first("parent_title", "roaster_id"))
        .filter("rank = 1")
        .join(seller, "roaster_id")
        .withColumn("rank", _smallest_first("parent_title", "roaster_name"))
        .filter("rank = 1")
    )


def whole_beans(
    variants: DataFrame,
    products: DataFrame,
    roasters: DataFrame,
    details: DataFrame,
    rules: SellableRules = SellableRules(),
) -> DataFrame:
    """The sellable catalog: the smallest packages with the attributes of their product."""
    packages = smallest_packages(variants, products, roasters, rules)
    details = details.select("product_id", *DETAIL_COLUMNS)
    return typed(packages.join(details, "product_id", "left"), rules)


def smallest_of(packages: DataFrame, rules: SellableRules = SellableRules()) -> DataFrame:
    """``smallest_packages`` of variants that have their seller's name and product's link already.

    Only the first package of a line and seller leaves the map side, so this is one shuffle.
    """
    return (
        packages.filter(rules.sellable())
        .drop("vendor")
        .withColumn("rank", _smallest_first("parent_title", "roaster_name"))
        .filter("rank = 1")
    )


def typed(packages: DataFrame, rules: SellableRules = SellableRules()) -> DataFrame:
    """Packages and their attributes with the type and the days of rest that follow from them."""
    return packages.withColumn("coffee_type", rules.coffee_type()).withColumn(
        "adjusted_resting_period_days", adjusted_resting_days()
    )


def _smallest_first(*group: str) -> Column:
    by_size = Window.partitionBy(*group).orderBy(F.asc_nulls_first("grams"), "variant_id")
    return F.row_number().over(by_size)


def available_options(beans: DataFrame, orders: DataFrame) -> DataFrame:
    """Single-origin rows whose variant nobody in ``orders`` has bought.

    The type filter stays above the rank of ``whole_beans``: a blend may be the smallest package of
    a title and then hides the single origin of the same title.
    """
    bought = orders.select("product_id", "variant_id").distinct()
    return (
        beans.filter(F.col("coffee_type") == "Single Origin")
        .join(bought, ["product_id", "variant_id"], "left_anti")
    )


def without_ordered_products(options: DataFrame, orders: DataFrame) -> DataFrame:
    """Options whose product was never ordered in any variant."""
    return options.join(orders.select("product_id").distinct(), "product_id", "left_anti")


def option_rows(options: DataFrame, roasters: DataFrame) -> DataFrame:
    """The columns a recommendation shows, with the seller's display name."""
    names = roasters.select("id", F.col("description").alias("display_name"))
    return options.join(names, options.roaster_id == names.id).select(
        "product_id", "variant_id", "parent_title", F.col("display_name").alias("roaster_name"),
        "processing_method", "origin_country", "tasting_notes", "price",
        F.col("product_url").alias("url"),
    )


def catalog_count(beans: DataFrame) -> DataFrame:
    """Rows per type, and in total under ``All``."""
    return (
        beans.rollup("coffee_type")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("coffee_type", F.lit("All")).alias("coffee_type"), "n")
    )


def options_by_roaster(options: DataFrame) -> DataFrame:
    """The options listed per seller in title order, one row each.

    ``starts_group`` marks the rows that a heading goes above. It comes from a pre-aggregated
    minimum per seller, not from a window: one seller may hold a third of the catalog. The options
    are kept, because the minimum, the join and the sort would each derive them again.
    """
    options = cut_lineage(
        options.select(
            "roaster_name", "product_id", "variant_id", "parent_title", "origin_country", "price"
        )
    )
    position = F.struct("parent_title", "product_id", "variant_id")
    groups = options.groupBy("roaster_name").agg(
        F.min(position).alias("first_row"), F.count("*").alias("n_options")
    )
    origin = F.when(
        F.coalesce(F.col("origin_country") != "", F.lit(False)),
        F.concat(F.lit(" ("), "origin_country", F.lit(")")),
    ).otherwise("")
    price = F.format_string("%.2f", F.col("price").cast("double"))
    return (
        options.join(groups, "roaster_name")
        .select(
            "roaster_name", "product_id", "variant_id", "n_options",
            (position == F.col("first_row")).alias("starts_group"),
            F.concat(F.lit("  - "), "parent_title", origin, F.lit(" $"), price).alias("line"),
            "parent_title",
        )
        .orderBy("roaster_name", "parent_title", "product_id", "variant_id")
        .drop("parent_title")
    )


def roaster_summary(options: DataFrame) -> DataFrame:
    """Number of options and price range per seller."""
    return options.groupBy("roaster_name").agg(
        F.count("*").alias("n_options"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def register_views(**frames: DataFrame) -> None:
    """Create or replace one temporary view per frame, named by its keyword."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
