"""The catalog model read from the wholesale tables (part, supplier, lineitem, orders, ...).

A listing is a part sold by a supplier, a variant one package size of a listing, an order line a
purchase of a variant by a customer.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.terms import Term
from shelfwise.operators import catalog, spend
from shelfwise.operators.catalog import SellableRules
from shelfwise.session import dealt
from shelfwise.sources.landing import read_table

RULES = SellableRules(
    size_terms=("m",),
    excluded_titles=("rod",),
    excluded_vendor="Brand#13",
    blend_terms=("ring",),
    pairing_terms=("plate",),
)
AS_OF = date(2001, 7, 15)
LOAD_TS = datetime(2001, 7, 15)
MONTHLY_BUDGET = 200000.0
HOUSEHOLD = 7  # nation of the buyers who share their orders

# Titles are two words; each word stands for a note, a varietal or a roast.
DICTIONARY = [
    Term("roast", "hot", "Dark"), Term("roast", "old", "Espresso"),
    Term("roast", "cold", "Light"), Term("roast", "new", "Filter"),
    Term("process", "economy", "Washed", "primary"),
    Term("process", "standard", "Washed", "primary"),
    Term("process", "large", "Natural", "primary"),
    Term("process", "medium", "Honey", "primary"),
    Term("process", "promo", "Anaerobic", "secondary"),
    Term("process", "small", "Thermal Shock", "other"),
    Term("varietal", "anvil", "SL28"), Term("varietal", "bolt", "Bourbon"),
    Term("varietal", "gear", "Batian"), Term("varietal", "gizmo", "Typica"),
    Term("fruits", "red", "Cherry"), Term("florals", "blue", "Lavender"),
    Term("sweets", "ring", "Toffee"), Term("spices", "plate", "Clove"),
    Term("others", "widget", "Almond"), Term("others", "rod", "Tobacco"),
    *[Term("country", f"nation {n}", f"NATION_{n}") for n in range(25)],
]


# Words of titles as places: regions, areas in them, and names that lie in two regions or countries.
PLACES = [
    Term("region", "gear", "Gearland", "NATION_1"), Term("region", "red", "Red Valley", "NATION_1"),
    Term("region", "blue", "Blue Coast", "NATION_4"),
    Term("region", "gizmo", "Gizmo Hills", "NATION_2"), Term("region", "gizmo", "Gizmo Hills", "NATION_3"),
    Term("area", "anvil", "Anvil Farm", "Gearland"), Term("area", "ring", "Ring Estate", "Gizmo Hills"),
    Term("area", "bolt", "Bolt Ridge", "Red Valley"), Term("area", "bolt", "Bolt Ridge", "Blue Coast"),
    *[Term("country", f"nation {n}", f"NATION_{n}") for n in range(25)],
]

PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")

# Room for seller numbers in a product's number. Nothing shares a number: a larger seller number is
# an error, and so is a product too large for 64 bits (parts above 4.6 billion).
SELLERS = 200_000_000


def product_key() -> Column:
    seller = F.col("l_suppkey")
    checked = F.when(seller < SELLERS, seller).otherwise(
        F.raise_error(F.lit(f"seller numbers reach {SELLERS}")).cast("bigint")
    )
    return F.col("l_partkey") * SELLERS + checked


def variant_key() -> Column:
    return product_key() * 10 + F.col("l_linenumber")


def product_url() -> Column:
    return F.concat(
        F.lit("https://"), F.col("l_suppkey").cast("string"), F.lit("/"),
        F.col("l_partkey").cast("string"),
    )


class Store:
    """Lazily built frames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def roasters(self) -> DataFrame:
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.table("supplier")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("id"),
                F.col("s_name").alias("name"),
                F.col("s_name").alias("description"),
                F.concat(F.lit("https://"), F.lower("s_name")).alias("url"),
                F.col("n_name").alias("origin_country"),
                F.col("r_name").alias("origin_region"),
            )
        )

    def listings(self) -> DataFrame:
        """Part and supplier pairs that were ever sold."""
        sold = self._lines_by_part().distinct()
        return sold.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    def products(self) -> DataFrame:
        return self.listings().select(
            product_key().alias("id"),
            F.col("l_suppkey").alias("roaster_id"),
            F.col("p_name").alias("title"),
            F.lit(None).cast("string").alias("parent_title"),
            product_url().alias("url"),
            F.concat_ws(" ", "p_type", "p_brand").alias("body_html"),
            F.concat_ws(",", F.split("p_name", " ")).alias("tags"),
            F.col("p_brand").alias("vendor"),
        )

    def _lines_by_part(self, *columns: str | Column) -> DataFrame:
        """Order lines dealt out by their part, with nothing but numbers and flags: grouping them by
        part and more, and joining the part's columns to the groups, takes no other shuffle. Hardly
        two lines share a package, so that grouping them before the shuffle would save nothing."""
        lines = self.table("lineitem").filter(F.col("l_partkey").isNotNull())
        return dealt(lines.select("l_partkey", "l_suppkey", *columns), "l_partkey")

    def _with_part(self, grouped: DataFrame) -> DataFrame:
        """Groups with the columns of their part, once for each different row the part has."""
        part = dealt(self.table("part").select(*PART), "p_partkey").distinct()
        return grouped.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")

    def packages(self, few_parts: bool = False) -> DataFrame:
        """Part, seller and size, with the part's columns.

        Every size that was sold is offered, and the next size: one that nobody has bought yet is
        in stock at the retail price of its size. For ``few_parts`` the part is joined before the
        grouping: filters on its columns then reach its scan and keep order lines of other parts out
        of the shuffle, which is more than its columns add to the lines that are left.
        """
        keys = ["l_partkey", "l_suppkey", *(PART[1:] if few_parts else ())]
        if few_parts:
            lines = self.table("lineitem").select(
                "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", *self._line_flags()
            )
            lines = lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        else:
            lines = self._lines_by_part("l_linenumber", "l_extendedprice", *self._line_flags())
        sold = F.struct(
            F.col("l_linenumber").alias("size"), F.col("l_extendedprice").alias("price"), "open",
            "kept",
        )
        offered = F.struct(
            (F.col("l_linenumber") % 7 + 1).alias("size"), F.lit(None).cast("double").alias("price"),
            F.lit(None).cast("int").alias("open"), F.lit(None).cast("boolean").alias("kept"),
        )
        sizes = lines.select(*keys, F.explode(F.array(sold, offered)).alias("package"))
        grouped = sizes.groupBy(*keys, F.col("package.size").alias("l_linenumber")).agg(
            F.min("package.price").alias("least"), F.max("package.open").alias("open"),
            F.max("package.kept").alias("kept"),
        )
        return self._priced(grouped if few_parts else self._with_part(grouped))

    def carried_packages(self) -> DataFrame:
        """The packages that were sold and not always sent back. The next size of a line, which
        nobody may have bought, is none of them and adds nothing to those it shares a size with."""
        lines = self._lines_by_part("l_linenumber", "l_extendedprice", *self._line_flags())
        grouped = lines.groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(
            F.min("l_extendedprice").alias("least"), F.max("open").alias("open"),
            F.max("kept").alias("kept"),
        )
        return self._priced(self._with_part(grouped.filter("kept")))

    def _line_flags(self) -> list[Column]:
        return [
            (F.col("l_linestatus") == "O").cast("int").alias("open"),
            (F.col("l_returnflag") != "R").alias("kept"),
        ]

    def _priced(self, packages: DataFrame) -> DataFrame:
        return packages.withColumn(
            "price", F.coalesce("least", F.col("p_retailprice") * F.col("l_linenumber"))
        ).withColumn("available", F.coalesce("open", F.lit(1)))

    def _variant_columns(self) -> list[Column]:
        return [
            variant_key().alias("id"),
            product_key().alias("product_id"),
            F.col("p_name").alias("parent_title"),
            F.col("p_brand").alias("vendor"),
            F.col("price"),
            F.col("available"),
            (F.col("l_linenumber") * 50).alias("grams"),
            F.col("p_type").alias("option1"),
            F.lit("Whole Bean").alias("option2"),
            F.lit(None).cast("string").alias("option3"),
        ]

    def variants(self) -> DataFrame:
        return self.packages().select(*self._variant_columns())

    def carried_variants(self) -> DataFrame:
        """Variants with a line that was not sent back; others are no longer carried."""
        return self.carried_packages().select(*self._variant_columns())

    def details(self) -> DataFrame:
        sellers = self.roasters().select("id", "origin_country", "origin_region")
        rows = self.listings().join(sellers, F.col("l_suppkey") == F.col("id"))
        return rows.select(product_key().alias("product_id"), *self._detail_columns())

    def _detail_columns(self) -> list[Column]:
        words = F.split("p_name", " ")
        none = F.array().cast("array<string>")
        notes = F.struct(
            F.slice(words, 1, 1).alias("fruits"), F.slice(words, 2, 1).alias("sweets"),
            none.alias("florals"), none.alias("spices"), none.alias("others"),
        )
        # The size stands for the three-valued flag: true, false or unknown.
        group = F.col("p_size") % 3
        missing = F.lit(None).cast("string")
        return [
            F.when(group == 1, True).when(group == 0, False).alias("is_single_origin"),
            F.col("origin_country"),
            F.col("origin_region"),
            F.col("p_type").alias("processing_method"),
            missing.alias("roast_level"),
            F.col("p_brand").alias("varietals"),
            missing.alias("altitude"),
            missing.alias("farm"),
            missing.alias("producer"),
            notes.alias("tasting_notes"),
            F.lit(1.0).alias("extraction_confidence"),
            F.col("p_size").alias("resting_period_days"),
        ]

    def _catalog(self) -> DataFrame:
        """Variants with their seller and attributes, from one pass over the order lines: part,
        seller and details of a package are columns of the row it was grouped to."""
        sellers = self.roasters().select(
            F.col("id").alias("roaster_id"), F.col("name").alias("roaster_name"),
            "origin_country", "origin_region",
        )
        return (
            self.packages(few_parts=True)
            .join(sellers, F.col("l_suppkey") == F.col("roaster_id"))
            .select(
                *self._variant_columns(), "roaster_id", "roaster_name",
                product_url().alias("product_url"), *self._detail_columns(),
            )
            .withColumnRenamed("id", "variant_id")
        )

    def beans(self) -> DataFrame:
        return catalog.typed(self.smallest_packages(), RULES)

    def smallest_packages(self) -> DataFrame:
        return catalog.smallest_of(self._catalog(), RULES)

    def orders(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice",
        )
        heads = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            product_key().alias("product_id"),
            variant_key().alias("variant_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").alias("price_paid"),
        )

    def household_orders(self) -> DataFrame:
        """The orders of one household, that of a nation."""
        members = self.table("customer").filter(F.col("c_nationkey") == HOUSEHOLD)
        return self.orders().join(members.select(F.col("c_custkey").alias("user_id")), "user_id")

    def options(self, beans: DataFrame | None = None) -> DataFrame:
        beans = self.beans() if beans is None else beans
        return catalog.available_options(beans, self.orders())

    def single_origins(self, beans: DataFrame | None = None) -> DataFrame:
        beans = self.beans() if beans is None else beans
        return beans.filter(F.col("coffee_type") == "Single Origin")

    def history(self, beans: DataFrame | None = None) -> DataFrame:
        beans = self.beans() if beans is None else beans
        return spend.purchase_history(self.past_orders(), beans, self.roasters())

    def past_orders(self) -> DataFrame:
        return self.orders().filter(F.col("order_date") <= F.lit(AS_OF))

    def sellable_lines(self) -> DataFrame:
        return spend.sellable_lines(self.past_orders(), self.smallest_packages())

    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"))
