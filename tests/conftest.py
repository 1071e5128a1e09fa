from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from shelfwise.operators.catalog import whole_beans  # noqa: E402
from shelfwise.session import tune  # noqa: E402
from shelfwise.sources.schemas import NOTES, TABLES  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("shelfwise-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def frame(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """Rows of a base table; columns that a row leaves out are null."""
    schema = spark.createDataFrame([], TABLES[table]).schema
    return spark.createDataFrame([[row.get(f.name) for f in schema] for row in rows], schema)


# Variants of the golden catalog: number, title, what differs from the defaults, and the product
# where it is not the variant's own. Defaults: 250 g of whole beans from seller 1 at 20.
GOLDEN = [
    (1, "Sunrise Blend", {"flag": True}),
    (2, "Kilo AA", {"flag": True, "days": 10}),
    (3, "Kilo AA", {"product": 2, "option1": "1kg (4x250)", "grams": 1000}),
    (4, "Kilo AA", {"roaster": 2, "flag": True, "price": 19.0}),
    (5, "Upper", {"option1": "200G"}),
    (6, "Ground One", {"option2": "Ground"}),
    (7, "No Option", {"option2": None}),
    (8, "House ESPRESSO", {}),
    (9, "Monthly Subscription", {}),
    (10, "Decaf Peru", {}),
    (11, "Gift Voucher", {}),
    (12, "Wholesale", {"vendor": "AAZ B2B"}),
    (13, "Vendorless", {"vendor": None}),
    (14, "Can", {"option3": "READY TO DRINK"}),
    (15, "Can Two", {"option3": "ready to drink"}),
    (16, "Sold Out", {"available": 0}),
    (17, "Kenya & Peru", {}),
    (18, "Salt and Sand", {}),
    (19, "Sandy", {}),
    (20, "Rwanda & Friends", {"flag": True}),
    (21, "Plain", {"flag": False}),
    (22, "Tie", {}),
    (23, "Tie", {}),
    (24, "Nullgram", {}),
    (25, "Nullgram", {"grams": None}),
    (26, "Big", {"option1": "500g"}),
]
EXPECTED_TYPES = {
    1: "Blend", 2: "Single Origin", 4: "Single Origin", 5: "Unknown", 15: "Unknown", 17: "Blend",
    18: "Blend", 19: "Unknown", 20: "Single Origin", 21: "Blend", 22: "Unknown", 25: "Unknown",
}


class Golden:
    """The golden tables; ids of products and variants agree where nothing else is said."""

    def __init__(self, spark: SparkSession):
        variants, products, details = [], {}, []
        for number, title, other in GOLDEN:
            product = other.get("product", number)
            variants.append(
                {
                    "id": number, "product_id": product, "parent_title": title,
                    "vendor": other.get("vendor", "v"), "available": other.get("available", 1),
                    "grams": other.get("grams", 250), "price": other.get("price", 20.0),
                    "option1": other.get("option1", "250g"),
                    "option2": other.get("option2", "Whole Bean"),
                    "option3": other.get("option3"),
                }
            )
            products.setdefault(
                product,
                {
                    "id": product, "roaster_id": other.get("roaster", 1), "title": title,
                    "url": f"https://shop/{product}", "parent_title": "",
                },
            )
            if "flag" in other or "days" in other:
                details.append(
                    {
                        "product_id": product, "is_single_origin": other.get("flag"),
                        "resting_period_days": other.get("days"),
                        "origin_country": f"Country {product}", "processing_method": "Washed",
                    }
                )
        self.variants = frame(spark, "variants", variants)
        self.products = frame(spark, "products", list(products.values()))
        self.details = frame(spark, "product_extended_details", details)
        self.roasters = frame(
            spark, "roasters",
            [
                {"id": 1, "name": "r_one", "description": "Roaster One", "url": "https://one"},
                {"id": 2, "name": "r_two", "description": "Roaster Two", "url": "https://two"},
            ],
        )
        self.beans = whole_beans(self.variants, self.products, self.roasters, self.details)
        self.orders = frame(
            spark, "order_history",
            [
                {"id": n, "user_id": 1, "product_id": p, "variant_id": v, "quantity": 1,
                 "order_date": datetime.fromisoformat(day), "price_paid": price,
                 "product_title": f"t{p}", "roaster_name": "r_one"}
                for n, p, v, day, price in [
                    (1, 2, 2, "2025-01-03", 20.0), (2, 2, 3, "2024-12-10", 30.0),
                    (3, 4, 4, "2024-10-05", 15.5), (4, 16, 16, "2024-12-20", 8.0),
                    (5, 9999, 9999, "2024-11-11", 7.0),
                ]
            ],
        )
        self.no_orders = frame(spark, "order_history", [])


@pytest.fixture(scope="session")
def golden(spark):
    return Golden(spark)


def notes(**lists: list[str]) -> tuple:
    categories = ("fruits", "sweets", "florals", "spices", "others")
    return tuple(lists.get(category, []) for category in categories)


NOTES_TYPE = NOTES
