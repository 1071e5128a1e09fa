"""The batch jobs: load a landing zone, read attributes, advise buyers, write orders back.

Each job reads one snapshot folder of Parquet tables and writes the next one. The steps between are
lazy frames; control leaves the cluster only at a write.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.functions.terms import Term
from shelfwise.operators import catalog, enrich, ingest, orders, recommend, resolve, spend
from shelfwise.operators.catalog import SellableRules
from shelfwise.session import cut_lineage, tune
from shelfwise.sources import landing, sinks
from shelfwise.sources.schemas import PRODUCT_RAW, TABLES, VARIANT_RAW

CATALOG_TABLES = (
    "roasters", "products", "product_options", "product_images", "variants",
    "product_extended_details", "id_marks",
)
NUMBERED_TABLES = ("products", "product_options", "product_images", "variants")


def conform(rows: DataFrame, table: str) -> DataFrame:
    """The declared columns of a base table; those that ``rows`` lacks are null."""
    return rows.select(
        *[
            (F.col(f"`{field.name}`") if field.name in rows.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in StructType.fromDDL(TABLES[table])
        ]
    )


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def write_tables(folder: str, **tables: DataFrame) -> None:
    for name, rows in tables.items():
        sinks.write_snapshot(conform(rows, name), f"{folder}/{name}.parquet")


@dataclass
class Snapshot:
    """The tables of one snapshot folder; without a folder all are empty."""

    spark: SparkSession
    folder: str | None

    def table(self, name: str) -> DataFrame:
        if self.folder is None:
            return empty_table(self.spark, name)
        return landing.read_table(self.spark, self.folder, name)

    def beans(self, rules: SellableRules = SellableRules()) -> DataFrame:
        return catalog.whole_beans(
            self.table("variants"), self.table("products"), self.table("roasters"),
            self.table("product_extended_details"), rules,
        )


def _with_content(variants: DataFrame) -> DataFrame:
    """Add a digest of what a variant says, by which it is known within its product."""
    data = [c for c in variants.columns if c not in ("id", "product_id", "last_updated")]
    return variants.withColumn("content", F.sha2(F.to_json(F.struct(*data)), 256))


def load_catalog(
    spark: SparkSession,
    landing_folder: str,
    registry: DataFrame,
    previous: str | None,
    target: str,
    load_ts: datetime,
) -> tuple[DataFrame, DataFrame]:
    """Load ``products`` and ``variants`` of the landing zone over the previous snapshot.

    Products are known by their seller and their id there, without an id by their link. Those that
    come again keep their id and replace themselves and their children; loading the same files twice
    gives the same tables. Ids are numbers given once, not hashes, so no two rows share one. Variants
    that differ in any column all stay. Returns the report (records, bad records, files and files
    that could not be read whole, per source) and
    the good records that were left out: ``source``, ``kind``, ``reason``, the ``record``, and how
    many equal ones, ``n``.
    """
    old = Snapshot(tune(spark), previous)
    landed = {
        name: landing.read_landing(spark, f"{landing_folder}/{name}", schema)
        for name, schema in (("products", PRODUCT_RAW), ("variants", VARIANT_RAW))
    }
    named = ingest.display_names(
        registry.select("key", "name", "url"), registry.select("name", "description")
    )
    incoming = named.withColumn("id", ingest.stable_id("url"))
    sellers = sinks.upsert_roasters(old.table("roasters"), incoming)
    sellers = sinks.with_audit(sellers, old.table("roasters"), "id", load_ts)

    keys = named.join(sellers.select("url", F.col("id").alias("roaster_id")), "url").select(
        F.col("key").alias("source"), "roaster_id"
    )
    products = landing.good_records(landed["products"]).join(keys, "source")
    variants = landing.good_records(landed["variants"]).join(keys, "source")
    marks = old.table("id_marks")

    def with_ids(table: str, rows: DataFrame, before: DataFrame, *key: str) -> DataFrame:
        last = marks.filter(F.col("name") == table).agg(F.max("last_id")).scalar()
        return ingest.kept_ids(rows, before, F.coalesce(last, F.lit(0)), *key)

    records, repeated = ingest.one_per_key(
        ingest.with_source_key(products), "roaster_id", "source_key"
    )
    records = cut_lineage(
        with_ids(
            "products", records.withColumnRenamed("id", "own_id"), old.table("products"),
            "roaster_id", "source_key",
        )
        .withColumnRenamed("id", "product_id")
        .withColumnRenamed("own_id", "id")
    )
    fresh = ingest.product_rows(records, load_ts)
    fresh_ids = fresh.select(F.col("id").alias("product_id"))

    def children(table: str, rows: DataFrame, *key: str) -> DataFrame:
        before = old.table(table)
        made = with_ids(table, rows.drop("id"), before, *key)
        kept = sinks.without_children_of(before, fresh_ids, "product_id")
        return cut_lineage(kept.unionByName(conform(made, table)))

    # Landing rows that are equal after coercion are one variant; the others are reported.
    attached = ingest.variant_rows(variants, fresh, load_ts).drop("id")
    counted = cut_lineage(attached.groupBy(*attached.columns).agg(F.count("*").alias("n")))
    packages = _with_content(conform(counted, "variants"))
    old_packages = _with_content(old.table("variants"))
    made = with_ids("variants", packages.drop("id"), old_packages, "product_id", "content")
    kept = sinks.without_children_of(old.table("variants"), fresh_ids, "product_id")
    tables = {
        "products": cut_lineage(
            sinks.replace_by_key(
                old.table("products"), conform(fresh, "products"), "roaster_id", "source_key"
            )
        ),
        "product_options": children(
            "product_options", ingest.option_rows(records), "product_id", "position"
        ),
        "product_images": children(
            "product_images", ingest.image_rows(records), "product_id", "position"
        ),
        "variants": cut_lineage(kept.unionByName(conform(made, "variants"))),
    }
    used = [
        rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id")).select(F.lit(name).alias("name"), "last_id")
        for name, rows in tables.items()
    ]
    last_ids = reduce(DataFrame.unionByName, used, marks).groupBy("name").agg(
        F.max("last_id").alias("last_id")
    )
    write_tables(
        target,
        roasters=sellers,
        **tables,
        product_extended_details=old.table("product_extended_details"),
        id_marks=last_ids,
    )

    by_seller = keys.groupBy("roaster_id").agg(F.min("source").alias("source"))
    equal = counted.filter("n > 1").join(
        fresh.select(F.col("id").alias("product_id"), "roaster_id"), "product_id"
    ).join(by_seller, "roaster_id")
    left_out = [
        ingest.load_rejects(landing.good_records(landed["products"]), keys, "products")
        .withColumn("n", F.lit(1).cast("bigint")),
        ingest.load_rejects(landing.good_records(landed["variants"]), keys, "variants", fresh)
        .withColumn("n", F.lit(1).cast("bigint")),
        repeated.select(
            "source", F.lit("products").alias("kind"),
            F.lit("older or equal record of the product").alias("reason"), "record", "n",
        ),
        equal.select(
            "source", F.lit("variants").alias("kind"), F.lit("equals another variant").alias("reason"),
            F.to_json(F.struct(*attached.columns)).alias("record"), (F.col("n") - 1).alias("n"),
        ),
    ]
    rejects = reduce(DataFrame.unionByName, left_out)
    reports = []
    for kind, rows in landed.items():
        counts = landing.load_report(rows.select("source", landing.CORRUPT))
        files = landing.source_files(spark, f"{landing_folder}/{kind}")
        # A source whose files are all unreadable has no record, but a row.
        both = files.join(counts, "source", "left").fillna(0, ["n_rows", "n_bad"])
        reports.append(both.withColumn("kind", F.lit(kind)))
    report = reduce(DataFrame.unionByName, reports)
    return report, rejects


def enrich_catalog(
    spark: SparkSession,
    current: str,
    pages: DataFrame,
    target: str,
    load_ts: datetime,
    dictionary: list[Term] = enrich.DICTIONARY,
    rules: SellableRules = SellableRules(),
    ids: DataFrame | None = None,
) -> DataFrame:
    """Read attributes of catalog products that have none, or of the chosen ``ids``.

    Writes a snapshot with the new details table and returns the details added or replaced.
    """
    now = Snapshot(tune(spark), current)
    products, details = now.table("products"), now.table("product_extended_details")
    if ids is None:
        todo = enrich.to_enrich(now.beans(rules), products, details).select("product_id")
    else:
        todo = ids.select("product_id").distinct()
    chosen = products.join(todo.withColumnRenamed("product_id", "id"), "id", "left_semi")
    wanted = pages.join(chosen.select("url").distinct(), "url", "left_semi")
    texts = enrich.assemble_documents(chosen, wanted)
    names = now.table("roasters").select(
        F.col("id").alias("roaster_id"), F.col("description").alias("roaster_name")
    )
    sellers = chosen.select(F.col("id").alias("product_id"), "roaster_id").join(
        names, "roaster_id", "left"
    )
    found = enrich.extract_attributes(
        texts.join(sellers, "product_id"), dictionary, roaster_name="roaster_name"
    )
    fresh = cut_lineage(
        conform(enrich.detail_rows(found, load_ts), "product_extended_details")
    )
    others = {name: now.table(name) for name in CATALOG_TABLES}
    others["product_extended_details"] = sinks.replace_by_key(details, fresh, "product_id")
    write_tables(target, **others)
    return fresh


def advise_buyers(
    spark: SparkSession,
    current: str,
    order_history: DataFrame,
    users: DataFrame,
    as_of: datetime,
    budget: float = spend.MONTHLY_BUDGET,
    flexibility: float = spend.BUDGET_FLEXIBILITY,
    rules: SellableRules = SellableRules(),
) -> tuple[DataFrame, DataFrame]:
    """The spending report and one recommended offer per buyer, with its readable line."""
    now = Snapshot(tune(spark), current)
    sellers = now.table("roasters")
    beans = cut_lineage(now.beans(rules))
    notes = enrich.notes_array(F.col("tasting_notes"))
    names = sellers.select("id", F.col("description").alias("display_name"))
    options = (
        beans.filter(F.col("coffee_type") == "Single Origin")
        .join(names, F.col("roaster_id") == F.col("id"))
        .withColumn("roaster_name", F.col("display_name"))
        .withColumn("notes", notes)
    )
    past = order_history.filter(F.col("order_date") <= F.lit(as_of))
    history = cut_lineage(
        spend.purchase_history(past, beans, sellers).withColumn("notes", notes)
    )
    summary = spend.with_budget(
        spend.spending_summary(history, users, as_of.date()), budget, flexibility
    )
    report = spend.spending_report(summary, spend.recent_orders(history))
    picked = recommend.recommend_from_history(summary, history, options)
    shown = F.array_join(enrich.notes_array(F.col("tasting_notes")), ", ")
    lines = options.withColumn("url", F.col("product_url")).select(
        "product_id", "variant_id", recommend.format_line(shown).alias("line")
    )
    return report, picked.join(lines, ["product_id", "variant_id"])


def _append(placed: DataFrame, orders_folder: str, as_of: datetime) -> None:
    rows = placed.withColumns(
        {
            "id": ingest.stable_id("user_id", "request_id", F.lit(as_of)),
            "created_at": F.lit(as_of),
            "updated_at": F.lit(as_of),
        }
    )
    sinks.append_orders(
        conform(rows, "order_history"), orders_folder, ("created_at", "user_id", "request_id")
    )


def add_orders(
    spark: SparkSession, current: str, requests: DataFrame, orders_folder: str, as_of: datetime
) -> DataFrame:
    """Append order requests by ids (request_id, user_id, product_id, variant_id, quantity,
    price_paid, order_date, notes); returns the rejects with their reason."""
    now = Snapshot(tune(spark), current)
    placed, rejects = orders.order_snapshot(
        requests, now.table("products"), now.table("variants"), now.table("roasters"),
        now.table("product_extended_details"), as_of,
    )
    _append(placed, orders_folder, as_of)
    return rejects


def add_orders_by_name(
    spark: SparkSession,
    current: str,
    requests: DataFrame,
    orders_folder: str,
    as_of: datetime,
    rules: SellableRules = SellableRules(),
) -> DataFrame:
    """Append an order at the catalog price for each name (request_id, user_id, fragment,
    order_date) that means one product; returns the names that mean none or several, and those
    whose order was rejected with the ``reason``."""
    now = Snapshot(tune(spark), current)
    resolved = resolve.resolve_names(requests, now.beans(rules))
    found, missing = resolve.order_requests_by_name(resolved)
    rejects = add_orders(spark, current, found, orders_folder, as_of)
    return missing.unionByName(
        rejects.select(*[c for c in requests.columns if c in rejects.columns], "reason"),
        allowMissingColumns=True,
    )


def place_orders(
    spark: SparkSession,
    current: str,
    requests: DataFrame,
    orders_folder: str,
    as_of: datetime,
    rules: SellableRules = SellableRules(),
) -> DataFrame:
    """Append an order for each order string (request_id, user_id, text); returns the rejects.

    The folder holds the orders so far; an option that its buyer has already is rejected. Orders of
    the same ``as_of`` do not count for that, so a batch can be repeated.
    """
    now = Snapshot(tune(spark), current)
    options = now.beans(rules).filter(F.col("coffee_type") == "Single Origin")
    held = sinks.read_orders(spark, orders_folder)
    if held is not None:
        held = held.filter(F.col("created_at") != F.lit(as_of))
    placed, rejects = orders.place_order_strings(
        requests, options, now.table("products"), now.table("variants"), now.table("roasters"),
        now.table("product_extended_details"), as_of, held,
    )
    _append(placed, orders_folder, as_of)
    return rejects
