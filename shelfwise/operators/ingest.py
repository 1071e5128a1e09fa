"""From nested landing records to the base tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import title_case
from shelfwise.session import cut_lineage, numbered
from shelfwise.sources.schemas import IMAGE_LIST, OPTION_LIST

EMPTY = ""


def stable_id(*columns) -> Column:
    """The same key gives the same id in every run, so loading twice changes nothing."""
    return F.xxhash64(*columns)


def joined_list(column) -> Column:
    """Comma text of a JSON list; other text as it is; empty for null."""
    items = F.from_json(column, "ARRAY<STRING>")
    return F.coalesce(
        F.when(column.startswith("["), F.array_join(items, ",")), column, F.lit(EMPTY)
    )


def newest_records(records: DataFrame, *key: str) -> DataFrame:
    """One record per key, the one updated last; its content settles ties the same way each run."""
    newest = Window.partitionBy(*key).orderBy(
        F.desc_nulls_last("updated_at"), F.xxhash64(*records.columns)
    )
    return (
        records.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    )


def with_source_key(records: DataFrame) -> DataFrame:
    """Add what a seller knows a product by: its id there, else its link, else all it says.

    Products without a link, or with a link that others have too, are products of their own.
    """
    content = F.sha2(F.to_json(F.struct(*records.columns)), 256)
    key = F.coalesce(
        F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("url:"), "url"),
        F.concat(F.lit("row:"), content),
    )
    return records.withColumn("source_key", key)


def one_per_key(records: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """The record updated last per key, and the others: ``record`` as JSON and how often, ``n``.

    Equal records are counted before the shuffle, so a record that comes a million times is one row.
    The JSON text settles ties; it is made after the shuffle by key and does not travel. A key with
    a missing part is no key.
    """
    whole = [F.col(name).isNotNull() for name in key]
    counted = records.filter(reduce(and_, whole)).groupBy(*records.columns).agg(F.count("*").alias("_n"))
    text = F.to_json(F.struct(*records.columns))
    newest = Window.partitionBy(*key).orderBy(F.desc_nulls_last("updated_at"), F.desc("_text"))
    ranked = counted.withColumn("_text", text).withColumn("_first", F.row_number().over(newest) == 1)
    left = F.when(F.col("_first"), F.col("_n") - 1).otherwise(F.col("_n"))
    others = ranked.withColumn("n", left).filter("n > 0")
    return (
        ranked.filter("_first").select(*records.columns),
        others.select("source", F.col("_text").alias("record"), "n"),
    )


def kept_ids(rows: DataFrame, old: DataFrame, last_id: Column, *key: str) -> DataFrame:
    """Rows with the ``id`` that ``old`` has for their key, or the next free number.

    ``key`` identifies a row of either table. Numbers are given in the order of the keys, after
    ``last_id`` and all ids of ``old``, so no two rows share one and a repeated load gives the same.
    """
    known = rows.join(old.select(*key, "id"), list(key), "left")
    fresh = numbered(known.filter("id is null").select(*key).distinct(), *key)
    used = old.agg(F.max("id")).scalar()
    first = F.greatest(last_id, F.coalesce(used, F.lit(0)), F.lit(0)) + 1
    return (
        known.join(fresh, list(key), "left")
        .withColumn("id", F.coalesce("id", first + F.col("number")))
        .drop("number")
    )


def display_names(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Description of each source name: the configured one, else the name in title case."""
    known = registry.groupBy("name").agg(F.min("description").alias("_description"))
    return (
        sources.join(known, "name", "left")
        .withColumn("description", F.coalesce("_description", title_case(F.col("name"))))
        .drop("_description")
    )


def identified(records: DataFrame) -> DataFrame:
    """Add a product id made of seller and link, for records that no earlier load has seen."""
    return records.withColumn("product_id", stable_id("roaster_id", "url"))


def product_rows(records: DataFrame, load_ts: datetime) -> DataFrame:
    """Product table rows from identified landing records, with their source_id."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(EMPTY)).alias(name)

    def when(name: str) -> Column:
        return F.col(name).try_cast("timestamp").alias(name)

    return records.select(
        F.col("product_id").alias("id"),
        F.col("id").alias("source_id"),
        "roaster_id", "title", text("handle"), text("body_html"),
        when("published_at"), when("created_at"), when("updated_at"),
        text("vendor"), text("product_type"), joined_list(F.col("tags")).alias("tags"), "url",
        F.lit(load_ts).alias("last_updated"),
        *(["source_key"] if "source_key" in records.columns else []),
    )


def option_rows(records: DataFrame) -> DataFrame:
    """One row per element of ``options``; records without a list give none."""
    options = F.posexplode(F.from_json("options", OPTION_LIST)).alias("at", "option")
    return records.select("product_id", options).select(
        stable_id("product_id", "at").alias("id"),
        "product_id",
        (F.col("at") + 1).alias("position"),
        F.coalesce("option.name", F.lit(EMPTY)).alias("name"),
        joined_list(F.col("option.values")).alias("values"),
    )


def image_rows(records: DataFrame) -> DataFrame:
    """One row per element of ``images``, positions counted from 1."""
    images = F.posexplode(F.from_json("images", IMAGE_LIST)).alias("at", "image")
    return records.select("product_id", images).select(
        stable_id("product_id", "at").alias("id"),
        "product_id",
        (F.col("at") + 1).alias("position"),
        F.coalesce("image.src", F.lit(EMPTY)).alias("src"),
    )


def _integer(name: str, default: int) -> Column:
    number = F.col(name).try_cast("double").try_cast("int")
    flag = F.when(F.lower(name) == "true", 1).when(F.lower(name) == "false", 0)
    return F.coalesce(number, flag, F.lit(default)).alias(name)


def coerce_variants(variants: DataFrame) -> DataFrame:
    """Typed variant columns with the declared defaults; unreadable numbers take the default."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(EMPTY)).alias(name)

    return variants.select(
        "roaster_id", "parent_id", "title",
        _integer("available", 0),
        F.col("compare_at_price").try_cast("double").alias("compare_at_price"),
        text("featured_image"),
        _integer("grams", 0),
        text("option1"), text("option2"), text("option3"),
        _integer("position", 0),
        F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)).alias("price"),
        _integer("requires_shipping", 1),
        text("sku"),
        _integer("taxable", 1),
        text("parent_title"), text("vendor"),
        F.col("weight").try_cast("double").alias("weight"),
        "weight_unit", "barcode",
        _integer("inventory_quantity", 0),
        F.col("created_at").try_cast("timestamp").alias("created_at"),
        F.col("updated_at").try_cast("timestamp").alias("updated_at"),
    )


def variant_rows(variants: DataFrame, products: DataFrame, load_ts: datetime) -> DataFrame:
    """Variant table rows: coerced landing variants attached to the product of their seller.

    The id covers every column: variants that differ in any of them are different ones.
    """
    parents = products.select(
        "roaster_id", F.col("source_id").alias("parent_id"), F.col("id").alias("product_id")
    )
    keys = ["roaster_id", "parent_id"]
    attached = coerce_variants(variants).join(parents, keys).drop(*keys)
    return attached.select(
        stable_id(*attached.columns).alias("id"),
        "*",
        F.lit(load_ts).alias("last_updated"),
    )


def load_rejects(
    landed: DataFrame, keys: DataFrame, kind: str, products: DataFrame | None = None
) -> DataFrame:
    """Good records that a load leaves out, by reason: their ``source`` is not registered, or no
    product of the seller has their parent's id."""
    known = landed.join(keys, "source", "left")
    reason = F.when(F.col("roaster_id").isNull(), "source not registered")
    if products is not None:
        parents = products.select("roaster_id", F.col("source_id").alias("parent_id"))
        known = known.join(
            parents.distinct().withColumn("_parent", F.lit(True)), ["roaster_id", "parent_id"], "left"
        )
        reason = reason.when(F.col("_parent").isNull(), "no such product")
    return known.select(
        "source", F.lit(kind).alias("kind"), reason.alias("reason"), F.to_json(F.struct(*landed.columns)).alias("record")
    ).filter("reason is not null")


def load_counts(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Products and variants per roaster. Variants are counted per product before the join."""
    per_product = variants.groupBy("product_id").agg(F.count("*").alias("n"))
    return (
        products.select("roaster_id", F.col("id").alias("product_id"))
        .join(per_product, "product_id", "left")
        .groupBy("roaster_id")
        .agg(
            F.count("*").alias("n_products"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_variants"),
        )
    )


def null_violations(table: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows per column that must not be null but are, from one pass."""
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rules = F.explode(
        F.array(
            *[
                F.struct(F.lit(f"{name}.{c} is null").alias("rule"), F.col(c).alias("violations"))
                for c in columns
            ]
        )
    )
    return counts.select(rules.alias("r")).select("r.rule", "r.violations")


def duplicate_violations(table: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Keys that more than one row holds."""
    repeated = table.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(
        F.lit(f"{name}.({', '.join(columns)}) repeats").alias("rule"),
        F.count("*").alias("violations"),
    )


def orphan_violations(
    child: DataFrame, column: str, parent: DataFrame, key: str, name: str
) -> DataFrame:
    """Rows whose foreign key has no parent; null keys are allowed.

    Child rows are counted per key before the join, so a hot key is one row in it.
    """
    keys = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_key"))
        .agg(F.count("*").alias("n"))
    )
    lost = keys.join(parent.select(F.col(key).alias("_key")), "_key", "left_anti")
    return lost.agg(
        F.lit(f"{name}.{column} has no parent").alias("rule"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations"),
    )
