"""The registered queries: every operator over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import text as t
from shelfwise.functions.regions import region_text
from shelfwise.functions.terms import Term
from shelfwise.operators import catalog, enrich, ingest, orders, recommend, resolve, spend
from shelfwise.plans import store as model
from shelfwise.plans.store import Store
from shelfwise.session import cut_lineage, join_side, tune
from shelfwise.sources import landing, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
    """Register a query under its function name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Store(tune(spark), folder))

    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


def _day(name: str = "order_date") -> Column:
    return F.col(name).cast("date").alias(name)


# ---------------------------------------------------------------- catalog


@query
def whole_beans(s: Store) -> DataFrame:
    return s.beans().select(
        "product_id", "variant_id", "parent_title", "roaster_name", "price", "option1",
        "product_url", "coffee_type", "origin_country", "origin_region", "processing_method",
        "is_single_origin", "resting_period_days", "adjusted_resting_period_days", "rank",
    )


@query
def available_options(s: Store) -> DataFrame:
    return (
        s.options()
        .select(
            "product_id", "variant_id", "parent_title", "roaster_name", "price", "origin_country",
            "processing_method", "product_url",
        )
        .orderBy("roaster_name", "parent_title")
    )


@query
def candidate_options(s: Store) -> DataFrame:
    """Options of one household: no product its buyers ever had in any size."""
    left = catalog.without_ordered_products(s.single_origins(), s.household_orders())
    return left.select("product_id", "variant_id", "parent_title", "roaster_name", "price")


@query
def recommendation_options(s: Store) -> DataFrame:
    rows = catalog.option_rows(s.options(), s.roasters())
    return (
        rows.withColumn("tasting_notes", enrich.notes_text(F.col("tasting_notes")))
        .orderBy("roaster_name", "parent_title")
    )


@query
def catalog_count(s: Store) -> DataFrame:
    return catalog.catalog_count(s.beans())


@query
def view_counts(s: Store) -> DataFrame:
    """Sellable products and sellers, read through their registered views."""
    catalog.register_views(sellable_products=s.beans(), known_sellers=s.roasters())
    return s.spark.sql(
        "SELECT k.origin_country, count(*) AS n_products, min(p.price) AS cheapest "
        "FROM sellable_products p JOIN known_sellers k ON p.roaster_name = k.name "
        "GROUP BY k.origin_country"
    )


@query
def options_by_roaster(s: Store) -> DataFrame:
    return catalog.options_by_roaster(s.options())


@query
def roaster_summary(s: Store) -> DataFrame:
    return catalog.roaster_summary(s.options())


# ---------------------------------------------------------------- orders


@query
def order_history_view(s: Store) -> DataFrame:
    view = orders.order_history_view(s.orders(), s.beans(), s.roasters())
    return orders.newest_first(
        view.select(
            "id", "user_id", "product_id", "variant_id", _day(), "quantity", "price_paid",
            "roaster_display_name", "parent_title", "current_processing_method",
            "current_origin_country", "current_origin_region",
        )
    )


@query
def order_status(s: Store) -> DataFrame:
    marked = orders.order_status(s.orders(), s.carried_variants())
    return marked.select("id", "user_id", _day(), "price_paid", "product_status")


@query
def orders_still_carried(s: Store) -> DataFrame:
    marked = orders.order_status(s.orders(), s.carried_variants(), include_discontinued=False)
    return marked.select("id", "product_status")


@query
def orders_by_status(s: Store) -> DataFrame:
    marked = orders.order_status(s.orders(), s.carried_variants())
    return orders.orders_by_status(marked).select("bucket", "id", _day(), "price_paid")


@query
def status_totals(s: Store) -> DataFrame:
    totals = orders.status_totals(orders.order_status(s.orders(), s.carried_variants()))
    return totals.withColumn("newest", _day("newest"))


def _urgent_ids(s: Store) -> DataFrame:
    """Lines of the orders marked urgent, those asked about."""
    urgent = s.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return s.orders().join(
        urgent.select(F.col("o_orderkey").alias("order_id")), "order_id", "left_semi"
    ).select("id")


@query
def orders_by_id(s: Store) -> DataFrame:
    view = orders.order_history_view(s.orders(), s.beans(), s.roasters())
    return orders.orders_by_id(view, _urgent_ids(s)).select(
        "id", "user_id", _day(), "price_paid", "parent_title", "roaster_display_name"
    )


@query
def missing_order_ids(s: Store) -> DataFrame:
    view = orders.order_history_view(s.orders(), s.beans(), s.roasters())
    return orders.missing_order_ids(view, _urgent_ids(s))


@query
def orders_by_id_status(s: Store) -> DataFrame:
    """The orders asked about and what has become of their variant. They are looked up before they
    are marked, so that only they are shuffled by variant."""
    asked = orders.orders_by_id(s.orders(), _urgent_ids(s))
    return orders.order_status(asked, s.carried_variants()).select("id", "price_paid", "product_status")


@query
def append_twice(s: Store) -> DataFrame:
    """All orders appended to a table that holds the past ones: each is there once."""
    month = F.trunc("order_date", "month").alias("order_month")
    batch = s.orders().select("id", "user_id", "price_paid", month)
    held = s.past_orders().select("id", "user_id", "price_paid", month)
    return held.unionByName(sinks.not_held(batch, held).select(*held.columns)).drop("order_month")


def _snapshot(s: Store) -> tuple[DataFrame, DataFrame]:
    """Every order line requested again; returned lines ask for a size that does not exist, lines
    of the supplier with key 0 for a product that does not."""
    lines = s.table("lineitem")
    product = F.when(F.col("l_suppkey") == 0, F.lit(-1)).otherwise(model.product_key())
    variant = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(model.variant_key())
    late = F.col("l_shipdate") >= "2000-01-01"
    requests = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .alias("request_id"),
        product.alias("product_id"),
        variant.alias("variant_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("price_paid"),
        F.when(late, F.col("l_shipdate").cast("timestamp")).alias("order_date"),
    )
    return orders.order_snapshot(
        requests, s.products(), s.variants(), s.roasters(), s.details(), model.LOAD_TS
    )


@query
def order_snapshot(s: Store) -> DataFrame:
    return _snapshot(s)[0].select(
        "request_id", "product_id", "variant_id", "quantity", "price_paid",
        F.col("order_date").cast("date").alias("order_date"), "roaster_name", "product_title",
        "product_url", "option1", "is_single_origin", "origin_country", "origin_region",
        "processing_method", "varietals",
    )


@query
def order_rejects(s: Store) -> DataFrame:
    return _snapshot(s)[1].select("request_id", "product_id", "variant_id", "reason")


# ---------------------------------------------------------------- spend


@query
def monthly_spend(s: Store) -> DataFrame:
    return spend.monthly_spend(s.sellable_lines())


@query
def monthly_spend_all(s: Store) -> DataFrame:
    """Also lines whose product is no longer sellable."""
    return spend.monthly_spend(spend.full_history(s.orders()))


@query
def spending_summary(s: Store) -> DataFrame:
    summary = spend.spending_summary(s.sellable_lines(), s.users(), model.AS_OF)
    return spend.with_budget(summary, model.MONTHLY_BUDGET).withColumn(
        "three_month_average", F.round("three_month_average", 4)
    )


@query
def recent_orders(s: Store) -> DataFrame:
    recent = spend.recent_orders(s.history())
    return recent.select(
        "user_id", "position", "id", _day(), "roaster_name", "parent_title", "price"
    )


@query
def spending_report(s: Store) -> DataFrame:
    history = s.history()
    summary = spend.spending_summary(history, s.users(), model.AS_OF)
    return spend.spending_report(summary, spend.recent_orders(history)).withColumn(
        "three_month_average", F.round("three_month_average", 4)
    )


@query
def feature_distribution(s: Store) -> DataFrame:
    return spend.feature_distribution(s.history()).withColumn("last_order", _day("last_order"))


@query
def top_features(s: Store) -> DataFrame:
    top = spend.top_features(spend.feature_distribution(s.history()))
    return top.withColumn("last_order", _day("last_order"))


@query
def ordered_products(s: Store) -> DataFrame:
    return s.sellable_lines().select("user_id", "product_id").distinct()


# ---------------------------------------------------------------- recommendation


def _with_notes(frame: DataFrame) -> DataFrame:
    return frame.withColumn("notes", enrich.notes_array(F.col("tasting_notes")))


def _recommendation(s: Store, beans: DataFrame, n_beans: int) -> DataFrame:
    """History is read by three aggregations and the catalog by two joins, so both are kept."""
    history = cut_lineage(
        _with_notes(s.history(join_side(beans, n_beans))).select(
            "user_id", "product_id", "order_date", "price", "notes", *recommend.FEATURES
        )
    )
    summary = spend.spending_summary(history, s.users(), model.AS_OF)
    budgets = spend.with_budget(summary, model.MONTHLY_BUDGET)
    options = _with_notes(s.single_origins(beans))
    return recommend.recommend_from_history(budgets, history, options)


def _kept_beans(s: Store) -> DataFrame:
    return cut_lineage(s.beans())


@query
def recommendation(s: Store) -> DataFrame:
    beans = _kept_beans(s)
    return _recommendation(s, beans, beans.count())


@query
def candidate_counts(s: Store) -> DataFrame:
    return recommend.candidate_counts(s.users(), s.past_orders(), s.single_origins())


@query
def recommended_orders(s: Store) -> DataFrame:
    """The offers picked, written back: text, its first line, the order it means, its snapshot."""
    beans = _kept_beans(s)
    n_beans = beans.count()
    options = s.single_origins(beans)
    shown = options.select("product_id", "variant_id", "parent_title", "roaster_name")
    picked = _recommendation(s, beans, n_beans).select("user_id", "product_id", "variant_id")
    texts = picked.join(join_side(shown, n_beans), ["product_id", "variant_id"]).select(
        F.col("user_id").alias("request_id"),
        F.concat(
            F.lit("["), F.col("product_id").cast("string"), F.lit(","),
            F.col("variant_id").cast("string"), F.lit("] "), "roaster_name", F.lit(" - "),
            "parent_title", F.lit("\n\nA change from recent purchases."),
        ).alias("text"),
    )
    placed, _ = orders.place_order_strings(
        texts, options, s.products(), s.variants(), s.roasters(), s.details(), model.LOAD_TS
    )
    return placed.select(
        F.col("request_id").alias("user_id"), "product_id", "variant_id", "product_title",
        "quantity", "price_paid", "matched_by", "roaster_name", "product_url", "option1",
        "origin_country", "processing_method",
    )


@query
def format_lines(s: Store) -> DataFrame:
    rows = catalog.option_rows(s.options(), s.roasters())
    notes = F.array_join(enrich.notes_array(F.col("tasting_notes")), ", ")
    return rows.select("product_id", "variant_id", recommend.format_line(notes).alias("line"))


@query
def display_labels(s: Store) -> DataFrame:
    """Labels of each catalog row: type, varietals and a title safe for a file name."""
    return s.beans().select(
        "product_id", "variant_id",
        t.type_label(F.col("is_single_origin")).alias("type_label"),
        t.varietals_text(t.csv_to_array(F.col("varietals"))).alias("varietals_text"),
        t.safe_title(F.concat(F.lit(" "), "parent_title", F.lit(" ("), "varietals", F.lit(")")))
        .alias("safe_title"),
        t.money_text(F.col("price")).alias("price_text"),
        F.col("is_single_origin").cast("int").alias("single_origin_flag"),
    )


# ---------------------------------------------------------------- resolving


def _order_strings(beans: DataFrame) -> DataFrame:
    """Four order strings per offer: ids, a title behind an unknown key, a title, malformed."""
    pid, vid = F.col("product_id").cast("string"), F.col("variant_id").cast("string")
    name = F.concat("roaster_name", F.lit(" - "), "parent_title")
    forms = F.array(
        F.concat(F.lit("["), pid, F.lit(", "), vid, F.lit(",7] "), name, F.lit("\nmore text")),
        F.concat(F.lit("[999,"), vid, F.lit("] "), name),
        F.col("parent_title"),
        F.concat(F.lit("[x,"), vid, F.lit("] "), "parent_title"),
    )
    return beans.select(
        F.posexplode(forms).alias("form", "text"), pid.alias("pid"), vid.alias("vid")
    ).select(
        F.concat_ws("/", "pid", "vid", F.col("form").cast("string")).alias("request_id"), "text"
    )


@query
def resolve_order_keys(s: Store) -> DataFrame:
    beans = _kept_beans(s)
    return resolve.resolve_order_strings(_order_strings(beans), s.options(beans))[0]


@query
def unresolved_order_keys(s: Store) -> DataFrame:
    beans = _kept_beans(s)
    return resolve.resolve_order_strings(_order_strings(beans), s.options(beans))[1]


@query
def order_string_rejects(s: Store) -> DataFrame:
    """Order strings that give no order: unreadable, unknown, or of a brand that has gone since."""
    beans = _kept_beans(s)
    left = s.products().filter(F.col("vendor") != "Brand#8")
    _, rejects = orders.place_order_strings(
        _order_strings(beans), s.options(beans), left, s.variants(), s.roasters(), s.details(),
        model.LOAD_TS,
    )
    return rejects


def _labelled_beans(s: Store) -> DataFrame:
    """The catalog by label; kept, because requests are made from it and looked up in it."""
    rows = s.beans().withColumn("label", F.concat_ws(" ", "parent_title", "roaster_name"))
    return cut_lineage(rows.select("product_id", "variant_id", "price", "roaster_name", "label"))


def _fragments(s: Store, beans: DataFrame) -> DataFrame:
    """What customers type: part names, full labels of everything on sale, words, and names
    turned round, which mean nothing."""
    part = s.table("part").select("p_name").distinct()
    words = F.split("p_name", " ")
    typed = F.array(F.upper("p_name"), F.concat_ws(" ", F.reverse(words)))
    names = part.select(F.explode(F.concat(words, typed)).alias("fragment"))
    labels = F.array(F.col("label"), F.replace("label", F.lit(" "), F.lit("%")))
    return names.union(beans.select(F.explode(labels))).distinct()


@query
def resolve_names(s: Store) -> DataFrame:
    beans = _labelled_beans(s)
    return resolve.resolve_names(_fragments(s, beans), beans, "label")


@query
def match_fragments(s: Store) -> DataFrame:
    """Catalog rows behind every part name typed in upper case."""
    names = s.table("part").select(F.upper("p_name").alias("fragment")).distinct()
    rows = _labelled_beans(s).select("product_id", "variant_id", "label")
    return resolve.match_fragments(names, rows, "label")


@query
def ambiguous_candidates(s: Store) -> DataFrame:
    """Catalog rows of every part name, typed in upper case, that means several."""
    names = s.table("part").select(F.upper("p_name").alias("fragment")).distinct()
    rows = _labelled_beans(s).select("product_id", "variant_id", "label")
    return resolve.ambiguous_candidates(names, rows, "label")


@query
def bulk_order_by_name(s: Store) -> DataFrame:
    beans = _labelled_beans(s)
    resolved = resolve.resolve_names(_fragments(s, beans), beans, "label")
    requests, _ = resolve.order_requests_by_name(resolved)
    dated = requests.withColumn("order_date", F.lit(model.LOAD_TS))
    placed, _ = orders.order_snapshot(
        dated, s.products(), s.variants(), s.roasters(), s.details(), model.LOAD_TS
    )
    return placed.select(
        "fragment", "product_id", "variant_id", "quantity", "price_paid",
        F.col("order_date").cast("date").alias("order_date"), "roaster_name", "product_title",
        "origin_country",
    )


@query
def names_not_found(s: Store) -> DataFrame:
    beans = _labelled_beans(s)
    resolved = resolve.resolve_names(_fragments(s, beans), beans, "label")
    return resolve.order_requests_by_name(resolved)[1]


# ---------------------------------------------------------------- ingest


def _product_records(s: Store) -> DataFrame:
    """Parts as landing records: nested lists arrive as JSON text."""
    words = F.split("p_name", " ")
    options = F.array(
        F.struct(F.lit("Size").alias("name"), F.array(F.col("p_size").cast("string"), "p_type")
                 .alias("values")),
        F.struct(F.lit(None).cast("string").alias("name"), words.alias("values")),
    )
    images = F.transform(
        words, lambda word: F.struct(F.concat(word, F.lit(".jpg")).alias("src"))
    )
    no_images = F.col("p_type") == "PROMO"
    return s.table("part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.lit(None).cast("string").alias("handle"),
        F.col("p_brand").alias("body_html"),
        F.lit("2001-02-03T04:05:06Z").alias("published_at"),
        F.col("p_brand").alias("created_at"),
        F.lit("2001-02-03").alias("updated_at"),
        F.nullif("p_brand", F.lit("Brand#13")).alias("vendor"),
        F.col("p_type").alias("product_type"),
        F.when(F.col("p_type") == "SMALL", F.concat_ws(";", words)).otherwise(F.to_json(words))
        .alias("tags"),
        F.concat(F.lit("https://parts/"), F.col("p_partkey").cast("string")).alias("url"),
        F.to_json(options).alias("options"),
        F.when(no_images, "none").otherwise(F.to_json(images)).alias("images"),
        F.lit(1).cast("bigint").alias("roaster_id"),
    )


@query
def product_rows(s: Store) -> DataFrame:
    rows = ingest.product_rows(_product_records(s), model.LOAD_TS)
    return rows.select(
        "source_id", "title", "handle", "body_html", "vendor", "product_type", "tags", "url",
        F.col("published_at").cast("date").alias("published_on"),
        F.col("created_at").cast("date").alias("created_on"),
        F.col("last_updated").cast("date").alias("loaded_on"),
    )


@query
def flatten_options(s: Store) -> DataFrame:
    return ingest.option_rows(_product_records(s)).drop("id", "position")


@query
def flatten_images(s: Store) -> DataFrame:
    return ingest.image_rows(_product_records(s)).drop("id")


@query
def first_images(s: Store) -> DataFrame:
    return enrich.first_images(ingest.image_rows(_product_records(s)))


@query
def flatten_tags(s: Store) -> DataFrame:
    """Tags of every listing as rows, from their comma text."""
    tags = F.posexplode(t.csv_to_array(F.col("tags"))).alias("position", "tag")
    return s.products().select(F.col("id").alias("product_id"), tags)


def _variant_records(s: Store) -> DataFrame:
    """Order lines as landing variants: numbers as text, some unreadable or missing."""
    missing = F.lit(None).cast("string")
    flag = F.col("l_returnflag")
    return s.table("lineitem").select(
        F.lit(1).cast("bigint").alias("roaster_id"),
        F.col("l_partkey").alias("parent_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("title"),
        F.when(flag == "R", "1").when(flag == "A", "yes").alias("available"),
        F.when(flag == "N", F.col("l_tax").cast("string")).alias("compare_at_price"),
        missing.alias("created_at"), missing.alias("featured_image"),
        F.col("l_quantity").cast("string").alias("grams"),
        F.col("l_linestatus").alias("option1"), missing.alias("option2"),
        F.nullif("l_returnflag", F.lit("N")).alias("option3"),
        F.col("l_linenumber").cast("string").alias("position"),
        F.when(flag != "A", F.format_string("%.2f", "l_extendedprice")).otherwise("n/a")
        .alias("price"),
        F.when(flag == "A", "false").alias("requires_shipping"),
        missing.alias("sku"), F.lit("").alias("taxable"), missing.alias("updated_at"),
        missing.alias("parent_title"), missing.alias("vendor"),
        F.col("l_discount").cast("string").alias("weight"), missing.alias("weight_unit"),
        missing.alias("barcode"), missing.alias("inventory_quantity"),
    )


@query
def variant_coercion(s: Store) -> DataFrame:
    products = ingest.product_rows(_product_records(s), model.LOAD_TS)
    rows = ingest.variant_rows(_variant_records(s), products, model.LOAD_TS)
    return rows.select(
        F.col("product_id").alias("source_id"), "title", "available", "compare_at_price", "grams",
        "option1", "option2", "option3", "position", "price", "requires_shipping", "taxable", "weight",
        "inventory_quantity",
    )


@query
def load_counts(s: Store) -> DataFrame:
    variants = s.variants().select("product_id")
    return ingest.load_counts(s.products(), variants)


@query
def display_names(s: Store) -> DataFrame:
    """Display names of suppliers; those in Asia are registered, the others get title case."""
    registry = s.roasters().filter(F.col("origin_region") == "ASIA").select(
        "name", F.concat(F.lit("House "), "name").alias("description")
    )
    sources = s.roasters().select(F.concat(F.lit("o'"), F.replace("name", F.lit("#"), F.lit("_")))
                                  .alias("name"))
    both = sources.union(s.roasters().select("name"))
    return ingest.display_names(both, registry)


@query
def upsert_roasters(s: Store) -> DataFrame:
    """Suppliers upserted with renamed African ones and one new seller per nation."""
    base = s.roasters().select("id", "name", "description", "url")
    renamed = s.roasters().filter(F.col("origin_region") == "AFRICA").select(
        F.lit(-1).cast("bigint").alias("id"), F.lit("ignored").alias("name"),
        F.concat_ws(" ", "name", "origin_country").alias("description"), "url",
    )
    added = s.table("nation").select(
        (F.col("n_nationkey") + 1000000000).cast("bigint").alias("id"),
        F.lower("n_name").alias("name"), t.title_case(F.col("n_name")).alias("description"),
        F.concat(F.lit("https://nation/"), F.lower("n_name")).alias("url"),
    )
    return sinks.upsert_roasters(base, renamed.union(added))


@query
def upsert_with_audit(s: Store) -> DataFrame:
    """When each seller was created and updated, after African ones were renamed and new ones came."""
    first = F.lit("1995-01-01").cast("timestamp")
    base = s.roasters().select("id", "name", "description", "url")
    renamed = s.roasters().filter(F.col("origin_region") == "AFRICA").select(
        "id", "name", F.concat_ws(" ", "name", "origin_country").alias("description"), "url"
    )
    added = s.table("nation").select(
        (F.col("n_nationkey") + 1000000000).cast("bigint").alias("id"),
        F.col("n_name").alias("name"), F.col("n_name").alias("description"),
        F.concat(F.lit("https://nation/"), F.lower("n_name")).alias("url"),
    )
    old = base.withColumns({"created_at": first, "updated_at": first})
    merged = sinks.upsert_roasters(base, renamed.union(added))
    return sinks.with_audit(merged, old, "id", model.LOAD_TS).select(
        "id", "description", F.col("created_at").cast("date").alias("created_on"),
        F.col("updated_at").cast("date").alias("updated_on"),
    )


@query
def load_rejects(s: Store) -> DataFrame:
    """Order lines as landing variants; sellers in Africa are not registered, one brand not loaded."""
    landed = s.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias("source"), F.col("l_partkey").alias("parent_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("title"),
    )
    keys = s.roasters().filter(F.col("origin_region") != "AFRICA").select(
        F.col("id").cast("string").alias("source"), F.col("id").alias("roaster_id")
    )
    loaded = s.listings().filter(F.col("p_brand") != "Brand#13").select(
        F.col("l_suppkey").alias("roaster_id"), F.col("l_partkey").alias("source_id")
    )
    return ingest.load_rejects(landed, keys, "variants", loaded).select(
        "source", "kind", "reason", F.get_json_object("record", "$.title").alias("title")
    )


def _repeated_products(s: Store) -> tuple[DataFrame, DataFrame]:
    """Order lines as landing products: some without an id of their seller, some without a link."""
    own_id = F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))
    records = s.table("lineitem").select(
        own_id.alias("id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("title"),
        F.when(F.col("l_linestatus") != "O", model.product_url()).alias("url"),
        F.col("l_shipdate").cast("date").cast("string").alias("updated_at"),
        F.col("l_suppkey").alias("roaster_id"), F.col("l_suppkey").cast("string").alias("source"),
    )
    return ingest.one_per_key(ingest.with_source_key(records), "roaster_id", "source_key")


@query
def load_products(s: Store) -> DataFrame:
    """The record that is loaded for each product."""
    kept, _ = _repeated_products(s)
    return kept.select("roaster_id", F.col("id").alias("own_id"), "url", "title", "updated_at")


@query
def load_lost(s: Store) -> DataFrame:
    """Records that are not loaded, because another of their product is newer or equal."""
    _, others = _repeated_products(s)
    return others.select("source", F.get_json_object("record", "$.title").alias("title"), "n")


@query
def schema_union(s: Store) -> DataFrame:
    left = s.table("supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    right = s.table("customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return sinks.union_schemas(left, right)


@query
def cascade_orphans(s: Store) -> DataFrame:
    """Variants left after all products of the excluded brand were deleted."""
    deleted = s.products().filter(F.col("vendor") == model.RULES.excluded_vendor).select(
        F.col("id").alias("product_id")
    )
    return sinks.without_children_of(s.variants(), deleted, "product_id").select(
        F.col("id").alias("variant_id"), "product_id", "price"
    )


@query
def load_report(s: Store) -> DataFrame:
    """Event records per source; a payload without a whole number below 100 in ``k`` is bad."""
    payload = F.from_json(
        "props", "k INT, _corrupt_record STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    # Clicks are cut off after the colon, as if their source had failed half way.
    cut = F.when(F.col("event_type") == "click", F.substring_index("props", ":", 1)).otherwise(
        F.col("props")
    )
    landed = (
        s.table("events")
        .withColumn("props", cut)
        .select(F.col("event_type").alias("source"), payload.alias("p"))
        .select("source", "p._corrupt_record")
    )
    return landing.load_report(landed)


@query
def constraint_report(s: Store) -> DataFrame:
    lines, heads = s.table("lineitem"), s.table("orders")
    reports = [
        ingest.null_violations(lines, ["l_quantity", "l_extendedprice"], "lineitem"),
        ingest.null_violations(s.table("part"), ["p_name"], "part"),
        ingest.null_violations(s.table("supplier"), ["s_name"], "supplier"),
        ingest.duplicate_violations(lines, ["l_orderkey", "l_linenumber"], "lineitem"),
        ingest.duplicate_violations(s.details(), ["product_id"], "details"),
        ingest.orphan_violations(lines, "l_orderkey", heads, "o_orderkey", "lineitem"),
        ingest.orphan_violations(lines, "l_partkey", s.table("part"), "p_partkey", "lineitem"),
        ingest.orphan_violations(heads, "o_custkey", s.table("customer"), "c_custkey", "orders"),
        ingest.orphan_violations(
            s.table("events"), "user_id", s.table("supplier"), "s_suppkey", "events"
        ),
    ]
    every = reports[0]
    for report in reports[1:]:
        every = every.unionByName(report)
    return every


@query
def order_dates(s: Store) -> DataFrame:
    """Order dates read back from the formats sources write, one per priority."""
    kind = F.substring("o_orderpriority", 1, 1)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = (
        F.when(kind == "1", day)
        .when(kind == "2", F.concat(day, F.lit(" 10:20:30.123456")))
        .when(kind == "3", F.concat(day, F.lit(" 10:20:30")))
        .when(kind == "4", F.replace(day, F.lit("-"), F.lit("/")))
    )
    read = t.parse_day(F.col("written"))
    return s.table("orders").select("o_orderkey", written.alias("written")).select(
        F.col("o_orderkey").alias("order_id"),
        read.cast("date").alias("order_date"),
        F.date_format(read, "HH:mm:ss").alias("order_time"),
        (F.col("written").isNotNull() & read.isNull()).alias("rejected"),
    )


# ---------------------------------------------------------------- enrichment


def _enriched(s: Store) -> DataFrame:
    """Details stored so far: everything but promotional listings has been read."""
    return s.details().filter(F.col("processing_method") != "PROMO")


@query
def to_enrich(s: Store) -> DataFrame:
    return enrich.to_enrich(s.beans(), s.products(), _enriched(s)).orderBy(
        "parent_title", "product_id"
    )


def _flat_details(details: DataFrame) -> DataFrame:
    return details.select(
        "product_id", "is_single_origin", "origin_country", "origin_region",
        "processing_method", "varietals", "resting_period_days",
    )


@query
def replace_details(s: Store) -> DataFrame:
    """Details of medium listings replaced and those of promotional ones added."""
    everything = _flat_details(s.details())
    fresh = everything.filter(F.col("processing_method").isin("MEDIUM", "PROMO")).withColumn(
        "processing_method", F.lit("Honey")
    )
    return sinks.replace_by_key(_flat_details(_enriched(s)), fresh, "product_id")


def _listing_texts(s: Store) -> DataFrame:
    """Everything said about a listing, with labelled lines for altitude, farm and producer."""
    listings = s.listings().join(s.roasters(), F.col("l_suppkey") == F.col("id"))
    metres = F.col("p_size") * 50
    heights = (
        F.when(F.col("p_type") == "LARGE", F.format_string("%d masl", metres))
        .when(F.col("p_type") == "SMALL", F.format_string("%d - %d ft", metres, metres + 900))
        .when(F.col("p_type") == "MEDIUM", F.format_string("%d-%dm", metres, metres + 200))
        .otherwise("unknown")
    )
    farm = F.when(F.col("p_brand") == "Brand#7", F.concat(F.lit("\nFarm: "), "p_name"))
    producer = F.when(F.col("p_brand") == "Brand#8", F.concat(F.lit("\nProducer: "), "name")).when(
        F.col("p_brand") == "Brand#9", F.concat(F.lit("\nProducer: Coop "), "origin_country")
    )
    return listings.select(
        model.product_key().alias("product_id"),
        F.col("name").alias("roaster_name"),
        F.concat(
            F.concat_ws(" ", "p_name", "p_type", "origin_country"),
            F.lit("\nGrown at "), heights,
            F.coalesce(farm, F.lit("")), F.coalesce(producer, F.lit("")),
        ).alias("text"),
    )


def _attributes(s: Store) -> DataFrame:
    return enrich.extract_attributes(
        _listing_texts(s), model.DICTIONARY, roaster_name="roaster_name"
    )


@query
def place_attributes(s: Store) -> DataFrame:
    """Where each listing comes from, by a dictionary of areas, regions and countries; parts of even
    sizes name the seller's country too."""
    nation = F.lower(F.replace("origin_country", F.lit("_"), F.lit(" ")))
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, nation))
    listings = s.listings().join(s.roasters(), F.col("l_suppkey") == F.col("id"))
    rows = listings.select(model.product_key().alias("product_id"), text.alias("text"))
    return enrich.extract_attributes(rows, model.PLACES).select(
        "product_id", "is_single_origin", F.col("origin.country").alias("origin_country"),
        F.col("origin.region").alias("origin_region"),
    )


@query
def extract_attributes(s: Store) -> DataFrame:
    return _attributes(s).select(
        "product_id", "is_single_origin",
        F.col("origin.country").alias("origin_country"), "roast_level", "processing_method",
        F.array_join("varietals", ",").alias("varietals"), "altitude", "farm", "producer",
        enrich.notes_text(F.col("tasting_notes")).alias("notes"),
        "resting_period_days", "confidence_score",
    )


@query
def altitude_normalise(s: Store) -> DataFrame:
    return _listing_texts(s).select(
        "product_id", enrich.altitude(F.col("text")).alias("altitude")
    )


@query
def grower_labels(s: Store) -> DataFrame:
    text = F.col("text")
    return _listing_texts(s).select(
        "product_id",
        enrich.labelled(text, "farm").alias("farm"),
        enrich.grower(text).alias("named_producer"),
        enrich.grower(text, F.col("roaster_name")).alias("producer"),
    )


@query
def resting_period(s: Store) -> DataFrame:
    """Range and recommended days of rest by method, roast, varietal and altitude of each part."""
    method = F.when(F.col("p_type") == "LARGE", "Natural; Anaerobic").when(
        F.col("p_type").isin("ECONOMY", "STANDARD"), "Washed"
    ).when(F.col("p_type") == "MEDIUM", "Honey")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    roast = F.when(first == "hot", "Dark").when(first == "old", "Espresso").when(
        first == "cold", "Light"
    ).when(first == "new", "Filter").otherwise("Medium")
    varietals = F.when(second == "anvil", F.array(F.lit("Bourbon"), F.lit("SL28"))).when(
        second == "gear", F.array(F.lit("Batian"))
    ).otherwise(F.array().cast("array<string>"))
    low, high = enrich.resting_range(method, roast, varietals, F.col("p_size") * 50)
    return s.table("part").select(
        F.col("p_partkey").alias("product_id"), low.alias("low_days"), high.alias("high_days"),
        enrich.resting_days(low, high).alias("days"),
    )


DOCUMENT_TERMS = [
    Term("country", "the", "English"), Term("country", "und", "German"),
    Term("country", "der", "German"), Term("country", "les", "French"),
    Term("country", "des", "French"), Term("country", "el", "Spanish"),
    Term("process", "of the", "Washed", "primary"), Term("process", "de la", "Natural", "primary"),
    Term("process", "and the", "Anaerobic", "secondary"),
    Term("process", "in the", "Thermal Shock", "other"),
    Term("fruits", "is", "Apple"), Term("sweets", "a", "Toffee"), Term("florals", "en", "Rose"),
    Term("spices", "on", "Clove"), Term("others", "it was", "Almond"),
    Term("varietal", "with", "Typica"), Term("roast", "by", "Light"),
]


@query
def document_attributes(s: Store) -> DataFrame:
    """Dictionary attributes of every document, whole texts, words and pairs of words."""
    read = enrich.extract_attributes(s.table("documents").select("doc_id", "text"), DOCUMENT_TERMS)
    return read.select(
        "doc_id", "is_single_origin", F.col("origin.country").alias("origin_country"),
        "processing_method", F.array_join("varietals", ",").alias("varietals"), "roast_level",
        enrich.notes_text(F.col("tasting_notes")).alias("notes"),
    )


@query
def re_enrich(s: Store) -> DataFrame:
    """Listings of three brands read again and their stored details replaced."""
    chosen = s.listings().filter(F.col("p_brand").isin("Brand#7", "Brand#8", "Brand#9"))
    ids = chosen.select(model.product_key().alias("product_id"))
    stored = enrich.detail_rows(
        _attributes(s).withColumn("confidence_score", F.lit(0.5)), model.LOAD_TS
    ).withColumn("roast_level", F.lit("stored"))
    replaced, _ = enrich.re_enrich(
        ids, _listing_texts(s), stored, model.LOAD_TS, model.DICTIONARY,
        roaster_name="roaster_name",
    )
    return replaced.select(
        "product_id", "roast_level", "processing_method", "producer", "extraction_confidence"
    )


@query
def re_enrich_unknown(s: Store) -> DataFrame:
    """Ids asked for that no listing has, among all listings and as many numbers below zero."""
    known = s.listings().select(model.product_key().alias("product_id"))
    ids = known.unionByName(known.select((-1 - F.col("product_id")).alias("product_id")))
    stored = enrich.detail_rows(_attributes(s), model.LOAD_TS)
    return enrich.re_enrich(
        ids, _listing_texts(s), stored, model.LOAD_TS, model.DICTIONARY, roaster_name="roaster_name"
    )[1]


@query
def parse_event_props(s: Store) -> DataFrame:
    """Event payloads as attribute records: read, filled with defaults, and how it went."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    payload = (
        F.when(kind == "view", F.concat(F.lit('{"roast_level":"r'), k, F.lit('","origin":null}')))
        .when(
            kind == "click",
            F.concat(F.lit('{"farm":["x","f'), k, F.lit('"],"confidence_score":0.25}')),
        )
        .when(
            kind == "purchase",
            F.concat(F.lit('{"origin":{"country":"c'), k, F.lit('"},"varietals":"A, B"}')),
        )
        .when(kind == "signup", F.concat(F.lit('{"k":'), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"k":'), k))
    )
    rows = s.table("events").select("event_id", payload.alias("payload"))
    return enrich.parse_payload(rows).select(
        "event_id", "status", "origin_country", "roast_level", "varietals", "farm",
        "extraction_confidence",
    )


@query
def payload_notes(s: Store) -> DataFrame:
    """Tasting notes of event payloads, one row each; views name two fruits, clicks a spice."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    payload = (
        F.when(
            kind == "view",
            F.concat(F.lit('{"tasting_notes":{"fruits":["f'), k, F.lit('","Plum"],"sweets":[]}}')),
        )
        .when(
            kind == "click",
            F.concat(F.lit('{"tasting_notes":{"spices":["s'), k, F.lit('"],"fruits":null}}')),
        )
        .otherwise(F.lit('{"tasting_notes":null}'))
    )
    rows = s.table("events").select("event_id", payload.alias("payload"))
    return enrich.notes_long(enrich.parse_payload(rows), "event_id")


@query
def event_props(s: Store) -> DataFrame:
    """The payload's own field, null-safe and typed, per event."""
    props = F.from_json("props", "k INT")
    return s.table("events").select(
        "event_id", F.coalesce(props["k"], F.lit(0)).alias("k")
    )


@query
def notes_long(s: Store) -> DataFrame:
    return enrich.notes_long(s.beans().select("product_id", "tasting_notes"))


@query
def page_region_text(s: Store) -> DataFrame:
    return s.table("pages").select(
        "page_id", region_text(F.col("html"), "ad").alias("region_text"),
    )


@query
def pages_without_region(s: Store) -> DataFrame:
    """Pages with and without a description block; a page without one gives an empty text, there is
    no fallback. The blocks of pages below ``.org`` are taken as descriptions."""
    described = F.replace("html", F.lit('class="ad"'), F.lit('class="Product-DESCription"'))
    html = F.when(F.col("url").contains(".org/"), described).otherwise(F.col("html"))
    return s.table("pages").select("page_id", region_text(html).alias("region_text"))


@query
def assemble_documents(s: Store) -> DataFrame:
    """Every document with the page of the same number as its web page."""
    pages = s.table("pages").select(F.col("page_id").cast("string").alias("url"), "page_id", "html")
    documents = s.table("documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.lit("").alias("parent_title"),
        F.col("text").alias("body_html"),
        F.when(F.col("lang") != "de", F.concat_ws(",", "lang", "source")).alias("tags"),
        F.col("doc_id").cast("string").alias("url"),
    )
    return enrich.assemble_documents(documents, pages, "ad")


@query
def product_by_url(s: Store) -> DataFrame:
    """Listings looked up by the link of their part: the first of all suppliers' listings."""
    listings = s.listings().select(
        model.product_key().alias("id"),
        F.concat(F.lit("/part/"), F.col("l_partkey").cast("string")).alias("url"),
    )
    urls = s.table("part").select(
        F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("url")
    )
    return enrich.product_by_url(urls, listings)
