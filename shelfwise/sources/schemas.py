"""Column types of the base tables, the landing records and the attribute payload."""

from __future__ import annotations

# Landing records. Fields that may hold a list or plain text are read as text and parsed on ingest;
# scalars of a variant arrive as text and are coerced there too.
PRODUCT_RAW = """
    id BIGINT, title STRING, handle STRING, body_html STRING,
    published_at STRING, created_at STRING, updated_at STRING,
    vendor STRING, product_type STRING, tags STRING, url STRING, options STRING, images STRING
"""
OPTION_LIST = "ARRAY<STRUCT<name: STRING, values: STRING>>"
IMAGE_LIST = "ARRAY<STRUCT<src: STRING>>"

VARIANT_TEXT_COLUMNS = (
    "title", "available", "compare_at_price", "created_at", "featured_image", "grams",
    "option1", "option2", "option3", "position", "price", "requires_shipping", "sku", "taxable",
    "updated_at", "parent_title", "vendor", "weight", "weight_unit", "barcode",
    "inventory_quantity",
)
VARIANT_RAW = "parent_id BIGINT, " + ", ".join(f"{name} STRING" for name in VARIANT_TEXT_COLUMNS)

REGISTRY = "key STRING, name STRING, description STRING, url STRING"

NOTES = (
    "STRUCT<fruits: ARRAY<STRING>, sweets: ARRAY<STRING>, florals: ARRAY<STRING>, "
    "spices: ARRAY<STRING>, others: ARRAY<STRING>>"
)
# The five note categories, in display order.
NOTE_CATEGORIES = ("fruits", "sweets", "florals", "spices", "others")

PAYLOAD = f"""
    is_single_origin BOOLEAN, origin STRUCT<country: STRING, region: STRING>, roast_level STRING,
    processing_method STRING, varietals STRING, altitude STRING, farm STRING, producer STRING,
    tasting_notes {NOTES}, resting_period_days INT, confidence_score DOUBLE
"""

TABLES = {
    "roasters": """
        id BIGINT, name STRING, description STRING, url STRING,
        created_at TIMESTAMP, updated_at TIMESTAMP
    """,
    "products": """
        id BIGINT, roaster_id BIGINT, title STRING, handle STRING, body_html STRING,
        published_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP, vendor STRING,
        product_type STRING, tags STRING, url STRING, parent_title STRING, last_updated TIMESTAMP,
        source_key STRING
    """,
    "product_options": """
        id BIGINT, product_id BIGINT, name STRING, position INT, values STRING,
        created_at TIMESTAMP, updated_at TIMESTAMP
    """,
    "variants": """
        id BIGINT, product_id BIGINT, title STRING, available INT, compare_at_price DOUBLE,
        featured_image STRING, grams INT, option1 STRING, option2 STRING, option3 STRING,
        position INT, price DOUBLE, requires_shipping INT, sku STRING, taxable INT,
        parent_title STRING, vendor STRING, weight DOUBLE, weight_unit STRING, barcode STRING,
        inventory_quantity INT, created_at TIMESTAMP, updated_at TIMESTAMP, last_updated TIMESTAMP
    """,
    "product_images": """
        id BIGINT, product_id BIGINT, position INT, src STRING, width INT, height INT, alt STRING,
        created_at TIMESTAMP, updated_at TIMESTAMP
    """,
    "product_extended_details": f"""
        product_id BIGINT, is_single_origin BOOLEAN, origin_country STRING, origin_region STRING,
        roast_level STRING, processing_method STRING, varietals STRING, altitude STRING,
        farm STRING, producer STRING, tasting_notes {NOTES}, resting_period_days INT,
        extraction_confidence DOUBLE, last_updated TIMESTAMP
    """,
    "order_history": f"""
        id BIGINT, user_id BIGINT, product_id BIGINT, variant_id BIGINT, order_date TIMESTAMP,
        quantity INT, price_paid DOUBLE, notes STRING, roaster_name STRING, product_title STRING,
        product_url STRING, option1 STRING, option2 STRING, option3 STRING,
        is_single_origin BOOLEAN, origin_country STRING, origin_region STRING, roast_level STRING,
        processing_method STRING, varietals STRING, altitude STRING, farm STRING, producer STRING,
        tasting_notes {NOTES}, created_at TIMESTAMP, updated_at TIMESTAMP, request_id STRING
    """,
    # The last id each table has given out: ids of rows that are gone are not given again.
    "id_marks": "name STRING, last_id BIGINT",
}

# Attributes of a product that are frozen into an order.
SNAPSHOT_ATTRIBUTES = (
    "is_single_origin", "origin_country", "origin_region", "roast_level", "processing_method",
    "varietals", "altitude", "farm", "producer", "tasting_notes",
)
