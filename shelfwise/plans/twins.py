"""The registered queries once more, as SQL for DuckDB; written apart from the Spark code."""

from __future__ import annotations

from datetime import date, datetime

AS_OF = date(2001, 7, 15)
LOAD_TS = datetime(2001, 7, 15)
MONTHLY_BUDGET = 200000.0

BASE = f"""
roasters AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS origin_country, r_name AS origin_region,
         'https://' || lower(s_name) AS url
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
listings AS (
  SELECT DISTINCT l_partkey * 200000000 + l_suppkey AS product_id, l_partkey, l_suppkey FROM lineitem
),
products AS (
  SELECT product_id, l_suppkey AS roaster_id, p.*,
         'https://' || l_suppkey || '/' || l_partkey AS url,
         p_type || ' ' || p_brand AS body_html, replace(p_name, ' ', ',') AS tags
  FROM listings JOIN part p ON l_partkey = p_partkey
),
sizes AS (
  SELECT l_partkey, l_suppkey, l_linenumber, l_extendedprice AS price,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS open, l_returnflag <> 'R' AS kept
  FROM lineitem
  UNION ALL SELECT l_partkey, l_suppkey, l_linenumber % 7 + 1, NULL, NULL, NULL FROM lineitem
),
variants AS (
  SELECT (l_partkey * 200000000 + l_suppkey) * 10 + l_linenumber AS variant_id,
         l_partkey * 200000000 + l_suppkey AS product_id, l_suppkey, l_linenumber * 50 AS grams,
         coalesce(min(price), any_value(p_retailprice) * l_linenumber) AS price,
         coalesce(max(open), 1) AS available, max(kept) AS kept
  FROM sizes JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey, l_linenumber
),
details AS (
  SELECT product_id, CASE p_size % 3 WHEN 1 THEN true WHEN 0 THEN false END AS is_single_origin,
         origin_country, origin_region, p_type AS processing_method, p_brand AS varietals,
         split_part(p_name, ' ', 1) AS fruit, split_part(p_name, ' ', 2) AS sweet,
         p_size AS resting_period_days
  FROM products JOIN roasters r ON roaster_id = r.id
),
ranked AS (
  SELECT v.product_id, v.variant_id, p_name AS parent_title, r.name AS roaster_name, v.price,
         p_type AS option1, p.url AS product_url, r.id AS roaster_id,
         CASE WHEN p_name ILIKE '%ring%' THEN 'Blend'
              WHEN d.is_single_origin THEN 'Single Origin'
              WHEN NOT d.is_single_origin THEN 'Blend'
              WHEN p_name ILIKE '%plate%' THEN 'Blend'
              ELSE 'Unknown' END AS coffee_type,
         d.origin_country, d.origin_region, d.processing_method, d.is_single_origin, d.varietals,
         d.fruit, d.sweet, d.resting_period_days,
         2 * d.resting_period_days AS adjusted_resting_period_days,
         row_number() OVER (PARTITION BY p_name, r.name
                            ORDER BY v.grams NULLS FIRST, v.variant_id) AS rank
  FROM variants v JOIN products p USING (product_id) JOIN roasters r ON r.id = p.roaster_id
  LEFT JOIN details d USING (product_id)
  WHERE p_type ILIKE '%m%' AND p_name NOT ILIKE '%rod%' AND p_brand <> 'Brand#13' AND available = 1
),
beans AS (SELECT * FROM ranked WHERE rank = 1),
lines AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
         l_orderkey AS order_id, o_custkey AS user_id,
         l_partkey * 200000000 + l_suppkey AS product_id,
         (l_partkey * 200000000 + l_suppkey) * 10 + l_linenumber AS variant_id,
         CAST(o_orderdate AS DATE) AS order_date, CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice AS price_paid, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
options AS (
  SELECT * FROM beans b
  WHERE coffee_type = 'Single Origin' AND NOT EXISTS (
    SELECT 1 FROM lines l WHERE l.product_id = b.product_id AND l.variant_id = b.variant_id)
),
history AS (
  SELECT l.id, l.user_id, l.product_id, l.variant_id, l.order_date, l.price_paid AS price,
         b.roaster_name, b.parent_title, b.origin_country, b.processing_method,
         array_to_string(list_sort([b.fruit, b.sweet]), ', ') AS notes_key
  FROM lines l JOIN beans b USING (product_id) WHERE l.order_date <= DATE '{AS_OF}'
),
summary AS (
  SELECT c_custkey AS user_id,
    coalesce(sum(CAST(price AS DECIMAL(18,2))) FILTER (date_trunc('month', order_date)
      = DATE '2001-07-01'), 0)::DOUBLE AS current_month,
    coalesce(sum(CAST(price AS DECIMAL(18,2))) FILTER (date_trunc('month', order_date)
      = DATE '2001-06-01'), 0)::DOUBLE AS last_month,
    round(coalesce(sum(CAST(price AS DECIMAL(18,2))) FILTER (date_trunc('month', order_date)
      BETWEEN DATE '2001-04-01' AND DATE '2001-06-01'), 0)::DOUBLE / 3, 4) AS three_month_average
  FROM customer LEFT JOIN history ON user_id = c_custkey GROUP BY c_custkey
),
budgets AS (
  SELECT *, round({MONTHLY_BUDGET} - current_month, 2) AS remaining,
         round({MONTHLY_BUDGET} * 1.2, 2)::DOUBLE AS ceiling FROM summary
)
"""


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([BASE, *more]) + "\n" + body


TWINS: dict[str, str] = {}

# ---------------------------------------------------------------- catalog

TWINS["whole_beans"] = _with("""
SELECT product_id, variant_id, parent_title, roaster_name, price, option1, product_url,
       coffee_type, origin_country, origin_region, processing_method, is_single_origin,
       resting_period_days, adjusted_resting_period_days, CAST(rank AS INTEGER) AS rank
FROM beans""")

TWINS["available_options"] = _with("""
SELECT product_id, variant_id, parent_title, roaster_name, price, origin_country,
       processing_method, product_url FROM options""")

TWINS["candidate_options"] = _with("""
SELECT product_id, variant_id, parent_title, roaster_name, price FROM beans
WHERE coffee_type = 'Single Origin' AND product_id NOT IN (
  SELECT product_id FROM lines JOIN customer ON user_id = c_custkey WHERE c_nationkey = 7)""")

TWINS["recommendation_options"] = _with("""
SELECT product_id, variant_id, parent_title, roaster_name, processing_method, origin_country,
       'Fruits: ' || fruit || chr(10) || 'Sweets: ' || sweet AS tasting_notes, price,
       product_url AS url FROM options""")

TWINS["catalog_count"] = _with("""
SELECT coffee_type, count(*) AS n FROM beans GROUP BY 1 UNION ALL SELECT 'All', count(*) FROM beans
""")

TWINS["view_counts"] = _with("""
SELECT n_name AS origin_country, count(*) AS n_products, min(price) AS cheapest
FROM beans JOIN supplier ON roaster_name = s_name JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1""")

TWINS["options_by_roaster"] = _with("""
SELECT roaster_name, product_id, variant_id, count(*) OVER (PARTITION BY roaster_name) AS n_options,
       row_number() OVER (PARTITION BY roaster_name
                          ORDER BY parent_title, product_id, variant_id) = 1 AS starts_group,
       '  - ' || parent_title || coalesce(' (' || nullif(origin_country, '') || ')', '')
       || ' $' || printf('%.2f', price) AS line
FROM options""")

TWINS["roaster_summary"] = _with("""
SELECT roaster_name, count(*) AS n_options, min(price) AS min_price, max(price) AS max_price
FROM options GROUP BY 1""")

# ---------------------------------------------------------------- orders

TWINS["order_history_view"] = _with("""
SELECT l.id, l.user_id, l.product_id, l.variant_id, l.order_date, l.quantity, l.price_paid,
       r.name AS roaster_display_name, b.parent_title,
       b.processing_method AS current_processing_method, b.origin_country AS current_origin_country,
       b.origin_region AS current_origin_region
FROM lines l JOIN beans b USING (product_id) JOIN roasters r ON r.name = b.roaster_name""")

_STATUS = """
marked AS (
  SELECT l.*, CASE WHEN v.variant_id IS NULL THEN 'Discontinued' WHEN v.available = 0
              THEN 'Out of Stock' ELSE 'Available' END AS product_status
  FROM lines l LEFT JOIN (
    SELECT * FROM variants WHERE kept) v USING (variant_id)
)"""
TWINS["order_status"] = _with(
    "SELECT id, user_id, order_date, price_paid, product_status FROM marked", _STATUS
)
TWINS["orders_still_carried"] = _with(
    "SELECT id, product_status FROM marked WHERE product_status <> 'Discontinued'", _STATUS
)
TWINS["orders_by_status"] = _with(
    "SELECT lower(replace(product_status, ' ', '_')) AS bucket, id, order_date, price_paid"
    " FROM marked", _STATUS
)
TWINS["status_totals"] = _with("""
SELECT product_status, count(*) AS n_orders, sum(CAST(price_paid AS DECIMAL(18,2)))::DOUBLE
       AS total_paid, max(order_date) AS newest FROM marked GROUP BY 1""", _STATUS)

TWINS["orders_by_id"] = _with("""
SELECT l.id, user_id, order_date, price_paid, parent_title, roaster_name AS roaster_display_name
FROM lines l JOIN beans USING (product_id) WHERE o_orderpriority = '1-URGENT'""")

TWINS["missing_order_ids"] = _with("""
SELECT DISTINCT id FROM lines WHERE o_orderpriority = '1-URGENT'
  AND product_id NOT IN (SELECT product_id FROM beans)""")

_REQUESTS = f"""
requests AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
         CASE WHEN l_suppkey = 0 THEN -1 ELSE l_partkey * 200000000 + l_suppkey END AS product_id,
         CASE WHEN l_returnflag = 'R' THEN -1
              ELSE (l_partkey * 200000000 + l_suppkey) * 10 + l_linenumber END AS variant_id,
         CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS price_paid,
         CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN CAST(l_shipdate AS DATE)
              ELSE DATE '{LOAD_TS:%Y-%m-%d}' END AS order_date
  FROM lineitem
)"""
TWINS["order_snapshot"] = _with("""
SELECT q.request_id, q.product_id, q.variant_id, q.quantity, q.price_paid, q.order_date,
       r.name AS roaster_name, p_name AS product_title, p.url AS product_url, p_type AS option1,
       d.is_single_origin, d.origin_country, d.origin_region, d.processing_method, d.varietals
FROM requests q JOIN products p USING (product_id) JOIN variants v USING (variant_id)
JOIN roasters r ON r.id = p.roaster_id LEFT JOIN details d ON d.product_id = q.product_id
""", _REQUESTS)
TWINS["order_rejects"] = _with("""
SELECT request_id, product_id, variant_id,
       CASE WHEN product_id = -1 THEN 'product not found' ELSE 'variant not found' END AS reason
FROM requests WHERE product_id = -1 OR variant_id = -1""", _REQUESTS)

# ---------------------------------------------------------------- spend

TWINS["monthly_spend"] = _with("""
SELECT user_id, CAST(date_trunc('month', order_date) AS DATE) AS month,
       sum(CAST(price AS DECIMAL(18,2)))::DOUBLE AS spend FROM history GROUP BY 1, 2""")

TWINS["monthly_spend_all"] = _with("""
SELECT user_id, CAST(date_trunc('month', order_date) AS DATE) AS month,
       sum(CAST(price_paid AS DECIMAL(18,2)))::DOUBLE AS spend FROM lines GROUP BY 1, 2""")

TWINS["spending_summary"] = _with("SELECT * FROM budgets")

_RECENT = """
recent AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_date DESC, id) AS position
  FROM history QUALIFY position <= 5
)"""
TWINS["recent_orders"] = _with("""
SELECT user_id, CAST(position AS INTEGER) AS position, id, order_date, roaster_name, parent_title,
       price FROM recent""", _RECENT)
TWINS["spending_report"] = _with("""
SELECT s.*, coalesce(r.recent_orders, '') AS recent_orders FROM summary s LEFT JOIN (
  SELECT user_id, string_agg(strftime(order_date, '%Y-%m-%d') || ': ' || roaster_name || ' - '
         || parent_title || ' ($' || printf('%.2f', price) || ')', chr(10) ORDER BY position)
         AS recent_orders
  FROM recent GROUP BY 1) r USING (user_id)""", _RECENT)

_FEATURES = """
distribution AS (
  SELECT user_id, feature, value, count(*) AS n, max(order_date) AS last_order FROM (
    SELECT user_id, order_date, 'roaster_name' AS feature, roaster_name AS value FROM history
    UNION ALL SELECT user_id, order_date, 'origin_country', origin_country FROM history
    UNION ALL SELECT user_id, order_date, 'processing_method', processing_method FROM history)
  WHERE value <> '' GROUP BY 1, 2, 3
)"""
TWINS["feature_distribution"] = _with("SELECT * FROM distribution", _FEATURES)
TWINS["top_features"] = _with("""
SELECT *, CAST(row_number() OVER (PARTITION BY user_id, feature
             ORDER BY n DESC, last_order DESC, value) AS INTEGER) AS position
FROM distribution QUALIFY position <= 3 OR feature = 'processing_method'""", _FEATURES)

TWINS["ordered_products"] = _with("SELECT DISTINCT user_id, product_id FROM history")

# ---------------------------------------------------------------- recommendation

# All pairs of buyer and offer, narrowed feature by feature. Fine for an oracle, not for a cluster.
_PICKED = """
offers AS (
  SELECT product_id, variant_id, price, processing_method, origin_country, roaster_name,
         list_sort(list_distinct([lower(fruit), lower(sweet)])) AS own_notes
  FROM beans WHERE coffee_type = 'Single Origin'
),
eligible AS (
  SELECT b.user_id, o.*, CASE WHEN price <= remaining THEN 0 ELSE 1 END AS tier
  FROM budgets b CROSS JOIN offers o
  WHERE price <= greatest(remaining, ceiling) AND (price <= remaining OR price <= ceiling)
    AND NOT EXISTS (SELECT 1 FROM history h
                    WHERE h.user_id = b.user_id AND h.product_id = o.product_id)
),
tiered AS (SELECT * FROM eligible
           QUALIFY tier = min(tier) OVER (PARTITION BY user_id)),
tasted AS (
  SELECT user_id, list(DISTINCT note) AS known
  FROM (SELECT user_id, lower(unnest(string_split(notes_key, ', '))) AS note FROM history)
  GROUP BY user_id
),
counted AS (
  SELECT t.*, coalesce(p.n, 0) AS n_processing_method, coalesce(c.n, 0) AS n_origin_country,
         coalesce(r.n, 0) AS n_roaster_name, len(own_notes) AS n_notes,
         coalesce(len(list_intersect(own_notes, known)), 0) AS n_known_notes
  FROM tiered t
  LEFT JOIN (SELECT user_id, processing_method, count(*) AS n FROM history GROUP BY 1, 2) p
    USING (user_id, processing_method)
  LEFT JOIN (SELECT user_id, origin_country, count(*) AS n FROM history GROUP BY 1, 2) c
    USING (user_id, origin_country)
  LEFT JOIN (SELECT user_id, roaster_name, count(*) AS n FROM history GROUP BY 1, 2) r
    USING (user_id, roaster_name)
  LEFT JOIN tasted USING (user_id)
),
step1 AS (SELECT * FROM counted QUALIFY processing_method = first_value(processing_method) OVER (
  PARTITION BY user_id ORDER BY n_processing_method, price, product_id, variant_id)),
step2 AS (SELECT * FROM step1 QUALIFY origin_country = first_value(origin_country) OVER (
  PARTITION BY user_id ORDER BY n_origin_country, price, product_id, variant_id)),
step3 AS (SELECT * FROM step2 QUALIFY roaster_name = first_value(roaster_name) OVER (
  PARTITION BY user_id ORDER BY n_roaster_name, price, product_id, variant_id)),
picked AS (SELECT * FROM step3 QUALIFY 1 = row_number() OVER (
  PARTITION BY user_id ORDER BY n_known_notes / n_notes, price, product_id, variant_id))"""
TWINS["recommendation"] = _with("""
SELECT * EXCLUDE (own_notes), array_to_string(own_notes, ', ') AS notes FROM picked""", _PICKED)
TWINS["recommended_orders"] = _with("""
SELECT user_id, product_id, variant_id, b.parent_title AS product_title, 1 AS quantity,
       b.price AS price_paid, 'ids' AS matched_by, b.roaster_name, b.product_url, b.option1,
       b.origin_country, b.processing_method
FROM picked JOIN beans b USING (product_id, variant_id)""", _PICKED)

TWINS["candidate_counts"] = _with("""
SELECT c_custkey AS user_id, count(DISTINCT b.product_id) AS n_ordered,
       (SELECT count(*) FROM beans WHERE coffee_type = 'Single Origin') - count(DISTINCT
       b.product_id) AS n_candidates
FROM customer LEFT JOIN history h ON h.user_id = c_custkey
LEFT JOIN beans b ON b.product_id = h.product_id AND b.coffee_type = 'Single Origin'
GROUP BY c_custkey""")

TWINS["format_lines"] = _with("""
SELECT product_id, variant_id, '[' || product_id || ',' || variant_id || '] ' || roaster_name
       || ' - ' || parent_title || ' | Origin: ' || coalesce(nullif(origin_country, ''), 'Unknown')
       || coalesce(' | Process: ' || nullif(processing_method, ''), '')
       || ' | Tasting notes: ' || fruit || ', ' || sweet
       || ' | Price: $' || printf('%.2f', price) || ' | URL: ' || product_url AS line
FROM options""")

TWINS["display_labels"] = _with("""
SELECT product_id, variant_id, CASE is_single_origin WHEN true THEN 'Single Origin'
       WHEN false THEN 'Blend' ELSE 'Unknown' END AS type_label,
       varietals AS varietals_text, parent_title || ' ' || replace(varietals, '#', '')
       AS safe_title, printf('%.2f', price) AS price_text,
       CAST(is_single_origin AS INTEGER) AS single_origin_flag FROM beans""")

# ---------------------------------------------------------------- resolving

_STRINGS = r"""
strings AS (
  SELECT product_id || '/' || variant_id || '/' || form AS request_id, CASE form
    WHEN 0 THEN '[' || product_id || ', ' || variant_id || ',7] ' || roaster_name || ' - '
                || parent_title || chr(10) || 'more text'
    WHEN 1 THEN '[999,' || variant_id || '] ' || roaster_name || ' - ' || parent_title
    WHEN 2 THEN parent_title
    ELSE '[x,' || variant_id || '] ' || parent_title END AS text
  FROM beans CROSS JOIN range(4) f(form)
),
parsed AS (
  SELECT *, trim(split_part(text, chr(10), 1)) AS line,
         CASE WHEN line LIKE '[%' AND line LIKE '%]%'
              THEN string_split(split_part(substr(line, 2), ']', 1), ',') END AS ids,
         TRY_CAST(trim(ids[1]) AS BIGINT) AS pid, TRY_CAST(trim(ids[2]) AS BIGINT) AS vid,
         CASE WHEN line NOT LIKE '[%' THEN line
              WHEN pid IS NOT NULL AND vid IS NOT NULL
              THEN substr(line, strpos(line, ']') + 2) END AS title
  FROM strings
),
titles AS (
  SELECT * FROM options
  QUALIFY 1 = row_number() OVER (PARTITION BY parent_title ORDER BY price, product_id, variant_id)
),
found AS (
  SELECT p.request_id, p.text, p.title, a.product_id IS NOT NULL AS by_ids,
         coalesce(a.product_id, b.product_id, c.product_id) AS product_id,
         coalesce(a.variant_id, b.variant_id, c.variant_id) AS variant_id,
         coalesce(a.parent_title, b.parent_title, c.parent_title) AS parent_title,
         coalesce(a.price, b.price, c.price) AS price
  FROM parsed p
  LEFT JOIN options a ON a.product_id = p.pid AND a.variant_id = p.vid
  LEFT JOIN titles b ON b.parent_title = p.title
  LEFT JOIN titles c ON strpos(p.title, ' - ') > 0
                    AND c.parent_title = substr(p.title, strpos(p.title, ' - ') + 3)
)"""
TWINS["resolve_order_keys"] = _with("""
SELECT request_id, product_id, variant_id, parent_title, 1 AS quantity, price AS price_paid,
       CASE WHEN by_ids THEN 'ids' ELSE 'title' END AS matched_by
FROM found WHERE product_id IS NOT NULL""", _STRINGS)
TWINS["unresolved_order_keys"] = _with("""
SELECT request_id, text, CASE WHEN title IS NULL THEN 'malformed key' ELSE 'no such option' END
       AS reason FROM found WHERE product_id IS NULL""", _STRINGS)

_NAMES = """
labelled AS (SELECT *, parent_title || ' ' || roaster_name AS label FROM beans),
fragments AS (
  SELECT upper(p_name) AS fragment FROM part
  UNION SELECT unnest(string_split(p_name, ' ')) FROM part
  UNION SELECT label FROM labelled
  UNION SELECT replace(label, ' ', '%') FROM labelled
  UNION SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part
),
resolved AS (
  SELECT fragment, count(l.product_id) AS n_matches,
         CASE count(l.product_id) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END
         AS state,
         CASE WHEN count(l.product_id) = 1 THEN min(l.product_id) END AS product_id,
         CASE WHEN count(l.product_id) = 1 THEN min(l.variant_id) END AS variant_id,
         CASE WHEN count(l.product_id) = 1 THEN min(l.price) END AS price
  FROM fragments LEFT JOIN labelled l ON lower(label) LIKE '%' || lower(fragment) || '%'
  GROUP BY fragment
)"""
TWINS["resolve_names"] = _with("SELECT * FROM resolved", _NAMES)
TWINS["names_not_found"] = _with(
    "SELECT fragment, n_matches, state FROM resolved WHERE state <> 'unique'", _NAMES
)
TWINS["bulk_order_by_name"] = _with(f"""
SELECT fragment, q.product_id, q.variant_id, 1 AS quantity, q.price AS price_paid,
       DATE '{LOAD_TS:%Y-%m-%d}' AS order_date, r.name AS roaster_name, p_name AS product_title,
       r.origin_country
FROM resolved q JOIN products p USING (product_id) JOIN roasters r ON r.id = p.roaster_id
WHERE state = 'unique'""", _NAMES)
TWINS["match_fragments"] = _with("""
SELECT fragment, product_id, variant_id, label
FROM (SELECT DISTINCT upper(p_name) AS fragment FROM part) JOIN labelled
  ON label ILIKE '%' || fragment || '%'""", _NAMES)

# ---------------------------------------------------------------- ingest

TWINS["product_rows"] = f"""
SELECT p_partkey AS source_id, p_name AS title, '' AS handle, p_brand AS body_html,
       CASE WHEN p_brand = 'Brand#13' THEN '' ELSE p_brand END AS vendor, p_type AS product_type,
       replace(p_name, ' ', CASE WHEN p_type = 'SMALL' THEN ';' ELSE ',' END) AS tags,
       'https://parts/' || p_partkey AS url, DATE '2001-02-03' AS published_on,
       CAST(NULL AS DATE) AS created_on, DATE '{LOAD_TS:%Y-%m-%d}' AS loaded_on
FROM part"""

TWINS["flatten_options"] = """
SELECT p_partkey AS product_id, 'Size' AS name, p_size || ',' || p_type AS values FROM part
UNION ALL SELECT p_partkey, '', replace(p_name, ' ', ',') FROM part"""

TWINS["flatten_images"] = """
SELECT p_partkey AS product_id, CAST(i AS INTEGER) AS position,
       split_part(p_name, ' ', CAST(i AS INTEGER)) || '.jpg' AS src
FROM part CROSS JOIN range(1, 3) r(i) WHERE p_type <> 'PROMO'"""

TWINS["first_images"] = """
SELECT p_partkey AS product_id, split_part(p_name, ' ', 1) || '.jpg' AS image_url
FROM part WHERE p_type <> 'PROMO'"""

TWINS["flatten_tags"] = _with("""
SELECT product_id, CAST(i AS INTEGER) AS position,
       split_part(p_name, ' ', CAST(i AS INTEGER) + 1) AS tag
FROM products CROSS JOIN range(2) r(i)""")

TWINS["variant_coercion"] = """
SELECT l_partkey AS source_id,
       l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS title,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS available,
       CASE WHEN l_returnflag = 'N' THEN l_tax END AS compare_at_price,
       CAST(l_quantity AS INTEGER) AS grams, l_linestatus AS option1, '' AS option2,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS option3,
       l_linenumber AS position,
       CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_extendedprice END::DOUBLE AS price,
       CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS requires_shipping, 1 AS taxable,
       l_discount AS weight, 0 AS inventory_quantity
FROM lineitem JOIN part ON l_partkey = p_partkey"""

TWINS["load_counts"] = _with("""
SELECT roaster_id, count(DISTINCT product_id) AS n_products, count(*) AS n_variants
FROM products JOIN variants USING (product_id) GROUP BY 1""")

TWINS["display_names"] = _with("""
SELECT name, CASE WHEN origin_region = 'ASIA' THEN 'House ' || name ELSE name END AS description
FROM roasters
UNION ALL SELECT 'o''' || replace(name, '#', '_'), 'O''' || replace(name, '#', '_')
FROM roasters""")

TWINS["upsert_roasters"] = _with("""
SELECT id, name, CASE WHEN origin_region = 'AFRICA' THEN name || ' ' || origin_country ELSE name END
       AS description, url FROM roasters
UNION ALL SELECT n_nationkey + 1000000000, lower(n_name),
       upper(n_name[1]) || lower(substr(n_name, 2)), 'https://nation/' || lower(n_name) FROM nation
""")

TWINS["schema_union"] = """
SELECT s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer"""

TWINS["cascade_orphans"] = _with("""
SELECT variant_id, product_id, price FROM variants JOIN products USING (product_id)
WHERE p_brand <> 'Brand#13'""")

TWINS["load_report"] = """
SELECT event_type AS source, count(*) AS n_rows,
       count(*) FILTER (event_type = 'click') AS n_bad FROM events GROUP BY 1"""

TWINS["constraint_report"] = _with("""
SELECT 'lineitem.l_quantity is null' AS rule, count(*) FILTER (l_quantity IS NULL) AS violations
FROM lineitem
UNION ALL SELECT 'lineitem.l_extendedprice is null', count(*) FILTER (l_extendedprice IS NULL)
FROM lineitem
UNION ALL SELECT 'part.p_name is null', count(*) FILTER (p_name IS NULL) FROM part
UNION ALL SELECT 'supplier.s_name is null', count(*) FILTER (s_name IS NULL) FROM supplier
UNION ALL SELECT 'lineitem.(l_orderkey, l_linenumber) repeats', count(*) FROM (
  SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'details.(product_id) repeats', count(*) FROM (
  SELECT 1 FROM details GROUP BY product_id HAVING count(*) > 1)
UNION ALL SELECT 'lineitem.l_orderkey has no parent', count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem.l_partkey has no parent', count(*) FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orders.o_custkey has no parent', count(*) FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'events.user_id has no parent', count(*) FROM events
  WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")

TWINS["order_dates"] = """
SELECT o_orderkey AS order_id,
       CASE WHEN o_orderpriority[1] IN ('1', '2') THEN CAST(o_orderdate AS DATE) END AS order_date,
       CASE o_orderpriority[1] WHEN '1' THEN '00:00:00' WHEN '2' THEN '10:20:30' END AS order_time,
       o_orderpriority[1] IN ('3', '4') AS rejected
FROM orders"""

# ---------------------------------------------------------------- enrichment

TWINS["to_enrich"] = _with("""
SELECT product_id, parent_title, product_url, parent_title AS title, p.body_html, p.tags
FROM beans JOIN products p USING (product_id) WHERE processing_method = 'PROMO'""")

TWINS["replace_details"] = _with("""
SELECT product_id, is_single_origin, origin_country, origin_region,
       CASE WHEN processing_method IN ('MEDIUM', 'PROMO') THEN 'Honey' ELSE processing_method END
       AS processing_method, varietals, resting_period_days FROM details""")

_TEXTS = r"""
said AS (
  SELECT product_id, p_size, p_type, p_brand, r.name AS roaster_name, origin_country,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_name,
         CASE p_type WHEN 'LARGE' THEN CAST(p_size * 50 AS VARCHAR)
           WHEN 'MEDIUM' THEN (p_size * 50) || '-' || (p_size * 50 + 200)
           WHEN 'SMALL' THEN CAST(round(p_size * 50 * 0.3048) AS INTEGER) || '-'
                             || CAST(round((p_size * 50 + 900) * 0.3048) AS INTEGER) END
         AS altitude,
         CASE WHEN p_brand = 'Brand#7' THEN p_name END AS farm,
         CASE WHEN p_brand = 'Brand#8' THEN r.name
              WHEN p_brand = 'Brand#9' THEN 'Coop ' || origin_country END AS named_producer
  FROM products JOIN roasters r ON r.id = roaster_id
),
facts AS (
  SELECT *, nullif(named_producer, roaster_name) AS producer,
         CASE w1 WHEN 'hot' THEN 'Dark' WHEN 'old' THEN 'Espresso' WHEN 'cold' THEN 'Light'
                 WHEN 'new' THEN 'Filter' END AS roast_level,
         p_type = 'MEDIUM' AS honey, p_type = 'LARGE' OR w1 = 'large' AS natural_dried,
         p_type IN ('ECONOMY', 'STANDARD') AS washed,
         concat_ws('; ', CASE WHEN honey THEN 'Honey' END,
           CASE WHEN natural_dried THEN 'Natural' END,
           CASE WHEN washed THEN 'Washed' END, CASE WHEN p_type = 'PROMO' THEN 'Anaerobic' END,
           CASE WHEN p_type = 'SMALL' OR w1 = 'small' THEN 'Thermal Shock' END)
         AS processing_method,
         CASE w2 WHEN 'anvil' THEN 'SL28' WHEN 'bolt' THEN 'Bourbon' WHEN 'gear' THEN 'Batian'
                 WHEN 'gizmo' THEN 'Typica' ELSE '' END AS varietals,
         concat_ws(chr(10), CASE WHEN w1 = 'red' THEN 'Fruits: Cherry' END,
           CASE WHEN w2 = 'ring' THEN 'Sweets: Toffee' END,
           CASE WHEN w1 = 'blue' THEN 'Florals: Lavender' END,
           CASE WHEN w2 = 'plate' THEN 'Spices: Clove' END,
           CASE w2 WHEN 'widget' THEN 'Others: Almond' WHEN 'rod' THEN 'Others: Tobacco' END)
         AS notes,
         CAST(split_part(altitude, '-', -1) AS INTEGER) > 1600 AS dense
  FROM said
),
rests AS (
  SELECT *, CASE WHEN honey OR natural_dried THEN 10 WHEN washed THEN 7 END
         + CASE WHEN roast_level IN ('Dark', 'Espresso') THEN -3
                    WHEN roast_level IN ('Light', 'Filter') THEN 2 ELSE 0 END
         + CASE WHEN varietals IN ('SL28', 'Batian') THEN 1 ELSE 0 END
         + CASE WHEN dense THEN 1 ELSE 0 END AS low,
         CASE WHEN honey OR natural_dried THEN 14 WHEN washed THEN 10 END
         + CASE WHEN roast_level IN ('Dark', 'Espresso') THEN -2
                    WHEN roast_level IN ('Light', 'Filter') THEN 3 ELSE 0 END
         + CASE WHEN varietals IN ('SL28', 'Batian') THEN 2 ELSE 0 END
         + CASE WHEN dense THEN 2 ELSE 0 END AS high
  FROM facts
)"""
TWINS["extract_attributes"] = _with("""
SELECT product_id, CASE WHEN farm IS NOT NULL OR producer IS NOT NULL THEN true END AS is_single_origin,
       origin_country, roast_level, processing_method,
       varietals, altitude, farm, producer, notes,
       CAST(floor((low + high) / 2.0) AS INTEGER) AS resting_period_days,
       round((2 + (farm IS NOT NULL OR producer IS NOT NULL)::INT
              + (roast_level IS NOT NULL)::INT + (altitude IS NOT NULL)::INT
              + (farm IS NOT NULL)::INT + (producer IS NOT NULL)::INT + (varietals <> '')::INT
              + (notes <> '')::INT) / 9.0::DOUBLE, 4) AS confidence_score
FROM rests""", _TEXTS)
TWINS["altitude_normalise"] = _with("SELECT product_id, altitude FROM facts", _TEXTS)
TWINS["grower_labels"] = _with(
    "SELECT product_id, farm, named_producer, producer FROM facts", _TEXTS
)
TWINS["re_enrich"] = _with("""
SELECT product_id, CASE WHEN chosen THEN roast_level ELSE 'stored' END AS roast_level,
       processing_method, producer,
       CASE WHEN chosen THEN round((2 + (farm IS NOT NULL OR producer IS NOT NULL)::INT
              + (roast_level IS NOT NULL)::INT
         + (altitude IS NOT NULL)::INT + (farm IS NOT NULL)::INT
         + (producer IS NOT NULL)::INT + (varietals <> '')::INT
         + (notes <> '')::INT) / 9.0::DOUBLE, 4) ELSE 0.5 END AS extraction_confidence
FROM (SELECT *, p_brand IN ('Brand#7', 'Brand#8', 'Brand#9') AS chosen FROM facts)""", _TEXTS)

TWINS["resting_period"] = """
SELECT p_partkey AS product_id, low AS low_days, high AS high_days,
       CAST(floor((low + high) / 2.0) AS INTEGER) AS days
FROM (
  SELECT p_partkey, base + roast_low + long_low + dense_low AS low,
         base + CASE WHEN base = 10 THEN 4 ELSE 3 END + roast_high + 2 * (long_low + dense_low)
         AS high
  FROM (
    SELECT p_partkey,
      CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 10 WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 7
      END AS base,
      CASE split_part(p_name, ' ', 1) WHEN 'hot' THEN -3 WHEN 'old' THEN -3 WHEN 'cold' THEN 2
           WHEN 'new' THEN 2 ELSE 0 END AS roast_low,
      CASE split_part(p_name, ' ', 1) WHEN 'hot' THEN -2 WHEN 'old' THEN -2 WHEN 'cold' THEN 3
           WHEN 'new' THEN 3 ELSE 0 END AS roast_high,
      CASE WHEN split_part(p_name, ' ', 2) IN ('anvil', 'gear') THEN 1 ELSE 0 END AS long_low,
      CASE WHEN p_size * 50 > 1600 THEN 1 ELSE 0 END AS dense_low
    FROM part))"""

TWINS["document_attributes"] = r"""
WITH words AS (
  SELECT doc_id, w, i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')),
                                  ' ') AS ws FROM documents))
),
phrases AS (
  SELECT doc_id, w AS phrase FROM words
  UNION SELECT a.doc_id, a.w || ' ' || b.w FROM words a JOIN words b
    ON a.doc_id = b.doc_id AND b.i = a.i + 1
),
terms(kind, term, value) AS (VALUES
  ('country', 'the', 'English'), ('country', 'und', 'German'), ('country', 'der', 'German'),
  ('country', 'les', 'French'), ('country', 'des', 'French'), ('country', 'el', 'Spanish'),
  ('process1', 'of the', 'Washed'), ('process1', 'de la', 'Natural'),
  ('process2', 'and the', 'Anaerobic'), ('process3', 'in the', 'Thermal Shock'),
  ('note1', 'is', 'Fruits: Apple'), ('note2', 'a', 'Sweets: Toffee'),
  ('note3', 'en', 'Florals: Rose'), ('note4', 'on', 'Spices: Clove'),
  ('note5', 'it was', 'Others: Almond'), ('varietal', 'with', 'Typica'), ('roast', 'by', 'Light'),
  ('blend', 'blend', 'blend')
),
hits AS (SELECT DISTINCT doc_id, kind, value FROM phrases JOIN terms ON phrase = term)
SELECT d.doc_id,
  CASE WHEN count(*) FILTER (kind = 'blend') > 0 OR count(*) FILTER (kind = 'country') > 1
       THEN false END AS is_single_origin,
  min(value) FILTER (kind = 'country') AS origin_country,
  string_agg(value, '; ' ORDER BY kind, value) FILTER (kind LIKE 'process%') AS processing_method,
  coalesce(string_agg(value, ',' ORDER BY value) FILTER (kind = 'varietal'), '') AS varietals,
  min(value) FILTER (kind = 'roast') AS roast_level,
  coalesce(string_agg(value, chr(10) ORDER BY kind) FILTER (kind LIKE 'note%'), '') AS notes
FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id"""

TWINS["parse_event_props"] = """
SELECT event_id,
       CASE event_type WHEN 'signup' THEN 'empty' WHEN 'error' THEN 'failed' ELSE 'ok' END
       AS status,
       CASE WHEN event_type = 'purchase' THEN 'c' || k END AS origin_country,
       CASE WHEN event_type = 'view' THEN 'r' || k END AS roast_level,
       CASE WHEN event_type = 'purchase' THEN 'A, B' END AS varietals,
       CASE WHEN event_type = 'click' THEN 'x, f' || k END AS farm,
       CASE WHEN event_type = 'click' THEN 0.25 ELSE 0.0 END::DOUBLE AS extraction_confidence
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)"""

TWINS["payload_notes"] = """
WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 'fruits' AS category, 'f' || k AS note FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 'fruits', 'Plum' FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 'spices', 's' || k FROM e WHERE event_type = 'click'"""

TWINS["event_props"] = """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events
"""

TWINS["notes_long"] = _with("""
SELECT product_id, 'fruits' AS category, fruit AS note FROM beans
UNION ALL SELECT product_id, 'sweets', sweet FROM beans""")

_REGION = r"""(?is)<div[^>]*class="[^"]*ad[^"]*"[^>]*>(.*?)</div>"""
TWINS["page_region_text"] = f"""
SELECT page_id, regexp_extract(html, '{_REGION}', 1) AS region_text FROM pages"""
TWINS["pages_without_region"] = f"""
SELECT page_id, CASE WHEN url LIKE '%.org/%' THEN regexp_extract(html, '{_REGION}', 1) ELSE '' END
       AS region_text FROM pages"""

TWINS["assemble_documents"] = f"""
SELECT doc_id AS product_id, concat_ws(chr(10) || chr(10),
         '[title]' || chr(10) || source || ' ' || lang,
         '[description]' || chr(10) || nullif(text, ''),
         '[page]' || chr(10) || regexp_extract(html, '{_REGION}', 1),
         CASE WHEN lang <> 'de' THEN '[tags]' || chr(10) || lang || ', ' || source END) AS text
FROM documents LEFT JOIN pages ON page_id = doc_id"""

TWINS["product_by_url"] = """
SELECT '/part/' || p_partkey AS url, min(l_partkey * 200000000 + l_suppkey) AS product_id
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"""

# ---------------------------------------------------------------- rejects, repeats, status

TWINS["orders_by_id_status"] = _with(
    "SELECT id, price_paid, product_status FROM marked WHERE o_orderpriority = '1-URGENT'", _STATUS
)
TWINS["append_twice"] = _with("SELECT id, user_id, price_paid FROM lines")
TWINS["order_string_rejects"] = _with("""
SELECT request_id, text, CASE WHEN title IS NULL THEN 'malformed key' ELSE 'no such option' END
       AS reason FROM found WHERE product_id IS NULL
UNION ALL
SELECT request_id, text, 'product not found' FROM found JOIN products USING (product_id)
WHERE p_brand = 'Brand#8'""", _STRINGS)
TWINS["ambiguous_candidates"] = _with("""
SELECT fragment, product_id, variant_id, label
FROM (SELECT DISTINCT upper(p_name) AS fragment FROM part) JOIN labelled
  ON label ILIKE '%' || fragment || '%'
QUALIFY count(*) OVER (PARTITION BY fragment) > 1""", _NAMES)
TWINS["upsert_with_audit"] = _with("""
SELECT id, CASE WHEN origin_region = 'AFRICA' THEN name || ' ' || origin_country ELSE name END
       AS description, DATE '1995-01-01' AS created_on,
       CASE WHEN origin_region = 'AFRICA' THEN DATE '2001-07-15' ELSE DATE '1995-01-01' END
       AS updated_on FROM roasters
UNION ALL SELECT n_nationkey + 1000000000, n_name, DATE '2001-07-15', DATE '2001-07-15' FROM nation
""")
TWINS["load_rejects"] = _with("""
SELECT CAST(l_suppkey AS VARCHAR) AS source, 'variants' AS kind,
       CASE WHEN r.id IS NULL OR origin_region = 'AFRICA' THEN 'source not registered'
            ELSE 'no such product' END AS reason, l_orderkey || '-' || l_linenumber AS title
FROM lineitem LEFT JOIN roasters r ON r.id = l_suppkey LEFT JOIN part ON p_partkey = l_partkey
WHERE r.id IS NULL OR origin_region = 'AFRICA' OR p_partkey IS NULL OR p_brand = 'Brand#13'""")
TWINS["re_enrich_unknown"] = _with("SELECT -1 - product_id AS product_id FROM products")

_REPEATED = """
records AS (
  SELECT CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS own_id,
         l_orderkey || '-' || l_linenumber AS title,
         CASE WHEN l_linestatus <> 'O' THEN 'https://' || l_suppkey || '/' || l_partkey END AS url,
         strftime(l_shipdate, '%Y-%m-%d') AS updated_at, l_suppkey AS roaster_id,
         coalesce('id:' || CASE WHEN l_returnflag <> 'R' THEN l_partkey END,
                  'url:' || CASE WHEN l_linestatus <> 'O' THEN 'https://' || l_suppkey || '/' || l_partkey END,
                  'row:' || l_orderkey || '-' || l_linenumber || strftime(l_shipdate, '%Y-%m-%d')) AS source_key
  FROM lineitem
),
counted AS (SELECT *, count(*) AS n FROM records GROUP BY ALL),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY roaster_id, source_key
           ORDER BY updated_at DESC, title DESC, url DESC NULLS LAST) AS place
  FROM counted
)"""
TWINS["load_products"] = _with(
    "SELECT roaster_id, own_id, url, title, updated_at FROM marked WHERE place = 1", _REPEATED
)
TWINS["load_lost"] = _with("""
SELECT CAST(roaster_id AS VARCHAR) AS source, title,
       CASE WHEN place = 1 THEN n - 1 ELSE n END AS n
FROM marked WHERE place > 1 OR n > 1""", _REPEATED)

TWINS["place_attributes"] = _with("""
SELECT product_id,
       CASE WHEN len(countries) > 1 OR len(regions) > 1 THEN false
            WHEN len(regions) = 1 OR n_areas = 1 THEN true END AS is_single_origin,
       countries[1] AS origin_country, regions[1] AS origin_region
FROM (
  SELECT product_id, count(DISTINCT area) AS n_areas,
         list_sort(coalesce(list(DISTINCT region) FILTER (region IS NOT NULL), [])) AS regions,
         list_sort(coalesce(list(DISTINCT country) FILTER (country IS NOT NULL), [])) AS countries
  FROM (
    SELECT product_id, area, region, country
    FROM listings JOIN part ON l_partkey = p_partkey
    JOIN places ON word IN (split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))
    UNION ALL
    SELECT product_id, NULL, NULL, CASE WHEN p_size % 2 = 0 THEN origin_country END
    FROM listings JOIN part ON l_partkey = p_partkey JOIN roasters r ON r.id = l_suppkey
  ) GROUP BY product_id
)""", """
places(word, area, region, country) AS (VALUES
  ('gear', NULL, 'Gearland', 'NATION_1'), ('red', NULL, 'Red Valley', 'NATION_1'),
  ('blue', NULL, 'Blue Coast', 'NATION_4'), ('gizmo', NULL, 'Gizmo Hills', NULL),
  ('anvil', 'Anvil Farm', 'Gearland', 'NATION_1'), ('ring', 'Ring Estate', 'Gizmo Hills', NULL),
  ('bolt', 'Bolt Ridge', NULL, NULL)
)""")
