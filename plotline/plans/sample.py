"""Property tables derived from the driver's star schema, as SQL that Spark and DuckDB both read.

Only these input views are shared with the oracle; every operator and its oracle are written apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plotline.operators.shared import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
AS_OF = "2024-01-31 00:00:00"

#: name -> SELECT over the driver's tables and earlier views
VIEWS: dict[str, str] = {
    "n_parts": "SELECT count(*) AS n FROM part",
    "n_customers": "SELECT count(*) AS n FROM customer",
    "n_listings": "SELECT count(*) AS n_li FROM orders",
    "assets": """
        SELECT p_partkey AS id, lower(p_type) AS asset_type_detail,
               CASE WHEN p_partkey % 3 = 0 THEN 'retail_office' ELSE 'residential_standard' END AS asset_type_family,
               concat('Calle ', p_name, ' ', CAST(p_partkey % 90 + 1 AS STRING), ', ', n_name, ', ', r_name) AS address_raw,
               lower(replace(p_name, ' ', '')) AS address_norm,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE n_name END AS neighborhood,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE r_name END AS district,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 4.035e1 + CAST(p_partkey % 97 AS DOUBLE) * 1.3e-3 END AS lat,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE -3.75e0 + CAST(p_partkey % 89 AS DOUBLE) * 1.7e-3 END AS lon,
               CAST(20 + p_size * 3 AS DOUBLE) AS area_m2
        FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey
    """,
    "contacts": """
        SELECT c_custkey AS id, concat('6', lpad(CAST(c_custkey % CAST(n / 3 AS BIGINT) AS STRING), 8, '0')) AS phone_raw,
               concat('+346', lpad(CAST(c_custkey % CAST(n / 3 AS BIGINT) AS STRING), 8, '0')) AS phone_norm,
               c_name AS name_raw, lower(replace(c_name, '#', '')) AS name_norm
        FROM customer CROSS JOIN (SELECT CAST(greatest(floor(n / 3), 1) * 3 AS BIGINT) AS n FROM n_customers) AS s
    """,
    "listings": """
        SELECT o_orderkey AS id, (o_orderkey * 7919) % n AS asset_id, o_custkey AS contact_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'Idealista' WHEN 1 THEN 'Fotocasa' WHEN 2 THEN 'Habitaclia' WHEN 3 THEN 'Milanuncios' WHEN 4 THEN 'Pisos' ELSE NULL END AS source_portal,
               concat('https://portal', CAST(o_orderkey % 6 AS STRING), '.example.com/listing-', CAST(o_orderkey AS STRING)) AS listing_url,
               CAST(o_orderkey AS STRING) AS external_id,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'sold' ELSE NULL END AS status,
               o_totalprice AS price_eur, o_totalprice / CAST(20 + p_size * 3 AS DOUBLE) AS price_per_m2, CAST(20 + p_size * 3 AS DOUBLE) AS area_m2,
               o_orderdate AS updated_at
        FROM orders CROSS JOIN n_parts JOIN part ON p_partkey = (o_orderkey * 7919) % n
    """,
    "snapshots": "SELECT l_orderkey AS listing_id, l_shipdate AS snapshot_datetime, l_extendedprice AS price_eur, l_linestatus AS status FROM lineitem",
    "market_events": """
        SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % n END AS asset_id, event_id % n_li AS listing_id,
               CASE event_type WHEN 'view' THEN 'listing_detected' WHEN 'click' THEN 'price_drop' WHEN 'purchase' THEN 'sold' WHEN 'signup' THEN 'reserved' ELSE 'expired' END AS event_type,
               ts AS event_datetime, CASE WHEN event_id % 10 = 9 THEN 'alerts' ELSE 'flow' END AS source_channel,
               CAST(100000 + floor(value) * 100 AS DOUBLE) AS price_old, CAST(100000 + floor(value) * 100 - (event_id % 40) * 1000 AS DOUBLE) AS price_new
        FROM events CROSS JOIN n_parts CROSS JOIN n_listings
    """,
    "flow_items": """
        SELECT e.event_id AS id, concat('uid', CAST(CASE WHEN e.event_id % 10 = 9 THEN e.event_id - 4 ELSE e.event_id END AS STRING)) AS source_uid,
               CASE e.event_type WHEN 'view' THEN 'listing_detected' WHEN 'click' THEN 'price_drop' WHEN 'purchase' THEN 'sold' ELSE 'history_item' END AS event_type_guess,
               e.ts AS event_datetime, a.address_raw, a.address_norm,
               CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE l.source_portal END AS portal,
               CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE c.name_raw END AS contact_name,
               CASE WHEN e.event_id % 4 = 1 THEN NULL ELSE c.phone_raw END AS contact_phone,
               CASE WHEN e.event_id % 6 = 0 THEN l.listing_url WHEN e.event_id % 6 = 1 THEN concat('https://otra.example.com/x/listing-', l.external_id) ELSE NULL END AS listing_url,
               l.price_eur * (1e0 + CAST(e.event_id % 30 AS DOUBLE) * 1e-2) AS current_price_eur,
               CASE WHEN e.event_id % 2 = 0 THEN l.price_eur ELSE NULL END AS previous_price_eur
        FROM events AS e CROSS JOIN n_listings JOIN listings AS l ON l.id = e.event_id % n_li
        JOIN assets AS a ON a.id = l.asset_id JOIN contacts AS c ON c.id = l.contact_id
    """,
    "links": """
        SELECT event_id AS flow_item_id, CASE WHEN event_id % 3 = 0 THEN event_id % n_li ELSE NULL END AS listing_id,
               CASE WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 3 = 1 THEN 'unresolved' WHEN event_id % 5 = 0 THEN 'pending' ELSE 'ambiguous' END AS match_status,
               CAST(event_id % 120 AS DOUBLE) AS match_score,
               CASE WHEN event_id % 3 = 0 THEN 'direct_anchor' ELSE 'candidate_scoring' END AS match_strategy,
               CASE WHEN event_id % 7 = 0 THEN 'reason=price_conflict | precio lejos' ELSE 'reason=weak_identity' END AS match_note
        FROM events CROSS JOIN n_listings
    """,
    "reviews": """
        SELECT event_id AS id, CAST(floor(event_id / 2) AS BIGINT) AS flow_item_id, CASE event_id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'no_match' WHEN 2 THEN 'match' ELSE 'unsure' END AS review_label,
               CASE WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 3 = 1 THEN 'unresolved' ELSE 'ambiguous' END AS predicted_status,
               CAST(event_id % 101 AS DOUBLE) / 1e2 AS predicted_score, ts AS created_at
        FROM events
    """,
    "runs": """
        SELECT event_id % 30 AS id, CASE WHEN event_id % 30 < 25 THEN 'csv' ELSE 'flow' END AS source_type, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'success' END AS status,
               max(ts) AS finished_at
        FROM events WHERE ts < TIMESTAMP '2024-01-24 00:00:00' OR event_id % 3 = 0 OR event_id % 30 >= 25 GROUP BY event_id % 30, event_id % 3
    """,
    "zone_context": """
        SELECT 'neighborhood' AS zone_level, concat(substr(n_name, 1, 1), lower(substr(n_name, 2))) AS zone_label, n_name AS zone_name,
               CAST(5000 + n_nationkey * 731 AS BIGINT) AS population, CAST(n_nationkey % 9 AS BIGINT) AS change_of_use_24m, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS change_of_use_rate,
               CAST(n_nationkey % 4 AS DOUBLE) AS inspections_rate, CAST(n_nationkey % 6 AS DOUBLE) AS closed_rate, CAST(n_nationkey % 3 AS DOUBLE) AS vut_rate
        FROM nation
        UNION ALL
        SELECT 'district', CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE concat(substr(r_name, 1, 1), lower(substr(r_name, 2))) END, r_name, CAST(90000 + r_regionkey * 1777 AS BIGINT), CAST(20 + r_regionkey AS BIGINT),
               CAST(r_regionkey AS DOUBLE), CAST(r_regionkey AS DOUBLE), CAST(r_regionkey AS DOUBLE), CAST(r_regionkey AS DOUBLE)
        FROM region
    """,
}
#: which views a view reads, beside the driver's tables
NEEDS = {"contacts": ["n_customers"], "listings": ["n_parts"], "market_events": ["n_parts", "n_listings"], "links": ["n_listings"], "flow_items": ["n_parts", "n_customers", "n_listings", "assets", "contacts", "listings"]}


def kept(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a written stage, for a query that reads it more than once: what reads it has a scan in its plan, not all that led to it."""
    return stored(df, name)


def cte(*names: str) -> str:
    """``WITH`` text of the named views and what they read, for an oracle."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in NEEDS.get(n, []) if x not in wanted]
        wanted += [n] if n not in wanted else []
    order = [n for n in VIEWS if n in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame; the driver's tables that it reads become temporary views."""
    text = name if name in TABLES else cte(name)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.table(name) if name in TABLES else spark.sql(f"{text} SELECT * FROM {name}")
