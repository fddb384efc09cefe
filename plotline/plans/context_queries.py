"""Context, street and list queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions import addresses
from plotline.operators import context, profiles
from plotline.plans.sample import cte, view
from plotline.plans.zone_queries import scored_v2
from plotline.plans.zone_sql import SCORED


def _licences(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    nation = view(spark, d, "nation").join(view(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", c("n_name").alias("neighborhood"), c("r_name").alias("district"))
    return view(spark, d, "orders").withColumn("n_nationkey", (c("o_custkey") % 25).cast("int")).join(F.broadcast(nation), "n_nationkey").select("district", "neighborhood", c("o_orderdate").cast("date").alias("day"), c("o_orderpriority").alias("kind"), c("o_orderstatus").alias("use"))


def license_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = _licences(spark, d)
    return context.two_level_counts(rows, F.to_date(F.lit("1996-01-01")), residential=F.col("use") == "O", change_of_use=F.col("kind").startswith("1"))


def population_latest(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return context.population_latest(view(spark, d, "snapshots").select("listing_id", c("snapshot_datetime").cast("date").alias("day"), "price_eur"))


def _streets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return view(spark, d, "part").select(c("p_partkey").alias("row_no"), (c("p_partkey") * 7 % 1999).alias("code"), F.when(c("p_partkey") % 2 == 0, "calle").otherwise("avenida").alias("street_type"), c("p_name").alias("street_name"))


def street_catalog(spark: SparkSession, d: str) -> DataFrame:
    return context.street_catalog(_streets(spark, d)).select("street_name", "lookup_key", "first_code", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return view(spark, d, "listings").select((c("id") % 40).alias("code"), (c("id") * 13 % 400).alias("number"), c("id").alias("row_no"), F.when(c("id") % 3 != 0, "d").alias("district"), F.when(c("id") % 5 != 0, "n").alias("neighborhood"), F.when(c("id") % 2 == 0, c("price_eur")).alias("lat"), F.when(c("id") % 2 == 0, c("area_m2")).alias("lon"))


def address_points(spark: SparkSession, d: str) -> DataFrame:
    return context.address_points(_points(spark, d))


def nearest_house_number(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    wanted = view(spark, d, "part").select(c("p_partkey").alias("id"), (c("p_partkey") % 40).alias("code"), (c("p_partkey") * 3 % 420).alias("number"))
    return context.nearest_house_number(wanted, _points(spark, d)).select("id", "number")


def boundary_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = view(spark, d, "nation").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("name"))
    return context.boundary_metrics(names, scored_v2(spark, d), "zone_capture_score").select(F.trim("name").alias("name"), "value")


def reason_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    v = lambda n: view(spark, d, n)
    phones = profiles.phone_profiles(v("listings"), v("contacts")).select(F.right("phone_norm", F.lit(9)).alias("contact_phone"), "phone_profile")
    items = v("flow_items").select(c("id").alias("flow_item_id"), "contact_phone", "listing_url")
    links = v("links").join(items, "flow_item_id").join(phones, "contact_phone", "left").withColumns({"address_precision": F.when(c("flow_item_id") % 2 == 0, "zone_like").otherwise("precise"), "is_new": c("flow_item_id") % 4 == 1, "match_note": F.when(c("flow_item_id") % 10 == 1, "Sin candidatos suficientes").otherwise(c("match_note"))})
    return context.reason_taxonomy(links)


def recent_assets(spark: SparkSession, d: str) -> DataFrame:
    return context.recent_assets(view(spark, d, "assets"), view(spark, d, "listings"))


_ADDRESS = "CASE p_partkey % 5 WHEN 0 THEN concat('C/ ', p_name, ' ', CAST(p_partkey AS STRING), ', 3º B, 28009 Madrid') WHEN 1 THEN concat('Avda. de ', p_name, ' ', CAST(p_partkey AS STRING), ' portal 2, Madrid') WHEN 2 THEN concat('Calle de ', p_name, ' número ', CAST(p_partkey AS STRING)) WHEN 3 THEN concat(p_name, ' - Madrid') ELSE NULL END"


def address_base(spark: SparkSession, d: str) -> DataFrame:
    a = F.expr(_ADDRESS)
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), addresses.address_base(a).alias("address_base"), addresses.address_key(a).alias("address_key"))


QUERIES = {f.__name__: f for f in (license_signals, population_latest, street_catalog, address_points, nearest_house_number, boundary_metrics, reason_taxonomy, recent_assets, address_base)}

_LI = "li AS (SELECT r_name AS district, n_name AS neighborhood, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind, o_orderstatus AS use FROM orders JOIN nation ON n_nationkey = o_custkey % 25 JOIN region ON r_regionkey = n_regionkey)"
_LEVEL = lambda name: f"SELECT '{name}' AS zone_level, {name} AS zone_key, count(*) AS total, count(*) FILTER (use = 'O') AS residential, count(*) FILTER (kind LIKE '1%') AS change_of_use FROM li WHERE day >= DATE '1996-01-01' GROUP BY 2"
_PTS = "pt AS (SELECT id % 40 AS code, id * 13 % 400 AS number, id AS row_no, CASE WHEN id % 3 <> 0 THEN 'd' END AS district, CASE WHEN id % 5 <> 0 THEN 'n' END AS neighborhood, CASE WHEN id % 2 = 0 THEN price_eur END AS lat, CASE WHEN id % 2 = 0 THEN area_m2 END AS lon FROM listings)"
ORACLES = {
    "license_signals": f"WITH {_LI} {_LEVEL('district')} UNION ALL {_LEVEL('neighborhood')}",
    "population_latest": "SELECT l_orderkey AS listing_id, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price_eur FROM lineitem WHERE CAST(l_shipdate AS DATE) = (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)",
    "street_catalog": """WITH s AS (SELECT p_partkey AS row_no, p_partkey * 7 % 1999 AS code, CASE WHEN p_partkey % 2 = 0 THEN 'calle' ELSE 'avenida' END AS t, p_name AS street_name FROM part),
        n AS (SELECT street_name, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM s GROUP BY 1)
        SELECT street_name, lookup_key, first_code, codes FROM (SELECT street_name, t || '|' || street_name AS lookup_key, arg_min(code, row_no) AS first_code FROM s GROUP BY 1, 2) q JOIN n USING (street_name)""",
    "address_points": cte("listings") + f", {_PTS} SELECT code, number, district, neighborhood, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY code, number ORDER BY (district IS NOT NULL)::INT + (neighborhood IS NOT NULL)::INT + (lat IS NOT NULL)::INT + (lon IS NOT NULL)::INT DESC, row_no) AS k FROM pt) q WHERE k = 1",
    "nearest_house_number": cte("listings") + f", {_PTS} SELECT id, number FROM (SELECT p_partkey AS id, number, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(number - p_partkey * 3 % 420), number) AS k FROM part JOIN (SELECT DISTINCT code, number FROM pt) x ON code = p_partkey % 40 AND abs(number - p_partkey * 3 % 420) <= 6) q WHERE k = 1",
    "boundary_metrics": SCORED + " SELECT lower(n_name) AS name, zone_capture_score AS value FROM nation JOIN z ON replace(lower(zone_label), '_', '') = replace(lower(n_name), '_', '') ORDER BY value DESC, name LIMIT 12",
    "reason_taxonomy": cte("flow_items", "links") + """, pf AS (SELECT phone_norm, CASE WHEN a = 1 AND b <= 1 AND c <= 1 THEN 'owner_like' WHEN a >= 4 OR b >= 3 OR c >= 3 THEN 'broker_like' ELSE 'unknown' END AS profile
            FROM (SELECT phone_norm, count(DISTINCT l.id) AS a, count(DISTINCT asset_id) AS b, count(DISTINCT source_portal) AS c FROM listings l JOIN contacts k ON k.id = l.contact_id GROUP BY 1) t)
        SELECT flow_item_id, CASE WHEN match_status = 'resolved' THEN CASE WHEN match_score >= 90 THEN 'resolved_strong' ELSE 'resolved_soft' END WHEN match_status = 'ambiguous' THEN 'ambiguous_multiple_candidates' WHEN match_status = 'pending' THEN 'pending_review'
            WHEN flow_item_id % 10 = 1 THEN CASE WHEN flow_item_id % 4 = 1 THEN 'not_in_csv_yet' ELSE 'no_candidates' END WHEN flow_item_id % 2 = 0 AND f.listing_url IS NULL AND f.contact_phone IS NULL THEN 'zone_only_address'
            WHEN profile = 'broker_like' THEN 'repeated_phone_conflict' WHEN flow_item_id % 7 = 0 THEN 'price_conflict' ELSE 'weak_identity' END AS reason
        FROM links JOIN flow_items f ON f.id = flow_item_id LEFT JOIN pf ON pf.phone_norm = '+34' || f.contact_phone""",
    "recent_assets": cte("assets", "listings") + " SELECT id, coalesce(n, 0) AS listings, m AS latest_listing FROM (SELECT id FROM assets ORDER BY id DESC LIMIT 50) a LEFT JOIN (SELECT asset_id, count(*) AS n, max(id) AS m FROM listings GROUP BY 1) l ON l.asset_id = a.id",
    "address_base": """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'calle ' || p_name || ', ' || p_partkey WHEN 1 THEN 'avenida ' || p_name || ', ' || p_partkey WHEN 2 THEN 'calle ' || p_name || ', ' || p_partkey WHEN 3 THEN p_name END AS address_base,
        CASE p_partkey % 5 WHEN 0 THEN 'calle' || p_name WHEN 1 THEN 'avenida' || p_name WHEN 2 THEN 'calle' || p_name WHEN 3 THEN p_name END AS address_key FROM part""",
}
