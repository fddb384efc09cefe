"""Report queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions.numbers import split_district_list
from plotline.operators import profiles, radar, reports
from plotline.plans.sample import cte, view
from plotline.plans.zone_queries import Stages, placed_assets, scored_v2
from plotline.plans.zone_sql import BASE, MEAN, SCORED

_R = lambda x, n: f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"


def link_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.link_report(view(spark, d, "flow_items"), view(spark, d, "links"), view(spark, d, "market_events"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return view(spark, d, "reviews").withColumns({"reviewer": F.when(c("id") % 3 > 0, F.concat(F.lit("R"), (c("id") % 5).cast("string"))), "source_channel": F.when(c("id") % 2 == 0, "Flow")})


def matching_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.matching_report(_reviews(spark, d))


def review_counters(spark: SparkSession, d: str) -> DataFrame:
    return reports.review_counters(_reviews(spark, d))


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    v = lambda n: view(spark, d, n)
    listings = v("listings").withColumn("listing_url", F.when(c("id") % 5 > 0, F.concat(F.lit("https://x/"), (c("id") % 997).cast("string"))))
    return reports.integrity_report(v("assets"), listings, v("snapshots"), v("market_events"))


def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    items = view(spark, d, "flow_items").select(F.when(c("id") % 9 > 0, c("event_datetime")).alias("alert_datetime"), (c("id") % 4 + 1).alias("occurrence_count"), (c("id") % 2 == 0).alias("resolved"), "listing_url")
    return reports.overlap_report(items, profiles.snapshot_window(view(spark, d, "market_events").where("event_type = 'sold'").select(c("event_datetime").alias("snapshot_datetime"))))


def population_levels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = view(spark, d, "snapshots").select(c("snapshot_datetime").cast("date").alias("day"), (c("listing_id") % 21).cast("string").alias("district"), F.when(c("listing_id") % 3 > 0, (c("listing_id") % 131).cast("string")).alias("neighborhood"), "price_eur")
    return reports.population_levels(rows).select("zone_level", "district", "neighborhood", "price_eur")


def table_freshness(spark: SparkSession, d: str) -> DataFrame:
    v = lambda n: view(spark, d, n)
    day = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return reports.table_freshness({"assets": (v("assets"), None), "listings": (v("listings"), day("updated_at")), "market_events": (v("market_events"), day("event_datetime")), "flow_items": (v("flow_items"), day("event_datetime"))})


def boundary_layers(spark: SparkSession, d: str) -> DataFrame:
    names = view(spark, d, "nation").select(F.lit("neighborhoods").alias("level"), F.col("n_name").alias("name")).unionByName(view(spark, d, "region").select(F.lit("districts").alias("level"), F.col("r_name").alias("name")))
    zones, out = scored_v2(spark, d), None
    for metric in reports.ZONE_METRICS:
        part = reports.boundary_layers(names, zones, metric, min_score=20.0).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out


def recent_asset_details(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    a = view(spark, d, "assets").withColumn("building_id", F.when(c("id") % 7 > 0, c("id") - c("id") % 4))
    b = view(spark, d, "assets").select("id", F.substring_index("address_raw", ",", 1).alias("address_base"))
    return reports.recent_asset_details(a, view(spark, d, "listings"), b).withColumn("listings", F.array_join(F.transform("listings", lambda x: x.cast("string")), ","))


def zone_latest_events(spark: SparkSession, d: str) -> DataFrame:
    stages = Stages(spark, d)
    return radar.zone_latest_events(stages.events, stages.assets).select("zone_label", "place", "event_id", "event_type", "asset_id", "listing_id")


def zone_means(spark: SparkSession, d: str) -> DataFrame:
    return radar.zone_means(placed_assets(spark, d), view(spark, d, "listings"))


def district_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(' 0', CAST(p_partkey % 21 AS STRING), '-', CAST(p_partkey % 19 AS STRING), ' - ') WHEN 1 THEN concat(CAST(p_partkey AS STRING), '/ ', CAST(p_partkey % 7 AS STRING), '-', p_name) WHEN 2 THEN p_name END")
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(split_district_list(text), "|").alias("districts"))


QUERIES = {f.__name__: f for f in (link_report, matching_report, review_counters, integrity_report, overlap_report, population_levels, table_freshness, boundary_layers, recent_asset_details, zone_latest_events, zone_means, district_lists)}

_RV = cte("reviews") + ", rv AS (SELECT *, CASE WHEN id % 3 > 0 THEN 'r' || id % 5 ELSE 'unknown' END AS reviewer, CASE WHEN id % 2 = 0 THEN 'flow' ELSE 'unknown' END AS source FROM reviews)"
_SIDE = "tp + fn + fp + tn"
_OV = "place, count(*) AS alerts, CAST(sum(occ) AS BIGINT) AS occurrences, count(*) FILTER (NOT resolved) AS unresolved, count(DISTINCT url) AS urls, count(DISTINCT url) FILTER (NOT resolved) AS unresolved_urls"
_B = " UNION ALL ".join(f"SELECT '{m}' AS metric, level, name, zone_label, coalesce({c}, 0) AS value FROM b JOIN z ON lower(name) = lower(zone_label) WHERE coalesce({c}, 0) >= 20" for m, c in reports.ZONE_METRICS.items())
ORACLES = {
    "link_report": cte("flow_items", "links", "market_events") + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (match_status = '{s}') AS {s}" for s in ("resolved", "unresolved", "ambiguous", "pending"))
    + ", count(listing_id) AS linked, (SELECT count(*) FROM flow_items) AS items, (SELECT count(*) FROM market_events WHERE source_channel = 'flow') AS events_created FROM links",
    "matching_report": _RV + f""", m AS (SELECT count(*) AS reviews_total, count(*) FILTER (predicted_status = 'resolved' AND review_label = 'match') AS tp, count(*) FILTER (predicted_status = 'resolved' AND review_label = 'no_match') AS fp,
        count(*) FILTER (predicted_status <> 'resolved' AND review_label = 'match') AS fn, count(*) FILTER (predicted_status <> 'resolved' AND review_label = 'no_match') AS tn, count(*) FILTER (review_label = 'match') AS positive,
        count(*) FILTER (review_label = 'no_match') AS negative, count(*) FILTER (review_label IN ('uncertain', 'ambiguous', 'skip')) AS uncertain, count(*) FILTER (predicted_status = 'resolved') AS accepted, count(*) FILTER (predicted_status <> 'resolved') AS rejected,
        {_R('CAST(sum(CAST(floor(predicted_score * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / (count(predicted_score) * 1e6)', 4)} AS mean_score FROM rv)
        SELECT *, {_R('tp::DOUBLE / (tp + fp)', 4)} AS precision, {_R('tp::DOUBLE / (tp + fn)', 4)} AS recall, {_R(f'(tp + tn)::DOUBLE / ({_SIDE})', 4)} AS accuracy FROM m""",
    "review_counters": _RV + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {x} AS value, count(*) AS n FROM rv GROUP BY 2" for k, x in (("label", "review_label"), ("status", "predicted_status"), ("source", "source"), ("reviewer", "reviewer"))),
    "integrity_report": cte("assets", "listings", "snapshots", "market_events") + " " + " UNION ALL ".join(f"SELECT 'count' AS kind, '{t}' AS value, count(*) AS n FROM {x}" for t, x in (("assets", "assets"), ("listings", "listings"), ("snapshots", "snapshots"), ("events", "market_events"), ("sheet_events", "market_events WHERE source_channel = 'csv'")))
    + " UNION ALL SELECT 'duplicate_url', 'https://x/' || id % 997, count(*) FROM listings WHERE id % 5 > 0 GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'suspicious', address_norm || '|' || asset_type_detail || '|' || CAST(floor(area_m2 + 0.5) AS BIGINT), count(*) FROM assets GROUP BY 2 HAVING count(*) > 1",
    "overlap_report": cte("flow_items", "market_events") + f""", w AS (SELECT CAST(min(event_datetime) AS DATE) AS lo, CAST(max(event_datetime) AS DATE) AS hi FROM market_events WHERE event_type = 'sold'),
        a AS (SELECT CASE WHEN id % 9 = 0 THEN 'without_date' WHEN CAST(event_datetime AS DATE) < lo THEN 'before' WHEN CAST(event_datetime AS DATE) > hi THEN 'after' ELSE 'inside' END AS place, id % 4 + 1 AS occ, id % 2 = 0 AS resolved, listing_url AS url FROM flow_items CROSS JOIN w)
        SELECT {_OV} FROM a GROUP BY 1 UNION ALL SELECT 'all' AS {_OV} FROM a""",
    "population_levels": cte("snapshots") + " SELECT CASE WHEN listing_id % 3 > 0 THEN 'neighborhood' ELSE 'district' END AS zone_level, CAST(listing_id % 21 AS VARCHAR) AS district, CASE WHEN listing_id % 3 > 0 THEN CAST(listing_id % 131 AS VARCHAR) END AS neighborhood, price_eur FROM snapshots WHERE CAST(snapshot_datetime AS DATE) = (SELECT max(CAST(snapshot_datetime AS DATE)) FROM snapshots)",
    "table_freshness": cte("assets", "contacts", "listings", "market_events", "flow_items") + " SELECT 'assets' AS name, count(*) AS n, max(id) AS max_id, NULL AS updated FROM assets" + "".join(f" UNION ALL SELECT '{t}', count(*), max(id), max(strftime({x}, '%Y-%m-%d %H:%M:%S')) FROM {t}" for t, x in (("listings", "updated_at"), ("market_events", "event_datetime"), ("flow_items", "event_datetime"))),
    "boundary_layers": SCORED + f" SELECT *, count(*) OVER (PARTITION BY metric, level) AS matched_count FROM (WITH b AS (SELECT 'neighborhoods' AS level, n_name AS name FROM nation UNION ALL SELECT 'districts', r_name FROM region) {_B}) q",
    "recent_asset_details": cte("assets", "listings") + """ SELECT a.id, building_id, b.address_base, coalesce(l.listings, '') AS listings FROM (SELECT id, CASE WHEN id % 7 > 0 THEN id - id % 4 END AS building_id FROM assets ORDER BY id DESC LIMIT 300) a
        LEFT JOIN (SELECT id AS bid, split_part(address_raw, ',', 1) AS address_base FROM assets) b ON b.bid = a.building_id LEFT JOIN (SELECT asset_id, array_to_string(list_reverse_sort(list(id)), ',') AS listings FROM listings GROUP BY 1) l ON l.asset_id = a.id""",
    "zone_latest_events": BASE.rstrip().rstrip(",") + " SELECT zone_label, CAST(place AS INTEGER) AS place, event_id, event_type, asset_id, listing_id FROM (SELECT za.zone_label, ev.*, row_number() OVER (PARTITION BY za.zone_label ORDER BY event_datetime DESC, event_id DESC) AS place FROM ev JOIN za ON za.id = ev.asset_id) q WHERE place <= 20",
    "zone_means": BASE.rstrip().rstrip(",") + f" SELECT za.zone_label, count(*) AS listings_count, count(DISTINCT asset_id) AS assets_count, {MEAN('price_eur')} AS avg_price_eur, {MEAN('price_per_m2')} AS avg_price_m2 FROM listings l JOIN za ON za.id = l.asset_id GROUP BY 1",
    "district_lists": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '0' || p_partkey % 21 || '|' || p_partkey % 19 WHEN 1 THEN p_partkey || '|' || p_partkey % 7 || '-' || p_name WHEN 2 THEN p_name ELSE '' END AS districts FROM part",
}
