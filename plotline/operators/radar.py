"""Rank tables, summaries, zone comparison and map (A-19 to A-21, P-07, T-01 to T-04, W-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.numbers import rounded
from plotline.functions.text import text_key
from plotline.operators.zones import winsorize

#: Order of each rank table, best first; a minus sign is ascending.
KINDS = {
    "capture": ["zone_capture_score_sort", "zone_confidence_score", "zone_heat_score"],
    "heat": ["zone_heat_score_sort", "zone_relative_heat_score", "events_per_10k", "zone_confidence_score"],
    "pressure": ["zone_pressure_score_sort", "price_drop_count", "zone_confidence_score"],
    "transformation": ["zone_transformation_signal_score", "change_of_use_rate", "closed_rate", "zone_confidence_score"],
    "liquidity": ["zone_liquidity_score_sort", "absorption_count", "zone_confidence_score"],
    "predictive": ["predicted_absorption_score", "zone_liquidity_score", "zone_relative_heat_score", "zone_confidence_score"],
    "low_confidence": ["-zone_confidence_score", "raw_in_zone"],
}


def top(df: DataFrame, keys: list[str], k: int, last: str) -> DataFrame:
    """The first k rows by ``keys`` (nulls as 0), ties by ``last`` ascending."""
    order = [F.coalesce(F.col(x.lstrip("-")).cast("double"), F.lit(0.0)) for x in keys]
    return df.orderBy(*[o.asc() if x.startswith("-") else o.desc() for o, x in zip(order, keys, strict=True)], F.col(last).asc()).limit(k)


def radar(zones: DataFrame, kind: str, k: int = 12) -> DataFrame:
    """T-01: the zones of one rank table."""
    return top(winsorize(zones, ["zone_capture_score", "zone_heat_score", "zone_pressure_score", "zone_liquidity_score"]), KINDS[kind], k, "zone_label")


def top_microzones(micro: DataFrame, k: int = 12) -> DataFrame:
    """T-01: the hottest cells."""
    return top(micro, ["microzone_capture_score", "microzone_concentration_score", "microzone_confidence_score", "events_14d"], k, "microzone_label")


def _by_kind(df: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, rows in kinds.items():
        part = rows.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def radar_v1(zones: DataFrame, k: int = 12) -> DataFrame:
    """T-02: the best by opportunity, saturation and activity, with their kind."""
    keys = {"opportunity": ["zone_opportunity_score", "zone_activity_score"], "saturation": ["zone_saturation_score"], "activity": ["zone_activity_score"]}
    return _by_kind(zones, {n: top(zones, x, k, "zone_label") for n, x in keys.items()})


def dashboard_tops(zones: DataFrame, k: int = 8) -> DataFrame:
    """T-03: zones of low confidence (those without a zone first), of transformation and of predicted absorption."""
    low = zones.where("zone_confidence_score < 40").withColumn("_none", (F.col("zone_label") == "Sin zona").cast("int"))
    change = zones.where("zone_transformation_signal_score > 0")
    soon = zones.where("predicted_absorption_score > 0")
    return _by_kind(
        zones,
        {
            "low_confidence": top(low, ["_none", "raw_in_zone", "-zone_confidence_score"], k, "zone_label").drop("_none"),
            "transformation": top(change, ["zone_transformation_signal_score", "change_of_use_rate", "closed_rate"], k, "zone_label"),
            "predictive": top(soon, ["predicted_absorption_score", "zone_liquidity_score", "zone_relative_heat_score"], k, "zone_label"),
        },
    )


def radar_summary(zones: DataFrame, micro: DataFrame) -> DataFrame:
    """A-20: one row of counts over thresholds."""
    at = lambda c, n: F.count_if(F.coalesce(F.col(c), F.lit(0.0)) >= n)
    z = zones.agg(
        F.count("*").alias("zones_total"), at("zone_confidence_score", 60).alias("high_confidence_zones"), F.count_if(F.coalesce("zone_confidence_score", F.lit(0.0)) < 40).alias("low_confidence_zones"),
        F.count_if((F.col("zone_capture_score") >= 60) & (F.col("zone_confidence_score") >= 50)).alias("capture_ready_zones"), at("zone_heat_score", 65).alias("hot_zones"),
        at("zone_relative_heat_score", 65).alias("relative_hot_zones"), at("zone_transformation_signal_score", 65).alias("transform_zones"), at("predicted_absorption_score", 65).alias("predictive_zones"),
    )
    return z.crossJoin(F.broadcast(micro.agg(F.count("*").alias("microzones_total"), at("microzone_capture_score", 65).alias("microzone_hotspots"))))


def zone_focus_compare(zones: DataFrame) -> DataFrame:
    """W-13: for every two zones and each focus, both scores and the winner (ties: the first). As many rows as pairs of zones, which are few."""
    c = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    heat = F.coalesce(F.when(F.col("zone_relative_heat_score") != 0, F.col("zone_relative_heat_score")), F.col("zone_heat_score"), F.lit(0.0))
    focus = {
        "capture": c("zone_capture_score"), "confidence": c("zone_confidence_score"), "transformation": c("zone_transformation_signal_score"), "heat": heat,
        "pressure": c("zone_pressure_score"), "liquidity": c("zone_liquidity_score"), "predictive": c("predicted_absorption_score"),
        "overall": rounded(0.36 * c("zone_capture_score") + 0.22 * c("zone_confidence_score") + 0.16 * heat + 0.14 * c("zone_transformation_signal_score") + 0.12 * c("zone_liquidity_score"), 1),
    }
    long = zones.select("zone_label", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in focus]), F.array(*focus.values()))).alias("focus", "value"))
    a, b = (long.select("focus", F.col("zone_label").alias(f"zone_{x}"), F.col("value").alias(f"score_{x}")) for x in "ab")
    pairs = a.join(b, "focus").where("zone_a < zone_b")
    return pairs.withColumn("winner", F.when(F.col("score_a") >= F.col("score_b"), F.col("zone_a")).otherwise(F.col("zone_b")))


def filter_microzones(micro: DataFrame, *, min_score: float = 0.0, query: str = "") -> DataFrame:
    """P-07: cells with a centroid, of a least score, whose label holds a key."""
    out = micro.where((F.col("microzone_capture_score") >= min_score) & F.col("centroid_lat").isNotNull())
    return out.where(text_key(F.col("microzone_label")).contains(query)) if query else out


def map_points(queue: DataFrame, limit: int) -> DataFrame:
    """T-04: the best opportunities with a point, and the weight of their heat."""
    best = top(queue.where("has_geo_point"), ["score"], limit, "event_id")
    return best.select("event_id", "lat", "lon", "score", "priority_label", F.least(F.greatest(F.col("score") / 80.0, F.lit(0.2)), F.lit(1.0)).alias("heat_weight"))


def map_viewport(points: DataFrame) -> DataFrame:
    """A-21: centre (summed in whole millionths) and bounds of all points."""
    p = points.where("lat is not null and lon is not null")
    mean = lambda x: rounded(F.sum(F.floor(F.col(x) * 1e6 + 0.5)).cast("double") / (F.count(x) * 1000000), 6)
    return p.agg(F.count("*").alias("n"), mean("lat").alias("center_lat"), mean("lon").alias("center_lon"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def zone_detail(assets: DataFrame, listings: DataFrame, contacts: DataFrame, k: int = 10) -> DataFrame:
    """A-19: for every zone the k most frequent portals, types and phones. Counted before they are ranked."""
    zone_of = assets.select(F.col("id").alias("asset_id"), "zone_label", F.coalesce("asset_type_detail", "asset_type_family").alias("asset_type_detail"))
    placed = listings.join(zone_of, "asset_id").join(contacts.select(F.col("id").alias("contact_id"), "phone_raw"), "contact_id", "left")
    long = placed.select("zone_label", F.explode(F.map_from_arrays(F.array(F.lit("portal"), F.lit("type"), F.lit("phone")), F.array("source_portal", "asset_type_detail", "phone_raw"))).alias("kind", "value"))
    counts = long.where("value is not null").groupBy("zone_label", "kind", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("zone_label", "kind").orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def zone_latest_events(events: DataFrame, assets: DataFrame, k: int = 20) -> DataFrame:
    """A-19: the ``k`` newest events of every zone (ties: the highest id), by the zone of the event's asset. ``events`` have their asset (J-16)."""
    zone_of = assets.select(F.col("id").alias("asset_id"), "zone_label")
    placed = events.join(zone_of, "asset_id").select("zone_label", F.col("id").alias("event_id"), "event_type", "event_datetime", "asset_id", "listing_id")
    order = [F.col("event_datetime").desc_nulls_last(), F.col("event_id").desc()]
    # a zone may have a third of all events: the best of each of its shares first
    shares = placed.withColumn("_share", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    best = shares.withColumn("_n", F.row_number().over(Window.partitionBy("zone_label", "_share").orderBy(*order))).where(F.col("_n") <= k)
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("zone_label").orderBy(*order))).where(F.col("place") <= k)
    return ranked.drop("_share", "_n")


def zone_means(assets: DataFrame, listings: DataFrame) -> DataFrame:
    """A-19, first version: listings, assets, mean price and mean price a metre of every zone's listings; means in whole hundredths."""
    zone_of = assets.select(F.col("id").alias("asset_id"), "zone_label")
    mean = lambda x: rounded(F.sum(F.floor(F.col(x) * 100 + 0.5)).cast("double") / (F.count(x) * 100), 2)
    return listings.join(zone_of, "asset_id").groupBy("zone_label").agg(F.count("*").alias("listings_count"), F.countDistinct("asset_id").alias("assets_count"), mean("price_eur").alias("avg_price_eur"), mean("price_per_m2").alias("avg_price_m2"))
