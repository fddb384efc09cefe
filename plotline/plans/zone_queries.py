"""Zone, microzone, opportunity and radar queries, and their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions.labels import with_zone
from plotline.operators import opportunities, profiles, radar, zones
from plotline.plans.sample import AS_OF, kept, view


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def placed_assets(spark: SparkSession, d: str) -> DataFrame:
    return with_zone(view(spark, d, "assets"), view(spark, d, "zone_context"))


def placed_flow(spark: SparkSession, d: str) -> DataFrame:
    items = kept(view(spark, d, "flow_items").select("id", "address_raw", F.lit(None).cast("string").alias("neighborhood"), F.lit(None).cast("string").alias("district")), "flow")
    return with_zone(items, view(spark, d, "zone_context"))


class Stages:
    """The stage graph of one query: each stage is written when it is first asked for, and later stages scan it."""

    def __init__(self, spark: SparkSession, d: str):
        self.view = lambda n: view(spark, d, n)
        self.flow = lambda: placed_flow(spark, d)
        self.raw_assets = lambda: placed_assets(spark, d)

    @cached_property
    def assets(self) -> DataFrame:
        return kept(self.raw_assets(), "assets")

    @cached_property
    def listings(self) -> DataFrame:
        return kept(self.view("listings"), "listings")

    @cached_property
    def profiles(self) -> DataFrame:
        return kept(profiles.phone_profiles(self.listings, self.view("contacts")), "phone-profiles")

    @cached_property
    def events(self) -> DataFrame:
        """Market events with the asset of the event, or else of its listing."""
        return kept(profiles.event_asset(self.view("market_events"), self.listings), "events")

    @cached_property
    def features(self) -> DataFrame:
        v = self.view
        found = zones.zone_features_v2(self.assets, self.listings, v("contacts"), self.events, self.flow(), v("zone_context"), as_of=as_of(), phones=self.profiles, freshness=profiles.freshness_days(v("runs"), as_of()))
        return kept(found, "zone-features")

    @cached_property
    def zones(self) -> DataFrame:
        """Scored zones, a row for each."""
        return kept(zones.zone_prediction(zones.zone_scores_v2(zones.worth_keeping(self.features))), "zones")

    @cached_property
    def microzones(self) -> DataFrame:
        """Scored cells, a row for each."""
        cells = kept(zones.microzone_features(self.assets, self.listings, self.events, self.zones, as_of=as_of()), "cells")
        return kept(zones.microzone_scores(cells), "scored-cells")

    def queue(self, limit: int | None = None) -> DataFrame:
        return opportunities.opportunity_queue(self.events, self.assets, self.listings, self.view("contacts"), self.zones, self.microzones, as_of=as_of(), limit=limit, phones=self.profiles)


def features_v2(spark: SparkSession, d: str) -> DataFrame:
    return Stages(spark, d).features


def scored_v2(spark: SparkSession, d: str) -> DataFrame:
    return Stages(spark, d).zones


def scored_microzones(spark: SparkSession, d: str) -> DataFrame:
    return Stages(spark, d).microzones


FEATURES = [
    "zone_label", "assets_count", "listings_count", "active_listings_count", "contacts_count", "unique_phone_count", "owner_like_phone_count", "broker_like_phone_count",
    "broker_phone_share", "owner_phone_share", "avg_price_eur", "avg_price_m2", "avg_area_m2", "asset_type_diversity", "portal_diversity", "top_portal", "listings_per_asset",
    "events_7d", "events_14d", "events_30d", "listing_detected_count", "price_drop_count", "reserved_count", "sold_count", "expired_count", "absorption_count", "net_new_supply",
    "resolved_events", "raw_in_zone", "unresolved_estimated", "resolved_ratio", "geo_neighborhood_assets", "geo_district_assets", "geo_point_assets", "geo_coverage_ratio",
    "population", "assets_per_1k", "active_listings_per_1k", "events_per_10k", "detected_per_10k", "drops_per_10k", "absorption_per_10k", "raw_per_10k", "freshness_days",
]
SCORES = ["saturation", "heat", "relative_heat", "transformation_signal", "pressure", "liquidity", "confidence", "capture"]
SCORE_COLUMNS = [f"zone_{s}_score" for s in SCORES]
MICRO = ["microzone_label", "parent_zone_label", "assets_count", "listings_count", "active_listings_count", "events_14d", "listing_detected_count", "price_drop_count", "absorption_count", "avg_price_m2", "centroid_lat", "centroid_lon", "assets_share_in_parent", "events_share_in_parent", "events_per_asset"]
MICRO_SCORES = ["microzone_concentration_score", "microzone_local_intensity_score", "microzone_capture_score", "microzone_confidence_score", "recommended_action"]


def phone_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.phone_profiles(view(spark, d, "listings"), view(spark, d, "contacts"))


def infer_zone(spark: SparkSession, d: str) -> DataFrame:
    return placed_assets(spark, d).select("id", "zone_label")


def zone_features_v1(spark: SparkSession, d: str) -> DataFrame:
    return zones.zone_features_v1(placed_assets(spark, d), view(spark, d, "listings"))


def zone_features_v2(spark: SparkSession, d: str) -> DataFrame:
    return features_v2(spark, d).select(*FEATURES)


def freshness_days(spark: SparkSession, d: str) -> DataFrame:
    return profiles.freshness_days(view(spark, d, "runs"), as_of())


def alert_zone_features(spark: SparkSession, d: str) -> DataFrame:
    return opportunities.alert_zone_features(alerts(spark, d))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the sample: every flow item, resolved by even ids."""
    items = placed_flow(spark, d)
    return items.select("zone_label", (F.col("id") % 4 + 1).alias("occurrence_count"), (F.col("id") % 2 == 0).alias("resolved"))


def zone_scores_v1(spark: SparkSession, d: str) -> DataFrame:
    z = kept(zone_features_v1(spark, d)).join(alert_zone_features(spark, d), "zone_label", "left").na.fill(0, ["alerts_in_window", "occurrences_in_window", "resolved_in_window"])
    return zones.zone_scores_v1(kept(z)).select("zone_label", "zone_saturation_score", "zone_activity_score", "zone_opportunity_score", "confidence_ratio", "recommended_action")


def zone_scores_v2(spark: SparkSession, d: str) -> DataFrame:
    return scored_v2(spark, d).select("zone_label", *SCORE_COLUMNS, "geo_point_ratio", "recommended_action")


def zone_prediction(spark: SparkSession, d: str) -> DataFrame:
    return scored_v2(spark, d).select("zone_label", "predicted_absorption_score", "predicted_absorption_band", "predicted_action_window_days")


def microzone_features(spark: SparkSession, d: str) -> DataFrame:
    return scored_microzones(spark, d).select(*MICRO)


def microzone_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored_microzones(spark, d).select("microzone_label", *MICRO_SCORES)


def queue(spark: SparkSession, d: str, limit: int | None = None) -> DataFrame:
    return Stages(spark, d).queue(limit)


QUEUE = ["event_id", "event_type", "zone_label", "asset_id", "listing_id", "contact_id", "contact_phone", "phone_profile", "price_drop_pct", "score_event_base", "score_recency", "score_price_signal", "score_zone_signal", "score_microzone_signal", "score_predictive_signal", "score_geo_signal", "predicted_opportunity_score", "predicted_opportunity_band", "score", "priority_label", "reason"]


def opportunity_queue(spark: SparkSession, d: str) -> DataFrame:
    return queue(spark, d).select(*QUEUE)


def opportunity_top(spark: SparkSession, d: str) -> DataFrame:
    return queue(spark, d, 100).select("event_id", "score", "priority_label")


def filter_opportunities(spark: SparkSession, d: str) -> DataFrame:
    return opportunities.filter_opportunities(queue(spark, d), event_type="price_drop", with_geo=True, min_score=40.0, zone_query="nation_1").select("event_id", "score", "zone_label")


def opportunity_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(queue(spark, d))
    return opportunities.opportunity_groups(rows, "zone").unionByName(opportunities.opportunity_groups(rows, "event_type")).unionByName(opportunities.opportunity_groups(rows, "contact"))


def select_group(spark: SparkSession, d: str) -> DataFrame:
    return opportunities.select_group(queue(spark, d), "event_type", "sold").select("event_id", "score")


def best_listing(spark: SparkSession, d: str) -> DataFrame:
    a = profiles.best_listing(view(spark, d, "listings")).select("asset_id", F.col("id").alias("cheapest_id"))
    b = profiles.best_listing(view(spark, d, "listings"), newest=True).select("asset_id", F.col("id").alias("newest_id"))
    return a.join(b, "asset_id")


def event_asset(spark: SparkSession, d: str) -> DataFrame:
    return profiles.event_asset(view(spark, d, "market_events"), view(spark, d, "listings")).select("id", "asset_id")


def snapshot_window(spark: SparkSession, d: str) -> DataFrame:
    w = profiles.snapshot_window(view(spark, d, "snapshots"))
    return w.select(F.date_format("min_dt", "yyyy-MM-dd HH:mm:ss").alias("min_dt"), F.date_format("max_dt", "yyyy-MM-dd HH:mm:ss").alias("max_dt"))


def zone_context(spark: SparkSession, d: str) -> DataFrame:
    return zones.zone_context(placed_assets(spark, d).select("zone_label").distinct(), view(spark, d, "zone_context"))


def winsorize(spark: SparkSession, d: str) -> DataFrame:
    return zones.winsorize(scored_v2(spark, d), ["zone_capture_score", "zone_heat_score"]).select("zone_label", F.round("zone_capture_score_sort", 4).alias("capture_sort"), F.round("zone_heat_score_sort", 4).alias("heat_sort"))


def radar_top(spark: SparkSession, d: str) -> DataFrame:
    return radar.radar(scored_v2(spark, d), "capture").select("zone_label", "zone_capture_score", "zone_confidence_score", "recommended_action")


def radar_all(spark: SparkSession, d: str) -> DataFrame:
    z = scored_v2(spark, d)
    out = None
    for kind in radar.KINDS:
        part = radar.radar(z, kind).select(F.lit(kind).alias("kind"), "zone_label")
        out = part if out is None else out.unionByName(part)
    return out


def radar_microzones(spark: SparkSession, d: str) -> DataFrame:
    return radar.top_microzones(scored_microzones(spark, d)).select("microzone_label", "microzone_capture_score")


def radar_summary(spark: SparkSession, d: str) -> DataFrame:
    stages = Stages(spark, d)
    return radar.radar_summary(stages.zones, stages.microzones)


def radar_v1(spark: SparkSession, d: str) -> DataFrame:
    return radar.radar_v1(kept(zone_scores_v1(spark, d))).select("kind", "zone_label")


def dashboard_tops(spark: SparkSession, d: str) -> DataFrame:
    return radar.dashboard_tops(scored_v2(spark, d)).select("kind", "zone_label")


def zone_focus_compare(spark: SparkSession, d: str) -> DataFrame:
    return radar.zone_focus_compare(scored_v2(spark, d))


def map_viewport(spark: SparkSession, d: str) -> DataFrame:
    return radar.map_viewport(view(spark, d, "assets"))


def filter_microzones(spark: SparkSession, d: str) -> DataFrame:
    return radar.filter_microzones(scored_microzones(spark, d), min_score=30.0, query="nation").select("microzone_label", "microzone_capture_score")


def map_points(spark: SparkSession, d: str) -> DataFrame:
    return radar.map_points(queue(spark, d), 200)


def zone_detail(spark: SparkSession, d: str) -> DataFrame:
    return radar.zone_detail(placed_assets(spark, d), view(spark, d, "listings"), view(spark, d, "contacts"))


def opportunity_queue_v1(spark: SparkSession, d: str) -> DataFrame:
    v = lambda n: view(spark, d, n)
    rows = opportunities.opportunity_queue_v1(v("market_events"), placed_assets(spark, d), v("listings"), v("contacts"), scored_v2(spark, d), as_of=as_of(), limit=None)
    return rows.select("event_id", "zone_label", "priority_score")


QUERIES = {
    f.__name__: f
    for f in (
        phone_profiles, infer_zone, zone_features_v1, zone_features_v2, freshness_days, alert_zone_features, zone_scores_v1, zone_scores_v2, zone_prediction, microzone_features, microzone_scores,
        opportunity_queue, opportunity_top, filter_opportunities, opportunity_groups, select_group, best_listing, event_asset, snapshot_window, zone_context, winsorize, radar_top, radar_all, radar_microzones, radar_summary, radar_v1, dashboard_tops, zone_focus_compare,
        map_viewport, filter_microzones, map_points, zone_detail, opportunity_queue_v1,
    )
}
