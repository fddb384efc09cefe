"""Zone features and scores (A-02 to A-06, W-01 to W-05, W-12, J-17, J-22, P-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import bands, geo
from plotline.functions.numbers import rounded
from plotline.operators.profiles import ABSORBED, event_asset, is_active, phone_profiles

EVENT_TYPES = ["listing_detected", "price_drop", "price_raise", "reserved", "sold", "not_available", "expired"]


def mean_cents(c: Column, places: int = 2) -> Column:
    """Mean of values rounded to hundredths, summed exactly and so the same in any order."""
    return rounded(F.sum(F.floor(c * 100 + 0.5)).cast("double") / (F.count(c) * 100), places)


def ratio(a: Column, b: Column, places: int | None = 4) -> Column:
    """a / b, 0 where b is 0 or null."""
    r = a.cast("double") / b.cast("double")
    return F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(rounded(r, places) if places is not None else r)


def outer(base: DataFrame, *others: DataFrame, key: str = "zone_label") -> DataFrame:
    """Full outer join of small aggregates on ``key``."""
    for o in others:
        base = base.join(o, key, "full_outer")
    return base


def top_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def asset_counts(assets: DataFrame, key: str = "zone_label") -> DataFrame:
    """Per zone: assets, kinds and how well they are placed. ``assets`` has one row for each id."""
    kind = F.coalesce("asset_type_detail", "asset_type_family")
    return assets.groupBy(key).agg(
        F.count("*").alias("assets_count"), F.countDistinct(kind).alias("asset_type_diversity"),
        F.count_if(F.col("neighborhood").isNotNull()).alias("geo_neighborhood_assets"),
        F.count_if(F.col("neighborhood").isNull() & F.col("district").isNotNull()).alias("geo_district_assets"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("geo_point_assets"),
    )


def zone_features_v1(assets: DataFrame, listings: DataFrame) -> DataFrame:
    """A-02: counts, means, diversity, top portal. ``assets`` has zone_label; a listing is in its asset's zone."""
    zone_of = assets.select(F.col("id").alias("asset_id"), "zone_label", "asset_type_detail", "asset_type_family")
    placed = listings.join(zone_of, "asset_id", "left").withColumn("zone_label", F.coalesce("zone_label", F.lit("Sin zona")))
    sold = placed.groupBy("zone_label").agg(
        F.count("*").alias("listings_count"), F.countDistinct("contact_id").alias("contacts_count"),
        mean_cents(F.col("price_eur")).alias("avg_price_eur"), mean_cents(F.col("price_per_m2")).alias("avg_price_m2"),
    )
    out = outer(asset_counts(assets), sold, top_value(placed, "zone_label", "source_portal", "top_portal"))
    counts = ["assets_count", "listings_count", "contacts_count", "asset_type_diversity", "geo_neighborhood_assets", "geo_district_assets", "geo_point_assets"]
    out = out.na.fill(0, counts)
    return out.withColumn("listings_per_asset", ratio(F.col("listings_count"), F.col("assets_count"), 3))


def listing_counts(listings: DataFrame, contacts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per zone: listings, contacts, phones by profile and means. ``listings`` has zone_label and one row for each id."""
    phones = listings.select("zone_label", "contact_id").distinct().join(contacts.select(F.col("id").alias("contact_id"), "phone_norm"), "contact_id").select("zone_label", "phone_norm").where("phone_norm is not null").distinct()
    by_phone = phones.join(profiles.select("phone_norm", "phone_profile"), "phone_norm", "left").groupBy("zone_label").agg(
        F.count("*").alias("unique_phone_count"), F.count_if(F.col("phone_profile") == "owner_like").alias("owner_like_phone_count"),
        F.count_if(F.col("phone_profile") == "broker_like").alias("broker_like_phone_count"),
    )
    counts = listings.groupBy("zone_label").agg(
        F.count("*").alias("listings_count"), F.count_if(is_active(F.col("status"))).alias("active_listings_count"),
        F.countDistinct("contact_id").alias("contacts_count"), F.countDistinct("source_portal").alias("portal_diversity"),
        mean_cents(F.col("price_eur")).alias("avg_price_eur"), mean_cents(F.col("price_per_m2")).alias("avg_price_m2"), mean_cents(F.col("area_m2")).alias("avg_area_m2"),
    )
    return outer(counts, by_phone, top_value(listings, "zone_label", "source_portal", "top_portal"))


def event_counts(events: DataFrame, as_of: Column, window_days: int = 14) -> DataFrame:
    """Per zone: all events, those of 7, 14 (``window_days``) and 30 days, and types inside the window."""
    since = lambda d: F.col("event_datetime") >= as_of - F.expr(f"INTERVAL {d} DAYS")
    inside = since(window_days)
    return events.groupBy("zone_label").agg(
        F.count("*").alias("resolved_events"), F.count_if(since(7)).alias("events_7d"), F.count_if(inside).alias("events_14d"), F.count_if(since(30)).alias("events_30d"),
        *[F.count_if(inside & (F.coalesce("event_type", F.lit("history_item")) == t)).alias(f"{t}_count") for t in EVENT_TYPES],
    )


def zone_features_v2(assets: DataFrame, listings: DataFrame, contacts: DataFrame, events: DataFrame, flow_items: DataFrame, context: DataFrame, *, as_of: Column, window_days: int = 14, freshness: DataFrame | int | None = None, channel: str = "flow", phones: DataFrame | None = None) -> DataFrame:
    """A-03: some forty measures for each zone.

    ``assets`` and ``flow_items`` have zone_label. Four aggregates that each shrink to a row for each zone, then a full outer join of these and
    the zones' context (J-17: the neighborhood's, else the district's). ``phones``: the profiles of the phones (A-01), if they are at hand.
    ``freshness``: days since the last good run, or the one row of ``profiles.freshness_days``.
    """
    profiles = phone_profiles(listings, contacts) if phones is None else phones
    zone_of = assets.select(F.col("id").alias("asset_id"), "zone_label")
    in_zone = lambda df: df.join(zone_of, "asset_id", "left").withColumn("zone_label", F.coalesce("zone_label", F.lit("Sin zona")))
    mine = event_asset(events.where(F.col("source_channel") == channel).select("listing_id", "asset_id", "event_type", "event_datetime"), listings)
    raw = flow_items.groupBy("zone_label").agg(F.count("*").alias("raw_in_zone"))
    out = outer(asset_counts(assets), listing_counts(in_zone(listings), contacts, profiles), event_counts(in_zone(mine), as_of, window_days), raw)
    counts = [c for c, t in out.dtypes if t == "bigint"]
    out = out.na.fill(0, counts)
    c = F.col
    out = out.withColumn("absorption_count", sum((c(f"{t}_count") for t in ABSORBED[1:]), c("reserved_count")))
    out = out.withColumns(
        {
            "broker_phone_share": ratio(c("broker_like_phone_count"), c("unique_phone_count")),
            "owner_phone_share": ratio(c("owner_like_phone_count"), c("unique_phone_count")),
            "listings_per_asset": ratio(c("listings_count"), c("assets_count"), 3),
            "net_new_supply": c("listing_detected_count") - c("absorption_count"),
            "unresolved_estimated": F.greatest(c("raw_in_zone") - c("resolved_events"), F.lit(0)),
            "resolved_ratio": ratio(c("resolved_events"), c("raw_in_zone")),
            "geo_coverage_ratio": ratio(c("geo_point_assets"), c("assets_count")),
        }
    )
    age = freshness.select("freshness_days") if isinstance(freshness, DataFrame) else contacts.sparkSession.range(1).select(F.lit(freshness).cast("long").alias("freshness_days"))
    out = zone_context(out, context).crossJoin(F.broadcast(age))  # one row
    rate = lambda n, m: F.when(F.coalesce(c("population"), F.lit(0)) == 0, 0.0).otherwise(rounded(c(n) / c("population") * float(m), 4))
    return out.withColumns(
        {
            "assets_per_1k": rate("assets_count", 1000),
            "active_listings_per_1k": rate("active_listings_count", 1000),
            "events_per_10k": rate("events_14d", 10000),
            "detected_per_10k": rate("listing_detected_count", 10000),
            "drops_per_10k": rate("price_drop_count", 10000),
            "absorption_per_10k": rate("absorption_count", 10000),
            "raw_per_10k": rate("raw_in_zone", 10000),
        }
    )


def zone_context(zones: DataFrame, context: DataFrame) -> DataFrame:
    """J-17: ``zones`` with the context of the neighborhood of that label, else of the district."""
    order = F.struct((F.col("zone_level") != "neighborhood").cast("int"), "zone_name")
    columns = ["population", "change_of_use_24m", "change_of_use_rate", "inspections_rate", "closed_rate", "vut_rate", "zone_level"]
    best = context.groupBy("zone_label").agg(*[F.min_by(x, order).alias(x) for x in columns])
    return zones.join(best, "zone_label", "left")


def worth_keeping(zones: DataFrame) -> DataFrame:
    """P-08: zones with an asset, an event in the window or a raw item."""
    return zones.where("assets_count > 0 or events_14d > 0 or raw_in_zone > 0")


def min_max(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """W-01: ``df`` with each of ``columns`` scaled to 0–1 over all rows; 0.5 if all are equal. One row of bounds, joined back."""
    values = df.withColumns({f"_v_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})
    bounds = values.agg(*[f(f"_v_{k}").alias(f"_{n}_{k}") for k in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = values.crossJoin(F.broadcast(bounds))
    scaled = {k: F.when(F.col(f"_hi_{k}") == F.col(f"_lo_{k}"), 0.5).otherwise((F.col(f"_v_{k}") - F.col(f"_lo_{k}")) / (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))) for k in columns}
    return joined.withColumns(scaled).drop(*[f"_{n}_{k}" for k in columns for n in ("v", "lo", "hi")])


def score(c: Column) -> Column:
    return rounded(c * 100, 1)


def zone_scores_v1(zones: DataFrame) -> DataFrame:
    """W-02: saturation, activity, opportunity, confidence and an action. ``zones`` has alert counts (A-04)."""
    c = F.col
    names = ["listings_count", "listings_per_asset", "contacts_count", "alerts_in_window", "occurrences_in_window", "resolved_in_window", "asset_type_diversity"]
    n = min_max(zones, {f"n_{x}": c(x) for x in names})
    saturation = 0.55 * c("n_listings_count") + 0.25 * c("n_listings_per_asset") + 0.20 * c("n_contacts_count")
    activity = 0.50 * c("n_alerts_in_window") + 0.35 * c("n_occurrences_in_window") + 0.15 * c("n_resolved_in_window")
    confidence = ratio(c("resolved_in_window"), c("alerts_in_window"), None)
    n = n.withColumns({"_s": saturation, "_a": activity, "_c": confidence})
    opportunity = 0.45 * c("_a") + 0.25 * (1 - c("_s")) + 0.15 * c("n_asset_type_diversity") + 0.15 * c("_c")
    n = n.withColumns({"zone_saturation_score": score(c("_s")), "zone_activity_score": score(c("_a")), "zone_opportunity_score": score(opportunity), "confidence_ratio": score(c("_c"))})
    n = n.withColumn("recommended_action", bands.zone_action_v1(c("zone_opportunity_score"), c("zone_saturation_score"), c("zone_activity_score")))
    return n.drop("_s", "_a", "_c", *[f"n_{x}" for x in names])


def zone_scores_v2(zones: DataFrame) -> DataFrame:
    """W-03: saturation, heat, transformation, pressure, liquidity, confidence and capture of each kept zone, and an action."""
    c = F.col
    scaled = {
        "active": c("active_listings_count"), "lpa": c("listings_per_asset"), "broker": c("broker_phone_share"), "events": c("events_14d"), "supply": c("listing_detected_count"),
        "drops": c("price_drop_count"), "absorbed": c("absorption_count"), "resolved": c("resolved_ratio"), "kinds": c("asset_type_diversity"), "portals": c("portal_diversity"),
        "events_pop": c("events_per_10k"), "listings_pop": c("active_listings_per_1k"), "drops_pop": c("drops_per_10k"), "absorbed_pop": c("absorption_per_10k"),
        "change": c("change_of_use_rate"), "inspections": c("inspections_rate"), "closed": c("closed_rate"), "vut": c("vut_rate"),
        "context": (F.coalesce(c("population"), F.lit(0)) != 0).cast("double"),
        "point": ratio(c("geo_point_assets"), c("assets_count"), None), "near": ratio(c("geo_neighborhood_assets"), c("assets_count"), None),
    }
    z = min_max(zones, {f"n_{k}": v for k, v in scaled.items()})
    n = lambda k: c(f"n_{k}")
    z = z.withColumns(
        {
            "_sat": 0.45 * n("active") + 0.30 * n("lpa") + 0.25 * n("broker"),
            "_heat": 0.28 * n("events") + 0.22 * n("supply") + 0.18 * n("absorbed") + 0.20 * n("events_pop") + 0.12 * n("absorbed_pop"),
            "_rel": 0.40 * n("events_pop") + 0.30 * n("absorbed_pop") + 0.30 * n("listings_pop"),
            "_tra": 0.38 * n("change") + 0.26 * n("inspections") + 0.24 * n("closed") + 0.12 * n("vut"),
            "_geo": 0.60 * n("point") + 0.40 * n("near"),
            "_liq": F.least(F.greatest(0.50 * (c("absorption_count") / (c("listing_detected_count") + 1.0)) + 0.30 * n("absorbed") + 0.20 * n("events"), F.lit(0.0)), F.lit(1.0)),
        }
    )
    z = z.withColumns(
        {
            "_pre": 0.25 * n("drops") + 0.20 * n("drops_pop") + 0.20 * c("_sat") + 0.15 * n("broker") + 0.10 * F.greatest(n("supply") - n("absorbed"), F.lit(0.0)) + 0.10 * c("_tra"),
            "_con": 0.32 * n("resolved") + 0.18 * bands.freshness_score(c("freshness_days")) + 0.15 * n("kinds") + 0.10 * n("portals") + 0.20 * c("_geo") + 0.05 * n("context"),
        }
    )
    capture = 0.24 * c("_heat") + 0.18 * c("_rel") + 0.22 * c("_pre") + 0.12 * c("_liq") + 0.14 * c("_con") + 0.10 * c("_tra")
    names = {"saturation": "_sat", "heat": "_heat", "relative_heat": "_rel", "transformation_signal": "_tra", "pressure": "_pre", "liquidity": "_liq", "confidence": "_con"}
    z = z.withColumns({f"zone_{k}_score": score(c(v)) for k, v in names.items()} | {"zone_capture_score": score(capture)})
    z = z.withColumns({"geo_point_ratio": ratio(c("geo_point_assets"), c("assets_count")), "geo_neighborhood_ratio": ratio(c("geo_neighborhood_assets"), c("assets_count"))})
    z = z.withColumn("recommended_action", bands.zone_action_v2(c("zone_capture_score"), c("zone_pressure_score"), c("zone_liquidity_score"), c("zone_confidence_score")))
    return z.drop(*[f"n_{k}" for k in scaled], *names.values(), "_geo")


def zone_prediction(zones: DataFrame) -> DataFrame:
    """W-04: predicted absorption in 30 days, its band and the days to act in."""
    c = lambda k: F.coalesce(F.col(f"zone_{k}_score"), F.lit(0.0))
    raw = (
        0.26 * c("liquidity") + 0.18 * c("heat") + 0.18 * c("relative_heat") + 0.14 * c("confidence") + 0.12 * c("capture") + 0.08 * c("transformation_signal") + 0.06 * c("pressure")
        - F.greatest(c("pressure") - c("liquidity"), F.lit(0.0)) * 0.08 - F.greatest(c("saturation") - 58.0, F.lit(0.0)) * 0.05
    )
    z = zones.withColumn("predicted_absorption_score", rounded(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 1))
    p = F.col("predicted_absorption_score")
    return z.withColumns({"predicted_absorption_band": bands.prediction_band(p), "predicted_action_window_days": bands.action_window_days(p)})


def winsorize(df: DataFrame, columns: list[str], low: float = 0.1, high: float = 0.9, least: int = 6) -> DataFrame:
    """W-12: each of ``columns`` as ``<name>_sort``, clipped to its percentiles if there are at least six rows."""
    bounds = df.agg(F.count("*").alias("_n"), *[F.percentile(F.coalesce(F.col(x), F.lit(0.0)), q).alias(f"_{n}_{x}") for x in columns for n, q in (("lo", low), ("hi", high))])
    value = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    clipped = {f"{x}_sort": F.when(F.col("_n") < least, value(x)).otherwise(F.least(F.greatest(value(x), F.col(f"_lo_{x}")), F.col(f"_hi_{x}"))) for x in columns}
    return df.crossJoin(F.broadcast(bounds)).withColumns(clipped).drop("_n", *[f"_{n}_{x}" for x in columns for n in ("lo", "hi")])


def microzone_features(assets: DataFrame, listings: DataFrame, events: DataFrame, zones: DataFrame, *, as_of: Column, window_days: int = 14, channel: str = "flow") -> DataFrame:
    """A-05 and J-22: counts of each grid cell, and its shares in the parent zone. ``assets`` has zone_label; ``zones`` is scored."""
    c = F.col
    placed = assets.withColumn("microzone_label", geo.microzone_label(c("zone_label"), c("lat"), c("lon"))).where("microzone_label is not null")
    of_asset = placed.select(c("id").alias("asset_id"), "microzone_label")
    # coordinates are summed in whole millionths
    mean = lambda x: F.sum(F.floor(c(x) * 1e6 + 0.5)).cast("double") / (F.count(x) * 1000000)
    base = placed.groupBy("microzone_label").agg(F.min("zone_label").alias("parent_zone_label"), F.count("*").alias("assets_count"), mean("lat").alias("_lat"), mean("lon").alias("_lon"))
    sold = listings.join(of_asset, "asset_id").groupBy("microzone_label").agg(F.count("*").alias("listings_count"), F.count_if(is_active(c("status"))).alias("active_listings_count"), mean_cents(c("price_per_m2")).alias("avg_price_m2"))
    recent = events.where((c("source_channel") == channel) & (c("event_datetime") >= as_of - F.expr(f"INTERVAL {window_days} DAYS"))).select("listing_id", "asset_id", "event_type")
    happened = event_asset(recent, listings).join(of_asset, "asset_id").groupBy("microzone_label").agg(
        F.count("*").alias("events_14d"), F.count_if(c("event_type") == "listing_detected").alias("listing_detected_count"),
        F.count_if(c("event_type") == "price_drop").alias("price_drop_count"), F.count_if(c("event_type").isin(ABSORBED)).alias("absorption_count"),
    )
    m = base.join(sold, "microzone_label", "left").join(happened, "microzone_label", "left")
    m = m.na.fill(0, ["listings_count", "active_listings_count", "events_14d", "listing_detected_count", "price_drop_count", "absorption_count"])
    parent = zones.select(c("zone_label").alias("parent_zone_label"), c("assets_count").alias("_pa"), c("events_14d").alias("_pe"), c("zone_capture_score").alias("parent_capture"), c("zone_relative_heat_score").alias("parent_relative_heat"), c("zone_confidence_score").alias("parent_confidence"), c("zone_transformation_signal_score").alias("parent_transformation"))
    m = m.join(F.broadcast(parent), "parent_zone_label", "left")
    middle = geo.microzone_centroid(c("_lat"), c("_lon"))
    return m.withColumns(
        {
            "centroid_lat": middle["lat"], "centroid_lon": middle["lon"],
            "assets_share_in_parent": ratio(c("assets_count"), c("_pa")), "events_share_in_parent": ratio(c("events_14d"), c("_pe")),
            "events_per_asset": ratio(c("events_14d"), c("assets_count")), "active_listings_per_asset": ratio(c("active_listings_count"), c("assets_count")),
            "price_drops_per_asset": ratio(c("price_drop_count"), c("assets_count")), "absorption_per_asset": ratio(c("absorption_count"), c("assets_count")),
        }
    ).drop("_lat", "_lon", "_pa", "_pe")


def microzone_scores(micro: DataFrame) -> DataFrame:
    """W-05: intensity, concentration, confidence and capture of each cell, and an action."""
    c = F.col
    concentration = c("events_share_in_parent") / F.greatest(c("assets_share_in_parent"), F.lit(0.0001))
    names = {"epa": c("events_per_asset"), "lpa": c("active_listings_per_asset"), "dpa": c("price_drops_per_asset"), "apa": c("absorption_per_asset"), "conc": concentration, "assets": c("assets_count")}
    m = min_max(micro, {f"n_{k}": v for k, v in names.items()})
    part = lambda x: F.coalesce(c(x), F.lit(0.0)) / 100.0
    m = m.withColumns(
        {
            "_int": 0.36 * c("n_epa") + 0.24 * c("n_lpa") + 0.22 * c("n_dpa") + 0.18 * c("n_apa"),
            "_sup": 0.34 * part("parent_capture") + 0.28 * part("parent_relative_heat") + 0.22 * part("parent_confidence") + 0.16 * part("parent_transformation"),
            "_con": 0.42 * c("n_assets") + 0.38 * part("parent_confidence") + 0.20 * F.least(c("assets_count") / 4.0, F.lit(1.0)),
        }
    )
    capture = 0.42 * c("_int") + 0.30 * c("n_conc") + 0.18 * c("_sup") + 0.10 * c("_con")
    m = m.withColumns({"microzone_concentration_score": score(c("n_conc")), "microzone_local_intensity_score": score(c("_int")), "microzone_capture_score": score(capture), "microzone_confidence_score": score(c("_con"))})
    m = m.withColumn("recommended_action", bands.microzone_action(c("microzone_capture_score"), c("microzone_concentration_score"), c("microzone_confidence_score")))
    return m.drop("_int", "_sup", "_con", *[f"n_{k}" for k in names])
