"""The opportunity queue, its groups and filters (A-04, A-18, P-04, P-05, W-06 to W-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import bands, geo
from plotline.functions.bands import chain
from plotline.functions.numbers import rounded
from plotline.functions.text import text_key
from plotline.operators.profiles import best_listing, event_asset, phone_profiles

#: Points of an event by its type, and words for it.
EVENT_BASE = {"listing_detected": 32.0, "price_drop": 28.0, "price_raise": 10.0, "reserved": 22.0, "sold": 18.0, "not_available": 12.0, "expired": 16.0}
EVENT_BONUS = {"listing_detected": 12.0, "price_drop": 14.0, "reserved": 8.0, "sold": 8.0, "expired": 4.0, "not_available": 4.0}
EVENT_WORDS = {"price_drop": "bajada de precio", "listing_detected": "entrada reciente", "reserved": "reservado", "sold": "vendido", "expired": "caducado", "not_available": "retirado"}


def alert_zone_features(alerts: DataFrame) -> DataFrame:
    """A-04: alerts, occurrences and resolved alerts of each zone. ``alerts``: zone_label, occurrence_count, resolved."""
    return alerts.groupBy("zone_label").agg(F.count("*").alias("alerts_in_window"), F.sum("occurrence_count").alias("occurrences_in_window"), F.count_if("resolved").alias("resolved_in_window"))


def _of(c: Column, table: dict[str, float], other: float) -> Column:
    return chain(*[(c == k, v) for k, v in table.items()], other=other)


def opportunity_prediction(zone_absorption: Column, capture: Column, concentration: Column, confidence: Column, event_type: Column, drop: Column, has_point: Column) -> Column:
    """W-06: predicted opportunity in 30 days."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    micro = (0.45 * z(capture) + 0.35 * z(concentration) + 0.20 * z(confidence)) / 10.0
    bonus = chain((drop >= 0.15, 10.0), (drop >= 0.08, 6.0), (drop >= 0.03, 3.0), other=0.0)
    raw = 0.58 * z(zone_absorption) + 0.22 * micro + _of(event_type, EVENT_BONUS, 0.0) + bonus + F.when(has_point, 4.0).otherwise(0.0)
    return rounded(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 1)


def whole_days(as_of: Column, at: Column) -> Column:
    """Whole periods of 24 hours from ``at``, to its microsecond, to ``as_of``; 0 at least."""
    return F.greatest(F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000)), F.lit(0))


def opportunity_queue(events: DataFrame, assets: DataFrame, listings: DataFrame, contacts: DataFrame, zones: DataFrame, microzones: DataFrame, *, as_of: Column, window_days: int = 14, channel: str = "flow", limit: int | None = 100, phones: DataFrame | None = None) -> DataFrame:
    """W-07: a scored row for each event of the window.

    Events are cut to the window before any join; the zone table, a row for each zone, is broadcast; listings and assets are joined by id.
    ``limit``: the best so many by (score, time, id), or all rows.
    """
    c = F.col
    recent = events.where((c("source_channel") == channel) & (c("event_datetime") >= as_of - F.expr(f"INTERVAL {window_days} DAYS")))
    e = event_asset(recent.withColumnRenamed("id", "event_id"), listings)
    a = assets.select(c("id").alias("asset_id"), "zone_label", "neighborhood", "district", "lat", "lon")
    e = e.join(a, "asset_id", "left").withColumn("zone_label", F.coalesce("zone_label", F.lit("Sin zona")))
    best = best_listing(listings, newest=True).select("asset_id", c("id").alias("_best"))
    e = e.join(best, "asset_id", "left").withColumn("listing_id", F.coalesce("listing_id", "_best"))
    e = e.join(listings.select(c("id").alias("listing_id"), "contact_id", "source_portal"), "listing_id", "left")
    e = e.join(contacts.select(c("id").alias("contact_id"), c("phone_raw").alias("contact_phone"), "phone_norm"), "contact_id", "left")
    profiles = phone_profiles(listings, contacts) if phones is None else phones
    e = e.join(profiles.select("phone_norm", "phone_profile"), "phone_norm", "left").withColumn("phone_profile", F.coalesce("phone_profile", F.lit("unknown")))
    e = e.withColumn("microzone_label", geo.microzone_label(c("zone_label"), c("lat"), c("lon")))
    z = zones.select("zone_label", *[c(f"zone_{k}_score").alias(f"_z_{k}") for k in ("capture", "pressure", "confidence", "relative_heat", "transformation_signal")], c("predicted_absorption_score").alias("_absorption"))
    m = microzones.select("microzone_label", *[c(f"microzone_{k}_score").alias(f"_m_{k}") for k in ("capture", "concentration", "confidence")])
    e = e.join(F.broadcast(z), "zone_label", "left").join(m, "microzone_label", "left")
    z0 = lambda k: F.coalesce(c(f"_z_{k}"), F.lit(0.0)) / 100.0
    m0 = lambda k: F.coalesce(c(f"_m_{k}"), F.lit(0.0)) / 100.0
    age = whole_days(as_of, c("event_datetime"))
    priced = (c("event_type") == "price_drop") & (c("price_old") > 0) & (c("price_new") != 0)
    e = e.withColumn("price_drop_pct", F.when(priced, F.greatest((c("price_old") - c("price_new")) / c("price_old"), F.lit(0.0))))
    has_point = c("lat").isNotNull() & c("lon").isNotNull()
    e = e.withColumns(
        {
            "_base": _of(c("event_type"), EVENT_BASE, 8.0),
            "_recency": chain((age <= 1, 18.0), (age <= 3, 14.0), (age <= 7, 10.0), (age <= 14, 6.0), (age <= 30, 2.0), other=0.0),
            "_price": F.when(c("event_type") != "price_drop", 0.0).otherwise(chain((c("price_drop_pct").isNull(), 6.0), (c("price_drop_pct") >= 0.20, 18.0), (c("price_drop_pct") >= 0.10, 12.0), (c("price_drop_pct") >= 0.05, 8.0), other=4.0)),
            "_zone": 0.34 * z0("capture") * 20.0 + 0.24 * z0("pressure") * 15.0 + 0.14 * z0("confidence") * 10.0 + 0.16 * z0("relative_heat") * 14.0 + 0.12 * z0("transformation_signal") * 14.0,
            "_micro": 0.50 * m0("capture") * 12.0 + 0.30 * m0("concentration") * 10.0 + 0.20 * m0("confidence") * 8.0,
            "_geo": chain((c("neighborhood").isNotNull(), 6.0), (c("district").isNotNull(), 3.0), other=0.0) + F.when(has_point, 6.0).otherwise(0.0),
            "predicted_opportunity_score": opportunity_prediction(c("_absorption"), c("_m_capture"), c("_m_concentration"), c("_m_confidence"), c("event_type"), c("price_drop_pct"), has_point),
        }
    )
    e = e.withColumn("_predicted", c("predicted_opportunity_score") * 0.12)
    total = c("_base") + c("_recency") + c("_price") + c("_zone") + c("_micro") + c("_predicted") + c("_geo")
    above = lambda x, n: F.coalesce(x >= n, F.lit(False))
    reason = F.array_compact(
        F.array(
            _words(c("event_type")),
            F.when(above(c("_z_capture"), 65), "zona fuerte para captacion").when(above(c("_z_pressure"), 65), "zona con presion alta"),
            F.when(above(c("_z_relative_heat"), 65), "actividad relativa alta"), F.when(above(c("_z_transformation_signal"), 65), "senal transformadora alta"),
            F.when(above(c("_m_capture"), 65), "microzona caliente").when(above(c("_m_concentration"), 65), "microzona concentrada"),
            F.when(c("phone_profile") != "unknown", F.concat(F.lit("telefono "), c("phone_profile"))),
            F.when(c("neighborhood").isNotNull(), "geo por barrio").when(c("district").isNotNull(), "geo por distrito"),
        )
    )
    e = e.withColumn("_score", total).withColumns(
        {
            "score": rounded(c("_score"), 2), "priority_label": bands.priority_label(c("_score")), "reason": F.array_join(reason, " | "), "has_geo_point": has_point,
            "predicted_opportunity_band": bands.prediction_band(c("predicted_opportunity_score")),
            **{f"score_{k}": rounded(c(v), 2) for k, v in {"event_base": "_base", "recency": "_recency", "price_signal": "_price", "zone_signal": "_zone", "microzone_signal": "_micro", "predictive_signal": "_predicted", "geo_signal": "_geo"}.items()},
        }
    )
    e = e.drop(*[x for x in e.columns if x.startswith("_")])
    return e if limit is None else e.orderBy(c("score").desc(), c("event_datetime").desc(), c("event_id")).limit(limit)


def _words(event_type: Column) -> Column:
    return chain(*[(event_type == k, v) for k, v in EVENT_WORDS.items()], other=F.coalesce(event_type, F.lit("evento")))


def filter_opportunities(queue: DataFrame, *, event_type: str | None = None, with_geo: bool = False, min_score: float = 0.0, zone_query: str = "") -> DataFrame:
    """P-04: rows of one type, with a point, of a least score, whose text holds a key."""
    out = queue.where(F.col("score") >= min_score)
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if with_geo:
        out = out.where("has_geo_point")
    if zone_query:
        hay = text_key(F.concat_ws(" ", "zone_label", "microzone_label", "neighborhood", "district", "source_portal", "contact_phone", "reason"))
        out = out.where(F.coalesce(hay, F.lit("")).contains(zone_query.lower().replace("_", "")))
    return out


def _group_key(by: str) -> tuple[Column, Column]:
    c = F.col
    if by == "contact":
        digits = F.regexp_replace(F.coalesce("contact_phone", F.lit("")), "[^0-9]", "")
        return F.when(digits != "", digits).otherwise(F.coalesce(F.concat(F.lit("contact:"), c("contact_id").cast("string")), F.lit("sin_contacto"))), F.coalesce("contact_phone", F.concat(F.lit("contacto #"), c("contact_id").cast("string")), F.lit("Sin contacto"))
    name = "zone_label" if by == "zone" else "event_type"
    return c(name), c(name)


def opportunity_groups(queue: DataFrame, by: str) -> DataFrame:
    """A-18: for each zone, contact or event type: rows, best and mean score, distinct zones and portals, the most frequent reason (ties: the smallest)."""
    key, label = _group_key(by)
    rows = queue.withColumns({"group_key": key, "_label": label})
    cents = F.floor(F.col("score") * 100 + 0.5)
    out = rows.groupBy("group_key").agg(
        F.min("_label").alias("group_label"), F.count("*").alias("n"), F.max("score").alias("top_score"), rounded(F.sum(cents).cast("double") / (F.count("*") * 100), 2).alias("avg_score"),
        F.countDistinct("zone_label").alias("zones"), F.countDistinct("source_portal").alias("portals"),
    )
    counts = rows.groupBy("group_key", "reason").agg(F.count("*").alias("_n"))
    top = counts.groupBy("group_key").agg(F.min_by("reason", F.struct(-F.col("_n"), "reason")).alias("top_reason"))
    return out.join(top, "group_key").withColumn("group_by", F.lit(by))


def select_group(queue: DataFrame, by: str, key: str) -> DataFrame:
    """P-05: the rows of one group."""
    return queue.where(_group_key(by)[0] == key)


def opportunity_queue_v1(events: DataFrame, assets: DataFrame, listings: DataFrame, contacts: DataFrame, zones: DataFrame, *, as_of: Column, window_days: int = 14, channel: str = "flow", limit: int | None = 150) -> DataFrame:
    """W-08: 0.55 capture + 0.20 pressure + 0.15 confidence of the zone and a bonus of the event; only events in a known zone."""
    c = F.col
    recent = events.where((c("source_channel") == channel) & (c("event_datetime") >= as_of - F.expr(f"INTERVAL {window_days} DAYS")))
    e = event_asset(recent.withColumnRenamed("id", "event_id"), listings).join(assets.select(c("id").alias("asset_id"), "zone_label"), "asset_id", "left")
    e = e.withColumn("zone_label", F.coalesce("zone_label", F.lit("Sin zona")))
    e = e.join(listings.select(c("id").alias("listing_id"), "contact_id"), "listing_id", "left").join(contacts.select(c("id").alias("contact_id"), "phone_norm"), "contact_id", "left")
    z = zones.select("zone_label", "owner_like_phone_count", "zone_capture_score", "zone_pressure_score", "zone_confidence_score")
    e = e.join(F.broadcast(z), "zone_label")
    bonus = chain((c("event_type") == "listing_detected", 22.0), (c("event_type") == "price_drop", 18.0), (c("event_type").isin("reserved", "sold", "not_available"), 10.0), other=6.0)
    owner = F.when(c("phone_norm").isNotNull() & (c("owner_like_phone_count") > 0), 4.0).otherwise(0.0)
    scored = e.withColumn("priority_score", rounded(0.55 * c("zone_capture_score") + 0.20 * c("zone_pressure_score") + 0.15 * c("zone_confidence_score") + (bonus + owner), 1))
    return scored if limit is None else scored.orderBy(c("priority_score").desc(), c("event_datetime").desc(), "event_id").limit(limit)


def opportunity_detail(queue: DataFrame, comparables: DataFrame, *, k: int = 5) -> DataFrame:
    """J-25: every row of a queue with the ids of its asset's k first comparables, in their order. ``comparables``: asset_id, other_id, place."""
    few = comparables.where(F.col("place") <= k).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("place", "other_id"))).alias("_c"))
    return queue.join(few.select("asset_id", F.transform("_c", lambda x: x["other_id"]).alias("comparables")), "asset_id", "left")
