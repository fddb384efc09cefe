"""Reports on matches, entities and data (A-10 to A-16, A-30, J-24, P-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.text import text_key
from plotline.functions.bands import chain
from plotline.functions.numbers import rounded
from plotline.operators.identity import latest_review

POSITIVE, NEGATIVE = ["match", "correct", "positive"], ["no_match", "incorrect", "negative"]
ACCEPTED, REJECTED = ["resolved", "accepted", "match"], ["unresolved", "rejected", "no_match", "ambiguous"]


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(rounded(a.cast("double") / b.cast("double"), 4))


def event_type_breakdown(events: DataFrame) -> DataFrame:
    """A-11: events of each type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def link_stats(links: DataFrame) -> DataFrame:
    """A-12: links by status, and those with a listing."""
    at = lambda s: F.count_if(F.col("match_status") == s).alias(s)
    return links.agg(F.count("*").alias("total"), at("resolved"), at("unresolved"), at("ambiguous"), at("pending"), F.count("listing_id").alias("linked"))


def matching_metrics(reviews: DataFrame) -> DataFrame:
    """A-13: one row: confusion matrix, precision, recall and accuracy over all reviews."""
    yes, no = F.lower("review_label").isin(POSITIVE), F.lower("review_label").isin(NEGATIVE)
    acc, rej = F.lower("predicted_status").isin(ACCEPTED), F.lower("predicted_status").isin(REJECTED)
    c = F.col
    m = reviews.agg(F.count("*").alias("reviews_total"), F.count_if(acc & yes).alias("tp"), F.count_if(acc & no).alias("fp"), F.count_if(rej & yes).alias("fn"), F.count_if(rej & no).alias("tn"))
    return m.withColumns({"precision": _share(c("tp"), c("tp") + c("fp")), "recall": _share(c("tp"), c("tp") + c("fn")), "accuracy": _share(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn"))})


def threshold_bands(reviews: DataFrame, scale: float = 1.0) -> DataFrame:
    """A-14: reviews by band of the predicted score (times ``scale``), purity and advice (five reviews at least)."""
    s = F.col("predicted_score") * scale
    band = chain((s.isNull(), "no_score"), (s >= 0.90, "0.90+"), (s >= 0.75, "0.75-0.89"), (s >= 0.60, "0.60-0.74"), (s >= 0.40, "0.40-0.59"), other="<0.40")
    b = reviews.groupBy(band.alias("band")).agg(F.count("*").alias("total"), F.count_if(F.lower("review_label").isin(POSITIVE)).alias("positive"), F.count_if(F.lower("review_label").isin(NEGATIVE)).alias("negative"))
    b = b.withColumn("purity", _share(F.col("positive"), F.col("positive") + F.col("negative")))
    p = F.col("purity")
    return b.withColumn("recommendation", chain((F.col("total") < 5, "sin muestra"), (p >= 0.9, "banda muy fiable"), (p >= 0.75, "banda razonable"), (p >= 0.5, "revisar threshold"), other="banda problemática"))


def integrity_audit(assets: DataFrame) -> DataFrame:
    """A-15: groups of assets with one street, type and rounded area."""
    return assets.groupBy("address_norm", "asset_type_detail", F.floor(F.col("area_m2") + 0.5).cast("long").alias("area")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def overlap_audit(alerts: DataFrame, window: DataFrame) -> DataFrame:
    """J-24: alerts before, inside and after the snapshots' days, or without a date."""
    t = F.col("alert_datetime")
    place = chain((t.isNull(), "without_date"), (t < F.col("min_dt"), "before"), (t > F.col("max_dt"), "after"), other="inside")
    return alerts.crossJoin(F.broadcast(window)).groupBy(place.alias("place")).agg(F.count("*").alias("n"))


def table_signature(tables: dict[str, DataFrame]) -> DataFrame:
    """A-30: rows and highest id of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max("id").cast("long").alias("max_id"))
        out = part if out is None else out.unionByName(part)
    return out


def dashboard_stats(items: DataFrame, links: DataFrame, semantics: DataFrame, as_of: Column) -> DataFrame:
    """A-10: one row of counts and shares. ``semantics``: address_precision, price_confidence for each item."""
    c = F.col
    since = lambda d: c("event_datetime") >= as_of - F.expr(f"INTERVAL {d} DAYS")
    i = items.agg(F.count("*").alias("items"), F.count_if(since(7)).alias("events_7d"), F.count_if(since(30)).alias("events_30d"))
    s = semantics.agg(F.count_if(c("address_precision").isin("zone_like", "unknown")).alias("poor_address"), F.count_if(c("price_confidence").isin("none", "low")).alias("no_reliable_price"))
    m = links.agg(F.count_if(c("match_status") == "resolved").alias("resolved"), F.count("*").alias("links"))
    return i.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(m)).withColumn("resolved_ratio", _share(c("resolved"), c("links")))


#: Reasons that count as a weak identity.
WEAK_REASONS = ["weak_identity", "zone_only_address", "repeated_phone_conflict", "no_candidates", "not_in_csv_yet"]


def filter_links(links: DataFrame, reviews: DataFrame, *, status: str | None = None, focus: str | None = None, query: str = "", limit: int = 300) -> DataFrame:
    """P-06: the newest links (by event_datetime, flow_item_id), of a status before the limit, of a focus and with a text after it (Q24).

    Focus: review_needed, poor_address, repeated_phone, weak_identity or price_conflict. ``links`` has match_status, reason, address_precision,
    phone_profile and the texts that a query is looked for in: address_raw, contact_name, contact_phone, portal, match_note.
    """
    c = F.col
    rows = links if status is None else links.where(c("match_status") == status)
    rows = rows.orderBy(c("event_datetime").desc_nulls_last(), c("flow_item_id").desc()).limit(limit)
    wanted = {
        "poor_address": c("address_precision").isin("zone_like", "unknown"), "repeated_phone": c("phone_profile") == "broker_like", "weak_identity": c("reason").isin(WEAK_REASONS), "price_conflict": c("reason") == "price_conflict",
    }
    if focus == "review_needed":
        rows = review_needed(rows, reviews)
    elif focus is not None:
        rows = rows.where(wanted[focus])
    if query:
        hay = text_key(F.concat_ws(" ", "address_raw", "contact_name", "contact_phone", "portal", "match_status", "reason", "match_note"))
        rows = rows.where(F.contains(F.coalesce(hay, F.lit("")), text_key(F.lit(query))))
    return rows


def review_needed(links: DataFrame, reviews: DataFrame) -> DataFrame:
    """P-06, focus review_needed: unsettled links whose item has no review."""
    done = latest_review(reviews).select("flow_item_id")
    return links.where(F.col("match_status").isin("ambiguous", "unresolved", "pending")).join(done, "flow_item_id", "left_anti")
