"""Audit and dashboard reports of several tables at once (A-12, A-13, A-15, A-24, A-30, J-23, J-24, T-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.bands import chain
from plotline.functions.numbers import rounded
from plotline.functions.text import text_key
from plotline.operators.quality import ACCEPTED, NEGATIVE, POSITIVE, REJECTED, link_stats, matching_metrics

#: Labels of reviews that say neither; what boundaries can show, by the name it is asked for.
UNCERTAIN = ["uncertain", "ambiguous", "skip"]
ZONE_METRICS = {
    "capture": "zone_capture_score", "heat": "zone_heat_score", "relative_heat": "zone_relative_heat_score", "pressure": "zone_pressure_score", "transformation": "zone_transformation_signal_score",
    "predictive": "predicted_absorption_score", "confidence": "zone_confidence_score", "liquidity": "zone_liquidity_score",
}


def _rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def link_report(items: DataFrame, links: DataFrame, events: DataFrame, *, channel: str = "flow") -> DataFrame:
    """A-12: one row: items, links by status, those with a listing, and market events that the channel has made."""
    one = link_stats(links).crossJoin(F.broadcast(items.agg(F.count("*").alias("items"))))
    return one.crossJoin(F.broadcast(events.agg(F.count_if(F.col("source_channel") == channel).alias("events_created"))))


def matching_report(reviews: DataFrame) -> DataFrame:
    """A-13: ``matching_metrics`` with the reviews by kind, the predictions by side and the mean predicted score, in one pass."""
    label, status = F.lower("review_label"), F.lower("predicted_status")
    more = reviews.agg(
        F.count_if(label.isin(POSITIVE)).alias("positive"), F.count_if(label.isin(NEGATIVE)).alias("negative"), F.count_if(label.isin(UNCERTAIN)).alias("uncertain"),
        F.count_if(status.isin(ACCEPTED)).alias("accepted"), F.count_if(status.isin(REJECTED)).alias("rejected"),
        rounded(F.sum(F.floor(F.col("predicted_score") * 1e6 + 0.5)).cast("double") / (F.count("predicted_score") * 1e6), 4).alias("mean_score"),
    )
    return matching_metrics(reviews).crossJoin(F.broadcast(more))


def review_counters(reviews: DataFrame) -> DataFrame:
    """A-13: kind (label, status, source, reviewer), value, n of the reviews; one pass by grouping sets."""
    named = reviews.select(
        F.lower(F.coalesce("review_label", F.lit(""))).alias("label"), F.lower(F.coalesce("predicted_status", F.lit(""))).alias("status"),
        *[F.lower(F.coalesce(F.col(x), F.lit("unknown"))).alias(k) for x, k in (("source_channel", "source"), ("reviewer", "reviewer"))],
    )
    kinds = ["label", "status", "source", "reviewer"]
    sets = named.groupingSets([[k] for k in kinds], *kinds).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(kinds)) - 1
    kind = chain(*[(F.col("_g") == full - (1 << (len(kinds) - 1 - i)), k) for i, k in enumerate(kinds)], other=None)
    return sets.select(kind.alias("kind"), F.coalesce(*kinds).alias("value"), "n")


def integrity_report(assets: DataFrame, listings: DataFrame, snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """A-15: kind, value, n: rows of each table, events of the sheets (there should be none), URLs of several listings, and assets of one street, type and rounded area."""
    count = lambda df, name: df.agg(F.lit("count").alias("kind"), F.lit(name).alias("value"), F.count("*").alias("n"))
    urls = listings.where("listing_url is not null").groupBy(F.col("listing_url").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_url").alias("kind"), "value", "n")
    area = F.coalesce(F.floor(F.col("area_m2") + 0.5).cast("long").cast("string"), F.lit(""))
    like = assets.where("address_norm is not null").groupBy(F.concat_ws("|", "address_norm", F.coalesce("asset_type_detail", F.lit("")), area).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    tables = [count(df, n) for df, n in ((assets, "assets"), (listings, "listings"), (snapshots, "snapshots"), (events, "events"), (events.where("source_channel = 'csv'"), "sheet_events"))]
    return _rows([*tables, urls, like.select(F.lit("suspicious").alias("kind"), "value", "n")])


def overlap_report(alerts: DataFrame, window: DataFrame) -> DataFrame:
    """J-24: place of an alert's day against the snapshots' days (before, inside, after, without_date; all), alerts, occurrences, unresolved, urls and unresolved_urls (distinct)."""
    day = F.col("alert_datetime").cast("date")
    low, high = F.col("min_dt").cast("date"), F.col("max_dt").cast("date")
    place = chain((day.isNull() | low.isNull() | high.isNull(), "without_date"), (day < low, "before"), (day > high, "after"), other="inside")
    placed = alerts.crossJoin(F.broadcast(window)).select(place.alias("place"), "occurrence_count", "resolved", F.nullif(F.col("listing_url"), F.lit("")).alias("url"))
    counted = placed.rollup("place").agg(
        F.count("*").alias("alerts"), F.sum("occurrence_count").alias("occurrences"), F.count_if(~F.col("resolved")).alias("unresolved"),
        F.countDistinct("url").alias("urls"), F.countDistinct(F.when(~F.col("resolved"), F.col("url"))).alias("unresolved_urls"),
    )
    return counted.withColumn("place", F.coalesce("place", F.lit("all")))


def population_levels(rows: DataFrame) -> DataFrame:
    """A-24: ``rows`` (day, district, neighborhood, …) of the latest day, with the level that each is of: a district's have no neighborhood."""
    latest = rows.agg(F.max("day").alias("day"))
    level = F.when(F.col("neighborhood").isNull(), "district").otherwise("neighborhood")
    return rows.join(F.broadcast(latest), "day").where("district is not null").withColumn("zone_level", level)


def table_freshness(tables: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """A-30: rows, highest id and newest update of each table, as (table, its column of updates or None)."""
    return _rows([df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max("id").cast("long").alias("max_id"), F.max(F.lit(None) if at is None else at).cast("string").alias("updated")) for name, (df, at) in tables.items()])


def boundary_layers(boundaries: DataFrame, zones: DataFrame, metric: str = "capture", *, min_score: float | None = None, query: str = "") -> DataFrame:
    """J-23: level, name, zone_label, value and matched_count (of the level) of the official names of ``boundaries`` (level, name) that a zone has, by text key.

    ``zones`` are those with at least ``min_score`` and a label that holds ``query``; of zones of one key the last by label counts.
    """
    c = F.col
    rows = zones.withColumns({"value": F.coalesce(ZONE_METRICS[metric], F.lit(0.0)), "_k": text_key(c("zone_label"))}).where("_k <> ''")
    if min_score is not None:
        rows = rows.where(c("value") >= min_score)
    if query:
        rows = rows.where(F.contains("_k", text_key(F.lit(query))))
    one = rows.groupBy("_k").agg(F.max(F.struct("zone_label", "value")).alias("z")).select("_k", "z.*")
    met = boundaries.select("level", "name", text_key(c("name")).alias("_k")).join(one, "_k")
    counts = met.groupBy("level").agg(F.countDistinct("_k").alias("matched_count"))
    return met.join(counts, "level").select("level", "name", "zone_label", "value", "matched_count")


def recent_asset_details(assets: DataFrame, listings: DataFrame, buildings: DataFrame, k: int = 300) -> DataFrame:
    """T-05: the ``k`` newest assets with their building's address and their listings, newest first."""
    c = F.col
    top = assets.orderBy(c("id").desc()).limit(k).select("id", "building_id")
    mine = listings.join(F.broadcast(top.select(c("id").alias("asset_id"))), "asset_id", "left_semi").groupBy(c("asset_id").alias("id")).agg(F.sort_array(F.collect_list("id"), asc=False).alias("listings"))
    named = top.join(buildings.select(c("id").alias("building_id"), "address_base"), "building_id", "left")
    return named.join(mine, "id", "left").withColumn("listings", F.coalesce("listings", F.array().cast("array<bigint>")))
