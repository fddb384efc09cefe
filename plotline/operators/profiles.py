"""Phone profiles, best listings, event assets and snapshot windows (A-01, A-06, J-16, W-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import bands

#: Listing statuses that count as active, case-sensitive; and any case.
ACTIVE = ["", "active", "Disponible", "En venta"]
ABSORBED = ["reserved", "sold", "not_available", "expired"]


def is_active(status: Column) -> Column:
    return status.isNull() | status.isin(ACTIVE)


def phone_profiles(listings: DataFrame, contacts: DataFrame) -> DataFrame:
    """A-01: phone_norm, listing_count, asset_count, portal_count, phone_profile. Listings are distinct by id.

    Distinct pairs are counted after one shuffle by phone; a phone's sets are reduced in the map side first.
    """
    joined = listings.select("id", "contact_id", "asset_id", "source_portal").join(contacts.select(F.col("id").alias("contact_id"), "phone_norm").where("phone_norm is not null"), "contact_id")
    counts = joined.groupBy("phone_norm").agg(
        F.countDistinct("id").alias("listing_count"), F.countDistinct("asset_id").alias("asset_count"),
        F.countDistinct("source_portal").alias("portal_count"),
    )
    return counts.withColumn("phone_profile", bands.phone_profile(F.col("listing_count"), F.col("asset_count"), F.col("portal_count")))


def best_listing(listings: DataFrame, *, newest: bool = False) -> DataFrame:
    """W-09: one listing for each asset; active ones first, then the cheapest and the highest id, or the newest and the highest id."""
    active = F.coalesce(F.lower("status"), F.lit("")).isin([x.lower() for x in ACTIVE])
    order = [F.col("updated_at").desc_nulls_last()] if newest else [F.col("price_eur").asc_nulls_last()]
    w = Window.partitionBy("asset_id").orderBy(active.desc(), *order, F.col("id").desc())
    return listings.where("asset_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def event_asset(events: DataFrame, listings: DataFrame) -> DataFrame:
    """J-16: ``events`` with the asset of the event, or else of its listing."""
    of = listings.select(F.col("id").alias("listing_id"), F.col("asset_id").alias("_asset"))
    return events.join(of, "listing_id", "left").withColumn("asset_id", F.coalesce("asset_id", "_asset")).drop("_asset")


def snapshot_window(snapshots: DataFrame) -> DataFrame:
    """A-06: min_dt, max_dt of all snapshots."""
    return snapshots.agg(F.min("snapshot_datetime").alias("min_dt"), F.max("snapshot_datetime").alias("max_dt"))


def freshness_days(runs: DataFrame, as_of: Column) -> DataFrame:
    """A-06: whole days since the last successful baseline run, 0 at least; null without one."""
    ok = runs.where("source_type = 'csv' and status = 'success'")
    last = ok.agg(F.max_by("finished_at", F.struct("finished_at", "id")).alias("last"))
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return last.select(F.greatest(F.floor(seconds / 86400), F.lit(0)).alias("freshness_days"))
