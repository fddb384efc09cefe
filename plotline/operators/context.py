"""Official context and street catalogue (A-22 to A-26, J-12, J-19, J-23, T-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.bands import chain
from plotline.functions.text import text_key


def two_level_counts(rows: DataFrame, since: Column, **flags: Column) -> DataFrame:
    """A-25 and A-26: rows since a day, by zone at two levels: zone_level, zone_key, total and a count for each flag. One pass by grouping sets."""
    recent = rows.where(F.col("day") >= since)
    recent = recent.withColumns({f"f_{k}": v for k, v in flags.items()})
    out = recent.groupingSets([["district"], ["neighborhood"]], "district", "neighborhood").agg(F.grouping("district").alias("_g"), F.count("*").alias("total"), *[F.count_if(f"f_{k}").alias(k) for k in flags])
    level = F.when(F.col("_g") == 0, "district").otherwise("neighborhood")
    return out.select(level.alias("zone_level"), F.coalesce("district", "neighborhood").alias("zone_key"), "total", *flags).where("zone_key is not null")


def population_latest(rows: DataFrame) -> DataFrame:
    """A-24: rows of the latest date."""
    return rows.join(F.broadcast(rows.agg(F.max("day").alias("day"))), "day")


def street_catalog(streets: DataFrame) -> DataFrame:
    """A-22: for each lookup key the code of its first row, and all codes of the name, sorted. ``streets``: row_no, code, street_type, street_name."""
    key = F.concat_ws("|", "street_type", "street_name")
    names = streets.groupBy("street_name").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return streets.groupBy(key.alias("lookup_key"), "street_name").agg(F.min_by("code", "row_no").alias("first_code")).join(names, "street_name")


def address_points(points: DataFrame) -> DataFrame:
    """A-23: the most complete row of each (street, number); ties: the first."""
    filled = sum(F.col(x).isNotNull().cast("int") for x in ("district", "neighborhood", "lat", "lon"))
    return points.groupBy("code", "number").agg(F.max_by(F.struct("district", "neighborhood", "lat", "lon"), F.struct(filled, -F.col("row_no"))).alias("b")).select("code", "number", "b.*")


def nearest_house_number(wanted: DataFrame, points: DataFrame, within: int = 6) -> DataFrame:
    """J-19: the nearest number of the street within six (ties: the smaller); numbers meet in bands, so no street is crossed with itself."""
    w = wanted.select("id", "code", F.col("number").alias("want")).withColumn("band", F.explode(F.array(*[F.floor(F.col("want") / (within + 1)) + i for i in (-1, 0, 1)])))
    p = points.select("code", "number").distinct().withColumn("band", F.floor(F.col("number") / (within + 1)))
    j = w.join(p, ["code", "band"]).where(F.abs(F.col("number") - F.col("want")) <= within)
    return j.groupBy("id", "code", "want").agg(F.min_by("number", F.struct(F.abs(F.col("number") - F.col("want")), "number")).alias("number"))


def boundary_metrics(boundaries: DataFrame, zones: DataFrame, metric: str, k: int = 12) -> DataFrame:
    """J-23: official names with the metric of the zone of the same text key; the k highest (ties: the name)."""
    b = boundaries.select("name", text_key(F.col("name")).alias("_k"))
    z = zones.select(text_key(F.col("zone_label")).alias("_k"), "zone_label", F.col(metric).alias("value"))
    return b.join(F.broadcast(z), "_k").drop("_k").orderBy(F.col("value").desc_nulls_last(), "name").limit(k)


def reason_taxonomy(links: DataFrame) -> DataFrame:
    """J-12: flow_item_id, reason. ``links`` has match_status, match_score, match_note, address_precision, phone_profile, listing_url, contact_phone, is_new."""
    c = F.col
    note = F.coalesce(text_key(c("match_note")), F.lit(""))
    none = note.contains("sin candidatos suficientes")
    reason = chain(
        ((c("match_status") == "resolved") & (F.coalesce("match_score", F.lit(0.0)) >= 90), "resolved_strong"), (c("match_status") == "resolved", "resolved_soft"), (c("match_status") == "ambiguous", "ambiguous_multiple_candidates"),
        (c("match_status") == "pending", "pending_review"), (none & c("is_new"), "not_in_csv_yet"), (none, "no_candidates"),
        ((c("address_precision") == "zone_like") & c("listing_url").isNull() & c("contact_phone").isNull(), "zone_only_address"), (c("phone_profile") == "broker_like", "repeated_phone_conflict"), (note.contains("precio lejos"), "price_conflict"), other="weak_identity",
    )
    return links.select("flow_item_id", reason.alias("reason"))


def recent_assets(assets: DataFrame, listings: DataFrame, k: int = 50) -> DataFrame:
    """T-05: the k newest assets, how many listings each has, and its latest one."""
    top = assets.orderBy(F.col("id").desc()).limit(k)
    latest = Window.partitionBy("asset_id").orderBy(F.col("id").desc())
    mine = listings.join(F.broadcast(top.select(F.col("id").alias("asset_id"))), "asset_id", "left_semi").withColumns({"_n": F.row_number().over(latest), "listings": F.count("*").over(Window.partitionBy("asset_id"))}).where("_n = 1")
    return top.select("id").join(mine.select(F.col("asset_id").alias("id"), "listings", F.col("id").alias("latest_listing")), "id", "left").na.fill(0, ["listings"])
