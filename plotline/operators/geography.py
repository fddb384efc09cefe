"""Addresses against the street catalogue (J-18, J-20, A-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.addresses import NEIGHBORHOODS, address_base, address_key, parse_address
from plotline.functions.bands import chain
from plotline.functions.fuzzy import best_keys
from plotline.functions.numbers import rounded
from plotline.operators.context import nearest_house_number
from plotline.operators.shared import stored


def _named(key: Column, neighborhoods: dict[str, tuple[str, str]], place: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in neighborhoods.items() for x in (k, v[place])]), key)


def resolve_streets(addresses: DataFrame, streets: DataFrame, points: DataFrame, *, neighborhoods: dict[str, tuple[str, str]] | None = None, least: float = 92.0) -> DataFrame:
    """J-18: id, matched, confidence, match_type, street_code, district, neighborhood, lat, lon of every row of ``addresses`` (id, address).

    ``streets``: row_no, code, street_type, street_name, district. ``points``: code, number, district, neighborhood, lat, lon, one row
    for each number. Tiers: a neighborhood alone; the lookup key; a name of one code; the best fuzzy key, then name; a
    neighborhood at the end. Only distinct keys are looked up, and only those without an exact match go to the fuzzy ratios.
    """
    c = F.col
    hoods = NEIGHBORHOODS if neighborhoods is None else neighborhoods
    rows = stored(addresses.select("id", parse_address(c("address"), neighborhoods=hoods).alias("a")).select("id", "a.*"), "parsed-addresses")
    by_key = streets.groupBy(F.concat_ws("|", "street_type", "street_name").alias("choice")).agg(F.min_by("code", "row_no").alias("code"), F.min("row_no").alias("place"))
    by_key = stored(by_key, "street-keys")
    by_name = streets.groupBy(c("street_name").alias("choice")).agg(F.collect_set("code").alias("codes"), F.min("row_no").alias("place")).select("choice", "place", F.when(F.size("codes") == 1, F.get("codes", 0)).alias("code"))
    by_name = stored(by_name, "street-names")
    keys = rows.where("street_name is not null").select("lookup_key", "street_name").distinct()
    exact = keys.join(by_key.select(c("choice").alias("lookup_key"), c("code").alias("_k")), "lookup_key", "left").join(by_name.select(c("choice").alias("street_name"), c("code").alias("_n")), "street_name", "left")
    exact = stored(exact, "street-matches")
    open_ = exact.where("_k is null and _n is null").select("lookup_key", "street_name")
    fuzzy_key = best_keys(open_.select(c("lookup_key").alias("key")), by_key, least=least).join(by_key.select("choice", "code"), "choice").select(c("key").alias("lookup_key"), c("code").alias("_fk"), c("score").alias("_fks"))
    fuzzy_name = best_keys(open_.select(c("street_name").alias("key")), by_name, least=least).join(by_name.where("code is not null").select("choice", "code"), "choice").select(c("key").alias("street_name"), c("code").alias("_fn"), c("score").alias("_fns"))
    found = stored(exact.join(fuzzy_key, "lookup_key", "left").join(fuzzy_name, "street_name", "left"), "street-matches")
    j = rows.join(found, ["lookup_key", "street_name"], "left")
    last = _named(c("last_key"), hoods, 0)
    match = chain(
        (c("clean_text").isNull(), "empty"), (c("street_name").isNull() & _named(c("first_key"), hoods, 0).isNotNull(), "neighborhood_only"), (c("_k").isNotNull(), "exact_lookup_key"), (c("_n").isNotNull(), "exact_name_only"),
        (c("_fk").isNotNull(), "fuzzy_lookup_key"), (c("_fn").isNotNull(), "fuzzy_name_only"), (last.isNotNull(), "trailing_neighborhood_only"), other="not_found",
    )
    j = j.withColumns({"match_type": match, "code": F.coalesce("_k", "_n", "_fk", "_fn")})
    near = nearest_house_number(j.where("code is not null and house_number is not null").select("id", "code", c("house_number").try_cast("long").alias("number")), points).select("id", "code", "number")
    at = near.join(points.select("code", "number", c("district").alias("_d"), c("neighborhood").alias("_h"), c("lat").alias("_lat"), c("lon").alias("_lon")), ["code", "number"]).drop("code", "number")
    only = streets.groupBy("code").agg(F.collect_set("district").alias("ds")).select("code", F.when(F.size("ds") == 1, F.get("ds", 0)).alias("_only"))
    j = j.join(at, "id", "left").join(only, "code", "left")
    kind = lambda *names: c("match_type").isin(*names)
    confidence = chain((kind("neighborhood_only"), 0.72), (kind("exact_lookup_key"), 1.0), (kind("exact_name_only"), 0.96), (kind("trailing_neighborhood_only"), 0.68), other=0.0)
    confidence = F.when(kind("fuzzy_lookup_key"), rounded(c("_fks") / 100, 4)).when(kind("fuzzy_name_only"), rounded(c("_fns") / 100 * 0.97, 4)).otherwise(confidence)
    place = lambda i: F.when(kind("neighborhood_only"), _named(c("first_key"), hoods, i)).when(kind("trailing_neighborhood_only"), _named(c("last_key"), hoods, i))
    return j.select(
        "id", (~kind("empty", "not_found")).alias("matched"), confidence.alias("confidence"), "match_type", c("code").alias("street_code"),
        F.coalesce("_d", "_only", place(1)).alias("district"), F.coalesce("_h", place(0)).alias("neighborhood"), c("_lat").alias("lat"), c("_lon").alias("lon"),
    )


def match_confidence(current: Column) -> Column:
    """The confidence that a match of ``resolve_streets`` gives an asset, never below what it has."""
    c = F.col
    placed = c("neighborhood").isNotNull() | c("lat").isNotNull()
    base = (
        F.when(c("match_type") == "exact_lookup_key", F.when(placed, 0.96).otherwise(0.90))
        .when(c("match_type") == "exact_name_only", F.when(placed, 0.90).otherwise(0.84))
        .when(c("match_type") == "fuzzy_lookup_key", F.greatest(F.lit(0.78), F.least(c("confidence"), F.lit(0.92))))
        .when(c("match_type") == "fuzzy_name_only", F.greatest(F.lit(0.74), F.least(c("confidence") * 0.97, F.lit(0.88))))
        .otherwise(0.72)
    )
    return F.when(c("matched"), rounded(F.greatest(base, F.coalesce(current, base)), 4)).otherwise(current)


def enrich_geography(assets: DataFrame, buildings: DataFrame, streets: DataFrame, points: DataFrame, *, only_missing: bool = False, **options) -> DataFrame:
    """J-20: ``assets`` (id, building_id, address_raw, district, neighborhood, lat, lon, data_confidence) with what the catalogue says, and ``changed``.

    A match overwrites what it knows; what is still missing comes from the building (id, address_base, district, neighborhood,
    lat, lon), itself enriched by its own address. ``only_missing`` leaves alone a row that has any of the four (Q19).
    """
    c = F.col
    geo = ["district", "neighborhood", "lat", "lon"]

    def known(df: DataFrame, address: Column) -> DataFrame:
        return resolve_streets(df.select("id", address.alias("address")), streets, points, **options)

    of_building = known(buildings, c("address_base")).select("id", *[c(x).alias(f"_m_{x}") for x in geo])
    b = buildings.join(of_building, "id", "left").select(c("id").alias("building_id"), c("address_base").alias("_base"), *[F.coalesce(f"_m_{x}", x).alias(f"_b_{x}") for x in geo])
    j = stored(assets.join(b, "building_id", "left").withColumn("_address", F.coalesce("address_raw", "_base")), "placed-assets")
    m = known(j, c("_address")).withColumnsRenamed({x: f"_m_{x}" for x in geo})
    j = stored(j.join(m, "id", "left"), "placed-assets")
    confidence = j.select("id", "data_confidence", "matched", "match_type", "confidence", *[c(f"_m_{x}").alias(x) for x in geo]).select("id", match_confidence(c("data_confidence")).alias("_confidence"))
    j = j.join(confidence, "id")
    skip = F.lit(False)
    if only_missing:
        for x in geo:
            skip = skip | c(x).isNotNull()
    new = {x: F.when(skip, c(x)).otherwise(F.coalesce(f"_m_{x}", x, f"_b_{x}")) for x in geo} | {"data_confidence": F.when(skip, c("data_confidence")).otherwise(c("_confidence"))}
    changed = F.lit(False)
    for x, value in new.items():
        changed = changed | ~c(x).eqNullSafe(value)
    return j.select(*[c(x) for x in assets.columns if x not in new], *[v.alias(x) for x, v in new.items()], changed.alias("changed"))


def renormalized(assets: DataFrame) -> DataFrame:
    """J-20: id, address_raw, address_norm as they are normalised today, and how many of the two changed."""
    c = F.col
    raw, key = F.coalesce(address_base(c("address_raw")), c("address_raw")), F.coalesce(address_key(c("address_raw")), c("address_norm"))
    j = assets.select("id", raw.alias("new_raw"), key.alias("new_norm"), "address_raw", "address_norm")
    changes = (~c("new_raw").eqNullSafe(c("address_raw"))).cast("int") + (~c("new_norm").eqNullSafe(c("address_norm"))).cast("int")
    return j.select("id", c("new_raw").alias("address_raw"), c("new_norm").alias("address_norm"), changes.alias("changes"))


def geo_audit(resolved: DataFrame) -> DataFrame:
    """A-17: one row: total, matched, unmatched, matched_without_point of ``resolve_streets``."""
    c = F.col
    return resolved.agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if(~c("matched")).alias("unmatched"), F.count_if(c("matched") & (c("lat").isNull() | c("lon").isNull())).alias("matched_without_point"))
