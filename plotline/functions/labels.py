"""Zone labels (F-18, F-19): the distinct labels are mapped, then joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.text import normalize_text, text_key

NO_ZONE = "Sin zona"


def _title_if_upper(c: Column) -> Column:
    """Names in capitals with a capital at each word's start only, words also beginning after hyphens, dots and apostrophes; other names as they are."""
    mark = "\u0001 "  # a blank where a word begins that no blank precedes
    titled = F.replace(F.initcap(F.regexp_replace(c, r"([^\p{L}\s])(?=\p{L})", "$1" + mark)), F.lit(mark), F.lit(""))
    return F.when(F.upper(c) == c, titled).otherwise(c)


def canonical_zones(labels: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """F-18: label, zone for the distinct values of ``labels`` (column label) that name a zone of ``known`` (column zone_label)."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(normalize_text(F.col("label")), r"^[ ,\-/]+|[ ,\-/]+$", ""), r" - (Barrio|Zona)", ""))
    named = labels.select("label").where("label is not null").distinct().withColumns({"_key": text_key(F.col("label")), "_name": _title_if_upper(cleaned)})
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        named = named.withColumn("_alias", F.try_element_at(table, F.col("_key")))
    else:
        named = named.withColumn("_alias", F.lit(None).cast("string"))
    zones = known.select(F.col("zone_label").alias("_known")).distinct()
    joined = named.join(zones, F.col("_name") == F.col("_known"), "left")
    return joined.select("label", F.coalesce("_alias", "_known").alias("zone")).where("zone is not null")


def with_zone(df: DataFrame, known: DataFrame, *, neighborhood: str = "neighborhood", district: str = "district", address: str = "address_raw", aliases: dict[str, str] | None = None) -> DataFrame:
    """F-19: ``df`` with column zone_label: of the neighborhood, else the district, else the last address part that names a zone.

    Only distinct labels are mapped; parts with digits or under three characters are passed over.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(address), F.lit("")), ","), lambda p: F.trim(p)), lambda p: ~p.rlike("[0-9]") & (F.length(p) >= 3))
    rows = df.withColumn("_labels", F.array_compact(F.concat(F.array(F.col(neighborhood), F.col(district)), F.reverse(parts))))
    labels = rows.select(F.explode("_labels").alias("label"))
    zones = canonical_zones(labels, known, aliases)
    # the labels that name a zone, no more than there are zones and their spellings
    table = zones.agg(F.map_from_entries(F.collect_list(F.struct("label", "zone"))).alias("_map"))
    found = F.get(F.filter(F.transform(F.col("_labels"), lambda x: F.try_element_at(F.col("_map"), x)), lambda z: z.isNotNull()), 0)
    return rows.crossJoin(F.broadcast(table)).withColumn("zone_label", F.coalesce(found, F.lit(NO_ZONE))).drop("_labels", "_map")


def zone_or_default(c: Column) -> Column:
    return F.coalesce(c, F.lit(NO_ZONE))
