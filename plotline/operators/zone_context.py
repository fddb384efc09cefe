"""The official context of zones, put together from its sources (A-26, A-27)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.numbers import rounded
from plotline.functions.text import blank_to_null, text_key

#: Words of licences; what a census or inspection row must say.
CHANGE_OF_USE = ["cambio de uso", "transformacion locales en viviendas", "transformación locales en viviendas", "locales en viviendas", "local a vivienda"]
NEW_DWELLING = ["incr. n", "incremento n", "incremento de viviendas", "n viviendas"]
RESIDENTIAL = ["residencial", "vivienda"]
#: Measures that a neighborhood takes over from its district.
INHERITED = ["urban_inspections_24m", "discipline_inspections_24m", "vut_records", "vut_units"]


def zone_key(c: Column) -> Column:
    return blank_to_null(text_key(c))


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _levels(rows: DataFrame, *counts: Column) -> DataFrame:
    """zone_level, zone_key and the counts, by grouping sets over the two levels that ``rows`` has (district, neighborhood)."""
    keyed = rows.withColumns({"district": zone_key(F.col("district")), "neighborhood": zone_key(F.col("neighborhood"))})
    out = keyed.groupingSets([["district"], ["neighborhood"]], "district", "neighborhood").agg(F.grouping("district").alias("_g"), *counts)
    level = F.when(F.col("_g") == 0, "district").otherwise("neighborhood")
    return out.withColumns({"zone_level": level, "zone_key": F.coalesce("district", "neighborhood")}).where("zone_key is not null").drop("_g", "district", "neighborhood")


def license_counts(rows: DataFrame, since: Column) -> DataFrame:
    """A-25: licences since a day: urban, residential, change of use, new dwelling. ``rows``: district, neighborhood, day, text."""
    t = F.lower(F.coalesce("text", F.lit("")))
    return _levels(rows.where(F.col("day") >= since), F.count("*").alias("urban_licenses_24m"), F.count_if(_has(t, RESIDENTIAL)).alias("residential_licenses_24m"), F.count_if(_has(t, CHANGE_OF_USE)).alias("change_of_use_24m"), F.count_if(_has(t, NEW_DWELLING)).alias("new_dwelling_24m"))


def inspection_counts(rows: DataFrame, since: Column) -> DataFrame:
    """A-26: inspections since a day, and those of urban discipline, by district. ``rows``: district, day, matter."""
    discipline = F.lower(F.coalesce("matter", F.lit(""))).contains("disciplina urban")
    recent = rows.where(F.col("day") >= since).withColumn("neighborhood", F.lit(None).cast("string"))
    return _levels(recent, F.count("*").alias("urban_inspections_24m"), F.count_if(discipline).alias("discipline_inspections_24m")).where("zone_level = 'district'")


def premises_counts(rows: DataFrame) -> DataFrame:
    """A-26: premises, open, closed and turned into homes. ``rows``: district, neighborhood, status."""
    s = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    home = s.contains("vivienda") & ~s.isin("abierto", "cerrado")
    return _levels(rows, F.count("*").alias("locales_total"), F.count_if(s == "abierto").alias("locales_open"), F.count_if(s == "cerrado").alias("locales_closed"), F.count_if(home).alias("locales_residential_use"))


def tourist_flat_counts(rows: DataFrame) -> DataFrame:
    """A-26: records and units of tourist flats by district. ``rows``: district, units."""
    named = rows.select(F.regexp_replace("district", "Distrito de", "").alias("district"), F.lit(None).cast("string").alias("neighborhood"), F.coalesce("units", F.lit(0)).cast("long").alias("units"))
    return _levels(named, F.count("*").alias("vut_records"), F.sum("units").alias("vut_units")).where("zone_level = 'district'")


def _rate(value: Column, population: Column, per: float) -> Column:
    """Null where value or population is missing or zero (Q12)."""
    return F.when((value != 0) & (population != 0), rounded(value / population * per, 4))


def merged_context(population: DataFrame, *sources: DataFrame) -> DataFrame:
    """A-27: one row for each zone_level and zone_key of any source: of every measure the value of the last source that has one.

    Each source has zone_level, zone_key and measures of its own or shared ones; ``population`` has zone_label, district_label and
    population. A neighborhood takes its district's inspections and tourist flats over, and rates a head are added.
    """
    c = F.col
    keys = ["zone_level", "zone_key"]
    every = [x.withColumn("_n", F.lit(i)) for i, x in enumerate((population, *sources))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
    measures = [x for x in rows.columns if x not in (*keys, "_n")]
    z = rows.groupBy(*keys).agg(*[F.max_by(x, F.when(c(x).isNotNull(), c("_n"))).alias(x) for x in measures])
    have = [x for x in INHERITED if x in measures]
    d = z.where("zone_level = 'district'").select(c("zone_key").alias("_d"), *[c(x).alias(f"district_{x}") for x in have])
    z = z.withColumn("_d", F.when(c("zone_level") == "neighborhood", zone_key(c("district_label")))).join(d, "_d", "left").drop("_d")
    of = lambda x: c(x) if x in measures else F.lit(None).cast("long")
    own = lambda x: F.coalesce(F.nullif(of(x), F.lit(0)), c(f"district_{x}")) if x in measures else F.lit(None).cast("long")
    return z.withColumns({
        "change_of_use_per_10k_population": _rate(of("change_of_use_24m"), c("population"), 10000.0), "urban_inspections_per_10k_population": _rate(own("urban_inspections_24m"), c("population"), 10000.0),
        "closed_locales_per_1k_population": _rate(of("locales_closed"), c("population"), 1000.0), "vut_units_per_1k_population": _rate(own("vut_units"), c("population"), 1000.0),
    })


def context_summary(context: DataFrame) -> DataFrame:
    """A-27: how many zones of each level have each kind of measure."""
    c = F.col
    some = lambda x: F.count_if(F.coalesce(c(x), F.lit(0)) != 0)
    return context.groupBy("zone_level").agg(F.count("*").alias("zones"), some("population").alias("with_population"), some("change_of_use_24m").alias("with_change_of_use"), some("urban_inspections_24m").alias("with_inspections"), some("locales_closed").alias("with_closed_locales"))
