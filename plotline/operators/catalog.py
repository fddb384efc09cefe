"""The dataset catalogue: themes, focus, summaries and downloads (A-28, A-29, P-09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.text import fold_accents, slug, where_computed

#: Words of each theme, in the order in which themes win ties.
THEMES = {
    "boundaries_geography": ["barrio", "barrios", "distrito", "distritos", "seccion censal", "callejero", "cartografia", "geojson", "geolocalizacion", "limites administrativos", "zonificacion", "portal"],
    "demography": ["poblacion", "padron", "habitantes", "edad", "sexo", "hogares", "nacionalidad", "demografia", "nacimientos", "migracion"],
    "housing_urbanism": ["vivienda", "viviendas", "urban", "urbanismo", "licencias urbanisticas", "licencia", "declaraciones responsables", "catastro", "suelo", "turistico", "arrendamiento", "alquiler", "mercado inmobiliario", "planeamiento"],
    "socioeconomic": ["renta", "paro", "desempleo", "vulnerabilidad", "iguala", "servicios sociales", "economica", "actividad economica", "hogares", "ingresos"],
    "amenities_services": ["equipamientos", "mercados", "colegios", "centros educativos", "hospitales", "salud", "bibliotecas", "deportes", "servicios", "centros", "parques", "zonas verdes"],
    "mobility_access": ["transporte", "emt", "metro", "bicimad", "aparcamientos", "movilidad", "trafico", "autobus", "lineas", "accesibilidad"],
    "environment": ["calidad del aire", "aire", "ruido", "acustica", "arbolado", "zonas verdes", "temperatura", "clima", "contaminacion", "emisiones"],
    "safety_incidents": ["accidentes", "incidencias", "seguridad", "siniestralidad", "emergencias", "trafico"],
}
#: What a word counts in each field; words that add to a theme; formats; from which score on a dataset is in focus, and title words that put it there.
WEIGHTS = {"title": 5, "tags": 4, "groups": 3, "notes": 2, "resources": 1}
PEOPLE, HOMES = ["poblacion", "padron", "habitantes", "demografia"], ["vivienda", "licencia", "urbanismo", "catastro"]
GEOSPATIAL, TABULAR = ["geojson", "kml", "kmz", "shp", "gpkg", "wms", "wfs"], ["csv", "xlsx", "xls", "json", "xml", "txt"]
DOWNLOADABLE = ["csv", "json", "geojson", "xlsx", "xls", "zip", "txt", "xml", "kml", "kmz", "shp", "gpkg", "pdf"]
FOCUS_SCORE, FOCUS_TITLES = 7, ["barrio", "distrito", "vivienda", "licencias urbanisticas", "padron", "equipamientos", "calidad del aire", "zonas verdes"]


def plain_text(c: Column) -> Column:
    """Lower case without marks, white space collapsed; '' for null."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(F.coalesce(c.cast("string"), F.lit("")))), r"\s+", " "))


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def with_themes(datasets: DataFrame) -> DataFrame:
    """A-28: ``datasets`` with formats, theme_scores and theme_hits (maps), primary_theme, focus_score, is_focus.

    ``datasets``: portal_id, dataset_id, title, notes, tags, groups, granularity, resources (array of struct name, description, format,
    url, downloadable). Ties go to the first theme; people, then homes, take over where their words occur and their score is as high (Q26).
    """
    c = F.col
    described = F.transform("resources", lambda r: F.concat_ws(" ", r["name"], r["description"], r["format"]))
    texts = {"title": c("title"), "tags": F.array_join("tags", " "), "groups": F.array_join("groups", " "), "notes": c("notes"), "resources": F.array_join(described, " ")}
    formats = F.array_distinct(F.transform(F.filter("resources", lambda r: r["format"].isNotNull()), lambda r: plain_text(r["format"])))
    t = datasets.withColumns({f"_{k}": plain_text(v) for k, v in texts.items()} | {"formats": formats, "_grain": plain_text(c("granularity"))})
    overlap = lambda words: F.arrays_overlap("formats", F.array(*[F.lit(x) for x in words]))
    t = t.withColumns({"has_geospatial": overlap(GEOSPATIAL), "has_tabular": overlap(TABULAR)})
    words = F.array(*[F.struct(F.lit(theme).alias("theme"), F.lit(w).alias("word")) for theme, ws in THEMES.items() for w in ws])
    weight = lambda k: reduce(lambda a, b: a + b, [F.contains(c(f"_{f}"), k["word"]).cast("int") * n for f, n in WEIGHTS.items()])
    hits = F.filter(F.transform(words, lambda k: F.struct(k["theme"].alias("theme"), k["word"].alias("word"), weight(k).alias("n"))), lambda h: h["n"] > 0)
    both = F.concat_ws(" ", "_title", "_notes")
    flags = F.struct((c("_grain").contains("barrio") | c("_grain").contains("distrito")).cast("int").alias("grain"), _any(both, PEOPLE).cast("int").alias("people"), _any(both, HOMES).cast("int").alias("homes"), c("has_geospatial").cast("int").alias("geo"), c("has_tabular").cast("int").alias("tab"))
    t = t.withColumns({"_hits": hits, "_flags": flags})
    f = c("_flags")
    more = {
        "boundaries_geography": 2 * f["grain"] + 2 * f["geo"], "demography": 2 * f["grain"] + 4 * f["people"] + f["tab"], "housing_urbanism": 2 * f["homes"] + f["tab"], "environment": f["geo"],
    }

    def scored(theme: str) -> Column:
        found = F.filter("_hits", lambda h: h["theme"] == theme)
        own = F.aggregate(found, F.lit(0), lambda a, h: a + h["n"]) + more.get(theme, F.lit(0))
        return F.struct(own.alias("n"), F.transform(found, lambda h: h["word"]).alias("words"))

    t = t.withColumn("_themes", F.array(*[scored(k) for k in THEMES]))
    at = list(THEMES).index
    n = lambda i: F.get("_themes", i)["n"]
    best = F.array_max(F.transform("_themes", lambda x, i: F.struct(x["n"].alias("n"), (-i).alias("i"))))
    t = t.withColumn("_best", best)
    homes = (f["homes"] == 1) & (n(at("housing_urbanism")) >= c("_best.n"))
    people = (f["people"] == 1) & (n(at("demography")) >= c("_best.n"))
    names = F.array(*[F.lit(k) for k in THEMES])
    primary = F.when(homes, "housing_urbanism").when(people, "demography").otherwise(F.get(names, -c("_best.i")))
    return t.select(
        *datasets.columns, "formats", "has_geospatial", "has_tabular", F.map_from_arrays(names, F.transform("_themes", lambda x: x["n"])).alias("theme_scores"), F.map_from_arrays(names, F.transform("_themes", lambda x: x["words"])).alias("theme_hits"),
        primary.alias("primary_theme"), c("_best.n").alias("focus_score"), ((c("_best.n") >= FOCUS_SCORE) | _any(c("_title"), FOCUS_TITLES)).alias("is_focus"),
    )


def catalog_summary(themed: DataFrame) -> DataFrame:
    """A-29: portal_id (null: all), primary_theme (null: all), datasets, focus: by grouping sets."""
    out = themed.groupingSets([["portal_id", "primary_theme"], ["portal_id"], ["primary_theme"], []], "portal_id", "primary_theme")
    return out.agg(F.count("*").alias("datasets"), F.count_if("is_focus").alias("focus"))


def top_focus(themed: DataFrame, k: int = 5) -> DataFrame:
    """A-29: the k best datasets in focus of each theme: by score, title, id."""
    order = Window.partitionBy("primary_theme").orderBy(F.col("focus_score").desc(), F.coalesce("title", F.lit("")), "dataset_id")
    return where_computed(themed, F.col("is_focus")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("primary_theme", "place", "dataset_id", "title", "portal_id", "focus_score")


def download_candidates(themed: DataFrame, *, theme: str | None = None, portal_id: str | None = None, formats: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """P-09: the downloadable resources of datasets in focus, with a slug, in order of score, theme, title and slug."""
    c = F.col
    rows = where_computed(themed, c("is_focus"))
    if theme:
        rows = rows.where(c("primary_theme") == theme)
    if portal_id:
        rows = rows.where(c("portal_id") == portal_id)
    r = rows.select("portal_id", "dataset_id", "title", "primary_theme", "focus_score", F.explode("resources").alias("resource")).withColumn("format", plain_text(c("resource.format")))
    r = r.where(c("format").isin([f.lower() for f in (formats or DOWNLOADABLE)]) | (c("format") == "")).where("resource.downloadable")
    named = F.regexp_replace(slug(F.concat_ws("_", "portal_id", "title", F.coalesce("resource.name", "format"))), "-", "_")
    out = r.select("portal_id", "dataset_id", "title", "primary_theme", "focus_score", "format", c("resource.url").alias("url"), F.when(named != "", named).otherwise("dataset").alias("slug"))
    out = out.orderBy(c("focus_score").desc(), "primary_theme", F.coalesce("title", F.lit("")), "slug")
    return out.limit(limit) if limit is not None else out
