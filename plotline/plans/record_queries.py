"""Records, context, catalogue, texts, assets and streets: queries beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions.bands import match_band
from plotline.functions.numbers import rounded
from plotline.functions.semantics import address_semantics, price_semantics
from plotline.operators import captures, catalog, context, explanations, geography, identity, opportunities, profiles, quality, search, zone_context
from plotline.plans.more_queries import _search_docs, comparables
from plotline.plans.sample import cte, view
from plotline.plans.zone_queries import queue, scored_v2

_R = lambda x, n: f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"

# captured records: one JSON payload for each order

_PAYLOAD = """concat('{"url": "https://api.example.com/items?historyType=', CASE o_orderkey % 4 WHEN 0 THEN 'price-drop' WHEN 1 THEN 'sold' ELSE 'x' END, '", "data": [{"title": "Piso en venta en Calle Mayor ', CAST(o_custkey AS STRING), ' - Barrio Sol", "listingId": "L', CAST(o_orderkey AS STRING),
    '", "portal": "', CASE o_orderkey % 3 WHEN 0 THEN 'Idealista' WHEN 1 THEN 'fotocasa.es' ELSE '' END, '", "price": ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ', "seller": {"phone": "+34 6', lpad(CAST(o_custkey AS STRING), 8, '0'), '", "name": "Ana Lopez ', CAST(o_custkey % 7 AS STRING),
    '"}, "eventDate": "2024-01-1', CAST(o_orderkey % 10 AS STRING), 'T10:20:00", "status": "', CASE WHEN o_orderkey % 5 = 0 THEN 'reservado' ELSE '' END, '"}, {"geometry": {"x": 1}}]}')"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "orders").select(F.concat(F.lit("https://page.example.com/"), F.col("o_orderkey").cast("string")).alias("page_url"), F.lit(1).alias("page_number"), F.expr(_PAYLOAD).alias("content"))


def flow_records(spark: SparkSession, d: str) -> DataFrame:
    found = captures.flow_records(captures.payload_records(_payloads(spark, d)))
    return found.select("page_url", "event_type_guess", "portal", "contact_name", "contact_phone", "current_price_eur", "source_listing_id", "address_raw", F.date_format("event_datetime", "yyyy-MM-dd HH:mm").alias("at"), "listing_fingerprint", "source_uid")


_FLOW_RECORDS = """WITH t AS (SELECT *, 'Calle Mayor ' || o_custkey AS address, CASE o_orderkey % 3 WHEN 0 THEN 'Idealista' WHEN 1 THEN 'Fotocasa' END AS portal, CASE WHEN o_orderkey % 5 = 0 THEN 'reserved' WHEN o_orderkey % 4 = 0 THEN 'price_drop' WHEN o_orderkey % 4 = 1 THEN 'sold' ELSE 'history_item' END AS kind,
        '2024-01-1' || (o_orderkey % 10) AS day, floor(o_totalprice) AS price, lpad(o_custkey::VARCHAR, 8, '0') AS num FROM orders),
    u AS (SELECT *, CASE WHEN portal IS NULL THEN 'phone|6' || num ELSE 'portal_listing_id|' || lower(portal) || '|l' || o_orderkey END AS fp, CASE WHEN price BETWEEN 30000 AND 50000000 THEN price::DOUBLE END AS ok FROM t)
    SELECT 'https://page.example.com/' || o_orderkey AS page_url, kind AS event_type_guess, portal, 'Ana Lopez ' || (o_custkey % 7) AS contact_name, '+34 6' || num AS contact_phone, ok AS current_price_eur, 'L' || o_orderkey AS source_listing_id, address AS address_raw,
           day || ' 10:20' AS at, fp AS listing_fingerprint, sha1('event|' || fp || '|' || replace(kind, '_', '') || '|' || day || 'T10:20|' || coalesce(CAST(ok AS BIGINT)::VARCHAR, 'na') || '|na') AS source_uid FROM u WHERE kind <> 'history_item'"""


def extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = view(spark, d, "orders").select((c("o_custkey") % 200).cast("string").alias("page_url"), (c("o_custkey") % 200).cast("int").alias("page_number"), c("o_orderkey"))
    network = rows.where("o_orderkey % 9 = page_number % 9").select("page_url", "page_number", c("o_orderkey").cast("string").alias("source_uid"))  # what the network had
    cards = rows.select("page_url", "page_number", F.concat(F.lit("c"), (c("o_orderkey") % 5000).cast("string")).alias("source_uid"))
    return captures.extraction_coverage(network, cards, rows.groupBy("page_url").agg(F.count("*").alias("total")))


_COVERAGE = """WITH r AS (SELECT (o_custkey % 200)::VARCHAR AS page_url, o_custkey % 200 AS pn, o_orderkey AS k FROM orders), n AS (SELECT DISTINCT page_url, pn, k::VARCHAR AS uid FROM r WHERE k % 9 = pn % 9), used AS (SELECT page_url FROM n GROUP BY 1 HAVING count(*) >= 3),
    a AS (SELECT page_url, pn, uid, 'network' AS how FROM n WHERE page_url IN (SELECT page_url FROM used) UNION ALL SELECT DISTINCT page_url, pn, 'c' || (k % 5000), 'cards' FROM r WHERE page_url NOT IN (SELECT page_url FROM used)),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY pn, page_url) AS i FROM a) q WHERE i = 1), g AS (SELECT page_url, how, count(*) AS items FROM f GROUP BY 1, 2), t AS (SELECT page_url, count(*) AS announced FROM r GROUP BY 1)
    SELECT page_url, how, items, announced, greatest(announced - items, 0) AS gap FROM g LEFT JOIN t USING (page_url)"""

# chat alerts: one message for each order

_MESSAGE = """concat(CASE o_orderkey % 3 WHEN 0 THEN 'Piso' WHEN 1 THEN 'Ático' ELSE 'Studio' END, ':  Calle Mayor ', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 11 = 0 THEN ', Getafe' ELSE '' END, CASE WHEN o_orderkey % 13 = 0 THEN ' hola' ELSE ' Venta:' END, ' € ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' (€ 3.200/m²) Área total: ', CAST(o_orderkey % 200 + 20 AS STRING), ' m² Dormitorios: ',
    CAST(o_orderkey % 5 AS STRING), ' Baños: ', CAST(o_orderkey % 3 AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN ' Bajada de precio' ELSE '' END, ' Idealista: Ana ', CAST(o_custkey % 9 AS STRING), ' Contactos: 6', lpad(CAST(o_custkey AS STRING), 8, '0'), ' Número de anuncios de este propietario: ', CAST(o_custkey % 6 AS STRING), ' Nombre de la alerta: centro ', CAST(o_custkey % 4 AS STRING))"""


def chat_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    div = F.concat(F.lit("<div class='message default' id='m"), key, F.lit("'><div class='pull_right date details' title='"), F.lpad((F.col("o_orderkey") % 28 + 1).cast("string"), 2, "0"), F.lit(".01.2024 10:11:12 UTC'>x</div><div class='text'>"), F.expr(_MESSAGE), F.lit(" <a href='https://www.es.portal.example.com/l/"), key, F.lit("?a=1'>ver</a></div></div>"))
    found = captures.chat_alerts(captures.chat_messages(rows.select(key.alias("source_file"), div.alias("html"))))
    return found.select(
        "external_message_id", "event_type_guess", "property_type_raw", "address_raw", "price_eur", "price_per_m2", "area_m2", "bedrooms", "bathrooms", "listing_url", "source_portal", "contact_phone_raw", "contact_name_raw", "owner_listing_count",
        F.date_format("message_datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), "canonical_key",
    )


_CHAT = """WITH t AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'price_drop' ELSE 'listing_detected' END AS kind, 'https://portal.example.com/l/' || o_orderkey AS url, '2024-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') AS day, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)
    SELECT 'm' || o_orderkey AS external_message_id, kind AS event_type_guess, CASE o_orderkey % 3 WHEN 0 THEN 'piso' WHEN 1 THEN 'atico' ELSE 'estudio' END AS property_type_raw, 'Calle Mayor ' || o_custkey AS address_raw, price::DOUBLE AS price_eur, 3200e0 AS price_per_m2, CAST(o_orderkey % 200 + 20 AS DOUBLE) AS area_m2,
           CAST(o_orderkey % 5 AS INTEGER) AS bedrooms, CAST(o_orderkey % 3 AS INTEGER) AS bathrooms, url AS listing_url, 'Idealista' AS source_portal, '6' || lpad(o_custkey::VARCHAR, 8, '0') AS contact_phone_raw, 'Ana ' || (o_custkey % 9) AS contact_name_raw, CAST(o_custkey % 6 AS INTEGER) AS owner_listing_count, day || ' 10:11:12' AS at,
           sha1(url || '|' || day || '|' || kind || '|' || price) AS canonical_key FROM t WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0"""

# context


def _licences(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    nation = view(spark, d, "nation").join(view(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").cast("long").alias("_n"), c("n_name").alias("neighborhood"), c("r_name").alias("district"))
    words = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Cambio de uso, local a vivienda' WHEN 1 THEN 'Uso residencial' WHEN 2 THEN 'Incr. N viviendas' ELSE o_orderpriority END")
    return view(spark, d, "orders").withColumn("_n", (c("o_custkey") % 25).cast("long")).join(nation, "_n").select("district", "neighborhood", c("o_orderdate").cast("date").alias("day"), words.alias("text"), "o_orderkey", "o_orderstatus")


def _context(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    r, since = _licences(spark, d), F.to_date(F.lit("1996-01-01"))
    nation = view(spark, d, "nation").join(view(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    n = nation.select(F.lit("neighborhood").alias("zone_level"), zone_context.zone_key(c("n_name")).alias("zone_key"), c("n_name").alias("zone_label"), c("r_name").alias("district_label"), (c("n_nationkey") * 731).cast("long").alias("population"))
    p = n.unionByName(view(spark, d, "region").select(F.lit("district").alias("zone_level"), zone_context.zone_key(c("r_name")).alias("zone_key"), c("r_name").alias("zone_label"), F.lit(None).cast("string").alias("district_label"), (c("r_regionkey") * 9177 + 5).cast("long").alias("population")))
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN ' Abierto ' WHEN 'F' THEN 'Cerrado' ELSE 'Uso vivienda' END")
    return zone_context.merged_context(
        p, zone_context.license_counts(r, since), zone_context.inspection_counts(r.withColumn("matter", F.when(c("o_orderkey") % 2 == 0, "Disciplina urbanística")), since), zone_context.premises_counts(r.withColumn("status", status)),
        zone_context.tourist_flat_counts(r.where("text like 'Uso%'").select(F.concat(F.lit("Distrito de"), "district").alias("district"), (c("o_orderkey") % 4).alias("units"))),
    )


CONTEXT = ["zone_level", "zone_key", "zone_label", "population", "urban_licenses_24m", "residential_licenses_24m", "change_of_use_24m", "new_dwelling_24m", "urban_inspections_24m", "discipline_inspections_24m", "locales_total", "locales_open", "locales_closed", "locales_residential_use", "vut_records", "vut_units", "district_vut_units", "change_of_use_per_10k_population", "urban_inspections_per_10k_population", "closed_locales_per_1k_population", "vut_units_per_1k_population"]


def zone_context_merged(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select(*CONTEXT)


def context_summary(spark: SparkSession, d: str) -> DataFrame:
    return zone_context.context_summary(_context(spark, d))


_K = lambda x: f"replace(lower({x}), '_', '')"
_RATE = lambda v, n: f"CASE WHEN {v} <> 0 AND population <> 0 THEN {_R(f'{v}::DOUBLE / population * {n}', 4)} END"
_LEVELS = lambda body, where="": " UNION ALL ".join(f"SELECT '{lv}' AS zone_level, {_K(lv)} AS zone_key, {body} FROM li {where} GROUP BY 2" for lv in ("district", "neighborhood"))
_CONTEXT = f"""WITH li AS (SELECT r_name AS district, n_name AS neighborhood, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, o_orderstatus AS s, CASE o_orderkey % 5 WHEN 0 THEN 'Cambio de uso, local a vivienda' WHEN 1 THEN 'Uso residencial' WHEN 2 THEN 'Incr. N viviendas' ELSE o_orderpriority END AS t FROM orders JOIN nation ON n_nationkey = o_custkey % 25 JOIN region ON r_regionkey = n_regionkey),
    p AS (SELECT 'neighborhood' AS zone_level, {_K('n_name')} AS zone_key, n_name AS zone_label, {_K('r_name')} AS dk, CAST(n_nationkey * 731 AS BIGINT) AS population FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'district', {_K('r_name')}, r_name, NULL, CAST(r_regionkey * 9177 + 5 AS BIGINT) FROM region),
    lc AS ({_LEVELS("count(*) AS urban_licenses_24m, count(*) FILTER (k % 5 < 3) AS residential_licenses_24m, count(*) FILTER (k % 5 = 0) AS change_of_use_24m, count(*) FILTER (k % 5 = 2) AS new_dwelling_24m", "WHERE day >= DATE '1996-01-01'")}),
    ins AS (SELECT 'district' AS zone_level, {_K('district')} AS zone_key, count(*) AS urban_inspections_24m, count(*) FILTER (k % 2 = 0) AS discipline_inspections_24m FROM li WHERE day >= DATE '1996-01-01' GROUP BY 2),
    pr AS ({_LEVELS("count(*) AS locales_total, count(*) FILTER (s = 'O') AS locales_open, count(*) FILTER (s = 'F') AS locales_closed, count(*) FILTER (s NOT IN ('O', 'F')) AS locales_residential_use")}),
    vu AS (SELECT 'district' AS zone_level, {_K('district')} AS zone_key, count(*) AS vut_records, CAST(sum(k % 4) AS BIGINT) AS vut_units FROM li WHERE k % 5 = 1 GROUP BY 2),
    m AS (SELECT * FROM p LEFT JOIN lc USING (zone_level, zone_key) LEFT JOIN ins USING (zone_level, zone_key) LEFT JOIN pr USING (zone_level, zone_key) LEFT JOIN vu USING (zone_level, zone_key)),
    f AS (SELECT m.*, dv.vut_units AS district_vut_units, coalesce(nullif(m.urban_inspections_24m, 0), dv.urban_inspections_24m) AS ui, coalesce(nullif(m.vut_units, 0), dv.vut_units) AS vv FROM m LEFT JOIN m dv ON dv.zone_level = 'district' AND dv.zone_key = m.dk),
    z AS (SELECT * EXCLUDE (dk, ui, vv), {_RATE('change_of_use_24m', 10000)} AS change_of_use_per_10k_population, {_RATE('ui', 10000)} AS urban_inspections_per_10k_population, {_RATE('locales_closed', 1000)} AS closed_locales_per_1k_population, {_RATE('vv', 1000)} AS vut_units_per_1k_population FROM f)"""
_SUMMARY = _CONTEXT + " SELECT zone_level, count(*) AS zones, count(*) FILTER (population <> 0) AS with_population, count(*) FILTER (change_of_use_24m <> 0) AS with_change_of_use, count(*) FILTER (urban_inspections_24m <> 0) AS with_inspections, count(*) FILTER (locales_closed <> 0) AS with_closed_locales FROM z GROUP BY 1"

# catalogue: a dataset for each part

_TITLE = "CASE p_partkey % 6 WHEN 0 THEN 'Población por barrio' WHEN 1 THEN 'Licencias urbanísticas' WHEN 2 THEN 'Calidad del aire' WHEN 3 THEN 'Paradas de autobús' ELSE concat('Datos ', p_name) END"
_NOTES = "CASE p_partkey % 4 WHEN 0 THEN 'Renta y paro de los hogares' WHEN 1 THEN 'vivienda en alquiler' ELSE p_type END"


def _themed(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    resource = F.expr("array(named_struct('name', concat('r', CAST(p_partkey AS STRING)), 'description', CAST(NULL AS STRING), 'format', CASE p_partkey % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'GeoJSON' ELSE 'html' END, 'url', concat('https://d.example.com/', CAST(p_partkey AS STRING)), 'downloadable', p_partkey % 5 < 4))")
    rows = view(spark, d, "part").select(
        F.concat(F.lit("portal"), (c("p_partkey") % 2).cast("string")).alias("portal_id"), c("p_partkey").alias("dataset_id"), F.expr(_TITLE).alias("title"), F.expr(_NOTES).alias("notes"), F.array(F.when(c("p_partkey") % 7 == 0, "movilidad").otherwise("otros")).alias("tags"),
        F.array(F.lit("ciudad")).alias("groups"), F.when(c("p_partkey") % 8 == 0, "Distrito").alias("granularity"), resource.alias("resources"),
    )
    return catalog.with_themes(rows)


def theme_scores(spark: SparkSession, d: str) -> DataFrame:
    t = _themed(spark, d)
    return t.select("dataset_id", "primary_theme", "focus_score", "is_focus", *[F.col("theme_scores")[k].alias(k) for k in catalog.THEMES])


def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_summary(_themed(spark, d))


def top_focus(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top_focus(_themed(spark, d)).select("primary_theme", "place", "dataset_id", "focus_score")


def download_candidates(spark: SparkSession, d: str) -> DataFrame:
    return catalog.download_candidates(_themed(spark, d)).select("dataset_id", "format", "slug")


def _theme_sql() -> str:
    words = ", ".join(f"('{k}', {i}, '{w}')" for i, (k, ws) in enumerate(catalog.THEMES.items()) for w in ws)
    low = lambda x: f"lower(strip_accents({x}))"
    title, notes = _TITLE, _NOTES
    return f"""WITH d AS (SELECT p_partkey AS id, {low(title)} AS title, {low(notes)} AS notes, CASE WHEN p_partkey % 7 = 0 THEN 'movilidad' ELSE 'otros' END AS tags, 'r' || p_partkey || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'geojson' ELSE 'html' END AS res, p_partkey % 3 = 0 AS tab, p_partkey % 3 = 1 AS geo, p_partkey % 8 = 0 AS grain, 'portal' || (p_partkey % 2) AS portal_id FROM part),
    w(theme, i, word) AS (VALUES {words}),
    s AS (SELECT id, theme, i, sum(5 * contains(title, word)::INT + 4 * contains(tags, word)::INT + 3 * contains('ciudad', word)::INT + 2 * contains(notes, word)::INT + contains(res, word)::INT) AS n FROM d CROSS JOIN w GROUP BY 1, 2, 3),
    fl AS (SELECT *, regexp_matches(title || ' ' || notes, 'poblacion|padron|habitantes|demografia') AS people, regexp_matches(title || ' ' || notes, 'vivienda|licencia|urbanismo|catastro') AS homes FROM d),
    b AS (SELECT id, theme, i, CAST(n + CASE theme WHEN 'boundaries_geography' THEN 2 * grain::INT + 2 * geo::INT WHEN 'demography' THEN 2 * grain::INT + 4 * people::INT + tab::INT WHEN 'housing_urbanism' THEN 2 * homes::INT + tab::INT WHEN 'environment' THEN geo::INT ELSE 0 END AS INTEGER) AS n FROM s JOIN fl USING (id)),
    x AS (SELECT id, arg_max(theme, n * 100 - i) AS first, max(n) AS best, max(n) FILTER (theme = 'demography') AS dem, max(n) FILTER (theme = 'housing_urbanism') AS hou FROM b GROUP BY 1),
    th AS (SELECT fl.id AS dataset_id, fl.*, CASE WHEN homes AND hou >= best THEN 'housing_urbanism' WHEN people AND dem >= best THEN 'demography' ELSE first END AS primary_theme, best AS focus_score, best >= 7 OR regexp_matches(title, 'barrio|distrito|vivienda|licencias urbanisticas|padron|equipamientos|calidad del aire|zonas verdes') AS is_focus FROM x JOIN fl USING (id))"""


# texts


def explain_zones(spark: SparkSession, d: str) -> DataFrame:
    return explanations.explain_zones(scored_v2(spark, d))


def explain_opportunities(spark: SparkSession, d: str) -> DataFrame:
    zones = scored_v2(spark, d).select("zone_label", "zone_confidence_score")
    return explanations.explain_opportunities(queue(spark, d).join(zones, "zone_label", "left"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    v = lambda n: view(spark, d, n)
    phones = profiles.phone_profiles(v("listings"), v("contacts")).select(F.right("phone_norm", F.lit(9)).alias("contact_phone"), "phone_profile")
    items = v("flow_items").select(c("id").alias("flow_item_id"), "contact_phone", "contact_name", "portal", "listing_url", "address_raw", "current_price_eur", "previous_price_eur", "event_datetime")
    links = v("links").join(items, "flow_item_id").join(phones, "contact_phone", "left").withColumns({"address_precision": address_semantics(c("address_raw"))["address_precision"], "is_new": F.lit(False), "band": match_band(c("match_status"), c("match_score"))})
    links = links.withColumn("price_confidence", price_semantics(c("current_price_eur"), c("previous_price_eur"), F.lit("venta"))["price_confidence"])
    return links.join(context.reason_taxonomy(links), "flow_item_id")


_CASES = cte("flow_items", "links", "listings", "contacts") + """, pf AS (SELECT phone_norm, CASE WHEN a = 1 AND b <= 1 AND c <= 1 THEN 'owner_like' WHEN a >= 4 OR b >= 3 OR c >= 3 THEN 'broker_like' ELSE 'unknown' END AS phone_profile
        FROM (SELECT phone_norm, count(DISTINCT l.id) AS a, count(DISTINCT asset_id) AS b, count(DISTINCT source_portal) AS c FROM listings l JOIN contacts k ON k.id = l.contact_id GROUP BY 1) t),
    cs AS (SELECT flow_item_id, match_status, match_score, match_note, f.event_datetime, f.address_raw, f.contact_name, f.contact_phone, f.portal, f.listing_url, phone_profile, contains(lower(f.address_raw), 'barrio') AS zonal, current_price_eur AS cp, previous_price_eur AS pp FROM links JOIN flow_items f ON f.id = flow_item_id LEFT JOIN pf ON pf.phone_norm = '+34' || f.contact_phone),
    ca AS (SELECT *, CASE WHEN match_status = 'resolved' THEN CASE WHEN match_score >= 90 THEN 'resolved_strong' ELSE 'resolved_soft' END WHEN match_status = 'ambiguous' THEN 'ambiguous_multiple_candidates' WHEN match_status = 'pending' THEN 'pending_review' WHEN zonal AND listing_url IS NULL AND contact_phone IS NULL THEN 'zone_only_address'
            WHEN phone_profile = 'broker_like' THEN 'repeated_phone_conflict' WHEN contains(match_note, 'precio lejos') THEN 'price_conflict' ELSE 'weak_identity' END AS reason,
        CASE WHEN match_status <> 'resolved' THEN CASE WHEN match_score >= 55 THEN 'dudoso' ELSE 'sin_match' END WHEN match_score >= 90 THEN 'alto' WHEN match_score >= 75 THEN 'medio' ELSE 'bajo' END AS band,
        CASE WHEN cp IS NULL THEN 'none' WHEN cp < 30000 OR cp > 50000000 THEN 'low' WHEN pp IS NOT NULL THEN 'high' ELSE 'medium' END AS conf FROM cs)"""


def explain_cases(spark: SparkSession, d: str) -> DataFrame:
    return explanations.explain_cases(_cases(spark, d))


def filter_links(spark: SparkSession, d: str) -> DataFrame:
    rows, reviews = _cases(spark, d), view(spark, d, "reviews")
    out = None
    for focus in ("review_needed", "poor_address", "repeated_phone", "weak_identity", "price_conflict"):
        part = quality.filter_links(rows, reviews, status="unresolved" if focus != "review_needed" else None, focus=focus, query="barrio" if focus == "poor_address" else "", limit=500).select(F.lit(focus).alias("focus"), "flow_item_id")
        out = part if out is None else out.unionByName(part)
    return out


def _name_sql(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_E = explanations
_EXPLAINED = _CASES + f""", ex AS (SELECT *, {_name_sql('reason', _E.REASON_NAMES)} AS human, list_filter([{_name_sql('reason', _E.REASON_NAMES)}, CASE WHEN zonal THEN 'la direccion apunta mas a zona que a inmueble' END, CASE phone_profile WHEN 'broker_like' THEN 'el telefono aparece en muchos anuncios' WHEN 'owner_like' THEN 'el telefono parece bastante especifico' END,
        CASE conf WHEN 'high' THEN 'el precio es util para contrastar' WHEN 'low' THEN 'el precio ayuda poco' END], lambda x: x IS NOT NULL) AS clues FROM ca)
    SELECT flow_item_id, coalesce({_name_sql('match_status', _E.STATE_NAMES)}, 'Caso sin resolver') || '. Banda ' || band || '. La lectura actual sugiere que ' || array_to_string(clues[1:3], ', ') || '.' AS summary, upper(human[1]) || human[2:] || '.' AS brief,
        CASE WHEN match_status = 'resolved' THEN '{_E.CASE_STEPS['resolved']}' WHEN match_status = 'ambiguous' THEN '{_E.CASE_STEPS['ambiguous']}' WHEN reason IN ('weak_identity', 'zone_only_address', 'repeated_phone_conflict') THEN '{_E.CASE_STEPS['weak']}' ELSE '{_E.CASE_STEPS['other']}' END AS next_step FROM ex"""
_TOP = lambda where: f"SELECT * FROM ca {where} ORDER BY event_datetime DESC, flow_item_id DESC LIMIT 500"
_FOCUS = _CASES + f""", al AS ({_TOP('')}), un AS ({_TOP("WHERE match_status = 'unresolved'")}), rv AS (SELECT DISTINCT flow_item_id FROM (SELECT CAST(floor(event_id / 2) AS BIGINT) AS flow_item_id FROM events) q)
    SELECT 'review_needed' AS focus, flow_item_id FROM al WHERE match_status IN ('ambiguous', 'unresolved', 'pending') AND flow_item_id NOT IN (SELECT flow_item_id FROM rv)
    UNION ALL SELECT 'poor_address', flow_item_id FROM un WHERE zonal UNION ALL SELECT 'repeated_phone', flow_item_id FROM un WHERE phone_profile = 'broker_like'
    UNION ALL SELECT 'weak_identity', flow_item_id FROM un WHERE reason IN ('weak_identity', 'zone_only_address', 'repeated_phone_conflict') UNION ALL SELECT 'price_conflict', flow_item_id FROM un WHERE reason = 'price_conflict'"""


def opportunity_detail(spark: SparkSession, d: str) -> DataFrame:
    found = opportunities.opportunity_detail(queue(spark, d), comparables(spark, d))
    return found.select("event_id", "asset_id", rounded(F.col("score"), 2).alias("score"), F.array_join(F.transform("comparables", lambda x: x.cast("string")), ",").alias("comparables"))


# assets and streets


def match_asset(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    n = view(spark, d, "n_parts")
    rows = view(spark, d, "orders").crossJoin(F.broadcast(n)).withColumn("id", (c("o_orderkey") * 7919) % c("n")).join(view(spark, d, "assets"), "id")
    house = F.when(c("o_orderkey") % 3 > 0, F.concat_ws("|", "address_norm", (c("id") % 90).cast("string")))
    rows = rows.select(c("o_orderkey").alias("row_id"), "address_norm", house.alias("building_id"), "asset_type_detail", F.when(c("o_orderkey") % 4 > 0, c("area_m2") + c("o_orderkey") % 3).alias("area_m2"))
    return identity.match_asset(rows, identity.similar_streets(rows))


def _street_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    names = view(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("row_no"))
    streets = names.select("row_no", c("row_no").alias("code"), F.when(c("row_no") % 2 == 0, "calle").otherwise("avenida").alias("street_type"), c("p_name").alias("street_name"), F.when(c("row_no") % 3 == 0, "centro").alias("district"))
    points = view(spark, d, "part").join(names, "p_name").select(c("row_no").alias("code"), (c("p_partkey") % 90 + 1).cast("long").alias("number"), "p_partkey", F.lit("d").alias("district"), c("p_type").alias("neighborhood"), (c("p_partkey") / 1000).alias("lat"), (-c("p_partkey") / 1000).alias("lon"))
    return streets, points.groupBy("code", "number").agg(F.min_by(F.struct("district", "neighborhood", "lat", "lon"), "p_partkey").alias("b")).select("code", "number", "b.*")


def resolve_streets(spark: SparkSession, d: str) -> DataFrame:
    streets, points = _street_tables(spark, d)
    text = F.expr("CASE p_partkey % 7 WHEN 0 THEN concat('C/ ', p_name, ' ', CAST(p_partkey % 60 AS STRING)) WHEN 1 THEN concat('Avda. ', p_name, ', Madrid') WHEN 2 THEN concat(p_name, ' 12') WHEN 3 THEN concat('Calle de ', p_name, 's, 3') WHEN 4 THEN 'Lavapiés - Barrio' WHEN 5 THEN concat('Calle desconocida, Chueca') ELSE NULL END")
    return geography.resolve_streets(view(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("address")), streets, points)


def geo_audit(spark: SparkSession, d: str) -> DataFrame:
    return geography.geo_audit(resolve_streets(spark, d))


def enrich_geography(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    streets, points = _street_tables(spark, d)
    a = view(spark, d, "assets").withColumns({"building_id": c("id") - c("id") % 4, "data_confidence": F.when(c("id") % 2 == 0, 0.6)})
    a = a.withColumn("address_raw", F.when(c("id") % 9 > 0, F.substring_index("address_raw", ",", 1)))
    b = view(spark, d, "assets").select("id", F.substring_index("address_raw", ",", 1).alias("address_base"), "district", "neighborhood", "lat", "lon")
    return geography.enrich_geography(a, b, streets, points).select("id", "district", "neighborhood", "lat", "lon", "data_confidence", "changed")


def resolve_alerts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    v = lambda n: view(spark, d, n)
    n = v("n_parts").crossJoin(v("n_listings"))
    flow = v("flow_items").crossJoin(F.broadcast(n)).join(v("assets").select("address_norm", c("id").alias("_a"), "asset_type_family", "asset_type_detail", "area_m2"), c("_a") == (c("id") % c("n_li")) * 7919 % c("n"))
    alerts = flow.select("id", F.when(c("id") % 5 < 2, c("listing_url")).alias("listing_url"), c("portal").alias("source_portal"), "contact_phone", "contact_name", F.lower(F.regexp_replace(F.regexp_extract("address_raw", r"^Calle (.*) \d+,", 1), " ", "")).alias("address_norm"), "asset_type_family", "asset_type_detail", "area_m2", c("current_price_eur").alias("price_eur"), c("event_datetime").alias("alert_datetime"))
    window = spark.range(1).select(F.to_date(F.lit("2024-01-05")).alias("min_dt"), F.to_date(F.lit("2024-01-25")).alias("max_dt"))
    return identity.resolve_alerts(alerts, v("listings").withColumn("property_url", F.lit(None).cast("string")), v("assets"), v("contacts"), window)


def search_results(spark: SparkSession, d: str) -> DataFrame:
    queries = view(spark, d, "part").select(F.col("p_name").alias("text")).distinct().withColumn("query_id", F.col("text"))
    docs = _search_docs(spark, d)
    hits = search.search(queries, docs, search.build_search_index(docs))
    return search.search_results(hits, docs, queries).select("query_id", "section", "entity_id", "place", "title", "section_total", "snippet")


QUERIES = {
    f.__name__: f
    for f in (
        flow_records, extraction_coverage, chat_alerts, zone_context_merged, context_summary, theme_scores, catalog_summary, top_focus, download_candidates, explain_zones, explain_opportunities, explain_cases, filter_links, opportunity_detail,
        match_asset, resolve_streets, geo_audit, enrich_geography, resolve_alerts, search_results,
    )
}
_TH = _theme_sql()
ORACLES = {
    "flow_records": _FLOW_RECORDS, "extraction_coverage": _COVERAGE, "chat_alerts": _CHAT, "zone_context_merged": _CONTEXT + f" SELECT {', '.join(CONTEXT)} FROM z", "context_summary": _SUMMARY, "explain_cases": _EXPLAINED, "filter_links": _FOCUS,
    "theme_scores": _TH + " SELECT dataset_id, primary_theme, focus_score, is_focus, " + ", ".join(f"(SELECT n FROM b WHERE b.id = dataset_id AND theme = '{k}') AS {k}" for k in catalog.THEMES) + " FROM th",
    "catalog_summary": _TH + " SELECT portal_id, primary_theme, count(*) AS datasets, count(*) FILTER (is_focus) AS focus FROM th GROUP BY GROUPING SETS ((portal_id, primary_theme), (portal_id), (primary_theme), ())",
    "top_focus": _TH + f" SELECT primary_theme, place, dataset_id, focus_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY primary_theme ORDER BY focus_score DESC, t2, dataset_id) AS INTEGER) AS place FROM th JOIN (SELECT p_partkey AS dataset_id, {_TITLE} AS t2 FROM part) q USING (dataset_id) WHERE is_focus) r WHERE place <= 5",
    "download_candidates": _TH + " SELECT dataset_id, CASE dataset_id % 3 WHEN 0 THEN 'csv' ELSE 'geojson' END AS format, regexp_replace(regexp_replace(portal_id || '_' || title || '_r' || dataset_id, '_', '', 'g'), '[^a-z0-9]+', '_', 'g') AS slug FROM th WHERE is_focus AND dataset_id % 3 < 2 AND dataset_id % 5 < 4",
}
