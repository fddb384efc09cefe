"""Text, identity and quality queries, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions import bands, geo, numbers, semantics, text
from plotline.operators import identity, matching, profiles, quality
from plotline.operators.shared import shared_folder
from plotline.plans.sample import AS_OF, cte, kept, view
from plotline.sources import versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_KEY = r"trim(regexp_replace(regexp_replace(strip_accents(lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))), '[^a-z0-9\s,.\-]', '', 'g'), '\s+', ' ', 'g'))"
_R = lambda x, n: f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"


@query(r"SELECT conv_id, turn, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS clean FROM conversations")
def normalize_text(spark, d):
    return view(spark, d, "conversations").select("conv_id", "turn", text.normalize_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {_KEY.format('text')} AS key FROM documents")
def text_key(spark, d):
    return view(spark, d, "documents").select("doc_id", text.text_key(F.col("text")).alias("key"))


_PHONE = "CASE c_custkey % 6 WHEN 0 THEN concat('6', lpad(CAST(c_custkey AS STRING), 8, '0')) WHEN 1 THEN concat('0034 6', lpad(CAST(c_custkey AS STRING), 8, '0')) WHEN 2 THEN concat('+34-', lpad(CAST(c_custkey AS STRING), 9, '6')) WHEN 3 THEN concat('34', lpad(CAST(c_custkey AS STRING), 10, '9')) WHEN 4 THEN CAST(c_custkey AS STRING) ELSE NULL END"


@query(f"""
    WITH p AS (SELECT c_custkey AS id, regexp_replace({_PHONE}, '[^0-9+]', '', 'g') AS r0 FROM customer),
    q AS (SELECT id, CASE WHEN starts_with(r0, '00') THEN '+' || r0[3:] ELSE r0 END AS r, regexp_replace(CASE WHEN starts_with(r0, '00') THEN r0[3:] ELSE r0 END, '[^0-9]', '', 'g') AS dg, regexp_replace(coalesce(r0, ''), '[^0-9]', '', 'g') AS d0 FROM p)
    SELECT id, CASE WHEN starts_with(r, '+') THEN CASE WHEN length(dg) >= 7 THEN '+' || dg END WHEN length(dg) = 9 THEN '+34' || dg WHEN length(dg) >= 8 THEN dg END AS phone_norm,
           CASE WHEN starts_with(d0, '34') AND length(d0) >= 11 THEN right(d0, 9) WHEN length(d0) >= 9 THEN d0 END AS flow_key FROM q""")
def normalize_phone(spark, d):
    raw = F.expr(_PHONE)
    return view(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.normalize_phone(raw).alias("phone_norm"), text.flow_phone_key(raw).alias("flow_key"))


@query(r"""SELECT page_id, 'https://' || regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', ''), '^es\.', '')
    || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS url_norm,
    CASE WHEN starts_with(split_part(regexp_replace(url, '/+$', ''), '/', -1), 'listing-') THEN split_part(regexp_replace(url, '/+$', ''), '/', -1)[9:] ELSE split_part(url, '-', -1) END AS external_id FROM pages""")
def normalize_url(spark, d):
    return view(spark, d, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url_norm"), text.external_id(F.col("url")).alias("external_id"))


_PORTAL = "CASE o_orderkey % 7 WHEN 0 THEN 'Idealista: Hector' WHEN 1 THEN 'Fotocasa for Sale' WHEN 2 THEN 'PISOS.COM' WHEN 3 THEN concat('Otro portal: ', o_orderpriority) WHEN 4 THEN 'Yaencontre' WHEN 5 THEN '  ' ELSE o_orderpriority END"


@query(f"""WITH t AS (SELECT o_orderkey AS id, {_PORTAL} AS p FROM orders), k AS (SELECT id, nullif(trim(p), '') AS p, lower(p) AS l FROM t)
    SELECT id, CASE WHEN p IS NULL THEN NULL WHEN l LIKE '%idealista%' THEN 'idealista' WHEN l LIKE '%fotocasa%' THEN 'fotocasa' WHEN l LIKE '%pisos%' THEN 'pisos' WHEN l LIKE '%yaencontre%' THEN 'yaencontre' ELSE {_KEY.format('p')} END AS portal_key,
           CASE WHEN p IS NULL THEN NULL WHEN l LIKE '%idealista%' THEN 'Idealista' WHEN l LIKE '%fotocasa%' THEN 'Fotocasa' WHEN l LIKE '%pisos%' THEN 'Pisos' WHEN l LIKE '%yaencontre%' THEN 'Yaencontre' ELSE trim(split_part(p, ':', 1)) END AS portal_label FROM k""")
def portal_key(spark, d):
    p = F.expr(_PORTAL)
    return view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.portal_key(p).alias("portal_key"), text.portal_label(p).alias("portal_label"))


_TYPE = "CASE p_partkey % 6 WHEN 0 THEN 'Ático' WHEN 1 THEN ' PISO ' WHEN 2 THEN 'Local' WHEN 3 THEN 'Garaje' WHEN 4 THEN p_type ELSE NULL END"


@query(f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'residential_standard' WHEN 1 THEN 'residential_standard' WHEN 2 THEN 'retail_office' WHEN 5 THEN NULL ELSE 'other' END AS family,
    CASE p_partkey % 6 WHEN 0 THEN 'atico' WHEN 1 THEN 'piso' WHEN 2 THEN 'local' WHEN 3 THEN 'garaje' WHEN 4 THEN lower(p_type) END AS detail FROM part""")
def property_type(spark, d):
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), text.property_type(F.expr(_TYPE)).alias("t")).select("id", "t.family", "t.detail")


_MONEY = "concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' €' WHEN 1 THEN ',50' ELSE '.000 eur' END)"
_AREA = "concat(CAST(o_orderkey % 300 AS STRING), CASE o_orderkey % 2 WHEN 0 THEN ',5 m2' ELSE ' m2' END)"
_DATE = "concat(CAST(o_orderkey % 28 + 1 AS STRING), CASE o_orderkey % 3 WHEN 0 THEN '.03.2026' WHEN 1 THEN '/11/2025' ELSE ' de enero de 2026' END)"


@query(f"""SELECT o_orderkey AS id, CAST(regexp_extract(replace(replace({_MONEY}, '.', ''), ',', ''), '([0-9]+)', 1) AS DOUBLE) AS price, CAST(regexp_extract(replace({_AREA}, ',', '.'), '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS area,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(strptime({_DATE}, '%d.%m.%Y') AS DATE) END AS lead_date,
    CASE o_orderkey % 3 WHEN 1 THEN CAST(strptime({_DATE}, '%d/%m/%Y') AS DATE) WHEN 2 THEN make_date(2026, 1, CAST(o_orderkey % 28 + 1 AS INTEGER)) END AS text_date FROM orders""")
def parse_numbers(spark, d):
    return view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), numbers.parse_price_eur(F.expr(_MONEY)).alias("price"), numbers.parse_area_m2(F.expr(_AREA)).alias("area"), numbers.parse_lead_date(F.expr(_DATE)).alias("lead_date"), numbers.spanish_date(F.expr(_DATE)).alias("text_date"))


@query(cte("assets") + f""", p AS (SELECT a.id, a.lat, a.lon, b.id AS other_id, b.lat AS lat2, b.lon AS lon2, a.area_m2 AS x, b.area_m2 AS y FROM assets a JOIN assets b ON b.id = a.id + 1)
    SELECT id, {_R('2 * 6371.0088e0 * asin(sqrt(pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon)) / 2), 2)))', 6)} AS km,
           abs(x - y) <= greatest(5e0, greatest(x, y) * 0.08e0) AS close, {_R('abs(x - y) / greatest(x, y)', 6)} AS ratio, {_R('abs(y - x) / abs(x)', 6)} AS delta FROM p""")
def distances(spark, d):
    a = view(spark, d, "assets")
    b = a.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("area_m2").alias("y"))
    c = F.col
    return a.join(b, "id").select(
        "id", numbers.rounded(geo.haversine_km(c("lat"), c("lon"), c("lat2"), c("lon2")), 6).alias("km"), numbers.area_is_close(c("area_m2"), c("y")).alias("close"),
        numbers.rounded(numbers.price_distance_ratio(c("area_m2"), c("y")), 6).alias("ratio"), numbers.rounded(numbers.pct_delta(c("area_m2"), c("y")), 6).alias("delta"),
    )


_FRAGMENT = r"nullif(array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace({0}, '[,.\-]', ' ', 'g'), '\b[0-9]+[a-z]?\b', ' ', 'g'), '\b(calle|cl|avenida|av|paseo|ps|plaza|pl|carretera|camino|via|ronda|travesia)\b', ' ', 'g'), '\s+'), lambda w: w <> '')[1:4], ' '), '')"
_STREETS = "CASE id % 4 WHEN 0 THEN address_raw WHEN 1 THEN concat('Cl. del ', address_norm, ' 10b - Ronda, ', coalesce(district, 'x')) WHEN 2 THEN concat('Paseo ', asset_type_detail, ' 3, 4º dcha. El Sol de la Via ', coalesce(neighborhood, 'y')) ELSE 'Avda. 12' END"


@query(cte("assets") + f", t AS (SELECT id, {_KEY.format(_STREETS)} AS k FROM assets) SELECT id, {_FRAGMENT.format('k')} AS fragment FROM t")
def address_fragment(spark, d):
    return view(spark, d, "assets").select("id", text.address_fragment(F.expr(_STREETS)).alias("fragment"))


@query(cte("flow_items") + """ SELECT id, sha1(concat_ws('|', source_uid, coalesce(portal, ''), coalesce(CAST(floor(current_price_eur) AS BIGINT)::STRING, 'na'))) AS uid FROM flow_items""")
def source_uid(spark, d):
    return view(spark, d, "flow_items").select("id", semantics.source_uid(F.col("source_uid"), F.col("portal"), text.blank_to_null(semantics.price_key(F.col("current_price_eur")))).alias("uid"))


_ADDR = "CASE id % 5 WHEN 0 THEN address_raw WHEN 1 THEN 'Lavapies - Madrid' WHEN 2 THEN 'Barrio Sol' WHEN 3 THEN concat('Gran via larga ', asset_type_detail) ELSE NULL END"


@query(cte("assets") + """ SELECT id, CASE id % 5 WHEN 0 THEN 'precise' WHEN 1 THEN 'zone_like' WHEN 2 THEN 'zone_like' WHEN 3 THEN 'partial' ELSE 'unknown' END AS address_precision,
    CASE id % 5 WHEN 1 THEN 'Lavapies' WHEN 2 THEN 'Barrio Sol' END AS zone_like_label FROM assets""")
def address_precision(spark, d):
    return view(spark, d, "assets").select("id", semantics.address_semantics(F.expr(_ADDR)).alias("s")).select("id", "s.address_precision", "s.zone_like_label")


_RAW = "CASE id % 4 WHEN 0 THEN concat('Bajada de precio a ', CAST(id AS STRING), ' €') WHEN 1 THEN 'precio nuevo' WHEN 2 THEN concat('sin datos, ', coalesce(source_portal, 'vendido')) ELSE NULL END"


@query(cte("listings") + f""", t AS (SELECT id, price_eur, CASE WHEN id % 3 = 0 THEN price_eur END AS previous, lower(coalesce({_RAW}, '')) AS x FROM listings),
    u AS (SELECT *, contains(x, '€') AS euro, regexp_matches(x, 'precio|price|venta|sale|bajada|subida') AS named FROM t)
    SELECT id, CASE WHEN price_eur < 30000 OR price_eur > 50000000 THEN 'low' WHEN euro THEN 'high' WHEN named THEN CASE WHEN previous IS NOT NULL THEN 'high' ELSE 'medium' END ELSE 'low' END AS price_confidence,
    CASE WHEN euro THEN 'eur_text' WHEN named THEN 'contextual_fallback' ELSE 'structured_or_weak_fallback' END AS price_source,
    CASE WHEN contains(x, 'bajada de precio') THEN 'price_drop' WHEN contains(x, 'vendido') THEN 'sold' WHEN contains(x, 'nuevo') THEN 'listing_detected' ELSE 'history_item' END AS event_type FROM u""")
def price_confidence(spark, d):
    c = F.col
    s = semantics.price_semantics(c("price_eur"), F.when(c("id") % 3 == 0, c("price_eur")), F.expr(_RAW))
    return view(spark, d, "listings").select("id", s.alias("s"), semantics.infer_event_type(F.expr(_RAW)).alias("event_type")).select("id", "s.price_confidence", "s.price_source", "event_type")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'price_drop' WHEN 1 THEN 'not_available' WHEN 2 THEN 'sold' END AS event_type FROM pages""")
def event_type_of_url(spark, d):
    url = F.expr("concat(url, CASE page_id % 4 WHEN 0 THEN '?historyType=price-drop' WHEN 1 THEN '?type=notAvailable&x=1' WHEN 2 THEN '?a=b&history_type=sold' ELSE '' END)")
    return view(spark, d, "pages").select("page_id", semantics.event_type_of_url(F.regexp_replace(url, r"\?page=2&ref=x|#top", "")).alias("event_type"))


@query(cte("links") + """ SELECT flow_item_id, CASE WHEN match_status <> 'resolved' THEN CASE WHEN match_score >= 55 THEN 'dudoso' ELSE 'sin_match' END WHEN match_score >= 90 THEN 'alto' WHEN match_score >= 75 THEN 'medio' ELSE 'bajo' END AS band FROM links""")
def match_band(spark, d):
    return view(spark, d, "links").select("flow_item_id", bands.match_band(F.col("match_status"), F.col("match_score")).alias("band"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(""" + _KEY.format("text") + r""", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 180 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE rtrim(trim(regexp_replace(text, '\s+', ' ', 'g'))[1:177]) || '...' END AS excerpt FROM documents""")
def slug(spark, d):
    return view(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"), text.excerpt(F.col("text")).alias("excerpt"))


# identity


def _items(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "flow_items")


_EXT = "CASE WHEN {0} IS NULL THEN NULL WHEN starts_with(split_part({0}, '/', -1), 'listing-') THEN split_part({0}, '/', -1)[9:] ELSE split_part({0}, '-', -1) END"
_NORM = _KEY.format("address_raw")
_JOINED = cte("flow_items", "assets", "contacts", "listings") + f""",
f0 AS (SELECT * REPLACE (CASE WHEN id % 17 = 0 THEN 'Barrio Sol' ELSE address_raw END AS address_raw) FROM flow_items), i0 AS (SELECT *, {_NORM} AS ak FROM f0), a0 AS (SELECT id, address_norm, {_NORM} AS ak FROM assets),
it AS (SELECT id AS item_id, f.* EXCLUDE (id), CASE WHEN contact_phone IS NULL THEN NULL ELSE '+34' || contact_phone END AS phone, lower(replace(contact_name, '#', '')) AS nm, {_EXT.format('listing_url')} AS ext,
    {_FRAGMENT.format('ak')} AS frag, address_raw IS NULL OR NOT contains(ak, 'barrio') AS placed FROM i0 f),
li AS (SELECT l.*, a.address_norm, {_FRAGMENT.format('a.ak')} AS frag, c.phone_norm, c.name_norm FROM listings l JOIN a0 a ON a.id = l.asset_id JOIN contacts c ON c.id = l.contact_id),
ca AS (
    SELECT item_id, coalesce(u.id, e.id) AS listing_id FROM it LEFT JOIN li u ON u.listing_url = it.listing_url LEFT JOIN li e ON e.external_id = it.ext WHERE coalesce(u.id, e.id) IS NOT NULL
    UNION SELECT item_id, l.id FROM it JOIN li l ON l.phone_norm = it.phone
    UNION SELECT item_id, l.id FROM it JOIN li l ON l.address_norm = it.address_norm WHERE placed
    UNION SELECT item_id, l.id FROM it JOIN li l ON l.frag = it.frag WHERE placed AND (it.portal IS NULL OR l.source_portal IS NULL OR it.portal = l.source_portal)
    UNION SELECT item_id, l.id FROM it JOIN li l ON l.name_norm = it.nm
)"""
_PROF = """,
pf AS (SELECT phone_norm, CASE WHEN a = 1 AND b <= 1 AND c <= 1 THEN 'owner_like' WHEN a >= 4 OR b >= 3 OR c >= 3 THEN 'broker_like' ELSE 'unknown' END AS profile
       FROM (SELECT phone_norm, count(DISTINCT id) AS a, count(DISTINCT asset_id) AS b, count(DISTINCT source_portal) AS c FROM li GROUP BY 1) t),
pr AS (
    SELECT ca.item_id, ca.listing_id, coalesce(it.listing_url = l.listing_url, false) AS url, coalesce(it.ext = l.external_id, false) AS ex, coalesce(it.portal = l.source_portal, false) AS po, coalesce(it.phone = l.phone_norm, false) AS ph, coalesce(it.address_norm = l.address_norm, false) AS ad,
           coalesce(it.nm = l.name_norm, false) AS nm, coalesce(it.frag = l.frag, false) AS fr, CASE WHEN it.current_price_eur > 0 AND l.price_eur > 0 THEN abs(it.current_price_eur - l.price_eur) / greatest(it.current_price_eur, l.price_eur) END AS r, pf.profile
    FROM ca JOIN it USING (item_id) JOIN li l ON l.id = ca.listing_id LEFT JOIN pf USING (phone_norm)
),
sc AS (
    SELECT item_id, listing_id, CASE WHEN url THEN 100e0 ELSE 0e0 END + CASE WHEN ex THEN 95e0 ELSE 0e0 END + CASE WHEN po THEN 18e0 ELSE 0e0 END + CASE WHEN ph THEN CASE profile WHEN 'owner_like' THEN 45e0 WHEN 'unknown' THEN 28e0 ELSE 10e0 END ELSE 0e0 END + CASE WHEN nm THEN 8e0 ELSE 0e0 END
           + CASE WHEN ad THEN 40e0 ELSE 0e0 END + CASE WHEN fr THEN 28e0 ELSE 0e0 END + CASE WHEN r <= 0.05e0 THEN 18e0 WHEN r <= 0.12e0 THEN 10e0 WHEN r <= 0.20e0 THEN 4e0 WHEN r > 0.20e0 THEN -10e0 ELSE 0e0 END + CASE WHEN ph AND ad THEN 18e0 ELSE 0e0 END + CASE WHEN r <= 0.12e0 AND ad THEN 12e0 ELSE 0e0 END AS score,
           url OR ex AS url, po, ph, profile, r FROM pr
)"""
_BEST = """,
rk AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, -999e0) AS second_score FROM sc WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, CASE WHEN r <= 0.2e0 THEN r ELSE 1e0 END, listing_id)),
be AS (SELECT *, score - second_score AS gap FROM rk WHERE k = 1)"""


@query(cte("flow_items", "listings") + f""", f AS (SELECT *, {_EXT.format('listing_url')} AS ext, id % (SELECT count(*) FROM part) AS asset, CASE WHEN id % 5 = 2 THEN 'https://www.es.prop.example.com/p/' || (id % (SELECT count(*) FROM orders)) || '?x=1' END AS purl FROM flow_items),
    l AS (SELECT *, 'https://prop.example.com/p/' || id AS purl FROM listings)
    SELECT f.id, coalesce(u.id, p.id, e.id, ap.id) AS listing_id, CASE WHEN u.id IS NOT NULL THEN 'url' WHEN p.id IS NOT NULL THEN 'property_url' WHEN e.id IS NOT NULL THEN 'external_id' WHEN ap.id IS NOT NULL THEN 'asset_portal' END AS how
    FROM f LEFT JOIN l u ON u.listing_url = f.listing_url LEFT JOIN l p ON p.purl = replace(replace(f.purl, 'www.es.', ''), '?x=1', '') LEFT JOIN l e ON e.external_id = f.ext
    LEFT JOIN (SELECT f.id AS fid, min(l.id) AS id FROM f JOIN l ON l.asset_id = f.asset AND l.source_portal = f.portal AND (f.id % 3 > 0 OR l.contact_id = f.id % (SELECT count(*) FROM customer)) GROUP BY 1) ap ON ap.fid = f.id""")
def match_listing(spark, d):
    c = F.col
    v = lambda n: view(spark, d, n)
    n = v("n_parts").crossJoin(v("n_listings")).crossJoin(v("n_customers").withColumnRenamed("n", "n_c"))  # one row
    items = _items(spark, d).crossJoin(F.broadcast(n)).select(
        "id", "listing_url", F.when(c("id") % 5 == 2, F.concat(F.lit("https://www.es.prop.example.com/p/"), (c("id") % c("n_li")).cast("string"), F.lit("?x=1"))).alias("property_url"), text.external_id(c("listing_url")).alias("external_id"),
        (c("id") % c("n")).alias("asset_id"), F.when(c("id") % 3 == 0, c("id") % c("n_c")).alias("contact_id"), "portal",
    )
    return identity.match_listing(items, v("listings").withColumn("property_url", F.concat(F.lit("https://prop.example.com/p/"), c("id").cast("string"))))


@query(cte("contacts") + """ SELECT CASE WHEN id % 3 = 0 THEN 'name:' || name_norm ELSE phone_norm END AS contact_key, min(id) AS first_row, arg_min(name_norm, id) AS name_norm, count(*) AS n_rows FROM contacts GROUP BY 1""")
def match_contact(spark, d):
    c = view(spark, d, "contacts").select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 != 0, F.col("phone_norm")).alias("phone_norm"), "name_norm")
    return identity.merge_contacts(c)


@query(cte("assets") + " SELECT address_norm AS address_base, min(id) AS building_id, count(*) AS n_rows FROM assets GROUP BY 1")
def match_building(spark, d):
    return identity.match_building(view(spark, d, "assets").select(F.col("id").alias("row_id"), F.col("address_norm").alias("address_base")))


_SHAPED = cte("flow_items", "assets", "contacts", "listings") + ", q AS (SELECT f.id, f.address_norm, f.event_datetime, f.current_price_eur, l.source_portal, l.contact_id, 20e0 + f.id % 150 AS area_m2, CASE WHEN f.id % 2 = 0 THEN 'standard' ELSE 'economy' END AS typ FROM flow_items f JOIN listings l ON l.id = f.id % (SELECT count(*) FROM orders))"


def _shaped(spark, d):
    c = F.col
    items = _items(spark, d).crossJoin(F.broadcast(view(spark, d, "n_listings"))).withColumn("listing_id", c("id") % c("n_li")).select("id", "listing_id", "address_norm", "event_datetime", "current_price_eur")
    l = view(spark, d, "listings").select(c("id").alias("listing_id"), "source_portal", "contact_id")  # noqa: E741
    return items.join(l, "listing_id").withColumns({"area_m2": (c("id") % 150 + 20).cast("double"), "asset_type_detail": F.when(c("id") % 2 == 0, "standard").otherwise("economy")})


@query(_SHAPED + """, j AS (SELECT q.id, a.id AS asset_id, CASE WHEN a.asset_type_detail = typ AND abs(a.area_m2 - q.area_m2) <= greatest(5e0, greatest(a.area_m2, q.area_m2) * 0.08e0) THEN 1 WHEN a.asset_type_detail = typ THEN 2
        WHEN abs(a.area_m2 - q.area_m2) <= greatest(5e0, greatest(a.area_m2, q.area_m2) * 0.08e0) THEN 3 ELSE 4 END AS tier, count(*) OVER (PARTITION BY q.id) AS n FROM q JOIN assets a USING (address_norm))
    SELECT id, asset_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, asset_id) AS k FROM j) t WHERE k = 1 AND (tier < 4 OR n = 1)""")
def match_asset_strict(spark, d):
    return identity.match_asset_strict(_shaped(spark, d), view(spark, d, "assets"))


@query(_SHAPED + """, j AS (SELECT q.id, l.id AS listing_id, CASE WHEN a.address_norm = q.address_norm THEN 60 ELSE 0 END + CASE WHEN abs(l.area_m2 - q.area_m2) <= greatest(5e0, greatest(l.area_m2, q.area_m2) * 0.08e0) THEN 30 ELSE 0 END + 10 AS score
        FROM q JOIN listings l ON l.source_portal = q.source_portal AND l.contact_id = q.contact_id JOIN assets a ON a.id = l.asset_id)
    SELECT id, listing_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, listing_id) AS k FROM j) t WHERE k = 1 AND score >= 70""")
def match_listing_by_shape(spark, d):
    return identity.match_listing_by_shape(_shaped(spark, d), view(spark, d, "listings"), view(spark, d, "assets"))


@query(_SHAPED + """, w AS (SELECT CAST('2024-01-05' AS DATE) AS lo, CAST('2024-01-25' AS DATE) AS hi),
    j AS (SELECT q.id, l.id AS listing_id, 40e0 + CASE WHEN a.asset_type_detail = typ THEN 10e0 ELSE 0e0 END + CASE WHEN abs(l.area_m2 - q.area_m2) <= greatest(5e0, greatest(l.area_m2, q.area_m2) * 0.08e0) THEN 20e0 ELSE 0e0 END
            + CASE WHEN abs(l.price_eur - q.current_price_eur) / greatest(l.price_eur, q.current_price_eur) <= 0.15e0 THEN 10e0 ELSE 0e0 END + CASE WHEN c.phone_norm = c2.phone_norm THEN 25e0 ELSE 0e0 END AS score
        FROM q CROSS JOIN w JOIN listings l ON l.source_portal = q.source_portal JOIN assets a ON a.id = l.asset_id AND a.address_norm = q.address_norm LEFT JOIN contacts c ON c.id = l.contact_id LEFT JOIN contacts c2 ON c2.id = q.contact_id
        WHERE CAST(q.event_datetime AS DATE) BETWEEN lo AND hi),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, listing_id) AS k, score - coalesce(lead(score) OVER (PARTITION BY id ORDER BY score DESC, listing_id), -999e0) AS gap FROM j)
    SELECT id, listing_id, score, gap FROM r WHERE k = 1 AND score >= 70 AND gap >= 15""")
def match_listing_in_window(spark, d):
    c = F.col
    items = _shaped(spark, d).withColumnRenamed("event_datetime", "alert_datetime").withColumnsRenamed({"current_price_eur": "price_eur"}).withColumn("asset_type_family", F.lit(None).cast("string"))
    items = items.join(view(spark, d, "contacts").select(c("id").alias("contact_id"), "phone_norm"), "contact_id", "left")
    window = spark.range(1).select(F.to_date(F.lit("2024-01-05")).alias("min_dt"), F.to_date(F.lit("2024-01-25")).alias("max_dt"))
    return identity.match_listing_in_window(items.drop("listing_id", "contact_id"), view(spark, d, "listings"), view(spark, d, "assets"), view(spark, d, "contacts"), window)


def _keys(spark, d):
    v = lambda n: view(spark, d, n)
    listings, contacts = v("listings"), v("contacts")
    items = _items(spark, d).withColumn("address_raw", F.when(F.col("id") % 17 == 0, "Barrio Sol").otherwise(F.col("address_raw")))  # some name a zone alone
    return kept(matching.item_keys(items)), kept(matching.listing_keys(listings, v("assets"), contacts, profiles.phone_profiles(listings, contacts)))


@query(_JOINED + " SELECT * FROM ca")
def flow_candidates(spark, d):
    return matching.flow_candidates(*_keys(spark, d))


@query(_JOINED + _PROF + " SELECT item_id, listing_id, score FROM sc")
def score_candidates(spark, d):
    return matching.scored_pairs(*_keys(spark, d)).select("item_id", "listing_id", "score")


@query(_JOINED + _PROF + _BEST + " SELECT item_id, listing_id, score, second_score, gap FROM be")
def best_and_gap(spark, d):
    return matching.best_matches(*_keys(spark, d)).select("item_id", "listing_id", "score", "second_score", "gap")


def similar_fragments(spark, d):
    """J-09, F-23: fuzzy ratios of distinct fragments; no SQL, tested against brute force."""
    return matching.similar_fragments(*_keys(spark, d))


QUERIES["similar_fragments"] = similar_fragments


_DECIDED = _JOINED + _PROF + _BEST + """,
de AS (SELECT it.item_id, it.current_price_eur, it.event_datetime, be.listing_id, be.score, CASE WHEN score IS NULL THEN 'unresolved' WHEN score >= 90 OR score >= 75 AND gap >= 10 OR score >= 65 AND gap >= 18 THEN 'resolved' WHEN score >= 55 THEN 'ambiguous' ELSE 'unresolved' END AS match_status,
    url, po, ph, profile, r FROM it LEFT JOIN be USING (item_id))"""


@query(_DECIDED + """ SELECT item_id, CASE WHEN match_status = 'resolved' THEN listing_id END AS listing_id, match_status, coalesce(score, 0e0) AS match_score,
    CASE WHEN score IS NULL THEN 'no_candidates' WHEN match_status <> 'resolved' THEN 'candidate_scoring' WHEN url THEN 'direct_anchor' WHEN ph AND profile = 'owner_like' AND po THEN 'phone_portal_owner' WHEN ph AND r > 0.05e0 AND r <= 0.12e0 THEN 'phone_price' ELSE 'candidate_scoring' END AS match_strategy FROM de""")
def decide_matches(spark, d):
    items, listings = _keys(spark, d)
    return matching.decide_matches(items, matching.best_matches(items, listings))


_STATUS = "CASE event_type_guess WHEN 'listing_detected' THEN 'active' WHEN 'sold' THEN 'sold' END"


@query(_DECIDED + f""", mm AS (SELECT listing_id AS id, arg_min(current_price_eur, event_datetime) AS p, arg_min({_STATUS}, event_datetime) FILTER ({_STATUS} IS NOT NULL) AS st, arg_max(portal, event_datetime) FILTER (portal IS NOT NULL) AS po, max(event_datetime) AS seen, count(*) AS n
        FROM de JOIN (SELECT id AS item_id, event_type_guess, portal FROM flow_items) USING (item_id) WHERE match_status = 'resolved' GROUP BY 1)
    SELECT id, coalesce(p, price_eur) AS price_eur, {_R("CASE WHEN p IS NULL THEN price_per_m2 ELSE p / area_m2 END", 4)} AS price_per_m2, coalesce(st, status) AS status, coalesce(source_portal, po) AS source_portal,
           strftime(seen, '%Y-%m-%d %H:%M:%S') AS first_seen, coalesce(n, 0) AS matched_items FROM listings LEFT JOIN mm USING (id)""")
def apply_matches(spark, d):
    items, listings = _keys(spark, d)
    flow = _items(spark, d).select(F.col("id").alias("item_id"), "current_price_eur", "event_datetime", "event_type_guess", "portal", "listing_url")
    decided = matching.decide_matches(items, matching.best_matches(items, listings)).join(flow, "item_id")
    stored = view(spark, d, "listings").withColumns({"first_seen_at": F.lit(None).cast("timestamp_ntz"), "last_seen_at": F.col("updated_at")})
    done = identity.apply_matches(stored, decided)
    return done.select("id", "price_eur", numbers.rounded(F.col("price_per_m2"), 4).alias("price_per_m2"), "status", "source_portal", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "matched_items")


@query(cte("flow_items", "links") + " SELECT id FROM flow_items WHERE id NOT IN (SELECT flow_item_id FROM links WHERE match_status = 'resolved')")
def pending_flow(spark, d):
    return identity.pending_flow(_items(spark, d), view(spark, d, "links")).select("id")


@query(cte("market_events") + """, e AS (SELECT id, listing_id, asset_id, CASE WHEN id % 2 = 0 THEN 'flow' ELSE source_channel END AS source_channel, event_type, CAST(event_datetime AS DATE) AS event_day, CASE WHEN id % 3 = 0 THEN NULL ELSE price_old END AS price_old, price_new FROM market_events)
    SELECT DISTINCT listing_id, asset_id, source_channel, event_type, event_day, price_old, price_new FROM e
    EXCEPT SELECT listing_id, asset_id, source_channel, event_type, event_day, price_old, price_new FROM e WHERE id % 5 = 0""")
def new_market_events(spark, d):
    c = F.col
    e = view(spark, d, "market_events").select("id", "listing_id", "asset_id", F.when(c("id") % 2 == 0, "flow").otherwise(c("source_channel")).alias("source_channel"), "event_type", c("event_datetime").cast("date").alias("event_day"), F.when(c("id") % 3 != 0, c("price_old")).alias("price_old"), "price_new")
    return identity.new_market_events(e, e.where("id % 5 = 0")).drop("id")  # what is stored: events of every fifth id


@query(cte("flow_items") + """ SELECT source_uid, count(*) AS occurrence_count, min(id) AS first_seq, max(id) AS last_seq, arg_max(portal, id) FILTER (portal IS NOT NULL AND portal <> '') AS portal, arg_max(contact_phone, id) FILTER (contact_phone IS NOT NULL) AS contact_phone,
    arg_min(contact_name, id) FILTER (contact_name IS NOT NULL) AS contact_name FROM flow_items GROUP BY 1""")
def upsert_flow(spark, d):
    return identity.consolidate(_items(spark, d), "source_uid", "id", ["portal", "contact_phone"], ["contact_name"])


_BATCH = "SELECT source_uid, arg_max(portal, id) FILTER (portal IS NOT NULL) AS portal, arg_max(contact_phone, id) FILTER (contact_phone IS NOT NULL) AS contact_phone, arg_max(contact_name, id) FILTER (contact_name IS NOT NULL) AS contact_name, max(id) AS id FROM flow_items"


@query(cte("flow_items") + f""", b1 AS ({_BATCH} WHERE event_datetime < TIMESTAMP '2024-01-20' GROUP BY 1), b2 AS ({_BATCH} GROUP BY 1)
    SELECT CASE WHEN b1.source_uid IS NULL THEN 'created' ELSE 'updated' END AS change, b2.source_uid, b2.portal, b2.contact_phone, b2.contact_name, b2.id FROM b2 LEFT JOIN b1 USING (source_uid)
    WHERE b1.source_uid IS NULL OR (b1.portal, b1.contact_phone, b1.contact_name, b1.id) IS DISTINCT FROM (b2.portal, b2.contact_phone, b2.contact_name, b2.id)""")
def flow_changes(spark, d):
    """A-08 and SNK-01: what a second batch of flow items created and updated in a table that the first has made."""
    items = _items(spark, d).select("source_uid", "portal", "contact_phone", "contact_name", "id", "event_datetime")
    path = f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"
    for early in (True, False):
        batch = items.where((F.col("event_datetime") < F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))) == F.lit(early)).drop("event_datetime")
        versions.upsert_version(batch, path, ["source_uid"], by="id", fill=True)
    return versions.changes(spark, path, 1)


@query(cte("snapshots") + """ SELECT listing_id, strftime(snapshot_datetime, '%Y-%m-%d') AS day, p.price_eur, p.status FROM (
    SELECT listing_id, snapshot_datetime, min(struct_pack(price_eur := price_eur, status := status)) AS p FROM snapshots GROUP BY 1, 2) t""")
def baseline_snapshots(spark, d):
    return identity.baseline_snapshots(view(spark, d, "snapshots")).select("listing_id", F.date_format("snapshot_datetime", "yyyy-MM-dd").alias("day"), "price_eur", "status")


@query(cte("reviews") + " SELECT flow_item_id, id, review_label FROM (SELECT *, row_number() OVER (PARTITION BY flow_item_id ORDER BY created_at DESC, id DESC) AS k FROM reviews) t WHERE k = 1")
def latest_review(spark, d):
    return identity.latest_review(view(spark, d, "reviews")).select("flow_item_id", "id", "review_label")


# quality


@query(cte("market_events") + " SELECT event_type, count(*) AS n FROM market_events GROUP BY 1")
def event_type_breakdown(spark, d):
    return quality.event_type_breakdown(view(spark, d, "market_events"))


@query(cte("links") + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (match_status = '{s}') AS {s}" for s in ("resolved", "unresolved", "ambiguous", "pending")) + ", count(listing_id) AS linked FROM links")
def link_stats(spark, d):
    return quality.link_stats(view(spark, d, "links"))


_CONF = """, m AS (SELECT count(*) AS reviews_total, count(*) FILTER (predicted_status = 'resolved' AND review_label = 'match') AS tp, count(*) FILTER (predicted_status = 'resolved' AND review_label = 'no_match') AS fp,
    count(*) FILTER (predicted_status <> 'resolved' AND review_label = 'match') AS fn, count(*) FILTER (predicted_status <> 'resolved' AND review_label = 'no_match') AS tn FROM reviews)"""


@query(cte("reviews") + _CONF + f" SELECT *, {_R('tp::DOUBLE / (tp + fp)', 4)} AS precision, {_R('tp::DOUBLE / (tp + fn)', 4)} AS recall, {_R('(tp + tn)::DOUBLE / (tp + tn + fp + fn)', 4)} AS accuracy FROM m")
def matching_metrics(spark, d):
    return quality.matching_metrics(view(spark, d, "reviews"))


@query(cte("reviews") + f""", b AS (SELECT CASE WHEN predicted_score >= 0.9e0 THEN '0.90+' WHEN predicted_score >= 0.75e0 THEN '0.75-0.89' WHEN predicted_score >= 0.6e0 THEN '0.60-0.74' WHEN predicted_score >= 0.4e0 THEN '0.40-0.59' ELSE '<0.40' END AS band,
    count(*) AS total, count(*) FILTER (review_label = 'match') AS positive, count(*) FILTER (review_label = 'no_match') AS negative FROM reviews GROUP BY 1), c AS (SELECT *, CASE WHEN positive + negative = 0 THEN 0e0 ELSE {_R('positive::DOUBLE / (positive + negative)', 4)} END AS purity FROM b)
    SELECT *, CASE WHEN total < 5 THEN 'sin muestra' WHEN purity >= 0.9e0 THEN 'banda muy fiable' WHEN purity >= 0.75e0 THEN 'banda razonable' WHEN purity >= 0.5e0 THEN 'revisar threshold' ELSE 'banda problemática' END AS recommendation FROM c""")
def threshold_bands(spark, d):
    return quality.threshold_bands(view(spark, d, "reviews"))


@query(cte("assets") + " SELECT address_norm, asset_type_detail, CAST(floor(area_m2 + 0.5) AS BIGINT) AS area, count(*) AS n, min(id) AS first_id FROM assets GROUP BY 1, 2, 3 HAVING count(*) > 1")
def integrity_audit(spark, d):
    return quality.integrity_audit(view(spark, d, "assets"))


@query(cte("flow_items", "snapshots") + " SELECT CASE WHEN event_datetime < lo THEN 'before' WHEN event_datetime > hi THEN 'after' ELSE 'inside' END AS place, count(*) AS n FROM flow_items CROSS JOIN (SELECT min(snapshot_datetime) AS lo, max(snapshot_datetime) AS hi FROM snapshots) w GROUP BY 1")
def overlap_audit(spark, d):
    return quality.overlap_audit(_items(spark, d).withColumnRenamed("event_datetime", "alert_datetime"), profiles.snapshot_window(view(spark, d, "snapshots")))


@query(cte("assets", "contacts", "listings", "flow_items") + " " + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, max(id) AS max_id FROM {t}" for t in ("assets", "contacts", "listings", "flow_items")))
def table_signature(spark, d):
    return quality.table_signature({t: view(spark, d, t) for t in ("assets", "contacts", "listings", "flow_items")})


@query(cte("flow_items", "links") + f""" SELECT count(*) AS items, count(*) FILTER (event_datetime >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS events_7d, count(*) FILTER (event_datetime >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS events_30d,
    count(*) FILTER (id % 4 = 0) AS poor_address, count(*) FILTER (current_price_eur < 30000 OR id % 3 = 0) AS no_reliable_price, (SELECT count(*) FROM links WHERE match_status = 'resolved') AS resolved, (SELECT count(*) FROM links) AS links,
    (SELECT {_R("count(*) FILTER (match_status = 'resolved')::DOUBLE / count(*)", 4)} FROM links) AS resolved_ratio FROM flow_items""")
def dashboard_stats(spark, d):
    c = F.col
    items = _items(spark, d)
    s = items.select(semantics.address_semantics(F.when(c("id") % 4 == 0, "Barrio Sol").otherwise(c("address_raw"))).alias("a"), semantics.price_semantics(c("current_price_eur"), c("previous_price_eur"), F.when(c("id") % 3 != 0, F.lit("venta 1 €"))).alias("p"))
    return quality.dashboard_stats(items, view(spark, d, "links"), s.select("a.address_precision", "p.price_confidence"), F.to_timestamp_ntz(F.lit(AS_OF)))


@query(cte("links", "reviews") + " SELECT flow_item_id, match_status FROM links WHERE match_status IN ('ambiguous', 'unresolved', 'pending') AND flow_item_id NOT IN (SELECT flow_item_id FROM reviews)")
def review_needed(spark, d):
    return quality.review_needed(view(spark, d, "links"), view(spark, d, "reviews")).select("flow_item_id", "match_status")
