"""SQL of the zone, microzone, opportunity and radar queries, written apart from the library."""

from __future__ import annotations

from plotline.plans.sample import AS_OF, cte

R = lambda x, n: f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"
SINCE = lambda d: f"event_datetime >= TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY"
RATIO = lambda a, b, n=4: f"(CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE {R(f'CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)', n)} END)"
MEAN = lambda x: R(f"CAST(sum(CAST(floor({x} * 100 + 0.5) AS HUGEINT)) AS DOUBLE) / (count({x}) * 100)", 2)
ACTIVE = "(status IS NULL OR status IN ('', 'active', 'Disponible', 'En venta'))"

BASE = cte("zone_context", "assets", "contacts", "listings", "market_events", "flow_items", "snapshots", "runs") + f""",
fs AS (SELECT CAST(greatest(date_diff('second', max(finished_at), TIMESTAMP '{AS_OF}') // 86400, 0) AS BIGINT) AS freshness_days FROM runs WHERE source_type = 'csv' AND status = 'success'),
za AS (
    SELECT a.*, coalesce(n.zone_label, d.zone_label, r.zone_label, 'Sin zona') AS zone_label
    FROM assets a LEFT JOIN zone_context n ON upper(n.zone_label) = a.neighborhood
    LEFT JOIN zone_context d ON upper(d.zone_label) = a.district
    LEFT JOIN zone_context r ON upper(r.zone_label) = split_part(a.address_raw, ', ', 3)
),
zf AS (SELECT f.id, r.zone_label FROM flow_items f JOIN zone_context r ON upper(r.zone_label) = split_part(f.address_raw, ', ', 3)),
prof AS (
    SELECT phone_norm, listing_count, asset_count, portal_count,
           CASE WHEN listing_count = 1 AND asset_count <= 1 AND portal_count <= 1 THEN 'owner_like'
                WHEN listing_count >= 4 OR asset_count >= 3 OR portal_count >= 3 THEN 'broker_like' ELSE 'unknown' END AS phone_profile
    FROM (SELECT phone_norm, count(DISTINCT l.id) AS listing_count, count(DISTINCT asset_id) AS asset_count, count(DISTINCT source_portal) AS portal_count
          FROM listings l JOIN contacts c ON c.id = l.contact_id GROUP BY 1) q
),
zl AS (SELECT l.*, coalesce(z.zone_label, 'Sin zona') AS zone_label FROM listings l LEFT JOIN za z ON z.id = l.asset_id),
ev AS (SELECT m.id AS event_id, m.event_type, m.event_datetime, m.source_channel, m.price_old, m.price_new, m.listing_id, coalesce(m.asset_id, l.asset_id) AS asset_id
       FROM market_events m LEFT JOIN listings l ON l.id = m.listing_id),
ze AS (SELECT e.*, coalesce(z.zone_label, 'Sin zona') AS zone_label FROM ev e LEFT JOIN za z ON z.id = e.asset_id WHERE source_channel = 'flow'),
fa AS (
    SELECT zone_label, count(*) AS assets_count, count(DISTINCT asset_type_detail) AS asset_type_diversity, count(neighborhood) AS geo_neighborhood_assets,
           count(*) FILTER (neighborhood IS NULL AND district IS NOT NULL) AS geo_district_assets, count(lat) AS geo_point_assets FROM za GROUP BY 1
),
tp AS (SELECT zone_label, source_portal AS top_portal FROM (
        SELECT zone_label, source_portal, row_number() OVER (PARTITION BY zone_label ORDER BY count(*) DESC, source_portal) AS k FROM zl WHERE source_portal IS NOT NULL GROUP BY 1, 2) q WHERE k = 1),
fl AS (
    SELECT zone_label, count(*) AS listings_count, count(*) FILTER ({ACTIVE}) AS active_listings_count, count(DISTINCT contact_id) AS contacts_count,
           count(DISTINCT source_portal) AS portal_diversity, {MEAN('price_eur')} AS avg_price_eur, {MEAN('price_per_m2')} AS avg_price_m2, {MEAN('area_m2')} AS avg_area_m2 FROM zl GROUP BY 1
),
fp AS (
    SELECT zone_label, count(*) AS unique_phone_count, count(*) FILTER (phone_profile = 'owner_like') AS owner_like_phone_count, count(*) FILTER (phone_profile = 'broker_like') AS broker_like_phone_count
    FROM (SELECT DISTINCT zone_label, phone_norm FROM zl JOIN contacts c ON c.id = zl.contact_id) q JOIN prof USING (phone_norm) GROUP BY 1
),
fe AS (
    SELECT zone_label, count(*) AS resolved_events, count(*) FILTER ({SINCE(7)}) AS events_7d, count(*) FILTER ({SINCE(14)}) AS events_14d, count(*) FILTER ({SINCE(30)}) AS events_30d,
           {', '.join(f"count(*) FILTER ({SINCE(14)} AND event_type = '{t}') AS {t}_count" for t in ('listing_detected', 'price_drop', 'reserved', 'sold', 'not_available', 'expired'))}
    FROM ze GROUP BY 1
),
fr AS (SELECT zone_label, count(*) AS raw_in_zone FROM zf GROUP BY 1),
f0 AS (
    SELECT zone_label, {', '.join(f'coalesce({x}, 0) AS {x}' for x in 'assets_count asset_type_diversity geo_neighborhood_assets geo_district_assets geo_point_assets listings_count active_listings_count contacts_count portal_diversity unique_phone_count owner_like_phone_count broker_like_phone_count resolved_events events_7d events_14d events_30d listing_detected_count price_drop_count reserved_count sold_count not_available_count expired_count raw_in_zone'.split())},
           avg_price_eur, avg_price_m2, avg_area_m2, top_portal
    FROM fa FULL JOIN fl USING (zone_label) FULL JOIN tp USING (zone_label) FULL JOIN fp USING (zone_label) FULL JOIN fe USING (zone_label) FULL JOIN fr USING (zone_label)
),
f1 AS (
    SELECT f0.*, fs.freshness_days, reserved_count + sold_count + not_available_count + expired_count AS absorption_count, c.population, c.change_of_use_rate, c.inspections_rate, c.closed_rate, c.vut_rate
    FROM f0 CROSS JOIN fs LEFT JOIN zone_context c USING (zone_label)
),
f AS (
    SELECT *, listing_detected_count - absorption_count AS net_new_supply, greatest(raw_in_zone - resolved_events, 0) AS unresolved_estimated,
           {RATIO('broker_like_phone_count', 'unique_phone_count')} AS broker_phone_share, {RATIO('owner_like_phone_count', 'unique_phone_count')} AS owner_phone_share,
           {RATIO('listings_count', 'assets_count', 3)} AS listings_per_asset, {RATIO('resolved_events', 'raw_in_zone')} AS resolved_ratio, {RATIO('geo_point_assets', 'assets_count')} AS geo_coverage_ratio,
           {', '.join(f"CASE WHEN coalesce(population, 0) = 0 THEN 0.0 ELSE {R(f'CAST({n} AS DOUBLE) / population * {m}', 4)} END AS {k}" for k, n, m in (('assets_per_1k', 'assets_count', '1000e0'), ('active_listings_per_1k', 'active_listings_count', '1000e0'), ('events_per_10k', 'events_14d', '10000e0'), ('detected_per_10k', 'listing_detected_count', '10000e0'), ('drops_per_10k', 'price_drop_count', '10000e0'), ('absorption_per_10k', 'absorption_count', '10000e0'), ('raw_per_10k', 'raw_in_zone', '10000e0')))}
    FROM f1
),
k0 AS (
    SELECT *, CAST(CASE WHEN coalesce(population, 0) <> 0 THEN 1 ELSE 0 END AS DOUBLE) AS has_context,
           CASE WHEN assets_count = 0 THEN 0.0 ELSE CAST(geo_point_assets AS DOUBLE) / assets_count END AS point_ratio, CASE WHEN assets_count = 0 THEN 0.0 ELSE CAST(geo_neighborhood_assets AS DOUBLE) / assets_count END AS near_ratio
    FROM f WHERE assets_count > 0 OR events_14d > 0 OR raw_in_zone > 0
),
"""
_N = {"active": "active_listings_count", "lpa": "listings_per_asset", "broker": "broker_phone_share", "events": "events_14d", "supply": "listing_detected_count", "drops": "price_drop_count", "absorbed": "absorption_count", "resolved": "resolved_ratio", "kinds": "asset_type_diversity", "portals": "portal_diversity", "events_pop": "events_per_10k", "listings_pop": "active_listings_per_1k", "drops_pop": "drops_per_10k", "absorbed_pop": "absorption_per_10k", "change": "change_of_use_rate", "inspections": "inspections_rate", "closed": "closed_rate", "vut": "vut_rate", "context": "has_context", "point": "point_ratio", "near": "near_ratio"}


def scaled(x: str, name: str) -> str:
    v = f"CAST(coalesce({x}, 0) AS DOUBLE)"
    return f"CASE WHEN max({v}) OVER () = min({v}) OVER () THEN 0.5 ELSE ({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()) END AS {name}"


_D = lambda s: s
SCORED = BASE + f"""
k1 AS (SELECT *, {', '.join(scaled(v, f'n_{k}') for k, v in _N.items())} FROM k0),
k2 AS (
    SELECT *, 0.45e0 * n_active + 0.30e0 * n_lpa + 0.25e0 * n_broker AS sat, 0.28e0 * n_events + 0.22e0 * n_supply + 0.18e0 * n_absorbed + 0.20e0 * n_events_pop + 0.12e0 * n_absorbed_pop AS heat,
           0.40e0 * n_events_pop + 0.30e0 * n_absorbed_pop + 0.30e0 * n_listings_pop AS rel, 0.38e0 * n_change + 0.26e0 * n_inspections + 0.24e0 * n_closed + 0.12e0 * n_vut AS tra, 0.60e0 * n_point + 0.40e0 * n_near AS geo,
           least(greatest(0.50e0 * (absorption_count / (listing_detected_count + 1e0)) + 0.30e0 * n_absorbed + 0.20e0 * n_events, 0e0), 1e0) AS liq FROM k1
),
k3 AS (
    SELECT *, 0.25e0 * n_drops + 0.20e0 * n_drops_pop + 0.20e0 * sat + 0.15e0 * n_broker + 0.10e0 * greatest(n_supply - n_absorbed, 0e0) + 0.10e0 * tra AS pre,
           0.32e0 * n_resolved + 0.18e0 * CASE WHEN freshness_days <= 3 THEN 1e0 WHEN freshness_days <= 7 THEN 0.8e0 WHEN freshness_days <= 14 THEN 0.6e0 WHEN freshness_days <= 30 THEN 0.35e0 ELSE 0.15e0 END + 0.15e0 * n_kinds + 0.10e0 * n_portals + 0.20e0 * geo + 0.05e0 * n_context AS con FROM k2
),
k4 AS (
    SELECT *, {', '.join(f"{R(f'{v} * 100', 1)} AS zone_{k}_score" for k, v in (('saturation', 'sat'), ('heat', 'heat'), ('relative_heat', 'rel'), ('transformation_signal', 'tra'), ('pressure', 'pre'), ('liquidity', 'liq'), ('confidence', 'con')))},
           {R('(0.24e0 * heat + 0.18e0 * rel + 0.22e0 * pre + 0.12e0 * liq + 0.14e0 * con + 0.10e0 * tra) * 100', 1)} AS zone_capture_score, {R('point_ratio', 4)} AS geo_point_ratio FROM k3
),
k5 AS (
    SELECT *, CASE WHEN zone_confidence_score < 40 THEN 'Poca senal / baja confianza' WHEN zone_capture_score >= 75 AND zone_pressure_score >= 55 THEN 'Captacion agresiva'
                   WHEN zone_capture_score >= 60 THEN 'Captacion selectiva' WHEN zone_pressure_score >= 70 AND zone_liquidity_score >= 50 THEN 'Negociacion mas que captacion'
                   WHEN zone_pressure_score >= 75 AND zone_liquidity_score < 40 THEN 'Zona saturada' WHEN zone_capture_score >= 45 OR zone_liquidity_score >= 50 THEN 'Seguir y vigilar' ELSE 'Baja prioridad' END AS recommended_action,
           {R('''least(greatest(0.26e0 * zone_liquidity_score + 0.18e0 * zone_heat_score + 0.18e0 * zone_relative_heat_score + 0.14e0 * zone_confidence_score + 0.12e0 * zone_capture_score + 0.08e0 * zone_transformation_signal_score
              + 0.06e0 * zone_pressure_score - greatest(zone_pressure_score - zone_liquidity_score, 0e0) * 0.08e0 - greatest(zone_saturation_score - 58e0, 0e0) * 0.05e0, 0e0), 100e0)''', 1)} AS predicted_absorption_score
    FROM k4
),
z AS (SELECT *, CASE WHEN predicted_absorption_score >= 72 THEN 'alta' WHEN predicted_absorption_score >= 56 THEN 'media' WHEN predicted_absorption_score >= 40 THEN 'moderada' ELSE 'baja' END AS predicted_absorption_band,
            CAST(CASE WHEN predicted_absorption_score >= 72 THEN 7 WHEN predicted_absorption_score >= 56 THEN 14 ELSE 30 END AS INTEGER) AS predicted_action_window_days FROM k5)
"""
_MX, _MY = "floor(lon * (111320e0 * cos(radians(40.4168e0))) / 350e0)", "floor(lat * 111320e0 / 350e0)"
_B36 = lambda x: f"(CASE WHEN {x} >= 0 THEN 'p' ELSE 'm' END || lower(to_base(CAST(abs({x}) AS BIGINT), 36)))"
MICRO = SCORED + f""",
ma AS (SELECT *, zone_label || ' / MZ ' || {_B36(_MX)} || '-' || {_B36(_MY)} AS microzone_label FROM za WHERE lat IS NOT NULL AND lon IS NOT NULL),
m0 AS (SELECT microzone_label, min(zone_label) AS parent_zone_label, count(*) AS assets_count, CAST(sum(CAST(floor(lat * 1e6 + 0.5) AS HUGEINT)) AS DOUBLE) / (count(*) * 1000000) AS lat, CAST(sum(CAST(floor(lon * 1e6 + 0.5) AS HUGEINT)) AS DOUBLE) / (count(*) * 1000000) AS lon FROM ma GROUP BY 1),
m1 AS (SELECT microzone_label, count(*) AS listings_count, count(*) FILTER ({ACTIVE}) AS active_listings_count, {MEAN('price_per_m2')} AS avg_price_m2 FROM listings l JOIN ma ON ma.id = l.asset_id GROUP BY 1),
m2 AS (SELECT microzone_label, count(*) AS events_14d, count(*) FILTER (event_type = 'listing_detected') AS listing_detected_count, count(*) FILTER (event_type = 'price_drop') AS price_drop_count,
              count(*) FILTER (event_type IN ('reserved', 'sold', 'not_available', 'expired')) AS absorption_count FROM ze JOIN ma ON ma.id = ze.asset_id WHERE {SINCE(14)} GROUP BY 1),
m3 AS (
    SELECT m0.microzone_label, m0.parent_zone_label, m0.assets_count, coalesce(m1.listings_count, 0) AS listings_count, coalesce(m1.active_listings_count, 0) AS active_listings_count, coalesce(m2.events_14d, 0) AS events_14d,
           coalesce(m2.listing_detected_count, 0) AS listing_detected_count, coalesce(m2.price_drop_count, 0) AS price_drop_count, coalesce(m2.absorption_count, 0) AS absorption_count, m1.avg_price_m2,
           {R(f'({_MY} + 0.5) * 350e0 / 111320e0', 6)} AS centroid_lat, {R(f'({_MX} + 0.5) * 350e0 / (111320e0 * cos(radians(40.4168e0)))', 6)} AS centroid_lon,
           z.assets_count AS pa, z.events_14d AS pe, z.zone_capture_score AS p1, z.zone_relative_heat_score AS p2, z.zone_confidence_score AS p3, z.zone_transformation_signal_score AS p4
    FROM m0 LEFT JOIN m1 USING (microzone_label) LEFT JOIN m2 USING (microzone_label) LEFT JOIN z ON z.zone_label = m0.parent_zone_label
),
m4 AS (SELECT *, {RATIO('assets_count', 'pa')} AS assets_share_in_parent, {RATIO('events_14d', 'pe')} AS events_share_in_parent, {RATIO('events_14d', 'assets_count')} AS events_per_asset,
              {RATIO('active_listings_count', 'assets_count')} AS lpa, {RATIO('price_drop_count', 'assets_count')} AS dpa, {RATIO('absorption_count', 'assets_count')} AS apa FROM m3),
m5 AS (SELECT *, {', '.join(scaled(v, k) for k, v in (('n1', 'events_per_asset'), ('n2', 'lpa'), ('n3', 'dpa'), ('n4', 'apa'), ('n5', 'events_share_in_parent / greatest(assets_share_in_parent, 0.0001e0)'), ('n6', 'assets_count')))} FROM m4),
m6 AS (SELECT *, 0.36e0 * n1 + 0.24e0 * n2 + 0.22e0 * n3 + 0.18e0 * n4 AS it, 0.34e0 * (coalesce(p1, 0) / 100e0) + 0.28e0 * (coalesce(p2, 0) / 100e0) + 0.22e0 * (coalesce(p3, 0) / 100e0) + 0.16e0 * (coalesce(p4, 0) / 100e0) AS su,
              0.42e0 * n6 + 0.38e0 * (coalesce(p3, 0) / 100e0) + 0.20e0 * least(assets_count / 4e0, 1e0) AS co FROM m5),
m7 AS (SELECT *, {R('n5 * 100', 1)} AS microzone_concentration_score, {R('it * 100', 1)} AS microzone_local_intensity_score, {R('(0.42e0 * it + 0.30e0 * n5 + 0.18e0 * su + 0.10e0 * co) * 100', 1)} AS microzone_capture_score, {R('co * 100', 1)} AS microzone_confidence_score FROM m6),
m AS (SELECT *, CASE WHEN microzone_confidence_score < 40 THEN 'Validar antes de actuar' WHEN microzone_capture_score >= 70 AND microzone_concentration_score >= 60 THEN 'Ir al punto caliente'
                     WHEN microzone_capture_score >= 58 THEN 'Microzona prioritaria' WHEN microzone_capture_score >= 45 THEN 'Seguir de cerca' ELSE 'Baja prioridad' END AS recommended_action FROM m7)
"""
_CASE = lambda col, table, other: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"
_AGE = f"greatest(floor(epoch(TIMESTAMP '{AS_OF}' - event_datetime) / 86400), 0)"
QUEUE = MICRO + f""",
bl AS (SELECT asset_id, id AS best FROM (SELECT asset_id, id, row_number() OVER (PARTITION BY asset_id ORDER BY coalesce(lower(status), '') IN ('', 'active', 'disponible', 'en venta') DESC, updated_at DESC NULLS LAST, id DESC) AS k FROM listings) q WHERE k = 1),
q0 AS (
    SELECT e.event_id, e.event_type, e.event_datetime, e.price_old, e.price_new, e.asset_id, e.zone_label, coalesce(e.listing_id, bl.best) AS listing_id, a.neighborhood, a.district, a.lat, a.lon, ma.microzone_label,
           CASE WHEN event_type = 'price_drop' AND price_old > 0 AND price_new <> 0 THEN greatest((price_old - price_new) / price_old, 0e0) END AS price_drop_pct
    FROM ze e LEFT JOIN za a ON a.id = e.asset_id LEFT JOIN bl ON bl.asset_id = e.asset_id LEFT JOIN ma ON ma.id = e.asset_id WHERE {SINCE(14)}
),
q1 AS (
    SELECT q0.*, l.contact_id, l.source_portal, c.phone_raw AS contact_phone, coalesce(p.phone_profile, 'unknown') AS phone_profile, lat IS NOT NULL AND lon IS NOT NULL AS has_geo_point,
           {_CASE('event_type', {'listing_detected': '32e0', 'price_drop': '28e0', 'price_raise': '10e0', 'reserved': '22e0', 'sold': '18e0', 'not_available': '12e0', 'expired': '16e0'}, '8e0')} AS b,
           CASE WHEN {_AGE} <= 1 THEN 18e0 WHEN {_AGE} <= 3 THEN 14e0 WHEN {_AGE} <= 7 THEN 10e0 WHEN {_AGE} <= 14 THEN 6e0 WHEN {_AGE} <= 30 THEN 2e0 ELSE 0e0 END AS rc,
           CASE WHEN event_type <> 'price_drop' THEN 0e0 WHEN price_drop_pct IS NULL THEN 6e0 WHEN price_drop_pct >= 0.20e0 THEN 18e0 WHEN price_drop_pct >= 0.10e0 THEN 12e0 WHEN price_drop_pct >= 0.05e0 THEN 8e0 ELSE 4e0 END AS pr,
           0.34e0 * (coalesce(z.zone_capture_score, 0) / 100e0) * 20e0 + 0.24e0 * (coalesce(z.zone_pressure_score, 0) / 100e0) * 15e0 + 0.14e0 * (coalesce(z.zone_confidence_score, 0) / 100e0) * 10e0
             + 0.16e0 * (coalesce(z.zone_relative_heat_score, 0) / 100e0) * 14e0 + 0.12e0 * (coalesce(z.zone_transformation_signal_score, 0) / 100e0) * 14e0 AS zs,
           0.50e0 * (coalesce(m.microzone_capture_score, 0) / 100e0) * 12e0 + 0.30e0 * (coalesce(m.microzone_concentration_score, 0) / 100e0) * 10e0 + 0.20e0 * (coalesce(m.microzone_confidence_score, 0) / 100e0) * 8e0 AS ms,
           CASE WHEN neighborhood IS NOT NULL THEN 6e0 WHEN district IS NOT NULL THEN 3e0 ELSE 0e0 END + CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 6e0 ELSE 0e0 END AS gs,
           {R(f'''least(greatest(0.58e0 * coalesce(z.predicted_absorption_score, 0) + 0.22e0 * ((0.45e0 * coalesce(m.microzone_capture_score, 0) + 0.35e0 * coalesce(m.microzone_concentration_score, 0) + 0.20e0 * coalesce(m.microzone_confidence_score, 0)) / 10e0)
              + {_CASE('event_type', {'listing_detected': '12e0', 'price_drop': '14e0', 'reserved': '8e0', 'sold': '8e0', 'expired': '4e0', 'not_available': '4e0'}, '0e0')}
              + CASE WHEN price_drop_pct >= 0.15e0 THEN 10e0 WHEN price_drop_pct >= 0.08e0 THEN 6e0 WHEN price_drop_pct >= 0.03e0 THEN 3e0 ELSE 0e0 END + CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 4e0 ELSE 0e0 END, 0e0), 100e0)''', 1)} AS predicted_opportunity_score,
           concat_ws(' | ', {_CASE('event_type', {'price_drop': "'bajada de precio'", 'listing_detected': "'entrada reciente'", 'reserved': "'reservado'", 'sold': "'vendido'", 'expired': "'caducado'", 'not_available': "'retirado'"}, "coalesce(event_type, 'evento')")},
              CASE WHEN z.zone_capture_score >= 65 THEN 'zona fuerte para captacion' WHEN z.zone_pressure_score >= 65 THEN 'zona con presion alta' END, CASE WHEN z.zone_relative_heat_score >= 65 THEN 'actividad relativa alta' END,
              CASE WHEN z.zone_transformation_signal_score >= 65 THEN 'senal transformadora alta' END, CASE WHEN m.microzone_capture_score >= 65 THEN 'microzona caliente' WHEN m.microzone_concentration_score >= 65 THEN 'microzona concentrada' END,
              CASE WHEN p.phone_profile <> 'unknown' THEN 'telefono ' || p.phone_profile END, CASE WHEN neighborhood IS NOT NULL THEN 'geo por barrio' WHEN district IS NOT NULL THEN 'geo por distrito' END) AS reason
    FROM q0 LEFT JOIN listings l ON l.id = q0.listing_id LEFT JOIN contacts c ON c.id = l.contact_id LEFT JOIN prof p ON p.phone_norm = c.phone_norm
    LEFT JOIN z ON z.zone_label = q0.zone_label LEFT JOIN m ON m.microzone_label = q0.microzone_label
),
q2 AS (SELECT *, predicted_opportunity_score * 0.12e0 AS ps, b + rc + pr + zs + ms + predicted_opportunity_score * 0.12e0 + gs AS total FROM q1),
q AS (
    SELECT *, {', '.join(f"{R(v, 2)} AS {k}" for k, v in (('score', 'total'), ('score_event_base', 'b'), ('score_recency', 'rc'), ('score_price_signal', 'pr'), ('score_zone_signal', 'zs'), ('score_microzone_signal', 'ms'), ('score_predictive_signal', 'ps'), ('score_geo_signal', 'gs')))},
           CASE WHEN total >= 62 THEN 'alta' WHEN total >= 50 THEN 'media' ELSE 'seguimiento' END AS priority_label,
           CASE WHEN predicted_opportunity_score >= 72 THEN 'alta' WHEN predicted_opportunity_score >= 56 THEN 'media' WHEN predicted_opportunity_score >= 40 THEN 'moderada' ELSE 'baja' END AS predicted_opportunity_band
    FROM q2
)
"""
_TOP = lambda src, kind, keys, k, label="zone_label", where="true": f"(SELECT '{kind}' AS kind, {label} FROM {src} WHERE {where} ORDER BY {', '.join(keys)}, {label} LIMIT {k})"
_CLIP = lambda x: f"CASE WHEN count(*) OVER () < 6 THEN {x} ELSE least(greatest({x}, quantile_cont({x}, 0.1) OVER ()), quantile_cont({x}, 0.9) OVER ()) END"
_W = "w AS (SELECT *, " + ", ".join(f"{_CLIP(f'zone_{k}_score')} AS {k}_sort" for k in ("capture", "heat", "pressure", "liquidity")) + " FROM z)"
_ALERTS = f"al AS (SELECT zone_label, count(*) AS alerts_in_window, CAST(sum(id % 4 + 1) AS BIGINT) AS occurrences_in_window, count(*) FILTER (id % 2 = 0) AS resolved_in_window FROM zf GROUP BY 1)"
_V1 = SCORED + f""",
{_ALERTS},
v0 AS (SELECT f.*, coalesce(alerts_in_window, 0) AS aw, coalesce(occurrences_in_window, 0) AS ow, coalesce(resolved_in_window, 0) AS rw FROM f LEFT JOIN al USING (zone_label) WHERE assets_count > 0 OR listings_count > 0),
v1 AS (SELECT *, {', '.join(scaled(v, k) for k, v in (('x1', 'listings_count'), ('x2', 'listings_per_asset'), ('x3', 'contacts_count'), ('x4', 'aw'), ('x5', 'ow'), ('x6', 'rw'), ('x7', 'asset_type_diversity')))} FROM v0),
v2 AS (SELECT *, 0.55e0 * x1 + 0.25e0 * x2 + 0.20e0 * x3 AS s, 0.50e0 * x4 + 0.35e0 * x5 + 0.15e0 * x6 AS a, CASE WHEN aw = 0 THEN 0e0 ELSE CAST(rw AS DOUBLE) / aw END AS c FROM v1),
v3 AS (SELECT zone_label, {R('s * 100', 1)} AS zone_saturation_score, {R('a * 100', 1)} AS zone_activity_score, {R('(0.45e0 * a + 0.25e0 * (1 - s) + 0.15e0 * x7 + 0.15e0 * c) * 100', 1)} AS zone_opportunity_score, {R('c * 100', 1)} AS confidence_ratio FROM v2),
v AS (SELECT *, CASE WHEN zone_opportunity_score >= 70 AND zone_saturation_score <= 60 THEN 'Atacar ya' WHEN zone_saturation_score >= 75 AND zone_activity_score <= 40 THEN 'Zona quemada'
                     WHEN zone_activity_score >= 60 AND zone_saturation_score < 75 THEN 'Vigilar' WHEN zone_activity_score < 25 AND zone_saturation_score < 40 THEN 'Baja prioridad' ELSE 'Seguir observando' END AS recommended_action FROM v3)
"""
_GROUP = lambda by, key, label: f"""(SELECT g.group_key, group_label, n, top_score, avg_score, zones, portals, top_reason, '{by}' AS group_by FROM (
    SELECT {key} AS group_key, min({label}) AS group_label, count(*) AS n, max(score) AS top_score, {R('CAST(sum(CAST(floor(score * 100 + 0.5) AS HUGEINT)) AS DOUBLE) / (count(*) * 100)', 2)} AS avg_score,
           count(DISTINCT zone_label) AS zones, count(DISTINCT source_portal) AS portals FROM q GROUP BY 1) g
    JOIN (SELECT group_key, reason AS top_reason FROM (SELECT {key} AS group_key, reason, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, reason) AS k FROM q GROUP BY 1, 2) t WHERE k = 1) r USING (group_key))"""  # noqa: E731
_CONTACT = "CASE WHEN contact_phone <> '' THEN contact_phone WHEN contact_id IS NOT NULL THEN 'contact:' || contact_id ELSE 'sin_contacto' END"
_FOCUS = {"capture": "zone_capture_score", "confidence": "zone_confidence_score", "transformation": "zone_transformation_signal_score", "heat": "coalesce(nullif(zone_relative_heat_score, 0), zone_heat_score)", "pressure": "zone_pressure_score", "liquidity": "zone_liquidity_score", "predictive": "predicted_absorption_score"}
_FOCUS["overall"] = R(f"0.36e0 * zone_capture_score + 0.22e0 * zone_confidence_score + 0.16e0 * {_FOCUS['heat']} + 0.14e0 * zone_transformation_signal_score + 0.12e0 * zone_liquidity_score", 1)


def _oracles() -> dict[str, str]:
    from plotline.plans import zone_queries as zq

    features = ", ".join(zq.FEATURES)
    return {
        "phone_profiles": BASE.rstrip().rstrip(",") + " SELECT * FROM prof",
        "infer_zone": BASE.rstrip().rstrip(",") + " SELECT id, zone_label FROM za",
        "zone_features_v1": BASE.rstrip().rstrip(",") + " SELECT zone_label, assets_count, asset_type_diversity, geo_neighborhood_assets, geo_district_assets, geo_point_assets, listings_count, contacts_count, avg_price_eur, avg_price_m2, top_portal, listings_per_asset FROM f WHERE assets_count > 0 OR listings_count > 0",
        "zone_features_v2": BASE.rstrip().rstrip(",") + f" SELECT {features} FROM f",
        "freshness_days": BASE.rstrip().rstrip(",") + " SELECT freshness_days FROM fs",
        "alert_zone_features": BASE + _ALERTS + " SELECT * FROM al",
        "zone_scores_v1": _V1 + " SELECT * FROM v",
        "zone_scores_v2": SCORED + f" SELECT zone_label, {', '.join(zq.SCORE_COLUMNS)}, geo_point_ratio, recommended_action FROM z",
        "zone_prediction": SCORED + " SELECT zone_label, predicted_absorption_score, predicted_absorption_band, predicted_action_window_days FROM z",
        "microzone_features": MICRO + f" SELECT {', '.join(zq.MICRO)} FROM m",
        "microzone_scores": MICRO + f" SELECT microzone_label, {', '.join(zq.MICRO_SCORES)} FROM m",
        "opportunity_queue": QUEUE + f" SELECT {', '.join(zq.QUEUE)} FROM q",
        "opportunity_top": QUEUE + " SELECT event_id, score, priority_label FROM q ORDER BY score DESC, event_datetime DESC, event_id LIMIT 100",
        "filter_opportunities": QUEUE + " SELECT event_id, score, zone_label FROM q WHERE event_type = 'price_drop' AND has_geo_point AND score >= 40 AND replace(lower(concat_ws(' ', zone_label, microzone_label, neighborhood, district, source_portal, contact_phone, reason)), '_', '') LIKE '%nation1%'",
        "opportunity_groups": QUEUE + f" SELECT * FROM {_GROUP('zone', 'zone_label', 'zone_label')} UNION ALL SELECT * FROM {_GROUP('event_type', 'event_type', 'event_type')} UNION ALL SELECT * FROM {_GROUP('contact', _CONTACT, 'contact_phone')}",
        "select_group": QUEUE + " SELECT event_id, score FROM q WHERE event_type = 'sold'",
        "best_listing": cte("listings") + """ SELECT asset_id, max(id) FILTER (a = 1) AS cheapest_id, max(id) FILTER (b = 1) AS newest_id FROM (
            SELECT asset_id, id, row_number() OVER (PARTITION BY asset_id ORDER BY coalesce(lower(status), '') IN ('', 'active', 'disponible', 'en venta') DESC, price_eur, id DESC) AS a,
                   row_number() OVER (PARTITION BY asset_id ORDER BY coalesce(lower(status), '') IN ('', 'active', 'disponible', 'en venta') DESC, updated_at DESC NULLS LAST, id DESC) AS b FROM listings) t GROUP BY 1""",
        "event_asset": BASE.rstrip().rstrip(",") + " SELECT event_id AS id, asset_id FROM ev",
        "snapshot_window": "SELECT strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min_dt, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max_dt FROM lineitem",
        "zone_context": BASE.rstrip().rstrip(",") + " SELECT t.zone_label, population, change_of_use_24m, change_of_use_rate, inspections_rate, closed_rate, vut_rate, zone_level FROM (SELECT DISTINCT zone_label FROM za) t LEFT JOIN zone_context c USING (zone_label)",
        "winsorize": SCORED + f", {_W} SELECT zone_label, round(capture_sort, 4) AS capture_sort, round(heat_sort, 4) AS heat_sort FROM w",
        "radar_top": SCORED + f", {_W} SELECT zone_label, zone_capture_score, zone_confidence_score, recommended_action FROM w ORDER BY capture_sort DESC, zone_confidence_score DESC, zone_heat_score DESC, zone_label LIMIT 12",
        "radar_all": SCORED + f", {_W} " + " UNION ALL ".join("SELECT * FROM " + _TOP("w", kind, keys, 12) for kind, keys in {
            "capture": ["capture_sort DESC", "zone_confidence_score DESC", "zone_heat_score DESC"], "heat": ["heat_sort DESC", "zone_relative_heat_score DESC", "events_per_10k DESC", "zone_confidence_score DESC"],
            "pressure": ["pressure_sort DESC", "price_drop_count DESC", "zone_confidence_score DESC"], "transformation": ["zone_transformation_signal_score DESC", "coalesce(change_of_use_rate, 0) DESC", "coalesce(closed_rate, 0) DESC", "zone_confidence_score DESC"],
            "liquidity": ["liquidity_sort DESC", "absorption_count DESC", "zone_confidence_score DESC"], "predictive": ["predicted_absorption_score DESC", "zone_liquidity_score DESC", "zone_relative_heat_score DESC", "zone_confidence_score DESC"],
            "low_confidence": ["zone_confidence_score", "raw_in_zone DESC"]}.items()),
        "radar_microzones": MICRO + " SELECT microzone_label, microzone_capture_score FROM m ORDER BY microzone_capture_score DESC, microzone_concentration_score DESC, microzone_confidence_score DESC, events_14d DESC, microzone_label LIMIT 12",
        "radar_summary": MICRO + """ SELECT count(*) AS zones_total, count(*) FILTER (zone_confidence_score >= 60) AS high_confidence_zones, count(*) FILTER (zone_confidence_score < 40) AS low_confidence_zones,
            count(*) FILTER (zone_capture_score >= 60 AND zone_confidence_score >= 50) AS capture_ready_zones, count(*) FILTER (zone_heat_score >= 65) AS hot_zones, count(*) FILTER (zone_relative_heat_score >= 65) AS relative_hot_zones,
            count(*) FILTER (zone_transformation_signal_score >= 65) AS transform_zones, count(*) FILTER (predicted_absorption_score >= 65) AS predictive_zones, (SELECT count(*) FROM m) AS microzones_total,
            (SELECT count(*) FROM m WHERE microzone_capture_score >= 65) AS microzone_hotspots FROM z""",
        "radar_v1": _V1 + " " + " UNION ALL ".join("SELECT * FROM " + _TOP("v", k, o, 12) for k, o in {"opportunity": ["zone_opportunity_score DESC", "zone_activity_score DESC"], "saturation": ["zone_saturation_score DESC"], "activity": ["zone_activity_score DESC"]}.items()),
        "dashboard_tops": SCORED + " SELECT * FROM " + _TOP("z", "low_confidence", ["(zone_label = 'Sin zona') DESC", "raw_in_zone DESC", "zone_confidence_score"], 8, where="zone_confidence_score < 40")
        + " UNION ALL SELECT * FROM " + _TOP("z", "transformation", ["zone_transformation_signal_score DESC", "coalesce(change_of_use_rate, 0) DESC", "coalesce(closed_rate, 0) DESC"], 8, where="zone_transformation_signal_score > 0")
        + " UNION ALL SELECT * FROM " + _TOP("z", "predictive", ["predicted_absorption_score DESC", "zone_liquidity_score DESC", "zone_relative_heat_score DESC"], 8, where="predicted_absorption_score > 0"),
        "zone_focus_compare": SCORED + ", fo AS (" + " UNION ALL ".join(f"SELECT '{k}' AS focus, zone_label, {v} AS value FROM z" for k, v in _FOCUS.items()) + ") SELECT a.focus, a.zone_label AS zone_a, a.value AS score_a, b.zone_label AS zone_b, b.value AS score_b, CASE WHEN a.value >= b.value THEN a.zone_label ELSE b.zone_label END AS winner FROM fo a JOIN fo b ON a.focus = b.focus AND a.zone_label < b.zone_label",
        "map_viewport": cte("assets") + f" SELECT count(*) AS n, {R('CAST(sum(CAST(floor(lat * 1e6 + 0.5) AS HUGEINT)) AS DOUBLE) / (count(*) * 1000000)', 6)} AS center_lat, {R('CAST(sum(CAST(floor(lon * 1e6 + 0.5) AS HUGEINT)) AS DOUBLE) / (count(*) * 1000000)', 6)} AS center_lon, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM assets WHERE lat IS NOT NULL AND lon IS NOT NULL",
        "filter_microzones": MICRO + " SELECT microzone_label, microzone_capture_score FROM m WHERE microzone_capture_score >= 30 AND lower(microzone_label) LIKE '%nation%'",
        "map_points": QUEUE + " SELECT event_id, lat, lon, score, priority_label, least(greatest(score / 80e0, 0.2e0), 1e0) AS heat_weight FROM q WHERE has_geo_point ORDER BY score DESC, event_id LIMIT 200",
        "zone_detail": BASE + """ zd AS (SELECT z.zone_label, source_portal, asset_type_detail, phone_raw FROM listings l JOIN za z ON z.id = l.asset_id LEFT JOIN contacts c ON c.id = l.contact_id),
            zk AS (SELECT zone_label, 'portal' AS kind, source_portal AS value FROM zd UNION ALL SELECT zone_label, 'type', asset_type_detail FROM zd UNION ALL SELECT zone_label, 'phone', phone_raw FROM zd)
            SELECT * FROM (SELECT zone_label, kind, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY zone_label, kind ORDER BY count(*) DESC, value) AS INTEGER) AS place FROM zk WHERE value IS NOT NULL GROUP BY 1, 2, 3) t WHERE place <= 10""",
        "opportunity_queue_v1": SCORED + f""" SELECT event_id, e.zone_label, {R('''0.55e0 * zone_capture_score + 0.20e0 * zone_pressure_score + 0.15e0 * zone_confidence_score
            + (CASE WHEN event_type = 'listing_detected' THEN 22e0 WHEN event_type = 'price_drop' THEN 18e0 WHEN event_type IN ('reserved', 'sold', 'not_available') THEN 10e0 ELSE 6e0 END + CASE WHEN c.phone_norm IS NOT NULL AND owner_like_phone_count > 0 THEN 4e0 ELSE 0e0 END)''', 1)} AS priority_score
            FROM ze e JOIN z USING (zone_label) LEFT JOIN listings l ON l.id = e.listing_id LEFT JOIN contacts c ON c.id = l.contact_id WHERE {SINCE(14)}""",
    }


ORACLES = _oracles()
