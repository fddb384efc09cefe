"""Explanation texts for zones, opportunities and flow cases (F-34): tables of conditions and phrases, joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.bands import chain
from plotline.functions.numbers import rounded

#: Names of events and reasons in texts.
EVENT_NAMES = {"listing_detected": "entrada nueva", "price_drop": "bajada de precio", "price_raise": "subida de precio", "reserved": "reserva", "sold": "venta", "expired": "caducidad", "not_available": "retirada"}
REASON_NAMES = {
    "resolved_strong": "encaje muy solido", "resolved_soft": "encaje razonable", "ambiguous_multiple_candidates": "hay varios candidatos plausibles", "pending_review": "queda pendiente de revisar", "not_in_csv_yet": "puede que aun no este en el baseline",
    "no_candidates": "no aparecen candidatos claros", "zone_only_address": "la direccion es demasiado generica", "repeated_phone_conflict": "el telefono se repite demasiado", "price_conflict": "el precio no termina de cuadrar", "weak_identity": "faltan senales de identidad",
}
STATE_NAMES = {"resolved": "Caso bastante encajado", "ambiguous": "Caso dudoso", "pending": "Caso pendiente"}
#: Next steps of a flow case by status, and by reason where it is not resolved, ambiguous.
CASE_STEPS = {
    "resolved": "Se puede aceptar el enlace, pero conviene revisar una muestra manual para seguir afinando el matching.", "ambiguous": "Abrir el caso y elegir entre los candidatos antes de crear confianza falsa.",
    "weak": "No enlazar aun. Hace falta validar direccion, telefono o portal con mas contexto.", "new": "Esperar la siguiente importacion baseline o buscar si el activo aun no ha entrado.", "other": "Mantener el caso en revision hasta tener una senal mas clara.",
}


def _n(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _one(c: Column) -> Column:
    """With one decimal."""
    return F.format_string("%.1f", rounded(c, 1))


def phrases(*rules: tuple[Column, str]) -> Column:
    """The phrases whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in rules]))


def steps(name: Column, *levels: tuple[float, str]) -> list[tuple[Column, str]]:
    """Rules of which the first whose level is reached holds."""
    out, above = [], None
    for least, text in levels:
        out.append(((name >= least) if above is None else (name >= least) & (name < above), text))
        above = least
    return out


def sentence(*parts: Column) -> Column:
    """The parts that are there, each a sentence."""
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), ". "), F.lit("."))


def _list(prefix: str, words: Column, most: int) -> Column:
    return F.when(F.size(words) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(words, 1, most), ", ")))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def _name(c: Column, names: dict[str, str], missing: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c), F.nullif(c, F.lit("")), F.lit(missing))


def explain_zones(zones: DataFrame) -> DataFrame:
    """F-34: zone_label, summary, brief, context_line, next_step."""
    zone = F.coalesce("zone_label", F.lit("Sin zona"))
    capture, confidence, liquidity, prediction = _n("zone_capture_score"), _n("zone_confidence_score"), _n("zone_liquidity_score"), _n("predicted_absorption_score")
    moves = F.greatest(_n("zone_relative_heat_score"), _n("zone_heat_score"))
    phase = chain((confidence < 40, "lectura todavia fragil"), (capture >= 65, "zona bastante accionable"), (capture >= 50, "zona interesante para seguimiento"), other="zona en observacion")
    good = phrases(
        *steps(capture, (65, "buena opcion para captar"), (50, "senal suficiente para seguirla")), *steps(moves, (65, "mercado con movimiento fuerte"), (45, "movimiento de mercado razonable")),
        (liquidity >= 60, "salida de producto sana"), (liquidity < 35, "salida de producto floja"), *steps(_n("zone_transformation_signal_score"), (65, "transformacion urbana clara"), (45, "cambios urbanos en marcha")),
    )
    bad = phrases((confidence < 40, "todavia falta confianza en el dato"), ((_n("zone_pressure_score") >= 65) & (liquidity < 45), "hay presion alta sin liquidez equivalente"), (F.lower(zone) == "sin zona", "falta una zona oficial fiable"))
    context = F.array_compact(F.array(
        F.when(_n("population") > 0, F.concat(F.lit("poblacion "), F.regexp_replace(F.format_number(F.col("population"), 0), ",", "."))), F.when(_n("events_per_10k") > 0, F.concat(_one(_n("events_per_10k")), F.lit(" eventos por 10k hab"))),
    ))
    action = F.coalesce("recommended_action", F.lit("Seguir y vigilar"))
    then = chain(
        (prediction >= 65, F.concat(F.lit("Conviene entrar en la siguiente ventana de "), F.coalesce("predicted_action_window_days", F.lit(14)).cast("string"), F.lit(" dias."))),
        (prediction >= 50, F.lit("Merece seguimiento activo durante las proximas 2 semanas.")), other=F.lit("Mejor observar y esperar mas senal."),
    )
    z = zones.withColumns({"_good": good, "_bad": bad, "_phase": phase})
    g = F.col("_good")
    return z.select(
        zone.alias("zone_label"), sentence(F.concat(zone, F.lit(": "), F.col("_phase")), _list("Destaca por ", g, 3), _list("Ojo: ", F.col("_bad"), 2)).alias("summary"),
        F.concat(_capital(F.coalesce(F.get(g, 0), F.col("_phase"))), F.lit(".")).alias("brief"), F.when(F.size(context) > 0, F.array_join(context, " | ")).otherwise("Sin contexto oficial suficiente.").alias("context_line"),
        F.when(confidence < 40, "Validar primero direcciones y cobertura geo antes de tomar decisiones.").otherwise(F.concat(action, F.lit(". "), then)).alias("next_step"),
    )


def explain_opportunities(queue: DataFrame) -> DataFrame:
    """F-34: event_id, summary, brief, next_step, score_story."""
    event, zone, priority = _name(F.col("event_type"), EVENT_NAMES, "senal"), F.coalesce("zone_label", F.lit("Sin zona")), F.coalesce("priority_label", F.lit("seguimiento"))
    geo, days = _n("score_geo_signal"), F.coalesce(F.col("predicted_action_window_days") if "predicted_action_window_days" in queue.columns else F.lit(None).cast("int"), F.lit(30)).cast("string")
    why = phrases(
        (_n("score_price_signal") >= 8, "la bajada de precio pesa de verdad"), (_n("score_zone_signal") >= 8, "la zona acompana"), (_n("score_microzone_signal") >= 5, "la microzona suma"), (geo >= 10, "la geo es precisa"), (geo <= 3, "la geo es todavia floja"),
        (_n("predicted_opportunity_score") >= 56, "la ventana 30d es favorable"),
    )
    but = phrases((_n("zone_confidence_score") < 40, "la lectura de zona aun es fragil"), (~F.coalesce("has_geo_point", F.lit(False)), "falta coordenada exacta"))
    step = chain(
        (priority == "alta", F.concat(F.lit("Priorizar validacion y accion en los proximos "), days, F.lit(" dias."))),
        (F.col("predicted_opportunity_band").isin("alta", "media", "moderada"), F.concat(F.lit("Revisar este caso en los proximos "), days, F.lit(" dias."))), other=F.lit("Mantener en seguimiento hasta que aparezca mas senal."),
    )
    two = lambda a, x, b, y: F.concat(F.lit(a), _one(_n(x)), F.lit(b), _one(_n(y)))
    return queue.select(
        "event_id", sentence(F.concat(_capital(event), F.lit(" en "), zone), F.concat(F.lit("Prioridad "), priority), _list("Sube porque ", why, 3), _list("Ojo: ", but, 2)).alias("summary"),
        F.concat(_capital(event), F.lit(" con prioridad "), priority, F.lit(".")).alias("brief"), step.alias("next_step"),
        sentence(two("Evento ", "score_event_base", " + recencia ", "score_recency"), two("Zona ", "score_zone_signal", " + microzona ", "score_microzone_signal"), two("Geo ", "score_geo_signal", " + prediccion ", "score_predictive_signal")).alias("score_story"),
    )


def explain_cases(links: DataFrame) -> DataFrame:
    """F-34: flow_item_id, summary, brief, next_step of flow cases with reason, address_precision, band, phone_profile and price_confidence."""
    c = F.col
    reason = _name(c("reason"), REASON_NAMES, "caso sin clasificar")
    clues = F.concat(F.array(reason), phrases(
        (c("address_precision") == "zone_like", "la direccion apunta mas a zona que a inmueble"), (F.coalesce("address_precision", F.lit("unknown")) == "unknown", "la direccion llega pobre"),
        (c("phone_profile") == "broker_like", "el telefono aparece en muchos anuncios"), (c("phone_profile") == "owner_like", "el telefono parece bastante especifico"),
        (c("price_confidence") == "high", "el precio es util para contrastar"), (c("price_confidence") == "low", "el precio ayuda poco"),
    ))
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair]), F.coalesce("match_status", F.lit("pending"))), F.lit("Caso sin resolver"))
    step = chain((c("match_status") == "resolved", CASE_STEPS["resolved"]), (c("match_status") == "ambiguous", CASE_STEPS["ambiguous"]), (c("reason").isin("weak_identity", "zone_only_address", "repeated_phone_conflict"), CASE_STEPS["weak"]), (c("reason") == "not_in_csv_yet", CASE_STEPS["new"]), other=CASE_STEPS["other"])
    return links.select("flow_item_id", sentence(state, F.concat(F.lit("Banda "), F.coalesce("band", F.lit("low"))), F.concat(F.lit("La lectura actual sugiere que "), F.array_join(F.slice(clues, 1, 3), ", "))).alias("summary"), F.concat(_capital(reason), F.lit(".")).alias("brief"), step.alias("next_step"))
