"""What an address, a price, an event or a key text means (F-25 to F-28)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions.bands import chain
from plotline.functions.text import let, normalize_text, text_key

#: Words that tell a street, and names of event types in page addresses.
STREET_HINTS = ["calle", "cl", "avenida", "av", "paseo", "ps", "plaza", "pl", "carretera", "camino", "via", "ronda", "travesia"]
EVENT_NAMES = {"new": "listing_detected", "listingdetected": "listing_detected", "pricedrop": "price_drop", "decrease": "price_drop", "priceraise": "price_raise", "increase": "price_raise", "reserved": "reserved", "notavailable": "not_available", "sold": "sold", "expired": "expired"}
#: Fixed value: words of a price.
PRICE_WORDS = "precio|price|venta|sale|bajada|subida"
GENERIC_CONTACTS = ["anuncio particular", "particular", "profesional", "inmobiliaria", "agencia", "anunciante", "propietario"]


def address_semantics(c: Column) -> Column:
    """F-27: struct(address_precision, zone_like_label)."""

    def of(t: Column, k: Column) -> Column:
        spaced = F.concat(F.lit(" "), k, F.lit(" "))
        words = F.size(F.split(t, " "))
        number = k.rlike(r"\b[0-9]+[a-z]?\b")
        street = spaced.rlike(f" ({'|'.join(STREET_HINTS)}) ")
        zone = k.contains("barrio") | k.contains("district") | spaced.contains(" distrito ") | (~number & t.contains("-") & (words <= 6))
        precision = chain((t.isNull(), "unknown"), (zone, "zone_like"), (street & number, "precise"), (street | (words >= 3), "partial"), other="zone_like")
        named = F.when(zone & t.contains("-"), F.trim(F.substring_index(t, "-", 1))).otherwise(t)
        return let(precision, lambda x: F.struct(x.alias("address_precision"), F.when(x == "zone_like", named).alias("zone_like_label")))

    return let(normalize_text(c), lambda t: let(text_key(t), lambda k: of(t, k)))


def price_semantics(current: Column, previous: Column, text: Column) -> Column:
    """F-28: struct(price_confidence, price_source)."""
    t = F.coalesce(normalize_text(text), F.lit(""))
    k = F.coalesce(text_key(text), F.lit(""))
    euro = t.contains("€") | F.concat(F.lit(" "), k, F.lit(" ")).contains(" eur ")
    named = k.rlike(PRICE_WORDS)
    source = chain((current.isNull(), "none"), (euro, "eur_text"), (named, "contextual_fallback"), other="structured_or_weak_fallback")
    confidence = chain((current.isNull(), "none"), ((current < 30000) | (current > 50000000), "low"), (euro, "high"), (named & previous.isNotNull(), "high"), (named, "medium"), other="low")
    return F.struct(confidence.alias("price_confidence"), source.alias("price_source"))


def event_type_of_url(c: Column) -> Column:
    """F-26: the event type that a page address asks for."""
    value = F.regexp_extract(F.coalesce(c, F.lit("")), r"[?&](?:historyType|history_type|type)=([^&#]*)", 1)
    key = F.regexp_replace(F.coalesce(text_key(value), F.lit("")), "[-_]", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair]), key)


#: Words of a flow text and the event type that they tell, in this order.
EVENT_WORDS = [("bajada de precio", "price_drop"), ("subida de precio", "price_raise"), ("reservado", "reserved"), ("no disponible", "not_available"), ("vendido", "sold"), ("vencido", "expired"), ("nuevo", "listing_detected")]


def infer_event_type(text: Column) -> Column:
    """F-26: the event type that Spanish words of a text tell (Q16)."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: chain(*[(t.contains(w), kind) for w, kind in EVENT_WORDS], other="history_item"))


def source_uid(*parts: Column) -> Column:
    """F-25: a stable key of what tells a record."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def price_key(c: Column) -> Column:
    return F.coalesce(F.floor(c).cast("string"), F.lit("na"))  # a number of euros is whole


def is_generic_contact(c: Column) -> Column:
    return F.coalesce(text_key(c), F.lit("")).isin(GENERIC_CONTACTS)
