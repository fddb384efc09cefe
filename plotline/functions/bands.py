"""Labels from scores and counts (F-29, F-33)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chain(*rules: tuple[Column, str | float | int], other=None) -> Column:
    """The value of the first rule that holds."""
    first, *rest = rules
    out = F.when(*first)
    for r in rest:
        out = out.when(*r)
    return out.otherwise(other)


def phone_profile(listings: Column, assets: Column, portals: Column) -> Column:
    """F-29: owner_like, broker_like or unknown, from how much one phone sells."""
    return chain(((listings == 1) & (assets <= 1) & (portals <= 1), "owner_like"), ((listings >= 4) | (assets >= 3) | (portals >= 3), "broker_like"), other="unknown")


def match_band(status: Column, score: Column) -> Column:
    """F-29: how far a match can be relied on."""
    return chain((status != "resolved", F.when(score >= 55, "dudoso").otherwise("sin_match")), (score >= 90, "alto"), (score >= 75, "medio"), other="bajo")


def prediction_band(score: Column) -> Column:
    return chain((score >= 72, "alta"), (score >= 56, "media"), (score >= 40, "moderada"), other="baja")


def action_window_days(score: Column) -> Column:
    return chain((score >= 72, 7), (score >= 56, 14), other=30)


def zone_action_v1(opportunity: Column, saturation: Column, activity: Column) -> Column:
    return chain(
        ((opportunity >= 70) & (saturation <= 60), "Atacar ya"), ((saturation >= 75) & (activity <= 40), "Zona quemada"),
        ((activity >= 60) & (saturation < 75), "Vigilar"), ((activity < 25) & (saturation < 40), "Baja prioridad"), other="Seguir observando",
    )


def zone_action_v2(capture: Column, pressure: Column, liquidity: Column, confidence: Column) -> Column:
    return chain(
        (confidence < 40, "Poca senal / baja confianza"), ((capture >= 75) & (pressure >= 55), "Captacion agresiva"), (capture >= 60, "Captacion selectiva"),
        ((pressure >= 70) & (liquidity >= 50), "Negociacion mas que captacion"), ((pressure >= 75) & (liquidity < 40), "Zona saturada"),
        ((capture >= 45) | (liquidity >= 50), "Seguir y vigilar"), other="Baja prioridad",
    )


def microzone_action(score: Column, concentration: Column, confidence: Column) -> Column:
    return chain(
        (confidence < 40, "Validar antes de actuar"), ((score >= 70) & (concentration >= 60), "Ir al punto caliente"),
        (score >= 58, "Microzona prioritaria"), (score >= 45, "Seguir de cerca"), other="Baja prioridad",
    )


def priority_label(score: Column) -> Column:
    return chain((score >= 62, "alta"), (score >= 50, "media"), other="seguimiento")


def freshness_score(days: Column) -> Column:
    return chain((days.isNull(), 0.15), (days <= 3, 1.0), (days <= 7, 0.8), (days <= 14, 0.6), (days <= 30, 0.35), other=0.15)
