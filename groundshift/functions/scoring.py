"""Confidence, risk, threat, tonnage and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import THREAT_LEVELS
from .formats import rounded

# Weights, cut-offs and rate tables the results depend on.
AREA_WEIGHT, CONFIDENCE_WEIGHT, PROXIMITY_WEIGHT = 0.4, 0.3, 0.3
THREAT_CUTS = (("Critical", 75), ("High", 50), ("Moderate", 25))
DEFAULT_DENSITY = 0.15
DENSITY_T_PER_M2 = {"mixed": 0.15, "construction": 0.3, "hazardous": 0.1, "electronic": 0.05}
DEFAULT_CLEANUP = 25.0
CLEANUP_EUR_PER_M2 = {"mixed": 25.0, "construction": 15.0, "hazardous": 150.0, "electronic": 80.0}
DEFAULT_LEGAL = 1.0
LEGAL_MULTIPLIER = {"netherlands": 3.0, "germany": 2.5, "france": 2.0, "brazil": 1.5, "drc": 1.0}
ECOSYSTEM_EUR_PER_M2 = 50.0


def rate(key: Column, table: dict[str, float], default: float) -> Column:
    """Look up a constant rate table; unknown or null keys get the default.

    The tables are code constants of a handful of rows, so they travel in the plan as a map literal
    and the look-up is a projection, not a join.
    """
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(float(default)))


def detection_confidence(area_m2: Column) -> Column:
    return F.least(F.lit(0.6) + F.least(area_m2 / 100000.0, F.lit(0.3)), F.lit(0.95))


def risk_score(area_m2: Column, confidence: Column, water_km: Column) -> Column:
    """Weighted 0-100 score, rounded half-even to an integer."""
    score = (
        F.least(area_m2 / 500000.0, F.lit(1.0)) * AREA_WEIGHT
        + confidence * CONFIDENCE_WEIGHT
        + F.greatest(F.lit(1.0) - water_km / 10.0, F.lit(0.0)) * PROXIMITY_WEIGHT
    ) * 100.0
    return F.bround(score, 0).cast("int")


def threat_level(risk: Column) -> Column:
    """Level of the already rounded score."""
    out = F.lit("Low")
    for name, cut in reversed(THREAT_CUTS):
        out = F.when(risk >= cut, F.lit(name)).otherwise(out)
    return out


def threat_rank(level: Column) -> Column:
    """Ordinal of a level: Critical 4 .. Low 1, null otherwise."""
    n = len(THREAT_LEVELS)
    out = F.lit(None).cast("int")
    for i, name in enumerate(THREAT_LEVELS):
        out = F.when(level == name, F.lit(n - i)).otherwise(out)
    return out


def tonnage(area_m2: Column, waste_type: Column | None = None) -> Column:
    """Area times density, 2 dp; without a waste type the default density applies."""
    density = F.lit(DEFAULT_DENSITY) if waste_type is None else rate(waste_type, DENSITY_T_PER_M2, DEFAULT_DENSITY)
    return rounded(area_m2 * density, 2)


def impact(area_m2: Column, waste_type: Column, water_km: Column, protected_km: Column, jurisdiction: Column) -> dict[str, Column]:
    """Cleanup, liability and ecosystem cost of a site, with the factors they came from."""
    base = rate(waste_type, CLEANUP_EUR_PER_M2, DEFAULT_CLEANUP)
    water = F.greatest(F.lit(1.0), F.lit(2.0) - water_km)
    protected = F.greatest(F.lit(1.0), F.lit(1.5) - protected_km * 0.1)
    multiplier = rate(F.lower(jurisdiction), LEGAL_MULTIPLIER, DEFAULT_LEGAL)
    cleanup = area_m2 * base * water * protected
    legal = cleanup * multiplier
    env = area_m2 * ECOSYSTEM_EUR_PER_M2 * water
    return {
        "cleanup_cost_eur": rounded(cleanup, 2),
        "legal_liability_eur": rounded(legal, 2),
        "environmental_damage_eur_per_year": rounded(env, 2),
        "total_exposure_eur": rounded(cleanup + legal + env, 2),
        "base_cleanup_rate": base,
        "water_proximity_factor": water,
        "protected_area_factor": protected,
        "jurisdiction_multiplier": multiplier,
    }
