"""Row predicates, parameter checks and the site record projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ALERT_SEVERITIES, ALERT_STATUSES, SEVERE_LEVELS, THREAT_LEVELS, WASTE_TYPES


def check_bbox(bbox) -> tuple[float, float, float, float]:
    if bbox is None or len(bbox) != 4:
        raise ValueError("bbox needs [min_lon, min_lat, max_lon, max_lat]")
    return tuple(float(v) for v in bbox)


def check_range(name: str, value: float, lo: float, hi: float) -> float:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value}")
    return value


def check_confidence(value: float) -> float:
    return check_range("confidence threshold", value, 0.3, 0.95)


def check_member(name: str, value: str, domain) -> str:
    if value not in domain:
        raise ValueError(f"{name} must be one of {domain}, got {value!r}")
    return value


def by_confidence(df: DataFrame, threshold: float) -> DataFrame:
    """Keep rows at or above the threshold."""
    return df.filter(F.col("confidence") >= threshold)


def severe(df: DataFrame) -> DataFrame:
    return df.filter(F.col("threat_level").isin(*SEVERE_LEVELS))


def owned_by(rows: DataFrame, jobs: DataFrame, user_id) -> DataFrame:
    """Rows whose job belongs to the user."""
    return rows.join(jobs.filter(F.col("user_id") == user_id).select("job_id"), "job_id", "left_semi")


def alerts_where(alerts: DataFrame, status: str | None = None, severity: str | None = None, job_id=None) -> DataFrame:
    """Optional equality tests on status, severity and job."""
    if status is not None:
        alerts = alerts.filter(F.col("status") == check_member("status", status, ALERT_STATUSES))
    if severity is not None:
        alerts = alerts.filter(F.col("severity") == check_member("severity", severity, ALERT_SEVERITIES))
    if job_id is not None:
        alerts = alerts.filter(F.col("job_id") == job_id)
    return alerts


def for_export(sites: DataFrame, min_confidence: float = 0.0, bbox=None, date_range=None) -> DataFrame:
    """Confidence, centroid-in-box and inclusive date range."""
    out = by_confidence(sites, min_confidence)
    if bbox is not None:
        x0, y0, x1, y1 = check_bbox(bbox)
        out = out.filter(F.col("centroid.lon").between(x0, x1) & F.col("centroid.lat").between(y0, y1))
    if date_range is not None:
        first, last = date_range
        out = out.filter(F.col("detection_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out


def large_enough(polygons: DataFrame, min_px: float = 10.0, min_vertices: int = 3, min_area_m2: float = 10000.0) -> DataFrame:
    """Contour area in pixels, distinct vertices and area in m², all inclusive."""
    return polygons.filter(
        (F.col("contour_px") >= min_px) & (F.col("n_vertices") >= min_vertices) & (F.col("area_m2") >= min_area_m2)
    )


def site_rules() -> dict[str, Column]:
    """Domain rules of a site row, by the reason reported when they fail."""
    return {
        "confidence": F.col("confidence").between(0.0, 1.0),
        "area_m2": F.col("area_m2") > 0.0,
        "threat_level": F.col("threat_level").isin(*THREAT_LEVELS),
        "waste_type": F.col("waste_type").isin(*WASTE_TYPES),
    }


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Tag every row with the rules it breaks (an unknown value breaks its rule); ``is_valid`` splits them."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("rejected_for", F.array_compact(F.array(*broken))).withColumn(
        "is_valid", F.size("rejected_for") == 0
    )


def stored_sites(sites: DataFrame, sectors: DataFrame, bbox, threshold: float) -> DataFrame:
    """Active sites above the threshold of the active sector whose box equals ``bbox`` exactly."""
    x0, y0, x1, y1 = check_bbox(bbox)
    b = F.col("bbox")
    sector = sectors.filter(
        (b["min_lon"] == x0) & (b["min_lat"] == y0) & (b["max_lon"] == x1) & (b["max_lat"] == y1) & F.col("is_active")
    ).select("sector_id")
    return by_confidence(sites.filter("is_active"), threshold).join(sector, "sector_id", "left_semi")


def site_record(sites: DataFrame) -> DataFrame:
    """Flat property record of a site with the date as ISO text."""
    plain = ["area_m2", "confidence", "risk_score", "threat_level", "estimated_tonnage"]
    optional = ["sensor", "waste_type", "ndvi_before", "ndvi_after", "delta_ndvi", "swir_mean",
                "distance_to_water_km", "distance_to_protected_km"]
    return sites.select(
        F.col("site_id").alias("id"), *plain,
        F.col("centroid.lon").alias("lon"), F.col("centroid.lat").alias("lat"),
        F.date_format("detection_date", "yyyy-MM-dd").alias("detection_date"),
        *[c for c in optional if c in sites.columns],
    )


def by_confidence_desc(df: DataFrame, id_col: str = "site_id") -> DataFrame:
    """Most confident first, missing as 0; the id makes the order total."""
    return df.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), F.col(id_col))
