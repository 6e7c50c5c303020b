"""Exports, report and evidence tables, map and chip writers, site append and alert payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..operators import filters, relations, summaries
from ..schemas import THREAT_LEVELS

FORMATS = ("geojson", "csv", "pdf")
# Column titles of the CSV export and colours of alert messages.
CSV_TITLES = ("ID", "Area (m²)", "Tonnage (t)", "Confidence", "Risk Score", "Threat Level", "Centroid (lat,lon)", "Detection Date", "Waste Type")
CRITICAL_COLOUR, HIGH_COLOUR = 0xFF0000, 0xFFA500
SITES_PER_MESSAGE = 5


def geojson_lines(sites: DataFrame) -> DataFrame:
    """One GeoJSON feature per row as text."""
    record = filters.site_record(sites.select("*")).columns
    props = F.struct(
        *[F.col(c) for c in ("area_m2", "confidence", "risk_score", "threat_level", "estimated_tonnage")],
        F.array("centroid.lon", "centroid.lat").alias("centroid"),
        F.date_format("detection_date", "yyyy-MM-dd").alias("detection_date"),
        *[F.col(c) for c in record if c in sites.columns and c in ("sensor", "waste_type", "ndvi_before", "ndvi_after", "delta_ndvi",
                                                                   "swir_mean", "distance_to_water_km", "distance_to_protected_km")],
        F.col("site_id").alias("id"),
    )
    return sites.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("geometry"), props.alias("properties"))).alias("value"))


def export_metadata(sites: DataFrame, min_confidence: float, bbox=None, date_range=None, generated: str | None = None) -> DataFrame:
    """One row: when (a parameter), the filters and the number of features."""
    nothing = F.lit(None).cast("string")
    return sites.agg(F.count("*").alias("total_features")).select(
        F.lit(generated).cast("string").alias("generated"), F.lit(float(min_confidence)).alias("confidence_threshold"),
        F.to_json(F.array(*[F.lit(float(v)) for v in bbox])).alias("bbox") if bbox else nothing.alias("bbox"),
        F.to_json(F.array(*[F.lit(v) for v in date_range])).alias("date_range") if date_range else nothing.alias("date_range"),
        "total_features")


def write_geojson(sites: DataFrame, path: str, min_confidence: float = 0.0, bbox=None, date_range=None, generated: str | None = None) -> None:
    """Newline-delimited features in ``path``/features, written by all tasks, and ``path``/metadata."""
    kept = filters.for_export(sites, min_confidence, bbox, date_range)
    geojson_lines(kept).write.text(path + "/features")
    export_metadata(kept, min_confidence, bbox, date_range, generated).write.json(path + "/metadata")


def csv_rows(sites: DataFrame) -> DataFrame:
    c = F.col
    return sites.select(
        c("site_id").alias("id"), "area_m2", "estimated_tonnage", "confidence", "risk_score", "threat_level",
        F.concat_ws(", ", c("centroid.lat").cast("string"), c("centroid.lon").cast("string")).alias("centroid"),
        F.date_format("detection_date", "yyyy-MM-dd").alias("detection_date"), F.coalesce("waste_type", F.lit("unknown")).alias("waste_type"))


def write_csv(sites: DataFrame, path: str, min_confidence: float = 0.0, bbox=None, date_range=None) -> None:
    rows = csv_rows(filters.for_export(sites, min_confidence, bbox, date_range))
    rows.toDF(*CSV_TITLES).write.option("header", True).csv(path)


def report_rows(sites: DataFrame) -> DataFrame:
    """Detail lines of a report, formatted as text."""
    c = F.col
    return sites.select(
        "site_id", formats.fixed(c("area_m2"), 0, grouped=True).alias("area"), formats.fixed(c("estimated_tonnage"), 1).alias("tonnage"),
        formats.percent(c("confidence")).alias("confidence"), F.concat(c("risk_score").cast("string"), F.lit("/100")).alias("risk"),
        c("threat_level").alias("threat"), formats.lat_lon(c("centroid.lat"), c("centroid.lon")).alias("centroid"),
        F.date_format("detection_date", "yyyy-MM-dd").alias("date"))


def report_summary(sites: DataFrame) -> DataFrame:
    """Totals and the threat counts of a report, one row."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return sites.agg(
        F.count("*").alias("total_sites"), zero(F.sum("area_m2")).alias("total_area"), zero(F.sum("estimated_tonnage")).alias("total_tonnage"),
        zero(F.avg("confidence")).alias("avg_confidence"), *summaries.histogram("threat_level", THREAT_LEVELS))


def evidence_records(sites: DataFrame, run_date: str, hashed: list[str] | None = None) -> DataFrame:
    """Case record per site: id with the run date, formatted measures or N/A, scenes, geometry and a
    content hash over all columns, or the named ones, in alphabetical order."""
    c = F.col
    have = set(sites.columns)
    opt = lambda name, places: formats.or_na(c(name), places) if name in have else F.lit("N/A")
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit("N/A")) if name in have else F.lit("N/A")
    return sites.select(
        F.concat(F.lit("EVD-" + run_date.replace("-", "") + "-"), c("site_id")).alias("case_id"), "site_id", "threat_level",
        F.date_format("detection_date", "yyyy-MM-dd").alias("detection_date"),
        formats.fixed(c("centroid.lat"), 6).alias("lat"), formats.fixed(c("centroid.lon"), 6).alias("lng"),
        F.initcap("waste_type").alias("waste_type"), formats.fixed(c("area_m2"), 0, grouped=True).alias("area_m2"),
        formats.fixed(c("estimated_tonnage"), 1, grouped=True).alias("tonnage"), formats.fixed(c("confidence") * 100.0, 1).alias("confidence"),
        "risk_score", opt("delta_ndvi", 3).alias("delta_ndvi"), opt("swir_mean", 3).alias("swir_mean"),
        opt("distance_to_water_km", 2).alias("water_km"), opt("distance_to_protected_km", 2).alias("protected_km"),
        text("scene_t0").alias("scene_t0"), text("scene_t1").alias("scene_t1"),
        F.to_json("geometry").alias("geojson"), formats.content_hash({n: c(n) for n in hashed or sites.columns}).alias("report_hash"))


def site_rows_for_boxes(detections: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sectors to create, site rows with their sector) for detections that carry the requested ``bbox``."""
    fresh = relations.missing_sectors(detections, sectors)
    known = sectors.select(F.col("sector_id").cast("string"), "bbox").unionByName(fresh.select("sector_id", "bbox"))
    return fresh, detections.drop("sector_id").join(known, "bbox")


def append_sites(site_rows: DataFrame, path: str) -> None:
    """Append below ``sector_id=...`` folders, sorted by date so that date ranges prune row groups.

    The rebalance gathers a small sector in one file and splits a large one over several tasks.
    """
    rows = site_rows.hint("rebalance", "sector_id").sortWithinPartitions("sector_id", "detection_date")
    rows.write.mode("append").partitionBy("sector_id").parquet(path)


def write_maps(prob_cells: DataFrame, path: str, keys: list[str], threshold: float = 0.5) -> None:
    """Probability, confidence and mask of every cell, one folder per scene."""
    out = prob_cells.withColumn("mask", (F.col("p") > threshold).cast("tinyint"))
    out.hint("rebalance", *keys).write.partitionBy(keys[-1]).parquet(path)


def write_chips(chips: DataFrame, path: str, scene: str = "step") -> None:
    chips.hint("rebalance", scene).write.partitionBy(scene).parquet(path)


def message_fields(site: Column | None = None) -> list[Column]:
    c = F.col
    return [
        c("site_id").alias("site_id"), formats.fixed(c("area_m2"), 0, grouped=True).alias("area"),
        formats.fixed(c("estimated_tonnage"), 1, grouped=True).alias("tonnage"), formats.percent(c("confidence")).alias("confidence"),
        formats.lat_lon(c("centroid.lat"), c("centroid.lon")).alias("coordinates"), c("threat_level").alias("threat_level"),
        F.coalesce("waste_type", F.lit("unknown")).alias("waste_type"),
        F.when(c("threat_level") == "Critical", F.lit(CRITICAL_COLOUR)).otherwise(F.lit(HIGH_COLOUR)).alias("colour"),
    ]


def alert_payloads(sites: DataFrame, message: list[str], per_message: int = SITES_PER_MESSAGE) -> DataFrame:
    """One message per key: title with the number of severe sites and at most five of them.

    Counting and the per-key rank limit are separate passes, so no message ever gathers more than
    five sites, however many a key has.
    """
    hot = filters.severe(sites)
    total = hot.groupBy(*message).agg(F.count("*").alias("n_severe"))
    top = summaries.top_per_group(hot, message, [F.col("risk_score").desc(), F.col("site_id")], per_message)
    body = top.groupBy(*message).agg(F.sort_array(F.collect_list(F.struct("rank", *message_fields()))).alias("sites"))
    return total.join(body, message).withColumn(
        "title", F.concat(F.lit("Alert: "), F.col("n_severe").cast("string"), F.lit(" Critical/High Detections")))


def deliver(payloads: DataFrame, send) -> None:
    """Hand every payload row to ``send(dict)`` inside the tasks; transport is the caller's."""
    payloads.foreachPartition(lambda rows: [send(r.asDict(recursive=True)) for r in rows] and None)
