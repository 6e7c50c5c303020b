"""Citizen reports and inbound detections as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import validate


def accept_reports(reports: DataFrame) -> DataFrame:
    """Add id, [lng, lat] coordinates and the initial state. The id is derived from the report's time and key."""
    return reports.select(
        F.concat(F.lit("CIT-"), F.date_format("created_at", "yyyyMMddHHmmss"), F.lit("-"), F.col("report_key")).alias("report_id"),
        "reporter_id", F.array("longitude", "latitude").alias("coordinates"), "threat_level", "waste_type",
        F.lit("pending").alias("status"), F.lit(False).alias("verified"), "created_at")


def ingest_reports(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append accepted reports to a Parquet table, exactly once."""
    q = (accept_reports(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def report_counts(reports: DataFrame, width: str = "1 day", lateness: str | None = None) -> DataFrame:
    """Reports per status, threat and time window; with ``lateness`` usable on a stream."""
    if lateness:
        reports = reports.withWatermark("created_at", lateness)
    out = reports.groupBy(F.window("created_at", width).alias("w"), "status", "threat_level").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "status", "threat_level", "n")


def split_inbound(detections: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons) of an inbound detection batch or stream."""
    v = validate(detections, rules)
    return v.filter("is_valid").drop("is_valid", "rejected_for"), v.filter("not is_valid").drop("is_valid")
