"""Feature-collection files: sites, per-site series and the sector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import rounded
from ..schemas import SECTOR_FILE

# Defaults of absent feature properties.
DEFAULT_WASTE_TYPE = "mixed"
DEFAULT_SENSOR = "Sentinel-2 L2A"


def read_sector_files(spark: SparkSession, path) -> DataFrame:
    """One row per sector file, typed by the declared schema (no inference pass)."""
    return spark.read.schema(SECTOR_FILE).option("multiLine", True).json(path)


def sites_from_sector_files(files: DataFrame) -> DataFrame:
    """One row per feature with flattened properties and defaults filled in."""
    f = files.select("metadata", F.explode("feature_collection.features").alias("f"))
    p = "f.properties."
    return f.select(
        F.col(p + "id").alias("site_id"),
        F.col("metadata.id").alias("sector_id"),
        F.col("f.geometry").alias("geometry"),
        F.struct(F.get(F.col(p + "centroid"), F.lit(0)).alias("lon"), F.get(F.col(p + "centroid"), F.lit(1)).alias("lat")).alias("centroid"),
        *[F.col(p + c) for c in ("area_m2", "estimated_tonnage", "confidence", "risk_score", "threat_level")],
        F.coalesce(F.col(p + "waste_type"), F.lit(DEFAULT_WASTE_TYPE)).alias("waste_type"),
        F.to_date(p + "detection_date").alias("detection_date"),
        F.coalesce(F.col(p + "sensor"), F.lit(DEFAULT_SENSOR)).alias("sensor"),
        *[F.col(p + c) for c in ("ndvi_before", "ndvi_after", "delta_ndvi", "swir_mean",
                                 "distance_to_water_km", "distance_to_protected_km")],
        F.col("metadata.scene_t0").alias("scene_t0"),
        F.col("metadata.scene_t1").alias("scene_t1"),
        F.lit(True).alias("is_active"),
    )


def sectors_from_sector_files(files: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return files.select(
        m["id"].alias("sector_id"), m["name"].alias("name"),
        F.struct(*[F.get(m["bbox"], F.lit(i)).alias(n) for i, n in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))]).alias("bbox"),
        F.struct(F.get(m["center"], F.lit(0)).alias("lon"), F.get(m["center"], F.lit(1)).alias("lat")).alias("center"),
        m["zoom"].alias("zoom"), F.lit(True).alias("is_active"),
    )


def series_from_sector_files(files: DataFrame) -> DataFrame:
    """Parallel per-site arrays turned into one row per site and date; no series, no rows."""
    sites = files.select(F.col("metadata.id").alias("sector_id"), F.explode("timeseries.sites").alias("site_id", "s"))
    rows = F.arrays_zip("s.dates", "s.area_m2", "s.confidence", "s.ndvi")
    return sites.select("sector_id", "site_id", F.inline(rows)).select(
        "sector_id", "site_id", F.to_date("dates").alias("date"), "area_m2", "confidence", "ndvi"
    )


def series_from_arrays(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Same for an already loaded table holding the arrays dates / area_m2 / confidence / ndvi per row."""
    return packed.select(*keys, F.inline(F.arrays_zip("dates", "area_m2", "confidence", "ndvi"))).withColumnRenamed("dates", "date")


def sector_index(sites: DataFrame, sectors: DataFrame) -> DataFrame:
    """Every sector with its number of sites and total area, zero where it has none.

    Sites are reduced per sector before the join, so a sector holding most of the sites costs one row.
    """
    per = sites.groupBy("sector_id").agg(F.count("*").alias("num_sites"), F.sum("area_m2").alias("total_area_m2"))
    return sectors.join(per, "sector_id", "left").withColumns({
        "num_sites": F.coalesce("num_sites", F.lit(0).cast("long")),
        "total_area_m2": rounded(F.round(F.coalesce("total_area_m2", F.lit(0.0)), 6), 2),
    })
