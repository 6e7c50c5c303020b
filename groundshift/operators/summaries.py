"""Roll-ups of sites, observations and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formats import rounded
from ..functions.scoring import threat_rank
from ..schemas import SEVERE_LEVELS, THREAT_LEVELS

ACTIVE_AREA_M2 = 1000.0
# Waste types the stored summaries count.
SUMMARY_WASTE_TYPES = ("mixed", "construction", "hazardous", "electronic")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def settled(total: Column, places: int) -> Column:
    """Round a floating sum; the first rounding removes the noise of summation order, so that a
    decimal tie falls the same way whatever the partitioning."""
    return rounded(F.round(total, 6), places)


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def histogram(col: str, levels) -> list[Column]:
    """One count per level, zero when absent."""
    return [_count_if(F.col(col) == v).alias("n_" + v.lower()) for v in levels]


def _totals() -> list[Column]:
    return [
        F.count("*").alias("total_sites"),
        settled(_zero(F.sum("area_m2")), 2).alias("total_area_m2"),
        settled(_zero(F.sum("estimated_tonnage")), 2).alias("total_tonnage"),
        settled(_zero(F.avg("confidence")), 3).alias("avg_confidence"),
    ]


def summary(sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, area, tonnage and mean confidence; all zero for empty input."""
    return sites.groupBy(*(by or [])).agg(*_totals())


def threat_histogram(sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sites.groupBy(*(by or [])).agg(*histogram("threat_level", THREAT_LEVELS))


def sector_summary(sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, threat and waste-type histograms and mean risk in one pass."""
    return sites.groupBy(*(by or [])).agg(
        *_totals(),
        *histogram("threat_level", THREAT_LEVELS),
        *histogram("waste_type", SUMMARY_WASTE_TYPES),
        settled(_zero(F.avg("risk_score")), 1).alias("avg_risk_score"),
    )


def share_by(sites: DataFrame, key: str = "threat_level") -> DataFrame:
    """Count, whole-number area and percentage of all rows per key.

    The window runs over the handful of aggregated key rows only.
    """
    per = sites.groupBy(key).agg(F.count("*").alias("n_sites"), F.round(F.round(F.sum("area_m2"), 6), 0).cast("long").alias("area_m2"))
    total = F.sum("n_sites").over(W.partitionBy(F.lit(1)))
    return per.withColumn("share_pct", F.round(F.col("n_sites") * 100.0 / total, 1))


def sensor_results(spark: SparkSession, requested: list[str], detections: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per requested sensor: detections, scene pair or scene count, and the error when fewer than two scenes exist.

    ``scenes`` carries ``source_sensor``; both tables are reduced per sensor before they meet the request list.
    """
    names = {"sentinel2": "Sentinel-2", "sentinel1": "SAR", "landsat": "Landsat"}
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in requested])).alias("source_sensor"))
    found = detections.groupBy("source_sensor").agg(F.count("*").alias("n"))
    # the rank limit keeps two rows of each sensor on the map side
    order = W.partitionBy("source_sensor").orderBy(F.col("ts").desc(), F.col("scene_id").desc())
    two = scenes.select("source_sensor", "ts", "scene_id").withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    two = two.groupBy("source_sensor").agg(F.max(F.when(F.col("rank") == 1, F.col("scene_id"))).alias("scene_t1"),
                                           F.max(F.when(F.col("rank") == 2, F.col("scene_id"))).alias("scene_t0"))
    have = scenes.groupBy("source_sensor").agg(F.count("*").alias("scenes")).join(two, "source_sensor")
    out = wanted.join(have, "source_sensor", "left").join(found, "source_sensor", "left")
    enough = F.coalesce(F.col("scenes"), F.lit(0)) >= 2
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("source_sensor")]
    return out.select(
        "source_sensor",
        F.when(enough, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("count"),
        F.coalesce("scenes", F.lit(0)).cast("long").alias("scenes_processed"),
        F.when(enough, F.col("scene_t0")).alias("scene_t0"), F.when(enough, F.col("scene_t1")).alias("scene_t1"),
        F.when(~enough, F.concat(F.lit("Insufficient "), label, F.lit(" scenes"))).alias("error"),
    )


def series_rollup(obs: DataFrame, by: list[str]) -> DataFrame:
    """Total area (1 dp) and number of observations above 1000 m² per key."""
    return obs.groupBy(*by).agg(
        settled(F.sum("area_m2"), 1).alias("total_area_m2"),
        _count_if(F.col("area_m2") > ACTIVE_AREA_M2).alias("num_active_sites"),
    )


def worst_level() -> Column:
    """Most severe level of a group by rank, not by spelling."""
    return F.max_by("threat_level", threat_rank(F.col("threat_level")))


def alert_rollup(new_sites: DataFrame, run: list[str]) -> DataFrame:
    """One alert row per run with at least one new site."""
    hot = F.max(F.when(F.col("threat_level").isin(*SEVERE_LEVELS), 1).otherwise(0)) == 1
    return new_sites.groupBy(*run).agg(
        F.count("*").alias("sites_count"),
        settled(F.sum("area_m2"), 2).alias("total_area_m2"),
        worst_level().alias("max_threat_level"),
        F.when(hot, F.lit("critical")).otherwise(F.lit("low")).alias("severity"),
    )


def unique_observations(obs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in ``order``. Written as a min-by aggregate, so duplicates of a hot key
    collapse on the map side instead of being sorted in one task."""
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def site_growth(obs: DataFrame, by: list[str]) -> DataFrame:
    """Onset, latest area, growth per day, slope, peak and status of each site's series."""
    first, last = F.min_by("area_m2", "date"), F.max_by("area_m2", "date")
    days = F.datediff(F.max("date"), F.min("date"))
    day_no = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("double")
    out = obs.groupBy(*by).agg(
        F.min("date").alias("onset_date"),
        last.alias("total_area_m2"),
        F.coalesce((last - first) / F.when(days > 0, days), F.lit(0.0)).alias("growth_m2_per_day"),
        F.regr_slope("area_m2", day_no).alias("slope_m2_per_day"),
        F.max("area_m2").alias("peak_area_m2"),
        F.avg("confidence").alias("confidence"),
    )
    return out.withColumn("current_status", F.when(F.col("total_area_m2") > ACTIVE_AREA_M2, "active").otherwise("inactive"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; the rank limit is applied before and after the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def newest_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    return alerts.orderBy(F.col("created_at").desc(), F.col("alert_id")).limit(limit)
