"""Scene catalogue scans. ``scenes`` is any DataFrame with the columns of ``schemas.SCENES``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import bbox_intersects
from ..operators.filters import check_bbox

# Catalogue defaults.
DEFAULT_MAX_CLOUD = 20
OPTICAL, RADAR, HISTORICAL = "optical", "radar", "historical"


def _window(bbox, start: str | None, end: str | None) -> Column:
    """Footprint overlap and inclusive whole-day range, as predicates a Parquet scan can push down."""
    cond = F.lit(True)
    if bbox is not None:
        cols = tuple(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
        cond = bbox_intersects(cols, check_bbox(bbox))
    if start is not None:
        cond = cond & (F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return cond


def search_optical(scenes: DataFrame, bbox=None, start=None, end=None, max_cloud=None,
                   collection: str = OPTICAL, max_items: int | None = None) -> DataFrame:
    """Scenes of a collection that overlap ``bbox``, in the day range, strictly below the cloud limit (0 means default)."""
    out = scenes.filter(
        (F.col("collection") == collection)
        & _window(bbox, start, end)
        & (F.col("cloud_cover") < float(max_cloud or DEFAULT_MAX_CLOUD))
    )
    return out if max_items is None else out.orderBy(F.col("ts").desc_nulls_last(), "scene_id").limit(max_items)


def search_radar(scenes: DataFrame, bbox=None, start=None, end=None, collection: str = RADAR) -> DataFrame:
    """Descending-orbit scenes, whatever the cloud cover."""
    return scenes.filter(
        (F.col("collection") == collection) & _window(bbox, start, end) & (F.col("orbit_state") == "descending")
    )


def search_historical(scenes: DataFrame, bbox=None, start=None, end=None, max_cloud=None) -> DataFrame:
    return search_optical(scenes, bbox, start, end, max_cloud, collection=HISTORICAL)


def _newest_first(area: list[str]):
    return W.partitionBy(*area).orderBy(F.col("ts").desc_nulls_last(), F.col("scene_id"))


def newest_scenes(scenes: DataFrame, area: list[str], n: int = 2) -> DataFrame:
    """The ``n`` newest scenes of each area, null times last. The window rank limit keeps at most
    ``n`` rows per area on the map side, so a busy area is cut down before the shuffle."""
    return scenes.withColumn("rank", F.row_number().over(_newest_first(area))).filter(F.col("rank") <= n)


def latest_pair(scenes: DataFrame, area: list[str], single: bool = False) -> DataFrame:
    """Newest scene (t1) and the one before it (t0) per area; areas with a single scene yield no pair, or half of one with ``single``."""
    two = newest_scenes(scenes, area, 2)
    pairs = (
        two.groupBy(*area)
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("scene_id"))).alias("scene_t1"),
            F.max(F.when(F.col("rank") == 2, F.col("scene_id"))).alias("scene_t0"),
            F.max(F.when(F.col("rank") == 1, F.col("ts"))).alias("ts_t1"),
            F.max(F.when(F.col("rank") == 2, F.col("ts"))).alias("ts_t0"),
        )
    )
    return pairs if single else pairs.filter(F.col("scene_t0").isNotNull())


def enough_revisits(scenes: DataFrame, area: list[str], minimum: int = 3) -> DataFrame:
    """Areas with at least ``minimum`` scenes, and how many they have."""
    return scenes.groupBy(*area).agg(F.count("*").alias("n_scenes")).filter(F.col("n_scenes") >= minimum)


def require_revisits(scenes: DataFrame, minimum: int = 3) -> None:
    """Raise when a single-area selection has fewer than ``minimum`` scenes."""
    found = len(scenes.select("scene_id").take(minimum))
    if found < minimum:
        raise ValueError(f"Insufficient scenes: {found} < {minimum}")


def chronological(scenes: DataFrame) -> DataFrame:
    """Oldest first, scenes without a time before all others."""
    return scenes.orderBy(F.col("ts").asc_nulls_first(), "scene_id")
