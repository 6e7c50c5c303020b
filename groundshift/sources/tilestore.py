"""Tile tables bucketed and sorted by tile address, over which bands and scenes are aligned without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import raster

BUCKETS = 256


def write_tiles(band_tiles: DataFrame, table: str, path: str, buckets: int = BUCKETS, order: str = "step") -> None:
    """Saves band tiles as ``table`` below ``path``, bucketed by (area, ty, tx) and sorted by address and ``order`` in each bucket.

    The rows are dealt by the bucket key first, so a bucket is one file. Choose the number of buckets for the size that the
    table will have: all tables that are to be joined in place need the same.
    """
    dealt = band_tiles.repartition(buckets, *raster.ADDRESS)
    dealt.write.mode("overwrite").bucketBy(buckets, *raster.ADDRESS).sortBy(*raster.ADDRESS, order).option("path", path).saveAsTable(table)


def scene_stack(spark: SparkSession, table: str, bands: dict[str, str], time: str = "step", extra: list[str] | None = None,
                scene: str | None = None) -> DataFrame:
    """Aligned tiles of all scenes of a stored table, still dealt by tile address."""
    return raster.align_bands(spark.table(table), bands, time, extra, scene=scene, placed=True)


def scene_pairs(spark: SparkSession, table: str, bands: dict[str, str], time: str = "step", extra: list[str] | None = None) -> DataFrame:
    """Each aligned tile beside the same tile of the scene before it."""
    return raster.previous_scene(scene_stack(spark, table, bands, time, extra), list(bands), time)


def join_stores(spark: SparkSession, left: str, right: str, bands: dict[str, str], time: str = "step", extra: list[str] | None = None) -> DataFrame:
    """Tiles of two stored tables, each with one scene of a place, by address: ``<band>`` of the left and ``<band>_t0`` of the right one."""
    return raster.pair_scenes(scene_stack(spark, right, bands, time, extra).drop(time, *(extra or [])), scene_stack(spark, left, bands, time, extra), list(bands))
