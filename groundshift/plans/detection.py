"""Detection jobs over one or many areas: catalogue -> bands -> mask -> polygons -> scored sites."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, indices, scoring
from ..functions.formats import rounded
from ..operators import components, filters, overlap, raster, scorer, stencils, summaries, tiling, timeseries, warp
from ..session import attach, stage
from ..sources import catalogue

# Sensor names written on detections.
SENSOR_LABEL = {"sentinel2": "Sentinel-2", "sentinel1": "Sentinel-1", "landsat": "Landsat"}
RADAR_METHOD = "SAR coherence + backscatter"
KEYS = ["area", "step"]


@dataclass(frozen=True)
class Layout:
    """How tiles lie on the ground: tile side and image size in cells, and the affine terms
    (a, b, c, d, e, f) from (column, row) to x = a*col + b*row + c, y = d*col + e*row + f, which are degrees,
    or metres with ``crs`` EPSG:3857. What is found is in degrees either way."""

    tile: int
    width: int
    height: int
    affine: tuple[float, float, float, float, float, float]
    crs: str = warp.DEGREES

    def __post_init__(self) -> None:
        if self.crs not in (warp.DEGREES, warp.MERCATOR):
            raise ValueError(f"cannot read {self.crs}")

    @property
    def grid(self) -> Column:
        return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("abcdef", self.affine)])

    def ring(self, pixels: Column) -> Column:
        """A ring of columns and rows in degrees."""
        ring = components.ring_to_world(pixels, self.grid)
        return geometry.lonlat_ring(ring) if self.crs == warp.MERCATOR else ring


@dataclass(frozen=True)
class Limits:
    """Detection parameters with the engine's defaults."""

    ndvi_delta: float = indices.NDVI_DELTA_MAX
    swir: float = indices.SWIR_MIN
    tolerance: float = 0.01
    min_px: float = 10.0
    min_area_m2: float = 10000.0
    confidence: float = 0.7
    min_persistence: int = 2
    step_change: float = indices.STEP_CHANGE


def vectorise(masks: DataFrame, layout: Layout, limits: Limits, keys: list[str] = KEYS) -> DataFrame:
    """Polygons of mask tiles with area, confidence, risk, threat and tonnage, small ones dropped."""
    cells = components.label_cells(masks, keys, layout.tile, layout.width)
    p = components.polygonise(cells, keys, limits.tolerance, limits.min_px)
    p = p.withColumn("ring", layout.ring(F.col("ring")))
    p = p.withColumn("area_m2", geometry.area_m2(F.col("ring")))
    p = filters.large_enough(p, limits.min_px, 3, limits.min_area_m2)
    conf = scoring.detection_confidence(F.col("area_m2"))
    p = p.withColumns({"confidence": conf, "risk_score": scoring.risk_score(F.col("area_m2"), conf, F.lit(1.0))})
    c = geometry.centroid(F.col("ring"))
    return p.select(
        *keys, "component", F.format_string("%s-%s-%s", *[F.col(k).cast("string") for k in keys], F.col("component").cast("string")).alias("site_id"),
        "n_cells", "contour_px", "n_vertices", "ring",
        F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"),
        F.struct(c[0].alias("lon"), c[1].alias("lat")).alias("centroid"),
        rounded(F.col("area_m2"), 2).alias("area_m2"), rounded(F.col("confidence"), 2).alias("confidence"), "risk_score",
        scoring.threat_level(F.col("risk_score")).alias("threat_level"), scoring.tonnage(F.col("area_m2")).alias("estimated_tonnage"),
    )


def tiles_of_pair(band_tiles: DataFrame, pairs: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Band tiles of the newest scene and the one before it, per area, aligned into ``<band>`` and ``<band>_t0``.

    The pair table holds one row per area and is attached by its measured size, so tiles of other
    scenes fall away before anything is shuffled.
    """
    wanted = pairs.select("area", F.explode(F.array(
        F.struct(F.col("scene_t0").alias("scene_id"), F.lit(0).alias("step")),
        F.struct(F.col("scene_t1").alias("scene_id"), F.lit(1).alias("step")))).alias("p")).select("area", "p.*")
    tiles = attach(band_tiles.drop("step"), wanted, ["area", "scene_id"], "inner", "pair")
    aligned = raster.align_bands(tiles, bands, extra=["scene_id", "h", "w"])
    return raster.previous_scene(aligned, list(bands))


def within(band_tiles: DataFrame, bbox, layout: Layout) -> DataFrame:
    """Tiles that touch the box. The address range is worked out here from the north-up grid, so the
    filter is plain comparisons on ty and tx, which a partitioned or sorted tile table prunes by."""
    x0, y0, x1, y1 = filters.check_bbox(bbox)
    if layout.crs == warp.MERCATOR:
        (x0, x1), (y0, y1) = (warp.forward(np.array(v), k) for k, v in enumerate(((x0, x1), (y0, y1))))
    a, b, c, d, e, f = layout.affine
    if b or d:
        raise ValueError("box clipping needs a north-up grid")
    cols, rows = sorted(((x0 - c) / a, (x1 - c) / a)), sorted(((y0 - f) / e, (y1 - f) / e))
    tx = [math.floor(v / layout.tile) for v in cols]
    ty = [math.floor(v / layout.tile) for v in rows]
    return band_tiles.filter(F.col("tx").between(*tx) & F.col("ty").between(*ty))


def _complete(found: DataFrame, band_tiles: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Scenes of a search that have all bands; a newest scene without one gives way to the scene before it."""
    whole = raster.complete_scenes(band_tiles, list(bands.values()), ["area", "scene_id"])
    return found.join(whole.select("area", "scene_id"), ["area", "scene_id"], "left_semi")


def complete_pairs(scenes: DataFrame, band_tiles: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Newest complete scene and the one before it per area; ``scene_t0`` is null where there is only one."""
    return catalogue.latest_pair(_complete(scenes, band_tiles, bands), ["area"], single=True)


def _named(found: DataFrame, scene: str) -> DataFrame:
    """Site ids from area, scene and component, so that runs over other dates do not share ids."""
    return found.withColumn("site_id", F.format_string("%s-%s-%s", F.col("area").cast("string"), F.col(scene).cast("string"), F.col("component").cast("string")))


def detect_changes(scenes: DataFrame, band_tiles: DataFrame, bands: dict[str, str], layout: Layout, limits: Limits = Limits(),
                   bbox=None, start=None, end=None, max_cloud=None) -> DataFrame:
    """Bitemporal detection between the two newest scenes of every area."""
    pairs = catalogue.latest_pair(_complete(catalogue.search_optical(scenes, bbox, start, end, max_cloud), band_tiles, bands), ["area"])
    return detect_pairs(pairs, band_tiles, bands, layout, limits, bbox)


def detect_pairs(pairs: DataFrame, band_tiles: DataFrame, bands: dict[str, str], layout: Layout, limits: Limits = Limits(), bbox=None) -> DataFrame:
    """Bitemporal detection of given scene pairs, one row (area, scene_t0, scene_t1, ts_t1) for an area."""
    if bbox is not None:
        band_tiles = within(band_tiles, bbox, layout)
    cells = raster.change_cells(tiles_of_pair(band_tiles, pairs, bands), layout.tile)
    cells = cells.withColumn("anomaly", indices.vegetation_to_bare(F.col("delta_ndvi"), F.col("swir"), limits.ndvi_delta, limits.swir))
    found = vectorise(raster.mask_tiles(cells, "anomaly", layout.tile), layout, limits)
    found = found.join(pairs.select("area", "scene_t0", "scene_t1", F.to_date("ts_t1").alias("detection_date")), "area")
    return filters.by_confidence(_named(found, "scene_t1"), limits.confidence)


def detect_radar(scenes: DataFrame, band_tiles: DataFrame, bands: dict[str, str], layout: Layout, limits: Limits = Limits(),
                 bbox=None, start=None, end=None) -> DataFrame:
    """Radar change between the two newest descending scenes: backscatter test, clean-up, polygons.

    The percentile of the test is that of whole scenes; a box clips the mask after it.
    """
    pairs = catalogue.latest_pair(_complete(catalogue.search_radar(scenes, bbox, start, end), band_tiles, bands), ["area"])
    wanted = pairs.select("area", F.explode(F.array(
        F.struct(F.col("scene_t0").alias("scene_id"), F.lit(0).alias("step")),
        F.struct(F.col("scene_t1").alias("scene_id"), F.lit(1).alias("step")))).alias("p")).select("area", "p.*")
    tiles = raster.align_bands(attach(band_tiles.drop("step"), wanted, ["area", "scene_id"], "inner", "pair"), bands, extra=["h", "w"])
    cells = raster.radar_change(tiles, layout.tile)
    masks = stencils.clean_mask(raster.mask_tiles(cells, "anomaly", layout.tile), KEYS, layout.tile)
    if bbox is not None:
        masks = within(masks, bbox, layout)
    found = vectorise(masks, layout, limits).withColumn("detection_method", F.lit(RADAR_METHOD))
    return _named(found.join(pairs.select("area", "scene_t0", "scene_t1", F.to_date("ts_t1").alias("detection_date")), "area"), "scene_t1")


def detect_over_time(scenes: DataFrame, band_tiles: DataFrame, bands: dict[str, str], layout: Layout, limits: Limits = Limits(),
                     bbox=None, start=None, end=None, max_cloud=30, min_revisits: int = 3, collection: str = catalogue.OPTICAL) -> DataFrame:
    """Detection over a whole stack: cells anomalous at the last step and often enough before.

    Areas with fewer than ``min_revisits`` scenes are left out. The stack ends with the newest scene whose tiles have all
    bands; its SWIR maximum is that of whole scenes, and a box clips what is found. Each site carries its stack's first
    and last time, the largest persistence, the mean progression and its own earliest onset.
    """
    found = catalogue.search_optical(scenes, bbox, start, end, max_cloud, collection)
    usable = catalogue.enough_revisits(found, ["area"], min_revisits)
    stack = found.join(usable.select("area"), "area", "left_semi").select("area", "scene_id", F.col("ts"))
    tiles = attach(band_tiles.drop("ts", "step"), stack, ["area", "scene_id"], "inner", "stack").withColumnRenamed("ts", "step")
    tiles = stage(raster.align_bands(tiles, bands, extra=["h", "w"], scene="scene_id"), "aligned")
    steps = timeseries.tile_differences(tiles, layout.tile, raster.stack_max(tiles, "swir", ["area"]))
    steps = timeseries.step_flags(steps, limits.step_change)
    history = timeseries.persistent_cells(timeseries.cell_history(steps), limits.min_persistence)
    last = tiles.groupBy("area").agg(F.max("step").alias("_end"), F.max_by("scene_id", "step").alias("scene_t1"))
    if bbox is not None:
        history = within(history, bbox, layout)
    history = attach(history, last.select("area", "_end"), ["area"], "inner", "end").withColumn("persistent", F.col("persistent") & (F.col("last_time") == F.col("_end")))
    history = stage(history.withColumnRenamed("last_time", "step").drop("_end"), "history")
    masks = raster.mask_tiles(history.withColumn("step", F.lit(0)), "persistent", layout.tile)
    sites = vectorise(masks, layout, limits)
    meta = timeseries.stack_metadata(tiles, timeseries.running_anomalies(steps), history)
    labelled = components.label_cells(masks, KEYS, layout.tile, layout.width)
    onset = labelled.join(history.select("area", "ty", "tx", "pos", "onset"), ["area", "ty", "tx", "pos"])
    onset = onset.groupBy("area", "component").agg(F.min("onset").alias("first_onset"))
    sites = sites.join(meta, "area").join(onset, ["area", "component"]).join(last.select("area", "scene_t1"), "area")
    return _named(sites, "scene_t1").withColumn("detection_date", F.to_date("last_time"))


def union_sensors(per_sensor: dict[str, DataFrame]) -> DataFrame:
    """Concatenate detections of several sensors, tagging each with its sensor."""
    tagged = [
        df.withColumn("source_sensor", F.lit(name)).withColumn("sensor", F.lit(SENSOR_LABEL[name]))
        for name, df in per_sensor.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_sensors(per_sensor: dict[str, DataFrame], confidence: float = 0.7, threshold: float = 0.5) -> DataFrame:
    """Union of the sensors' detections, confidence filter, then suppression of overlapping ones per area."""
    both = union_sensors(per_sensor)
    both = both.withColumn("site_id", F.concat_ws("-", "source_sensor", "site_id"))
    kept = stage(filters.by_confidence(both, confidence), "sensors")
    return overlap.suppress(kept, "site_id", ["area"], threshold, ring="ring")


def detect_multisensor(scenes: DataFrame, band_tiles: dict[str, DataFrame], bands: dict[str, dict[str, str]], layout: Layout,
                       limits: Limits = Limits(), bbox=None, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """(deduplicated detections, per-sensor result rows) of the sensors that have tiles.

    Each sensor is an independent plan; one without enough scenes contributes no rows and an error text.
    """
    runs = {}
    if "sentinel2" in band_tiles:
        runs["sentinel2"] = detect_changes(scenes, band_tiles["sentinel2"], bands["sentinel2"], layout, limits, bbox, start, end)
    if "sentinel1" in band_tiles:
        runs["sentinel1"] = detect_radar(scenes, band_tiles["sentinel1"], bands["sentinel1"], layout, limits, bbox, start, end)
    if "landsat" in band_tiles:
        runs["landsat"] = detect_over_time(scenes, band_tiles["landsat"], bands["landsat"], layout, limits, bbox, start, end,
                                           max_cloud=None, min_revisits=2, collection=catalogue.HISTORICAL)
    wanted = ["area", "site_id", "ring", "geometry", "centroid", "area_m2", "confidence", "risk_score", "threat_level", "estimated_tonnage", "detection_date"]
    runs = {k: stage(v.select(*[c for c in (*wanted, "detection_method") if c in v.columns]), k) for k, v in runs.items()}
    kept = merge_sensors(runs, limits.confidence)
    name = F.when(F.col("collection") == catalogue.OPTICAL, "sentinel2").when(F.col("collection") == catalogue.RADAR, "sentinel1").otherwise("landsat")
    searched = catalogue.search_optical(scenes, bbox, start, end).unionByName(catalogue.search_radar(scenes, bbox, start, end)).unionByName(
        catalogue.search_historical(scenes, bbox, start, end))
    results = summaries.sensor_results(kept.sparkSession, list(runs), union_sensors(runs), searched.withColumn("source_sensor", name))
    return kept, results


def lookup_sites(sites: DataFrame, sectors: DataFrame, bbox, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Stored answer for an exact sector box: (records, summary)."""
    found = filters.stored_sites(sites, sectors, bbox, threshold)
    return filters.site_record(found), summaries.summary(found)


def score_scene(tiles: DataFrame, layout: Layout, build=scorer.linear_scorer, size: int = tiling.TILE_SIZE, stride: int = tiling.STRIDE,
                threshold: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """Tiles with the probability ``p``, model confidence and ``mask`` of every cell, from overlapping model windows.

    ``tiles`` has the six channels of its cells in ``values`` (``raster.feature_tiles``). A window with missing cells is scored with
    zeros in their place; only cells that no window covers get probability 0. Arrays of pieces are shuffled twice, to windows
    and back to tiles; cells are not.
    """
    score = scorer.scoring([*keys, "y0", "x0"], build)
    out = tiling.overlap_scores(tiles, keys, layout.tile, layout.height, layout.width, 6, score, size, stride)
    return out.withColumn("mask", F.transform("p", lambda p: (p > threshold).cast("tinyint")))


def scored_cells(scored: DataFrame, layout: Layout, keys: list[str] = KEYS) -> DataFrame:
    """Cells of scored tiles, in the tile's own row order."""
    place = [c for c in keys if c not in ("area", "step")]
    return raster.cells(scored, ["p", "confidence", "mask"], layout.tile, carry=place)


def scored_polygons(scored: DataFrame, layout: Layout, min_px: float = 100.0, tolerance: float = 0.005, keys: list[str] = KEYS) -> DataFrame:
    """Polygons of scored tiles with approximate area and the mean confidence of their cells.

    The tiles are staged, since they are read twice, and a task that scores them has no second Python worker that labels them.
    """
    scored = stage(scored.select(*keys, "ty", "tx", "h", "w", "confidence", "mask"), "scored")
    cells = components.label_cells(scored.drop("confidence"), keys, layout.tile, layout.width)
    measures = raster.cells(scored, ["confidence"], layout.tile, carry=[c for c in keys if c not in ("area", "step")])
    conf = components.zonal_means(cells, measures, keys, ["confidence"])
    p = components.polygonise(cells, keys, tolerance, min_px).filter(F.col("n_vertices") >= 3)
    p = p.withColumn("ring", layout.ring(F.col("ring")))
    p = p.withColumn("area_m2", geometry.area_m2_approx(F.col("ring")))
    return p.join(conf.drop("n_cells"), [*keys, "component"])
