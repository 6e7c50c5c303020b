"""Catalogue scans, band alignment, map algebra and time-series queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from groundshift.functions import geometry, indices
from groundshift.operators import filters, raster, summaries, timeseries, warp
from groundshift.schemas import SECTOR_FILE
from groundshift.session import run_dir
from groundshift.sources import catalogue, features, labels, tilestore

from .fixtures import BANDS, SIDE, TILE
from .q_sites import DAY, SQL_STAMP, STAMP, YMD
from .registry import query, rnd

# ---- catalogue --------------------------------------------------------------------------------------

_BOX = (-30.0, -25.0, 25.0, 20.0)
_HIT = "min_lon <= 25.0 AND max_lon >= -30.0 AND min_lat <= 20.0 AND max_lat >= -25.0 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26'"
_SPAN = ("2024-01-05", "2024-01-25")


@query("src_01", f"SELECT scene_id, {SQL_STAMP.format('ts')} AS taken FROM scenes WHERE collection = 'optical' AND cloud_cover < 20 AND {_HIT}", ("scenes",))
def src_01(t):
    return catalogue.search_optical(t.scenes, _BOX, *_SPAN, max_cloud=0).select("scene_id", STAMP("ts").alias("taken"))


@query("src_02", f"SELECT scene_id FROM scenes WHERE collection = 'radar' AND orbit_state = 'descending' AND {_HIT}", ("scenes",))
def src_02(t):
    return catalogue.search_radar(t.scenes, _BOX, *_SPAN).select("scene_id")


@query("src_03", f"SELECT scene_id FROM scenes WHERE collection = 'historical' AND cloud_cover < 20 AND {_HIT}", ("scenes",))
def src_03(t):
    return catalogue.search_historical(t.scenes, _BOX, *_SPAN).select("scene_id")


@query("src_04", """
SELECT scene, count(DISTINCT band) AS n_bands FROM (SELECT vec_id // 3 AS scene, vec_id % 3 AS band FROM embeddings) GROUP BY scene HAVING count(DISTINCT band) = 3""")
def src_04(t):
    return raster.complete_scenes(t.band_tiles, list(BANDS.values()))


_OBS_TEXT = f"SELECT site_no, {YMD.format('date')} AS day, area_m2, confidence, ndvi FROM obs"


@query("src_06", _OBS_TEXT, ("obs",))
def src_06(t):
    """Series are written as sector files, one for each hundred sites and year, and scanned from there."""
    row = F.struct(F.date_format("date", "yyyy-MM-dd").alias("d"), "area_m2", "confidence", "ndvi")
    part = ["part", "year"]
    obs = t.obs.withColumns({"part": F.floor(F.col("site_no") / 100), "year": F.year("date")}).repartition(*part)  # serves both groupings
    packed = obs.groupBy(*part, "site_no").agg(F.sort_array(F.collect_list(row)).alias("s"))
    series = F.struct(F.col("s.d").alias("dates"), *[F.col(f"s.{c}").alias(c) for c in ("area_m2", "confidence", "ndvi")])
    sites = F.map_from_entries(F.collect_list(F.struct(F.col("site_no").cast("string").alias("key"), series.alias("value"))))
    files = packed.groupBy(*part).agg(sites.alias("sites")).select(
        F.struct(F.col("year").cast("string").alias("id")).alias("metadata"), F.struct("sites").alias("timeseries"))
    path = run_dir(t.spark, "series")
    files.write.json(path)
    rows = features.series_from_sector_files(t.spark.read.schema(SECTOR_FILE).json(path))
    return rows.select(F.col("site_id").cast(t.obs.schema["site_no"].dataType).alias("site_no"), "area_m2", "confidence", "ndvi", DAY("date").alias("day"))


_WAYS = """
SELECT way_id, count(*) AS n_points, CAST(1 AS INTEGER) AS label, string_agg(printf('%.3f', lon) || ' ' || printf('%.3f', lat), ';' ORDER BY pos) AS ring_text
FROM (SELECT l_orderkey AS way_id, l_linenumber AS pos, min(l_partkey) AS node_id FROM lineitem GROUP BY 1, 2)
JOIN (SELECT p_partkey AS node_id, 4.0::DOUBLE + (p_partkey % 1000)::DOUBLE/1000.0::DOUBLE AS lon, 51.0::DOUBLE + p_size::DOUBLE/1000.0::DOUBLE AS lat FROM part) USING (node_id)
GROUP BY way_id HAVING count(*) >= 4"""


def _ring_text(rings):
    from groundshift.functions.formats import fixed
    point = lambda p: F.concat_ws(" ", fixed(p[0], 3), fixed(p[1], 3))
    return rings.withColumn("ring_text", F.array_join(F.transform("ring", point), ";"))


@query("src_08", _WAYS.replace("SELECT way_id, count(*)", "SELECT 'OSM' AS source, way_id, count(*)"))
def src_08(t):
    ways = t.way_steps.groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("nodes"))
    return _ring_text(labels.way_rings(ways, t.nodes)).select("way_id", F.size("ring").cast("long").alias("n_points"), "label", "source", "ring_text")


@query("join_09", _WAYS)
def join_09(t):
    return _ring_text(labels.rings_from_steps(t.way_steps, t.nodes)).select("way_id", F.size("ring").cast("long").alias("n_points"), "label", "ring_text")


@query("src_09", "SELECT doc_id AS stem, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def src_09(t):
    images = t.raw("documents").select(F.col("doc_id").alias("stem"), "n_chars")
    return labels.pair_by_stem(images, t.raw("labels").select(F.col("doc_id").alias("stem"), "quality"))


@query("join_08", "SELECT lang, count(*) AS n_pairs, CAST(sum(quality) AS BIGINT) AS n_positive FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def join_08(t):
    pairs = labels.pair_by_stem(t.raw("documents").select("doc_id", "lang"), t.raw("labels"), "doc_id")
    return pairs.groupBy("lang").agg(F.count("*").alias("n_pairs"), F.sum("quality").alias("n_positive"))


@query("ts_12", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY ts DESC NULLS LAST, scene_id) AS rn FROM scenes WHERE collection = 'optical' AND cloud_cover < 20)
SELECT a.area, a.scene_id AS scene_t1, b.scene_id AS scene_t0, {SQL_STAMP.format('a.ts')} AS t1, {SQL_STAMP.format('b.ts')} AS t0
FROM r a JOIN r b ON a.area = b.area AND a.rn = 1 AND b.rn = 2""", ("scenes",))
def ts_12(t):
    pairs = catalogue.latest_pair(catalogue.search_optical(t.scenes), ["area"])
    return pairs.select("area", "scene_t1", "scene_t0", STAMP("ts_t1").alias("t1"), STAMP("ts_t0").alias("t0"))


@query("flt_08", "SELECT area, count(*) AS n_scenes FROM scenes WHERE collection = 'optical' AND cloud_cover < 30 GROUP BY area HAVING count(*) >= 3", ("scenes",))
def flt_08(t):
    return catalogue.enough_revisits(catalogue.search_optical(t.scenes, max_cloud=30), ["area"])


@query("srt_03", f"SELECT scene_id, {SQL_STAMP.format('ts')} AS taken FROM scenes ORDER BY ts ASC NULLS FIRST, scene_id", ("scenes",))
def srt_03(t):
    return catalogue.chronological(t.scenes).select("scene_id", STAMP("ts").alias("taken"))


# ---- bands and indices --------------------------------------------------------------------------------

_YX = ["step", "y", "x"]


@query("join_01", "SELECT step, y, x, red, nir, swir FROM cells", ("cells",))
def join_01(t):
    return t.cells.select(*_YX, *BANDS)


_PAIRS = """
SELECT b.step, b.y, b.x, a.ndvi AS ndvi_t0, b.ndvi AS ndvi_t1, b.ndvi - a.ndvi AS delta_ndvi, b.swir,
  (b.ndvi - a.ndvi < -0.35::DOUBLE) AND (b.swir > 0.25::DOUBLE) AS anomaly
FROM idx b JOIN idx a ON a.y = b.y AND a.x = b.x AND a.step = b.step - 1"""


def _pairs(t):
    return raster.change_cells(raster.previous_scene(t.tiles, list(BANDS)), TILE)


@query("join_02", f"SELECT step, y, x, ndvi_t0, ndvi_t1 FROM ({_PAIRS})", ("idx",))
def join_02(t):
    t0 = t.tiles.withColumn("step", F.col("step") + 1)
    pairs = raster.pair_scenes(t0, t.tiles, list(BANDS), [*raster.ADDRESS, "step"])
    return raster.change_cells(pairs, TILE).select(*_YX, "ndvi_t0", "ndvi_t1")


@query("join_02_stored", f"SELECT step, y, x, ndvi_t0, ndvi_t1 FROM ({_PAIRS})", ("idx",))
def join_02_stored(t):
    """Scene pairs over a tile table that is bucketed by address: nothing is shuffled after it is written."""
    path = run_dir(t.spark, "tile-store")
    name = "tiles_" + path[-32:]
    tilestore.write_tiles(t.band_tiles, name, path, buckets=8)
    return raster.change_cells(tilestore.scene_pairs(t.spark, name, BANDS, extra=["h", "w"]), TILE).select(*_YX, "ndvi_t0", "ndvi_t1")


@query("ras_01", "SELECT step, y, x, ndvi FROM idx", ("idx",))
def ras_01(t):
    return raster.with_indices(t.cells).select(*_YX, "ndvi")


@query("ras_02", f"SELECT step, y, x, delta_ndvi FROM ({_PAIRS})", ("idx",))
def ras_02(t):
    return _pairs(t).select(*_YX, "delta_ndvi")


@query("ras_03", f"SELECT step, y, x, CAST(anomaly AS INTEGER) AS anomaly FROM ({_PAIRS})", ("idx",))
def ras_03(t):
    return _pairs(t).select(*_YX, F.col("anomaly").cast("int").alias("anomaly"))


@query("flagship", f"""
WITH p AS ({_PAIRS}), a AS (SELECT step, count(*) AS n_cells, count(*) FILTER (anomaly) AS n_changed, {rnd('avg(delta_ndvi)', 6)} AS mean_delta FROM p GROUP BY step),
s AS (SELECT *, n_changed*10000.0::DOUBLE AS area_m2, least(0.6::DOUBLE + least(n_changed*10000.0::DOUBLE/100000.0::DOUBLE, 0.3::DOUBLE), 0.95::DOUBLE) AS confidence FROM a),
r AS (SELECT *, CAST(round_even((least(area_m2/500000.0::DOUBLE, 1.0::DOUBLE)*0.4::DOUBLE + confidence*0.3::DOUBLE + greatest(1.0::DOUBLE - 1.0::DOUBLE/10.0::DOUBLE, 0.0::DOUBLE)*0.3::DOUBLE)*100.0::DOUBLE, 0) AS INTEGER) AS risk_score FROM s)
SELECT step, n_cells, n_changed, mean_delta, area_m2, confidence, risk_score,
  CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 25 THEN 'Moderate' ELSE 'Low' END AS threat_level FROM r""", ("idx",))
def flagship(t):
    from groundshift.functions import scoring
    per = _pairs(t).groupBy("step").agg(
        F.count("*").alias("n_cells"), F.sum(F.when(F.col("anomaly"), 1).otherwise(0)).alias("n_changed"), F.round(F.avg("delta_ndvi"), 6).alias("mean_delta"))
    per = per.withColumn("area_m2", F.col("n_changed") * 10000.0)
    per = per.withColumn("confidence", scoring.detection_confidence(F.col("area_m2")))
    per = per.withColumn("risk_score", scoring.risk_score(F.col("area_m2"), F.col("confidence"), F.lit(1.0)))
    return per.withColumn("threat_level", scoring.threat_level(F.col("risk_score")))


@query("ras_04", "SELECT step, y, x, nbr FROM idx", ("idx",))
def ras_04(t):
    return raster.with_indices(t.cells).select(*_YX, "nbr")


_SCENE_ENH = "SELECT step, y, x, greatest(least(swir/(max(swir) OVER (PARTITION BY step)+1e-10::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS scene_enh, swir_enh AS stack_enh FROM idx"


@query("ras_05", _SCENE_ENH, ("idx",))
def ras_05(t):
    tiles = raster.attach_max(raster.attach_max(t.tiles, "swir", ["area"], "m_stack"), "swir", ["area", "step"], "m_scene")
    c = raster.cells(tiles, ["swir"], TILE, carry=["m_stack", "m_scene"])
    return c.select(*_YX, indices.swir_enhanced(F.col("swir"), F.col("m_scene")).alias("scene_enh"),
                    indices.swir_enhanced(F.col("swir"), F.col("m_stack")).alias("stack_enh"))


@query("agg_10", f"SELECT step, max(swir) AS swir_max, {rnd('quantile_cont(swir, 0.9)', 9)} AS swir_p90 FROM cells GROUP BY step", ("cells",))
def agg_10(t):
    top = raster.stack_max(t.tiles, "swir", ["step"])
    p90 = raster.exact_percentile(t.cells, ["step"], "swir", 0.9, "swir_p90")
    return top.join(p90, "step").withColumn("swir_p90", F.round("swir_p90", 9))


_SAR = """
WITH p AS (SELECT step, quantile_cont(vv, 0.9) AS p_vv, quantile_cont(vh, 0.9) AS p_vh FROM sar GROUP BY step),
j AS (SELECT b.step, b.y, b.x, b.vv, b.vh, p.p_vv, p.p_vh,
  CASE WHEN a.vv <> 0 THEN b.vv/(a.vv+1e-10::DOUBLE) ELSE 1.0::DOUBLE END AS vv_ratio, CASE WHEN a.vh <> 0 THEN b.vh/(a.vh+1e-10::DOUBLE) ELSE 1.0::DOUBLE END AS vh_ratio
  FROM sar b JOIN sar a ON a.y = b.y AND a.x = b.x AND a.step = b.step - 1 JOIN p ON p.step = b.step - 1),
f AS (SELECT *, vv_ratio < 0.7::DOUBLE OR vh_ratio < 0.7::DOUBLE AS coherence_loss, vv > p_vv*1.3::DOUBLE OR vh > p_vh*1.3::DOUBLE AS increase FROM j)
"""


@query("ras_08", _SAR + "SELECT step, y, x, vv_ratio, vh_ratio FROM f", ("sar",))
def ras_08(t):
    return raster.radar_change(t.sar_tiles, TILE).select(*_YX, "vv_ratio", "vh_ratio")


@query("ras_09", _SAR + "SELECT step, y, x, CAST(coherence_loss AS INTEGER) AS coherence_loss FROM f", ("sar",))
def ras_09(t):
    return raster.radar_change(t.sar_tiles, TILE).select(*_YX, F.col("coherence_loss").cast("int").alias("coherence_loss"))


@query("ras_10", _SAR + "SELECT step, y, x, CAST(increase AS INTEGER) AS backscatter_increase FROM f", ("sar",))
def ras_10(t):
    return raster.radar_change(t.sar_tiles, TILE).select(*_YX, F.col("backscatter_increase").cast("int").alias("backscatter_increase"))


_WARP = """
WITH g AS (SELECT 6378137.0::DOUBLE*radians(4.2::DOUBLE) AS x0, 6378137.0::DOUBLE*ln(tan(pi()/4 + radians(51.95::DOUBLE)/2)) AS y0),
place AS (SELECT y, x, (6378137.0::DOUBLE*radians(4.2::DOUBLE + 0.001::DOUBLE*(x + 0.5)) - x0)/100.0 - 0.5 AS sx,
  (6378137.0::DOUBLE*ln(tan(pi()/4 + radians(51.95::DOUBLE - 0.001::DOUBLE*(y + 0.5))/2)) - y0)/-160.0 - 0.5 AS sy FROM (SELECT unnest(range(40)) AS y), (SELECT unnest(range(40)) AS x), g),
inside AS (SELECT *, greatest(floor(sy), 0) AS ly, least(floor(sy) + 1, 31) AS hy, greatest(floor(sx), 0) AS lx, least(floor(sx) + 1, 31) AS hx FROM place WHERE sx BETWEEN -0.5 AND 31.5 AND sy BETWEEN -0.5 AND 31.5),
w AS (SELECT y, x, ly, hy, lx, hx, CASE WHEN ly = hy THEN 0 ELSE greatest(least(sy - ly, 1), 0) END AS fy, CASE WHEN lx = hx THEN 0 ELSE greatest(least(sx - lx, 1), 0) END AS fx FROM inside),
n AS (SELECT y, x, unnest([ly, ly, hy, hy]) AS r, unnest([lx, hx, lx, hx]) AS c, unnest([(1-fy)*(1-fx), (1-fy)*fx, fy*(1-fx), fy*fx]) AS k FROM w)
SELECT s.step, CAST(n.y AS INTEGER) AS y, CAST(n.x AS INTEGER) AS x, round(sum(k*swir), 9) AS swir FROM (SELECT DISTINCT step FROM cells) s, n LEFT JOIN cells v ON v.step = s.step AND v.y = n.r AND v.x = n.c
GROUP BY 1, 2, 3 HAVING count(*) FILTER (k > 0 AND swir IS NULL) = 0"""


@query("ras_07_warp", _WARP, ("cells",))
def ras_07_warp(t):
    """SWIR tiles as if they lay on a grid in metres, warped to one in degrees."""
    x0, y0 = float(warp.forward(np.array(4.2), 0)), float(warp.forward(np.array(51.95), 1))
    metres = warp.Grid(TILE, SIDE, SIDE, (100.0, 0.0, x0, 0.0, -160.0, y0), warp.MERCATOR)
    out = warp.warp(t.tiles, "swir", ["area", "step"], metres, warp.Grid(TILE, 40, 40, (0.001, 0.0, 4.2, 0.0, -0.001, 51.95)))
    return raster.cells(out, ["swir"], TILE).filter("swir IS NOT NULL").select(*_YX, F.round("swir", 9).alias("swir"))


@query("ras_10_sketch", "SELECT step, count(*) AS n, true AS within FROM sar GROUP BY step", ("sar",))
def ras_10_sketch(t):
    """The 90th percentile of each scene from sketches of its tiles: how far its true rank is off stays within the stated error."""
    c = raster.cells(t.sar_tiles, ["vv"], TILE)
    sketches = raster.percentile_sketches(c, ["step", "ty", "tx"], "vv", 256)
    p = raster.sketched_percentile(sketches, ["step"], 0.9, "p", 256).drop("n")
    share = c.join(p, "step").groupBy("step").agg(F.count("*").alias("n"), F.avg((F.col("vv") <= F.col("p")).cast("double")).alias("share"))
    return share.select("step", "n", (F.abs(F.col("share") - 0.9) <= raster.sketch_rank_error(256) + 1 / F.col("n")).alias("within"))


@query("ras_11", _SAR + "SELECT step, count(*) AS n_cells, count(*) FILTER (coherence_loss AND increase) AS n_anomalous FROM f GROUP BY step", ("sar",))
def ras_11(t):
    c = raster.radar_change(t.sar_tiles, TILE)
    return c.groupBy("step").agg(F.count("*").alias("n_cells"), F.sum(F.col("anomaly").cast("long")).alias("n_anomalous"))


_STACKED = "SELECT step, y, x, red AS c0, nir AS c1, swir AS c2, ndvi AS c3, 0.0::DOUBLE AS c4, greatest(least(swir/(max(swir) OVER (PARTITION BY step)+1e-10::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS c5 FROM idx"


def _stack(t):
    return raster.feature_stack(raster.with_swir_enhanced(t.tiles, list(BANDS), TILE, ["area", "step"]))


def _channels(df, col="channels"):
    return df.select(*_YX, *[F.col(col)[i].alias(f"c{i}") for i in range(6)])


@query("ras_13", _STACKED, ("idx",))
def ras_13(t):
    return _channels(_stack(t))


_NORM = ", ".join(f"(c{i} - {m}::DOUBLE)/({s}::DOUBLE + 1e-6::DOUBLE) AS c{i}" for i, (m, s) in enumerate(zip(indices.CHANNEL_MEAN, indices.CHANNEL_STD)))


@query("ras_14", f"SELECT step, y, x, {_NORM} FROM ({_STACKED})", ("idx",))
def ras_14(t):
    return _channels(_stack(t).withColumn("channels", indices.normalise_channels(F.col("channels"))))


@query("ras_17", "SELECT step, y, x, CAST(swir > 0.2::DOUBLE AS INTEGER) AS mask FROM cells", ("cells",))
def ras_17(t):
    return raster.mask_cells(t.bright_tiles, TILE).select(*_YX, F.col("mask").cast("int").alias("mask"))


@query("ras_23", "SELECT step, y, x, 0.001::DOUBLE*x + 0.0::DOUBLE*y + 4.2::DOUBLE AS lon, 0.0::DOUBLE*x + (-0.001)::DOUBLE*y + 51.95::DOUBLE AS lat FROM cells", ("cells",))
def ras_23(t):
    grid = F.struct(*[F.lit(v).alias(n) for n, v in zip("abcdef", (0.001, 0.0, 4.2, 0.0, -0.001, 51.95))])
    lon, lat = geometry.pixel_to_world(grid, F.col("x"), F.col("y"))
    return t.cells.select(*_YX, lon.alias("lon"), lat.alias("lat"))


@query("ras_24", "SELECT step, y, x, CAST(floor(least(red*1000.0::DOUBLE, 255.0::DOUBLE)) > 127 AS INTEGER) AS label FROM cells", ("cells",))
def ras_24(t):
    grey = F.floor(F.least(F.col("red") * 1000.0, F.lit(255.0)))
    return t.cells.select(*_YX, (grey > 127).cast("int").alias("label"))


# ---- time series ----------------------------------------------------------------------------------------


def _steps(t):
    return timeseries.step_flags(timeseries.tile_differences(t.tiles, TILE, raster.stack_max(t.tiles, "swir", ["area"])))


@query("ts_01", "SELECT step, y, x, k, d_ndvi, d_swir FROM steps WHERE k >= 0", ("steps",))
def ts_01(t):
    return _steps(t).select(*_YX, "k", "d_ndvi", "d_swir")


@query("ts_02", "SELECT step, y, x, CAST(loss AS INTEGER) AS loss, CAST(rise AS INTEGER) AS rise FROM diffs", ("diffs",))
def ts_02(t):
    return _steps(t).select(*_YX, F.col("loss").cast("int").alias("loss"), F.col("rise").cast("int").alias("rise"))


@query("ts_03", "SELECT step, count(*) AS n_cells, count(*) FILTER (anomaly) AS n_anomalous FROM diffs GROUP BY step", ("diffs",))
def ts_03(t):
    return _steps(t).groupBy("step").agg(F.count("*").alias("n_cells"), F.sum(F.col("anomaly").cast("long")).alias("n_anomalous"))


@query("ts_04", "SELECT y, x, coalesce(min(k) FILTER (anomaly), -1) AS onset FROM diffs GROUP BY y, x", ("diffs",))
def ts_04(t):
    return timeseries.cell_history(_steps(t)).select("y", "x", "onset")


_CUM = """
WITH c AS (SELECT *, CAST(sum(CASE WHEN anomaly THEN 1 ELSE 0 END) OVER (PARTITION BY y, x ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_anomalies FROM diffs),
p AS (SELECT *, cum_anomalies - lag(cum_anomalies) OVER (PARTITION BY y, x ORDER BY step) AS progression FROM c)
"""


@query("ts_05", _CUM + "SELECT step, y, x, cum_anomalies FROM p", ("diffs",))
def ts_05(t):
    return timeseries.running_anomalies(_steps(t)).select(*_YX, "cum_anomalies")


@query("ts_06", _CUM + "SELECT step, y, x, progression FROM p WHERE progression IS NOT NULL", ("diffs",))
def ts_06(t):
    return timeseries.running_anomalies(_steps(t)).filter("progression is not null").select(*_YX, "progression")


@query("ts_07", "SELECT y, x, count(*) FILTER (anomaly) AS persistence_steps FROM diffs GROUP BY y, x", ("diffs",))
def ts_07(t):
    return timeseries.cell_history(_steps(t)).select("y", "x", "persistence_steps")


@query("ts_08", "SELECT y, x, CAST(arg_max(anomaly, step) AND count(*) FILTER (anomaly) >= 2 AS INTEGER) AS persistent FROM diffs GROUP BY y, x", ("diffs",))
def ts_08(t):
    h = timeseries.persistent_cells(timeseries.cell_history(_steps(t)))
    return h.select("y", "x", F.col("persistent").cast("int").alias("persistent"))


@query("ts_09", _CUM + f"""
SELECT (SELECT min(step) FROM cells) AS first_time, (SELECT max(step) FROM cells) AS last_time,
  (SELECT max(n) FROM (SELECT count(*) FILTER (anomaly) AS n FROM diffs GROUP BY y, x)) AS max_persistence, {rnd('avg(progression)', 9)} AS mean_progression FROM p""", ("diffs",))
def ts_09(t):
    steps = _steps(t)
    m = timeseries.stack_metadata(t.cells, timeseries.running_anomalies(steps), timeseries.cell_history(steps))
    return m.select("first_time", "last_time", "max_persistence", F.round("mean_progression", 9).alias("mean_progression"))


@query("ts_10", f"""
SELECT site_no, {YMD.format('min(date)')} AS onset_date, arg_max(area_m2, date) AS total_area_m2,
  {rnd("coalesce((arg_max(area_m2, date) - arg_min(area_m2, date))/nullif(date_diff('day', min(date), max(date)), 0), 0.0)", 6)} AS growth_m2_per_day,
  {rnd(rnd("nullif(regr_slope(area_m2, date_diff('day', DATE '1970-01-01', date)), 'nan'::DOUBLE)", 7), 3)} AS slope_m2_per_day,
  max(area_m2) AS peak_area_m2, {rnd('avg(confidence)', 6)} AS confidence,
  CASE WHEN arg_max(area_m2, date) > 1000 THEN 'active' ELSE 'inactive' END AS current_status FROM obs GROUP BY site_no""", ("obs",))
def ts_10(t):
    g = summaries.site_growth(t.obs, ["site_no"])
    return g.withColumns({"onset_date": DAY("onset_date"), "growth_m2_per_day": F.round("growth_m2_per_day", 6),
                          "slope_m2_per_day": F.round(F.round("slope_m2_per_day", 7), 3), "confidence": F.round("confidence", 6)})


@query("ts_11", _OBS_TEXT, ("obs",))
def ts_11(t):
    return t.obs.select("site_no", DAY("date").alias("day"), "area_m2", "confidence", "ndvi")
