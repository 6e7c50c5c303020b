"""Sinks, file round trips and whole pipelines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from groundshift.operators import filters, summaries
from groundshift.plans import detection
from groundshift.plans.export import export_sites
from groundshift.session import run_dir
from groundshift.sinks import exports
from groundshift.sources import features

from .fixtures import BANDS, SAR_BANDS, SIDE, TILE
from .q_raster import _stack
from .q_shapes import GRID, MEASURE_SQL, OUTLINE_SQL, _CHIPS, _chips, _feature_tiles
from .q_sites import _LEVELS, _TOTALS, DAY, YMD
from .registry import query, rnd

_MIN = 0.9


def _doc_files(t):
    """Sites written as sector documents (at most 100 features each) and read back as files."""
    p = t.polygons
    props = F.struct(
        F.col("site_id").alias("id"), "area_m2", "confidence", "risk_score", "threat_level", "estimated_tonnage",
        F.array("centroid.lon", "centroid.lat").alias("centroid"), DAY("detection_date").alias("detection_date"),
        F.when(F.col("waste_type") != "other", F.col("waste_type")).alias("waste_type"), "distance_to_water_km", "distance_to_protected_km")
    feature = F.struct(F.lit("Feature").alias("type"), "geometry", props.alias("properties"))
    docs = p.groupBy("sector_id", F.floor(F.col("site_no") / 100).alias("part")).agg(F.collect_list(feature).alias("features"))
    docs = docs.select(F.struct(F.col("sector_id").cast("string").alias("id"), F.lit("t0").alias("scene_t0")).alias("metadata"),
                       F.struct(F.lit("FeatureCollection").alias("type"), "features").alias("feature_collection"))
    path = run_dir(t.spark, "docs")
    docs.write.json(path)
    return t.spark.read.schema(features.SECTOR_FILE).json(path)


@query("src_05", f"""
SELECT site_id, CAST(sector_id AS VARCHAR) AS sector_id, area_m2, confidence, risk_score, threat_level, estimated_tonnage, lon, lat,
  CASE WHEN waste_type = 'other' THEN 'mixed' ELSE waste_type END AS waste_type, 'Sentinel-2 L2A' AS sensor, {YMD.format('detection_date')} AS detection_date, 't0' AS scene_t0
FROM scored""", ("scored",))
def src_05(t):
    s = features.sites_from_sector_files(_doc_files(t))
    return s.select("site_id", "sector_id", "area_m2", "confidence", "risk_score", "threat_level", "estimated_tonnage", "centroid.lon", "centroid.lat",
                    "waste_type", "sensor", DAY("detection_date").alias("detection_date"), "scene_t0")


# ---- sinks ------------------------------------------------------------------------------------------------


@query("snk_01", f"SELECT site_id AS id, confidence, lon, lat, {YMD.format('detection_date')} AS detection_date, 5 AS n_points, (SELECT count(*) FROM scored WHERE confidence >= {_MIN}) AS total_features FROM scored WHERE confidence >= {_MIN}::DOUBLE", ("scored",))
def snk_01(t):
    path = run_dir(t.spark, "geojson")
    exports.write_geojson(t.polygons, path, _MIN, generated="2024-01-30T00:00:00")
    shape = ("type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, "
             "properties struct<id:string,confidence:double,centroid:array<double>,detection_date:string>")
    f = t.spark.read.schema(shape).json(path + "/features")
    meta = t.spark.read.schema("total_features bigint").json(path + "/metadata")
    n = meta.select("total_features", F.lit("Feature").alias("type"))
    p = F.col("properties")
    return f.join(n, "type").select(p["id"].alias("id"), p["confidence"].alias("confidence"), p["centroid"][0].alias("lon"), p["centroid"][1].alias("lat"),
                                    p["detection_date"].alias("detection_date"), F.size(F.col("geometry.coordinates")[0]).alias("n_points"), "total_features")


_CSV = f"SELECT site_id AS id, area_m2, estimated_tonnage, confidence, risk_score, threat_level, CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR) AS centroid, {YMD.format('detection_date')} AS detection_date, waste_type FROM scored"


@query("snk_02", _CSV, ("scored",))
def snk_02(t):
    return exports.csv_rows(t.scored)


@query("snk_03", f"""
SELECT site_id, format('{{:,.0f}}', area_m2) AS area, printf('%.1f', estimated_tonnage) AS tonnage, printf('%.1f', confidence*100.0::DOUBLE) || '%' AS confidence,
  risk_score || '/100' AS risk, threat_level AS threat, printf('%.5f', lat) || ', ' || printf('%.5f', lon) AS centroid, {YMD.format('detection_date')} AS date FROM scored""", ("scored",))
def snk_03(t):
    return exports.report_rows(t.scored)


@query("snk_03_summary", f"SELECT count(*) AS total_sites, {rnd('sum(area_m2)', 2)} AS total_area, {rnd('sum(estimated_tonnage)', 2)} AS total_tonnage, {rnd('avg(confidence)', 6)} AS avg_confidence, {_LEVELS} FROM scored", ("scored",))
def snk_03_summary(t):
    r = exports.report_summary(t.scored)
    return r.withColumns({"total_area": F.round("total_area", 2), "total_tonnage": F.round("total_tonnage", 2), "avg_confidence": F.round("avg_confidence", 6)})


# columns whose JSON text both engines write alike
_EXACT = {"detection_date", "is_active", "jurisdiction", "region_id", "risk_score", "sector_id", "site_id", "site_no", "source_sensor", "threat_level", "waste_type"}


@query("snk_04", f"""
SELECT 'EVD-20240130-' || site_id AS case_id, threat_level, {YMD.format('detection_date')} AS detection_date, printf('%.6f', lat) AS lat, printf('%.6f', lon) AS lng,
  upper(substr(waste_type, 1, 1)) || substr(waste_type, 2) AS waste_type, format('{{:,.0f}}', area_m2) AS area_m2, format('{{:,.1f}}', estimated_tonnage) AS tonnage,
  printf('%.1f', confidence*100.0::DOUBLE) AS confidence, risk_score, 'N/A' AS delta_ndvi, CASE WHEN distance_to_water_km = 0 THEN 'N/A' ELSE printf('%.2f', distance_to_water_km) END AS water_km,
  printf('%.2f', distance_to_protected_km) AS protected_km, 'N/A' AS scene_t0, substr(sha256(CAST(to_json({{detection_date: detection_date, is_active: is_active, jurisdiction: jurisdiction, region_id: region_id, risk_score: risk_score,
    sector_id: sector_id, site_id: site_id, site_no: site_no, source_sensor: source_sensor, threat_level: threat_level, waste_type: waste_type}}) AS VARCHAR)), 1, 16) AS report_hash FROM scored""", ("scored",))
def snk_04(t):
    e = exports.evidence_records(t.polygons, "2024-01-30", [c for c in t.polygons.columns if c in _EXACT])
    return e.select("case_id", "threat_level", "detection_date", "lat", "lng", "waste_type", "area_m2", "tonnage", "confidence", "risk_score",
                    "delta_ndvi", "water_km", "protected_km", "scene_t0", "report_hash")


@query("snk_05", """
WITH d AS (SELECT s.site_id, s.sector_id AS n, c.min_lon, c.min_lat, c.max_lon, c.max_lat, s.region_id FROM sites s JOIN sectors c USING (sector_id) WHERE s.confidence >= 0.7::DOUBLE),
x AS (SELECT *, concat_ws(',', CAST(min_lon AS VARCHAR), CAST(min_lat AS VARCHAR), CAST(max_lon AS VARCHAR), CAST(max_lat AS VARCHAR)) AS txt FROM d)
SELECT site_id, CASE WHEN region_id = 3 THEN 'bbox-' || substr(sha256(txt), 1, 8) ELSE CAST(n AS VARCHAR) END AS sector_id, CASE WHEN region_id = 3 THEN (min_lon + max_lon)/2 END AS center_lon FROM x""", ("sites", "sectors"))
def snk_05(t):
    boxes = t.sectors.select("sector_id", "bbox")
    d = filters.by_confidence(t.sites, 0.7).select("site_id", "sector_id", "region_id", "detection_date").join(boxes, "sector_id")
    stored = t.sites.select("sector_id", "region_id").distinct().filter("region_id <> 3").join(boxes, "sector_id").select("sector_id", "bbox")
    fresh, rows = exports.site_rows_for_boxes(d, stored)
    path = run_dir(t.spark, "sites")
    exports.append_sites(rows.select("site_id", "sector_id", "detection_date"), path)
    saved = t.spark.read.schema("site_id string, detection_date date, sector_id string").parquet(path)
    return saved.join(fresh.select("sector_id", F.col("center.lon").alias("center_lon")), "sector_id", "left").select("site_id", "sector_id", "center_lon")


@query("snk_08", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY sector_id ORDER BY risk_score DESC, site_id) AS rn FROM scored WHERE threat_level IN ('Critical','High'))
SELECT sector_id, 'Alert: ' || (SELECT count(*) FROM h b WHERE b.sector_id = h.sector_id) || ' Critical/High Detections' AS title, rn AS rank, site_id, format('{:,.0f}', area_m2) AS area,
  format('{:,.1f}', estimated_tonnage) AS tonnage, printf('%.1f', confidence*100.0::DOUBLE) || '%' AS confidence, printf('%.5f', lat) || ', ' || printf('%.5f', lon) AS coordinates,
  threat_level, waste_type, CASE WHEN threat_level = 'Critical' THEN 16711680 ELSE 16753920 END AS colour FROM h WHERE rn <= 5""", ("scored",))
def snk_08(t):
    return exports.alert_payloads(t.scored, ["sector_id"]).select("sector_id", "title", F.inline("sites"))


@query("snk_07", _CHIPS + "SELECT k.chip_id, k.step, count(*) AS n_cells, round(sum(c.red), 6) AS sum_red, count(*) FILTER (lc.y IS NOT NULL) AS n_mask FROM kept k JOIN cells c ON c.step = k.step AND c.y BETWEEN k.y0 AND k.y0+11 AND c.x BETWEEN k.x0 AND k.x0+11 LEFT JOIN lc ON lc.y = c.y AND lc.x = c.x GROUP BY 1, 2", ("cells",))
def snk_07(t):
    from groundshift.operators import tiling
    from groundshift.session import attach
    from .q_shapes import _label_rings
    labels = tiling.rasterise(_label_rings(t), GRID, SIDE, SIDE).withColumn("m", F.lit(1))
    stack = attach(_stack(t), labels, ["y", "x"], "left", "labels").withColumn("mask", F.coalesce("m", F.lit(0)).cast("tinyint"))
    chips = _chips(t).withColumn("area", F.lit("mosaic"))
    cut = tiling.cut_chips(stack, chips, ["area", "step"], ["channels", "mask"], 12, 8, F.lit(SIDE), F.lit(SIDE), False)
    cut = cut.withColumn("chip_id", tiling.chip_id(F.col("step"), F.col("y0"), F.col("x0")))
    path = run_dir(t.spark, "chips")
    exports.write_chips(cut, path)
    saved = t.spark.read.schema("chip_id string, step int, channels array<array<double>>, mask array<tinyint>").parquet(path)
    red = F.aggregate("channels", F.lit(0.0), lambda a, c: a + c[0])
    return saved.select("chip_id", "step", F.size("channels").cast("long").alias("n_cells"), F.round(red, 6).alias("sum_red"),
                        F.aggregate("mask", F.lit(0), lambda a, m: a + m).cast("long").alias("n_mask"))


# ---- pipelines ------------------------------------------------------------------------------------------------

# thresholds loosened for the stand-in values, whose cells are independent noise; every corner is kept
LIMITS = detection.Limits(ndvi_delta=0.0, swir=0.05, tolerance=0.0, min_px=1.0, confidence=0.6, min_persistence=1, step_change=0.01)


def layout():
    return detection.Layout(TILE, SIDE, SIDE, tuple(GRID.values()))


SCENE_EPOCH, SCENE_DAYS = datetime(2024, 1, 1, tzinfo=timezone.utc), 30


def scene_rows(steps):
    """Catalogue rows of raster steps, one in each collection."""
    day = F.timestamp_seconds(F.lit(int(SCENE_EPOCH.timestamp())) + F.col("step").cast("long") * SCENE_DAYS * 86400)
    s = steps.withColumn("ts", day).withColumn("collection", F.explode(F.array(*[F.lit(c) for c in ("optical", "radar", "historical")])))
    return s.select("area", F.col("step").cast("string").alias("scene_id"), "collection", "ts", F.lit(1.0).alias("cloud_cover"), F.lit("descending").alias("orbit_state"),
                    F.lit(4.2).alias("min_lon"), F.lit(51.9).alias("min_lat"), F.lit(4.24).alias("max_lon"), F.lit(51.95).alias("max_lat"))


def _catalogue(t):
    """A catalogue of the raster scenes, one entry per step and collection."""
    return scene_rows(t.band_tiles.groupBy("area", "step").agg(F.count("*").alias("n")))


def with_scene_ids(band_tiles):
    return band_tiles.withColumn("scene_id", F.col("step").cast("string"))


def _tiles(t):
    return with_scene_ids(t.band_tiles)


_COLS = ["site_id", "area_m2", "confidence", "risk_score", "threat_level", "estimated_tonnage", "n_vertices"]


_SITES_SQL = """
found AS (SELECT p.*, area, lon, lat, least(0.6::DOUBLE + least(area/100000.0, 0.3), 0.95::DOUBLE) AS conf FROM poly p JOIN size USING (step, component)
  WHERE box_px >= 1 AND contour_px >= 1 AND n_vertices >= 3 AND area >= 10000),
risky AS (SELECT *, CAST(round_even((least(area/500000.0, 1.0)*0.4 + conf*0.3 + 0.9*0.3)*100.0, 0) AS INTEGER) AS risk_score FROM found),
site AS (SELECT 'mosaic-' || step || '-' || component AS site_id, component, round(area, 2) AS exact_m2, round(round(area, 2), 0) AS area_m2, round(conf, 2) AS confidence, risk_score,
  CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 25 THEN 'Moderate' ELSE 'Low' END AS threat_level,
  round(round(area*0.15, 2), 0) AS estimated_tonnage, n_vertices, round(lon, 6) AS lon, round(lat, 6) AS lat FROM risky WHERE round(conf, 2) >= 0.6)
"""


def _site_columns(d):
    return d.withColumns({"area_m2": F.round("area_m2", 0), "estimated_tonnage": F.round("estimated_tonnage", 0)})


CHANGED_SITES_SQL = """
WITH RECURSIVE last AS (SELECT max(step) AS b FROM cells), prev AS (SELECT max(step) AS a FROM cells, last WHERE step < b),
t AS (SELECT b AS step, y.y, y.x FROM idx y JOIN idx z ON z.y = y.y AND z.x = y.x, last, prev WHERE y.step = b AND z.step = a AND y.ndvi - z.ndvi < 0.0 AND y.swir > 0.05::DOUBLE),
""" + OUTLINE_SQL + "," + MEASURE_SQL + "," + _SITES_SQL


@query("pipe_01", CHANGED_SITES_SQL + """
SELECT site_id, area_m2, confidence, risk_score, threat_level, estimated_tonnage, n_vertices, lon, lat, CAST((SELECT a FROM prev) AS VARCHAR) AS scene_t0, CAST((SELECT b FROM last) AS VARCHAR) AS scene_t1 FROM site""", ("idx",))
def pipe_01(t):
    d = detection.detect_changes(_catalogue(t), _tiles(t), BANDS, layout(), LIMITS, bbox=[4.2, 51.9, 4.24, 51.95])
    return _site_columns(d).select(*_COLS, "scene_t0", "scene_t1", F.round("centroid.lon", 6).alias("lon"), F.round("centroid.lat", 6).alias("lat"))


@query("pipe_02", f"""
WITH f AS (SELECT s.* FROM scored s JOIN sectors c USING (sector_id) WHERE c.min_lon = -56.0 AND c.min_lat = -28.0 AND c.max_lon = -55.0 AND c.max_lat = -27.0 AND c.is_active AND s.is_active AND s.confidence >= 0.7::DOUBLE)
SELECT f.site_id AS id, f.threat_level, {YMD.format('f.detection_date')} AS detection_date, t.total_sites, t.total_area_m2, t.avg_confidence FROM f, (SELECT {_TOTALS} FROM f) t""", ("scored", "sectors"))
def pipe_02(t):
    records, totals = detection.lookup_sites(t.scored, t.sectors, [-56.0, -28.0, -55.0, -27.0], 0.7)
    k = F.lit(1).alias("k")
    both = records.select("id", "threat_level", "detection_date", k).join(totals.select("total_sites", "total_area_m2", "avg_confidence", k), "k")
    return both.drop("k")


@query("pipe_03", """
WITH RECURSIVE g AS (SELECT *, coalesce(d_ndvi < -0.01::DOUBLE AND d_swir > 0.01::DOUBLE, false) AS hit FROM steps WHERE k >= 0),
h AS (SELECT y, x, arg_max(hit, step) AS last_hit, max(step) AS last_step, count(*) FILTER (hit) AS n, coalesce(min(k) FILTER (hit), -1) AS onset FROM g GROUP BY 1, 2),
t AS (SELECT last_step AS step, y, x FROM h WHERE last_hit AND n >= 1 AND last_step = (SELECT max(step) FROM cells)),
""" + OUTLINE_SQL + "," + MEASURE_SQL + "," + _SITES_SQL + f""",
c AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY y, x ORDER BY step ROWS UNBOUNDED PRECEDING) AS cum FROM g),
p AS (SELECT cum - lag(cum) OVER (PARTITION BY y, x ORDER BY step) AS progression FROM c),
o AS (SELECT component, min(onset) AS first_onset FROM comp JOIN h ON h.y = comp.y AND h.x = comp.x GROUP BY 1)
SELECT site_id, area_m2, confidence, risk_score, threat_level, estimated_tonnage, n_vertices, (SELECT max(n) FROM h) AS max_persistence,
  {rnd('(SELECT avg(progression) FROM p)', 9)} AS mean_progression, first_onset FROM site JOIN o USING (component)""", ("steps",))
def pipe_03(t):
    d = detection.detect_over_time(_catalogue(t), _tiles(t), BANDS, layout(), LIMITS)
    return _site_columns(filters.by_confidence(d, 0.6)).select(*_COLS, "max_persistence", F.round("mean_progression", 9).alias("mean_progression"), "first_onset")


@query("pipe_04")
def pipe_04(t):
    sets = {"sentinel2": BANDS, "sentinel1": SAR_BANDS, "landsat": BANDS}
    kept, results = detection.detect_multisensor(_catalogue(t), {s: _tiles(t) for s in sets}, sets, layout(), LIMITS)
    per = kept.groupBy("source_sensor").agg(F.count("*").alias("kept"))
    return results.join(per, "source_sensor", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))


def _scored_scene(t):
    return detection.score_scene(_feature_tiles(t), layout(), size=12, stride=8)


_SCORE = """
WITH win AS (SELECT a.s AS y0, b.s AS x0 FROM (SELECT unnest([0, 8, 16, 20]) AS s) a, (SELECT unnest([0, 8, 16, 20]) AS s) b),
pred AS (SELECT step, y0, x0, y, x, 1.0/(1.0+exp(-(2.0*swir - 3.0*ndvi))) AS p FROM idx JOIN win ON y BETWEEN y0 AND y0 + 11 AND x BETWEEN x0 AND x0 + 11),
f AS (SELECT step, y0, x0, (sum(p) + (144 - count(*))*0.5)/144 AS confidence FROM pred GROUP BY 1, 2, 3),
m AS (SELECT c.step, c.y, c.x, coalesce(avg(q.p), 0) AS p, coalesce(avg(f.confidence), 0) AS confidence
FROM cells c LEFT JOIN (pred q JOIN f USING (step, y0, x0)) ON q.step = c.step AND q.y = c.y AND q.x = c.x GROUP BY 1, 2, 3)
"""


@query("snk_06", _SCORE + "SELECT step, y, x, round(p, 8) AS p, round(confidence, 8) AS confidence, CAST(p > 0.5 AS INTEGER) AS mask FROM m", ("idx",))
def snk_06(t):
    path = run_dir(t.spark, "maps")
    exports.write_maps(detection.scored_cells(_scored_scene(t), layout()), path, ["area", "step"])
    saved = t.spark.read.schema("y int, x int, p double, confidence double, mask tinyint, step int").parquet(path)
    return saved.select("step", "y", "x", F.round("p", 8).alias("p"), F.round("confidence", 8).alias("confidence"), F.col("mask").cast("int").alias("mask"))


@query("pipe_06", "WITH RECURSIVE " + _SCORE.strip()[5:] + ", t AS (SELECT step, y, x FROM m WHERE p > 0.5), " + OUTLINE_SQL + "," + MEASURE_SQL + """
, z AS (SELECT c.step, c.component, avg(confidence) AS conf FROM comp c JOIN m ON m.step = c.step AND m.y = c.y AND m.x = c.x GROUP BY 1, 2)
SELECT step, component, n_cells, contour_px, n_vertices, round(abs(deg2)*111000.0*111000.0*cos(radians(lat)), 1) AS area_m2, round(conf, 6) AS confidence
FROM poly JOIN size USING (step, component) JOIN z USING (step, component) WHERE box_px >= 10 AND contour_px >= 10 AND n_vertices >= 3""", ("idx",))
def pipe_06(t):
    p = detection.scored_polygons(_scored_scene(t), layout(), min_px=10.0, tolerance=0.0)
    return p.select("step", "component", "n_cells", "contour_px", "n_vertices", F.round("area_m2", 1).alias("area_m2"), F.round("mean_confidence", 6).alias("confidence"))


@query("pipe_07", f"SELECT * FROM ({_CSV}) WHERE confidence >= {_MIN}::DOUBLE", ("scored",))
def pipe_07(t):
    path = run_dir(t.spark, "export")
    export_sites(t.scored, "csv", path, _MIN)
    names = ("id", "area_m2", "estimated_tonnage", "confidence", "risk_score", "threat_level", "centroid", "detection_date", "waste_type")
    schema = "id string, area_m2 double, estimated_tonnage double, confidence double, risk_score int, threat_level string, centroid string, detection_date string, waste_type string"
    return t.spark.read.option("header", True).schema(schema).csv(path).toDF(*names)
