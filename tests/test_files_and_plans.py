import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundshift.operators import scorer
from groundshift.plans import detection
from groundshift.plans.export import export_sites
from groundshift.sinks import exports
from groundshift.sources import features, labels


def sector_doc(sector, prefix, n):
    ring = [[4.3, 51.9], [4.31, 51.9], [4.31, 51.91], [4.3, 51.9]]
    feats = []
    for i in range(n):
        p = {"id": f"{prefix}-{i:03d}", "area_m2": 1000.0 * (i + 1), "confidence": round(0.7 + i / 10, 2), "risk_score": 50, "threat_level": "High",
             "estimated_tonnage": 150.0 * (i + 1), "centroid": [4.305, 51.905], "detection_date": "2024-01-0%d" % (i + 1)}
        if i:
            p.update(waste_type="hazardous", sensor="X")
        feats.append({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": p})
    dates = ["2024-01-01", "2024-01-31"]
    return {"metadata": {"id": sector, "name": sector, "bbox": [4.2, 51.85, 4.5, 51.95], "center": [4.35, 51.9], "zoom": 12, "scene_t0": "A", "scene_t1": "B"},
            "feature_collection": {"type": "FeatureCollection", "features": feats},
            "timeseries": {"dates": dates, "sites": {f"{prefix}-000": {"dates": dates, "area_m2": [900.0, 2000.0], "confidence": [0.5, 0.6], "ndvi": [0.1, 0.2]}},
                           "summary": {"total_area_m2": [900.0, 2000.0], "num_active_sites": [0, 1]}}}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sectors")
    for s, p, n in (("s1", "AA", 2), ("s2", "BB", 3)):
        (d / f"{s}.json").write_text(json.dumps(sector_doc(s, p, n), indent=1))
    return features.read_sector_files(spark, str(d))


def test_sector_files(files):
    sites = {r["site_id"]: r for r in features.sites_from_sector_files(files).collect()}
    assert len(sites) == 5
    assert (sites["AA-000"]["waste_type"], sites["AA-000"]["sensor"]) == ("mixed", "Sentinel-2 L2A")
    assert (sites["AA-001"]["waste_type"], sites["AA-001"]["scene_t1"], sites["AA-001"]["centroid"]["lat"]) == ("hazardous", "B", 51.905)
    idx = {r["sector_id"]: (r["num_sites"], r["total_area_m2"]) for r in features.sector_index(
        features.sites_from_sector_files(files), features.sectors_from_sector_files(files)).collect()}
    assert idx == {"s1": (2, 3000.0), "s2": (3, 6000.0)}


def test_series_and_rollup_equal_the_stored_summary(files):
    from groundshift.operators.summaries import series_rollup
    s = features.series_from_sector_files(files)
    assert s.count() == 4
    got = {(r["sector_id"], str(r["date"])): (r["total_area_m2"], r["num_active_sites"]) for r in series_rollup(s, ["sector_id", "date"]).collect()}
    assert got[("s1", "2024-01-01")] == (900.0, 0) and got[("s2", "2024-01-31")] == (2000.0, 1)


def test_stored_answer_needs_the_exact_box(files):
    sites, sectors = features.sites_from_sector_files(files), features.sectors_from_sector_files(files).filter("sector_id = 's2'")
    rec, tot = detection.lookup_sites(sites, sectors, [4.2, 51.85, 4.5, 51.95], 0.8)
    assert rec.count() == tot.first()["total_sites"] == 2
    rec, tot = detection.lookup_sites(sites, sectors, [4.2, 51.85, 4.5, 51.96], 0.8)
    assert rec.count() == 0 and tot.first()["total_area_m2"] == 0.0


@pytest.mark.parametrize("fmt", ["geojson", "csv", "pdf"])
def test_export(spark, files, tmp_path, fmt):
    path = str(tmp_path / fmt)
    export_sites(features.sites_from_sector_files(files), fmt, path, 0.8, bbox=[4.0, 51.0, 5.0, 52.0], date_range=("2024-01-01", "2024-01-02"), generated="2024-02-01T00:00:00")
    if fmt == "geojson":
        f = [json.loads(r["value"]) for r in spark.read.text(path + "/features").collect()]
        assert sorted(x["properties"]["id"] for x in f) == ["AA-001", "BB-001"]
        assert f[0]["type"] == "Feature" and f[0]["geometry"]["type"] == "Polygon"
        meta = spark.read.json(path + "/metadata").first()
        assert meta["total_features"] == 2 and meta["confidence_threshold"] == 0.8
    elif fmt == "csv":
        t = spark.read.option("header", True).csv(path)
        assert tuple(t.columns) == exports.CSV_TITLES and t.count() == 2
        assert t.first()["Centroid (lat,lon)"] == "51.905, 4.305"
    else:
        assert spark.read.parquet(path + "/summary").first()["total_sites"] == 2
    with pytest.raises(ValueError):
        export_sites(features.sites_from_sector_files(files), "xml", path)


def test_payloads_hold_five_sites_and_count_all(spark, tables):
    p = exports.alert_payloads(tables.scored, ["sector_id"]).collect()
    assert p and all(len(r["sites"]) <= 5 for r in p)
    assert all(str(r["n_severe"]) in r["title"] for r in p)


def test_way_rings_skip_unknown_nodes_and_short_ways(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 9, 1], {"landuse": "landfill"}), (2, [1, 2, 3], {"landuse": "landfill"}), (3, [1, 2, 3, 1], {"landuse": "forest"})],
                                 "way_id int, nodes array<int>, tags map<string,string>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "node_id int, lon double, lat double")
    got = labels.way_rings(ways, nodes, tag="landfill").collect()
    assert [(r["way_id"], r["ring"]) for r in got] == [(1, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])]


def test_scorer_is_built_once_per_task_and_keeps_tiles(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.random((9, 6)).tolist()) for i in range(10)]
    df = spark.createDataFrame(rows, "tile int, channels array<array<double>>").coalesce(1)
    got = {r["tile"]: r for r in scorer.score_tiles(df, ["tile"], batch=3).collect()}
    for i, c in rows:
        c = np.array(c)
        p = 1 / (1 + np.exp(-(2 * c[:, 2] - 3 * c[:, 3])))
        assert np.allclose(got[i]["p"], p) and got[i]["confidence"] == pytest.approx(p.mean())


def _scene_tiles(spark, images):
    """images: scene -> (red, nir, swir) arrays; 8 x 8 tiles."""
    rows = []
    for scene, bands in images.items():
        for name, img in zip(("B04", "B08", "B11"), bands):
            for y in range(0, img.shape[0], 8):
                for x in range(0, img.shape[1], 8):
                    b = img[y:y + 8, x:x + 8]
                    rows.append(("a", scene, name, y // 8, x // 8, b.shape[0], b.shape[1], b.ravel().tolist()))
    return spark.createDataFrame(rows, "area string, scene_id string, band string, ty int, tx int, h int, w int, data array<double>")


def layout():
    return detection.Layout(8, 24, 24, (0.001, 0.0, 4.2, 0.0, -0.001, 51.95))


def _catalogue(spark, n, collection="optical"):
    return spark.createDataFrame([("a", f"s{i}", collection, f"2024-0{i + 1}-01", 5.0, 4.2, 51.92, 4.23, 51.95) for i in range(n)],
                                 "area string, scene_id string, collection string, d string, cloud_cover double, min_lon double, min_lat double, max_lon double, max_lat double").withColumn("ts", F.to_timestamp("d"))


BANDS = {"red": "B04", "nir": "B08", "swir": "B11"}


def _field(changed):
    red, nir, swir = np.full((24, 24), 0.1), np.full((24, 24), 0.5), np.full((24, 24), 0.1)
    if changed is not None:
        red[changed], nir[changed], swir[changed] = 0.4, 0.3, 0.6
    return red, nir, swir


def test_pair_detection_finds_the_cleared_block(spark):
    block = (slice(5, 17), slice(6, 14))  # crosses tile seams
    tiles = _scene_tiles(spark, {"s0": _field(None), "s1": _field(None), "s2": _field(block)})
    got = detection.detect_changes(_catalogue(spark, 3), tiles, BANDS, layout()).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["scene_t0"], r["scene_t1"], r["n_cells"], r["contour_px"]) == ("s1", "s2", 96, 77.0)
    assert r["centroid"]["lon"] == pytest.approx(4.2 + 0.001 * 9.5) and r["centroid"]["lat"] == pytest.approx(51.95 - 0.001 * 10.5)
    # 77 cells are about 1.5 km² in Mercator metres: 0.4 + 0.3 * 0.9 + 0.3 * 0.9
    assert (r["risk_score"], r["threat_level"], r["confidence"]) == (94, "Critical", 0.9)
    assert detection.detect_changes(_catalogue(spark, 1), tiles, BANDS, layout()).count() == 0


def test_box_prunes_tiles_by_address(spark):
    tiles = _scene_tiles(spark, {"s0": _field(None)})
    got = detection.within(tiles, [4.2, 51.943, 4.2075, 51.95], layout()).select("ty", "tx").distinct().collect()
    assert {(r["ty"], r["tx"]) for r in got} == {(0, 0)}
    got = detection.within(tiles, [4.205, 51.93, 4.217, 51.9405], layout()).select("ty", "tx").distinct().collect()
    assert {(r["ty"], r["tx"]) for r in got} == {(y, x) for y in (1, 2) for x in (0, 1, 2)}


def test_stack_detection_needs_persistence(spark):
    a, b = (slice(2, 10), slice(2, 10)), (slice(2, 10), slice(2, 10))
    def worse(level):
        red, nir, swir = _field(None)
        red[a], nir[a], swir[a] = 0.1 + level, 0.5 - level, 0.1 + 3 * level
        return red, nir, swir
    tiles = _scene_tiles(spark, {"s0": _field(None), "s1": worse(0.1), "s2": worse(0.25)})
    got = detection.detect_over_time(_catalogue(spark, 3), tiles, BANDS, layout()).collect()
    assert len(got) == 1 and got[0]["max_persistence"] == 2 and got[0]["first_onset"] == 0 and got[0]["contour_px"] == 49.0
    assert detection.detect_over_time(_catalogue(spark, 2), tiles, BANDS, layout()).count() == 0


def test_sensors_are_merged_by_confidence(spark):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    mk = lambda conf: spark.createDataFrame([("a", "x", ring, conf)], "area string, site_id string, ring array<array<double>>, confidence double")
    out = detection.merge_sensors({"sentinel2": mk(0.8), "sentinel1": mk(0.9), "landsat": mk(0.4)}).collect()
    assert [(r["source_sensor"], r["sensor"]) for r in out] == [("sentinel1", "Sentinel-1")]


def test_multisensor_dedupes_and_reports_missing_scenes(spark):
    block = (slice(2, 10), slice(2, 10))

    def worse(level):
        red, nir, swir = _field(None)
        red[block], nir[block], swir[block] = 0.1 + level, 0.5 - level, 0.1 + 3 * level
        return red, nir, swir

    optical = _scene_tiles(spark, {"s0": _field(None), "s1": _field(block)})
    history = _scene_tiles(spark, {"s0": _field(None), "s1": worse(0.1), "s2": worse(0.25)})
    radar = _scene_tiles(spark, {"s0": _field(None)})
    scenes = _catalogue(spark, 2).unionByName(_catalogue(spark, 3, "historical")).unionByName(_catalogue(spark, 1, "radar"))
    scenes = scenes.withColumn("orbit_state", F.lit("descending"))
    kept, results = detection.detect_multisensor(
        scenes, {"sentinel2": optical, "sentinel1": radar, "landsat": history},
        {"sentinel2": BANDS, "sentinel1": {"vv": "B04", "vh": "B08"}, "landsat": BANDS}, layout())
    # both optical sensors see the same block with equal confidence; the id decides
    assert [r["site_id"] for r in kept.collect()] == ["landsat-a-s2-50"]
    got = {r["source_sensor"]: (r["count"], r["scenes_processed"], r["error"]) for r in results.collect()}
    assert got == {"sentinel2": (1, 2, None), "sentinel1": (0, 1, "Insufficient SAR scenes"), "landsat": (1, 3, None)}


def test_radar_detection_finds_new_material(spark):
    rng = np.random.default_rng(2)
    base = 0.2 + 0.02 * rng.random((24, 24))
    vv, vh = base.copy(), base.copy()
    vv[4:12, 5:14] = 0.05  # coherence lost in one polarisation
    vh[4:12, 5:14] = 0.9   # bright in the other
    tiles = _scene_tiles(spark, {"s0": (base, base, base), "s1": (vv, vh, base)})
    scenes = _catalogue(spark, 2, "radar").withColumn("orbit_state", F.lit("descending"))
    got = detection.detect_radar(scenes, tiles, {"vv": "B04", "vh": "B08"}, layout()).collect()
    assert len(got) == 1 and got[0]["n_cells"] >= 60 and got[0]["detection_method"] == detection.RADAR_METHOD
    assert (got[0]["scene_t0"], got[0]["scene_t1"]) == ("s0", "s1")
