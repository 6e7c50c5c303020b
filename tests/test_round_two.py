"""What the first review found wrong."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from contract.fixtures import BANDS, TILE
from contract.q_outputs import _catalogue, layout, LIMITS, _tiles
from groundshift.functions import formats
from groundshift.operators import overlap, raster, stencils
from groundshift.plans import detection
from groundshift.session import discard, stage


def test_ids_count_within_their_scope(spark):
    box = lambda x: (x, 0.0, x + 1.0, 1.0)
    rows = [("A", 1, 0.9, *box(0.0)), ("A", 2, 0.8, *box(0.1)), ("B", 2, 0.9, *box(0.0)), ("B", 3, 0.8, *box(5.0))]
    df = spark.createDataFrame(rows, "scope string, id long, confidence double, min_x double, min_y double, max_x double, max_y double")
    kept = overlap.suppress(df, "id", ["scope"])
    assert sorted((r.scope, r.id) for r in kept.collect()) == [("A", 1), ("B", 2), ("B", 3)]
    assert kept.columns == df.columns


def test_repeated_ids_against_the_sequential_result(spark):
    rng = np.random.default_rng(4)
    rows = []
    for scope in ("a", "b", None):
        for i in range(60):
            x, y, w = rng.random() * 4, rng.random() * 4, 0.5 + rng.random()
            rows.append((scope, i, float(rng.integers(5)) / 4, float(x), float(y), float(x + w), float(y + w)))
    df = spark.createDataFrame(rows, "scope string, id long, confidence double, min_x double, min_y double, max_x double, max_y double")

    def iou(p, q):
        w, h = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
        both = max(w, 0) * max(h, 0)
        return both / ((p[5] - p[3]) * (p[6] - p[4]) + (q[5] - q[3]) * (q[6] - q[4]) - both)

    want = []
    for scope in ("a", "b"):
        kept = []
        for r in sorted((r for r in rows if r[0] == scope), key=lambda r: (-r[2], r[1])):
            if all(iou(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want += [(scope, r[1]) for r in kept]
    got = overlap.suppress(df.filter("scope IS NOT NULL"), "id", ["scope"], 0.3, heads=4)
    assert sorted((r.scope, r.id) for r in got.collect()) == sorted(want)


def test_rings_of_many_vertices_stay_small():
    def ring(n, shift):
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        r = 1 + 0.1 * np.cos(20 * a)
        p = np.stack([shift + r * np.cos(a), r * np.sin(a)], axis=1)
        return np.concatenate([p, p[:1]])

    small = overlap.ring_iou(ring(300, 0.0), ring(300, 0.3))
    tracemalloc.start()
    large = overlap.ring_iou(ring(1000, 0.0), ring(1000, 0.3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(small - large) < 1e-2 and peak < 200e6


def test_bands_of_different_size_fail(spark):
    rows = [("m", 0, 0, 0, "r", [1.0] * 4), ("m", 0, 0, 0, "s", [1.0])]
    tiles = spark.createDataFrame(rows, "area string, ty int, tx int, step int, band string, data array<double>")
    with pytest.raises(Exception, match="resample"):
        raster.align_bands(tiles, {"red": "r", "swir": "s"}).collect()


def test_scenes_of_one_time_are_not_mixed(spark):
    rows = [("m", 0, 0, 7, s, b, [v]) for s, b, v in (("x", "r", 1.0), ("y", "r", 2.0), ("y", "n", 3.0), ("z", "r", 4.0), ("z", "n", 5.0))]
    tiles = spark.createDataFrame(rows, "area string, ty int, tx int, step int, scene_id string, band string, data array<double>")
    got = raster.align_bands(tiles, {"red": "r", "nir": "n"}, scene="scene_id").collect()
    assert [(r.scene_id, r.red, r.nir) for r in got] == [("y", [2.0], [3.0])]


def test_newest_scene_without_a_band_gives_way(spark, tables):
    tiles = _tiles(tables)
    last = tiles.agg(F.max("step")).first()[0]
    lame = tiles.filter((F.col("step") < last) | (F.col("band") != BANDS["swir"]))
    less = tiles.filter(F.col("step") < last)
    scenes = _catalogue(tables)
    for run in (detection.detect_changes, detection.detect_over_time):
        a = run(scenes, lame, BANDS, layout(), LIMITS).select("site_id", "area_m2").collect()
        b = run(scenes.filter(F.col("scene_id") != str(last)), less, BANDS, layout(), LIMITS).select("site_id", "area_m2").collect()
        assert a and sorted(a) == sorted(b)


def test_box_clips_every_detector(spark, tables):
    box = [4.2, 51.9425, 4.2075, 51.95]  # the first tile
    lon0, lat0 = 4.2 + TILE * 0.001, 51.95 - TILE * 0.001
    for run, bands in ((detection.detect_changes, BANDS), (detection.detect_over_time, BANDS), (detection.detect_radar, {"vv": "0", "vh": "1"})):
        rings = run(_catalogue(tables), _tiles(tables), bands, layout(), LIMITS, bbox=box).select("ring").collect()
        assert all(x <= lon0 and y >= lat0 for r in rings for x, y in r.ring)


def test_site_ids_name_the_scene(spark, tables):
    found = detection.detect_changes(_catalogue(tables), _tiles(tables), BANDS, layout(), LIMITS).select("site_id", "scene_t1").collect()
    assert found and all(r.site_id.split("-")[1] == r.scene_t1 for r in found)


def test_resampling_with_holes(spark):
    rng = np.random.default_rng(1)
    for missing in (0, 1, 17, 60):
        img = rng.random((8, 8))
        img.ravel()[:missing] = np.nan
        data = [None if np.isnan(v) else float(v) for v in img.ravel()]
        df = spark.createDataFrame([(0, 0, 0, 8, 8, data)], "k int, ty int, tx int, h int, w int, v array<double>")
        got = {(r.ty, r.tx): r for r in stencils.resample(df, "v", ["k"], 8, (8, 8), (16, 16)).collect()}
        s = (np.arange(16) + 0.5) / 2 - 0.5
        lo = np.floor(s)
        a, b, f = np.clip(lo, 0, 7).astype(int), np.clip(lo + 1, 0, 7).astype(int), s - lo
        rows = (1 - f)[:, None] * img[a] + f[:, None] * img[b]
        want = (1 - f) * rows[:, a] + f * rows[:, b]
        for (ty, tx), r in got.items():
            part = want[8 * ty:8 * ty + 8, 8 * tx:8 * tx + 8].ravel()
            assert [v is None for v in r.v] == np.isnan(part).tolist()
            assert np.allclose([v for v in r.v if v is not None], part[~np.isnan(part)])


def test_windows_with_missing_cells_are_scored(spark):
    values = [v for y in range(6) for x in range(6) for v in ([0.0, 0.0, 1.0, 0.0, 0.0, 0.0] if (y, x) != (2, 2) else [None] * 6)]
    tiles = spark.createDataFrame([("m", 0, 0, 0, 6, 6, values)], "area string, step int, ty int, tx int, h int, w int, values array<double>")
    got = detection.score_scene(tiles, detection.Layout(6, 6, 6, (1, 0, 0, 0, -1, 0)), size=4, stride=2).collect()
    want = np.full((6, 6), 1 / (1 + np.exp(-2.0)))
    want[2, 2] = 0.5
    assert len(got) == 1 and np.allclose(np.reshape(got[0].p, (6, 6)), want, atol=1e-12)


@pytest.mark.parametrize("tile,size,stride,height,width", [(8, 12, 8, 29, 21), (5, 4, 3, 13, 17), (16, 6, 6, 20, 16), (4, 9, 2, 15, 9), (8, 40, 8, 20, 20)])
def test_overlap_mean_of_tiles(spark, tile, size, stride, height, width):
    """Windows cut from tiles of any size, with one tile missing, against sliding over the whole image."""
    from groundshift.operators import scorer, tiling

    rng = np.random.default_rng(tile)
    img = rng.random((height, width, 6))
    hole = (1, 1)
    rows, there = [], np.zeros((height, width), bool)
    for ty in range(-(-height // tile)):
        for tx in range(-(-width // tile)):
            at = slice(ty * tile, min(height, ty * tile + tile)), slice(tx * tile, min(width, tx * tile + tile))
            if (ty, tx) == hole:
                img[at] = 0
                continue
            there[at] = True
            rows.append(("m", 3, ty, tx, *img[at].shape[:2], img[at].ravel().tolist()))
    tiles = spark.createDataFrame(rows, "area string, step int, ty int, tx int, h int, w int, values array<double>")
    cut = tiling.cut_windows(tiles, ["area", "step"], tile, height, width, 6, size, stride)
    scored = scorer.score_tiles(cut, ["area", "step", "y0", "x0"])
    got = {(r.ty, r.tx): r for r in tiling.overlap_mean(scored, tiles, ["area", "step"], tile, size).collect()}
    sums, n = np.zeros((2, height, width)), np.zeros((height, width))
    for y0 in tiling.window_starts(height, size, stride):
        for x0 in tiling.window_starts(width, size, stride):
            at = slice(y0, y0 + size), slice(x0, x0 + size)
            if there[at].any():
                p = 1 / (1 + np.exp(-(2 * img[at][..., 2] - 3 * img[at][..., 3])))
                sums[0][at] += p
                sums[1][at] += p.mean()
                n[at] += 1
    want = sums / np.maximum(n, 1)
    assert len(got) == len(rows)
    for (ty, tx), r in got.items():
        at = slice(ty * tile, min(height, ty * tile + tile)), slice(tx * tile, min(width, tx * tile + tile))
        assert np.allclose([r.p, r.confidence], want[:, at[0], at[1]].reshape(2, -1), atol=1e-12)


def test_scoring_shuffles_pieces_of_tiles_alone(spark, tables):
    from contract import q_shapes

    tiles = stage(q_shapes._feature_tiles(tables).select("area", "step", "ty", "tx", "h", "w", "values"), "tiles")
    plan = detection.score_scene(tiles, layout(), size=12, stride=8)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and plan.count("Exchange") == 2


def test_rounding_of_what_is_no_number(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (61.25,), (2.675,), (-0.5,)], "x double")
    got = [r[0] for r in df.select(formats.rounded(F.col("x"), 1)).collect()]
    assert got[0] == float("inf") and np.isnan(got[1]) and got[2] is None and got[3:] == [61.2, 2.7, -0.5]


def test_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "p string, q string, r string")
    h = [r[0] for r in df.select(formats.content_hash({c: F.col(c) for c in df.columns})).collect()]
    assert h[0] != h[1]


def test_discarded_tables_are_gone(spark):
    kept, gone = stage(spark.range(3), "kept"), stage(spark.range(3), "gone")
    discard(gone, spark.range(3))
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_rules_from_a_table(spark):
    from groundshift.operators import relations

    sites = spark.createDataFrame([(1, 5, 0.9, 2e5), (2, 6, 0.95, 5e4), (3, None, 0.99, 9e5)], "site_id int, sector_id int, confidence double, area_m2 double")
    rules = spark.createDataFrame([("all", 0.8, 1e5, None), ("five", 0.8, 1e4, [5, 5, 6]), ("none", 0.5, 1.0, [77])],
                                  "rule_id string, min_confidence double, min_area_m2 double, regions array<int>")
    got = relations.fired_rules(sites, rules)
    assert sorted((r.site_id, r.rule_id) for r in got.collect()) == [(1, "all"), (1, "five"), (2, "five"), (3, "all")]
    assert relations.fired_rules(sites, rules.limit(0)).count() == 0


def test_monitor_starts_from_a_compacted_log(spark):
    from groundshift.session import run_dir
    from groundshift.streaming import monitoring

    jobs = spark.createDataFrame([(1, 7, 0.7, True, 30)], "job_id int, sector_id int, confidence_threshold double, is_active boolean, lookback_days int")
    schema = "sector_id int, site_id int, ts timestamp, detection_date date, confidence double, risk_score int, threat_level string, area_m2 double, estimated_tonnage double, waste_type string, centroid struct<lon:double,lat:double>"
    rows = lambda ids, day: spark.sql(" UNION ALL ".join(
        f"SELECT 7 sector_id, {i} site_id, TIMESTAMP '2024-01-{day} 00:00:00' ts, DATE '2024-01-{day}' detection_date, 0.9D confidence, 80 risk_score, "
        f"'Critical' threat_level, 100.0D area_m2, 15.0D estimated_tonnage, 'mixed' waste_type, named_struct('lon', 1D, 'lat', 2D) centroid" for i in ids))
    empty = spark.createDataFrame([], schema)
    make = lambda root, start=None: monitoring.Monitor(spark, root, jobs, empty, ["ts", "site_id"], lambda d: d, start=start)
    a = make(run_dir(spark, "m"))
    a.process(rows([1, 2], "01"), 0)
    a.process(rows([2, 3], "02"), 1)
    b = make(run_dir(spark, "m"), a.compact(run_dir(spark, "compact")))
    b.process(rows([3, 4], "03"), 0)
    assert {r.site_id: str(r.detection_date) for r in b.sites().collect()} == {1: "2024-01-01", 2: "2024-01-02", 3: "2024-01-03", 4: "2024-01-03"}
    assert [r.sites_count for r in b.alerts().collect()] == [1]
    assert b.payloads().count() == 1
    again = make(b.table.path.removesuffix("/sites"))  # opening an existing log loses nothing
    assert again.sites().count() == 4


def test_no_imagery_no_sites(spark):
    from groundshift.session import run_dir
    from groundshift.streaming import monitoring

    jobs = spark.createDataFrame([(1, 7, 0.7, True, 30), (2, 8, 0.7, True, 30)], "job_id int, sector_id int, confidence_threshold double, is_active boolean, lookback_days int")
    det = spark.sql("SELECT s sector_id, s site_id, TIMESTAMP '2024-01-20 00:00:00' ts, DATE '2024-01-20' detection_date, 0.9D confidence, 80 risk_score, 'Critical' "
                    "threat_level, 100.0D area_m2, 15.0D estimated_tonnage FROM VALUES (7), (8) v(s)")
    scenes = spark.sql("SELECT 7 sector_id, concat('s', d) scene_id, CAST(concat('2024-01-', d) AS TIMESTAMP) ts FROM VALUES ('10'), ('15') v(d)")
    m = monitoring.Monitor(spark, run_dir(spark, "m"), jobs, det, ["ts", "site_id"], lambda d: d, scenes=scenes, run_date="2024-01-21")
    m.process(det, 0)
    assert [r.sector_id for r in m.sites().collect()] == [7]
    assert {r.job_id: r.last_error for r in m.job_state().collect()} == {1: None, 2: monitoring.NO_IMAGERY}


@pytest.mark.parametrize("slots", [None, 1, 4, 16])
def test_rules_by_dominance(spark, slots):
    """Every pair that fires, once, and few pairs compared besides; ties with bounds, missing values and regions included."""
    from groundshift.operators import relations

    rng = np.random.default_rng(3)
    at = lambda: round(float(rng.choice([rng.random(), 0.5, 0.25])), 3)
    sites = [(i, int(rng.integers(0, 6)) if i % 9 else None, at() if i % 31 else None, at() if i % 37 else None) for i in range(300)]
    rules = [(f"r{i}", at() if i % 41 else None, at() if i % 43 else None, [] if i % 3 else [int(x) for x in rng.integers(0, 6, 3)]) for i in range(400)]
    s = spark.createDataFrame(sites, "site_id int, sector_id int, confidence double, area_m2 double")
    r = spark.createDataFrame(rules, "rule_id string, min_confidence double, min_area_m2 double, regions array<int>")
    got = [(x.site_id, x.rule_id) for x in relations.fired_rules(s, r, slots=slots).collect()]
    want = {(i, k) for i, g, c, a in sites for k, mc, ma, where in rules
            if None not in (c, a, mc, ma) and c >= mc and a >= ma and (not where or g in where)}
    assert len(got) == len(set(got)) and set(got) == want
    if slots == 16:
        r = r.filter("min_confidence IS NOT NULL AND min_area_m2 IS NOT NULL")
        assert relations.rule_meetings(s, r, "sector_id", slots).count() < 1.6 * len(want)


def _inside(ring, grid, height, width):
    """Even-odd test of every cell centre against every edge."""
    ring = np.asarray(ring, float)
    lon, lat = grid["a"] * (np.arange(width) + 0.5) + grid["c"], grid["e"] * (np.arange(height) + 0.5) + grid["f"]
    out = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:]):
        hit = (ay > lat) != (by > lat)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (bx - ax) * (lat - ay) / (by - ay) + ax
        out ^= hit[:, None] & (lon[None, :] < at[:, None])
    return out


@pytest.mark.parametrize("a,e", [(0.001, -0.001), (-0.001, 0.0015), (0.003, -0.002)])
def test_scan_lines_fill_what_is_inside(spark, a, e):
    from groundshift.operators import tiling

    grid = {"a": a, "b": 0.0, "c": 4.2, "d": 0.0, "e": e, "f": 51.9}
    rng = np.random.default_rng(7)
    rings, want = [], {}
    for i in range(30):
        n = int(rng.integers(3, 25))
        p = np.c_[4.2 + a * (rng.random(n) * 60 - 10), 51.9 + e * (rng.random(n) * 50 - 10)]  # crossing itself and the border
        if i % 4 == 0:  # on centres and borders of cells
            p = np.c_[4.2 + a * np.round(rng.random(n) * 40 * 2) / 2, 51.9 + e * np.round(rng.random(n) * 30 * 2) / 2]
        ring = np.vstack([p, p[:1]]).tolist()
        rings += [(i % 3, ring)] * (1 + i % 2)
        want[i % 3] = want.get(i % 3, False) | _inside(ring, grid, 30, 40)
    rings += [(0, None), (0, []), (1, [[4.2, 51.9]])]
    df = spark.createDataFrame(rings, "k int, ring array<array<double>>")
    got = tiling.rasterise(df, grid, 30, 40, keys=["k"]).collect()
    assert len(got) == len(set(got)) and {(r.k, r.y, r.x) for r in got} == {(k, y, x) for k, m in want.items() for y, x in zip(*np.nonzero(m))}


def test_ring_of_a_hundred_thousand_vertices(spark):
    from groundshift.operators import tiling

    t = np.linspace(0, 2 * np.pi, 100_000)
    r = 0.02 * (1 + 0.3 * np.cos(9 * t))
    ring = np.c_[4.23 + r * np.cos(t), 51.87 + r * np.sin(t)]
    ring[-1] = ring[0]
    grid = {"a": 0.0002, "b": 0.0, "c": 4.2, "d": 0.0, "e": -0.0002, "f": 51.9}
    got = tiling.rasterise(spark.createDataFrame([(ring.tolist(),)], "ring array<array<double>>"), grid, 300, 300).toPandas()
    mask = np.zeros((300, 300), bool)
    mask[got["y"], got["x"]] = True
    assert (mask == _inside(ring[::1], grid, 300, 300)).all()


def test_stored_tiles_are_aligned_in_place(spark, tables):
    """Stack, pair and mask over a bucketed table, and the join of two tables, without an exchange; the rows are those of the shuffled way."""
    from contract.fixtures import BANDS
    from groundshift.operators import raster
    from groundshift.session import run_dir
    from groundshift.sources import tilestore

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = [f"tiles_{i}" for i in range(3)]
    newest = tables.band_tiles.agg(F.max("step")).first()[0] - 1
    parts = [tables.band_tiles, tables.band_tiles.filter(F.col("step") == newest), tables.band_tiles.filter(F.col("step") == newest - 1)]
    for name, part in zip(names, parts):
        tilestore.write_tiles(part, name, run_dir(spark, name), buckets=4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables too large to broadcast
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        stack = tilestore.scene_stack(spark, names[0], BANDS, extra=["scene", "h", "w"])
        cells = raster.change_cells(tilestore.scene_pairs(spark, names[0], BANDS, extra=["h", "w"]), 8)
        joined = tilestore.join_stores(spark, names[1], names[2], BANDS, extra=["h", "w"])
        for df in (stack, raster.mask_tiles(cells, "anomaly", 8), joined):
            assert "Exchange" not in plan(df)
        key = lambda df: sorted(map(str, df.select("ty", "tx", "step", "red", "nir", "swir").collect()))
        assert key(stack) == key(tables.tiles)
        want = raster.change_cells(raster.previous_scene(tables.tiles, list(BANDS)), 8)
        cols = ["step", "y", "x", "delta_ndvi", "anomaly"]
        assert sorted(map(str, cells.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
        pair = raster.previous_scene(tables.tiles, list(BANDS)).filter(F.col("step") == newest)
        assert sorted(map(str, joined.select("ty", "tx", "red", "red_t0").collect())) == sorted(map(str, pair.select("ty", "tx", "red", "red_t0").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE {name}")


def test_rank_error_of_sketches(spark):
    from groundshift.operators import raster

    rng = np.random.default_rng(1)
    rows = [(g, s, float(v)) for g in range(2) for s in range(5) for v in rng.gamma(2 + g, 1 + s, 8000)]
    df = spark.createDataFrame(rows + [(0, 0, None)], "g int, scene int, v double")
    sketches = stage(raster.percentile_sketches(df, ["g", "scene"], "v", 512), "sketches")
    assert raster.sketch_rank_error(512) < 0.01 and raster.sketch_rank_error() < 0.0014
    for q in (0.05, 0.5, 0.9, 0.99):
        for r in raster.sketched_percentile(sketches, ["g"], q, k=512).collect():  # merged over scenes
            values = np.array([v for g, _, v in rows if g == r.g])
            assert r.n == len(values) and abs((values <= r.pct).mean() - q) <= raster.sketch_rank_error(512)


def test_windows_are_scored_in_one_worker_from_frames_of_bounded_size(spark, tables):
    """Putting together, scoring and cutting again are one step, so a task has one Python worker for the three."""
    from contract import q_shapes
    from groundshift.operators import scorer, tiling

    tiles = stage(q_shapes._feature_tiles(tables).select("area", "step", "ty", "tx", "h", "w", "values"), "tiles")
    assert str(detection.score_scene(tiles, layout(), size=12, stride=8)._jdf.queryExecution().executedPlan()).count("MapIn") == 3
    score = scorer.scoring(["area", "step", "y0", "x0"])
    apart = scorer.score_tiles(tiling.cut_windows(tiles, ["area", "step"], 8, 32, 32, 6, 12, 8), ["area", "step", "y0", "x0"])
    together = tiling.score_windows(tiles, ["area", "step"], 8, 32, 32, 6, score, 12, 8)
    assert sorted(apart.collect()) == sorted(together.collect())
    mean = tiling.overlap_mean(apart, tiles, ["area", "step"], 8, 12)
    assert sorted(mean.collect()) == sorted(tiling.overlap_scores(tiles, ["area", "step"], 8, 32, 32, 6, score, 12, 8).collect())
    frames = list(tiling._framed(((i, np.zeros(1 << 17)) for i in range(9)), ["i", "v"]))
    assert [len(f) for f in frames] == [4, 4, 1]

    def told(parts):
        for pdf in parts:
            yield pdf[["id"]].assign(n=len(pdf))

    assert max(r.n for r in tiling.mapped(spark.range(0, 5000, 1, 1), ["id"], told, {"n": "int"}).collect()) == 256


def test_outlines_are_traced_once(spark):
    """Filters on what tracing found make no second Python step, and rings put together from arrays of coordinates have their corners."""
    from groundshift.operators import components

    rows = [("m", 0, ty, tx, 8, 8, [1] * 64) for ty in (0, 1) for tx in (0, 1, 3)]
    tiles = spark.createDataFrame(rows, "area string, step int, ty int, tx int, h int, w int, mask array<tinyint>")
    cells = components.label_cells(tiles, ["area", "step"], 8, 32)
    p = components.polygonise(cells, ["area", "step"], 0.0, 10.0).filter(F.col("n_vertices") >= 3)
    assert str(p._jdf.queryExecution().executedPlan()).count("trace(") == 1
    got = {r.component: r.ring for r in p.collect()}
    assert got == {0: [[0.0, 0.0], [15.0, 0.0], [15.0, 15.0], [0.0, 15.0], [0.0, 0.0]], 24: [[24.0, 0.0], [31.0, 0.0], [31.0, 15.0], [24.0, 15.0], [24.0, 0.0]]}
