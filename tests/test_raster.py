import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundshift.functions import indices
from groundshift.operators import components, raster, stencils, tiling
from groundshift.sources import catalogue

TILE = 8


def tiled(spark, images, tile=TILE, name="mask", kind="tinyint"):
    """Cut 2-D arrays (one per step) into tile rows."""
    rows = []
    for step, img in enumerate(images):
        h, w = img.shape
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                b = img[y:y + tile, x:x + tile]
                rows.append(("a", step, y // tile, x // tile, b.shape[0], b.shape[1], [v.item() for v in b.ravel()]))
    return spark.createDataFrame(rows, f"area string, step int, ty int, tx int, h int, w int, {name} array<{kind}>")


def untile(rows, shape, value):
    out = np.full(shape, -1.0)
    for r in rows:
        out[r["y"], r["x"]] = np.nan if r[value] is None else r[value]
    return out


def flood(mask):
    """Plain flood fill: smallest flat index per 8-connected component."""
    h, w = mask.shape
    lab = np.full(mask.shape, -1)
    for y in range(h):
        for x in range(w):
            if mask[y, x] and lab[y, x] < 0:
                todo = [(y, x)]
                lab[y, x] = y * w + x
                while todo:
                    a, b = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            p, q = a + dy, b + dx
                            if 0 <= p < h and 0 <= q < w and mask[p, q] and lab[p, q] < 0:
                                lab[p, q] = y * w + x
                                todo.append((p, q))
    return lab


def masks():
    rng = np.random.default_rng(7)
    snake = np.zeros((24, 24), dtype=bool)
    snake[::4] = True
    for i in range(0, 24, 8):
        snake[i:i + 5, 23] = True
        snake[i + 4:i + 9, 0] = True
    cross = np.zeros((24, 24), dtype=bool)
    cross[6:10, 6:10] = True  # meets four tiles
    diag = np.eye(24, dtype=bool)
    hole = np.ones((24, 24), dtype=bool)
    hole[5:18, 5:18] = False
    hole[10:12, 10:12] = True
    return [rng.random((24, 24)) < p for p in (0.2, 0.35, 0.5)] + [snake, cross, diag, hole]


def test_components_equal_flood_fill(spark):
    imgs = masks()
    got = components.label_cells(tiled(spark, [m.astype(np.int8) for m in imgs]), ["area", "step"], TILE, 24).collect()
    for step, m in enumerate(imgs):
        lab = np.full(m.shape, -1)
        for r in got:
            if r["step"] == step:
                lab[r["y"], r["x"]] = r["component"]
        assert np.array_equal(lab, flood(m)), step


def test_outlines_of_solid_blocks(spark):
    imgs = []
    for n, m in [(4, 4), (3, 9), (12, 5), (1, 6)]:
        a = np.zeros((24, 24), dtype=np.int8)
        a[5:5 + n, 6:6 + m] = 1
        imgs.append(a)
    holed = np.zeros((24, 24), dtype=np.int8)
    holed[2:20, 3:22] = 1
    holed[5:15, 6:12] = 0
    imgs.append(holed)
    p = components.polygonise(components.label_cells(tiled(spark, imgs), ["area", "step"], TILE, 24), ["area", "step"], 0.01).collect()
    got = {r["step"]: r for r in p}
    assert {k: r["contour_px"] for k, r in got.items()} == {0: 9.0, 1: 16.0, 2: 44.0, 3: 0.0, 4: 17.0 * 18.0}
    assert got[0]["n_vertices"] == 4 and got[0]["ring"][0] == got[0]["ring"][-1]
    assert got[2]["perimeter_px"] == 2 * (11 + 4)


@pytest.mark.parametrize("tolerance", [0.0, 0.02])
def test_large_outlines_equal_traced_ones(spark, tolerance):
    """The distributed walk gives the ring the in-task trace gives, on noise, snakes, holes and single cells."""
    cells = components.label_cells(tiled(spark, [m.astype(np.int8) for m in masks()]), ["area", "step"], TILE, 24)
    traced = components.polygonise(cells, ["area", "step"], tolerance).filter("n_cells > 1").collect()
    spread = components.polygonise(cells, ["area", "step"], tolerance, in_task=0).filter("n_cells > 1").collect()
    by = lambda rows: {(r["step"], r["component"]): r for r in rows}
    a, b = by(traced), by(spread)
    assert a.keys() == b.keys() and len(a) > 20
    for k in a:
        assert a[k]["contour_px"] == b[k]["contour_px"] and a[k]["perimeter_px"] == pytest.approx(b[k]["perimeter_px"])
        assert a[k]["ring"] == b[k]["ring"], k


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.3, 0.9))
def test_outline_encloses_its_component(seed, density):
    m = np.random.default_rng(seed).random((12, 12)) < density
    lab = flood(m)
    for comp in np.unique(lab[lab >= 0]):
        ys, xs = np.nonzero(lab == comp)
        border = components.outline_cells(lab == comp)
        by, bx = np.nonzero(border)
        path = components.trace_outline(by, bx)
        assert path == components.trace_outline(ys, xs)  # interior cells never matter
        assert path[0] == (ys[0], xs[0])
        cells = set(zip(ys.tolist(), xs.tolist()))
        assert set(path) <= cells
        assert {min(ys), max(ys)} <= {p[0] for p in path} and {min(xs), max(xs)} <= {p[1] for p in path}
        steps = np.abs(np.diff(np.array(path + path[:1]), axis=0)).max(axis=1) if len(path) > 1 else np.array([1])
        assert steps.max() == 1


def test_simplified_ring_stays_close():
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    pts = np.c_[50 * np.cos(t), 50 * np.sin(t)]
    ring = components.simplify_ring(pts, 1.0)
    assert 8 <= len(ring) < 60
    assert components._shoelace(ring) > 0.95 * np.pi * 2500


def brute_morph(mask):
    known = np.ones_like(mask)
    for op in (max, min, min, max):
        out = np.zeros_like(mask)
        for y in range(mask.shape[0]):
            for x in range(mask.shape[1]):
                near = [mask[y + dy, x + dx] for dy, dx in stencils.ELLIPSE_5 if 0 <= y + dy < mask.shape[0] and 0 <= x + dx < mask.shape[1]]
                out[y, x] = op(near)
        mask = out
    return mask & known


def test_morphology_across_seams_and_ragged_border(spark):
    rng = np.random.default_rng(3)
    imgs = [rng.random((21, 27)) < p for p in (0.3, 0.6)]
    out = stencils.clean_mask(tiled(spark, [m.astype(np.int8) for m in imgs]), ["area", "step"], TILE)
    rows = raster.cells(out, ["mask"], TILE).collect()
    for step, m in enumerate(imgs):
        got = untile([r for r in rows if r["step"] == step], m.shape, "mask")
        assert np.array_equal(got > 0, brute_morph(m))


def test_morphology_refuses_tiles_smaller_than_its_reach(spark):
    with pytest.raises(ValueError):
        stencils.clean_mask(tiled(spark, [np.ones((8, 8), dtype=np.int8)], tile=4), ["area", "step"], 4)


@pytest.mark.parametrize("src,dst", [((10, 12), (20, 24)), ((20, 24), (13, 17)), ((9, 9), (31, 20))])
def test_bilinear_resample(spark, src, dst):
    img = np.random.default_rng(1).random(src)
    out = stencils.resample(tiled(spark, [img], name="v", kind="double"), "v", ["area", "step"], TILE, src, dst)
    got = untile(raster.cells(out, ["v"], TILE).collect(), dst, "v")

    def at(i, n_out, n_in):
        s = (i + 0.5) * n_in / n_out - 0.5
        lo = int(np.floor(s))
        return min(max(lo, 0), n_in - 1), min(max(lo + 1, 0), n_in - 1), s - lo

    exp = np.empty(dst)
    for y in range(dst[0]):
        for x in range(dst[1]):
            (a, b, f), (c, d, g) = at(y, dst[0], src[0]), at(x, dst[1], src[1])
            exp[y, x] = (1 - f) * ((1 - g) * img[a, c] + g * img[a, d]) + f * ((1 - g) * img[b, c] + g * img[b, d])
    assert np.allclose(got, exp)


@pytest.mark.parametrize("n,q", [(5, 0.9), (1, 0.9), (1000, 0.5), (60000, 0.9), (60000, 0.0), (60000, 1.0)])
def test_exact_percentile(spark, n, q):
    v = np.round(np.random.default_rng(n).normal(size=n), 3)
    df = spark.createDataFrame([("k", float(x)) for x in v], "k string, v double")
    got = raster.exact_percentile(df, ["k"], "v", q, accuracy=1000).first()["pct"]
    assert got == pytest.approx(np.percentile(v, q * 100), abs=1e-12)


def test_tile_algebra_equals_cell_algebra(spark, tables):
    cells = raster.with_indices(tables.cells).select("step", "y", "x", "ndvi")
    t = tables.tiles.withColumn("nd", raster.tile_algebra([F.col("nir"), F.col("red")], indices.ndvi))
    arr = raster.cells(t, ["nd"], TILE).select("step", "y", "x", "nd")
    both = cells.join(arr, ["step", "y", "x"])
    assert both.count() == cells.count() > 0
    assert both.filter("ndvi <> nd").count() == 0


def test_whole_stack_uses_one_exchange(spark, tables):
    """Band alignment, scene pairs, per-cell windows and cell histories all run on the tile-address partitioning."""
    from groundshift.operators import timeseries

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan

    c = raster.with_indices(tables.cells).withColumn("swir_enh", F.col("swir"))
    by_cell = timeseries.running_anomalies(timeseries.step_flags(timeseries.differences(c)))
    n, plan = exchanges(timeseries.cell_history(by_cell))
    assert n == 1, plan
    top = spark.createDataFrame([("mosaic", 0.5)], "area string, swir_max double")
    steps = timeseries.step_flags(timeseries.tile_differences(tables.tiles, TILE, top))
    n, plan = exchanges(timeseries.cell_history(steps))
    assert n == 1 and plan.count("+- Sort ") == 1, plan


def test_tile_differences_equal_cell_differences(spark, tables):
    from groundshift.operators import timeseries
    a = timeseries.differences(raster.with_swir_enhanced(tables.tiles, ["red", "nir", "swir"], TILE, ["area"]))
    b = timeseries.tile_differences(tables.tiles, TILE, raster.stack_max(tables.tiles, "swir", ["area"]))
    cols = ["step", "y", "x", "k", "d_ndvi", "d_swir"]
    assert a.select(*cols).exceptAll(b.select(*cols)).isEmpty() and a.count() == b.count() > 0


def test_missing_band_drops_or_fails(spark):
    rows = [("a", 0, 0, 0, "0", [1.0]), ("a", 0, 0, 0, "1", [1.0]), ("a", 1, 0, 0, "0", [2.0])]
    df = spark.createDataFrame(rows, "area string, step int, ty int, tx int, band string, data array<double>")
    assert raster.align_bands(df, {"vv": "0", "vh": "1"}).count() == 1
    with pytest.raises(Exception, match="required band missing"):
        raster.align_bands(df, {"vv": "0", "vh": "1"}, strict=True).collect()


def test_grid_mismatch_fails(spark):
    mk = lambda n: spark.createDataFrame([("a", 0, 0, [1.0] * n)], "area string, ty int, tx int, red array<double>")
    with pytest.raises(Exception, match="grids differ"):
        raster.pair_scenes(mk(3), mk(4), ["red"]).collect()


def test_window_starts(spark):
    row = spark.range(1).select(tiling.starts(F.lit(32), 12, 8).alias("a"), tiling.starts(F.lit(28), 12, 8).alias("b"),
                                tiling.starts(F.lit(10), 12, 8).alias("c"), tiling.starts(F.lit(32), 12, 8, False).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ([0, 8, 16, 20], [0, 8, 16], [], [0, 8, 16])


@pytest.mark.parametrize("edge", [True, False])
def test_membership_equals_window_scan(spark, edge):
    n, size, stride = 29, 12, 5
    cells = spark.range(n).select(F.col("id").cast("int").alias("y"), F.lit(3).alias("x"))
    got = {(r["y"], r["y0"]) for r in tiling.tile_membership(cells, F.lit(n), F.lit(n), size, stride, edge).collect()}
    begins = list(range(0, n - size + 1, stride))
    if edge and begins[-1] + size < n:
        begins.append(n - size)
    assert got == {(y, b) for b in begins for y in range(b, b + size)}


def test_latest_pair_edge_rows(spark):
    rows = [("a", 1, "2024-01-01"), ("a", 2, "2024-02-01"), ("a", 3, None), ("b", 4, "2024-01-01"), ("c", 5, None), ("c", 6, "2024-01-01")]
    df = spark.createDataFrame(rows, "area string, scene_id int, d string").withColumn("ts", F.to_timestamp("d"))
    got = {r["area"]: (r["scene_t1"], r["scene_t0"]) for r in catalogue.latest_pair(df, ["area"]).collect()}
    assert got == {"a": (2, 1), "c": (6, 5)}
    with pytest.raises(ValueError):
        catalogue.require_revisits(df.filter("area = 'b'"))


def test_search_pushes_predicates_to_the_scan(spark, tmp_path):
    from groundshift import schemas
    path = str(tmp_path / "scenes")
    spark.createDataFrame([], schemas.SCENES).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    found = catalogue.search_optical(spark.read.parquet(path), (0, 0, 1, 1), "2024-01-01", "2024-01-31", 30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for c in ("collection", "cloud_cover", "min_lon", "max_lat", "ts"):
        assert c in pushed


def test_rank_limit_runs_before_the_shuffle(spark, tables):
    from groundshift.operators import summaries
    top = summaries.top_per_group(tables.scored.select("sector_id", "site_id", "risk_score"), ["sector_id"], [F.col("risk_score").desc(), F.col("site_id")], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_lookups_are_broadcast_only_below_the_threshold(spark):
    from groundshift.session import attach
    big, small = spark.range(1000).withColumn("k", F.col("id") % 10), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = lambda: attach(big, small, ["k"])._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16")
    try:
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_staging_needs_a_shared_folder():
    from groundshift import session

    class Conf:
        def get(self, k, d=None):
            return d

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"getCheckpointDir": lambda self: self.given, "given": None})()

    with pytest.raises(RuntimeError):
        session.shared_root(Fake())
    Fake.sparkContext.given = "hdfs:///shared/"
    assert session.shared_root(Fake()) == "hdfs:///shared"
