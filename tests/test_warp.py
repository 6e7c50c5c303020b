import numpy as np
import pytest

from groundshift.operators import warp
from groundshift.plans import detection

DEG = warp.Grid(16, 61, 50, (0.002, 0.0, 4.2, 0.0, -0.002, 52.0))


def mercator_grid(step=190.0, tile=16):
    """Covers DEG with a margin."""
    x0, y0 = warp.forward(np.array(4.19), 0), warp.forward(np.array(52.01), 1)
    x1, y1 = warp.forward(np.array(4.34), 0), warp.forward(np.array(51.88), 1)
    return warp.Grid(tile, int((x1 - x0) / step) + 1, int((y0 - y1) / step) + 1, (step, 0.0, float(x0), 0.0, -step, float(y0)), warp.MERCATOR)


def centres(g):
    lon, lat = (g.axis(k)[1] + g.axis(k)[0] * (np.arange(g.axis(k)[2]) + 0.5) for k in (0, 1))
    if g.crs == warp.MERCATOR:
        lon, lat = warp.inverse(lon, 0), warp.inverse(lat, 1)
    return lon, lat


def cut(spark, img, tile, kind="double", without=()):
    rows = []
    for ty in range(-(-img.shape[0] // tile)):
        for tx in range(-(-img.shape[1] // tile)):
            part = img[ty * tile:(ty + 1) * tile, tx * tile:(tx + 1) * tile]
            if (ty, tx) not in without:
                rows.append(("m", 0, ty, tx, *part.shape, [None if v != v else (int(v) if kind == "tinyint" else float(v)) for v in part.ravel()]))
    return spark.createDataFrame(rows, f"area string, step int, ty int, tx int, h int, w int, v array<{kind}>")


def joined(df, g):
    out = np.full((g.height, g.width), np.nan)
    for r in df.collect():
        out[r.ty * g.tile:r.ty * g.tile + r.h, r.tx * g.tile:r.tx * g.tile + r.w] = np.array(r.v, dtype=float).reshape(r.h, r.w)
    return out


def test_round_trip_of_coordinates():
    v = np.linspace(-80, 80, 33)
    for k in (0, 1):
        assert np.allclose(warp.inverse(warp.forward(v, k), k), v)


@pytest.mark.parametrize("tile", [16, 7])
def test_warp_against_bilinear_sampling_of_the_whole_image(spark, tile):
    src = mercator_grid(tile=tile)
    rng = np.random.default_rng(tile)
    img = rng.random((src.height, src.width))
    img[20, 20] = np.nan
    got = joined(warp.warp(cut(spark, img, tile), "v", ["area", "step"], src, DEG), DEG)
    y, x = warp._places(src, DEG, 1), warp._places(src, DEG, 0)
    a, b, fy, fx = np.floor(y).astype(int), np.floor(x).astype(int), (y % 1)[:, None], (x % 1)[None]
    want = sum(wy * wx * img[np.ix_(r, c)] for r, wy in ((a, 1 - fy), (a + 1, fy)) for c, wx in ((b, 1 - fx), (b + 1, fx)))
    assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want)) < 1e-12 and np.isnan(got).any()


def test_smooth_surface_and_missing_tiles(spark):
    src = mercator_grid()
    lon, lat = centres(src)
    img = np.sin(40 * lon)[None] * np.cos(30 * lat)[:, None]
    got = joined(warp.warp(cut(spark, img, src.tile, without={(0, 0)}), "v", ["area", "step"], src, DEG), DEG)
    lon, lat = centres(DEG)
    want = np.sin(40 * lon)[None] * np.cos(30 * lat)[:, None]
    assert np.isnan(got[0, 0]) and np.nanmax(np.abs(got - want)) < 2e-3
    # outside the source nothing is made up
    far = warp.Grid(16, 20, 20, (0.002, 0.0, 4.33, 0.0, -0.002, 52.0))
    out = joined(warp.warp(cut(spark, img, src.tile), "v", ["area", "step"], src, far), far)
    assert not np.isnan(out[10, 0]) and np.isnan(out[:, -1]).all()


def test_polygons_of_a_mercator_grid(spark):
    """Masks of one place on both grids give the same sites within a cell, in degrees."""
    rings = {}
    for g in (DEG, mercator_grid()):
        lon, lat = centres(g)
        disc = ((lon[None] - 4.25) / 0.02) ** 2 + ((lat[:, None] - 51.95) / 0.012) ** 2 < 1
        box = (np.abs(lon - 4.30) < 0.008)[None] & (np.abs(lat - 51.93) < 0.006)[:, None]
        masks = cut(spark, (disc | box).astype(float), g.tile, "tinyint").withColumnRenamed("v", "mask")
        layout = detection.Layout(g.tile, g.width, g.height, g.affine, g.crs)
        found = detection.vectorise(masks, layout, detection.Limits(tolerance=0.0, min_px=1.0)).collect()
        rings[g.crs] = sorted((np.array(r.ring) for r in found), key=lambda r: r[0, 0])
        areas = sorted(r.area_m2 for r in found)
        assert len(found) == 2 and areas[0] > 1e6
        inside = detection.within(masks, [4.249, 51.949, 4.251, 51.951], layout).select("ty", "tx").collect()
        assert len(inside) >= 1
        mid = [(int(np.searchsorted(-lat, -51.95)) // g.tile, int(np.searchsorted(lon, 4.25)) // g.tile)]
        assert set(mid) <= {(r.ty, r.tx) for r in inside}
    for p, q in zip(*rings.values()):
        assert np.abs(p.min(0) - q.min(0)).max() < 0.002 and np.abs(p.max(0) - q.max(0)).max() < 0.002


def test_unknown_systems_are_refused():
    with pytest.raises(ValueError):
        detection.Layout(8, 8, 8, (1, 0, 0, 0, -1, 0), "EPSG:32631")
