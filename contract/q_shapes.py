"""Stencils, components, polygons, overlap, tiling, scoring and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.functions import geometry, scoring
from groundshift.operators import components, filters, overlap, raster, scorer, stencils, tiling

from .fixtures import SIDE, TILE
from .registry import query, rnd

_YX = ["step", "y", "x"]
_KEYS = ["area", "step"]
GRID = {"a": 0.001, "b": 0.0, "c": 4.2, "d": 0.0, "e": -0.001, "f": 51.95}


# ---- resampling -------------------------------------------------------------------------------------------

_HALF = "half AS (SELECT step, y // 2 AS y, x // 2 AS x, swir AS v FROM cells WHERE y % 2 = 0 AND x % 2 = 0)"
_AXIS = "(SELECT i, least(greatest(CAST(floor((i+0.5)*0.5-0.5) AS INTEGER), 0), 15) AS lo, least(greatest(CAST(floor((i+0.5)*0.5-0.5) AS INTEGER)+1, 0), 15) AS hi, (i+0.5)*0.5-0.5 - floor((i+0.5)*0.5-0.5) AS f FROM (SELECT unnest(range(32)) AS i))"
_BILINEAR = f"""
WITH {_HALF}, ax AS {_AXIS}, st AS (SELECT DISTINCT step FROM half)
SELECT st.step, ay.i AS y, ax.i AS x, round((1-ay.f)*(1-ax.f)*a.v + (1-ay.f)*ax.f*b.v + ay.f*(1-ax.f)*c.v + ay.f*ax.f*d.v, 9) AS v
FROM st, ax ay, ax ax JOIN half a ON a.step = st.step AND a.y = ay.lo AND a.x = ax.lo JOIN half b ON b.step = st.step AND b.y = ay.lo AND b.x = ax.hi
JOIN half c ON c.step = st.step AND c.y = ay.hi AND c.x = ax.lo JOIN half d ON d.step = st.step AND d.y = ay.hi AND d.x = ax.hi"""


def _half_tiles(t):
    """Every second cell of SWIR, re-tiled on the 16 x 16 grid; cells that the last, partial step lacks are null."""
    c = t.cells.filter("y % 2 = 0 and x % 2 = 0").withColumns({"y": F.floor(F.col("y") / 2).cast("int"), "x": F.floor(F.col("x") / 2).cast("int")})
    c = c.withColumns({"ty": F.floor(F.col("y") / TILE).cast("int"), "tx": F.floor(F.col("x") / TILE).cast("int")})
    at = (F.col("y") % TILE * TILE + F.col("x") % TILE).cast("int")
    g = c.groupBy(*_KEYS, "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct(at, "swir"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda i: F.try_element_at("m", i))
    return g.select(*_KEYS, "ty", "tx", F.lit(TILE).alias("h"), F.lit(TILE).alias("w"), whole.alias("swir"))


def _resampled(t):
    out = stencils.resample(_half_tiles(t), "swir", _KEYS, TILE, (16, 16), (32, 32))
    return raster.cells(out, ["swir"], TILE)


@query("ras_06", _BILINEAR, ("cells",))
def ras_06(t):
    # target cells whose source neighbours are missing (the last, partial step) come out null and are left out
    return _resampled(t).filter(F.col("swir").isNotNull()).select(*_YX, F.round("swir", 9).alias("v"))


_ALIGN = f"""
WITH {_HALF}, ax AS {_AXIS}, st AS (SELECT DISTINCT step FROM half WHERE step % 2 = 1),
r AS (SELECT st.step, ay.i AS y, ax.i AS x, (1-ay.f)*(1-ax.f)*a.v + (1-ay.f)*ax.f*b.v + ay.f*(1-ax.f)*c.v + ay.f*ax.f*d.v AS v
FROM st, ax ay, ax ax JOIN half a ON a.step = st.step AND a.y = ay.lo AND a.x = ax.lo JOIN half b ON b.step = st.step AND b.y = ay.lo AND b.x = ax.hi
JOIN half c ON c.step = st.step AND c.y = ay.hi AND c.x = ax.lo JOIN half d ON d.step = st.step AND d.y = ay.hi AND d.x = ax.hi)
SELECT step, count(*) AS n_cells, {rnd('sum(v)', 6)} AS total FROM (SELECT step, y, x, v FROM r UNION ALL SELECT step, y, x, swir FROM cells WHERE step % 2 = 0) GROUP BY step"""


@query("ras_07", _ALIGN, ("cells",))
def ras_07(t):
    """Odd scenes come on a coarser grid and are brought to the grid of the earliest scene."""
    fine = t.tiles.filter("step % 2 = 0").select(*_KEYS, "ty", "tx", "h", "w", "swir", F.lit(32).alias("rows"), F.lit(32).alias("cols"))
    coarse = _half_tiles(t).filter("step % 2 = 1").withColumns({"rows": F.lit(16), "cols": F.lit(16)})
    grids = stencils.reference_grids(fine.unionByName(coarse, allowMissingColumns=True), "area", "step", ["rows", "cols"])
    ref = grids.first()  # one row per area; one area here
    aligned = stencils.resample(coarse, "swir", _KEYS, TILE, (16, 16), (ref["rows"], ref["cols"]))
    both = fine.select(*_KEYS, "ty", "tx", "h", "w", "swir").unionByName(aligned)
    c = raster.cells(both, ["swir"], TILE).filter(F.col("swir").isNotNull())
    return c.groupBy("step").agg(F.count("*").alias("n_cells"), F.round(F.sum("swir"), 6).alias("total"))


# ---- morphology and components ---------------------------------------------------------------------------------

_KERNEL = "k AS (SELECT * FROM (VALUES " + ",".join(f"({a},{b})" for a, b in stencils.ELLIPSE_5) + ") v(dy, dx))"


def _pass(name: str, src: str, fn: str) -> str:
    return (f"{name} AS (SELECT c.step, c.y, c.x, {fn}(n.m) AS m FROM {src} c, k JOIN {src} n ON n.step = c.step AND n.y = c.y + k.dy AND n.x = c.x + k.dx GROUP BY c.step, c.y, c.x)")


_MORPH = (f"WITH {_KERNEL}, m0 AS (SELECT step, y, x, CASE WHEN swir > 0.2::DOUBLE THEN 1 ELSE 0 END AS m FROM cells), "
          + ", ".join([_pass("m1", "m0", "max"), _pass("m2", "m1", "min"), _pass("m3", "m2", "min"), _pass("m4", "m3", "max")]))


@query("ras_12", _MORPH + " SELECT step, y, x, m AS mask FROM m4", ("cells",))
def ras_12(t):
    out = stencils.clean_mask(t.bright_tiles, _KEYS, TILE)
    return raster.mask_cells(out, TILE).select(*_YX, F.col("mask").cast("int").alias("mask"))


_CC = """
WITH RECURSIVE t AS (SELECT step, y, x, y*32 + x AS id FROM cells WHERE swir > 0.2::DOUBLE),
e AS (SELECT a.step, a.id AS a, b.id AS b FROM t a JOIN t b ON a.step = b.step AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(step, a, b) AS (SELECT step, id, id FROM t UNION SELECT r.step, r.a, e.b FROM r JOIN e ON e.step = r.step AND e.a = r.b),
comp AS (SELECT r.step, t.y, t.x, min(r.b) AS component FROM r JOIN t ON t.step = r.step AND t.id = r.a GROUP BY 1, 2, 3)
"""


_TURN = "(({c}) + list_filter([0,1,2,3,4,5,6,7], lambda i: (({m}) >> ((({c}) + i) % 8)) & 1 = 1)[1]) % 8"

# Outlines in SQL, following the border of every component of the cells t(step, y, x) cell by cell.
OUTLINE_SQL = f"""
e AS (SELECT a.step, a.y*32 + a.x AS a, b.y*32 + b.x AS b FROM t a JOIN t b ON a.step = b.step AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(step, a, b) AS (SELECT step, y*32 + x, y*32 + x FROM t UNION SELECT r.step, r.a, e.b FROM r JOIN e ON e.step = r.step AND e.a = r.b),
comp AS (SELECT step, a // 32 AS y, a % 32 AS x, min(b) AS component FROM r GROUP BY 1, 2, 3),
dirs AS (SELECT * FROM (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1),(4,0,-1),(5,-1,-1),(6,-1,0),(7,-1,1)) v(d, dy, dx)),
nb AS (SELECT a.step, a.y, a.x, CAST(sum(1 << d) AS INTEGER) AS mask FROM (SELECT t.*, dirs.* FROM t, dirs) a JOIN t b ON b.step = a.step AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3),
s0 AS (SELECT c.step, c.component, nb.y, nb.x, {_TURN.format(c='4', m='mask')} AS d FROM (SELECT DISTINCT step, component FROM comp) c
  JOIN nb ON nb.step = c.step AND nb.y = component // 32 AND nb.x = component % 32),
w(step, component, n, y, x, d, y0, x0, d0) AS (
  SELECT step, component, 0, y, x, d, y, x, d FROM s0
  UNION ALL
  SELECT step, component, n + 1, y, x, d, y0, x0, d0 FROM (
    SELECT w.step, component, n, nb.y, nb.x, {_TURN.format(c='w.d + 6', m='nb.mask')} AS d, y0, x0, d0
    FROM w JOIN dirs ON dirs.d = w.d JOIN nb ON nb.step = w.step AND nb.y = w.y + dy AND nb.x = w.x + dx)
  WHERE NOT (y = y0 AND x = x0 AND d = d0)),
walk AS (SELECT w.*, y + dy AS y2, x + dx AS x2, coalesce(lag(w.d) OVER (PARTITION BY step, component ORDER BY n), last_value(w.d) OVER (PARTITION BY step, component ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS come
  FROM w JOIN dirs ON dirs.d = w.d),
outline AS (SELECT step, component, abs(sum(x*y2 - x2*y))/2.0 AS contour_px, sum(CASE WHEN d % 2 = 1 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END) AS perimeter_px,
  count(*) FILTER (come <> d) AS n_vertices, string_agg('[' || x || '.0,' || y || '.0]', ',' ORDER BY n) FILTER (come <> d) AS pts FROM walk GROUP BY 1, 2),
extent AS (SELECT step, component, count(*) AS n_cells, (max(y) - min(y))*(max(x) - min(x)) AS box_px FROM comp GROUP BY 1, 2),
poly AS (SELECT x.step, x.component, n_cells, box_px, coalesce(contour_px, 0) AS contour_px, coalesce(perimeter_px, 0) AS perimeter_px, coalesce(n_vertices, 1) AS n_vertices,
  '[' || coalesce(pts, '[' || (x.component % 32) || '.0,' || (x.component // 32) || '.0]') || ',' || coalesce(split_part(pts, ']', 1) || ']', '[' || (x.component % 32) || '.0,' || (x.component // 32) || '.0]') || ']' AS ring
  FROM extent x LEFT JOIN outline o ON o.step = x.step AND o.component = x.component)
"""

# Mercator and degree measures of the corner rings above.
MEASURE_SQL = """
corner AS (SELECT step, component, n, 4.2::DOUBLE + 0.001::DOUBLE*x AS lon, 51.95::DOUBLE - 0.001::DOUBLE*y AS lat FROM walk WHERE come <> d),
cyc AS (SELECT *, coalesce(lead(lon) OVER z, first_value(lon) OVER z) AS lon2, coalesce(lead(lat) OVER z, first_value(lat) OVER z) AS lat2,
  first_value(lon) OVER z AS lon0, first_value(lat) OVER z AS lat0 FROM corner WINDOW z AS (PARTITION BY step, component ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
proj AS (SELECT step, component, lon - lon0 AS ax, lat - lat0 AS ay, lon2 - lon0 AS bx, lat2 - lat0 AS by_, lon0, lat0,
  6378137.0*radians(lon - lon0) AS mx, 6378137.0*(ln(tan(pi()/4 + radians(lat)/2)) - ln(tan(pi()/4 + radians(lat0)/2))) AS my,
  6378137.0*radians(lon2 - lon0) AS mx2, 6378137.0*(ln(tan(pi()/4 + radians(lat2)/2)) - ln(tan(pi()/4 + radians(lat0)/2))) AS my2 FROM cyc),
size AS (SELECT step, component, abs(sum(mx*my2 - mx2*my))/2 AS area, sum(ax*by_ - bx*ay)/2 AS deg2,
  any_value(lon0) + sum((ax+bx)*(ax*by_ - bx*ay))/nullif(3*sum(ax*by_ - bx*ay), 0) AS lon, any_value(lat0) + sum((ay+by_)*(ax*by_ - bx*ay))/nullif(3*sum(ax*by_ - bx*ay), 0) AS lat
  FROM proj GROUP BY 1, 2)
"""


def _labelled(t):
    return components.label_cells(t.bright_tiles, _KEYS, TILE, SIDE)


@query("ras_20", _CC + "SELECT step, y, x, component FROM comp", ("cells",))
def ras_20(t):
    return _labelled(t).select(*_YX, "component")


@query("agg_09", _CC + f"""
, m AS (SELECT b.step, b.y, b.x, a.ndvi AS before, b.ndvi AS after, b.ndvi - a.ndvi AS delta, b.swir FROM idx b JOIN idx a ON a.y = b.y AND a.x = b.x AND a.step = b.step - 1)
SELECT c.step, c.component, count(*) AS n_cells, round(avg(before), 9) AS ndvi_before, round(avg(after), 9) AS ndvi_after, round(avg(delta), 9) AS delta_ndvi, round(avg(swir), 9) AS swir_mean
FROM comp c JOIN m ON m.step = c.step AND m.y = c.y AND m.x = c.x GROUP BY 1, 2""", ("idx",))
def agg_09(t):
    m = raster.change_cells(raster.previous_scene(t.tiles, ["red", "nir", "swir"]), TILE)
    z = components.zonal_means(_labelled(t), m, _KEYS, ["ndvi_t0", "ndvi_t1", "delta_ndvi", "swir"])
    return z.select("step", "component", "n_cells", F.round("mean_ndvi_t0", 9).alias("ndvi_before"), F.round("mean_ndvi_t1", 9).alias("ndvi_after"),
                    F.round("mean_delta_ndvi", 9).alias("delta_ndvi"), F.round("mean_swir", 9).alias("swir_mean"))


@query("ras_18", _CC + f"""
, s AS (SELECT step, count(*) FILTER (swir > 0.2::DOUBLE) AS total_area_px, max(swir) AS max_probability, round(coalesce(avg(swir) FILTER (swir > 0.2::DOUBLE), 0), 9) AS mean_probability FROM cells GROUP BY step),
n AS (SELECT step, count(DISTINCT component) AS num_components FROM comp GROUP BY step)
SELECT s.*, coalesce(num_components, 0) AS num_components FROM s LEFT JOIN n USING (step)""", ("cells",))
def ras_18(t):
    stats = raster.mask_statistics(t.cells, ["step"], "swir", 0.2)
    n = components.component_stats(_labelled(t), _KEYS).groupBy("step").agg(F.count("*").alias("num_components"))
    out = stats.join(n, "step", "left").withColumn("num_components", F.coalesce("num_components", F.lit(0)).cast("long"))
    return out.withColumn("mean_probability", F.round("mean_probability", 9))


def _polygons(t, tolerance=0.01, min_px=0.0):
    return components.polygonise(_labelled(t), _KEYS, tolerance, min_px)


@query("ras_21", "WITH RECURSIVE t AS (SELECT step, y, x FROM cells WHERE swir > 0.2::DOUBLE), " + OUTLINE_SQL + "SELECT step, component, n_cells, contour_px, round(perimeter_px, 6) AS perimeter_px, n_vertices, ring FROM poly", ("cells",))
def ras_21(t):
    return _polygons(t, 0.0).select("step", "component", "n_cells", "contour_px", F.round("perimeter_px", 6).alias("perimeter_px"), "n_vertices", F.to_json("ring").alias("ring"))


def _far(name: str, base: str) -> str:
    return (f"{name} AS (SELECT c.step, c.component, arg_max(c.i, ((c.x-b.x)*(c.x-b.x) + (c.y-b.y)*(c.y-b.y), -c.i)) AS i FROM cor c JOIN {base} z USING (step, component) "
            "JOIN cor b ON b.step = c.step AND b.component = c.component AND b.i = z.i GROUP BY 1, 2)")


_SIMPLE = f"""
, cor AS (SELECT step, component, row_number() OVER (PARTITION BY step, component ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY step, component) AS m, x, y FROM walk WHERE come <> d),
f0 AS (SELECT step, component, i FROM cor WHERE i = 0), {_far('f1', 'f0')}, {_far('f2', 'f1')}, {_far('f3', 'f2')},
pt AS (SELECT c.step, c.component, (c.i - f3.i + m) % m AS pos, m, x, y, (f2.i - f3.i + m) % m AS bpos FROM cor c JOIN f3 USING (step, component) JOIN f2 USING (step, component)),
seg(step, component, lo, hi) AS (
  SELECT DISTINCT step, component, unnest([0, bpos]) AS lo, unnest([bpos, m]) AS hi FROM pt
  UNION ALL
  SELECT step, component, unnest([lo, s]), unnest([s, hi]) FROM (
    SELECT g.step, g.component, lo, hi, max(dist) AS md, arg_max(pos, (dist, -pos)) AS s FROM (
      SELECT s.step, s.component, s.lo, s.hi, k.pos,
        CASE WHEN p.x = q.x AND p.y = q.y THEN sqrt((k.x-p.x)*(k.x-p.x) + (k.y-p.y)*(k.y-p.y))
             ELSE abs((q.x-p.x)*(k.y-p.y) - (q.y-p.y)*(k.x-p.x))/sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)) END AS dist
      FROM seg s JOIN pt k ON k.step = s.step AND k.component = s.component AND k.pos > s.lo AND k.pos < s.hi
      JOIN pt p ON p.step = s.step AND p.component = s.component AND p.pos = s.lo
      JOIN pt q ON q.step = s.step AND q.component = s.component AND q.pos = s.hi % q.m) g GROUP BY 1, 2, 3, 4) h
  JOIN outline o USING (step, component) WHERE md > 0.01::DOUBLE*perimeter_px),
ends AS (SELECT DISTINCT step, component, lo AS pos FROM seg),
simple AS (SELECT step, component, count(*) AS nv, string_agg('[' || x || '.0,' || y || '.0]', ',' ORDER BY pos) AS pts FROM ends JOIN pt USING (step, component, pos) GROUP BY 1, 2)
SELECT p.step, p.component, contour_px, coalesce(nv, n_vertices) AS n_vertices, coalesce('[' || pts || ',' || split_part(pts, ']', 1) || ']]', ring) AS ring
FROM poly p LEFT JOIN simple USING (step, component)"""


@query("ras_22", "WITH RECURSIVE t AS (SELECT step, y, x FROM cells WHERE swir > 0.2::DOUBLE), " + OUTLINE_SQL + _SIMPLE, ("cells",))
def ras_22(t):
    return _polygons(t, 0.01).select("step", "component", "contour_px", "n_vertices", F.to_json("ring").alias("ring"))


@query("flt_06", """
SELECT site_id FROM scored WHERE estimated_tonnage/1000.0::DOUBLE >= 10 AND risk_score % 12 >= 3 AND area_m2 >= 10000""", ("scored",))
def flt_06(t):
    shaped = t.scored.withColumns({"contour_px": F.col("estimated_tonnage") / 1000.0, "n_vertices": F.col("risk_score") % 12})
    return filters.large_enough(shaped).select("site_id")


# ---- windows over an image ----------------------------------------------------------------------------------------

_STARTS = "(SELECT unnest([0, 8, 16, 20]) AS s)"
_IMAGES = "(SELECT DISTINCT step FROM cells)"


def _images(t):
    return t.tiles.groupBy("area", "step").agg(F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))


@query("ras_15", f"SELECT step, a.s AS y0, b.s AS x0 FROM {_IMAGES}, {_STARTS} a, {_STARTS} b", ("cells",))
def ras_15(t):
    return tiling.sliding_tiles(_images(t), ["step"], 12, 8)


_P = "1.0/(1.0+exp(-(2.0*swir - 3.0*ndvi)))"
_WIN = f"""
WITH w AS (SELECT a.s AS y0, b.s AS x0 FROM {_STARTS} a, {_STARTS} b),
p AS (SELECT step, y0, x0, y, x, {_P} AS p FROM idx JOIN w ON y BETWEEN y0 AND y0 + 11 AND x BETWEEN x0 AND x0 + 11),
full_windows AS (SELECT step, y0, x0, (sum(p) + (144 - count(*))*0.5)/144 AS confidence FROM p GROUP BY 1, 2, 3)
"""


def _feature_tiles(t):
    return raster.feature_tiles(t.tiles, _KEYS)


def _by_window(t, operator):
    """An operator over 12 x 12 windows of every scene, scored with the linear stand-in; missing cells are zeros, which it takes for 0.5."""
    return operator(_feature_tiles(t), _KEYS, TILE, SIDE, SIDE, 6, scorer.scoring([*_KEYS, "y0", "x0"]), 12, 8)


@query("ml_03", _WIN + "SELECT step, y0, x0, round(confidence, 9) AS confidence FROM full_windows", ("idx",))
def ml_03(t):
    return _by_window(t, tiling.score_windows).select("step", "y0", "x0", F.round("confidence", 9).alias("confidence"))


@query("ras_16", _WIN + """SELECT c.step, c.y, c.x, round(coalesce(avg(f.confidence*100 + q.p), 0), 6) AS p
FROM cells c LEFT JOIN (p q JOIN full_windows f USING (step, y0, x0)) ON q.step = c.step AND q.y = c.y AND q.x = c.x GROUP BY 1, 2, 3""", ("idx",))
def ras_16(t):
    mean = _by_window(t, tiling.overlap_scores)
    cells = raster.cells(mean, ["p", "confidence"], TILE)
    return cells.select(*_YX, F.round(F.col("confidence") * 100 + F.col("p"), 6).alias("p"))


_RECTS = "SELECT doc_id AS label_id, doc_id % 28 AS x0, (doc_id // 28) % 28 AS y0, 1 + quality AS n FROM labels"


def _label_rings(t):
    """Rectangles of label cells from the labels table, in world coordinates."""
    l = t.raw("labels")
    x0, y0, n = F.col("doc_id") % 28, F.floor(F.col("doc_id") / 28) % 28, 1 + F.col("quality")
    lon, lat = lambda x: F.lit(4.2) + x * 0.001, lambda y: F.lit(51.95) - y * 0.001
    return l.select("doc_id", geometry.rectangle(lon(x0), lat(y0 + n), lon(x0 + n), lat(y0)).alias("ring"))


@query("ras_19", f"""
WITH l AS ({_RECTS}), c AS (SELECT y, x FROM (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x))
SELECT DISTINCT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM c JOIN l ON x >= x0 AND x < x0 + n AND y >= y0 AND y < y0 + n""")
def ras_19(t):
    return tiling.rasterise(_label_rings(t), GRID, SIDE, SIDE)


_CHIPS = f"""
WITH l AS ({_RECTS}), st AS (SELECT unnest([0, 8, 16]) AS s), w AS (SELECT a.s AS y0, b.s AS x0 FROM st a, st b),
lc AS (SELECT DISTINCT y, x FROM (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x), l WHERE x >= l.x0 AND x < l.x0 + n AND y >= l.y0 AND y < l.y0 + n),
hot AS (SELECT w.y0, w.x0, count(*) AS n FROM w JOIN lc ON y BETWEEN w.y0 AND w.y0 + 11 AND x BETWEEN w.x0 AND w.x0 + 11 GROUP BY 1, 2),
chips AS (SELECT step, w.y0, w.x0, coalesce(n, 0) AS n_label_cells, step || '_y' || w.y0 || '_x' || w.x0 AS chip_id
FROM {_IMAGES}, w LEFT JOIN hot ON hot.y0 = w.y0 AND hot.x0 = w.x0),
kept AS (SELECT * FROM chips WHERE n_label_cells > 0 OR CAST('0x' || substr(md5(chip_id), 1, 8) AS BIGINT) % 10 = 0)
"""


def _chips(t):
    lc = tiling.rasterise(_label_rings(t), GRID, SIDE, SIDE)
    return tiling.choose_chips(_images(t), lc, "step", 12, 8, SIDE, SIDE)


@query("ml_01", _CHIPS + "SELECT chip_id, step, y0, x0, n_label_cells FROM kept", ("cells",))
def ml_01(t):
    return _chips(t).select("chip_id", "step", "y0", "x0", "n_label_cells")


@query("ml_02", "SELECT doc_id AS stem, a.s AS y0, b.s AS x0 FROM (SELECT doc_id, 20 + 4*(n_chars % 6) AS n FROM documents JOIN labels USING (doc_id)), (SELECT unnest(range(0, 64, 8)) AS s) a, (SELECT unnest(range(0, 64, 8)) AS s) b WHERE a.s <= n - 12 AND b.s <= n - 12")
def ml_02(t):
    from groundshift.sources.labels import pair_by_stem
    side = (F.lit(20) + 4 * (F.col("n_chars") % 6)).cast("int")
    images = t.raw("documents").select(F.col("doc_id").alias("stem"), side.alias("height"), side.alias("width"))
    pairs = pair_by_stem(images, t.raw("labels").select(F.col("doc_id").alias("stem")))
    return tiling.tile_index(pairs, "stem", 12, 8)


# ---- metrics --------------------------------------------------------------------------------------------------------

_EVAL = f"ev AS (SELECT step, y // 8 AS ty, x // 8 AS tx, 2.0*swir - 3.0*ndvi AS z, {_P} AS p, nir < 0.08::DOUBLE AS truth FROM idx)"


def _eval(t):
    c = raster.with_indices(t.cells)
    z = F.col("swir") * 2.0 - F.col("ndvi") * 3.0
    return c.select("step", "ty", "tx", z.alias("logit"), scorer.sigmoid(z).alias("p"), (F.col("nir") < 0.08).alias("truth"))


_TILE = ["step", "ty", "tx"]


@query("ml_04", f"WITH {_EVAL} SELECT step, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, max(CAST(truth AS INTEGER)) AS has_target FROM ev GROUP BY 1, 2, 3", ("idx",))
def ml_04(t):
    return scorer.tile_labels(_eval(t), _TILE)


@query("ml_05", f"WITH {_EVAL}, g AS (SELECT count(*) FILTER (p > 0.5 AND truth) AS i, count(*) FILTER (p > 0.5 OR truth) AS u FROM ev GROUP BY step, ty, tx) SELECT round(avg(i/(u + 1e-6::DOUBLE)), 9) AS mean_iou, count(*) AS n_tiles FROM g", ("idx",))
def ml_05(t):
    return scorer.mean_iou(_eval(t), _TILE).withColumn("mean_iou", F.round("mean_iou", 9))


@query("ml_06", f"WITH {_EVAL} SELECT round(1 - (2*sum(p*truth::INT) + 1e-6)/(sum(p) + sum(truth::INT) + 1e-6), 9) AS dice_loss FROM ev", ("idx",))
def ml_06(t):
    return _eval(t).agg(F.round(scorer.dice_loss(F.col("p"), F.col("truth").cast("double")), 9).alias("dice_loss"))


@query("ml_07", f"""
WITH {_EVAL}, b AS (SELECT *, greatest(z, 0) - z*truth::INT + ln(1 + exp(-abs(z))) AS bce FROM ev),
s AS (SELECT 1 - (2*sum(p*truth::INT) + 1e-6)/(sum(p) + sum(truth::INT) + 1e-6) AS dice, avg(0.25*pow(1 - exp(-bce), 2)*bce) AS focal, avg(bce) AS bce FROM b),
g AS (SELECT avg(z) AS z, max(truth::INT) AS t FROM ev GROUP BY step, ty, tx), d AS (SELECT avg(greatest(z, 0) - z*t + ln(1 + exp(-abs(z)))) AS detection FROM g)
SELECT round(dice, 8) AS dice, round(focal, 8) AS focal, round(bce, 8) AS bce, round(detection, 8) AS detection, round(dice + focal + 0.5*bce, 8) AS segmentation, round(dice + focal + 0.5*bce + 0.5*detection, 8) AS total FROM s, d""", ("idx",))
def ml_07(t):
    out = scorer.losses(_eval(t), _TILE)
    return out.select(*[F.round(c, 8).alias(c) for c in ("dice", "focal", "bce", "detection", "segmentation", "total")])


@query("ml_08", f"""
WITH {_EVAL}, c AS (SELECT step, count(*) FILTER (p > 0.5 AND truth) AS tp, count(*) FILTER (p > 0.5 AND NOT truth) AS fp, count(*) FILTER (NOT p > 0.5 AND truth) AS fn, count(*) FILTER (NOT p > 0.5 AND NOT truth) AS tn FROM ev GROUP BY step)
SELECT *, coalesce(tp/nullif(tp+fp, 0)::DOUBLE, 0) AS precision, coalesce(tp/nullif(tp+fn, 0)::DOUBLE, 0) AS recall, coalesce(tp/nullif(tp+fp+fn, 0)::DOUBLE, 0) AS iou FROM c""", ("idx",))
def ml_08(t):
    return scorer.precision_recall(_eval(t), by=["step"])


# ---- overlap ----------------------------------------------------------------------------------------------------------

_PAIRSQL = """
SELECT a.sector_id, a.site_no AS id_a, b.site_no AS id_b,
  (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x))*(least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) AS inter,
  (a.max_x-a.min_x)*(a.max_y-a.min_y) + (b.max_x-b.min_x)*(b.max_y-b.min_y) AS both_areas, a.confidence AS ca, b.confidence AS cb
FROM boxes a JOIN boxes b ON a.sector_id = b.sector_id AND a.site_no < b.site_no AND a.min_x < b.max_x AND b.min_x < a.max_x AND a.min_y < b.max_y AND b.min_y < a.max_y"""
_OVER = f"(SELECT *, inter/(both_areas - inter) AS iou FROM ({_PAIRSQL}))"


@query("join_07", f"SELECT sector_id, id_a, id_b, round(iou, 6) AS iou FROM {_OVER} WHERE iou > 0.5", ("boxes",))
def join_07(t):
    """Every pair of sites whose boxes overlap by more than 0.5, copies of a box included."""
    return overlap.overlap_pairs(t.sites, ["sector_id"], "site_no").withColumn("iou", F.round("iou", 6))


@query("geo_06", f"SELECT sector_id, id_a, id_b, round(iou, 6) AS iou FROM {_OVER} WHERE iou > 0.8", ("boxes",))
def geo_06(t):
    """General rings: the exact polygon IoU of every pair above 0.8, copies of a ring included."""
    return overlap.overlap_pairs(t.polygons, ["sector_id"], "site_no", 0.8, ring="ring").withColumn("iou", F.round("iou", 6))


_NMS = f"""
WITH RECURSIVE pr AS MATERIALIZED (SELECT CASE WHEN ca >= cb THEN id_b ELSE id_a END AS worse, CASE WHEN ca >= cb THEN id_a ELSE id_b END AS better FROM {_OVER} WHERE iou > 0.5),
st(n, id, s) AS (
  SELECT 0, site_no, 'U' FROM boxes
  UNION ALL
  SELECT n + 1, id, CASE WHEN s <> 'U' THEN s WHEN k > 0 THEN 'S' WHEN u = 0 THEN 'K' ELSE 'U' END FROM (
    SELECT st.n, st.id, st.s, count(*) FILTER (b.s = 'K') AS k, count(*) FILTER (b.s = 'U') AS u
    FROM st LEFT JOIN pr ON pr.worse = st.id LEFT JOIN st b ON b.id = pr.better GROUP BY 1, 2, 3)
  WHERE n < 60 AND EXISTS (SELECT 1 FROM st WHERE s = 'U'))
SELECT site_id, sector_id, confidence FROM boxes JOIN st ON st.id = site_no AND st.n = (SELECT max(n) FROM st) AND st.s = 'K'"""


@query("ded_01", _NMS, ("boxes",))
def ded_01(t):
    return overlap.suppress(t.sites, "site_no", ["sector_id"]).select("site_id", "sector_id", "confidence")
