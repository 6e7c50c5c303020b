"""Connected components of mask tiles and their outlines.

Cells are labelled inside their tile; labels that touch across a tile seam form a small graph
whose components are found by star contraction; one join carries the result back. No scene, and no
component, is ever gathered in one task for labelling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, stage

# The eight moves to a neighbour cell, clockwise from east, rows growing downwards.
MOVES = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def label_block(mask: np.ndarray) -> np.ndarray:
    """8-connected labels of one block: the smallest flat index of each component, -1 outside."""
    h, w = mask.shape
    none = h * w
    lab = np.where(mask, np.arange(none).reshape(h, w), none)
    while True:
        ext = np.pad(lab, 1, constant_values=none)
        low = lab
        for dy in range(3):
            for dx in range(3):
                low = np.minimum(low, ext[dy:dy + h, dx:dx + w])
        flat = np.append(np.where(mask, low, none).ravel(), none)
        flat = flat[flat]  # follow the label to that cell's own label
        new = flat[:-1].reshape(h, w)
        if np.array_equal(new, lab):
            return np.where(mask, lab, -1)
        lab = new


def outline_cells(mask: np.ndarray) -> np.ndarray:
    """Cells that may lie on an outline: not surrounded on four sides inside the block."""
    m = np.pad(mask, 1)
    return mask & ~(m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:])


_TILE_LABELS = T.StructType([
    T.StructField("label", T.ArrayType(T.IntegerType())), T.StructField("outline", T.ArrayType(T.ByteType()))])


@F.pandas_udf(_TILE_LABELS)
def _label_tile(mask: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    rows = []
    for m, th, tw in zip(mask, h, w):
        block = np.asarray(m).reshape(th, tw) > 0
        rows.append((label_block(block).ravel().astype(np.int32), outline_cells(block).ravel().astype(np.int8)))
    return pd.DataFrame(rows, columns=["label", "outline"])


def _changed(a: DataFrame, cols: list[str]) -> tuple:
    """Order-free fingerprint of a table (two numbers reach the driver)."""
    h = F.xxhash64(*cols)
    r = a.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def star_roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node of the component of every node: (keys, node, root), nodes that are roots left out.

    ``edges`` has (keys, u, v). Alternating large-star and small-star rewiring: each round links a
    node's larger neighbours, then its smaller ones, to its least neighbour, until every edge points
    at a root. Minima come from partial aggregates and are joined back, so a node with very many
    edges is split like any skewed join key.
    """
    up = edges.filter("u <> v").select(*keys, F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    up = stage(up, "edges")
    seen = _changed(up, [*keys, "hi", "lo"])
    while True:
        before = up
        both = up.select(*keys, F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(
            up.select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy(*keys, "hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, [*keys, "hi"])
        up = small.filter("lo <> m").select(*keys, F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            floor.select(*keys, "hi", F.col("m").alias("lo"))).distinct()
        up = stage(up, "stars")
        discard(before)
        now = _changed(up, [*keys, "hi", "lo"])
        if now == seen:
            return up.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now


def label_cells(tiles: DataFrame, keys: list[str], tile: int, width: int, value: str = "mask") -> DataFrame:
    """True cells of a tiled mask with their component.

    ``component`` is the smallest ``y * width + x`` of the component; ``outline`` marks cells that
    can lie on its border.
    """
    ty, tx, w = F.col("ty"), F.col("tx"), F.col("w")
    busy = tiles.filter(F.exists(value, lambda m: m > 0)).select(*keys, "ty", "tx", "h", "w", _label_tile(value, "h", "w").alias("l"))
    busy = stage(busy, "labels")
    c = busy.select(*keys, "ty", "tx", "h", "w", F.posexplode(F.arrays_zip("l.label", "l.outline")).alias("pos", "c"))
    r, k, lab = F.floor(F.col("pos") / w), F.col("pos") % w, F.col("c.label")
    c = c.filter(lab >= 0).select(
        *keys, "ty", "tx", "pos", (ty * tile + r).cast("int").alias("y"), (tx * tile + k).cast("int").alias("x"),
        ((ty * tile + F.floor(lab / w)).cast("long") * width + tx * tile + lab % w).alias("label"),
        (F.col("c.outline") > 0).alias("outline"),
        ((r == 0) | (r == F.col("h") - 1) | (k == 0) | (k == w - 1)).alias("seam"),
    )
    seam = c.filter("seam").select(*keys, "ty", "tx", "y", "x", "label")
    ahead = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in MOVES[:4]])
    probe = seam.select(*keys, "ty", "tx", F.col("label").alias("u"), "y", "x", F.explode(ahead).alias("d")).select(
        *keys, "ty", "tx", "u", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    probe = probe.filter((F.floor(F.col("y") / tile) != F.col("ty")) | (F.floor(F.col("x") / tile) != F.col("tx"))).drop("ty", "tx")
    edges = probe.join(seam.select(*keys, "y", "x", F.col("label").alias("v")), [*keys, "y", "x"]).select(*keys, "u", "v")
    roots = star_roots(edges, keys).withColumnRenamed("node", "label")
    return (
        c.join(roots, [*keys, "label"], "left")
        .select(*keys, "ty", "tx", "pos", "y", "x", F.coalesce("root", "label").alias("component"), "outline")
    )


def component_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, "component").agg(F.count("*").alias("n_cells"))


# ---- outlines --------------------------------------------------------------------------------------------


def trace_outline(ys: np.ndarray, xs: np.ndarray) -> list[tuple[int, int]]:
    """Cells (y, x) of the outer border in order, starting at the topmost-leftmost cell.

    Walks clockwise with the outside on the left; a cell is repeated where the shape is one cell wide.
    """
    cells = set(zip(ys.tolist(), xs.tolist()))
    start = min(cells)

    def turn(cell, come):
        for i in range(8):
            d = (come + i) % 8
            nxt = (cell[0] + MOVES[d][0], cell[1] + MOVES[d][1])
            if nxt in cells:
                return d, nxt
        return None, cell

    first, cell = turn(start, 4)
    if first is None:
        return [start]
    path, d = [start], first
    while True:
        d2, nxt = turn(cell, (d + 6) % 8)
        if cell == start and d2 == first:
            return path
        path.append(cell)
        d, cell = d2, nxt


def drop_straight(path: np.ndarray) -> np.ndarray:
    """Keep only the points where the walk changes direction."""
    if len(path) < 3:
        return path
    step = np.roll(path, -1, axis=0) - path
    return path[np.any(step != np.roll(step, 1, axis=0), axis=1)]


def simplify_ring(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, anchored at two mutually far points."""
    n = len(pts)
    if n < 2:
        return pts
    a = 0
    for _ in range(3):
        b, a = a, int(np.argmax(((pts - pts[a]) ** 2).sum(axis=1)))
    ring = np.roll(pts, -a, axis=0)
    b = (b - a) % n
    closed = np.vstack([ring, ring[:1]])
    keep = np.zeros(n + 1, dtype=bool)
    keep[[0, b, n]] = True
    todo = [(0, b), (b, n)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, q, mid = closed[i], closed[j], closed[i + 1:j]
        dx, dy = q - p
        length = np.hypot(dx, dy)
        if length == 0:
            dist = np.hypot(mid[:, 0] - p[0], mid[:, 1] - p[1])
        else:
            dist = np.abs(dx * (mid[:, 1] - p[1]) - dy * (mid[:, 0] - p[0])) / length
        k = int(np.argmax(dist))
        if dist[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[keep[:n]]


def _shoelace(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2.0


def polygonise(cells: DataFrame, keys: list[str], tolerance: float = 0.01, min_px: float = 0.0, in_task: int = 1_000_000) -> DataFrame:
    """Outer ring of every component in pixel coordinates (x, y at cell centres), holes ignored.

    ``contour_px`` is the ring's shoelace area before simplification and ``tolerance`` a fraction of
    its perimeter; 0 keeps every corner. Components whose bounding box cannot reach ``min_px`` are dropped before tracing,
    the others are tested on their real area. A component with up to ``in_task`` outline cells is
    traced in one task from those cells; a larger one goes through ``outlines``, which never holds
    a component together and gives the same ring.
    """
    key = [*keys, "component"]
    size = cells.groupBy(*key).agg(
        F.count("*").alias("n_cells"), F.count(F.when(F.col("outline"), 1)).alias("n_outline"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    size = stage(size.filter((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) >= min_px), "extents")
    big = size.filter(F.col("n_outline") > in_task).select(*key)
    small = size.filter(F.col("n_outline") <= in_task)
    border = cells.filter("outline").select(*key, "y", "x").join(small.select(*key), key, "left_semi")
    grouped = border.groupBy(*key).agg(F.collect_list(F.struct("y", "x")).alias("c"))
    grouped = grouped.select(*key, F.col("c.y").alias("ys"), F.col("c.x").alias("xs"))

    @F.pandas_udf("struct<contour_px:double,perimeter_px:double,x:array<double>,y:array<double>>")
    def trace(ys: pd.Series, xs: pd.Series) -> pd.DataFrame:
        rows = []
        for y, x in zip(ys, xs):
            path = np.array(trace_outline(np.asarray(y), np.asarray(x)), dtype=float)[:, ::-1]
            corners = drop_straight(path)
            perimeter = float(np.hypot(*(np.roll(corners, -1, axis=0) - corners).T).sum())
            ring = simplify_ring(corners, tolerance * perimeter) if tolerance > 0 else corners
            rows.append((_shoelace(corners), perimeter, *np.vstack([ring, ring[:1]]).T.copy()))
        return pd.DataFrame(rows, columns=["contour_px", "perimeter_px", "x", "y"])

    # Spark would trace again for each filter on the result that it moves below the join
    traced = grouped.withColumn("t", trace.asNondeterministic()("ys", "xs"))
    rings = traced.select(*key, "t.contour_px", "t.perimeter_px", F.zip_with("t.x", "t.y", lambda x, y: F.array(x, y)).alias("ring"))
    if not big.isEmpty():
        from .outlines import large_outlines

        whole = cells.select(*key, "y", "x").join(big, key, "left_semi")
        rings = rings.unionByName(large_outlines(whole, key, tolerance))
    out = size.drop("n_outline").join(rings, key).withColumn("n_vertices", F.size("ring") - 1)
    return out.filter(F.col("contour_px") >= min_px)


def ring_to_world(ring: Column, grid: Column) -> Column:
    """Apply the affine grid to every point of a pixel ring."""
    def at(p: Column) -> Column:
        col, row = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.array(grid["a"] * col + grid["b"] * row + grid["c"], grid["d"] * col + grid["e"] * row + grid["f"])

    return F.transform(ring, at)


def zonal_means(labelled: DataFrame, measures: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean of cell measures inside every component. Both sides are keyed by the cell address, and
    the sums are partial before the component shuffle."""
    on = [*keys, "ty", "tx", "pos"]
    joined = labelled.join(measures.select(*on, *cols), on)
    return joined.groupBy(*keys, "component").agg(F.count("*").alias("n_cells"), *[F.avg(c).alias("mean_" + c) for c in cols])
