"""Geometry as column expressions: rings are ARRAY<ARRAY<DOUBLE>> of closed [lon, lat] points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius of EPSG:3857 and metres per degree of the approximate area.
EARTH_RADIUS_M = 6378137.0
METRES_PER_DEGREE = 111000.0


def mercator_x(lon: Column) -> Column:
    return lon * (math.pi / 180.0) * EARTH_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4.0) + lat * (math.pi / 360.0))) * EARTH_RADIUS_M


def inverse_mercator_lon(x: Column) -> Column:
    return x / EARTH_RADIUS_M * (180.0 / math.pi)


def inverse_mercator_lat(y: Column) -> Column:
    return (F.atan(F.exp(y / EARTH_RADIUS_M)) * 2.0 - F.lit(math.pi / 2.0)) * (180.0 / math.pi)


def lonlat_ring(ring: Column) -> Column:
    """A ring of EPSG:3857 metres in degrees."""
    return F.transform(ring, lambda p: F.array(inverse_mercator_lon(F.get(p, F.lit(0))), inverse_mercator_lat(F.get(p, F.lit(1)))))


def _edges(ring: Column) -> Column:
    """Consecutive point pairs, relative to the ring's first point to keep the sums small."""
    n = F.size(ring)
    o = F.get(ring, F.lit(0))
    rel = F.transform(ring, lambda p: F.struct(
        (F.get(p, F.lit(0)) - F.get(o, F.lit(0))).alias("x"), (F.get(p, F.lit(1)) - F.get(o, F.lit(1))).alias("y")))
    return F.arrays_zip(
        F.slice(rel, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"),
        F.slice(rel, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"),
    )


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + f(e))


def signed_area(ring: Column) -> Column:
    return _sum(_edges(ring), _cross) / 2.0


def ring_area(ring: Column) -> Column:
    """Shoelace area in squared ring units."""
    return F.abs(signed_area(ring))


def mercator_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(mercator_x(F.get(p, F.lit(0))), mercator_y(F.get(p, F.lit(1)))))


def area_m2(ring: Column, true_area: bool = False) -> Column:
    """Area in EPSG:3857 square metres; ``true_area`` removes the projection's 1/cos² inflation."""
    a = ring_area(mercator_ring(ring))
    if not true_area:
        return a
    c = F.cos(F.radians(F.get(centroid(ring), F.lit(1))))
    return a * c * c


def area_m2_approx(ring: Column) -> Column:
    """Squared degrees times 111000² times cos(centroid latitude)."""
    lat = F.get(centroid(ring), F.lit(1))
    return ring_area(ring) * METRES_PER_DEGREE * METRES_PER_DEGREE * F.cos(F.radians(lat))


def centroid(ring: Column) -> Column:
    """Area-weighted centroid [lon, lat]; the first point for a ring of zero area."""
    o = F.get(ring, F.lit(0))
    edges = _edges(ring)
    a6 = _sum(edges, _cross) * 3.0
    cx = _sum(edges, lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e))
    cy = _sum(edges, lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e))
    safe = F.when(a6 != 0.0, a6)
    return F.array(
        F.get(o, F.lit(0)) + F.coalesce(cx / safe, F.lit(0.0)),
        F.get(o, F.lit(1)) + F.coalesce(cy / safe, F.lit(0.0)),
    )


def ring_bbox(ring: Column) -> dict[str, Column]:
    xs = F.transform(ring, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(ring, lambda p: F.get(p, F.lit(1)))
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def rectangle(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Closed counter-clockwise ring of a box."""
    pts = [(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y), (min_x, min_y)]
    return F.array(*[F.array(x, y) for x, y in pts])


def bbox_midpoint(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> tuple[Column, Column]:
    return (min_x + max_x) / 2.0, (min_y + max_y) / 2.0


def bbox_intersects(row: tuple[Column, ...], query: tuple[float, ...]) -> Column:
    """Closed-interval overlap of a (min_x, min_y, max_x, max_y) row with a constant box."""
    x0, y0, x1, y1 = row
    q0, q1, q2, q3 = (float(v) for v in query)
    return (x0 <= q2) & (x1 >= q0) & (y0 <= q3) & (y1 >= q1)


def rect_intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    ox = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    oy = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return ox * oy


def rect_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """IoU of two boxes given as (min_x, min_y, max_x, max_y); 0 for an empty union."""
    inter = rect_intersection(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0.0, inter / union).otherwise(F.lit(0.0))


def tile_x(lon: Column, zoom: Column | int) -> Column:
    """Web-map tile column of a longitude."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), z)).cast("long")


def tile_y(lat: Column, zoom: Column | int) -> Column:
    """Web-map tile row of a latitude."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    phi = lat * F.lit(math.pi) / 180.0
    inner = F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.lit(math.pi)
    return F.floor((F.lit(1.0) - inner) / 2.0 * F.pow(F.lit(2.0), z)).cast("long")


def pixel_to_world(grid: Column, col: Column, row: Column) -> tuple[Column, Column]:
    """Affine grid struct (a, b, c, d, e, f): x = a*col + b*row + c, y = d*col + e*row + f."""
    x = grid["a"] * col + grid["b"] * row + grid["c"]
    y = grid["d"] * col + grid["e"] * row + grid["f"]
    return x, y


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a closed ring."""
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))

    def crosses(e: Column) -> Column:
        ax, ay = F.get(e["a"], F.lit(0)), F.get(e["a"], F.lit(1))
        bx, by = F.get(e["b"], F.lit(0)), F.get(e["b"], F.lit(1))
        straddles = (ay > y) != (by > y)
        at = F.when(by != ay, (bx - ax) * (y - ay) / (by - ay) + ax)
        return F.coalesce(straddles & (x < at), F.lit(False))

    hits = F.aggregate(pairs, F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0))
    return hits % 2 == 1
