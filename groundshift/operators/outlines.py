"""Outlines of components too large to be traced in one task.

The outline is a cycle of steps between neighbouring cells, and each step's successor follows from
the cells around its end. The steps are put in order by pointer doubling, so area, perimeter and
simplification are joins and aggregates over step rows and no component is ever held together. Only
the simplified ring, which is the result, is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import MOVES

_DY = [m[0] for m in MOVES]
_DX = [m[1] for m in MOVES]
_SIDES = sum(1 << d for d in (0, 2, 4, 6))


def _pick(values: list[int], d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), d + 1)


def _has(mask: Column, d: Column) -> Column:
    return F.call_function("getbit", mask, d % 8) == 1


def _first_turn(mask: Column, come: Column) -> Column:
    """First occupied direction, clockwise from ``come``."""
    order = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (come + i) % 8)
    return F.get(F.filter(order, lambda d: _has(mask, d)), F.lit(0))


def _ident(y: Column, x: Column, d: Column) -> Column:
    return F.shiftleft(y.cast("long"), 34) + x.cast("long") * 8 + d


def _neighbour_masks(cells: DataFrame, key: list[str]) -> DataFrame:
    """Outline cells with a bit per occupied neighbour direction."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << ((d + 4) % 8)).alias("bit"))
                      for d, (dy, dx) in enumerate(MOVES)])
    told = cells.select(*key, "y", "x", F.explode(moves).alias("m")).select(
        *key, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), F.col("m.bit").alias("bit"), F.lit(0).alias("own"))
    own = cells.select(*key, "y", "x", F.lit(0).alias("bit"), F.lit(1).alias("own"))
    masks = told.unionByName(own).groupBy(*key, "y", "x").agg(F.bit_or("bit").alias("mask"), F.max("own").alias("own"))
    return masks.filter((F.col("own") == 1) & (F.col("mask").bitwiseAND(F.lit(_SIDES)) != _SIDES)).drop("own")


def _steps(masks: DataFrame, key: list[str]) -> DataFrame:
    """Border steps (y, x, d) -> (y2, x2, d2): the outside lies directly before direction d."""
    d, m = F.col("d"), F.col("mask")
    s = masks.filter("mask <> 0").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(7))))
    s = s.filter(_has(m, d) & ~_has(m, d + 7) & ((d % 2 == 1) | ~_has(m, d + 6)))
    s = s.select(*key, "y", "x", "d", (F.col("y") + _pick(_DY, d)).alias("y2"), (F.col("x") + _pick(_DX, d)).alias("x2"))
    ends = masks.select(*key, F.col("y").alias("y2"), F.col("x").alias("x2"), "mask")
    s = s.join(ends, [*key, "y2", "x2"]).withColumn("d2", _first_turn(m, d + 6)).drop("mask")
    return s.withColumns({"id": _ident(F.col("y"), F.col("x"), d), "nxt": _ident(F.col("y2"), F.col("x2"), F.col("d2"))})


def _ordered(steps: DataFrame, masks: DataFrame, key: list[str]) -> DataFrame:
    """Steps of the outer border with their position ``seq`` from the topmost-leftmost cell.

    The cycle is cut before its first step and every step finds its distance to the cut by pointer
    doubling; borders of holes never reach the cut and drop out.
    """
    first = masks.groupBy(*key).agg(F.min(F.struct("y", "x", "mask")).alias("s"))
    first = stage(first.select(*key, _ident(F.col("s.y"), F.col("s.x"), _first_turn(F.col("s.mask"), F.lit(4))).alias("start")), "starts")
    steps = stage(steps.join(first, key), "steps")
    longest = steps.groupBy(*key).count().agg(F.max("count")).first()[0] or 1
    n = steps.select(*key, "id", F.when(F.col("nxt") != F.col("start"), F.col("nxt")).alias("nxt"), F.lit(1).cast("long").alias("dist"))
    for _ in range(math.ceil(math.log2(longest)) + 1):
        ahead = n.select(*key, F.col("id").alias("nxt"), F.col("nxt").alias("far"), F.col("dist").alias("more"))
        n = n.join(ahead, [*key, "nxt"], "left").select(
            *key, "id", F.col("far").alias("nxt"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))
        n = stage(n, "jumps")
    n = n.filter("nxt is null")
    length = n.groupBy(*key).agg(F.max("dist").alias("length"))
    out = steps.drop("nxt").join(n.select(*key, "id", "dist"), [*key, "id"]).join(length, key)
    return stage(out.withColumn("seq", F.col("length") - F.col("dist")), "ordered")


def _corners(ordered: DataFrame, key: list[str]) -> DataFrame:
    """Points where the walk changes direction, numbered from the start."""
    return ordered.filter("d2 <> d").select(*key, ((F.col("seq") + 1) % F.col("length")).alias("seq"),
                                            F.col("x2").cast("double").alias("px"), F.col("y2").cast("double").alias("py"), "length")


def _farthest(corners: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Farthest corner from the base corner of each component; the earlier one on ties."""
    b = corners.join(base.select(*key, F.col("seq").alias("bs"), F.col("px").alias("bx"), F.col("py").alias("by")), key)
    gap = (F.col("px") - F.col("bx")) * (F.col("px") - F.col("bx")) + (F.col("py") - F.col("by")) * (F.col("py") - F.col("by"))
    top = b.groupBy(*key).agg(F.max_by(F.struct("seq", "px", "py"), F.struct(gap, -F.col("seq"))).alias("t"))
    return top.select(*key, "t.*")


def _simplified(corners: DataFrame, limits: DataFrame, key: list[str]) -> DataFrame:
    """Douglas-Peucker by rounds: in every open segment the farthest point is one aggregate."""
    base = corners.filter("seq = 0").select(*key, "seq", "px", "py")
    prev = base
    for _ in range(3):
        prev, base = base, stage(_farthest(corners, base, key), "anchor")
    a, b = base, prev
    place = corners.join(a.select(*key, F.col("seq").alias("a_seq"), F.struct("px", "py").alias("a")), key)
    at = lambda s: (s - F.col("a_seq") + F.col("length")) % F.col("length")
    place = place.join(b.select(*key, F.col("seq").alias("b_seq"), F.struct("px", "py").alias("b")), key)
    place = place.withColumns({"pos": at(F.col("seq")), "b_pos": at(F.col("b_seq"))}).join(limits, key)
    kept = place.filter((F.col("pos") == 0) | (F.col("pos") == F.col("b_pos"))).select(*key, "pos", "px", "py")
    before = F.col("pos") < F.col("b_pos")
    open_pts = place.filter((F.col("pos") != 0) & (F.col("pos") != F.col("b_pos"))).select(
        *key, "pos", "px", "py", "tolerance",
        F.when(before, F.lit(0)).otherwise(F.col("b_pos")).cast("long").alias("lo"), F.when(before, F.col("a")).otherwise(F.col("b")).alias("p"),
        F.when(before, F.col("b")).otherwise(F.col("a")).alias("q"))
    open_pts = stage(open_pts, "segments")
    while not open_pts.isEmpty():
        dx, dy = F.col("q.px") - F.col("p.px"), F.col("q.py") - F.col("p.py")
        rx, ry = F.col("px") - F.col("p.px"), F.col("py") - F.col("p.py")
        length = F.hypot(dx, dy)
        gap = F.when(length == 0.0, F.hypot(rx, ry)).otherwise(F.abs(dx * ry - dy * rx) / F.when(length != 0.0, length))
        far = open_pts.withColumn("gap", gap).groupBy(*key, "lo", "tolerance").agg(
            F.max_by(F.struct("gap", "pos", "px", "py"), F.struct("gap", -F.col("pos"))).alias("f"))
        split = stage(far.filter(F.col("f.gap") > F.col("tolerance")).select(*key, "lo", F.col("f.pos").alias("s"), F.struct("f.px", "f.py").alias("c")), "splits")
        kept = kept.unionByName(split.select(*key, F.col("s").alias("pos"), F.col("c.px").alias("px"), F.col("c.py").alias("py")))
        left = F.col("pos") < F.col("s")
        open_pts = open_pts.join(split, [*key, "lo"]).filter("pos <> s").select(
            *key, "pos", "px", "py", "tolerance", F.when(left, F.col("lo")).otherwise(F.col("s")).alias("lo"),
            F.when(left, F.col("p")).otherwise(F.col("c")).alias("p"), F.when(left, F.col("c")).otherwise(F.col("q")).alias("q"))
        open_pts = stage(open_pts, "segments")
    return kept


def large_outlines(cells: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """(key, contour_px, perimeter_px, ring) of the components in ``cells`` (key, y, x)."""
    masks = stage(_neighbour_masks(cells, key), "masks")
    ordered = _ordered(_steps(masks, key), masks, key)
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    size = ordered.groupBy(*key).agg(
        (F.abs(F.sum(cross.cast("double"))) / 2.0).alias("contour_px"),
        F.sum(F.when(F.col("d") % 2 == 1, F.lit(math.sqrt(2.0))).otherwise(F.lit(1.0))).alias("perimeter_px"))
    size = stage(size, "sizes")
    limits = size.select(*key, (F.col("perimeter_px") * tolerance).alias("tolerance"))
    corners = _corners(ordered, key)
    pts = _simplified(corners, limits, key) if tolerance > 0 else corners.select(*key, F.col("seq").alias("pos"), "px", "py")
    ring = F.transform(F.sort_array(F.collect_list(F.struct("pos", "px", "py"))), lambda s: F.array(s["px"], s["py"]))
    rings = pts.groupBy(*key).agg(ring.alias("ring")).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    return size.join(rings, key)
