"""Neighbourhood operators on tiles: halo exchange, morphology, bilinear resampling.

Only the strips a neighbour needs are shuffled, each tile meets at most eight of them, and the
imaging itself is NumPy on one tile plus its halo.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = {(dy, dx): f"p_{'nos'[dy + 1]}{'wce'[dx + 1]}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)}

# The cells of a 5 x 5 elliptic kernel (row offset, column offset).
ELLIPSE_5 = [(-2, 0), (2, 0)] + [(dy, dx) for dy in (-1, 0, 1) for dx in (-2, -1, 0, 1, 2)]


def _cut(v: Column, w: Column, r0: Column, rows: Column, c0: Column, cols: Column, whole_rows: bool) -> Column:
    """Row-major sub-block of a row-major tile array."""
    if whole_rows:
        return F.slice(v, r0 * w + 1, rows * w)
    return F.flatten(F.transform(F.sequence(r0, r0 + rows - 1), lambda r: F.slice(v, r * w + c0 + 1, cols)))


def halo_exchange(tiles: DataFrame, value: str, pad: int, keys: list[str]) -> DataFrame:
    """Give every tile the ``pad`` cells around it that exist: nine pieces per tile row.

    ``pad`` must not exceed the tile side except for the last row and column of tiles.
    """
    v, h, w = F.col(value), F.col("h"), F.col("w")
    zero, reach = F.lit(0), F.lit(pad)
    parts = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            rows = h if dy == 0 else F.least(reach, h)
            cols = w if dx == 0 else F.least(reach, w)
            r0 = h - rows if dy == 1 else zero
            c0 = w - cols if dx == 1 else zero
            parts.append(F.struct(
                (F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"),
                F.lit(_NAMES[(-dy, -dx)]).alias("slot"),
                F.struct(rows.alias("r"), cols.alias("c"), _cut(v, w, r0, rows, c0, cols, dx == 0).alias("v")).alias("piece"),
            ))
    sent = tiles.select(*keys, F.inline(F.array(*parts)))
    slots = [F.first(F.when(F.col("slot") == n, F.col("piece")), ignorenulls=True).alias(n) for n in _NAMES.values()]
    return sent.groupBy(*keys, "ty", "tx").agg(*slots).filter(F.col("p_oc").isNotNull())


def _assemble(row: dict, pad: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Padded block and the mask of the cells that exist in it."""
    own = row["p_oc"]
    h, w = int(own["r"]), int(own["c"])
    block = np.zeros((h + 2 * pad, w + 2 * pad), dtype=np.asarray(own["v"]).dtype)
    known = np.zeros(block.shape, dtype=bool)
    for (dy, dx), name in _NAMES.items():
        p = row[name]
        if p is None or p["v"] is None:
            continue
        r, c = int(p["r"]), int(p["c"])
        y = pad - r if dy < 0 else pad + (h if dy > 0 else 0)
        x = pad - c if dx < 0 else pad + (w if dx > 0 else 0)
        block[y:y + r, x:x + c] = np.asarray(p["v"]).reshape(r, c)
        known[y:y + r, x:x + c] = True
    return block, known, h, w


def _pieces(cols: list[pd.DataFrame]):
    names = list(_NAMES.values())
    records = [c.to_dict("records") for c in cols]
    for i in range(len(cols[0])):
        yield {n: records[j][i] for j, n in enumerate(names)}


def _shifted(a: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    out = np.full(a.shape, fill)
    h, w = a.shape
    out[max(0, -dy):h - max(0, dy), max(0, -dx):w - max(0, dx)] = a[max(0, dy):h - max(0, -dy), max(0, dx):w - max(0, -dx)]
    return out


def dilate(mask: np.ndarray, known: np.ndarray, kernel) -> np.ndarray:
    src = mask & known
    out = np.zeros_like(src)
    for dy, dx in kernel:
        out |= _shifted(src, dy, dx, False)
    return out & known


def erode(mask: np.ndarray, known: np.ndarray, kernel) -> np.ndarray:
    src = mask | ~known
    out = np.ones_like(src)
    for dy, dx in kernel:
        out &= _shifted(src, dy, dx, True)
    return out & known


def close_open(mask: np.ndarray, known: np.ndarray, kernel=ELLIPSE_5) -> np.ndarray:
    """Closing then opening; cells outside the image are ignored by every pass."""
    for step in (dilate, erode, erode, dilate):
        mask = step(mask, known, kernel)
    return mask


def clean_mask(tiles: DataFrame, keys: list[str], tile: int, value: str = "mask", kernel=tuple(ELLIPSE_5)) -> DataFrame:
    """Morphological close then open of a mask over the whole mosaic, tile by tile.

    Four passes of a radius-2 kernel reach eight cells, which is the halo exchanged. Tiles other
    than those at the far border must be at least that large (``tile`` is their side).
    """
    pad = 4 * max(max(abs(dy), abs(dx)) for dy, dx in kernel)
    if tile < pad:
        raise ValueError(f"tiles of side {tile} are smaller than the {pad} cells the passes reach")
    kernel = list(kernel)

    @F.pandas_udf("struct<h:int,w:int,mask:array<tinyint>>")
    def run(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame, d: pd.DataFrame, e: pd.DataFrame,
            f: pd.DataFrame, g: pd.DataFrame, h: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for piece in _pieces([a, b, c, d, e, f, g, h, i]):
            block, known, th, tw = _assemble(piece, pad)
            out = close_open(block > 0, known, kernel)[pad:pad + th, pad:pad + tw]
            rows.append((th, tw, out.astype(np.int8).ravel()))
        return pd.DataFrame(rows, columns=["h", "w", "mask"])

    wide = halo_exchange(tiles, value, pad, keys)
    return wide.select(*keys, "ty", "tx", run(*_NAMES.values()).alias("o")).select(*keys, "ty", "tx", "o.*")


def _axis(n_out: int, n_in: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source cell pairs and weight of target cells first .. first+count-1 (half-pixel centres, clamped)."""
    s = (np.arange(first, first + count) + 0.5) * (n_in / n_out) - 0.5
    lo = np.floor(s)
    return np.clip(lo, 0, n_in - 1).astype(int), np.clip(lo + 1, 0, n_in - 1).astype(int), s - lo


def resample(tiles: DataFrame, value: str, keys: list[str], tile: int, src_size: tuple[int, int],
             dst_size: tuple[int, int]) -> DataFrame:
    """Bilinear resize of a tiled image to another grid of the same extent.

    ``tile`` is the nominal tile side of source and target. Each source tile is sent to the few
    target tiles whose cells read from it; a target tile is then interpolated on its own. A source tile lists all
    its h x w cells, missing ones as null; cells that read one come out null.
    """
    (sh, sw), (dh, dw) = src_size, dst_size

    def targets(first: Column, count: Column, n_in: int, n_out: int) -> Column:
        ratio = n_out / n_in
        lo = F.floor((first - 0.5) * ratio - 0.5)
        hi = F.ceil((first + count + 0.5) * ratio - 0.5)
        # the clamped border cells are read by every target cell up to the image edge
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n_out - 1))
        return F.sequence(F.floor(lo / tile).cast("int"), F.floor(hi / tile).cast("int"))

    y0, x0 = F.col("ty") * tile, F.col("tx") * tile
    sent = tiles.select(*keys, F.col("ty").alias("sy"), F.col("tx").alias("sx"), F.col("h").alias("r"), F.col("w").alias("c"),
                        F.col(value).cast("array<double>").alias("v"),
                        F.explode(targets(y0, F.col("h"), sh, dh)).alias("ty"), targets(x0, F.col("w"), sw, dw).alias("txs"))
    sent = sent.withColumn("tx", F.explode("txs"))
    # a target tile reads from a fixed number of source tiles, set by the size ratio
    grouped = sent.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("sy", "sx", "r", "c", "v")).alias("src"))

    @F.pandas_udf("struct<h:int,w:int,v:array<double>>")
    def interpolate(ty: pd.Series, tx: pd.Series, src: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, pieces in zip(ty, tx, src):
            h, w = min(tile, dh - a * tile), min(tile, dw - b * tile)
            yl, yh, fy = _axis(dh, sh, a * tile, h)
            xl, xh, fx = _axis(dw, sw, b * tile, w)
            oy, ox = yl.min(), xl.min()
            grid = np.full((yh.max() - oy + 1, xh.max() - ox + 1), np.nan)
            for p in pieces:
                data = np.asarray(p["v"], dtype=float).reshape(p["r"], p["c"])
                py, px = p["sy"] * tile - oy, p["sx"] * tile - ox
                a0, a1 = max(py, 0), min(py + p["r"], grid.shape[0])
                b0, b1 = max(px, 0), min(px + p["c"], grid.shape[1])
                if a0 < a1 and b0 < b1:
                    grid[a0:a1, b0:b1] = data[a0 - py:a1 - py, b0 - px:b1 - px]
            yl, yh, xl, xh = yl - oy, yh - oy, xl - ox, xh - ox
            fy = fy[:, None]
            out = ((1 - fy) * (1 - fx) * grid[np.ix_(yl, xl)] + (1 - fy) * fx * grid[np.ix_(yl, xh)]
                   + fy * (1 - fx) * grid[np.ix_(yh, xl)] + fy * fx * grid[np.ix_(yh, xh)])
            rows.append((h, w, out.ravel()))
        return pd.DataFrame(rows, columns=["h", "w", "v"])

    out = grouped.select(*keys, "ty", "tx", interpolate("ty", "tx", "src").alias("o"))
    return out.select(*keys, "ty", "tx", F.col("o.h").alias("h"), F.col("o.w").alias("w"), F.transform("o.v", lambda x: F.when(~F.isnan(x), x)).alias(value))


def reference_grids(tile_rows: DataFrame, area: str, time: str, grid: list[str]) -> DataFrame:
    """Grid of the earliest scene of each area: the one the whole stack is resampled to."""
    return tile_rows.groupBy(area).agg(F.min_by(F.struct(*grid), time).alias("g")).select(area, "g.*")
