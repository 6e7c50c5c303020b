"""Tiles of one grid resampled to the tiles of another, between degrees and Web Mercator metres.

Both grids are north-up, so the column of a place depends on its longitude alone and the row on its latitude. A target tile
knows the block of source cells it needs; each source tile is cut for the target tiles that need a part of it, and the pieces are
shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import EARTH_RADIUS_M
from .tiling import _dealt, _framed, _groups, _types

DEGREES, MERCATOR = "EPSG:4326", "EPSG:3857"


def forward(v: np.ndarray, axis: int) -> np.ndarray:
    """Longitudes (axis 0) or latitudes (axis 1) in EPSG:3857 metres."""
    r = np.radians(v)
    return EARTH_RADIUS_M * (r if axis == 0 else np.log(np.tan(math.pi / 4 + r / 2)))


def inverse(v: np.ndarray, axis: int) -> np.ndarray:
    """EPSG:3857 metres in degrees."""
    return np.degrees(v / EARTH_RADIUS_M if axis == 0 else 2 * np.arctan(np.exp(v / EARTH_RADIUS_M)) - math.pi / 2)


@dataclass(frozen=True)
class Grid:
    """A north-up grid of cells: tile side and size in cells, step and start along x and y."""

    tile: int
    width: int
    height: int
    affine: tuple[float, float, float, float, float, float]
    crs: str = DEGREES

    def axis(self, k: int) -> tuple[float, float, int]:
        """Step, start and number of cells along x (0) or y (1)."""
        a, b, c, d, e, f = self.affine
        if b or d:
            raise ValueError("warping needs a north-up grid")
        return (a, c, self.width) if k == 0 else (e, f, self.height)


def _places(source: Grid, target: Grid, k: int) -> np.ndarray:
    """For each target column or row, where its centre lies among the centres of the source's."""
    step, start, n = target.axis(k)
    at = start + step * (np.arange(n) + 0.5)
    if source.crs != target.crs:
        at = forward(at, k) if source.crs == MERCATOR else inverse(at, k)
    step, start, _ = source.axis(k)
    return (at - start) / step - 0.5


def _needed(at: np.ndarray, n: int, tile: int) -> np.ndarray:
    """First and last source cell that the target cells of each tile need, -1 where they lie outside."""
    out = np.full((-(-len(at) // tile), 2), -1)
    for t in range(len(out)):
        part = at[t * tile:(t + 1) * tile]
        part = part[(part >= -0.5) & (part <= n - 0.5)]
        if len(part):
            out[t] = max(math.floor(part.min()), 0), min(math.floor(part.max()) + 1, n - 1)
    return out


def warp(tiles: DataFrame, value: str, keys: list[str], source: Grid, target: Grid) -> DataFrame:
    """Tiles (keys, ty, tx, h, w, ``value``) of the target grid by bilinear interpolation between source cell centres.

    Outside the outermost centres the nearest cell counts. A cell is null where its centre lies outside the source, or where a
    source cell of positive weight is null or lacks its tile; a target tile without any source tile is left out.
    """
    cols, rows = _places(source, target, 0), _places(source, target, 1)
    x_needs, y_needs = _needed(cols, source.width, target.tile), _needed(rows, source.height, target.tile)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[tuple]:
            for pdf in parts:
                for *key, ty, tx, h, w, v in pdf.itertuples(index=False, name=None):
                    block = np.asarray(v, dtype=float).reshape(h, w)
                    y, x = ty * source.tile, tx * source.tile
                    for sy in np.flatnonzero((y_needs[:, 0] >= 0) & (y_needs[:, 0] < y + h) & (y_needs[:, 1] >= y)).tolist():
                        top, bottom = max(y, y_needs[sy, 0]), min(y + h, y_needs[sy, 1] + 1)
                        for sx in np.flatnonzero((x_needs[:, 0] >= 0) & (x_needs[:, 0] < x + w) & (x_needs[:, 1] >= x)).tolist():
                            left, right = max(x, x_needs[sx, 0]), min(x + w, x_needs[sx, 1] + 1)
                            yield (*key, sy, sx, top - y_needs[sy, 0], left - x_needs[sx, 0], bottom - top, right - left, block[top - y:bottom - y, left - x:right - x].ravel())

        return _framed(pieces(), [*keys, "ty", "tx", "oy", "ox", "ph", "pw", "v"])

    def between(at: np.ndarray, first: int, n: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower and upper neighbour inside a block, weight of the upper one, and which places are inside the source."""
        inside = (at >= -0.5) & (at <= last - 0.5)
        low = np.clip(np.floor(at), 0, last - 1)
        high = np.clip(np.floor(at) + 1, 0, last - 1)
        f = np.where(low == high, 0.0, np.clip(at - low, 0.0, 1.0))
        return np.clip(low - first, 0, n - 1).astype(int), np.clip(high - first, 0, n - 1).astype(int), f, inside

    def sample(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sampled() -> Iterator[tuple]:
            for (*key, ty, tx), found in _groups(parts, len(keys) + 2):
                (y0, y1), (x0, x1) = y_needs[ty], x_needs[tx]
                block = np.full((y1 - y0 + 1, x1 - x0 + 1), np.nan)
                for oy, ox, ph, pw, v in found:
                    block[oy:oy + ph, ox:ox + pw] = np.reshape(v, (ph, pw))
                part_y, part_x = (at[t * target.tile:(t + 1) * target.tile] for at, t in ((rows, ty), (cols, tx)))
                top, bottom, fy, in_y = between(part_y, y0, block.shape[0], source.height)
                left, right, fx, in_x = between(part_x, x0, block.shape[1], source.width)
                out, known = np.zeros((len(part_y), len(part_x))), in_y[:, None] & in_x[None]
                for r, wy in ((top, 1 - fy), (bottom, fy)):
                    for c, wx in ((left, 1 - fx), (right, fx)):
                        weight, v = wy[:, None] * wx[None], block[np.ix_(r, c)]
                        known &= (weight == 0) | ~np.isnan(v)
                        out += weight * np.nan_to_num(v)
                flat = [float(v) if ok else None for v, ok in zip(out.ravel(), known.ravel())]
                yield (*key, ty, tx, len(part_y), len(part_x), flat)

        return _framed(sampled(), [*keys, "ty", "tx", "h", "w", value])

    head = f"{_types(tiles, keys)}, ty int, tx int"
    pieces = tiles.select(*keys, "ty", "tx", "h", "w", F.col(value).alias("v")).mapInPandas(cut, f"{head}, oy int, ox int, ph int, pw int, v array<double>")
    return _dealt(pieces, [*keys, "ty", "tx"], ["oy", "ox"]).mapInPandas(sample, f"{head}, h int, w int, `{value}` array<double>")
