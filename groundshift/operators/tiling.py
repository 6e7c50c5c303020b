"""Tile grids: web-map covers, sliding windows over an image, overlap means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import tile_x, tile_y

TILE_SIZE, STRIDE = 256, 128


def _web_ranges(areas: DataFrame, keys: list[str], zooms: list[int], bbox: str) -> DataFrame:
    z = areas.select(*keys, F.col(bbox).alias("b"), F.explode(F.array(*[F.lit(v) for v in zooms])).alias("zoom"))
    return z.select(
        *keys, "zoom", tile_x(F.col("b.min_lon"), F.col("zoom")).alias("x0"), tile_x(F.col("b.max_lon"), F.col("zoom")).alias("x1"),
        tile_y(F.col("b.max_lat"), F.col("zoom")).alias("y0"), tile_y(F.col("b.min_lat"), F.col("zoom")).alias("y1"))


def web_tile_cover(areas: DataFrame, keys: list[str], zooms: list[int], bbox: str = "bbox") -> DataFrame:
    """Every web-map tile that a bbox struct touches, per zoom (the row axis points south). Columns of tiles are
    dealt out before they are filled, so that one large box is not one task."""
    r = _web_ranges(areas, keys, zooms, bbox)
    x = r.select(*keys, "zoom", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("x")).repartition(*keys, "zoom", "x")
    return x.select(*keys, "zoom", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def web_tile_counts(areas: DataFrame, keys: list[str], zooms: list[int], layers: int = 1, bbox: str = "bbox") -> DataFrame:
    """How many web-map tiles a bbox struct touches, per zoom, without listing them."""
    r = _web_ranges(areas, keys, zooms, bbox)
    tiles = ((F.col("x1") - F.col("x0") + 1).cast("long") * (F.col("y1") - F.col("y0") + 1)).alias("tiles")
    return r.select(*keys, "zoom", tiles).withColumn("downloads", F.col("tiles") * layers)


def starts(length: Column, size: int, stride: int, cover_edge: bool = True) -> Column:
    """Window starts along one axis; with ``cover_edge`` a last window reaches the border.
    An axis shorter than the window has none."""
    last = length - size
    grid = F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"), F.lit(stride))
    if cover_edge:
        grid = F.array_distinct(F.concat(grid, F.array(last.cast("int"))))
    return F.when(last >= 0, grid).otherwise(F.array().cast("array<int>"))


def sliding_tiles(images: DataFrame, keys: list[str], size: int = TILE_SIZE, stride: int = STRIDE, cover_edge: bool = True) -> DataFrame:
    """One row per window (y0, x0) of each image row (height, width)."""
    rows = images.select(*keys, F.explode(starts(F.col("height"), size, stride, cover_edge)).alias("y0"), "width")
    return rows.select(*keys, "y0", F.explode(starts(F.col("width"), size, stride, cover_edge)).alias("x0"))


def _covering(v: Column, length: Column, size: int, stride: int, cover_edge: bool) -> Column:
    """Window starts that contain coordinate ``v``: at most ceil(size/stride) + 1 of them."""
    lo = F.greatest(F.ceil((v - size + 1) / stride), F.lit(0))
    hi = F.least(F.floor(v / stride), F.floor((length - size) / stride))
    inner = F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(hi, lo)), lambda i: (i * stride).cast("int"))).otherwise(F.array().cast("array<int>"))
    if not cover_edge:
        return inner
    last = (length - size).cast("int")
    return F.when((last >= 0) & (v >= last), F.array_distinct(F.concat(inner, F.array(last)))).otherwise(inner)


def tile_membership(cell_rows: DataFrame, height: Column, width: Column, size: int = TILE_SIZE, stride: int = STRIDE, cover_edge: bool = True) -> DataFrame:
    """Each cell with every window that covers it, worked out from its coordinates alone (no join)."""
    ok = (height >= size) & (width >= size)
    rows = cell_rows.filter(ok).withColumn("y0", F.explode(_covering(F.col("y"), height, size, stride, cover_edge)))
    return rows.withColumn("x0", F.explode(_covering(F.col("x"), width, size, stride, cover_edge)))


# ---- windows cut from tiles and put back into tiles ------------------------------------------------------------


def window_starts(length: int, size: int, stride: int, cover_edge: bool = True) -> np.ndarray:
    """Window starts along one axis, as ``starts`` gives them."""
    last = length - size
    if last < 0:
        return np.zeros(0, int)
    grid = np.arange(0, last + 1, stride)
    return np.append(grid, last) if cover_edge and grid[-1] != last else grid


def _overlapping(at: np.ndarray, size: int, lo: int, hi: int) -> list[int]:
    """Starts of the windows that touch the cells from ``lo`` to before ``hi``."""
    return at[(at < hi) & (at + size > lo)].tolist()


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _groups(parts: Iterator[pd.DataFrame], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that share their first columns and lie one after the other."""
    held, rows = None, []
    for pdf in parts:
        for row in pdf.itertuples(index=False, name=None):
            if rows and row[:n_keys] != held:
                yield held, rows
                rows = []
            held = row[:n_keys]
            rows.append(row[n_keys:])
    if rows:
        yield held, rows


def _framed(rows: Iterator[tuple], names: list[str], batch: int = 256, limit: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Frames of at most ``batch`` rows, closed once their arrays have ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(x.nbytes for x in row if isinstance(x, np.ndarray))
        if len(held) == batch or size >= limit:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


Step = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_ARROW = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def mapped(rows: DataFrame, keys: list[str], step: Step, made: dict[str, str], at_once: int = 256) -> DataFrame:
    """Rows (keys, ``made``) of a step over frames; ``made`` names columns and their types.

    A frame has at most ``at_once`` rows, whose arrays lie in the Arrow batch that they came in, so a worker holds one batch and
    little else. Steps that follow one another without a shuffle belong into one call: each call has a worker for each running task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = []

        def frames() -> Iterator[pd.DataFrame]:
            for b in batches:
                fields[:] = [b.schema.field(k) for k in keys]
                for i in range(0, b.num_rows, at_once):
                    yield b.slice(i, at_once).to_pandas()

        for frame in step(frames()):
            yield pa.RecordBatch.from_pandas(frame, pa.schema([*fields, *[(n, _ARROW[t]) for n, t in made.items()]]), preserve_index=False)

    return rows.mapInArrow(run, ", ".join([_types(rows, keys), *[f"`{n}` {t}" for n, t in made.items()]]))


def _dealt(pieces: DataFrame, by: list[str], then: list[str]) -> DataFrame:
    """Pieces of each group in one task and one after the other. A group has a bounded number of pieces."""
    return pieces.repartition(*by).sortWithinPartitions(*by, *then)


def _window_pieces(tiles: DataFrame, keys: list[str], tile: int, height: int, width: int, n_channels: int, size: int, stride: int,
                   cover_edge: bool, values: str) -> DataFrame:
    """Tiles cut at window borders, the pieces of a window one after the other."""
    ys, xs = window_starts(height, size, stride, cover_edge), window_starts(width, size, stride, cover_edge)
    place = ["y0", "x0", "oy", "ox", "ph", "pw"]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[tuple]:
            for pdf in parts:
                for *key, ty, tx, h, w, v in pdf.itertuples(index=False, name=None):
                    block = np.asarray(v, dtype=float).reshape(h, w, n_channels)
                    block = np.where(np.isnan(block).any(axis=2, keepdims=True), 0.0, block)
                    y, x = ty * tile, tx * tile
                    for y0 in _overlapping(ys, size, y, y + h):
                        top, bottom = max(y, y0), min(y + h, y0 + size)
                        for x0 in _overlapping(xs, size, x, x + w):
                            left, right = max(x, x0), min(x + w, x0 + size)
                            piece = block[top - y:bottom - y, left - x:right - x]
                            yield (*key, y0, x0, top - y0, left - x0, bottom - top, right - left, piece.ravel())

        return _framed(pieces(), [*keys, *place, "values"])

    rows = tiles.select(*keys, "ty", "tx", "h", "w", F.col(values).alias("values"))
    return _dealt(mapped(rows, keys, cut, dict.fromkeys(place, "int") | {"values": "array<double>"}), [*keys, "y0", "x0"], ["oy", "ox"])


def _put(keys: list[str], n_channels: int, size: int) -> Step:
    """Windows (keys, y0, x0, values) of their pieces."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def windows() -> Iterator[tuple]:
            for key, rows in _groups(parts, len(keys) + 2):
                out = np.zeros((size, size, n_channels))
                for oy, ox, ph, pw, v in rows:
                    out[oy:oy + ph, ox:ox + pw] = np.reshape(v, (ph, pw, n_channels))
                yield (*key, out.ravel())

        return _framed(windows(), [*keys, "y0", "x0", "values"])

    return put


def cut_windows(tiles: DataFrame, keys: list[str], tile: int, height: int, width: int, n_channels: int, size: int = TILE_SIZE, stride: int = STRIDE,
                cover_edge: bool = True, values: str = "values") -> DataFrame:
    """Windows (keys, y0, x0, values) of images given as tiles (keys, ty, tx, h, w, values).

    ``values`` holds the channels of one cell after those of the other, row by row. Tiles are cut at window borders and the pieces
    are shuffled once, whole arrays of them. A cell without a tile or with a null channel is zeros; a window without any tile is
    left out.
    """
    pieces = _window_pieces(tiles, keys, tile, height, width, n_channels, size, stride, cover_edge, values)
    return mapped(pieces, [*keys, "y0", "x0"], _put(keys, n_channels, size), {"values": "array<double>"})


def score_windows(tiles: DataFrame, keys: list[str], tile: int, height: int, width: int, n_channels: int, score: Step, size: int = TILE_SIZE,
                  stride: int = STRIDE, cover_edge: bool = True, values: str = "values") -> DataFrame:
    """Windows (keys, y0, x0, p, confidence) of ``cut_windows``, scored by the worker that puts them together."""
    pieces = _window_pieces(tiles, keys, tile, height, width, n_channels, size, stride, cover_edge, values)
    put = _put(keys, n_channels, size)
    return mapped(pieces, [*keys, "y0", "x0"], lambda parts: score(put(parts)), {"p": "array<double>", "confidence": "double"})


_PIECE = {**dict.fromkeys(["ty", "tx", "oy", "ox", "h", "w"], "int"), "p": "array<double>", "confidence": "double"}


def _cut_back(keys: list[str], tile: int, size: int) -> Step:
    """Scored windows (keys, y0, x0, p, confidence) cut at tile borders."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[tuple]:
            for pdf in parts:
                for *key, y0, x0, p, confidence in pdf.itertuples(index=False, name=None):
                    window = np.reshape(p, (size, size))
                    for ty in range(y0 // tile, (y0 + size - 1) // tile + 1):
                        top, bottom = max(ty * tile, y0), min(ty * tile + tile, y0 + size)
                        for tx in range(x0 // tile, (x0 + size - 1) // tile + 1):
                            left, right = max(tx * tile, x0), min(tx * tile + tile, x0 + size)
                            piece = window[top - y0:bottom - y0, left - x0:right - x0]
                            yield (*key, ty, tx, top - ty * tile, left - tx * tile, bottom - top, right - left, piece.ravel(), confidence)

        return _framed(pieces(), [*keys, *_PIECE])

    return cut


def _added(pieces: DataFrame, tiles: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Means of the pieces of scored windows for each of the ``tiles``."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def merged() -> Iterator[tuple]:
            for key, rows in _groups(parts, len(keys) + 2):
                oy, _, h, w, *_ = rows[0]
                if oy >= 0:
                    continue  # windows reach beyond the tiles there are
                sums, n = np.zeros((2, tile, tile)), np.zeros((tile, tile))
                for oy, ox, ph, pw, p, confidence in rows[1:]:
                    at = slice(oy, oy + ph), slice(ox, ox + pw)
                    sums[0][at] += np.reshape(p, (ph, pw))
                    sums[1][at] += confidence
                    n[at] += 1
                mean = (sums / np.maximum(n, 1))[:, :h, :w].reshape(2, -1)
                yield (*key, h, w, mean[0], mean[1])

        return _framed(merged(), [*keys, "ty", "tx", "h", "w", "p", "confidence"])

    nothing = F.lit(None)
    known = tiles.select(*keys, "ty", "tx", F.lit(-1).alias("oy"), F.lit(-1).alias("ox"), "h", "w", nothing.cast("array<double>").alias("p"), nothing.cast("double").alias("confidence"))
    # the order of the sum is fixed, so the mean does not depend on the partitioning
    dealt = _dealt(known.unionByName(pieces), [*keys, "ty", "tx"], ["oy", "ox", "h", "w", "confidence", "p"])
    return mapped(dealt, [*keys, "ty", "tx"], add, {"h": "int", "w": "int", "p": "array<double>", "confidence": "array<double>"})


def overlap_mean(scored: DataFrame, tiles: DataFrame, keys: list[str], tile: int, size: int = TILE_SIZE) -> DataFrame:
    """Tiles (keys, ty, tx, h, w, p, confidence) with the mean over all windows that cover a cell, 0 where none does.

    ``scored`` has windows (keys, y0, x0, p, confidence); ``tiles`` (keys, ty, tx, h, w) says which tiles there are. Windows are cut
    at tile borders and the pieces are shuffled once; a tile adds up the pieces' arrays and counts.
    """
    windows = scored.select(*keys, "y0", "x0", "p", "confidence")
    return _added(mapped(windows, keys, _cut_back(keys, tile, size), _PIECE), tiles, keys, tile)


def overlap_scores(tiles: DataFrame, keys: list[str], tile: int, height: int, width: int, n_channels: int, score: Step, size: int = TILE_SIZE,
                   stride: int = STRIDE, cover_edge: bool = True, values: str = "values") -> DataFrame:
    """``overlap_mean`` of ``score_windows``; one worker puts the windows together, scores them and cuts them again."""
    pieces = _window_pieces(tiles, keys, tile, height, width, n_channels, size, stride, cover_edge, values)
    put, back = _put(keys, n_channels, size), _cut_back(keys, tile, size)
    return _added(mapped(pieces, keys, lambda parts: back(score(put(parts))), _PIECE), tiles, keys, tile)


# ---- label rasters and chips ---------------------------------------------------------------------------------


def _first(value: Column, scale: float, offset: float, n: int) -> Column:
    """First of the indices 0 to ``n`` whose centre ``scale * (i + 0.5) + offset`` has reached ``value``: is not below it on a rising
    axis, is below it on a falling one. Guessed by division and settled by the centres themselves."""
    there = lambda i: (F.lit(scale) * (i + 0.5) + F.lit(offset) >= value) if scale > 0 else (F.lit(scale) * (i + 0.5) + F.lit(offset) < value)
    guess = F.ceil((value - F.lit(offset)) / F.lit(scale) - 0.5)
    first = F.when(there(guess - 1), guess - 1).when(there(guess), guess).otherwise(guess + 1)
    return F.least(F.greatest(first, F.lit(0)), F.lit(n)).cast("int")


def _span(low: Column, high: Column, scale: float, offset: float, n: int) -> tuple[Column, Column]:
    """Begin and end of the indices whose centres lie in [low, high)."""
    ends = _first(low, scale, offset, n), _first(high, scale, offset, n)
    return ends if scale > 0 else ends[::-1]


def rasterise(polygons: DataFrame, grid: dict[str, float], height: int, width: int, ring: str = "ring", keys: list[str] | None = None) -> DataFrame:
    """Cells (y, x) of a north-up grid whose centre lies inside any polygon (even-odd rule).

    Scan lines: each edge crosses the rows of centres between its ends, the crossings of a ring with a row are sorted, and cells
    between the first and the second, the third and the fourth, ... are filled. The work is that of the crossings and the filled
    cells. Rings are told apart by two hashes, so equal ones count once.
    """
    keys = keys or []
    a, c, e, f = (float(grid[k]) for k in "acef")
    rings = polygons.filter(F.col(ring).isNotNull()).select(*keys, F.col(ring).alias("_r"), F.xxhash64(ring).alias("_h"), F.hash(ring).alias("_g")).dropDuplicates([*keys, "_h", "_g"])
    n = F.size("_r")
    edges = rings.filter(n > 1).select(*keys, "_h", "_g", F.inline(F.arrays_zip(F.slice("_r", F.lit(1), n - 1).alias("p"), F.slice("_r", F.lit(2), n - 1).alias("q"))))
    at = lambda point, i: F.get(point, F.lit(i))
    px, py, qx, qy = at("p", 0), at("p", 1), at("q", 0), at("q", 1)
    begin, end = _span(F.least(py, qy), F.greatest(py, qy), e, f, height)
    rows = edges.select("*", begin.alias("_from"), end.alias("_to")).filter("_from < _to")
    rows = rows.withColumn("y", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    lat = F.lit(e) * (F.col("y") + 0.5) + F.lit(f)
    crossed = rows.select(*keys, "_h", "_g", "y", ((qx - px) * (lat - py) / (qy - py) + px).alias("_t"))
    lines = crossed.groupBy(*keys, "_h", "_g", "y").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_t") / 2).cast("int") - 1), lambda i: F.struct(F.get("_t", 2 * i).alias("s"), F.get("_t", 2 * i + 1).alias("t")))
    spans = lines.filter(F.size("_t") > 1).select(*keys, "y", F.inline(pairs))
    begin, end = _span(F.col("s"), F.col("t"), a, c, width)
    spans = spans.select(*keys, "y", begin.alias("_from"), end.alias("_to")).filter("_from < _to")
    return spans.select(*keys, "y", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("x")).distinct()


def chip_id(scene: Column, y0: Column, x0: Column) -> Column:
    return F.concat(scene.cast("string"), F.lit("_y"), y0.cast("string"), F.lit("_x"), x0.cast("string"))


def sampled(ident: Column, one_in: int = 10) -> Column:
    """Reproducible one-in-n choice from the hash of an id, the same on every engine."""
    return F.conv(F.substring(F.md5(ident), 1, 8), 16, 10).cast("long") % one_in == 0


def choose_chips(images: DataFrame, label_cells: DataFrame, scene: str, size: int = TILE_SIZE, stride: int = STRIDE,
                 height: int | None = None, width: int | None = None, one_in: int = 10) -> DataFrame:
    """Chips of every scene that hold a label cell, plus one in ``one_in`` of the empty ones.

    ``images`` has (scene, height, width); label cells are on the shared grid of the scenes' area.
    """
    chips = sliding_tiles(images, [scene], size, stride, cover_edge=False)
    hot = tile_membership(label_cells, F.lit(height), F.lit(width), size, stride, cover_edge=False)
    hot = hot.groupBy("y0", "x0").agg(F.count("*").alias("n_label_cells"))
    chips = chips.join(hot, ["y0", "x0"], "left").withColumn("n_label_cells", F.coalesce("n_label_cells", F.lit(0)).cast("long"))
    chips = chips.withColumn("chip_id", chip_id(F.col(scene), F.col("y0"), F.col("x0")))
    return chips.filter((F.col("n_label_cells") > 0) | sampled(F.col("chip_id"), one_in))


def _field(structs: str, name: str) -> Column:
    return F.transform(structs, lambda s: s[name])


def cut_chips(cell_rows: DataFrame, chips: DataFrame, keys: list[str], payload: list[str], size: int, stride: int,
              height: Column, width: Column, cover_edge: bool) -> DataFrame:
    """Row-major cell arrays of the wanted chips. Cells outside them are dropped before the shuffle; a
    chip's list has a fixed size. Missing cells are left out."""
    member = tile_membership(cell_rows, height, width, size, stride, cover_edge)
    member = member.join(chips.select(*keys, "y0", "x0"), [*keys, "y0", "x0"], "left_semi")
    packed = member.groupBy(*keys, "y0", "x0").agg(F.sort_array(F.collect_list(F.struct("y", "x", *payload))).alias("_c"))
    return packed.select(*keys, "y0", "x0", *[_field("_c", p).alias(p) for p in payload])


def tile_index(pairs: DataFrame, key: str, size: int = TILE_SIZE, stride: int = STRIDE) -> DataFrame:
    """One row per paired image and window, no edge windows."""
    return sliding_tiles(pairs, [key], size, stride, cover_edge=False)
