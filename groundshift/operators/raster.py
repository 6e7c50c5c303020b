"""Map algebra on tiles and cells.

A tile row holds one image block as row-major arrays, one per band. All work that needs other
scenes of the same place is keyed by the tile address (area, ty, tx): the compact arrays are
shuffled once on that address, and every later window over a cell (area, ty, tx, pos) reuses the
partitioning, so cells themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indices
from ..session import attach

ADDRESS = ["area", "ty", "tx"]
CELL = ADDRESS + ["pos"]


def align_bands(band_tiles: DataFrame, bands: dict[str, str], time: str = "step", extra: list[str] | None = None,
                strict: bool = False, scene: str | None = None, placed: bool = False) -> DataFrame:
    """One row per scene tile with one array column per logical band.

    ``bands`` maps logical names to asset names. A scene tile that lacks a band is dropped whole, or
    fails the job when ``strict``; bands of different size always fail it. With ``scene``, bands are only put together
    within a scene, and of scenes with one time the first complete one gives the tile. One shuffle, of arrays, on
    the tile address, which a table bucketed by it (``placed``) does without.
    """
    pick = [
        F.first(F.when(F.col("band") == asset, F.col("data")), ignorenulls=True).alias(name)
        for name, asset in bands.items()
    ]
    passed = [F.first(c).alias(c) for c in (extra or [])]
    wanted = band_tiles.filter(F.col("band").isin(*bands.values()))
    wide = (
        (wanted if placed else wanted.repartition(*ADDRESS))
        .groupBy(*ADDRESS, time, *([scene] if scene else []))
        .agg(*passed, *pick)
    )
    first, *others = bands
    for name in others:
        differs = F.size(name) != F.size(first)
        wide = wide.withColumn(name, F.when(differs, F.raise_error(F.lit("bands of different size: resample them to one grid first"))).otherwise(F.col(name)))
    if strict:
        whole = F.lit(True)
        for name in bands:
            whole = whole & F.col(name).isNotNull()
        return wide.withColumn(first, F.when(whole, F.col(first)).otherwise(F.raise_error(F.lit("required band missing"))))
    wide = wide.dropna(subset=list(bands))
    if scene:
        order = W.partitionBy(*ADDRESS, time).orderBy(scene)
        wide = wide.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    return wide


def complete_scenes(band_tiles: DataFrame, required: list[str], scene: str | list[str] = "scene") -> DataFrame:
    """Scenes that have every required band; ``scene`` names the column or columns that tell scenes apart."""
    return (
        band_tiles.filter(F.col("band").isin(*required))
        .groupBy(*([scene] if isinstance(scene, str) else scene))
        .agg(F.count_distinct("band").alias("n_bands"))
        .filter(F.col("n_bands") == len(required))
    )


def cells(tiles: DataFrame, bands: list[str], tile: int, time: str = "step", carry: list[str] | None = None) -> DataFrame:
    """One row per cell: address, pos inside the tile, image row/column, the band values and the
    per-tile columns named in ``carry``."""
    keep = [c for c in (*ADDRESS, time, "h", "w", *(carry or [])) if c in tiles.columns]
    out = tiles.select(*keep, F.posexplode(F.arrays_zip(*bands)).alias("pos", "v"))
    pos = F.col("pos")
    return out.select(
        *[c for c in keep if c not in ("h", "w")], "pos",
        (F.col("ty") * tile + F.floor(pos / F.col("w"))).cast("int").alias("y"),
        (F.col("tx") * tile + pos % F.col("w")).cast("int").alias("x"),
        *[F.col("v")[b].alias(b) for b in bands],
    )


def with_indices(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.withColumns({
        "ndvi": indices.ndvi(F.col("nir"), F.col("red")),
        "nbr": indices.nbr(F.col("nir"), F.col("swir")),
    })


def previous_scene(tiles: DataFrame, bands: list[str], time: str = "step") -> DataFrame:
    """Pair each tile with the same tile of the scene before it: ``<band>_t0`` arrays.

    A lag over whole tiles: the bitemporal join of two scenes without shuffling or matching cells.
    """
    w = W.partitionBy(*ADDRESS).orderBy(time)
    return tiles.withColumns({b + "_t0": F.lag(b).over(w) for b in bands}).filter(F.col(bands[0] + "_t0").isNotNull())


def pair_scenes(tiles_t0: DataFrame, tiles_t1: DataFrame, bands: list[str], on: list[str] = ADDRESS) -> DataFrame:
    """Equi join of two explicit scenes by tile address; arrays of different length fail the job."""
    t0 = tiles_t0.select(*on, *[F.col(b).alias(b + "_t0") for b in bands])
    out = tiles_t1.join(t0, on)
    same = F.size(bands[0]) == F.size(bands[0] + "_t0")
    return out.withColumn(bands[0], F.when(same, F.col(bands[0])).otherwise(F.raise_error(F.lit("scene grids differ"))))


def change_cells(pairs: DataFrame, tile: int, time: str = "step") -> DataFrame:
    """Cells of a scene pair with both NDVI values, their difference and the anomaly flag."""
    c = cells(pairs, ["red", "nir", "swir", "red_t0", "nir_t0"], tile, time)
    c = c.withColumns({
        "ndvi_t0": indices.ndvi(F.col("nir_t0"), F.col("red_t0")),
        "ndvi_t1": indices.ndvi(F.col("nir"), F.col("red")),
    })
    c = c.withColumn("delta_ndvi", F.col("ndvi_t1") - F.col("ndvi_t0"))
    return c.withColumn("anomaly", indices.vegetation_to_bare(F.col("delta_ndvi"), F.col("swir")))


def tile_algebra(arrays: list[Column], expr) -> Column:
    """Apply a cell expression to aligned tile arrays without exploding them."""
    zipped = F.arrays_zip(*[a.alias(f"a{i}") for i, a in enumerate(arrays)])
    return F.transform(zipped, lambda s: expr(*[s[f"a{i}"] for i in range(len(arrays))]))


def stack_max(tiles: DataFrame, band: str, over: list[str]) -> DataFrame:
    """Largest cell of a band per group, from per-tile maxima (partial aggregation, no explode)."""
    return tiles.groupBy(*over).agg(F.max(F.array_max(band)).alias(band + "_max"))


def attach_max(tiles: DataFrame, band: str, over: list[str], out: str) -> DataFrame:
    """Each tile with the band's maximum over ``over`` (an area's whole stack, or one scene).

    Attached to tiles, before anything is exploded: a summary too large to broadcast costs a shuffle
    of tiles, never of cells.
    """
    return attach(tiles, stack_max(tiles, band, over).withColumnRenamed(band + "_max", out), over, "inner", "max")


def with_swir_enhanced(tiles: DataFrame, bands: list[str], tile: int, over: list[str], time: str = "step") -> DataFrame:
    """Cells with indices and SWIR relative to its maximum over ``over``."""
    rows = cells(attach_max(tiles, "swir", over, "swir_max"), bands, tile, time, carry=["swir_max"])
    return with_indices(rows).withColumn("swir_enh", indices.swir_enhanced(F.col("swir"), F.col("swir_max"))).drop("swir_max")


def exact_percentile(rows: DataFrame, keys: list[str], value: str, q: float, out: str = "pct", accuracy: int = 10000) -> DataFrame:
    """Exact linear-interpolated percentile per key, without collecting a key's values anywhere.

    A mergeable sketch gives a bracket around the wanted rank (error at most n/accuracy on each
    side); the rows below it are only counted and the distinct values inside it are ranked exactly.
    Only about 6/accuracy of a group, less its repeats, is ever sorted together; groups of up to
    ``accuracy`` rows are ranked whole, since there the bracket could be narrower than one rank.
    """
    slack = 3.0 / accuracy
    probs = F.array(F.lit(max(q - slack, 0.0)), F.lit(min(q + slack, 1.0)))
    value_rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = value_rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", probs, F.lit(accuracy)).alias("_b"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # at the ends of the range the sketch error could cut off the extreme itself
    small = F.col("_n") <= accuracy
    sketch = sketch.select(*keys, "_n",
                           F.when(small | F.lit(q - slack <= 0.0), F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
                           F.when(small | F.lit(q + slack >= 1.0), F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"))
    tagged = attach(value_rows, sketch, keys, "inner", "bracket")
    counted = (
        tagged.filter(F.col("_v") <= F.col("_hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(*keys, "_n", "_v")
        .agg(F.count("*").alias("_c"))
    )
    w = W.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_c").over(w))
    r = F.lit(q) * (F.col("_n") - 1)
    lo, hi = F.floor(r), F.ceil(r)
    hit = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_v")))
    picked = ranked.groupBy(*keys, "_n").agg(hit(lo).alias("_a"), hit(hi).alias("_z"))
    frac = r - lo
    return picked.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * frac).alias(out))


SKETCH_K = 4096  # size of a percentile sketch, a few ten kilobytes


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Rank error of a KLL sketch as a share of the rows, kept in 99 of 100 cases: 0.13 % at the default size."""
    return 2.296 / k ** 0.9021


def percentile_sketches(rows: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, n, sketch): a KLL sketch of each group, to be stored beside the scenes and merged later without reading a cell."""
    known = rows.filter(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def sketched_percentile(sketches: DataFrame, keys: list[str], q: float, out: str = "pct", k: int = SKETCH_K) -> DataFrame:
    """Approximate percentile of groups of sketches: a value whose rank is off by ``sketch_rank_error`` of the rows at most.
    ``exact_percentile`` is the default everywhere; this is for callers who ask for it."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(out))


def radar_change(tiles: DataFrame, tile: int, time: str = "step", sketch: int | None = None) -> DataFrame:
    """Radar cells of consecutive scenes: ratios, coherence loss, exceedance of the earlier scene's 90th percentile, and their
    conjunction. With ``sketch`` the percentile comes from KLL sketches of that size instead of exactly."""
    # the percentile of the earlier scene is taken over all of its cells, each counted once
    scene_cells = cells(tiles, ["vv", "vh"], tile, time).select(
        "area", F.col(time).alias("scene_time"),
        F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in ("vv", "vh")])))
    by = ["area", "scene_time", "band"]
    if sketch:
        p = sketched_percentile(percentile_sketches(scene_cells, by, "v", sketch), by, 0.9, "p90", sketch)
    else:
        p = exact_percentile(scene_cells, by, "v", 0.9, "p90")
    p = p.groupBy("area", "scene_time").agg(*[F.max(F.when(F.col("band") == b, F.col("p90"))).alias("p90_" + b) for b in ("vv", "vh")])
    w = W.partitionBy("area").orderBy(time)
    before = tiles.select("area", time).distinct().withColumn("scene_time", F.lag(time).over(w)).filter(F.col("scene_time").isNotNull())
    p90 = before.join(p, ["area", "scene_time"]).drop("scene_time")
    pairs = attach(previous_scene(tiles, ["vv", "vh"], time), p90, ["area", time], "inner", "p90")
    c = cells(pairs, ["vv", "vh", "vv_t0", "vh_t0"], tile, time, carry=["p90_vv", "p90_vh"])
    c = c.withColumns({
        "vv_ratio": indices.backscatter_ratio(F.col("vv"), F.col("vv_t0")),
        "vh_ratio": indices.backscatter_ratio(F.col("vh"), F.col("vh_t0")),
    })
    c = c.withColumns({
        "coherence_loss": indices.coherence_loss(F.col("vv_ratio"), F.col("vh_ratio")),
        "backscatter_increase": indices.exceeds(F.col("vv"), F.col("p90_vv")) | indices.exceeds(F.col("vh"), F.col("p90_vh")),
    })
    return c.withColumn("anomaly", F.col("coherence_loss") & F.col("backscatter_increase"))


def feature_stack(cell_rows: DataFrame) -> DataFrame:
    """Six channels per cell: red, nir, swir, NDVI, 0, enhanced SWIR."""
    return cell_rows.withColumn("channels", F.array("red", "nir", "swir", "ndvi", F.lit(0.0), "swir_enh"))


def mask_tiles(cell_rows: DataFrame, flag: str, tile: int, time: str = "step") -> DataFrame:
    """Pack a boolean cell column back into tile arrays. Rows of a tile are already together, and a
    tile has a fixed number of cells, so the list per group is bounded by the tile size."""
    packed = cell_rows.groupBy(*ADDRESS, time).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col(flag).cast("tinyint").alias("m")))).alias("_c"),
        (F.max("y") - F.min("y") + 1).cast("int").alias("h"), (F.max("x") - F.min("x") + 1).cast("int").alias("w"),
    )
    return packed.select(*ADDRESS, time, "h", "w", F.transform("_c", lambda s: s["m"]).alias("mask"))


def mask_cells(tiles: DataFrame, tile: int, time: str = "step") -> DataFrame:
    return cells(tiles, ["mask"], tile, time)


def mask_statistics(prob_cells: DataFrame, keys: list[str], prob: str = "p", threshold: float = 0.5) -> DataFrame:
    """Mask size, highest probability and mean probability inside the mask (0 when empty)."""
    inside = F.col(prob) > threshold
    return prob_cells.groupBy(*keys).agg(
        F.sum(F.when(inside, 1).otherwise(0)).cast("long").alias("total_area_px"),
        F.max(prob).alias("max_probability"),
        F.coalesce(F.avg(F.when(inside, F.col(prob))), F.lit(0.0)).alias("mean_probability"),
    )


def feature_tiles(tiles: DataFrame, over: list[str]) -> DataFrame:
    """Tiles with ``values``: the six channels of ``feature_stack`` of one cell after those of the other, nulls kept.

    SWIR is relative to its maximum over ``over``. The arrays are made in the tile's own row.
    """
    out = attach_max(tiles, "swir", over, "swir_max")

    def channels(red: Column, nir: Column, swir: Column) -> Column:
        return F.array(red, nir, swir, indices.ndvi(nir, red), F.lit(0.0), indices.swir_enhanced(swir, F.col("swir_max")))

    values = F.flatten(tile_algebra([F.col("red"), F.col("nir"), F.col("swir")], channels))
    return out.withColumn("values", values).drop("swir_max")
