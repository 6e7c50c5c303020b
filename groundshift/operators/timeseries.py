"""Per-cell time series over a stack of scenes.

Input rows are cells from ``raster.cells`` partitioned by tile address; every window here is keyed
by (area, ty, tx, pos), which that partitioning already satisfies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indices
from ..functions.indices import STEP_CHANGE
from ..session import attach
from .raster import ADDRESS, CELL, previous_scene

INDEX_COLS = ("ndvi", "swir_enh")


def _over_time(time: str):
    return W.partitionBy(*CELL).orderBy(time)


def differences(cells: DataFrame, time: str = "step") -> DataFrame:
    """Change of NDVI and enhanced SWIR against the previous scene; the first scene drops out.

    ``k`` numbers the differences of a cell from 0.
    """
    w = _over_time(time)
    out = cells.withColumns({
        "d_ndvi": F.col("ndvi") - F.lag("ndvi").over(w),
        "d_swir": F.col("swir_enh") - F.lag("swir_enh").over(w),
        "k": (F.row_number().over(w) - 2).cast("long"),
    })
    return out.filter(F.col("k") >= 0)


def tile_differences(tiles: DataFrame, tile: int, swir_max: DataFrame, time: str = "step") -> DataFrame:
    """Same rows from whole tiles: the lag is taken over tile arrays, which are already sorted by time
    after band alignment, so cells are neither shuffled nor sorted.

    ``swir_max`` has (area, swir_max) for the whole stack.
    """
    w = W.partitionBy(*ADDRESS).orderBy(time)
    bands = ["red", "nir", "swir"]
    t = tiles.withColumn("k", (F.row_number().over(w) - 2).cast("long"))
    pairs = previous_scene(t, bands, time)
    pairs = attach(pairs, swir_max, ["area"], "inner", "swirmax")
    keep = [*ADDRESS, time, "k", "w", "swir_max"]
    c = pairs.select(*keep, F.posexplode(F.arrays_zip(*bands, *[b + "_t0" for b in bands])).alias("pos", "v"))
    v, pos = F.col("v"), F.col("pos")
    enh = lambda b: indices.swir_enhanced(v[b], F.col("swir_max"))
    return c.select(
        *ADDRESS, time, "pos", "k",
        (F.col("ty") * tile + F.floor(pos / F.col("w"))).cast("int").alias("y"), (F.col("tx") * tile + pos % F.col("w")).cast("int").alias("x"),
        (indices.ndvi(v["nir"], v["red"]) - indices.ndvi(v["nir_t0"], v["red_t0"])).alias("d_ndvi"),
        (enh("swir") - enh("swir_t0")).alias("d_swir"),
    )


def step_flags(diffs: DataFrame, change: float = STEP_CHANGE) -> DataFrame:
    """Significant loss, SWIR rise and their conjunction, all strict."""
    out = diffs.withColumns({"loss": F.col("d_ndvi") < -change, "rise": F.col("d_swir") > change})
    return out.withColumn("anomaly", F.col("loss") & F.col("rise"))


def running_anomalies(steps: DataFrame, time: str = "step") -> DataFrame:
    """Running number of anomalous steps and its change from step to step (null at the first)."""
    w = _over_time(time)
    hit = F.when(F.col("anomaly"), 1).otherwise(0)
    out = steps.withColumn("cum_anomalies", F.sum(hit).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("progression", F.col("cum_anomalies") - F.lag("cum_anomalies").over(w))


def cell_history(steps: DataFrame, time: str = "step") -> DataFrame:
    """Per cell: onset (index of the first anomalous difference, -1 if none), persistence in steps,
    and whether the last step is anomalous."""
    return steps.groupBy(*CELL, "y", "x").agg(
        F.coalesce(F.min(F.when(F.col("anomaly"), F.col("k"))), F.lit(-1)).cast("long").alias("onset"),
        F.sum(F.when(F.col("anomaly"), 1).otherwise(0)).cast("long").alias("persistence_steps"),
        F.max_by("anomaly", time).alias("last_anomaly"),
        F.max(time).alias("last_time"),
    )


def persistent_cells(history: DataFrame, min_persistence: int = 2) -> DataFrame:
    """Final mask: anomalous at the last step of the stack and for at least ``min_persistence`` steps."""
    return history.withColumn("persistent", F.col("last_anomaly") & (F.col("persistence_steps") >= min_persistence))


def stack_metadata(cells: DataFrame, progress: DataFrame, history: DataFrame, time: str = "step") -> DataFrame:
    """Per area: first and last time, largest persistence, mean progression over all cells.

    Each part is a partial aggregate down to one row per area before the three meet.
    """
    span = cells.groupBy("area").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    worst = history.groupBy("area").agg(F.max("persistence_steps").alias("max_persistence"))
    rate = progress.groupBy("area").agg(F.avg("progression").alias("mean_progression"))
    return span.join(worst, "area").join(rate, "area")
