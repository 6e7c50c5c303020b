"""Batch tile scoring and segmentation metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiling import Step, mapped

# Loss constants.
FOCAL_ALPHA, FOCAL_GAMMA = 0.25, 2.0
DICE_WEIGHT, FOCAL_WEIGHT, BCE_WEIGHT, DETECTION_WEIGHT = 1.0, 1.0, 0.5, 0.5
SMOOTH = 1e-6

Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def linear_scorer() -> Scorer:
    """Reproducible stand-in for a model: p = sigmoid(2 swir - 3 ndvi), tile confidence = mean p."""

    def run(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-(2.0 * batch[:, 2] - 3.0 * batch[:, 3])))
        return p, p.reshape(len(p), -1).mean(axis=1)

    return run


def scoring(keys: list[str], build: Callable[[], Scorer] = linear_scorer, n_channels: int = 6, batch: int = 64, values: str = "values") -> Step:
    """Step over frames (keys, ``values``) that gives (keys, p, confidence). The model is built once per task and fed batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = build()
        for pdf in parts:
            for n, same in pdf.groupby(pdf[values].map(len), sort=False):
                for i in range(0, len(same), batch):
                    part = same.iloc[i:i + batch]
                    stack = np.stack(part[values].to_list()).reshape(len(part), n // n_channels, n_channels).transpose(0, 2, 1)
                    p, c = scorer(stack)
                    yield part[keys].assign(p=list(p), confidence=c)

    return run


def score_tiles(tiles: DataFrame, keys: list[str], build: Callable[[], Scorer] = linear_scorer, values: str | None = None, n_channels: int = 6,
                batch: int = 64) -> DataFrame:
    """Apply a model to tile rows: cell probabilities and one confidence per tile.

    ``values`` holds the channels of one cell after those of the other; by default it is the column of that name, or ``channels``,
    an array for each cell. The model is built once per task and fed batches;
    tiles stay where they are.
    """
    nested = values is None and "values" not in tiles.columns
    rows = tiles.select(*keys, (F.flatten("channels") if nested else F.col(values or "values")).alias("_v"))
    return mapped(rows, keys, scoring(keys, build, n_channels, batch, "_v"), {"p": "array<double>", "confidence": "double"})


# ---- metrics ------------------------------------------------------------------------------------------------------


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def tile_labels(cells: DataFrame, keys: list[str], truth: str = "truth") -> DataFrame:
    """1 where a tile has any positive cell."""
    return cells.groupBy(*keys).agg(F.max(F.col(truth).cast("int")).alias("has_target"))


def mean_iou(cells: DataFrame, keys: list[str], prob: str = "p", truth: str = "truth", threshold: float = 0.5) -> DataFrame:
    """IoU per tile at the threshold, averaged over tiles."""
    pred, t = F.col(prob) > threshold, F.col(truth)
    per = cells.groupBy(*keys).agg(_n(pred & t).alias("i"), _n(pred | t).alias("u"))
    return per.agg(F.avg(F.col("i") / (F.col("u") + SMOOTH)).alias("mean_iou"), F.count("*").alias("n_tiles"))


def dice_loss(prob: Column, truth: Column) -> Column:
    return F.lit(1.0) - (F.sum(prob * truth) * 2.0 + SMOOTH) / (F.sum(prob) + F.sum(truth) + SMOOTH)


def bce_with_logits(z: Column, truth: Column) -> Column:
    """Binary cross entropy of a logit, in the overflow-free form."""
    return F.greatest(z, F.lit(0.0)) - z * truth + F.log1p(F.exp(-F.abs(z)))


def focal(z: Column, truth: Column) -> Column:
    b = bce_with_logits(z, truth)
    return F.lit(FOCAL_ALPHA) * F.pow(F.lit(1.0) - F.exp(-b), F.lit(FOCAL_GAMMA)) * b


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def losses(cells: DataFrame, tiles: list[str], logit: str = "logit", truth: str = "truth") -> DataFrame:
    """Segmentation losses over all cells, detection loss over tiles (logit: tile mean) and their total."""
    z, t = F.col(logit), F.col(truth).cast("double")
    seg = cells.agg(dice_loss(sigmoid(z), t).alias("dice"), F.avg(focal(z, t)).alias("focal"), F.avg(bce_with_logits(z, t)).alias("bce"))
    per = cells.groupBy(*tiles).agg(F.avg(z).alias("z"), F.max(t).alias("t"))
    det = per.agg(F.avg(bce_with_logits(F.col("z"), F.col("t"))).alias("detection"))
    one = F.lit(1).alias("_one")
    both = seg.select("*", one).join(det.select("*", one), "_one").drop("_one")
    both = both.withColumn("segmentation", F.col("dice") * DICE_WEIGHT + F.col("focal") * FOCAL_WEIGHT + F.col("bce") * BCE_WEIGHT)
    return both.withColumn("total", F.col("segmentation") + F.col("detection") * DETECTION_WEIGHT)


def precision_recall(cells: DataFrame, prob: str = "p", truth: str = "truth", threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    pred, t = F.col(prob) > threshold, F.col(truth)
    c = cells.groupBy(*(by or [])).agg(_n(pred & t).alias("tp"), _n(pred & ~t).alias("fp"), _n(~pred & t).alias("fn"), _n(~pred & ~t).alias("tn"))
    safe = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(a) + F.col(b) > 0, F.col(a) + F.col(b)), F.lit(0.0))
    return c.withColumns({"precision": safe("tp", "fp"), "recall": safe("tp", "fn"),
                          "iou": F.coalesce(F.col("tp") / F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))})
