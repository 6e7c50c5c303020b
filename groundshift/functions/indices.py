"""Spectral and radar cell expressions. Inputs are DOUBLE columns of one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detection thresholds and channel statistics the results depend on.
EPS = 1e-10
NDVI_DELTA_MAX = -0.35
SWIR_MIN = 0.25
STEP_CHANGE = 0.15
COHERENCE_RATIO = 0.7
BACKSCATTER_FACTOR = 1.3
CHANNEL_MEAN = (0.15, 0.25, 0.12, 0.0, 0.0, 0.15)
CHANNEL_STD = (0.1, 0.15, 0.08, 0.3, 0.2, 0.1)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]."""
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


def ratio_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b + 1e-10), 0 where that denominator is 0."""
    den = a + b + F.lit(EPS)
    return F.when(den != 0.0, (a - b) / den).otherwise(F.lit(0.0))


def ndvi(nir: Column, red: Column) -> Column:
    return clip(ratio_index(nir, red), -1.0, 1.0)


def nbr(nir: Column, swir: Column) -> Column:
    return ratio_index(nir, swir)


def swir_enhanced(swir: Column, swir_max: Column) -> Column:
    return clip(swir / (swir_max + F.lit(EPS)), 0.0, 1.0)


def vegetation_to_bare(delta_ndvi: Column, swir: Column,
                       ndvi_max: float = NDVI_DELTA_MAX, swir_min: float = SWIR_MIN) -> Column:
    """Anomaly test of a scene pair: strong NDVI loss and bright SWIR, both strict."""
    return (delta_ndvi < ndvi_max) & (swir > swir_min)


def backscatter_ratio(v1: Column, v0: Column) -> Column:
    """v1 / (v0 + 1e-10), 1 where v0 is 0."""
    return F.when(v0 != 0.0, v1 / F.when(v0 + EPS != 0.0, v0 + EPS)).otherwise(F.lit(1.0))


def coherence_loss(vv_ratio: Column, vh_ratio: Column, limit: float = COHERENCE_RATIO) -> Column:
    return (vv_ratio < limit) | (vh_ratio < limit)


def exceeds(v1: Column, p90: Column, factor: float = BACKSCATTER_FACTOR) -> Column:
    return v1 > p90 * F.lit(factor)


def normalise_channels(channels: Column) -> Column:
    """(v - mean_c) / (std_c + 1e-6) over the six-channel array of a cell."""
    stats = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(CHANNEL_MEAN, CHANNEL_STD)])
    return F.zip_with(channels, stats, lambda v, st: (v - st["m"]) / (st["s"] + 1e-6))
