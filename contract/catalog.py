"""Imports every query module, which fills the registry."""

from . import q_sites, q_raster, q_shapes, q_streams, q_outputs  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
