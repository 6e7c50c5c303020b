"""Label geometry and image/mask pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def way_rings(ways: DataFrame, nodes: DataFrame, min_points: int = 4, tag: str | None = None) -> DataFrame:
    """Assemble ways (way_id, nodes ARRAY) into ordered coordinate lists; short ones are dropped, label is 1.

    ``tag`` keeps only ways whose ``tags['landuse']`` has that value.
    """
    if tag is not None:
        ways = ways.filter(F.col("tags")["landuse"] == tag)
    steps = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id"))
    return rings_from_steps(steps, nodes, min_points)


def rings_from_steps(steps: DataFrame, nodes: DataFrame, min_points: int = 4) -> DataFrame:
    """Same from one row per (way_id, pos, node_id). Unknown nodes are skipped.

    A way's list is its own output row; the node look-up is an equi join whose popular nodes adaptive
    execution splits.
    """
    located = steps.join(nodes.select("node_id", "lon", "lat"), "node_id")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "lon", "lat")))
    return (
        located.groupBy("way_id")
        .agg(F.transform(ordered, lambda p: F.array(p["lon"], p["lat"])).alias("ring"))
        .filter(F.size("ring") >= min_points)
        .withColumn("label", F.lit(1))
        .withColumn("source", F.lit("OSM"))
    )


def pair_by_stem(images: DataFrame, masks: DataFrame, on: str = "stem") -> DataFrame:
    """Images with a mask of the same stem; the others are dropped."""
    return images.join(masks, on, "inner")
