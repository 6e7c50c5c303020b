"""Joins between sites, sectors, jobs, alerts, reports and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.geometry import bbox_midpoint
from ..session import stage
from . import summaries

SITE_KEY = ["sector_id", "site_id"]


def alerts_of_user(alerts: DataFrame, jobs: DataFrame, user_id) -> DataFrame:
    """Alerts with the job they came from, for one owner. The owner filter reaches the jobs scan."""
    mine = jobs.filter(F.col("user_id") == user_id).select("job_id", "user_id", F.col("sector_id").alias("job_sector_id"))
    return alerts.join(mine, "job_id")


def new_sites(detections: DataFrame, stored: DataFrame) -> DataFrame:
    """Detections whose (sector, site) key is not stored. Keys are unique on the stored side, so no row multiplies."""
    return detections.join(stored.select(*SITE_KEY), SITE_KEY, "left_anti")


def known_sites(detections: DataFrame, stored: DataFrame) -> DataFrame:
    return detections.join(stored.select(*SITE_KEY), SITE_KEY, "left_semi")


def with_sector(sites: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sites with their sector's attributes. Sectors are broadcast only when their measured size allows it."""
    return sites.join(sectors, "sector_id")


def missing_sectors(detections: DataFrame, sectors: DataFrame, zoom: int = 12) -> DataFrame:
    """Sector rows to create for detection boxes that no sector has: centre is the midpoint.

    ``detections`` carries ``bbox``; boxes are made distinct before the anti join.
    """
    boxes = detections.select("bbox").distinct()
    fresh = boxes.join(sectors.select("bbox"), "bbox", "left_anti")
    b = F.col("bbox")
    x, y = bbox_midpoint(b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"])
    text = F.concat_ws(",", b["min_lon"].cast("string"), b["min_lat"].cast("string"), b["max_lon"].cast("string"), b["max_lat"].cast("string"))
    return fresh.select(
        F.concat(F.lit("bbox-"), F.substring(F.sha2(text, 256), 1, 8)).alias("sector_id"),
        F.concat(F.lit("Custom Analysis ["), text, F.lit("]")).alias("name"),
        "bbox", F.struct(x.alias("lon"), y.alias("lat")).alias("center"),
        F.lit(zoom).alias("zoom"), F.lit(True).alias("is_active"),
    )


def site_overview(sites: DataFrame, observations: DataFrame, reports: DataFrame, alerts: DataFrame) -> DataFrame:
    """Sites with counts of their observations, reports and alerts; each child table is reduced first."""
    obs = observations.groupBy("site_id").agg(F.count("*").alias("n_obs"), F.max("date").alias("last_obs"))
    rep = reports.groupBy("site_id").agg(F.count("*").alias("n_reports"))
    al = alerts.groupBy("site_id").agg(F.count("*").alias("n_alerts"))
    out = sites.join(obs, "site_id", "left").join(rep, "site_id", "left").join(al, "site_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_obs", "n_reports", "n_alerts")})


def with_rates(sites: DataFrame) -> DataFrame:
    """Cleanup rate, legal multiplier and density of each site, with defaults."""
    return sites.withColumns({
        "cleanup_rate": scoring.rate(F.col("waste_type"), scoring.CLEANUP_EUR_PER_M2, scoring.DEFAULT_CLEANUP),
        "legal_multiplier": scoring.rate(F.lower("jurisdiction"), scoring.LEGAL_MULTIPLIER, scoring.DEFAULT_LEGAL),
        "density": scoring.rate(F.col("waste_type"), scoring.DENSITY_T_PER_M2, scoring.DEFAULT_DENSITY),
    })


@dataclass(frozen=True)
class AlertRule:
    """A delivery rule; an empty region list means everywhere."""

    rule_id: str
    min_confidence: float = 0.8
    min_area_m2: float = 10000.0
    regions: tuple = field(default=())


def rule_table(spark: SparkSession, rules: list[AlertRule], region: str = "string") -> DataFrame:
    """Rules as a table; ``region`` is the type of the region column they name."""
    rows = [(r.rule_id, float(r.min_confidence), float(r.min_area_m2), list(r.regions)) for r in rules]
    return spark.createDataFrame(rows, f"rule_id string, min_confidence double, min_area_m2 double, regions array<{region}>")


def _slots(n_rules: int) -> int:
    """Buckets along each axis, a power of two: one for few rules, which are then all compared."""
    n, k = n_rules // 64, 1
    while 4 * k * k <= n and k < 64:
        k *= 2
    return k


def _bucket(x: Column, bounds: list[float]) -> Column:
    """How many bounds are not above ``x``."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b <= x))


def _node(level: int | Column, at: Column) -> Column:
    return (F.lit(level) * 1024 + at).cast("int")


def _above(i: Column, levels: int) -> Column:
    """Nodes of a tree over the buckets that hold bucket ``i``, and the bucket itself as a border, which is level ``levels``."""
    return F.array(*[_node(lv, F.shiftright(i, lv)) for lv in range(levels)], _node(levels, i))


def _below(i: Column, levels: int) -> Column:
    """Nodes that together hold the buckets before ``i``, each once, and bucket ``i`` as a border."""
    nodes = F.array(*[F.when(F.shiftright(i, lv).bitwiseAND(F.lit(1)) == 1, _node(lv, F.shiftright(i, lv) - 1)) for lv in range(levels)], _node(levels, i))
    return F.array_compact(nodes)


def rule_meetings(sites: DataFrame, rules: DataFrame, region: str, slots: int | None = None) -> DataFrame:
    """Sites beside the rules that may fire, each pair once: ``_sure_c`` and ``_sure_a`` say which bounds are met without a test.

    Rules lie in buckets of their two bounds, cut at quantiles. A rule in lower buckets than a site is met for sure, one in
    higher buckets for sure not, and only rules in the site's own bucket along an axis have to be compared. Buckets form
    a binary tree along each axis, so a site asks for a few nodes and a rule stands in few: an equi-join.
    """
    k = slots or _slots(rules.count())
    levels = k.bit_length()
    parts = [F.percentile_approx(c, [i / k for i in range(1, k)], 100 * k).alias(c) for c in ("min_confidence", "min_area_m2")]
    bounds = rules.agg(*parts).first() if k > 1 else {}
    cuts = {c: sorted(set((bounds[c] if k > 1 else None) or [])) for c in ("min_confidence", "min_area_m2")}
    wide = F.size(F.coalesce("regions", F.array().cast(rules.schema["regions"].dataType))) == 0
    kind = sites.schema[region].dataType
    rule = rules.select("rule_id", "min_confidence", "min_area_m2", F.when(wide, F.array(F.lit(None).cast(kind))).otherwise(F.array_distinct("regions").cast(f"array<{kind.simpleString()}>")).alias("_regions"), wide.alias("_wide"))
    rule = rule.select("*", F.explode("_regions").alias("_region")).filter("_wide OR _region IS NOT NULL").drop("_regions")
    for name, c in (("_c", "min_confidence"), ("_a", "min_area_m2")):
        rule = rule.withColumn(name, F.explode(_above(_bucket(F.col(c), cuts[c]), levels)))
    scopes = F.array(F.struct(F.lit(True).alias("_wide"), F.lit(None).cast(kind).alias("_region")), F.struct(F.lit(False).alias("_wide"), F.col(region).alias("_region")))
    asked = sites.filter("confidence IS NOT NULL AND area_m2 IS NOT NULL").select("*", F.inline(scopes)).filter("_wide OR _region IS NOT NULL")
    for name, c, x in (("_c", "min_confidence", "confidence"), ("_a", "min_area_m2", "area_m2")):
        asked = asked.withColumn(name, F.explode(_below(_bucket(F.col(x), cuts[c]), levels)))
    r = rule.select(*[F.col(c).alias(f"{c}_r") for c in ("_wide", "_region", "_c", "_a")], F.col("rule_id").alias("_rule"), F.col("min_confidence").alias("_min_c"), F.col("min_area_m2").alias("_min_a"))
    # by their measured size rules are small; a table of unknown size would be shuffled, and with it all sites to the few nodes they ask for
    r = stage(r, "rules")
    same = (F.col("_wide") == F.col("_wide_r")) & F.col("_region").eqNullSafe(F.col("_region_r")) & (F.col("_c") == F.col("_c_r")) & (F.col("_a") == F.col("_a_r"))
    both = asked.join(r, same)
    return both.select(*sites.columns, "_rule", "_min_c", "_min_a", (F.col("_c") < levels * 1024).alias("_sure_c"), (F.col("_a") < levels * 1024).alias("_sure_a"))


def fired_rules(sites: DataFrame, rules: DataFrame | list[AlertRule], region: str = "sector_id", slots: int | None = None) -> DataFrame:
    """One row per site and rule that fires; ``rules`` is a table (rule_id, min_confidence, min_area_m2, regions) or a list.

    Rules that name regions meet the sites of these regions by key, rules without a region meet all sites. A rule that names a
    region twice fires once; a missing measure or bound fires nothing.
    """
    if isinstance(rules, list):
        rules = rule_table(sites.sparkSession, rules, sites.schema[region].dataType.simpleString())
    rules = rules.filter("min_confidence IS NOT NULL AND min_area_m2 IS NOT NULL")
    met = rule_meetings(sites, rules, region, slots)
    fires = (F.col("_sure_c") | (F.col("confidence") >= F.col("_min_c"))) & (F.col("_sure_a") | (F.col("area_m2") >= F.col("_min_a")))
    return met.filter(fires).select(*sites.columns, F.col("_rule").alias("rule_id"))


def latest_alerts_per_job(jobs: DataFrame, alerts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest alerts of each job. Alerts are cut to ``n`` per job before they meet the jobs."""
    newest = summaries.top_per_group(alerts, ["job_id"], [F.col("created_at").desc(), F.col("alert_id")], n)
    return jobs.select("job_id", "user_id").join(newest, "job_id")
