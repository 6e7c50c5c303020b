"""The given tables mapped to the engine's schemas, once as DataFrames and once as SQL views.

The mapped values are stand-ins that exercise the operators; they are not measurements.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundshift.functions import geometry, scoring
from groundshift.operators import raster

TILE = 8  # side of one raster tile
SIDE = 32  # side of the 4 x 4 tile mosaic
BANDS = {"red": "0", "nir": "1", "swir": "2"}
SAR_BANDS = {"vv": "0", "vh": "1"}


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # the files store local timestamps; event time and pushed-down time ranges need TIMESTAMP
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- sites -------------------------------------------------------------------------------
    @cached_property
    def sites(self) -> DataFrame:
        o, c, n = self.raw("orders"), self.raw("customer"), self.raw("nation")
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        pick = lambda col, values: F.element_at(F.array(*[F.lit(v) for v in values]), (col + 1).cast("int"))
        lon, lat = F.lit(4.2) + (k % 60) * 0.0002, F.lit(51.85) + (cust % 50) * 0.0002
        half = F.sqrt("o_totalprice") / 2.0 / 111000.0
        base = (
            o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        )
        prio = F.substring("o_orderpriority", 1, 1)
        waste = (F.when(prio == "1", "hazardous").when(prio == "2", "construction").when(prio == "3", "electronic")
                 .when(prio == "4", "other").otherwise("mixed"))
        return base.select(
            F.format_string("S-%09d", k).alias("site_id"), k.alias("site_no"),
            F.col("c_nationkey").alias("sector_id"), F.col("n_regionkey").alias("region_id"),
            F.col("o_totalprice").alias("area_m2"),
            (F.lit(0.6) + (k % 39) / 100.0).alias("confidence"),
            ((cust % 1000) / 100.0).alias("distance_to_water_km"),
            (F.lit(0.5) + (k % 496) / 10.0).alias("distance_to_protected_km"),
            waste.alias("waste_type"),
            F.to_date("o_orderdate").alias("detection_date"),
            (F.col("o_orderstatus") != "F").alias("is_active"),
            pick(k % 3, ["sentinel2", "sentinel1", "landsat"]).alias("source_sensor"),
            pick(F.col("c_nationkey") % 6, ["Netherlands", "germany", "france", "brazil", "drc", "unknown"]).alias("jurisdiction"),
            F.struct(lon.alias("lon"), lat.alias("lat")).alias("centroid"),
            (lon - half).alias("min_x"), (lat - half).alias("min_y"), (lon + half).alias("max_x"), (lat + half).alias("max_y"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        s = self.sites.withColumn("risk_score", scoring.risk_score(F.col("area_m2"), F.col("confidence"), F.col("distance_to_water_km")))
        return s.withColumns({
            "threat_level": scoring.threat_level(F.col("risk_score")),
            "estimated_tonnage": scoring.tonnage(F.col("area_m2")),
        })

    @cached_property
    def polygons(self) -> DataFrame:
        """Scored sites with their square as a GeoJSON-like geometry."""
        box = geometry.rectangle(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
        return self.scored.withColumn("ring", box).withColumn(
            "geometry", F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")))

    @cached_property
    def sectors(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        k = F.col("n_nationkey")
        x0, y0 = (F.lit(-60.0) + k * 4.0), (F.lit(-30.0) + k * 2.0)
        return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
            k.alias("sector_id"), F.col("n_name").alias("name"), F.col("r_name").alias("region_name"),
            F.struct(x0.alias("min_lon"), y0.alias("min_lat"), (x0 + 1.0).alias("max_lon"), (y0 + 1.0).alias("max_lat")).alias("bbox"),
            F.lit(12).alias("zoom"), (F.col("n_regionkey") != 4).alias("is_active"),
        )

    # ---- observations --------------------------------------------------------------------------
    @cached_property
    def obs_raw(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("site_no"), F.to_date("l_shipdate").alias("date"),
            F.col("l_extendedprice").alias("area_m2"), (F.lit(0.5) + F.col("l_discount") * 4.0).alias("confidence"),
            (F.col("l_tax") - 0.05).alias("ndvi"), "l_linenumber", "l_partkey", "l_suppkey",
        )

    @cached_property
    def obs(self) -> DataFrame:
        from groundshift.operators.summaries import unique_observations
        return unique_observations(self.obs_raw, ["site_no", "date"], ["l_linenumber", "l_partkey", "l_suppkey"])

    # ---- scenes --------------------------------------------------------------------------------
    @staticmethod
    def map_scenes(events: DataFrame) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        return events.select(
            e.alias("scene_id"),
            F.when(u % 3 == 0, "optical").when(u % 3 == 1, "radar").otherwise("historical").alias("collection"),
            "ts", (F.col("value") / 5.0).alias("cloud_cover"),
            F.when(F.col("event_type").isin("click", "view", "purchase"), "descending").otherwise("ascending").alias("orbit_state"),
            (F.lit(-60.0) + u % 120).alias("min_lon"), (F.lit(-30.0) + e % 60).alias("min_lat"),
            (F.lit(-59.0) + u % 120).alias("max_lon"), (F.lit(-29.0) + e % 60).alias("max_lat"),
            u.alias("area"),
        )

    @cached_property
    def scenes(self) -> DataFrame:
        return self.map_scenes(self.raw("events"))

    # ---- rasters -------------------------------------------------------------------------------
    @staticmethod
    def map_band_tiles(embeddings: DataFrame) -> DataFrame:
        """One row per scene tile and band: embeddings as 8 x 8 rasters of a 4 x 4 tile mosaic."""
        scene = F.floor(F.col("vec_id") / 3)
        tile = scene % 16
        return embeddings.select(
            # depends on the row, as an area column of a real table does (a literal would be folded away)
            F.when(F.col("vec_id") >= 0, "mosaic").alias("area"), scene.alias("scene"), F.floor(scene / 16).cast("int").alias("step"),
            F.floor(tile / 4).cast("int").alias("ty"), (tile % 4).cast("int").alias("tx"),
            (F.col("vec_id") % 3).cast("string").alias("band"),
            F.lit(TILE).alias("h"), F.lit(TILE).alias("w"),
            F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("data"),
        )

    @cached_property
    def band_tiles(self) -> DataFrame:
        return self.map_band_tiles(self.raw("embeddings"))

    @cached_property
    def tiles(self) -> DataFrame:
        return raster.align_bands(self.band_tiles, BANDS, extra=["scene", "h", "w"])

    @cached_property
    def sar_tiles(self) -> DataFrame:
        return raster.align_bands(self.band_tiles, SAR_BANDS, extra=["scene", "h", "w"])

    @cached_property
    def cells(self) -> DataFrame:
        return raster.cells(self.tiles, list(BANDS), tile=TILE)

    @cached_property
    def bright_tiles(self) -> DataFrame:
        """Tiles of the mask swir > 0.2."""
        return self.tiles.select("area", "step", "ty", "tx", "h", "w",
                                 F.transform("swir", lambda v: (v > 0.2).cast("tinyint")).alias("mask"))

    # ---- jobs, alerts, reports, detections --------------------------------------------------------
    @cached_property
    def jobs(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("job_id"), F.col("s_nationkey").alias("user_id"), F.col("s_nationkey").alias("sector_id"),
            (F.col("s_acctbal") >= 0).alias("is_active"), F.lit(0.7).alias("confidence_threshold"),
            F.lit(14).alias("lookback_days"), F.lit(24).alias("interval_hours"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        n_jobs = self.raw("supplier").count()
        k = F.get_json_object("props", "$.k").cast("int")
        sev = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(
            F.col("event_type") == "signup", "medium").otherwise("low")
        status = F.element_at(F.array(*[F.lit(s) for s in ("active", "acknowledged", "resolved", "dismissed")]), k % 4 + 1)
        return self.raw("events").select(
            F.col("event_id").alias("alert_id"), (F.col("user_id") % n_jobs).alias("job_id"), sev.alias("severity"),
            status.alias("status"), F.col("ts").alias("created_at"), (F.col("value") * 1000.0).alias("total_area_m2"),
            (F.col("event_id") % 500).alias("site_no"),
        )

    @staticmethod
    def map_alert_events(events: DataFrame) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        status = F.element_at(F.array(*[F.lit(s) for s in ("active", "acknowledged", "resolved", "dismissed")]), k % 4 + 1)
        return events.select(F.col("user_id").alias("alert_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"))

    @staticmethod
    def map_reports(events: DataFrame) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        level = F.element_at(F.array(*[F.lit(s) for s in ("Critical", "High", "Moderate", "Low")]), k % 4 + 1)
        return events.filter("event_type = 'signup'").select(
            F.col("event_id").cast("string").alias("report_key"), F.col("user_id").cast("string").alias("reporter_id"),
            (F.lit(51.85) + (F.col("event_id") % 100) / 1000.0).alias("latitude"),
            (F.lit(4.2) + (F.col("user_id") % 300) / 1000.0).alias("longitude"),
            level.alias("threat_level"), F.lit("mixed").alias("waste_type"), F.col("ts").alias("created_at"),
            (F.col("event_id") % 500).alias("site_no"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        return self.map_reports(self.raw("events"))

    @staticmethod
    def map_detections(events: DataFrame) -> DataFrame:
        area, conf = F.col("value") * 1000.0, F.lit(0.6) + (F.col("event_id") % 39) / 100.0
        risk = scoring.risk_score(area, conf, F.lit(1.0))
        return events.select(
            (F.col("user_id") % 25).alias("sector_id"), (F.col("event_id") % 500).alias("site_id"),
            F.col("event_id").alias("seq"), "ts", conf.alias("confidence"), area.alias("area_m2"),
            risk.alias("risk_score"), scoring.threat_level(risk).alias("threat_level"),
            scoring.tonnage(area).alias("estimated_tonnage"), F.to_date("ts").alias("detection_date"),
            F.lit("mixed").alias("waste_type"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        return self.map_detections(self.raw("events"))

    def file_stream(self, name: str) -> DataFrame:
        """A table, one file or a folder of files, as a file stream. A plain path would have to be a folder, a pattern may be either."""
        return self.spark.readStream.schema(self.raw(name).schema).parquet(f"{self.dir}/{name}.parque[t]")

    def event_stream(self) -> DataFrame:
        return self.file_stream("events")

    # ---- label geometry ---------------------------------------------------------------------------
    @cached_property
    def way_steps(self) -> DataFrame:
        steps = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"))
        return steps.agg(F.min("l_partkey").alias("node_id"))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("node_id"), (F.lit(4.0) + (F.col("p_partkey") % 1000) / 1000.0).alias("lon"),
            (F.lit(51.0) + F.col("p_size") / 1000.0).alias("lat"),
        )


# ---- the same views in SQL ------------------------------------------------------------------------
_TH = ("CASE WHEN {r} >= 75 THEN 'Critical' WHEN {r} >= 50 THEN 'High' WHEN {r} >= 25 THEN 'Moderate' ELSE 'Low' END")
_RISK = ("CAST(round_even((least({a}/500000.0::DOUBLE, 1.0::DOUBLE)*0.4::DOUBLE + {c}*0.3::DOUBLE + "
         "greatest(1.0::DOUBLE - {k}/10.0::DOUBLE, 0.0::DOUBLE)*0.3::DOUBLE)*100.0::DOUBLE, 0) AS INTEGER)")


def _tonnage(a: str, density: str = "0.15::DOUBLE") -> str:
    return f"CAST(printf('%.2f', ({a})*{density}) AS DOUBLE)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sites": ((), """
      SELECT 'S-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS site_id, o_orderkey AS site_no,
        c_nationkey AS sector_id, n_regionkey AS region_id, o_totalprice AS area_m2,
        0.6::DOUBLE + (o_orderkey % 39)::DOUBLE/100.0::DOUBLE AS confidence,
        (o_custkey % 1000)::DOUBLE/100.0::DOUBLE AS distance_to_water_km,
        0.5::DOUBLE + (o_orderkey % 496)::DOUBLE/10.0::DOUBLE AS distance_to_protected_km,
        CASE o_orderpriority[1] WHEN '1' THEN 'hazardous' WHEN '2' THEN 'construction' WHEN '3' THEN 'electronic'
             WHEN '4' THEN 'other' ELSE 'mixed' END AS waste_type,
        CAST(o_orderdate AS DATE) AS detection_date, o_orderstatus <> 'F' AS is_active,
        ['sentinel2','sentinel1','landsat'][o_orderkey % 3 + 1] AS source_sensor,
        ['Netherlands','germany','france','brazil','drc','unknown'][c_nationkey % 6 + 1] AS jurisdiction,
        4.2::DOUBLE + (o_orderkey % 60)::DOUBLE*0.0002::DOUBLE AS lon, 51.85::DOUBLE + (o_custkey % 50)::DOUBLE*0.0002::DOUBLE AS lat,
        sqrt(o_totalprice)/2.0::DOUBLE/111000.0::DOUBLE AS half
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "boxes": (("scored",), "SELECT *, lon - half AS min_x, lat - half AS min_y, lon + half AS max_x, lat + half AS max_y FROM scored"),
    "scored": (("sites",), f"""
      SELECT *, {_TH.format(r='risk_score')} AS threat_level, {_tonnage('area_m2')} AS estimated_tonnage
      FROM (SELECT *, {_RISK.format(a='area_m2', c='confidence', k='distance_to_water_km')} AS risk_score FROM sites)"""),
    "sectors": ((), """
      SELECT n_nationkey AS sector_id, n_name AS name, r_name AS region_name,
        -60.0::DOUBLE + n_nationkey*4.0::DOUBLE AS min_lon, -30.0::DOUBLE + n_nationkey*2.0::DOUBLE AS min_lat,
        -60.0::DOUBLE + n_nationkey*4.0::DOUBLE + 1.0::DOUBLE AS max_lon, -30.0::DOUBLE + n_nationkey*2.0::DOUBLE + 1.0::DOUBLE AS max_lat,
        n_regionkey <> 4 AS is_active
      FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "obs": ((), """
      SELECT l_orderkey AS site_no, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS area_m2,
        0.5::DOUBLE + l_discount*4.0::DOUBLE AS confidence, l_tax - 0.05::DOUBLE AS ndvi
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, CAST(l_shipdate AS DATE)
              ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"""),
    "scenes": ((), """
      SELECT event_id AS scene_id, CASE user_id % 3 WHEN 0 THEN 'optical' WHEN 1 THEN 'radar' ELSE 'historical' END AS collection,
        ts, value/5.0::DOUBLE AS cloud_cover,
        CASE WHEN event_type IN ('click','view','purchase') THEN 'descending' ELSE 'ascending' END AS orbit_state,
        (-60 + user_id % 120)::DOUBLE AS min_lon, (-30 + event_id % 60)::DOUBLE AS min_lat,
        (-59 + user_id % 120)::DOUBLE AS max_lon, (-29 + event_id % 60)::DOUBLE AS max_lat, user_id AS area
      FROM events"""),
    "band_cells": ((), """
      SELECT vec_id // 3 AS scene, vec_id % 3 AS band, unnest(range(64)) AS pos, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings"""),
    "cells": (("band_cells",), """
      SELECT CAST(scene // 16 AS INTEGER) AS step, CAST(8*((scene % 16) // 4) + pos // 8 AS INTEGER) AS y,
        CAST(8*((scene % 16) % 4) + pos % 8 AS INTEGER) AS x,
        max(CASE WHEN band = 0 THEN v END) AS red, max(CASE WHEN band = 1 THEN v END) AS nir, max(CASE WHEN band = 2 THEN v END) AS swir
      FROM band_cells GROUP BY scene, pos HAVING count(DISTINCT band) = 3"""),
    "sar": (("band_cells",), """
      SELECT CAST(scene // 16 AS INTEGER) AS step, CAST(8*((scene % 16) // 4) + pos // 8 AS INTEGER) AS y,
        CAST(8*((scene % 16) % 4) + pos % 8 AS INTEGER) AS x,
        max(CASE WHEN band = 0 THEN v END) AS vv, max(CASE WHEN band = 1 THEN v END) AS vh
      FROM band_cells WHERE band < 2 GROUP BY scene, pos HAVING count(DISTINCT band) = 2"""),
    "idx": (("cells",), """
      SELECT *, CASE WHEN nir + red + 1e-10::DOUBLE <> 0 THEN greatest(least((nir-red)/(nir+red+1e-10::DOUBLE), 1.0::DOUBLE), -1.0::DOUBLE) ELSE 0.0::DOUBLE END AS ndvi,
        CASE WHEN nir + swir + 1e-10::DOUBLE <> 0 THEN (nir-swir)/(nir+swir+1e-10::DOUBLE) ELSE 0.0::DOUBLE END AS nbr,
        greatest(least(swir/((SELECT max(swir) FROM cells)+1e-10::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS swir_enh
      FROM cells"""),
    "steps": (("idx",), """
      SELECT *, ndvi - lag(ndvi) OVER w AS d_ndvi, swir_enh - lag(swir_enh) OVER w AS d_swir,
        row_number() OVER w - 2 AS k
      FROM idx WINDOW w AS (PARTITION BY y, x ORDER BY step)"""),
    "diffs": (("steps",), """
      SELECT *, d_ndvi < -0.15::DOUBLE AS loss, d_swir > 0.15::DOUBLE AS rise,
        (d_ndvi < -0.15::DOUBLE) AND (d_swir > 0.15::DOUBLE) AS anomaly FROM steps WHERE k >= 0"""),
    "jobs": ((), """
      SELECT s_suppkey AS job_id, s_nationkey AS user_id, s_nationkey AS sector_id, s_acctbal >= 0 AS is_active,
        0.7::DOUBLE AS confidence_threshold, 14 AS lookback_days, 24 AS interval_hours FROM supplier"""),
    "alerts": ((), """
      SELECT event_id AS alert_id, user_id % (SELECT count(*) FROM supplier) AS job_id,
        CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
        ['active','acknowledged','resolved','dismissed'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS status,
        ts AS created_at, value*1000.0::DOUBLE AS total_area_m2, event_id % 500 AS site_no FROM events"""),
    "alert_events": ((), """
      SELECT user_id AS alert_id, event_id AS seq, ts,
        ['active','acknowledged','resolved','dismissed'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS status FROM events"""),
    "reports": ((), """
      SELECT CAST(event_id AS VARCHAR) AS report_key, CAST(user_id AS VARCHAR) AS reporter_id,
        51.85::DOUBLE + (event_id % 100)::DOUBLE/1000.0::DOUBLE AS latitude, 4.2::DOUBLE + (user_id % 300)::DOUBLE/1000.0::DOUBLE AS longitude,
        ['Critical','High','Moderate','Low'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS threat_level,
        'mixed' AS waste_type, ts AS created_at, event_id % 500 AS site_no FROM events WHERE event_type = 'signup'"""),
    "detections": ((), f"""
      SELECT *, {_TH.format(r='risk_score')} AS threat_level, {_tonnage('area_m2')} AS estimated_tonnage FROM (
        SELECT *, {_RISK.format(a='area_m2', c='confidence', k='1.0::DOUBLE')} AS risk_score FROM (
          SELECT user_id % 25 AS sector_id, event_id % 500 AS site_id, event_id AS seq, ts,
            0.6::DOUBLE + (event_id % 39)::DOUBLE/100.0::DOUBLE AS confidence, value*1000.0::DOUBLE AS area_m2,
            CAST(ts AS DATE) AS detection_date, 'mixed' AS waste_type FROM events))"""),
}


def sql_with(body: str, names: tuple[str, ...]) -> str:
    """Prefix ``body`` with the WITH list of the named views and what they need, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + views + ",\n" + body[len("WITH RECURSIVE"):].lstrip()
    if body.upper().startswith("WITH "):
        return "WITH " + views + ",\n" + body[4:].lstrip()
    return "WITH " + views + "\n" + body
