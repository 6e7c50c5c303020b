"""Streaming queries: the events table is read as a file stream and processed to its end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from groundshift.streaming import detecting, monitoring, reports

from .fixtures import BANDS
from .q_outputs import CHANGED_SITES_SQL, LIMITS, SCENE_DAYS, SCENE_EPOCH, layout, scene_rows, with_scene_ids
from .q_sites import DAY, SQL_STAMP, STAMP
from .registry import query, rnd

RUN_DATE = "2024-01-30"


def _scenes_by_sector(t, events):
    return t.map_scenes(events).filter("collection = 'optical' and cloud_cover < 20").withColumn("sector_id", (F.col("area") % 25).cast("int"))


_PAIR = f"""
s AS (SELECT *, area % 25 AS sector_id FROM scenes WHERE collection = 'optical' AND cloud_cover < 20 AND ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-31'),
r AS (SELECT *, row_number() OVER (PARTITION BY sector_id ORDER BY ts DESC, scene_id) AS rn FROM s),
p AS (SELECT sector_id, max(scene_id) FILTER (rn = 1) AS scene_t1, max(scene_id) FILTER (rn = 2) AS scene_t0 FROM r GROUP BY 1)"""


# ---- detection in the stream ------------------------------------------------------------------------------------------
# Jobs watch the raster area or one without imagery; scenes are 30 days apart, so a window of 14 days holds one and of 60 days two.

_WATCH = f"""
{CHANGED_SITES_SQL},
j AS (SELECT job_id, CASE WHEN sector_id % 3 <> 0 THEN 'mosaic' ELSE 'elsewhere' END AS area, CASE WHEN job_id % 2 = 0 THEN 14 ELSE 60 END AS lookback,
  0.6::DOUBLE + (job_id % 3)/10.0::DOUBLE AS threshold FROM jobs WHERE is_active),
k AS (SELECT j.*, CASE WHEN area = 'mosaic' THEN (SELECT CAST(b AS VARCHAR) FROM last) END AS scene_t1, CASE WHEN area = 'mosaic' AND lookback = 60 THEN (SELECT CAST(a AS VARCHAR) FROM prev) END AS scene_t0 FROM j),
ready AS (SELECT * FROM k WHERE scene_t0 IS NOT NULL AND scene_t1 IS NOT NULL),
credit AS (SELECT site.*, (SELECT min(job_id) FROM ready WHERE threshold <= site.confidence) AS job_id FROM site)
"""


def _watch_jobs(t):
    area = F.when(F.col("sector_id") % 3 != 0, "mosaic").otherwise("elsewhere")
    return t.jobs.select("job_id", "is_active", area.alias("sector_id"), F.when(F.col("job_id") % 2 == 0, 14).otherwise(60).alias("lookback_days"),
                         (F.lit(0.6) + (F.col("job_id") % 3) / 10.0).alias("confidence_threshold"))


def _watched(t, stream: bool = True) -> detecting.StreamedDetection:
    """The run of all jobs over the arrivals of scenes and tiles, which are the embeddings as a file stream."""
    root, ckpt = monitoring.fresh_dirs(t.spark, "watch")
    newest = t.band_tiles.agg(F.max("step")).first()[0]
    m = detecting.StreamedDetection(t.spark, root, _watch_jobs(t), lambda: with_scene_ids(t.band_tiles), BANDS, layout(), LIMITS,
                                    run_date=str((SCENE_EPOCH + timedelta(days=SCENE_DAYS * newest)).date()))
    if stream:
        tiles = t.map_band_tiles(t.file_stream("embeddings"))
        scenes = scene_rows(tiles.filter("band = '0' AND ty = 0 AND tx = 0").select("area", "step"))  # one row of each scene
        arrivals = detecting.scene_arrivals(scenes).union(detecting.tile_arrivals(with_scene_ids(tiles), BANDS))
        m.run(detecting.changed_pairs(arrivals, BANDS), ckpt)
    else:
        detecting.detect_in_batch(m, scene_rows(t.band_tiles.select("area", "step").distinct()))
    return m


@query("stm_01", f"""{_WATCH}
SELECT k.job_id, k.area, scene_t1, scene_t0, CASE WHEN scene_t0 IS NULL OR scene_t1 IS NULL THEN 'Insufficient satellite imagery' END AS last_error, 1 AS run_count, coalesce(n, 0) AS new_sites, coalesce(m2, 0) AS new_area_m2
FROM k LEFT JOIN (SELECT job_id, count(*) AS n, round(sum(exact_m2), 0) AS m2 FROM credit GROUP BY 1) c USING (job_id)""", ("idx", "jobs"))
def stm_01(t):
    """Scenes and tiles arrive as a stream; areas whose newest pair changes are analysed, and every active job is booked."""
    m = _watched(t)
    new = m.alerts().groupBy("job_id").agg(F.sum("total_area_m2").alias("m2"))
    pairs = m.job_pairs().select("job_id", F.col("sector_id").alias("area"), "scene_t1", "scene_t0")
    return pairs.join(m.job_state(), "job_id").join(new, "job_id", "left").select(
        "job_id", "area", "scene_t1", "scene_t0", "last_error", "run_count", "new_sites", F.coalesce(F.round("m2", 0), F.lit(0.0)).alias("new_area_m2"))


_WANTED = "w AS (SELECT d.* FROM detections d WHERE confidence >= 0.7::DOUBLE AND EXISTS (SELECT 1 FROM jobs j WHERE j.is_active AND j.sector_id = d.sector_id))"
_STATE = f"""
WITH {_WANTED}
SELECT sector_id, site_id, arg_min(seq, (ts, seq)) AS first_seq, strftime(arg_max(detection_date, (ts, seq)), '%Y-%m-%d') AS detection_date, arg_max(confidence, (ts, seq)) AS confidence,
  arg_max(risk_score, (ts, seq)) AS risk_score, arg_max(threat_level, (ts, seq)) AS threat_level, arg_max(area_m2, (ts, seq)) AS area_m2,
  arg_max(estimated_tonnage, (ts, seq)) AS estimated_tonnage FROM w GROUP BY 1, 2"""


def _monitor(t, scenes: bool = False):
    root, ckpt = monitoring.fresh_dirs(t.spark, "monitor")
    m = monitoring.Monitor(t.spark, root, t.jobs, t.detections, ["ts", "seq"], t.map_detections,
                           _scenes_by_sector(t, t.raw("events")) if scenes else None, run_date=RUN_DATE)
    m.run(t.event_stream(), ckpt)
    return m


def _state(m):
    return m.sites().select("sector_id", "site_id", F.col("seq").alias("first_seq"), DAY("detection_date").alias("detection_date"), "confidence",
                            "risk_score", "threat_level", "area_m2", "estimated_tonnage")


@query("stm_02", _STATE, ("detections", "jobs"))
def stm_02(t):
    return _state(_monitor(t))


_OPENING = f"""
WITH {_WANTED}, o AS (SELECT sector_id, site_id, arg_min(area_m2, (ts, seq)) AS area_m2, arg_min(threat_level, (ts, seq)) AS threat_level FROM w GROUP BY 1, 2),
c AS (SELECT o.*, (SELECT min(job_id) FROM jobs j WHERE j.is_active AND j.sector_id = o.sector_id) AS job_id FROM o)
"""
_ALERTS = _OPENING + f"""
SELECT job_id, sector_id, count(*) AS sites_count, {rnd('sum(area_m2)', 2)} AS total_area_m2,
  ['Low','Moderate','High','Critical'][max(CASE threat_level WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END)] AS max_threat_level,
  CASE WHEN bool_or(threat_level IN ('Critical','High')) THEN 'critical' ELSE 'low' END AS severity,
  'Scheduled analysis detected ' || count(*) || ' new sites' AS message FROM c GROUP BY 1, 2"""


@query("stm_03", _ALERTS, ("detections", "jobs"))
def stm_03(t):
    return _monitor(t).alerts().select("job_id", "sector_id", "sites_count", "total_area_m2", "max_threat_level", "severity", "message")


@query("stm_04", _OPENING + f"""
, {_PAIR}, n AS (SELECT job_id, count(*) AS new_sites FROM c WHERE sector_id IN (SELECT sector_id FROM p WHERE scene_t0 IS NOT NULL AND scene_t1 IS NOT NULL) GROUP BY 1)
SELECT j.job_id, {SQL_STAMP.format("(SELECT max(ts) FROM detections)")} AS last_run, 1 AS run_count,
  CASE WHEN scene_t0 IS NULL OR scene_t1 IS NULL THEN 'Insufficient satellite imagery' END AS last_error, coalesce(n.new_sites, 0) AS new_sites
FROM jobs j LEFT JOIN p ON p.sector_id = j.sector_id LEFT JOIN n ON n.job_id = j.job_id WHERE j.is_active""", ("detections", "jobs", "scenes"))
def stm_04(t):
    return _monitor(t, scenes=True).job_state().withColumn("last_run", STAMP("last_run"))


@query("stm_05", """
SELECT 'CIT-' || strftime(created_at, '%Y%m%d%H%M%S') || '-' || report_key AS report_id, reporter_id, longitude, latitude, threat_level, waste_type, 'pending' AS status,
  0 AS verified, strftime(created_at, '%Y-%m-%d') AS day, count(*) OVER (PARTITION BY CAST(created_at AS DATE), threat_level) AS day_reports FROM reports""", ("reports",))
def stm_05(t):
    root, ckpt = monitoring.fresh_dirs(t.spark, "reports")
    reports.ingest_reports(t.map_reports(t.event_stream()), root + "/table", ckpt)
    stored = t.spark.read.parquet(root + "/table")
    counts = reports.report_counts(stored).select(DAY("window_start").alias("day"), "threat_level", F.col("n").alias("day_reports"))
    out = stored.withColumn("day", DAY("created_at")).join(counts, ["day", "threat_level"])
    return out.select("report_id", "reporter_id", F.col("coordinates")[0].alias("longitude"), F.col("coordinates")[1].alias("latitude"), "threat_level",
                      "waste_type", "status", F.col("verified").cast("int").alias("verified"), "day", "day_reports")


@query("stm_06", """
SELECT sector_id, site_id, arg_max(area_m2, (ts, seq)) AS area_m2, arg_max(confidence, (ts, seq)) AS confidence FROM detections
WHERE confidence BETWEEN 0.65::DOUBLE AND 0.95::DOUBLE AND area_m2 > 5000 GROUP BY 1, 2""", ("detections",))
def stm_06(t):
    root, ckpt = monitoring.fresh_dirs(t.spark, "inbound")
    rules = {"confidence": F.col("confidence").between(0.65, 0.95), "area_m2": F.col("area_m2") > 5000.0}
    table = monitoring.SiteTable(t.spark, root + "/sites", monitoring.fold_batch(t.detections.limit(0), ["ts", "seq"]))
    refused = monitoring.BatchLog.create(t.spark, root + "/refused", reports.split_inbound(t.detections.limit(0), rules)[1])

    def batch(df, i):
        good, bad = reports.split_inbound(t.map_detections(df), rules)
        table.upsert(monitoring.fold_batch(good, ["ts", "seq"]), i)
        refused.write(bad, i)

    monitoring.run_available(t.event_stream(), batch, ckpt)
    return table.current().select("sector_id", "site_id", "area_m2", "confidence")


@query("stm_07", "SELECT DISTINCT sector_id, site_id FROM detections", ("detections",))
def stm_07(t):
    root, ckpt = monitoring.fresh_dirs(t.spark, "firstseen")
    log = monitoring.BatchLog.create(t.spark, root + "/seen", t.detections.select("sector_id", "site_id").limit(0))
    seen = monitoring.first_seen(t.map_detections(t.event_stream()), "40 days").select("sector_id", "site_id")
    monitoring.run_available(seen, lambda df, i: log.write(df, i), ckpt)
    return log.read().drop("batch_id")


_T = lambda s: f"coalesce({SQL_STAMP.format(f'''max(ts) FILTER (status = '{s}')''')}, '')"


@query("stm_08", f"""
SELECT alert_id, arg_max(status, (ts, seq)) AS status, {_T('acknowledged')} AS acknowledged_at, {_T('resolved')} AS resolved_at, {_T('dismissed')} AS dismissed_at,
  {SQL_STAMP.format('max(ts)')} AS updated_at FROM alert_events GROUP BY 1""", ("alert_events",))
def stm_08(t):
    root, ckpt = monitoring.fresh_dirs(t.spark, "transitions")
    out = monitoring.stream_transitions(t.event_stream(), t.map_alert_events, ["ts", "seq"], root, ckpt)
    return out.select("alert_id", "status", *[F.coalesce(STAMP(c), F.lit("")).alias(c) for c in ("acknowledged_at", "resolved_at", "dismissed_at", "updated_at")])


@query("stm_09", f"""
SELECT 'tumbling' AS kind, sector_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS n, {rnd('sum(area_m2)', 2)} AS area_m2 FROM detections GROUP BY 1, 2, 3
UNION ALL SELECT 'sliding', sector_id, strftime(date_trunc('day', ts) - to_days(CAST(i AS INTEGER)), '%Y-%m-%d'), count(*), {rnd('sum(area_m2)', 2)}
FROM detections, (SELECT unnest(range(14)) AS i) GROUP BY 1, 2, 3""", ("detections",))
def stm_09(t):
    parts = []
    for kind, width, slide in (("tumbling", "24 hours", None), ("sliding", "14 days", "1 day")):
        root, ckpt = monitoring.fresh_dirs(t.spark, kind)
        counts = monitoring.windowed_counts(t.map_detections(t.event_stream()), width, slide, ["sector_id"], lateness="14 days")
        w = monitoring.stream_windows(counts, root, ckpt, ["window_start", "sector_id"])
        parts.append(w.select(F.lit(kind).alias("kind"), "sector_id", DAY("window_start").alias("window_start"), "n", F.round("area_m2", 2).alias("area_m2")))
    return parts[0].unionByName(parts[1])


def monitored_sites(t):
    """Sites of arriving detections beside the alert of their sector."""
    m = _monitor(t)
    return _state(m).join(m.alerts().select("sector_id", F.col("sites_count").alias("sector_alert_sites")), "sector_id")


@query("pipe_05", f"""{_WATCH},
a AS (SELECT job_id, count(*) AS alert_sites, CASE WHEN bool_or(threat_level IN ('Critical','High')) THEN 'critical' ELSE 'low' END AS severity FROM credit WHERE job_id IS NOT NULL GROUP BY 1)
SELECT site_id, 'mosaic' AS sector_id, area_m2, confidence, risk_score, threat_level, estimated_tonnage, lon, lat, (SELECT CAST(a AS VARCHAR) FROM prev) AS scene_t0, (SELECT CAST(b AS VARCHAR) FROM last) AS scene_t1, alert_sites, severity
FROM credit JOIN a USING (job_id)""", ("idx", "jobs"))
def pipe_05(t):
    """Monitoring end to end: arrivals, scene pairs, detection, suppression, upsert, alerts."""
    m = _watched(t)
    alerts = m.alerts().join(_watch_jobs(t).select("job_id", "confidence_threshold"), "job_id")
    alerts = alerts.select("sector_id", "job_id", "confidence_threshold", F.col("sites_count").alias("alert_sites"), "severity")
    # a site is announced by the first job that accepts it
    ready = m.job_pairs().filter("last_error IS NULL").select("sector_id", "job_id", "confidence_threshold")
    first = m.sites().join(ready, "sector_id").filter("confidence >= confidence_threshold").groupBy("sector_id", "site_id").agg(F.min("job_id").alias("job_id"))
    out = m.sites().join(first, ["sector_id", "site_id"]).join(alerts.drop("confidence_threshold"), ["sector_id", "job_id"])
    return out.select("site_id", "sector_id", F.round("area_m2", 0).alias("area_m2"), "confidence", "risk_score", "threat_level", F.round("estimated_tonnage", 0).alias("estimated_tonnage"),
                      F.round("centroid.lon", 6).alias("lon"), F.round("centroid.lat", 6).alias("lat"), "scene_t0", "scene_t1", "alert_sites", "severity")
