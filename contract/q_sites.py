"""Scoring, filters, projections, summaries, sorts, sets and relational joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.functions import formats, geometry, indices, scoring
from groundshift.operators import filters, relations, summaries
from groundshift.sources import catalogue, features

from .registry import correct, query, rnd

YMD = "strftime({}, '%Y-%m-%d')"
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")
STAMP = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
SQL_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"

# ---- scoring ------------------------------------------------------------------------------------


@query("sco_01", "SELECT site_id, least(0.6::DOUBLE + least(area_m2/100000.0::DOUBLE, 0.3::DOUBLE), 0.95::DOUBLE) AS confidence FROM sites", ("sites",))
def sco_01(t):
    return t.sites.select("site_id", scoring.detection_confidence(F.col("area_m2")).alias("confidence"))


@query("sco_02", "SELECT site_id, risk_score FROM scored", ("scored",))
def sco_02(t):
    return t.scored.select("site_id", "risk_score")


@query("sco_03", "SELECT threat_level, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS sum_risk FROM scored GROUP BY 1", ("scored",))
def sco_03(t):
    return t.scored.groupBy("threat_level").agg(F.count("*").alias("n"), F.sum("risk_score").alias("sum_risk"))


_DENSITY = "CASE waste_type WHEN 'mixed' THEN 0.15::DOUBLE WHEN 'construction' THEN 0.3::DOUBLE WHEN 'hazardous' THEN 0.1::DOUBLE WHEN 'electronic' THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END"


@query("sco_04", f"SELECT site_id, estimated_tonnage, {correct('area_m2*(' + _DENSITY + ')', 2)} AS tonnage_by_type FROM scored", ("scored",))
def sco_04(t):
    return t.scored.select("site_id", "estimated_tonnage", scoring.tonnage(F.col("area_m2"), F.col("waste_type")).alias("tonnage_by_type"))


_RATES = """
SELECT site_id, area_m2, distance_to_water_km, waste_type, jurisdiction,
  CASE waste_type WHEN 'construction' THEN 15.0::DOUBLE WHEN 'hazardous' THEN 150.0::DOUBLE WHEN 'electronic' THEN 80.0::DOUBLE ELSE 25.0::DOUBLE END AS base,
  CASE lower(jurisdiction) WHEN 'netherlands' THEN 3.0::DOUBLE WHEN 'germany' THEN 2.5::DOUBLE WHEN 'france' THEN 2.0::DOUBLE WHEN 'brazil' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS mult,
  greatest(1.0::DOUBLE, 2.0::DOUBLE - distance_to_water_km) AS water,
  greatest(1.0::DOUBLE, 1.5::DOUBLE - distance_to_protected_km*0.1::DOUBLE) AS protected
FROM sites"""


@query("sco_05", f"""
WITH r AS ({_RATES}), c AS (SELECT *, area_m2*base*water*protected AS cleanup FROM r)
SELECT site_id, {correct('cleanup', 2)} AS cleanup_cost_eur, {correct('cleanup*mult', 2)} AS legal_liability_eur,
  {correct('area_m2*50.0::DOUBLE*water', 2)} AS environmental_damage_eur_per_year,
  {correct('cleanup + cleanup*mult + area_m2*50.0::DOUBLE*water', 2)} AS total_exposure_eur,
  base AS base_cleanup_rate, water AS water_proximity_factor, protected AS protected_area_factor, mult AS jurisdiction_multiplier
FROM c""", ("sites",))
def sco_05(t):
    parts = scoring.impact(*[F.col(c) for c in ("area_m2", "waste_type", "distance_to_water_km", "distance_to_protected_km", "jurisdiction")])
    return t.sites.select("site_id", *[c.alias(n) for n, c in parts.items()])


# ---- scalar functions -----------------------------------------------------------------------------


@query("sca_01", "SELECT event_id, greatest(least(value/100.0::DOUBLE, 1.0::DOUBLE), 0.2::DOUBLE) AS clipped FROM events")
def sca_01(t):
    return t.raw("events").select("event_id", indices.clip(F.col("value") / 100.0, 0.2, 1.0).alias("clipped"))


@query("sca_02", f"SELECT site_id, {correct('area_m2', 0)} AS area_0, {correct('confidence', 2)} AS conf_2, {correct('confidence*risk_score', 1)} AS risk_1, {correct('area_m2*0.15::DOUBLE', 3)} AS tons_3 FROM scored", ("scored",))
def sca_02(t):
    c = F.col
    return t.scored.select("site_id", formats.rounded(c("area_m2"), 0).alias("area_0"), formats.rounded(c("confidence"), 2).alias("conf_2"),
                           formats.rounded(c("confidence") * c("risk_score"), 1).alias("risk_1"), formats.rounded(c("area_m2") * 0.15, 3).alias("tons_3"))


@query("sca_03", """
SELECT site_id, format('{:,.0f}', area_m2) AS area_text, format('{:,.1f}', estimated_tonnage) AS tons_text,
  printf('%.1f', confidence*100.0::DOUBLE) || '%' AS conf_text,
  printf('%.5f', lat) || ', ' || printf('%.5f', lon) AS where_text,
  strftime(detection_date, '%Y-%m-%dT%H:%M:%S') AS iso_text, strftime(detection_date, '%Y%m%d%H%M%S') AS id_text
FROM scored""", ("scored",))
def sca_03(t):
    c = F.col
    return t.scored.select(
        "site_id", formats.fixed(c("area_m2"), 0, True).alias("area_text"), formats.fixed(c("estimated_tonnage"), 1, True).alias("tons_text"),
        formats.percent(c("confidence")).alias("conf_text"), formats.lat_lon(c("centroid.lat"), c("centroid.lon")).alias("where_text"),
        F.date_format("detection_date", "yyyy-MM-dd'T'HH:mm:ss").alias("iso_text"), F.date_format("detection_date", "yyyyMMddHHmmss").alias("id_text"))


@query("sca_04", "SELECT c_custkey, printf('%s-%03d', upper(substr(c_mktsegment, 1, 3)), c_custkey % 1000) AS padded FROM customer")
def sca_04(t):
    return t.raw("customer").select("c_custkey", formats.padded_id(F.upper(F.substring("c_mktsegment", 1, 3)), F.col("c_custkey") % 1000).alias("padded"))


@query("sca_05", """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.sensor') AS VARCHAR), 'Sentinel-2 L2A') AS sensor,
  coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events""")
def sca_05(t):
    return t.raw("events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.sensor"), F.lit(features.DEFAULT_SENSOR)).alias("sensor"),
        F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"))


@query("sca_06", """
SELECT site_id, upper(substr(waste_type, 1, 1)) || lower(substr(waste_type, 2)) AS titled, upper(source_sensor) AS up, lower(jurisdiction) AS low FROM sites""", ("sites",))
def sca_06(t):
    return t.sites.select("site_id", F.initcap("waste_type").alias("titled"), F.upper("source_sensor").alias("up"), F.lower("jurisdiction").alias("low"))


@query("sca_07", """
SELECT site_id, substr(sha256('{"risk_score":' || risk_score || ',"site_id":"' || site_id || '","threat_level":"' || threat_level || '"}'), 1, 16) AS content_hash,
  'search:' || substr(md5(concat_ws(':', site_id, CAST(sector_id AS VARCHAR))), 1, 12) AS cache_key FROM scored""", ("scored",))
def sca_07(t):
    c = F.col
    return t.scored.select("site_id", formats.content_hash({n: c(n) for n in ("site_id", "risk_score", "threat_level")}).alias("content_hash"),
                           formats.key_hash("search", [c("site_id"), c("sector_id")]).alias("cache_key"))


@query("sca_08", f"SELECT job_id, {YMD.format('DATE ' + repr('2024-01-30') + ' - lookback_days')} AS since FROM jobs", ("jobs",))
def sca_08(t):
    return t.jobs.select("job_id", DAY(F.date_sub(F.lit("2024-01-30").cast("date"), F.col("lookback_days"))).alias("since"))


@query("sca_09", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, min_lon, max_lat, (min_lon + max_lon)/2.0::DOUBLE AS mid
FROM events JOIN scenes ON event_id = scene_id""", ("scenes",))
def sca_09(t):
    e = t.raw("events").withColumn("v", F.parse_json("props"))
    s = t.map_scenes(e.select("*")).select("scene_id", "min_lon", "max_lon", "max_lat")
    k = e.select("event_id", F.variant_get("v", "$.k", "int").alias("k"))
    out = k.join(s, k.event_id == s.scene_id)
    return out.select("event_id", "k", "min_lon", "max_lat", ((F.col("min_lon") + F.col("max_lon")) / 2.0).alias("mid"))


# ---- filters and projections -------------------------------------------------------------------------


@query("flt_01", "SELECT site_id, confidence FROM sites WHERE confidence >= 0.7::DOUBLE", ("sites",))
def flt_01(t):
    return filters.by_confidence(t.sites, 0.7).select("site_id", "confidence")


@query("flt_02", """
SELECT s.site_id, s.sector_id, s.confidence FROM sites s JOIN sectors c USING (sector_id)
WHERE c.min_lon = -56.0 AND c.min_lat = -28.0 AND c.max_lon = -55.0 AND c.max_lat = -27.0 AND c.is_active AND s.is_active AND s.confidence >= 0.7::DOUBLE""", ("sites", "sectors"))
def flt_02(t):
    return filters.stored_sites(t.sites, t.sectors, [-56.0, -28.0, -55.0, -27.0], 0.7).select("site_id", "sector_id", "confidence")


@query("flt_03", """
SELECT site_id FROM sites WHERE confidence >= 0.75::DOUBLE AND lon BETWEEN 4.202::DOUBLE AND 4.209::DOUBLE AND lat BETWEEN 51.851::DOUBLE AND 51.858::DOUBLE
  AND detection_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'""", ("sites",))
def flt_03(t):
    return filters.for_export(t.sites, 0.75, [4.202, 51.851, 4.209, 51.858], ("1995-01-01", "1998-12-31")).select("site_id")


@query("flt_04", "SELECT alert_id, job_id FROM alerts WHERE status = 'active' AND severity = 'critical'", ("alerts",))
def flt_04(t):
    return filters.alerts_where(t.alerts, status="active", severity="critical").select("alert_id", "job_id")


@query("flt_05", "SELECT site_id, threat_level FROM scored WHERE threat_level IN ('Critical','High')", ("scored",))
def flt_05(t):
    return filters.severe(t.scored).select("site_id", "threat_level")


@query("flt_07", """
SELECT seq, sector_id, concat_ws(',', CASE WHEN NOT (confidence BETWEEN 0.3::DOUBLE AND 0.95::DOUBLE) THEN 'confidence' END,
  CASE WHEN NOT area_m2 > 1000 THEN 'area_m2' END) AS reasons FROM detections""", ("detections",))
def flt_07(t):
    rules = {"confidence": F.col("confidence").between(0.3, 0.95), "area_m2": F.col("area_m2") > 1000.0}
    out = filters.validate(t.detections, rules)
    return out.select("seq", "sector_id", F.concat_ws(",", "rejected_for").alias("reasons"))


@query("flt_09", "SELECT alert_id, a.job_id FROM alerts a JOIN jobs j USING (job_id) WHERE j.user_id = 5", ("alerts", "jobs"))
def flt_09(t):
    return filters.owned_by(t.alerts, t.jobs, 5).select("alert_id", "job_id")


@query("prj_01", f"""
SELECT site_id AS id, area_m2, confidence, risk_score, threat_level, estimated_tonnage, lon, lat, {YMD.format('detection_date')} AS detection_date,
  waste_type, distance_to_water_km, distance_to_protected_km FROM scored""", ("scored",))
def prj_01(t):
    return filters.site_record(t.scored)


# ---- aggregations ---------------------------------------------------------------------------------------

_TOTALS = f"count(*) AS total_sites, {rnd('coalesce(sum(area_m2),0)', 2)} AS total_area_m2, {rnd('coalesce(sum(estimated_tonnage),0)', 2)} AS total_tonnage, {correct(rnd('coalesce(avg(confidence),0)', 6), 3)} AS avg_confidence"
_LEVELS = ", ".join(f"count(*) FILTER (threat_level = '{v}') AS n_{v.lower()}" for v in ("Critical", "High", "Moderate", "Low"))
_TYPES = ", ".join(f"count(*) FILTER (waste_type = '{v}') AS n_{v}" for v in ("mixed", "construction", "hazardous", "electronic"))


@query("agg_01", f"SELECT {_TOTALS} FROM scored", ("scored",))
def agg_01(t):
    return summaries.summary(t.scored)


@query("agg_02", f"SELECT sector_id, {_LEVELS} FROM scored GROUP BY sector_id", ("scored",))
def agg_02(t):
    return summaries.threat_histogram(t.scored, ["sector_id"])


@query("agg_03", f"SELECT sector_id, {_TOTALS}, {_LEVELS}, {_TYPES}, {correct(rnd('avg(risk_score)', 6), 1)} AS avg_risk_score FROM scored GROUP BY sector_id", ("scored",))
def agg_03(t):
    return summaries.sector_summary(t.scored, ["sector_id"])


@query("agg_04", f"""
SELECT threat_level, count(*) AS n_sites, CAST({rnd(rnd('sum(area_m2)', 6), 0)} AS BIGINT) AS area_m2,
  {rnd('count(*)*100.0::DOUBLE/sum(count(*)) OVER ()', 1)} AS share_pct FROM scored GROUP BY threat_level""", ("scored",))
def agg_04(t):
    return summaries.share_by(t.scored)


_INDEX = f"""
SELECT c.sector_id, c.name, count(s.site_id) AS num_sites, {rnd('coalesce(sum(s.area_m2),0)', 2)} AS total_area_m2
FROM sectors c LEFT JOIN {{}} s USING (sector_id) GROUP BY 1, 2"""


@query("agg_05", _INDEX.format("sites"), ("sites", "sectors"))
def agg_05(t):
    return features.sector_index(t.sites, t.sectors).select("sector_id", "name", "num_sites", "total_area_m2")


@query("src_07", _INDEX.format("sites"), ("sites", "sectors"))
def src_07(t):
    return features.sector_index(t.sites, t.sectors).select("sector_id", "name", "num_sites", "total_area_m2")


@query("agg_06", """
WITH want AS (SELECT unnest(['sentinel2','sentinel1','landsat']) AS source_sensor),
sc AS (SELECT CASE collection WHEN 'optical' THEN 'sentinel2' WHEN 'radar' THEN 'sentinel1' ELSE 'landsat' END AS source_sensor, count(*) AS scenes,
  arg_max(scene_id, (ts, scene_id), 2) AS newest FROM scenes WHERE CASE collection WHEN 'radar' THEN orbit_state = 'descending' ELSE cloud_cover < 20 END GROUP BY 1),
d AS (SELECT source_sensor, count(*) AS n FROM sites WHERE confidence >= 0.7::DOUBLE GROUP BY 1)
SELECT source_sensor, CASE WHEN coalesce(scenes,0) >= 2 THEN coalesce(n,0) ELSE 0 END AS count, coalesce(scenes,0) AS scenes_processed,
  CASE WHEN coalesce(scenes,0) >= 2 THEN newest[2] END AS scene_t0, CASE WHEN coalesce(scenes,0) >= 2 THEN newest[1] END AS scene_t1,
  CASE WHEN coalesce(scenes,0) < 2 THEN 'Insufficient scenes' END AS error
FROM want LEFT JOIN sc USING (source_sensor) LEFT JOIN d USING (source_sensor)""", ("scenes", "sites"))
def agg_06(t):
    name = F.when(F.col("collection") == "optical", "sentinel2").when(F.col("collection") == "radar", "sentinel1").otherwise("landsat")
    found = catalogue.search_optical(t.scenes).unionByName(catalogue.search_radar(t.scenes)).unionByName(catalogue.search_historical(t.scenes))
    sc = found.withColumn("source_sensor", name)
    return summaries.sensor_results(t.spark, ["sentinel2", "sentinel1", "landsat"], filters.by_confidence(t.sites, 0.7), sc)


@query("agg_07", f"SELECT {YMD.format('date')} AS day, {correct(rnd('sum(area_m2)', 6), 1)} AS total_area_m2, count(*) FILTER (area_m2 > 1000) AS num_active_sites FROM obs GROUP BY date", ("obs",))
def agg_07(t):
    return summaries.series_rollup(t.obs, ["date"]).select(DAY("date").alias("day"), "total_area_m2", "num_active_sites")


@query("agg_08", f"""
SELECT sector_id, {YMD.format('detection_date')} AS run, count(*) AS sites_count, {rnd('sum(area_m2)', 2)} AS total_area_m2,
  ['Low','Moderate','High','Critical'][max(CASE threat_level WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END)] AS max_threat_level,
  CASE WHEN bool_or(threat_level IN ('Critical','High')) THEN 'critical' ELSE 'low' END AS severity
FROM detections GROUP BY sector_id, detection_date""", ("detections",))
def agg_08(t):
    return summaries.alert_rollup(t.detections, ["sector_id", "detection_date"]).withColumn("run", DAY("detection_date")).drop("detection_date")


# ---- sorts and sets --------------------------------------------------------------------------------------


@query("srt_01", "SELECT site_id, confidence FROM sites ORDER BY coalesce(confidence, 0) DESC, site_id", ("sites",))
def srt_01(t):
    return filters.by_confidence_desc(t.sites).select("site_id", "confidence")


@query("srt_02", f"SELECT alert_id, {SQL_STAMP.format('created_at')} AS created FROM alerts ORDER BY created_at DESC, alert_id LIMIT 50", ("alerts",))
def srt_02(t):
    return summaries.newest_alerts(t.alerts).select("alert_id", STAMP("created_at").alias("created"))


@query("srt_04", """
SELECT sector_id, site_id, risk_score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sector_id ORDER BY risk_score DESC, site_id) AS rn
FROM scored WHERE threat_level IN ('Critical','High')) WHERE rn <= 5""", ("scored",))
def srt_04(t):
    top = summaries.top_per_group(filters.severe(t.scored), ["sector_id"], [F.col("risk_score").desc(), F.col("site_id")], 5)
    return top.select("sector_id", "site_id", "risk_score", "rank")


@query("set_01", """
SELECT site_id, 'sentinel2' AS source_sensor, 'Sentinel-2' AS sensor, CAST(NULL AS VARCHAR) AS detection_method FROM sites WHERE source_sensor = 'sentinel2'
UNION ALL SELECT site_id, 'sentinel1', 'Sentinel-1', 'SAR coherence + backscatter' FROM sites WHERE source_sensor = 'sentinel1'
UNION ALL SELECT site_id, 'landsat', 'Landsat', NULL FROM sites WHERE source_sensor = 'landsat'""", ("sites",))
def set_01(t):
    from groundshift.plans.detection import union_sensors
    part = lambda s: t.sites.filter(F.col("source_sensor") == s).select("site_id")
    return union_sensors({"sentinel2": part("sentinel2"), "landsat": part("landsat"),
                          "sentinel1": part("sentinel1").withColumn("detection_method", F.lit("SAR coherence + backscatter"))})


@query("set_02", "SELECT site_id, sector_id FROM sites WHERE region_id = 0 UNION ALL SELECT site_id, sector_id FROM sites WHERE region_id <> 0", ("sites",))
def set_02(t):
    one, rest = t.sites.filter("region_id = 0"), t.sites.filter("region_id <> 0")
    return one.unionByName(rest, allowMissingColumns=True).select("site_id", "sector_id")


# ---- joins ---------------------------------------------------------------------------------------------------


@query("join_03", "SELECT a.alert_id, a.job_id, j.user_id, a.status FROM alerts a JOIN jobs j USING (job_id) WHERE j.user_id = 7", ("alerts", "jobs"))
def join_03(t):
    return relations.alerts_of_user(t.alerts, t.jobs, 7).select("alert_id", "job_id", "user_id", "status")


_STORED = "(SELECT DISTINCT sector_id, site_id FROM detections WHERE ts < TIMESTAMP '2024-01-15')"


def _stored(t):
    return t.detections.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).select("sector_id", "site_id").distinct()


@query("join_04", f"SELECT sector_id, site_id, seq FROM detections d WHERE NOT EXISTS (SELECT 1 FROM {_STORED} s WHERE s.sector_id = d.sector_id AND s.site_id = d.site_id)", ("detections",))
def join_04(t):
    return relations.new_sites(t.detections, _stored(t)).select("sector_id", "site_id", "seq")


@query("join_05", f"SELECT sector_id, site_id, seq FROM detections d WHERE EXISTS (SELECT 1 FROM {_STORED} s WHERE s.sector_id = d.sector_id AND s.site_id = d.site_id)", ("detections",))
def join_05(t):
    return relations.known_sites(t.detections, _stored(t)).select("sector_id", "site_id", "seq")


@query("join_06", "SELECT s.site_id, c.name, c.region_name FROM sites s JOIN sectors c USING (sector_id)", ("sites", "sectors"))
def join_06(t):
    return relations.with_sector(t.sites.drop("is_active"), t.sectors).select("site_id", "name", "region_name")


@query("join_10", f"""
WITH o AS (SELECT site_no, count(*) AS n_obs, max(date) AS last_obs FROM obs GROUP BY 1),
r AS (SELECT site_no, count(*) AS n FROM reports GROUP BY 1), a AS (SELECT site_no, count(*) AS n FROM alerts GROUP BY 1)
SELECT s.site_no AS site_id, coalesce(n_obs, 0) AS n_obs, {YMD.format('last_obs')} AS last_obs, coalesce(r.n, 0) AS n_reports, coalesce(a.n, 0) AS n_alerts
FROM sites s LEFT JOIN o USING (site_no) LEFT JOIN r USING (site_no) LEFT JOIN a USING (site_no)""", ("sites", "obs", "reports", "alerts"))
def join_10(t):
    key = F.col("site_no").alias("site_id")
    out = relations.site_overview(t.sites.select(key), t.obs.select(key, "date"), t.reports.select(key), t.alerts.select(key))
    return out.withColumn("last_obs", DAY("last_obs"))


@query("join_11", f"SELECT site_id, base AS cleanup_rate, mult AS legal_multiplier, {_DENSITY} AS density FROM ({_RATES})", ("sites",))
def join_11(t):
    return relations.with_rates(t.sites).select("site_id", "cleanup_rate", "legal_multiplier", "density")


@query("join_12", """
SELECT site_id, rule_id FROM sites, (VALUES ('r1', 0.8::DOUBLE, 10000.0::DOUBLE, []::INTEGER[]), ('r2', 0.9::DOUBLE, 200000.0::DOUBLE, [1,2,3]), ('r3', 0.7::DOUBLE, 450000.0::DOUBLE, [7])) r(rule_id, c, a, regions)
WHERE confidence >= c AND area_m2 >= a AND (len(regions) = 0 OR list_contains(regions, sector_id))""", ("sites",))
def join_12(t):
    rules = [relations.AlertRule("r1"), relations.AlertRule("r2", 0.9, 200000.0, (1, 2, 3)), relations.AlertRule("r3", 0.7, 450000.0, (7,))]
    return relations.fired_rules(t.sites, relations.rule_table(t.spark, rules, "int")).select("site_id", "rule_id")


@query("join_13", """
SELECT j.job_id, j.user_id, alert_id, rn AS rank FROM jobs j JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, alert_id) AS rn FROM alerts) a USING (job_id) WHERE rn <= 10""", ("jobs", "alerts"))
def join_13(t):
    return relations.latest_alerts_per_job(t.jobs, t.alerts).select("job_id", "user_id", "alert_id", "rank")


# ---- geometry columns ------------------------------------------------------------------------------------------


@query("geo_01", """
WITH m AS (SELECT site_id, 6378137.0::DOUBLE*(max_x-min_x)*pi()/180.0 AS w,
  6378137.0::DOUBLE*(ln(tan(pi()/4 + max_y*pi()/360)) - ln(tan(pi()/4 + min_y*pi()/360))) AS h FROM boxes)
SELECT site_id, round(w*h, 0) AS area_m2 FROM m""", ("boxes",))
def geo_01(t):
    return t.polygons.select("site_id", F.round(geometry.area_m2(F.col("ring")), 0).alias("area_m2"))


@query("geo_02", "SELECT site_id, round((max_x-min_x)*(max_y-min_y)*111000.0*111000.0*cos(radians(lat)), 2) AS area_m2 FROM boxes", ("boxes",))
def geo_02(t):
    return t.polygons.select("site_id", F.round(geometry.area_m2_approx(F.col("ring")), 2).alias("area_m2"))


@query("geo_03", "SELECT site_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM boxes", ("boxes",))
def geo_03(t):
    c = geometry.centroid(F.col("ring"))
    return t.polygons.select("site_id", F.round(c[0], 8).alias("lon"), F.round(c[1], 8).alias("lat"))


@query("geo_04", "SELECT scene_id, (min_lon+max_lon)/2.0::DOUBLE AS mid_lon, (min_lat+max_lat)/2.0::DOUBLE AS mid_lat FROM scenes", ("scenes",))
def geo_04(t):
    x, y = geometry.bbox_midpoint(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    return t.scenes.select("scene_id", x.alias("mid_lon"), y.alias("mid_lat"))


@query("geo_05", "SELECT scene_id FROM scenes WHERE min_lon <= 20.0 AND max_lon >= -10.0 AND min_lat <= 5.0 AND max_lat >= -5.0", ("scenes",))
def geo_05(t):
    cols = tuple(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    return t.scenes.filter(geometry.bbox_intersects(cols, (-10.0, -5.0, 20.0, 5.0))).select("scene_id")


_TX = "CAST(floor(({}+180.0::DOUBLE)/360.0::DOUBLE*pow(2.0::DOUBLE, {})) AS BIGINT)"
_TY = "CAST(floor((1.0::DOUBLE - ln(tan({0}*pi()/180.0::DOUBLE) + 1.0::DOUBLE/cos({0}*pi()/180.0::DOUBLE))/pi())/2.0::DOUBLE*pow(2.0::DOUBLE, {1})) AS BIGINT)"


@query("geo_07", f"SELECT site_id, {_TX.format('lon', 14)} AS tile_x, {_TY.format('lat', 14)} AS tile_y FROM sites", ("sites",))
def geo_07(t):
    return t.sites.select("site_id", geometry.tile_x(F.col("centroid.lon"), 14).alias("tile_x"), geometry.tile_y(F.col("centroid.lat"), 14).alias("tile_y"))


@query("geo_08", f"""
WITH z AS (SELECT *, unnest([10,11,12,13,14]) AS zoom FROM sectors),
r AS (SELECT sector_id, zoom, {_TX.format('min_lon', 'zoom')} AS x0, {_TX.format('max_lon', 'zoom')} AS x1, {_TY.format('max_lat', 'zoom')} AS y0, {_TY.format('min_lat', 'zoom')} AS y1 FROM z)
SELECT sector_id, zoom, (x1-x0+1)*(y1-y0+1) AS tiles, (x1-x0+1)*(y1-y0+1)*4 AS downloads FROM r""", ("sectors",))
def geo_08(t):
    from groundshift.operators.tiling import web_tile_counts
    return web_tile_counts(t.sectors, ["sector_id"], list(range(10, 15)), layers=4)
