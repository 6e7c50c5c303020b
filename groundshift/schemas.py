"""Typed schemas (DDL text) and value domains of every table the jobs read or write."""

from __future__ import annotations

# Domains of the enumerated columns, most severe first where an order exists.
THREAT_LEVELS = ("Critical", "High", "Moderate", "Low")
SEVERE_LEVELS = ("Critical", "High")
WASTE_TYPES = ("mixed", "construction", "hazardous", "electronic", "plastic", "organic", "medical", "other")
REPORTED_WASTE_TYPES = ("mixed", "construction", "hazardous", "electronic")
REPORT_STATUSES = ("pending", "under_review", "verified", "rejected", "resolved")
ALERT_SEVERITIES = ("low", "medium", "high", "critical")
ALERT_STATUSES = ("active", "acknowledged", "resolved", "dismissed")
SENSORS = ("sentinel2", "sentinel1", "landsat")

BBOX = "struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"

SCENES = (
    "scene_id string, collection string, ts timestamp, cloud_cover double, orbit_state string, "
    "min_lon double, min_lat double, max_lon double, max_lat double, assets map<string,string>"
)

BAND_TILES = (
    "area string, scene_id string, ts timestamp, band string, ty int, tx int, h int, w int, data array<float>"
)

SECTORS = (
    f"sector_id string, name string, bbox {BBOX}, center struct<lon:double,lat:double>, zoom int, is_active boolean"
)

SITES = (
    "site_id string, sector_id string, geometry struct<type:string,coordinates:array<array<array<double>>>>, "
    "centroid struct<lon:double,lat:double>, area_m2 double, estimated_tonnage double, confidence double, "
    "risk_score int, threat_level string, waste_type string, detection_date date, sensor string, "
    "ndvi_before double, ndvi_after double, delta_ndvi double, swir_mean double, "
    "distance_to_water_km double, distance_to_protected_km double, scene_t0 string, scene_t1 string, is_active boolean"
)

OBSERVATIONS = (
    "site_id string, date date, area_m2 double, confidence double, ndvi double"
)

REPORTS = (
    "report_id string, reporter_id string, latitude double, longitude double, accuracy_m double, "
    "threat_level string, waste_type string, description string, created_at timestamp"
)

JOBS = (
    f"job_id string, user_id string, sector_id string, bbox {BBOX}, confidence_threshold double, "
    "lookback_days int, schedule_type string, interval_hours int, is_active boolean"
)

ALERTS = (
    "alert_id string, job_id string, sector_id string, severity string, status string, title string, message string, "
    "sites_count bigint, total_area_m2 double, max_threat_level string, metadata map<string,string>, created_at timestamp"
)

_FEATURE_PROPERTIES = (
    "struct<id:string,area_m2:double,confidence:double,risk_score:int,threat_level:string,estimated_tonnage:double,"
    "centroid:array<double>,detection_date:string,sensor:string,waste_type:string,ndvi_before:double,ndvi_after:double,"
    "delta_ndvi:double,swir_mean:double,distance_to_water_km:double,distance_to_protected_km:double>"
)

SECTOR_FILE = (
    "metadata struct<id:string,name:string,bbox:array<double>,center:array<double>,zoom:int,generated_at:string,"
    "scene_t0:string,scene_t1:string,processing_mode:string>, "
    "feature_collection struct<type:string,features:array<struct<type:string,"
    f"geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:{_FEATURE_PROPERTIES}>>>, "
    "summary struct<total_sites:int,total_area_m2:double,total_tonnage:double,by_threat:map<string,int>,"
    "by_waste_type:map<string,int>,avg_confidence:double,avg_risk_score:double>, "
    "timeseries struct<dates:array<string>,sites:map<string,struct<dates:array<string>,area_m2:array<double>,"
    "confidence:array<double>,ndvi:array<double>>>,"
    "summary:struct<total_area_m2:array<double>,num_active_sites:array<int>>>"
)
