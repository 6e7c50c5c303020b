import pytest
from pyspark.sql import functions as F

from groundshift.session import run_dir
from groundshift.streaming import monitoring, reports


@pytest.fixture(scope="module")
def parts(spark, tables):
    """The events cut into five files by time, oldest first."""
    path = run_dir(spark, "parts")
    ev = tables.raw("events").withColumn("part", F.ntile(5).over(__import__("pyspark").sql.Window.orderBy("ts")))
    for i in range(1, 6):
        ev.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, tables, path):
    return spark.readStream.schema(tables.raw("events").schema).option("maxFilesPerTrigger", 1).parquet(path)


def monitor(spark, tables, source):
    root, ckpt = monitoring.fresh_dirs(spark, "m")
    m = monitoring.Monitor(spark, root, tables.jobs, tables.detections, ["ts", "seq"], tables.map_detections)
    m.run(source, ckpt)
    return m


def same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


def test_many_batches_give_the_state_of_one(spark, tables, parts):
    one, many = monitor(spark, tables, tables.event_stream()), monitor(spark, tables, stream(spark, tables, parts))
    assert many.run_log.read().select("batch_id").distinct().count() == 5
    assert same(one.sites(), many.sites())
    # every site is announced once, whatever the batches
    total = lambda m: m.alerts().agg(F.sum("sites_count")).first()[0]
    assert total(one) == total(many) == one.sites().count()
    state = many.job_state().collect()
    assert {r["run_count"] for r in state} == {5}


def test_replaying_a_batch_changes_nothing(spark, tables):
    m = monitor(spark, tables, tables.event_stream())
    before = (m.sites().collect(), m.alerts().collect(), m.job_state().collect())
    m.process(tables.raw("events"), 0)
    after = (m.sites().collect(), m.alerts().collect(), m.job_state().collect())
    assert [sorted(map(str, x)) for x in before] == [sorted(map(str, x)) for x in after]


def test_upsert_keeps_inserted_columns(spark):
    rows = [(1, 1, "2024-01-01", 0.8, 10, "a"), (1, 1, "2024-01-02", 0.9, 20, "b")]
    base = spark.createDataFrame(rows, "sector_id int, site_id int, d string, confidence double, area int, waste_type string")
    det = base.select("sector_id", "site_id", F.to_timestamp("d").alias("ts"), F.to_date("d").alias("detection_date"), "confidence",
                      F.lit(1).alias("risk_score"), F.lit("Low").alias("threat_level"), F.col("area").cast("double").alias("area_m2"),
                      F.lit(0.0).alias("estimated_tonnage"), "waste_type")
    table = monitoring.SiteTable(spark, run_dir(spark, "table"), monitoring.fold_batch(det.limit(0), ["ts"]))
    fresh = [table.upsert(monitoring.fold_batch(det.filter(f"area_m2 = {area}"), ["ts"]), i).count() for i, area in enumerate((10, 20))]
    assert fresh == [1, 0]
    r = table.current().first()
    assert (r["waste_type"], r["area_m2"], r["confidence"], str(r["detection_date"])) == ("a", 20.0, 0.9, "2024-01-02")


def test_site_table_versions(spark):
    rows = lambda *pairs: spark.createDataFrame([(s, i, f"2024-01-0{d}", float(d)) for s, i, d in pairs], "sector_id int, site_id int, d string, area_m2 double").select(
        "sector_id", "site_id", F.to_timestamp("d").alias("ts"), F.to_date("d").alias("detection_date"), F.lit(0.9).alias("confidence"), F.lit(1).alias("risk_score"),
        F.lit("Low").alias("threat_level"), "area_m2", F.lit(0.0).alias("estimated_tonnage"))
    fold = lambda *pairs: monitoring.fold_batch(rows(*pairs), ["ts"])
    table = monitoring.SiteTable(spark, run_dir(spark, "table"), fold((1, 1, 1)))
    assert table.upsert(fold((1, 1, 1), (2, 1, 1)), 0).count() == 2
    assert table.upsert(fold((1, 1, 2), (1, 2, 2)), 1).count() == 1
    state = lambda: {(r.sector_id, r.site_id): (r.area_m2, r.first_batch) for r in table.current().collect()}
    want = {(1, 1): (2.0, 0), (1, 2): (2.0, 1), (2, 1): (1.0, 0)}
    assert state() == want and table.current().count() == 3
    # a replay finds the same sites new and leaves the same rows
    assert table.upsert(fold((1, 1, 2), (1, 2, 2)), 1).count() == 1 and state() == want
    assert table.upsert(fold((1, 1, 1)).limit(0), 2).count() == 0 and state() == want
    # sector 2 is neither read nor written by a batch that does not touch it
    assert {r.sector_id for r in spark.read.parquet(f"{table.path}/batch_id=1").select("sector_id").distinct().collect()} == {1}


def test_batch_suppression_inside_the_monitor(spark, tables):
    rows = [(0, i, float(i), 0.95 - i / 100) for i in range(3)]
    raw = spark.createDataFrame(rows, "sector_id int, site_id int, shift double, confidence double")
    det = raw.select("sector_id", "site_id", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("2024-01-01").cast("date").alias("detection_date"),
                     "confidence", F.lit(80).alias("risk_score"), F.lit("Critical").alias("threat_level"), F.lit(5.0).alias("area_m2"),
                     F.lit(1.0).alias("estimated_tonnage"), F.lit("mixed").alias("waste_type"),
                     F.col("shift").alias("min_x"), F.lit(0.0).alias("min_y"), (F.col("shift") + 4).alias("max_x"), F.lit(4.0).alias("max_y"))
    jobs = spark.createDataFrame([(7, 0, True, 0.7), (9, 0, True, 0.7)], "job_id int, sector_id int, is_active boolean, confidence_threshold double")
    m = monitoring.Monitor(spark, run_dir(spark, "m"), jobs, det, ["ts", "site_id"], lambda d: d, dedupe_id="site_id")
    m.process(det, 0)
    assert {r["site_id"] for r in m.sites().collect()} == {0, 2}
    a = m.alerts().collect()
    assert [(r["job_id"], r["sites_count"], r["severity"]) for r in a] == [(7, 2, "critical")]
    assert {r["job_id"]: r["new_sites"] for r in m.job_state().collect()} == {7: 2, 9: 0}


def test_first_seen_over_batches_with_repeats(spark, tables, parts):
    root, ckpt = monitoring.fresh_dirs(spark, "seen")
    seen = monitoring.first_seen(tables.map_detections(stream(spark, tables, parts)), "60 days").select("sector_id", "site_id")
    log = monitoring.BatchLog.create(spark, root, tables.detections.select("sector_id", "site_id").limit(0))
    monitoring.run_available(seen, lambda df, i: log.write(df, i), ckpt)
    got = log.read().drop("batch_id")
    assert got.count() == got.distinct().count()
    assert same(got, tables.detections.select("sector_id", "site_id").distinct())


def test_transitions_and_windows_over_batches(spark, tables, parts):
    root, ckpt = monitoring.fresh_dirs(spark, "t")
    many = monitoring.stream_transitions(stream(spark, tables, parts), tables.map_alert_events, ["ts", "seq"], root, ckpt)
    one = monitoring.fold_transitions(tables.map_alert_events(tables.raw("events")), ["ts", "seq"]).drop("last")
    assert same(many, one)
    root, ckpt = monitoring.fresh_dirs(spark, "w")
    counts = monitoring.windowed_counts(tables.map_detections(stream(spark, tables, parts)), "14 days", "1 day", ["sector_id"], lateness="14 days")
    got = monitoring.stream_windows(counts, root, ckpt, ["window_start", "sector_id"]).withColumn("area_m2", F.round("area_m2", 3))
    exp = monitoring.windowed_counts(tables.detections, "14 days", "1 day", ["sector_id"]).withColumn("area_m2", F.round("area_m2", 3))
    assert same(got, exp)


def test_report_ingest_is_exactly_once(spark, tables, parts):
    root, ckpt = monitoring.fresh_dirs(spark, "r")
    for _ in range(2):  # a second timer run finds nothing new
        reports.ingest_reports(tables.map_reports(stream(spark, tables, parts)), root, ckpt)
    stored = spark.read.parquet(root)
    assert stored.count() == tables.reports.count() == stored.select("report_id").distinct().count()
    assert stored.filter("status <> 'pending' or verified").count() == 0


def test_job_without_scenes_reports_missing_imagery(spark):
    jobs = spark.createDataFrame([(1, 5, True, 14), (2, 6, True, 14), (3, 5, False, 14)], "job_id int, sector_id int, is_active boolean, lookback_days int")
    scenes = spark.createDataFrame([(5, 10, "2024-01-29"), (5, 11, "2024-01-20"), (5, 12, "2024-01-01"), (6, 13, "2024-01-29")], "sector_id int, scene_id int, d string").withColumn("ts", F.to_timestamp("d"))
    got = {r["job_id"]: (r["scene_t1"], r["scene_t0"], r["last_error"]) for r in monitoring.job_scene_pairs(jobs, scenes, "2024-01-30").collect()}
    assert got == {1: (10, 11, None), 2: (13, None, monitoring.NO_IMAGERY)}
