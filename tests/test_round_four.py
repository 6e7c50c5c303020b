"""Faults of larger tables: scene times, tables in folders, copies of shapes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contract import q_raster
from contract.fixtures import Tables
from contract.q_outputs import scene_rows
from contract.q_streams import stm_05
from groundshift.functions import geometry
from groundshift.operators import overlap, relations
from groundshift.session import run_dir
from groundshift.streaming import monitoring


def test_scene_times_do_not_overflow(spark):
    steps = spark.range(3).select(F.lit("a").alias("area"), (F.col("id") * 1000).cast("int").alias("step"))
    got = {r["scene_id"]: r["ts"] for r in scene_rows(steps).filter("collection = 'optical'").collect()}
    assert got["0"] == datetime(2024, 1, 1) and got["2000"] == datetime(2188, 4, 10)


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_in_a_folder_is_streamed_whole(spark, tables, files):
    where = run_dir(spark, "folder")
    for name in ("events", "supplier"):
        tables.raw(name).repartition(files).write.parquet(f"{where}/{name}.parquet")
    root, ckpt = monitoring.fresh_dirs(spark, "folder")
    seen = monitoring.BatchLog.create(spark, root + "/seen", tables.raw("events").limit(0))
    monitoring.run_available(Tables(spark, where).event_stream(), lambda df, i: seen.write(df, i), ckpt)
    assert seen.read().count() == tables.raw("events").count()
    assert stm_05(Tables(spark, where)).count() == stm_05(tables).count() > 0


def _copied_sites(spark, ring):
    """Thirty copies of each of three boxes, of which two overlap, and one in another scope."""
    box = {0: (0.0, 0.0, 2.0, 2.0), 1: (0.1, 0.0, 2.1, 2.0), 2: (9.0, 9.0, 10.0, 10.0), 3: (0.0, 0.0, 2.0, 2.0)}
    rows = [("other" if n == 3 else "one", 10 * i + n, *map(float, b)) for n, b in box.items() for i in range(30)]
    df = spark.createDataFrame(rows, "scope string, id long, min_x double, min_y double, max_x double, max_y double")
    return df.withColumn("ring", geometry.rectangle(*[F.col(c) for c in overlap.BOX])) if ring else df


@pytest.mark.parametrize("ring", [None, "ring"])
def test_copies_are_members_and_not_pairs(spark, ring):
    df = _copied_sites(spark, ring)
    got = overlap.class_pairs(df, ["scope"], "id", 0.5, ring).collect()
    assert len(got) == 4 * 29 + 1
    of = {(r["scope"], r["id_b"]): r["id_a"] for r in got if r["kind"] == "copy"}
    rep = lambda scope, i: of.get((scope, i), i)
    iou = {(r["scope"], r["id_a"], r["id_b"]): r["iou"] for r in got if r["kind"] == "link"}
    ids = [(r["scope"], r["id"]) for r in df.collect()]
    back = {}
    for scope, a in ids:
        for other, b in ids:
            if scope == other and a < b:
                pair = tuple(sorted((rep(scope, a), rep(scope, b))))
                if pair[0] == pair[1] or (scope, *pair) in iou:
                    back[scope, a, b] = 1.0 if pair[0] == pair[1] else iou[(scope, *pair)]
    whole = {(r["scope"], r["id_a"], r["id_b"]): r["iou"] for r in overlap.overlap_pairs(df, ["scope"], "id", 0.5, ring).collect()}
    assert len(whole) == 2640 and back == pytest.approx(whole)


def test_suppression_sends_no_rows_through_the_driver(spark, monkeypatch):
    plans = []
    keep = overlap.stage

    def stage(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(overlap, "stage", stage)
    df = _copied_sites(spark, None).withColumn("confidence", F.col("id") / 1000)
    kept = overlap.suppress(df, "id", ["scope"], heads=1)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert sorted(r["id"] for r in kept.collect()) == [291, 292, 293]
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_rules_come_to_the_sites(spark, tables):
    rules = [relations.AlertRule("r1"), relations.AlertRule("r2", 0.9, 200000.0, (1, 2, 3))]
    fired = relations.fired_rules(tables.sites.select("site_id", "sector_id", "confidence", "area_m2"), rules)
    plan = fired._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_wide" not in plan and "_wide" in plan
    assert fired.count() == fired.select("site_id", "rule_id").distinct().count() > 0


def test_series_files_hold_many_sites(spark, tables, monkeypatch):
    where = []
    monkeypatch.setattr(q_raster, "run_dir", lambda s, label: where.append(run_dir(s, label)) or where[-1])
    assert q_raster.src_06(tables).count() == tables.obs.count()
    o = tables.obs.select((F.floor(F.col("site_no") / 100)).alias("part"), F.year("date").alias("year")).distinct()
    assert spark.read.text(where[0]).count() == o.count()
