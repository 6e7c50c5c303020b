"""Detection inside the monitoring stream against the same run over whole tables."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundshift.plans import detection
from groundshift.session import run_dir, stage
from groundshift.streaming import detecting, monitoring

BANDS = {"red": "B04", "nir": "B08", "swir": "B11"}
LAYOUT = detection.Layout(8, 16, 16, (0.001, 0.0, 4.2, 0.0, -0.001, 51.95))
LIMITS = detection.Limits(ndvi_delta=0.0, swir=0.05, tolerance=0.0, min_px=1.0, min_area_m2=10.0, confidence=0.6)
AREAS, SCENES = ["a", "b", "c"], 3


@pytest.fixture(scope="module")
def store(spark):
    """Tiles of three areas in folders of area and scene, and their scenes, one of area c without its last band."""
    rng = random.Random(11)
    rows = []
    for area, scene, band, ty, tx in itertools.product(AREAS, range(SCENES), BANDS.values(), range(2), range(2)):
        if not (area == "c" and scene == SCENES - 1 and band == "B11"):
            rows.append((area, f"{area}{scene}", band, ty, tx, 8, 8, [rng.random() for _ in range(64)]))
    path = run_dir(spark, "tiles")
    df = spark.createDataFrame(rows, "area string, scene_id string, band string, ty int, tx int, h int, w int, data array<double>")
    df.write.partitionBy("area", "scene_id").parquet(path)
    scenes = spark.createDataFrame([(a, f"{a}{s}", "optical", f"2024-01-{10 + s}", 1.0) for a in AREAS for s in range(SCENES)],
                                   "area string, scene_id string, collection string, d string, cloud_cover double").withColumn("ts", F.to_timestamp("d"))
    return path, stage(scenes, "scenes")


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(1, "a", True, 0.6, 30), (2, "b", True, 0.6, 30), (3, "b", True, 0.9, 30), (4, "c", True, 0.6, 30), (5, "a", True, 0.6, 0), (6, "d", True, 0.6, 30), (7, "a", False, 0.6, 30)]
    return spark.createDataFrame(rows, "job_id int, sector_id string, is_active boolean, confidence_threshold double, lookback_days int")


def tiles(spark, store):
    schema = "band string, ty int, tx int, h int, w int, data array<double>, area string, scene_id string"
    return lambda: spark.read.schema(schema).parquet(store[0])


def arrivals(spark, store, scenes=None):
    rows = detecting.tile_arrivals(tiles(spark, store)(), BANDS).union(detecting.scene_arrivals(store[1]))
    return rows if scenes is None else rows.filter(F.substring("scene_id", 2, 1).cast("int").isin(scenes))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def monitor(spark, store, jobs):
    return detecting.StreamedDetection(spark, run_dir(spark, "watch"), jobs, tiles(spark, store), BANDS, LAYOUT, LIMITS, run_date="2024-01-12")


def rows(df, *drop):
    return sorted(map(str, df.drop("batch_id", "alert_id", "first_batch", *drop).collect()))


def test_one_batch_equals_the_batch_run(spark, store, jobs):
    path = run_dir(spark, "arrivals")
    all_ = arrivals(spark, store)
    all_.coalesce(1).write.parquet(path)
    m, b = monitor(spark, store, jobs), monitor(spark, store, jobs)
    m.run(detecting.changed_pairs(stream(spark, path, all_.schema), BANDS), run_dir(spark, "checkpoint"))
    detecting.detect_in_batch(b, store[1])
    assert m.sites().count() > 3
    for part in ("sites", "alerts", "job_state", "job_pairs"):
        assert rows(getattr(m, part)()) == rows(getattr(b, part)()), part
    newest = {r.area: (r.scene_t0, r.scene_t1) for r in m.pair_log.read().collect()}
    assert newest == {"a": ("a1", "a2"), "b": ("b1", "b2"), "c": ("c0", "c1")}
    assert {r.job_id: r.last_error for r in m.job_state().collect()} == {1: None, 2: None, 3: None, 4: None, 5: monitoring.NO_IMAGERY, 6: monitoring.NO_IMAGERY}
    # a replay of the batch leaves all tables as they are
    before = [rows(getattr(m, part)()) for part in ("sites", "alerts", "job_state")]
    m.process(stage(m.pair_log.read().drop("batch_id"), "again"), 0)
    assert before == [rows(getattr(m, part)()) for part in ("sites", "alerts", "job_state")]


def test_many_batches(spark, store, jobs):
    path = run_dir(spark, "arrivals")
    m, checkpoint = monitor(spark, store, jobs), run_dir(spark, "checkpoint")
    for i in range(SCENES):
        part = arrivals(spark, store, [i])
        part.coalesce(1).write.mode("append").parquet(path)
        m.run(detecting.changed_pairs(stream(spark, path, part.schema), BANDS), checkpoint)  # each run goes on with the state of the last
    log = {(r.batch_id, r.area): (r.scene_t0, r.scene_t1) for r in m.pair_log.read().collect()}
    assert {pair for (_, area), pair in log.items() if area == "a"} == {(None, "a0"), ("a0", "a1"), ("a1", "a2")}
    assert not any("c2" in pair for pair in log.values())
    whole = monitor(spark, store, jobs)
    detecting.detect_in_batch(whole, store[1])
    last = {"a": "a2", "b": "b2", "c": "c1"}
    newest = m.sites().filter(F.create_map(*[F.lit(x) for kv in last.items() for x in kv])[F.col("sector_id")] == F.col("scene_t1"))
    assert rows(newest) == rows(whole.sites())
    per_pair = m.alerts().groupBy("job_id").agg(F.sum("sites_count").alias("n"))
    assert {r.job_id for r in per_pair.collect()} <= {1, 2, 3, 4}
    assert m.alerts().agg(F.sum("sites_count")).first()[0] == m.sites().count()  # each site is announced once


def test_only_tiles_of_changed_areas_are_read(spark, store, jobs, tmp_path):
    pairs = stage(spark.createDataFrame([("b", "b0", "b1", None, None)], detecting.PAIRS), "pairs")
    wanted = detecting.tiles_of(tiles(spark, store)(), pairs)
    assert "dynamicpruning" in wanted._jdf.queryExecution().executedPlan().toString()
    assert {(r.area, r.scene_id) for r in wanted.select("area", "scene_id").distinct().collect()} == {("b", "b0"), ("b", "b1")}
    # files of other areas are not opened: broken ones do no harm
    broken = str(tmp_path / "tiles")
    tiles(spark, store)().write.partitionBy("area", "scene_id").parquet(broken)
    for area in ("a", "c"):
        for f in (tmp_path / "tiles").glob(f"area={area}/*/*.parquet"):
            f.write_bytes(b"no parquet at all")
    m = monitor(spark, (broken, store[1]), jobs)
    m.process(spark.createDataFrame([("b", "b1", "b2", None, None)], detecting.PAIRS).withColumns(
        {"ts_t0": F.lit("2024-01-11").cast("timestamp"), "ts_t1": F.lit("2024-01-12").cast("timestamp")}), 0)
    assert m.sites().count() > 0


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Map(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop


def test_state_of_an_area_for_any_order_of_arrivals():
    rng = random.Random(2)
    for _ in range(300):
        names = [f"s{i}" for i in range(rng.randint(1, 6))]
        times = {s: None if rng.random() < 0.05 else rng.randint(0, 3) for s in names}
        usable = {s: rng.random() < 0.8 for s in names}
        todo = [(s, None, times[s], usable[s], 2) for s in names]
        todo += [(s, b, None, None, None) for s in names for b in BANDS.values() for _ in range(2) if rng.random() < 0.95]
        whole = [s for s in names if usable[s] and times[s] is not None and all(sum(r[:2] == (s, b) for r in todo) == 2 for b in BANDS.values())]
        want = [*sorted(whole, key=lambda s: (-times[s], s))[:2], None, None][:2]
        rng.shuffle(todo)
        p = detecting.NewestPair(list(BANDS.values()))
        p.pair, p.pending, given = _Value(), _Map(), []
        while todo:
            k = rng.randint(1, len(todo))
            frame, todo = pd.DataFrame(todo[:k], columns=["scene_id", "band", "micros", "usable", "tiles"]), todo[k:]
            given += [(out["scene_t1"][0], out["scene_t0"][0]) for out in p.handleInputRows(("x",), iter([frame.iloc[:k // 2], frame.iloc[k // 2:]]), None)]
        assert (list(given[-1]) if given else [None, None]) == want
        assert all(a != b for a, b in zip(given, given[1:]))  # only changes are given out
        assert not set(want) & set(p.pending)  # scenes of the pair wait for nothing
