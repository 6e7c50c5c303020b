"""Detection inside the monitoring stream: scenes and tiles arrive, and areas whose newest scene pair changes are analysed.

Scenes and tiles form one keyed stream of arrivals. The state of an area is its two newest complete scenes and what is known of
newer ones that still lack tiles; older arrivals are forgotten. Only areas whose pair changed leave the operator, and only the
tiles of their pairs are read from the tile table, whose folders are area and scene.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans import detection
from ..session import discard, stage
from ..sources import catalogue
from .monitoring import BatchLog, Monitor, job_scene_pairs

PAIRS = "area string, scene_t0 string, scene_t1 string, ts_t0 timestamp, ts_t1 timestamp"
_PAIR_STATE = "scene_t0 string, scene_t1 string, micros_t0 long, micros_t1 long"
_PENDING_STATE = "micros long, usable boolean, tiles int, seen string"
DETECTIONS = ("sector_id string, site_id string, ts timestamp, detection_date date, confidence double, risk_score int, threat_level string, area_m2 double, "
              "estimated_tonnage double, ring array<array<double>>, centroid struct<lon: double, lat: double>, scene_t0 string, scene_t1 string, waste_type string")
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scene_arrivals(scenes: DataFrame, max_cloud: float | None = None, collection: str = catalogue.OPTICAL) -> DataFrame:
    """Arrivals of a catalogue's collection: (area, scene_id, micros, usable, tiles, band), usable below the cloud limit as in a search.

    ``tiles`` is how many tiles of each band the scene has; without that column, one of each band makes it complete.
    """
    tiles = F.col("tiles") if "tiles" in scenes.columns else F.lit(1)
    usable = F.coalesce(F.col("cloud_cover") < float(max_cloud or catalogue.DEFAULT_MAX_CLOUD), F.lit(False))
    return scenes.filter(F.col("collection") == collection).select(
        F.col("area").cast("string").alias("area"), F.col("scene_id").cast("string").alias("scene_id"), F.unix_micros("ts").alias("micros"),
        usable.alias("usable"), tiles.cast("int").alias("tiles"), F.lit(None).cast("string").alias("band"))


def tile_arrivals(band_tiles: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Arrivals of tiles of the wanted bands; their data are not read."""
    nothing = {"micros": "long", "usable": "boolean", "tiles": "int"}
    return band_tiles.filter(F.col("band").isin(*bands.values())).select(
        F.col("area").cast("string").alias("area"), F.col("scene_id").cast("string").alias("scene_id"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()], "band")


class NewestPair(StatefulProcessor):
    """Keeps the two newest complete usable scenes of an area and gives out the pair whenever it changes.

    Of scenes with one time the smaller scene_id counts as the newer one, as in a search of the whole catalogue. An announcement
    that is repeated replaces the one before; a scene that is announced as not usable is forgotten with its tiles.
    """

    def __init__(self, bands: list[str]):
        self.bands = bands

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pair = handle.getValueState("pair", _PAIR_STATE)
        self.pending = handle.getMapState("pending", "scene_id string", _PENDING_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.pair.get() if self.pair.exists() else (None, None, None, None)
        had = [(-micros, scene) for scene, micros in ((known[1], known[3]), (known[0], known[2])) if scene is not None]
        pending: dict[str, list] = {}

        def about(scene: str) -> list:
            if scene not in pending:
                held = self.pending.getValue((scene,)) if self.pending.containsKey((scene,)) else None
                pending[scene] = [held[0], held[1], held[2], json.loads(held[3])] if held else [None, None, None, {}]
            return pending[scene]

        dropped: set[str] = {scene for _, scene in had}  # of a pair already, nothing more to learn
        for pdf in rows:
            for scene, band, micros, usable, tiles in zip(pdf["scene_id"], pdf["band"], pdf["micros"], pdf["usable"], pdf["tiles"]):
                if scene in dropped:
                    continue
                known_of = about(scene)
                if band is None or pd.isna(band):
                    known_of[0], known_of[1], known_of[2] = (None if pd.isna(micros) else int(micros)), bool(usable), 1 if pd.isna(tiles) else int(tiles)
                else:
                    known_of[3][band] = known_of[3].get(band, 0) + 1
        whole = [(-m, scene) for scene, (m, usable, tiles, seen) in pending.items()
                 if usable and m is not None and all(seen.get(b, 0) >= tiles for b in self.bands)]
        best = sorted({*had, *whole})[:2]
        oldest = best[1] if len(best) == 2 else None
        for scene, (m, usable, tiles, seen) in pending.items():
            over = (-m, scene) in best if m is not None else False
            late = oldest is not None and m is not None and (-m, scene) > oldest
            if over or late or usable is False:
                if self.pending.containsKey((scene,)):
                    self.pending.removeKey((scene,))
            else:
                self.pending.updateValue((scene,), (m, usable, tiles, json.dumps(seen)))
        if best == had or not best:
            return
        t1, t0 = best[0], best[1] if len(best) == 2 else (None, None)
        micros_t0 = None if t0[0] is None else -t0[0]
        self.pair.update((t0[1], t1[1], micros_t0, -t1[0]))
        yield pd.DataFrame({"area": [key[0]], "scene_t0": [t0[1]], "scene_t1": [t1[1]], "micros_t0": pd.array([micros_t0], "Int64"), "micros_t1": [-t1[0]]})

    def close(self) -> None:
        pass


def changed_pairs(arrivals: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Stream of PAIRS: the newest pair of each area whose pair a micro-batch changed; ``scene_t0`` is null while there is one scene."""
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    out = arrivals.groupBy("area").transformWithStateInPandas(
        NewestPair(list(bands.values())), "area string, scene_t0 string, scene_t1 string, micros_t0 long, micros_t1 long", "Update", "None")
    return out.select("area", "scene_t0", "scene_t1", F.timestamp_micros("micros_t0").alias("ts_t0"), F.timestamp_micros("micros_t1").alias("ts_t1"))


def tiles_of(band_tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tiles of the scenes of ``pairs``. Of a table in folders by area and scene, Spark opens those of the wanted scenes alone.

    It prunes folders at run time only by a side that has a filter; the one on ``step`` keeps both scenes.
    """
    wanted = pairs.select("area", F.posexplode(F.array("scene_t0", "scene_t1")).alias("step", "scene_id")).filter("step <= 1 AND scene_id IS NOT NULL")
    return band_tiles.join(wanted, ["area", "scene_id"], "left_semi")


class StreamedDetection(Monitor):
    """A monitor whose batches are changed scene pairs: it runs the detection on their tiles and goes on with its sites.

    ``tiles`` gives the tile table (area, scene_id, band, ty, tx, h, w, data), the ``sector_id`` of jobs is an area. A batch is one
    run of all active jobs at ``run_date``: a job whose look-back window lacks a pair gets the error and no sites. Overlapping
    sites of an area are suppressed.
    """

    def __init__(self, spark: SparkSession, root: str, jobs: DataFrame, tiles: Callable[[], DataFrame], bands: dict[str, str],
                 layout: detection.Layout, limits: detection.Limits = detection.Limits(), run_date: str | None = None, start: DataFrame | None = None):
        self.tiles, self.bands, self.layout, self.limits = tiles, bands, layout, limits
        self.pair_log = BatchLog.create(spark, root + "/pairs", spark.createDataFrame([], PAIRS))
        super().__init__(spark, root, jobs, spark.createDataFrame([], DETECTIONS), ["ts", "site_id"], self._detect,
                         dedupe_id="site_id", ring="ring", run_date=run_date, start=start)

    def _detect(self, pairs: DataFrame) -> DataFrame:
        found = detection.detect_pairs(pairs.filter("scene_t0 IS NOT NULL"), tiles_of(self.tiles(), pairs), self.bands, self.layout, self.limits)
        ts = pairs.select("area", F.col("ts_t1").alias("ts"))
        return found.join(ts, "area").withColumn("sector_id", F.col("area")).select(
            "sector_id", "site_id", "ts", "detection_date", "confidence", "risk_score", "threat_level", "area_m2", "estimated_tonnage", "ring", "centroid",
            "scene_t0", "scene_t1", F.lit("mixed").alias("waste_type"))

    def _run_time(self, batch: DataFrame) -> Column:
        return F.lit(self.run_date).cast("timestamp")

    def newest_scenes(self, before: int | None = None) -> DataFrame:
        """(sector_id, scene_id, ts) of the two newest complete scenes of every area."""
        last = self.pair_log.read(before).groupBy("area").agg(F.max_by(F.struct("scene_t0", "scene_t1", "ts_t0", "ts_t1"), "batch_id").alias("p"))
        both = F.array(*[F.struct(F.col(f"p.scene_{t}").alias("scene_id"), F.col(f"p.ts_{t}").alias("ts")) for t in ("t0", "t1")])
        return last.select(F.col("area").alias("sector_id"), F.inline(both)).filter("scene_id IS NOT NULL")

    def process(self, raw: DataFrame, batch_id: int) -> None:
        pairs = stage(raw, "pairs")
        self.pair_log.write(pairs, batch_id)
        self.scenes = stage(self.newest_scenes(batch_id + 1), "newest")
        watched = self.job_pairs(batch_id + 1).filter("last_error IS NULL").select(F.col("sector_id").alias("area")).distinct()
        wanted = stage(pairs.join(watched, "area", "left_semi"), "watched-pairs")
        super().process(wanted, batch_id)
        discard(pairs, self.scenes, wanted)

    def job_pairs(self, before: int | None = None) -> DataFrame:
        """Every active job with the scene pair of its window, or the error."""
        return job_scene_pairs(self.jobs, self.newest_scenes(before), self.run_date)


def detect_in_batch(monitor: StreamedDetection, scenes: DataFrame, max_cloud: float | None = None) -> None:
    """The same run over whole tables at once: newest complete pairs by a search, then the monitor's batch."""
    pairs = detection.complete_pairs(catalogue.search_optical(scenes, max_cloud=max_cloud), monitor.tiles(), monitor.bands)
    monitor.process(pairs.select("area", "scene_t0", "scene_t1", "ts_t0", "ts_t1"), 0)
