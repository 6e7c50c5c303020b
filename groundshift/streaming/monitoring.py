"""Monitoring as a stream: site upserts, alerts, run log, first-seen keys, scheduled windows.

What a micro-batch produces is one Spark overwrite of a folder of its own. A batch that is replayed after a failure
rewrites that folder and reads only older ones, so results do not depend on retries. The site table holds current rows:
a batch writes the sectors it touches anew, and readers take each sector from the newest batch that wrote it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlap, summaries
from ..session import discard, run_dir, stage
from ..sinks import exports
from ..sources.catalogue import newest_scenes

# Error text of a run without a scene pair, and the columns an update overwrites.
NO_IMAGERY = "Insufficient satellite imagery"
MEASURES = ["detection_date", "confidence", "risk_score", "threat_level", "area_m2", "estimated_tonnage"]
KEY = ["sector_id", "site_id"]


@dataclass
class BatchLog:
    """Parquet table with a ``batch_id`` folder per micro-batch."""

    spark: SparkSession
    path: str
    schema: str

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        df = self.spark.read.schema(self.schema + ", batch_id bigint").parquet(self.path)
        return df if before is None else df.filter(F.col("batch_id") < before)

    @classmethod
    def create(cls, spark: SparkSession, path: str, empty: DataFrame) -> BatchLog:
        """Open a log with the columns of ``empty``, which is written if nothing is there yet."""
        empty.write.mode("ignore").parquet(f"{path}/batch_id=-1")
        return cls(spark, path, _ddl(empty))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class SiteTable:
    """One current row for each site, in folders ``batch_id=.../sector_id=...``.

    An upsert reads the touched sectors as they were before its batch and writes them whole under the batch's id, so it can be
    repeated and never overwrites what it reads. A reader takes each sector from its newest batch and folds nothing. Superseded
    folders stay until they are removed by age.
    """

    def __init__(self, spark: SparkSession, path: str, folded: DataFrame, start: DataFrame | None = None):
        rows = folded.limit(0).select(*KEY, "first.*", "last.*", F.lit(-1).cast("long").alias("first_batch"))
        self.spark, self.path, self.columns, self.schema = spark, path, rows.columns, _ddl(rows)
        if start is not None:
            rows, mode = start.select(*self.columns), "overwrite"
        else:
            mode = "ignore"
        rows.write.mode(mode).partitionBy("sector_id").parquet(f"{path}/batch_id=-1")

    def current(self, before: int | None = None) -> DataFrame:
        """Rows of all sites, as they were ahead of batch ``before`` if one is given."""
        versions = self.spark.read.schema(self.schema + ", batch_id bigint").parquet(self.path)
        if before is not None:
            versions = versions.filter(F.col("batch_id") < before)
        newest = versions.groupBy("sector_id").agg(F.max("batch_id").alias("batch_id"))
        return versions.join(newest, ["sector_id", "batch_id"]).select(*self.columns)

    def upsert(self, folded: DataFrame, batch_id: int) -> DataFrame:
        """Takes a batch of folded detections in and returns those of sites that were not stored before."""
        touched = folded.select("sector_id").distinct()
        old = self.current(before=batch_id).join(touched, "sector_id", "left_semi")
        new = folded.select(*KEY, F.struct("first.*", "last.*", F.lit(batch_id).cast("long").alias("first_batch")).alias("n"))
        both = old.select(*KEY, F.struct(*[c for c in self.columns if c not in KEY]).alias("o")).join(new, KEY, "full_outer")
        stored, seen = F.col("o").isNotNull(), F.col("n").isNotNull()
        pick = [F.when(seen if c in MEASURES else ~stored, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.columns if c not in KEY]
        rows = both.select(*KEY, *pick).hint("rebalance", "sector_id")
        rows.write.mode("overwrite").partitionBy("sector_id").parquet(f"{self.path}/batch_id={batch_id}")
        return folded.join(old.select(*KEY), KEY, "left_anti")


def run_available(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, then stop: one timer run of a job."""
    q = (stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---- scene pairs of jobs ------------------------------------------------------------------------------------


def job_scene_pairs(jobs: DataFrame, scenes: DataFrame, run_date: str, area: str = "sector_id") -> DataFrame:
    """Per active job the two newest scenes of its look-back window, or the insufficient-imagery error.

    Jobs that share area and window share the work: scenes meet distinct windows, not jobs.
    """
    active = jobs.filter("is_active")
    end = F.lit(run_date).cast("date")
    windows = active.select(area, "lookback_days").distinct()
    seen = scenes.join(windows, area).filter(
        (F.col("ts") >= F.date_sub(end, F.col("lookback_days")).cast("timestamp")) & (F.col("ts") < F.date_add(end, 1).cast("timestamp")))
    top = newest_scenes(seen, [area, "lookback_days"], 2)
    pair = top.groupBy(area, "lookback_days").agg(
        F.max(F.when(F.col("rank") == 1, F.col("scene_id"))).alias("scene_t1"),
        F.max(F.when(F.col("rank") == 2, F.col("scene_id"))).alias("scene_t0"))
    out = active.join(pair, [area, "lookback_days"], "left")
    return out.withColumn("last_error", F.when(F.col("scene_t0").isNull() | F.col("scene_t1").isNull(), F.lit(NO_IMAGERY)))


# ---- upsert ------------------------------------------------------------------------------------------------------


def fold_batch(detections: DataFrame, order: list[str]) -> DataFrame:
    """One change row per site of a batch: measures of its last detection, the rest from its first."""
    fixed = [c for c in detections.columns if c not in (*KEY, *MEASURES)]
    o = F.struct(*order)
    return detections.groupBy(*KEY).agg(
        F.min_by(F.struct(*fixed), o).alias("first"),
        F.min_by(F.struct(*MEASURES), o).alias("opening"),
        F.max_by(F.struct(*MEASURES), o).alias("last"))


def jobs_by_threshold(jobs: DataFrame) -> DataFrame:
    """First active job per sector and threshold: the one credited with a new site. At most one row per
    distinct threshold of a sector, however many jobs watch it."""
    return jobs.filter("is_active").groupBy("sector_id", "confidence_threshold").agg(F.min("job_id").alias("job_id"))


def wanted_detections(detections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Detections that at least one active job of the sector accepts."""
    lowest = jobs.filter("is_active").groupBy("sector_id").agg(F.min("confidence_threshold").alias("_t"))
    return detections.join(lowest, "sector_id").filter(F.col("confidence") >= F.col("_t")).drop("_t")


class Monitor:
    """Batch function of the monitoring stream and the tables it keeps.

    ``prepare`` turns a raw micro-batch into detections. With ``dedupe_id`` the detections of a batch are suppressed by IoU
    within a sector before anything else. With ``scenes`` a job without a scene pair in its window takes no detections in.
    ``start`` is a compacted site table to begin with.
    """

    def __init__(self, spark: SparkSession, root: str, jobs: DataFrame, detections_schema: DataFrame, order: list[str],
                 prepare: Callable[[DataFrame], DataFrame], scenes: DataFrame | None = None, dedupe_id: str | None = None,
                 ring: str | None = None, run_date: str | None = None, start: DataFrame | None = None):
        self.spark, self.jobs, self.order, self.prepare = spark, jobs, order, prepare
        self.scenes, self.dedupe_id, self.ring, self.run_date = scenes, dedupe_id, ring, run_date
        nothing = fold_batch(detections_schema.limit(0), order)
        self.table = SiteTable(spark, root + "/sites", nothing, start)
        self.alert_log = BatchLog.create(spark, root + "/alerts", self._alerts(self._credited(nothing, jobs)))
        self.run_log = BatchLog.create(spark, root + "/runs", self._runs(detections_schema.limit(0), nothing, jobs).limit(0))

    def _checked_jobs(self) -> DataFrame:
        """Active jobs with ``last_error``, which is null where there is a scene pair or no catalogue to ask."""
        if self.scenes is None:
            return self.jobs.filter("is_active").withColumn("last_error", F.lit(None).cast("string"))
        return job_scene_pairs(self.jobs, self.scenes, self.run_date)

    def _credited(self, fresh: DataFrame, jobs: DataFrame) -> DataFrame:
        new = fresh.select(*KEY, "opening.*")
        credit = new.join(jobs_by_threshold(jobs), "sector_id").filter(F.col("confidence") >= F.col("confidence_threshold"))
        return credit.groupBy(*KEY, *MEASURES).agg(F.min("job_id").alias("job_id"))

    def _alerts(self, credited: DataFrame) -> DataFrame:
        out = summaries.alert_rollup(credited, ["job_id", "sector_id"])
        return out.withColumn("message", F.concat(F.lit("Scheduled analysis detected "), F.col("sites_count").cast("string"), F.lit(" new sites")))

    def _run_time(self, batch: DataFrame) -> Column:
        return F.lit(batch.agg(F.max("ts")).first()[0]).cast("timestamp")

    def _runs(self, batch: DataFrame, credited: DataFrame, checked: DataFrame) -> DataFrame:
        if "last_error" not in checked.columns:
            checked = checked.withColumn("last_error", F.lit(None).cast("string"))
        if "job_id" in credited.columns:
            n = credited.groupBy("job_id").agg(F.count("*").alias("new_sites"))
        else:
            n = self.jobs.limit(0).select("job_id", F.lit(0).cast("long").alias("new_sites"))
        out = checked.select("job_id", "last_error").join(n, "job_id", "left")
        return out.select("job_id", self._run_time(batch).alias("run_ts"), "last_error", F.coalesce("new_sites", F.lit(0)).cast("long").alias("new_sites"))

    def process(self, raw: DataFrame, batch_id: int) -> None:
        batch = self.prepare(raw).persist()
        checked = stage(self._checked_jobs(), "checked-jobs")
        try:
            ready = checked.filter("last_error IS NULL")
            found = wanted_detections(batch, ready)
            if self.dedupe_id:
                found = overlap.suppress(found, self.dedupe_id, ["sector_id"], ring=self.ring)
            folded = stage(fold_batch(found, self.order), "folded")
            credited = stage(self._credited(self.table.upsert(folded, batch_id), ready), "credited")
            self.alert_log.write(self._alerts(credited), batch_id)
            self.run_log.write(self._runs(batch, credited, checked), batch_id)
            discard(folded, credited)
        finally:
            batch.unpersist()
            discard(checked)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        run_available(stream, self.process, checkpoint)

    def sites(self) -> DataFrame:
        return self.table.current().drop("first_batch")

    def alerts(self) -> DataFrame:
        return self.alert_log.read().withColumn("alert_id", F.format_string("ALT-%s-%s", F.col("job_id"), F.col("batch_id")))

    def job_state(self) -> DataFrame:
        """Bookkeeping of every job that ran: last run, number of runs, error of the last run."""
        return self.run_log.read().groupBy("job_id").agg(
            F.max("run_ts").alias("last_run"), F.count("*").alias("run_count"), F.max_by("last_error", "batch_id").alias("last_error"),
            F.sum("new_sites").alias("new_sites"))

    def compact(self, path: str) -> DataFrame:
        """Write the current sites alone; a later monitor takes them as ``start``."""
        rows = self.table.current().withColumn("first_batch", F.lit(-1).cast("long"))
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def payloads(self) -> DataFrame:
        """Message payloads of the severe sites of the current state, one message for each sector that has an alert."""
        alerted = self.alert_log.read().select("sector_id").distinct()
        return exports.alert_payloads(self.sites().join(alerted, "sector_id", "left_semi"), ["sector_id"])


# ---- first seen -----------------------------------------------------------------------------------------------------


def first_seen(stream: DataFrame, delay: str, keys: list[str] | None = None) -> DataFrame:
    """A key passes once per watermark delay; its state is dropped afterwards."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys or KEY)


# ---- alert transitions -------------------------------------------------------------------------------------------------


def fold_transitions(events: DataFrame, order: list[str]) -> DataFrame:
    """Status of each alert after all its events, with the time each state was last entered."""
    o = F.struct(*order)
    stamp = lambda s, name: F.max(F.when(F.col("status") == s, F.col("ts"))).alias(name)
    return events.groupBy("alert_id").agg(
        F.max_by("status", o).alias("status"), stamp("acknowledged", "acknowledged_at"), stamp("resolved", "resolved_at"),
        stamp("dismissed", "dismissed_at"), F.max("ts").alias("updated_at"), F.max(o).alias("last"))


def merge_transitions(partials: DataFrame) -> DataFrame:
    """Combine the folds of several batches."""
    later = [F.max(c).alias(c) for c in ("acknowledged_at", "resolved_at", "dismissed_at", "updated_at")]
    return partials.groupBy("alert_id").agg(F.max_by("status", "last").alias("status"), *later)


def stream_transitions(stream: DataFrame, prepare, order: list[str], root: str, checkpoint: str) -> DataFrame:
    """Run the transition stream over what has arrived and return the alert states."""
    spark = stream.sparkSession
    empty = fold_transitions(prepare(spark.createDataFrame([], stream.schema)), order)
    log = BatchLog.create(spark, root + "/transitions", empty)
    run_available(stream, lambda df, i: log.write(fold_transitions(prepare(df), order), i), checkpoint)
    return merge_transitions(log.read())


# ---- scheduled windows ---------------------------------------------------------------------------------------------------


def windowed_counts(df: DataFrame, width: str, slide: str | None = None, by: list[str] | None = None, lateness: str | None = None) -> DataFrame:
    """Detections and area per time window; ``lateness`` bounds the state of a stream."""
    if lateness:
        df = df.withWatermark("ts", lateness)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = df.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum("area_m2").alias("area_m2"))
    return out.select(F.col("w.start").alias("window_start"), *(by or []), "n", "area_m2")


def stream_windows(counts: DataFrame, root: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run a windowed aggregation in update mode; the newest version of each window is its value."""
    spark = counts.sparkSession
    log = BatchLog.create(spark, root + "/windows", spark.createDataFrame([], counts.schema))
    run_available(counts, lambda df, i: log.write(df, i), checkpoint, "update")
    rest = [c for c in counts.columns if c not in keys]
    return log.read().groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def fresh_dirs(spark: SparkSession, label: str) -> tuple[str, str]:
    """(state folder, checkpoint folder) of a one-off run below the shared root."""
    base = run_dir(spark, label)
    return base + "/state", base + "/checkpoint"
