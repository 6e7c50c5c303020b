"""Session settings, the shared staging folder and size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "groundshift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC clock, AQE with skew handling)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session, or what ``setCheckpointDir`` was given."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return root.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared root."""
    return f"{shared_root(spark)}/groundshift/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and gives the planner the real byte
    size of the result, so joins against it are broadcast only while they fit the session's
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that nothing will read again. Other frames are left alone."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", label: str = "lookup") -> DataFrame:
    """Join a derived per-key summary onto a large table.

    The summary is staged first: below the broadcast threshold the large side is not shuffled at all,
    above it the join is a shuffled one, whose hot keys adaptive execution splits.
    """
    return big.join(stage(small, label), on, how)
