"""What the operators of this package share: reading, staging and internal column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, run_dir  # noqa: F401

#: Internal columns start with this, so that columns of the caller's table cannot clash with them.
OWN = "_gs_llm_"

#: A word is a longest run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that ends inside are deleted at its end instead of when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = run_dir(spark, f"llm-{label}")
    with released_shuffles(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def raw(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, null read as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def words(text: Column) -> Column:
    """Words of a text as an array, null read as empty."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"({WORD})"), F.lit(1))
