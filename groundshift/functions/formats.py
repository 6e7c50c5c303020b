"""Text forms used by exports, reports and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int, grouped: bool = False) -> Column:
    """Fixed-point text, half-even on the binary value; ``grouped`` adds thousands separators."""
    head = "#,##0" if grouped else "0"
    pattern = head + ("." + "0" * places if places else "")
    return F.call_function("format_number", x, F.lit(pattern))


def rounded(x: Column, places: int) -> Column:
    """Round the binary value of a double correctly: half-even on a true tie, so 61.25 gives 61.2, while
    2.675, which is stored a little lower, gives 2.67. Spark's round and bround work on the decimal text instead."""
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))
    return F.when(finite, fixed(x, places)).otherwise(x.cast("string")).try_cast("double")


def percent(x: Column, places: int = 1) -> Column:
    return F.concat(fixed(x * 100.0, places), F.lit("%"))


def lat_lon(lat: Column, lon: Column, places: int = 5) -> Column:
    return F.concat_ws(", ", fixed(lat, places), fixed(lon, places))


def or_na(x: Column, places: int) -> Column:
    """Fixed-point text, or N/A where the measure is missing or zero."""
    return F.when(x.isNull() | (x == 0.0), F.lit("N/A")).otherwise(fixed(x, places))


def padded_id(prefix: Column, n: Column, width: int = 3) -> Column:
    return F.format_string(f"%s-%0{width}d", prefix, n)


def content_hash(cols: dict[str, Column], length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the columns as a JSON object with sorted names; nulls are written out."""
    body = F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, length)


def key_hash(prefix: str, cols: list[Column]) -> Column:
    """``prefix:`` plus the first 12 hex digits of the MD5 of the colon-joined arguments."""
    joined = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.concat(F.lit(prefix + ":"), F.substring(F.md5(joined), 1, 12))
