"""Export of sites in the formats users ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.filters import check_member, for_export
from ..sinks import exports


def export_sites(sites: DataFrame, fmt: str, path: str, min_confidence: float = 0.0, bbox=None, date_range=None, generated: str | None = None) -> None:
    """Filter and write as ``geojson`` (feature lines), ``csv`` or ``pdf`` (the report's tables)."""
    check_member("format", fmt, exports.FORMATS)
    if fmt == "geojson":
        exports.write_geojson(sites, path, min_confidence, bbox, date_range, generated)
    elif fmt == "csv":
        exports.write_csv(sites, path, min_confidence, bbox, date_range)
    else:
        kept = for_export(sites, min_confidence, bbox, date_range)
        exports.report_rows(kept).write.parquet(path + "/rows")
        exports.report_summary(kept).write.parquet(path + "/summary")
