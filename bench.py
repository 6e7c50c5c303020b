"""Headline timings: warm session, median of three runs, every result row written to the noop sink.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from contract import catalog, q_streams  # noqa: E402
from contract.fixtures import Tables  # noqa: E402
from groundshift.functions import scoring  # noqa: E402
from groundshift.operators import summaries  # noqa: E402
from groundshift.session import build_session  # noqa: E402

Q = catalog.QUERIES


def score_summary(t):
    parts = scoring.impact(*[F.col(c) for c in ("area_m2", "waste_type", "distance_to_water_km", "distance_to_protected_km", "jurisdiction")])
    costed = t.scored.select("*", parts["total_exposure_eur"].alias("exposure"))
    by = summaries.sector_summary(costed, ["sector_id"])
    return by.join(costed.groupBy("sector_id").agg(F.sum("exposure").alias("exposure")), "sector_id")


def series_rollup(t):
    growth = summaries.site_growth(t.obs, ["site_no"])
    return growth.groupBy("current_status").agg(F.count("*").alias("n"), F.sum("total_area_m2").alias("area"))


BENCH = {
    "score_summary": score_summary,
    "series_rollup": series_rollup,
    "series_by_day": Q["agg_07"],
    "scene_pairs": Q["ts_12"],
    "ndvi_change": Q["ras_03"],
    "step_anomaly": Q["ts_08"],
    "radar_change": Q["ras_11"],
    "morphology": Q["ras_12"],
    "components": Q["ras_20"],
    "polygons": Q["ras_22"],
    "dedupe_iou": Q["ded_01"],
    "overlap_pairs": Q["join_07"],
    "monitor_stream": q_streams.monitored_sites,
    "tile_scoring": Q["ml_03"],
    "segmentation_metrics": Q["ml_05"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
                          **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="groundshift-")})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    rows = {n: Tables(spark, sf_dir).raw(n).count() for n in ("orders", "lineitem", "events", "embeddings")}
    timings = {}
    for name, fn in BENCH.items():
        if only and name not in only:
            continue
        runs = []
        for i in range(4):  # the first run warms the code paths
            t0 = time.perf_counter()
            fn(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": int(cpus), "input_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
