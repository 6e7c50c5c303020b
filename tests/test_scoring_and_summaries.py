import math

import pytest
from pyspark.sql import functions as F

from groundshift.functions import formats, geometry, indices, scoring
from groundshift.operators import filters, relations, summaries

from . import golden


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(*r, golden.SECTOR_OF[r[0][:3]]) for r in golden.SITES]
    return spark.createDataFrame(rows, golden.COLUMNS + ["sector_id"])


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_known_summaries(sites):
    got = {r["sector_id"]: r for r in summaries.sector_summary(sites, ["sector_id"]).collect()}
    for sector, (n, area, tons, threat, waste, conf, risk) in golden.SUMMARIES.items():
        r = got[sector]
        assert (r["total_sites"], r["total_area_m2"], r["total_tonnage"]) == (n, area, tons)
        assert tuple(r["n_" + k.lower()] for k in ("Critical", "High", "Moderate", "Low")) == threat
        assert tuple(r["n_" + k] for k in summaries.SUMMARY_WASTE_TYPES) == waste
        assert (r["avg_confidence"], r["avg_risk_score"]) == (conf, risk)


def test_stored_levels_and_tonnage_follow_the_rules(sites):
    out = sites.select("threat_level", scoring.threat_level(F.col("risk_score")).alias("lvl"), "estimated_tonnage",
                       scoring.tonnage(F.col("area_m2"), F.col("waste_type")).alias("t")).collect()
    assert all(r["threat_level"] == r["lvl"] for r in out)
    assert all(abs(r["estimated_tonnage"] - r["t"]) < 0.011 for r in out)


def test_empty_input_gives_zeros(sites):
    r = summaries.sector_summary(sites.limit(0)).first()
    assert all(v == 0 for v in r.asDict().values())


def test_threshold_is_inclusive(sites):
    assert filters.by_confidence(sites, 0.892).filter("site_id = 'RTM-003'").count() == 1


@pytest.mark.parametrize("risk,level", [(25, "Moderate"), (24, "Low"), (50, "High"), (49, "Moderate"), (75, "Critical"), (74, "High")])
def test_level_edges(spark, risk, level):
    assert one(spark, v=scoring.threat_level(F.lit(risk)))["v"] == level


def test_risk_rounds_half_to_even(spark):
    # 0.3 * conf * 100 = 22.5 with no area and far water
    assert one(spark, v=scoring.risk_score(F.lit(0.0), F.lit(0.75), F.lit(10.0)))["v"] == 22


def test_impact_worked_example(spark):
    parts = scoring.impact(F.lit(1000.0), F.lit("hazardous"), F.lit(0.5), F.lit(2.0), F.lit("Netherlands"))
    r = one(spark, **parts)
    assert r["cleanup_cost_eur"] == pytest.approx(292500.0)
    assert r["legal_liability_eur"] == pytest.approx(877500.0)
    assert r["environmental_damage_eur_per_year"] == 75000.0
    assert r["total_exposure_eur"] == pytest.approx(1245000.0)


def test_unknown_rates_use_defaults(spark):
    r = one(spark, **scoring.impact(F.lit(10.0), F.lit("nonsense"), F.lit(5.0), F.lit(50.0), F.lit(None).cast("string")))
    assert (r["base_cleanup_rate"], r["jurisdiction_multiplier"]) == (25.0, 1.0)


def test_zero_denominators(spark):
    r = one(spark, a=indices.ndvi(F.lit(-1e-10), F.lit(0.0)), b=indices.backscatter_ratio(F.lit(3.0), F.lit(0.0)),
            c=indices.ndvi(F.lit(0.0), F.lit(0.0)), d=indices.ndvi(F.lit(5.0), F.lit(-1.0)))
    assert (r["a"], r["b"], r["c"], r["d"]) == (0.0, 1.0, 0.0, 1.0)


def test_worst_level_is_ordinal(spark):
    df = spark.createDataFrame([("j", "Moderate", 1.0), ("j", "High", 2.0)], "job string, threat_level string, area_m2 double")
    r = summaries.alert_rollup(df, ["job"]).first()
    assert (r["max_threat_level"], r["severity"], r["sites_count"]) == ("High", "critical", 2)


def test_text_forms(spark):
    r = one(spark, a=formats.fixed(F.lit(1234567.5), 0, True), b=formats.percent(F.lit(0.8235)), c=formats.or_na(F.lit(0.0), 2), d=formats.fixed(F.lit(0.5), 1))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("1,234,568", f"{0.8235 * 100:.1f}%", "N/A", "0.5")


def test_rounding_is_that_of_the_binary_value(spark):
    import random
    rng = random.Random(4)
    vals = [61.25, 2.675, 0.285, 0.155, 150.015, -0.125, 1e9 + 0.005] + [round(rng.uniform(0, 1e5), 3) for _ in range(3000)]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = df.select("v", formats.rounded(F.col("v"), 2).alias("a"), formats.rounded(F.col("v"), 1).alias("b")).collect()
    assert all(r["a"] == round(r["v"], 2) and r["b"] == round(r["v"], 1) for r in got)


def test_validation_keeps_reasons(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, "High", "mixed"), (2, 0.5, None, "Odd", "mixed"), (3, 0.5, 1.0, "Low", "other")],
                               "id int, confidence double, area_m2 double, threat_level string, waste_type string")
    got = {r["id"]: r["rejected_for"] for r in filters.validate(df, filters.site_rules()).collect()}
    assert got == {1: ["confidence"], 2: ["area_m2", "threat_level"], 3: []}


def test_parameter_checks():
    for bad in (lambda: filters.check_bbox([1, 2, 3]), lambda: filters.check_confidence(0.2), lambda: filters.check_member("status", "x", ("a",))):
        with pytest.raises(ValueError):
            bad()


def test_rules_fire_without_a_join(spark, sites):
    rules = [relations.AlertRule("all"), relations.AlertRule("r", 0.85, 300000.0, ("sector-7", "sector-4"))]
    got = {(r["site_id"], r["rule_id"]) for r in relations.fired_rules(sites, rules).collect()}
    exp = {(s[0], "all") for s in golden.SITES if s[2] >= 0.8 and s[1] >= 10000} | {
        (s[0], "r") for s in golden.SITES if s[2] >= 0.85 and s[1] >= 300000 and not s[0].startswith("AMZ")}
    assert got == exp


def test_areas_of_a_known_square(spark):
    ring = geometry.rectangle(F.lit(4.0), F.lit(51.0), F.lit(4.01), F.lit(51.01))
    r = one(spark, a=geometry.area_m2(ring), t=geometry.area_m2(ring, true_area=True), c=geometry.centroid(ring), p=geometry.area_m2_approx(ring),
            i=geometry.contains_point(ring, F.lit(4.005), F.lit(51.005)), o=geometry.contains_point(ring, F.lit(4.02), F.lit(51.005)))
    w = 6378137.0 * math.radians(0.01)
    y = lambda lat: 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    assert r["a"] == pytest.approx(w * (y(51.01) - y(51.0)), rel=1e-6)
    assert r["t"] == pytest.approx(r["p"], rel=0.01)
    assert r["c"] == pytest.approx([4.005, 51.005])
    assert r["i"] and not r["o"]


def test_growth_of_single_observation(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 500.0, 0.5)], "site string, d string, area_m2 double, confidence double").withColumn("date", F.to_date("d"))
    r = summaries.site_growth(df, ["site"]).first()
    assert (r["growth_m2_per_day"], r["current_status"], r["slope_m2_per_day"]) == (0.0, "inactive", None)
