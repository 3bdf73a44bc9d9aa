"""Thresholds, empty denominators and infinity."""

import pytest
from pyspark.sql import functions as F

from knotmeter.operators import reports, scores

BASE = dict(
    project_id="p", services_count=4, direct_count=0, direct_ratio=0.0, shared_count=0,
    pipelines_count=0, complex_pipelines=0, retrain_count=0, models_count=0, avg_impact=0.0,
    loops_count=0, glue_ratio=0.0, hidden_count=0, commit_count=0, bug_rate=0.0,
    avg_change_impact=0.0, top5_changes=0, top20_changes=0, mes_raw=0.0, mes_score=0.0,
)


def rows(spark, *changes):
    return spark.createDataFrame([{**BASE, **c} for c in changes], schema=", ".join(
        f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}"
        for k, v in BASE.items()))


@pytest.mark.parametrize("raw,level", [
    (3.0, "LOW"), (3.01, "MODERATE"), (7.0, "MODERATE"), (7.01, "CRITICAL")])
def test_levels_are_closed_above(spark, raw, level):
    assert scores.mes_level(rows(spark, {"mes_raw": raw})).first()["mes_level"] == level


def test_components_without_denominators(spark):
    row = scores.score_mes(rows(spark, {"services_count": 0, "loops_count": 3})).first()
    assert [row[c] for c in scores.COMPONENTS] == [0.0] * 6
    assert row["mes_score"] == 0


@pytest.mark.parametrize("change,score", [
    ({"commit_count": 500}, 10), ({"commit_count": 501}, 9), ({"commit_count": 1000}, 9),
    ({"commit_count": 1001}, 8), ({"bug_rate": 0.1}, 10), ({"bug_rate": 0.11}, 9),
    ({"bug_rate": 0.2}, 9), ({"bug_rate": 0.21}, 8), ({"bug_rate": 0.3}, 8),
    ({"bug_rate": 0.31}, 7), ({"avg_change_impact": 5.0}, 10), ({"avg_change_impact": 5.1}, 9),
    ({"avg_change_impact": 10.1}, 8), ({"top5_changes": 5, "top20_changes": 10}, 10),
    ({"top5_changes": 6, "top20_changes": 10}, 9)])
def test_maintainability_steps(spark, change, score):
    row = scores.maintainability_score(rows(spark, change)).first()
    assert row["maintainability_score"] == score
    assert len(row["maintainability_factors"]) == (0 if score == 10 else 1)


def test_degradation_is_infinite_at_zero(spark):
    df = rows(spark, {}).withColumns(
        {c: F.lit(None).cast("double") for c in ("isolated_mean", "non_isolated_mean")})
    row = scores.degradation_ratio(df).first()
    assert row["degradation_ratio"] == float("inf") and row["hypothesis_confirmed"]


def test_rounding_is_half_even(spark):
    row = scores.mes_score(rows(spark, {}).withColumns(
        {k: F.lit(0.0) for k in scores.COMPONENTS}).withColumn("direct_calls", F.lit(0.05))).first()
    assert row["mes_raw"] == pytest.approx(0.125) and row["mes_score"] == 0.12


@pytest.mark.parametrize("change,critical,warning", [
    ({"direct_ratio": 0.3, "direct_count": 1}, 0, 1), ({"direct_ratio": 0.31, "direct_count": 1}, 1, 0),
    ({"glue_ratio": 0.2}, 0, 0), ({"glue_ratio": 0.25}, 0, 1), ({"glue_ratio": 0.31}, 1, 0),
    ({"hidden_count": 3}, 0, 1), ({"hidden_count": 4}, 1, 0), ({"retrain_count": 4}, 0, 0),
    ({"retrain_count": 5}, 0, 1), ({"complex_pipelines": 3}, 0, 3), ({"loops_count": 1}, 0, 1)])
def test_smell_summary(spark, change, critical, warning):
    row = scores.smell_summary(rows(spark, change)).first()
    assert (row["critical_smells"], row["warning_smells"]) == (critical, warning)


def test_risks_are_ordered_by_value(spark):
    df = rows(spark, {}).withColumns({
        k: F.lit(v) for k, v in zip(scores.COMPONENTS, (0.4, 0.5, 0.71, 0.7, 1.0, 0.5))})
    got = [(r["component"], r["severity"]) for r in scores.risk_factors(df).orderBy("rank").collect()]
    assert got == [("impact_radius", "HIGH"), ("pipeline_complexity", "HIGH"),
                   ("retrain_frequency", "MEDIUM"), ("shared_features", "MEDIUM"),
                   ("feedback_loop", "MEDIUM")]


def test_improvement_list_keeps_the_library_second(spark):
    df = rows(spark, {"direct_count": 1, "glue_ratio": 0.3, "models_count": 1}).withColumn(
        "first_services", F.array(F.struct(
            F.lit(1).alias("rn"), F.lit("api").alias("name"), F.lit("Go").alias("language"))))
    row = reports.architecture_proposal(df).first()
    assert row["improvements"][:3] == [
        "Introduce model serving layer to eliminate direct model calls",
        "Implement shared feature engineering library",
        "Decouple AI models from business logic"]
    assert [c["name"] for c in row["components"]] == [
        "API Gateway", "api", "Model Serving Layer", "Feature Store", "Observability Stack"]
    assert row["expected_mes_reduction"] == 3.0
    bare = reports.architecture_proposal(rows(spark, {"glue_ratio": 0.3}).withColumn(
        "first_services", F.lit(None).cast("array<struct<rn:int,name:string,language:string>>"))).first()
    assert bare["improvements"][1] == "Implement shared feature engineering library"
