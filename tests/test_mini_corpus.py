"""Hand-derived results on a small literal project."""

import pytest

from knotmeter.operators import (
    endpoints, frameworks, inventory, models, scores, services, smells,
)
from knotmeter.plans import tiers
from knotmeter.sources import manifests


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_inventory_and_languages(facts):
    tree = facts.inventory
    assert tree.where("NOT ignored").count() == 9
    assert pairs(inventory.language_counts(tree), "language", "files") == [
        ("JavaScript", 2), ("Python", 5)]
    assert inventory.primary_language(tree).first()["language"] == "Python"


def test_services(facts):
    assert pairs(facts.services, "name", "path", "language") == [
        ("p1", ".", "Python"), ("svc_a", "svc_a", "Python"),
        ("svc_b", "svc_b", "JavaScript/Node.js")]


def test_models(facts):
    assert pairs(facts.models, "name", "path", "detected_by") == [
        ("fraud.pkl", "svc_a/app.py", "code_reference"),
        ("fraud.pkl", "svc_a/fraud.pkl", "file_extension")]


def test_pipelines(facts):
    rows = services.pipeline_complexity(facts.pipelines, facts.features).collect()
    assert [(r["path"], r["stages"], r["branching_factor"], r["is_complex"]) for r in rows] == [
        ("svc_b/train", 1, 3.0, True)]


def test_endpoints(facts):
    assert pairs(facts.endpoints, "service", "framework", "method", "path") == [
        ("p1", "fastapi", "GET", "/score"), ("p1", "flask", "GET", "/a"),
        ("p1", "flask", "GET", "/score"), ("svc_a", "fastapi", "GET", "/score"),
        ("svc_a", "flask", "GET", "/score"), ("svc_b", "express", "GET", "/b")]


def test_dependencies(facts):
    assert pairs(facts.dependencies, "source", "target") == [
        ("p1", "svc_a"), ("svc_b", "svc_a")]
    row = endpoints.key_counts(facts.services, facts.endpoints).first()
    assert (row["endpoint_count"], row["dependency_count"]) == (6, 3)


def test_direct_calls_and_glue(facts, corpus):
    calls = smells.direct_model_calls(facts.features, facts.services)
    assert pairs(calls, "service", "hits") == [("p1", 4), ("svc_a", 3), ("svc_b", 1)]
    glue = smells.glue_code_by_service(facts.features, facts.services)
    assert pairs(glue, "service", "total_lines") == [("p1", 19), ("svc_a", 6), ("svc_b", 9)]
    assert smells.glue_code_ratio(glue).first()["glue_ratio"] == pytest.approx(1 / 34)
    literal = tiers.Facts(corpus, "reference")
    zero = smells.glue_code_ratio(
        smells.glue_code_by_service(literal.features, literal.services))
    assert zero.first()["glue_ratio"] == 0


def test_call_details_are_the_first_hits(facts):
    rows = smells.direct_model_call_details(facts.inventory, facts.services).where(
        "service = 'svc_a'").orderBy("rank").collect()
    assert [(r["line"], r["pattern"], r["code"]) for r in rows] == [
        (3, "loading", "m = joblib.load('fraud.pkl')"),
        (3, "loading", "m = joblib.load('fraud.pkl')"),
        (5, "prediction", "y = m.predict(x)")]


def test_consumers(facts):
    actual = smells.actual_consumers(facts.mentions, facts.services)
    assert pairs(facts.declared, "model", "consumer") == [("fraud.pkl", "svc_a")]
    assert pairs(actual, "consumer") == [("p1",), ("svc_a",), ("svc_b",)]
    hidden = smells.hidden_consumers(actual, facts.declared)
    assert pairs(hidden, "consumer", "file", "line") == [
        ("p1", "svc_b/index.js", 3), ("svc_b", "index.js", 3)]
    impact = smells.impact_radius(facts.mentions, facts.services, facts.models)
    assert pairs(impact, "model", "impact_radius") == [("fraud.pkl", 3)]
    cells = smells.service_model_matrix(facts.mentions, facts.services)
    assert cells.count() == 3


def test_retraining_loops_and_shared_features(facts):
    assert pairs(smells.retrain_events(facts.features), "file", "reason") == [
        ("svc_b/train/train_job.py", "scheduled")]
    assert pairs(smells.feedback_loops(facts.features, facts.services), "service", "file") == [
        ("p1", "svc_a/app.py"), ("p1", "svc_b/train/train_job.py"), ("svc_a", "app.py"),
        ("svc_b", "train/train_job.py")]
    assert pairs(smells.shared_features(facts.features, facts.services), "module", "services") == [
        ("joblib", 3), ("sklearn", 2)]


def test_entanglement_score(facts):
    row = tiers.tier4(facts).first()
    got = [row[c] for c in scores.COMPONENTS]
    assert got == [1, 1, 1, 0.25, 1, 1]
    assert (row["mes_score"], row["mes_level"]) == (8.5, "CRITICAL")


def test_isolation_and_degradation(facts):
    judged = scores.violation_scores(scores.isolation_scores(tiers.service_profile(facts)))
    assert {(r["isolation_score"], r["violation_score"]) for r in judged.collect()} == {(5, 5)}
    means = scores.isolation_means(judged)
    row = scores.degradation_ratio(tiers.tier4(facts).join(means, "project_id")).first()
    assert (row["avg_isolated_mes"], row["avg_non_isolated_mes"]) == (5.0, 7.5)
    assert (row["degradation_ratio"], row["hypothesis_confirmed"]) == (1.5, False)


def test_manifests_and_frameworks(facts):
    tree = facts.inventory
    reqs = manifests.parse_requirements(tree)
    assert pairs(reqs, "path", "package") == [
        ("requirements.txt", "flask"), ("requirements.txt", "torch"),
        ("svc_a/requirements.txt", "flask"), ("svc_a/requirements.txt", "scikit-learn")]
    assert pairs(manifests.parse_package_json(tree), "package", "version") == [
        ("express", "^4"), ("jest", "^29")]
    assert pairs(manifests.dependency_manifests(tree), "dir", "type") == [
        (".", "pip"), ("svc_a", "pip"), ("svc_b", "npm")]
    found = frameworks.manifest_frameworks(tree)
    assert pairs(found, "framework") == [("express",), ("flask",), ("pytorch",), ("sklearn",)]


def test_scanner_references_attach_or_become_models(facts):
    merged = models.model_code_refs_merge(
        models.detect_model_files_scanner(facts.inventory),
        models.scanner_code_refs(facts.inventory))
    rows = merged.collect()
    assert [(r["name"], r["path"], r["consumer_file"], r["line"], r["inferred"]) for r in rows] == [
        ("fraud.pkl", "svc_a/fraud.pkl", "svc_a/app.py", 3, False)]


def test_many_projects_equal_single_runs(spark, corpus):
    from pyspark.sql import functions as F

    copies = corpus.unionByName(corpus.withColumn("project_id", F.lit("p2")))
    one = tiers.tier4(tiers.Facts(corpus)).drop("project_id").collect()
    two = tiers.tier4(tiers.Facts(copies.repartition(7))).drop("project_id").collect()
    assert two == one * 2


def test_full_analysis_without_history(spark, corpus):
    commits = spark.createDataFrame(
        [], "project_id string, commit_id string, author string, committed_at timestamp, message string")
    touched = spark.createDataFrame(
        [], "project_id string, commit_id string, path string, added bigint, deleted bigint")
    row = tiers.analyze(corpus, commits, touched, "2024-02-01").first()
    # nine kept files stand in for commits
    assert (row["commit_count"], row["top5_changes"], row["top20_changes"]) == (9, 5, 9)
    assert row["language"] == "Python" and row["accuracy_rate"] >= 70
