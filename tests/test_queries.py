"""Registered queries against their SQL, and the shape of their plans."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF_SMALL

from knotmeter.plans.oracle import ORACLES
from knotmeter.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "inf" if math.isinf(x) else f"{x:.9g}"
        return f"{float(x):.9g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert cells(got.columns, got.collect()) == cells(columns, want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 20


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "direct_model_calls", "glue_code_by_service", "detect_endpoints", "service_dependencies",
    "impact_radius", "hidden_consumers", "shared_features", "detect_pipelines", "churn_lines",
    "bugs_by_model", "mes_report", "framework_evidence"])
def test_no_pairwise_joins(spark, name):
    plan = final_plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["top_changed_files", "extreme_files", "bug_prone_files"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in final_plan(QUERIES[name](spark, SF_SMALL))


def test_texts_stay_out_of_shuffles_and_metadata_scans(spark, tmp_path, corpus):
    from knotmeter.operators import features, inventory, services, smells

    corpus.write.parquet(str(tmp_path / "files"))
    tree = inventory.file_inventory(spark.read.parquet(str(tmp_path / "files")))
    found = services.detect_services(tree)
    assert "content" not in final_plan(found)
    calls = smells.direct_model_calls(features.file_features(tree), found)
    exchanges = [line for line in final_plan(calls).splitlines() if "Exchange" in line]
    assert exchanges and not any("content" in line for line in exchanges)


@pytest.mark.parametrize("name", ["pipeline_complexity", "pipeline_complexity_scanner"])
def test_contents_are_rewritten_once(spark, name):
    """Pipelines are found by name; only the features need the contents, which a generator rewrites."""
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # the rewriting stands in the generator twice: for package.json and for all else
    assert plan.count("import joblib") == 2
