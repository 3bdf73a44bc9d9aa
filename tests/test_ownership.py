"""Which directories own a row, against a prefix test, and how the rows of a large project are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from knotmeter.operators.services import ROOT_SALTS, files_below, owner_keys, with_owners

ROWS = "project_id string, dir string, n int"
OWNERS = "project_id string, path string, name string"


def by_prefix(rows, owners):
    return sorted(
        (p, d, n, path, name) for p, d, n in rows for q, path, name in owners
        if p == q and (path in (".", d) or d.startswith(path + "/"))
    )


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    dirs = [".", "a", "a/b", "a/b/c", "ab", "ab/c", "b", "é/ü", "a b/c", "a/b c", "x/y/z/w/v"]
    rows = [(f"p{rng.randrange(6)}", rng.choice(dirs), i) for i in range(300)]
    rows += [(None, "a", 1000), ("p1", None, 1001)] + rows[:5]
    owners = sorted({(f"p{rng.randrange(5)}", rng.choice(dirs), "o") for _ in range(30)})
    return rows, [(p, d, f"{p}:{d}") for p, d, _ in owners]


def test_owners_against_prefixes(spark, cases):
    rows, owners = cases
    assert any(path == "." for _, path, _ in owners) and len({p for p, path, _ in owners if path == "."}) < 5
    got = with_owners(spark.createDataFrame(rows, ROWS), spark.createDataFrame(owners, OWNERS), "name").collect()
    found = sorted((r["project_id"], r["dir"], r["n"], r["owner_path"], r["name"]) for r in got)
    assert found == by_prefix([r for r in rows if r[0] and r[1]], owners)


def test_files_join_by_directory(spark, cases):
    rows, owners = cases
    got = files_below(spark.createDataFrame(rows, ROWS), spark.createDataFrame(owners, OWNERS), "name").collect()
    found = sorted((r["project_id"], r["dir"], r["n"], r["owner_path"], r["name"]) for r in got)
    assert found == by_prefix([r for r in rows if r[0] and r[1]], owners)


@pytest.mark.parametrize("rooted", [False, True])
def test_rows_of_a_large_project_are_dealt_out(spark, rooted):
    """Nine rows of ten are one project's."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("p"), F.col("id") % 7)).otherwise("huge").alias("project_id"),
        F.concat(F.lit("svc"), F.col("id") % 900, F.lit("/src")).alias("dir"), F.col("id").alias("n"),
    )
    owners = [("huge", f"svc{i}", "s") for i in range(900)] + [("p1", ".", "r"), ("p1", "svc7", "s")] + [("huge", ".", "r")] * rooted
    keys = owner_keys(rows, spark.createDataFrame(owners, OWNERS))
    at_root = keys.where("owner_path = '.'").groupBy("project_id").count().collect()
    assert {r["project_id"] for r in at_root} == {"p1"} | ({"huge"} if rooted else set())
    largest = keys.groupBy("project_id", "owner_path", "owner_salt").count().agg(F.max("count")).first()[0]
    assert largest < 2 * 18_000 / ROOT_SALTS
    owned = with_owners(rows, spark.createDataFrame(owners, OWNERS), "name")
    in_p1 = rows.where("project_id = 'p1'").count() + rows.where("project_id = 'p1' AND dir = 'svc7/src'").count()
    assert owned.count() == 18_000 * (1 + rooted) + in_p1


def test_no_owners(spark, cases):
    assert with_owners(spark.createDataFrame(cases[0], ROWS), spark.createDataFrame([], OWNERS), "name").count() == 0
    assert with_owners(spark.createDataFrame([], ROWS), spark.createDataFrame(cases[1], OWNERS), "name").count() == 0
