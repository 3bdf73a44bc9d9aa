"""Rank correlations and permutation p-values against the same figures by hand."""

import random

import numpy as np
import pandas as pd
import pytest

from knotmeter.operators import significance

OTHERS = ["up", "noise", "flat"]


def fleet(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = rng.randrange(12)
        rows.append((f"p{rng.randrange(10**6)}", float(x), x + rng.randrange(6), rng.choice([0.5, 0.5, 0.25, -1.0, 3e9]), 7))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "project_id string, mes double, up int, noise double, flat int, number int").repartition(5)


def by_hand(rows, permutations, seed):
    table = pd.DataFrame(rows, columns=["project_id", "mes", *OTHERS]).sort_values(["project_id", "mes", *OTHERS])
    ranks = table[["mes", *OTHERS]].rank()
    d = (2 * ranks - (len(table) + 1)).to_numpy().astype(int)
    n, out = len(table), {}
    for k, name in enumerate(OTHERS, 1):
        product = int(d[:, 0] @ d[:, k])
        rho = None if d[:, k].any() == 0 else float(np.corrcoef(ranks["mes"], ranks[name])[0, 1])
        drawn = [int(d[:, 0] @ d[[(a * j + c) % n for j in range(n)], k]) for a, c in significance.shuffles(permutations, seed)]
        out[name] = (n, rho, (sum(abs(x) >= abs(product) for x in drawn) + 1) / (permutations + 1))
    return out


@pytest.mark.parametrize(("n", "seed"), [(60, 1), (7, 2), (300, 3)])
def test_against_the_figures_by_hand(spark, n, seed):
    rows = fleet(n, seed)
    got = significance.permutation_p_values(frame(spark, rows), "mes", OTHERS, 49, 5).collect()
    want = by_hand(rows, 49, 5)
    assert {r["measure"] for r in got} == set(want) and len(got) == 3
    for r in got:
        projects, rho, p = want[r["measure"]]
        assert r["projects"] == projects and r["p_value"] == pytest.approx(p)
        assert r["rho"] == (None if rho is None else pytest.approx(rho))
    if n > 50:
        found = {r["measure"]: r["p_value"] for r in got}
        assert found["up"] == 0.02 and found["flat"] == 1.0
    plain = {r["measure"]: r["rho"] for r in significance.rank_correlations(frame(spark, rows), "mes", OTHERS).collect()}
    assert plain == {r["measure"]: r["rho"] for r in got}


def test_chance_is_seldom_significant(spark):
    """Of unrelated measures about one in twenty falls below 0.05."""
    low = 0
    for seed in range(12):
        rng = random.Random(100 + seed)
        rows = [(f"p{i}", rng.random(), rng.randrange(50), rng.random(), 1) for i in range(40)]
        low += sum(p < 0.05 for _, (_, _, p) in by_hand(rows, 99, seed).items())
    assert low <= 5


def test_nulls_and_small_fleets(spark):
    rows = fleet(30, 4)
    awkward = [*rows, ("x", None, 1, 1.0, 1), (None, 1.0, 1, 1.0, 1), ("y", 1.0, None, 1.0, 1), rows[0]]
    got = {r["measure"]: r["projects"] for r in significance.rank_correlations(frame(spark, awkward), "mes", OTHERS).collect()}
    assert got == dict.fromkeys(OTHERS, 31)
    for few in ([], rows[:1]):
        found = significance.permutation_p_values(frame(spark, few), "mes", OTHERS, 9, 5).collect()
        assert {(r["measure"], r["projects"], r["rho"], r["p_value"]) for r in found} == {(m, len(few), None, 1.0 if few else 0.1) for m in OTHERS}


def test_no_table_of_the_fleet_is_sent_to_the_driver(spark):
    out = significance.permutation_p_values(frame(spark, fleet(200, 6)), "mes", OTHERS, 9, 5)
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_sums_are_exact(spark):
    products = [(1 << 62) - 3, (1 << 62) - 5, (1 << 62) - 7, -(1 << 62) + 1, -1, 0]
    df = spark.createDataFrame([(x,) for x in products], "x bigint")
    assert int(df.agg(significance._whole(df["x"]).alias("x")).first()["x"]) == sum(products)
    assert df.where("x is null").agg(significance._whole(df["x"]).alias("x")).first()["x"] is None


def test_shuffles_are_permutations():
    for n in (1, 2, 10, 97, 1000):
        for a, c in significance.shuffles(9, 3):
            assert len({(a * j + c) % n for j in range(n)}) == n


def test_totals_run_over_all_tasks(spark):
    rows = [(i % 3, i * 7 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, x int, w int")
    for group, names in ((["g"], lambda r: r[0]), ([], lambda r: 0)):
        got = significance.running_totals(df, ["x"], df["w"], "upto", group).collect()
        totals, want = {}, {}
        for r in sorted(rows, key=lambda r: r[1]):
            totals[names(r)] = want[r[1]] = totals.get(names(r), 0) + r[2]
        assert {r["x"]: r["upto"] for r in got} == want and len(got) == 1000
