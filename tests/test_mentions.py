"""The substring join against brute force."""

import random

import pytest

from knotmeter.operators.mentions import contains_pairs, needle_index


def brute_force(texts, needles):
    out = set()
    for project, key, body in texts:
        for owner, needle in needles:
            if owner == project and project is not None and body and needle and needle in body:
                at = body.rindex(needle)
                begin, end = body.rfind("\n", 0, at) + 1, body.find("\n", at + len(needle))
                code = body[begin: end if end >= 0 else len(body)].strip(" ")
                out.add((project, key, needle, body.count("\n", 0, at) + 1, code))
    return out


def found(spark, texts, needles, **options):
    got = contains_pairs(
        spark.createDataFrame(texts, "project_id string, key int, content string"),
        spark.createDataFrame(needles, "project_id string, needle string"), **options,
    )
    rows = [(r.project_id, r.key, r.needle, r.last_line, r.last_code) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows), got


@pytest.mark.parametrize(("alphabet", "slice_bytes"), [("ab.é_/ \n😀", 1 << 25), ("ab.é_/ \n😀", 500), ("abc\n", 1 << 25), ("😀😁퟿é]^\\-[\n", 2000)])
def test_against_brute_force(spark, alphabet, slice_bytes):
    rng = random.Random(7)
    texts = [
        (f"p{i % 3}", i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400))))
        for i in range(60)
    ] + [("p0", 100, None), (None, 101, "ab.a")]
    needles = {
        (f"p{i % 4}", "".join(rng.choice(alphabet.replace("\n", "")) for _ in range(rng.randrange(0, 8))))
        for i in range(120)
    } | {(None, "ab.a"), ("p0", None)}
    # whole texts, heads and tails are found as well
    needles |= {("p1", t[2][:9].replace("\n", "")) for t in texts[:3]} | {(t[0], t[2][-5:]) for t in texts[:6]}
    needles = sorted(needles, key=str)
    rows, _ = found(spark, texts, needles, slice_bytes=slice_bytes)
    assert rows == brute_force(texts, needles)


def test_many_needles_in_one_project(spark):
    """Ten thousand needles with a common stem: each has its own key, whatever the number."""
    needles = [("p", f"model_{i}.pkl") for i in range(10_000)] + [("q", "model_5.pkl")]
    rng = random.Random(3)
    texts = [
        ("p", i, "\n".join(f"load('model_{rng.randrange(12_000)}.pkl') # the model" for _ in range(20)))
        for i in range(50)
    ] + [("q", 99, "model_5.pkl"), ("p", 98, "model_ .pkl")]
    rows, got = found(spark, texts, needles)
    wanted = {
        (p, k, f"model_{n}.pkl") for p, k, body in texts for n in {int(w.split(".")[0]) for w in body.split("model_")[1:] if w[0].isdigit()}
        if (p == "p" and n < 10_000) or (p == "q" and n == 5)
    }
    assert {r[:3] for r in rows if r[1] < 98 or r[1] == 99} >= wanted
    assert rows == brute_force(texts, needles)
    # one plan for every size: texts are exploded beside a broadcast index, without Python and without an exchange of texts
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "InPandas" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "content" in line]
    keys = needle_index(spark.createDataFrame(needles, "project_id string, needle string"), "project_id")
    sizes = [r["count"] for r in keys.groupBy("project_id", "key").count().collect()]
    assert sum(sizes) == len(needles) and max(sizes) <= 20


def test_slices_are_as_many_as_the_index_needs(spark):
    needles = [("p", f"needle {i}") for i in range(300)]
    texts = [("p", i, f"x needle {i} y") for i in range(300)]
    rows, got = found(spark, texts, needles, slice_bytes=4000)
    assert rows == brute_force(texts, needles)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 5


def test_without_needles(spark):
    assert found(spark, [("p", 1, "text")], [("p", ""), ("q", "text")])[0] == set()
    assert found(spark, [], [("p", "text")])[0] == set()
