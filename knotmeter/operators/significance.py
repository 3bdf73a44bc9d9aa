"""Rank correlations over a fleet of projects, and how likely chance is to give them.

The p-values that belong to the definition of the validation tier are constants (``scores.significance``); these are
measured.  Ranks, sums and permutations are joins and groupings: no task holds the fleet.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.session import materialize, spread

#: The measure that is compared, and the ones that it is compared with.
FIRST, OTHERS = "mes_score", ["commit_count", "bug_rate", "avg_change_impact"]
PERMUTATIONS, SEED = 199, 11


def running_totals(df: DataFrame, by: list[str], weight: Column, name: str, group: list[str] | None = None) -> DataFrame:
    """Adds the sum of ``weight`` over the rows up to and with this one in the order of ``by``, in each group.

    Ranges of the order are dealt to tasks; each adds up its own, on top of the totals of the ranges before.  The join
    deals the rows as the sums need them, so nothing has to pass the driver.
    """
    group = group or []
    dealt = materialize(df.withColumn("_weight", weight).repartitionByRange(*group, *by).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*group, "_part").agg(F.sum("_weight").alias("_own")).withColumn(
        "_before", F.coalesce(F.sum("_own").over(before), F.lit(0))
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.join(parts.drop("_own").hint("merge"), [*group, "_part"])
        .withColumn(name, F.col("_before") + F.sum("_weight").over(inside)).drop("_weight", "_part", "_before")
    )


def centred_ranks(rows: DataFrame, measures: list[str]) -> tuple[DataFrame, int]:
    """``number`` and for each measure twice the rank less its mean, an integer; equal values share the mean of their ranks.

    Projects with a null measure or id take no part.  Numbers run from 0 in the order of project_id.
    """
    kept = rows.select("project_id", *[F.col(m).cast("double").alias(m) for m in measures]).dropna()
    numbered = materialize(running_totals(kept, ["project_id", *measures], F.lit(1).cast("bigint"), "upto").withColumn("number", F.col("upto") - 1))
    n = numbered.count()
    long = numbered.select("number", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])))
    counts = long.groupBy("measure", "value").agg(F.count("*").alias("n"))
    ranks = running_totals(counts, ["value"], F.col("n"), "upto", ["measure"]).select(
        "measure", "value", (2 * F.col("upto") - F.col("n") - n).alias("rank")
    )
    wide = [F.max(F.when(F.col("measure") == m, F.col("rank"))).alias(m) for m in measures]
    return materialize(long.join(ranks.hint("merge"), ["measure", "value"]).groupBy("number").agg(*wide)), n


def _whole(product: Column) -> Column:
    """Sums that stay exact for any number of projects: of the high and the low bits, each of which fit a long."""
    high, low = F.sum(F.shiftright(product, 31)), F.sum(product.bitwiseAND(F.lit((1 << 31) - 1)))
    return (high.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def rank_correlations(rows: DataFrame, first: str = FIRST, others: list[str] = OTHERS) -> DataFrame:
    """``measure, projects, rho``: Spearman's coefficient of ``first`` with each other; null where a measure is constant."""
    ranks, n = centred_ranks(rows, [first, *others])
    return _correlations(ranks, n, first, others).select("measure", "projects", "rho")


def _correlations(ranks: DataFrame, n: int, first: str, others: list[str]) -> DataFrame:
    sums = ranks.agg(
        _whole(F.col(first) * F.col(first)).alias("own"),
        *[_whole(F.col(m) * F.col(m)).alias(f"square_{i}") for i, m in enumerate(others)],
        *[_whole(F.col(first) * F.col(m)).alias(f"product_{i}") for i, m in enumerate(others)],
    )
    entries = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"square_{i}").alias("square"), F.col(f"product_{i}").alias("product"))
        for i, m in enumerate(others)
    ])
    rho = F.try_divide(F.col("product").cast("double"), F.sqrt(F.col("own").cast("double")) * F.sqrt(F.col("square").cast("double")))
    return sums.select("own", F.inline(entries)).select("measure", F.lit(n).cast("bigint").alias("projects"), rho.alias("rho"), "product")


def _is_prime(x: int) -> bool:
    return x > 1 and all(x % d for d in range(2, int(x**0.5) + 1))


def shuffles(count: int, seed: int) -> list[tuple[int, int]]:
    """Seeded maps j -> (a * j + c) mod n.  The factors are primes above 2^31, so each map is a permutation for every n below."""
    rng = random.Random(seed)
    out = []
    while len(out) < count:
        a = rng.randrange(1 << 31, 1 << 32) | 1
        if _is_prime(a):
            out.append((a, rng.randrange(1 << 31)))
    return out


def permutation_p_values(
    rows: DataFrame, first: str = FIRST, others: list[str] = OTHERS, permutations: int = PERMUTATIONS, seed: int = SEED
) -> DataFrame:
    """``measure, projects, rho, p_value``: the share of permutations, this one included, that correlate at least as much.

    The permutations are drawn from a group of maps of the project numbers, which gives a valid test; they are
    ``permutations`` literals in the plan.  Every project meets its partner of each permutation in a join on the number,
    for which both sides are shuffled: a table of the fleet is never sent to the driver.  A fleet of 2^31 projects or more is refused.
    """
    ranks, n = centred_ranks(rows, [first, *others])
    if n >= 1 << 31:
        raise ValueError("too many projects for the permutations")
    maps = F.array(*[F.struct(F.lit(i).alias("map"), F.lit(a % max(n, 1)).alias("a"), F.lit(c % max(n, 1)).alias("c")) for i, (a, c) in enumerate(shuffles(permutations, seed))])
    partner = F.pmod(F.col("a") * F.col("own_number") + F.col("c"), F.lit(n))
    moved = spread(ranks).select(F.col("number").alias("own_number"), F.col(first).alias("own"), F.inline(maps)).select(
        "map", "own", partner.cast("bigint").alias("number")
    )
    products = moved.join(ranks.drop(first).hint("shuffle_hash"), "number").groupBy("map").agg(
        *[_whole(F.col("own") * F.col(m)).alias(m) for m in others]
    )
    drawn = products.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("drawn")) for m in others])))
    found = _correlations(ranks, n, first, others)
    reached = F.count_if(F.abs("drawn") >= F.abs("product"))
    return found.join(drawn.hint("merge"), "measure", "left").groupBy("measure", "projects", "rho").agg(
        ((reached + 1) / (permutations + 1)).alias("p_value")
    )
