"""Search, ranking and statistics over repository metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotmeter import rules


def search_repositories(
    repositories: DataFrame, query: str = "", topics: list[str] = (), max_results: int = 20,
    sort: str = "stars", order: str = "desc",
) -> DataFrame:
    """The first repositories matching the text and all topics, sorted."""
    if sort not in ("stars", "forks", "updated"):
        raise ValueError(f"unknown sort: {sort}")
    found = repositories
    if query:
        q = query.lower()
        found = found.where(
            F.lower("full_name").contains(q) | F.lower("description").contains(q)
        )
    for topic in topics:
        found = found.where(F.array_contains("topics", topic))
    key = F.col(sort).desc() if order == "desc" else F.col(sort).asc()
    return found.orderBy(key, "id").limit(max_results)


def ranked_repositories(
    repositories: DataFrame, topics: list[str] = rules.ML_TOPICS, max_results: int = 20,
    share: int | None = None,
) -> DataFrame:
    """Each repository once, by the first topic that lists it; then the most starred overall.

    With ``share``, a topic lists only so many of its most starred repositories.
    """
    order = F.create_map(*[F.lit(x) for i, t in enumerate(topics) for x in (t, i)])
    # topics of one repository are few, so this explode stays small
    per_topic = repositories.select(
        "*", F.explode(F.array_intersect("topics", F.array(*[F.lit(t) for t in topics]))).alias("topic")
    )
    top = Window.partitionBy("topic").orderBy(F.col("stars").desc(), "id")
    once = Window.partitionBy("id").orderBy("topic_order")
    return (
        (per_topic if share is None else per_topic.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= share))
        .withColumn("topic_order", order[F.col("topic")])
        .withColumn("k", F.row_number().over(once)).where(F.col("k") == 1)
        .drop("rn", "k", "topic_order")
        .orderBy(F.col("stars").desc(), "id").limit(max_results)
    )


def language_byte_share(languages: DataFrame) -> DataFrame:
    """Share of bytes per (id, language), one digit."""
    totals = languages.groupBy("id").agg(F.sum("bytes").alias("total"))
    grouped = languages.groupBy("id", "language").agg(F.sum("bytes").alias("bytes"))
    return grouped.join(totals, "id").select(
        "id", "language", "bytes",
        F.bround(F.try_divide(F.col("bytes"), F.col("total")) * 100, 1).alias("percentage"),
    )


def languages_of(repositories: DataFrame) -> DataFrame:
    return repositories.select("id", F.explode("languages").alias("language", "bytes"))


def top_contributors(contributions: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col("contributions").desc(), "login")
    return contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_releases(releases: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col("published").desc(), "tag")
    return releases.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
