"""JSON exports: repository metadata, MLOps responses, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from knotmeter.operators import mlops

REPOSITORY_SCHEMA = (
    "id bigint, full_name string, description string, html_url string, clone_url string, "
    "stargazers_count bigint, forks_count bigint, language string, default_branch string, "
    "topics array<string>, owner struct<login:string,avatar_url:string>, "
    "languages map<string,bigint>, updated_at string"
)

MANIFEST_SCHEMA = (
    "platform string, endpoint string, collection_time string, items_collected map<string,bigint>, "
    "quarantined bigint, target_path string"
)


def repositories_from_json(raw: DataFrame) -> DataFrame:
    """Typed repository records from a ``value`` column of JSON text."""
    r = F.from_json("value", REPOSITORY_SCHEMA)
    nobody = F.struct(F.lit("unknown").alias("login"), F.lit("").alias("avatar_url"))
    return raw.select(r.alias("r")).select(
        F.col("r.id").alias("id"),
        F.col("r.full_name").alias("full_name"),
        F.coalesce("r.description", F.lit("No description")).alias("description"),
        F.col("r.html_url").alias("url"),
        F.col("r.clone_url").alias("clone_url"),
        F.coalesce("r.stargazers_count", F.lit(0)).cast("bigint").alias("stars"),
        F.coalesce("r.forks_count", F.lit(0)).cast("bigint").alias("forks"),
        F.coalesce("r.language", F.lit("Unknown")).alias("language"),
        F.coalesce("r.default_branch", F.lit("main")).alias("default_branch"),
        F.coalesce("r.topics", F.array().cast("array<string>")).alias("topics"),
        F.coalesce("r.owner", nobody).alias("owner"),
        F.coalesce("r.languages", F.create_map().cast("map<string,bigint>")).alias("languages"),
        F.try_to_timestamp("r.updated_at").alias("updated"),
    )


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Exported repository JSON, one object per line."""
    return repositories_from_json(spark.read.text(path))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Exported API responses, one JSON document per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def results_json(results: DataFrame) -> DataFrame:
    """One JSON document per project from a wide results row."""
    return results.select(
        "project_id", F.to_json(F.struct(*results.columns), {"pretty": "true"}).alias("document")
    )


def write_results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def write_collection(
    payloads: DataFrame, platform: str, endpoint: str, collected_at: str, folder: str, target: str | None = None
) -> DataFrame:
    """Write the items of exported payloads below ``folder``, a folder for each kind, and give back the manifest.

    The manifest is one row: platform, endpoint, time, number of items by kind, payloads in quarantine, target.  Its counts are
    observed in the pass that writes, so the payloads are read once.
    """
    seen = Observation()
    items = mlops.collected_items(payloads, platform).observe(seen, *mlops.counted_items(platform))
    items.write.partitionBy("kind").parquet(f"{folder}/items")
    counts = {k: int(v) for k, v in seen.get.items()}
    bad = counts.pop("quarantined")
    row = (platform, endpoint, collected_at, counts, bad, target or folder)
    manifest = payloads.sparkSession.createDataFrame([row], MANIFEST_SCHEMA)
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest
