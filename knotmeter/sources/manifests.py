"""Dependency manifests inside the ``files`` relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKAGE_SCHEMA = "dependencies map<string,string>, devDependencies map<string,string>"


def _requirement_lines() -> Column:
    lines = F.transform(
        F.split("content", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    )
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


def parse_requirements(inventory: DataFrame) -> DataFrame:
    """One row per requirement line, with the name before ==, >= or <=."""
    return (
        inventory.where((F.col("name") == "requirements.txt") & F.col("content").isNotNull())
        .select("project_id", "dir", "path", F.explode(_requirement_lines()).alias("requirement"))
        .withColumn("package", F.regexp_extract("requirement", r"^(.*?)(==|>=|<=|$)", 1))
    )


def _merged_packages() -> Column:
    parsed = F.from_json("content", PACKAGE_SCHEMA)
    empty = F.create_map().cast("map<string,string>")
    main, dev = (F.coalesce(parsed[k], empty) for k in ("dependencies", "devDependencies"))
    # a development entry replaces the main one
    kept = F.map_filter(main, lambda k, _: ~F.array_contains(F.map_keys(dev), k))
    return F.map_concat(kept, dev)


def parse_package_json(inventory: DataFrame) -> DataFrame:
    """One row per package; unreadable JSON gives none."""
    return inventory.where(
        (F.col("name") == "package.json") & F.col("content").isNotNull()
    ).select("project_id", "dir", "path", F.explode(_merged_packages()).alias("package", "version"))


def pom_files(inventory: DataFrame) -> DataFrame:
    return inventory.where(
        (F.col("name") == "pom.xml") & F.col("content").isNotNull()
    ).select("project_id", "dir", "path", "content")


def dependency_manifests(inventory: DataFrame) -> DataFrame:
    """One manifest per directory: maven over npm over pip, with its entries."""
    name = F.col("name")
    readable = F.from_json("content", PACKAGE_SCHEMA).isNotNull() & F.get_json_object(
        "content", "$"
    ).isNotNull()
    nothing = F.array().cast("array<string>")
    kind = (
        F.when(name == "pom.xml", F.lit(3)).when((name == "package.json") & readable, F.lit(2))
        .when(name == "requirements.txt", F.lit(1))
    )
    entries = (
        F.when(name == "requirements.txt", _requirement_lines())
        .when(name == "package.json", F.map_keys(_merged_packages()))
        .otherwise(nothing)
    )
    return (
        inventory.where(name.isin("requirements.txt", "package.json", "pom.xml"))
        .select("project_id", "dir", "path", kind.alias("priority"), entries.alias("dependencies"))
        .where(F.col("priority").isNotNull())
        .groupBy("project_id", "dir")
        .agg(F.max_by(F.struct("priority", "path", "dependencies"), "priority").alias("m"))
        .select(
            "project_id", "dir",
            F.element_at(F.array(F.lit("pip"), F.lit("npm"), F.lit("maven")), F.col("m.priority")).alias("type"),
            F.col("m.path").alias("file"), "m.dependencies",
        )
    )
