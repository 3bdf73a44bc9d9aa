"""API endpoints and dependencies between services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import paths
from knotmeter.functions.matching import any_of, call_heads, is_call, quoted, starts_of
from knotmeter.operators.mentions import contains_pairs
from knotmeter.operators.services import relative_path, with_owners


def endpoint_hits(inventory: DataFrame, catalogue: dict = rules.ENDPOINT_PATTERNS) -> DataFrame:
    """Endpoint matches of every language's rules per code file, content dropped.

    A pattern is run on texts that hold one of its starts, which is looked up in the heads of the calls where it can be.
    """
    users: dict[str, list[tuple[str, str]]] = {}
    for language, frameworks in catalogue.items():
        for framework, patterns in frameworks.items():
            for pattern in patterns:
                users.setdefault(pattern, []).append((language, framework))

    def hits(pattern: str) -> str:
        groups = pattern.count("(") - pattern.count(r"\(")
        p = quoted(pattern)
        owners = ", ".join(
            f"struct('{lang}' AS rule_language, '{fw}' AS framework)" for lang, fw in users[pattern]
        )
        method = f"upper(regexp_extract(m, {p}, 1))" if groups == 2 else "'GET'"
        held = [f"contains({'heads' if is_call(v) else 'content'}, {quoted(v)})" for v in starts_of(pattern)]
        text = f"CASE WHEN {any_of(held)} THEN content ELSE '' END"
        return (
            f"transform(regexp_extract_all({text}, {p}, 0), m -> struct(array({owners}) AS owners, "
            f"{method} AS method, regexp_extract(m, {p}, {groups}) AS endpoint))"
        )

    capturing = [p for p in users if p.count("(") > p.count(r"\(")]
    found = F.expr("explode(concat(" + ", ".join(hits(p) for p in capturing) + "))")
    heads = F.expr(call_heads("content", [v for p in capturing for v in starts_of(p)]))
    return (
        inventory.where(paths.has_extension(F.col("name"), rules.ENDPOINT_CODE))
        .select("project_id", "dir", "path", "content", heads.alias("heads"))
        .select("project_id", "dir", "path", found.alias("e"))
        .select("project_id", "dir", "path", "e.method", "e.endpoint", F.inline("e.owners"))
    )


def detect_endpoints(inventory: DataFrame, services: DataFrame) -> DataFrame:
    """Endpoints per service; a language's rules apply when its name is part of the
    service language (so 'Java' rules also run on 'JavaScript/Node.js').

    A pattern listed by two frameworks reports twice.
    """
    owners = services.withColumnRenamed("name", "service")
    return (
        with_owners(endpoint_hits(inventory), owners, "service", "language")
        .where(F.col("language").contains(F.col("rule_language")))
        .select(
            "project_id", "service", F.col("owner_path").alias("service_path"),
            relative_path(F.col("path"), F.col("owner_path")).alias("file"),
            "framework", "method", F.col("endpoint").alias("path"),
        )
    )


def endpoint_counts(endpoints: DataFrame, services: DataFrame) -> DataFrame:
    counted = endpoints.groupBy("project_id", F.col("service_path").alias("path")).agg(
        F.count("*").alias("endpoint_count")
    )
    return services.join(counted, ["project_id", "path"], "left").select(
        "project_id", "name", "path", "language",
        F.coalesce("endpoint_count", F.lit(0)).cast("bigint").alias("endpoint_count"),
    )


def service_needles(services: DataFrame) -> DataFrame:
    """The texts that give away a call to a service (project, service, needle)."""
    name, path = F.col("name"), F.col("path")
    calls = F.array(
        F.concat(F.lit("http://"), name), F.concat(F.lit("https://"), name),
        F.concat(name, F.lit(".com")), F.when(path != ".", path),
        F.concat(F.lit("/"), name, F.lit("/")),
    )
    # for a top-level service the path is the name, which all the others contain
    needles = F.when(path == name, F.array(path)).otherwise(calls)
    return (
        services.select("project_id", name.alias("target"), F.explode(needles).alias("needle"))
        .where(F.col("needle").isNotNull())
        .distinct()
    )


def service_dependencies(inventory: DataFrame, services: DataFrame) -> DataFrame:
    """(source, target): code of the source mentions the target service."""
    code = inventory.where(
        paths.has_extension(F.col("name"), rules.ENDPOINT_CODE) & F.col("content").isNotNull()
    ).select("project_id", "dir", "content")
    needles = service_needles(services)
    pairs = contains_pairs(code, needles)
    return dependencies_from_pairs(pairs, services, needles)


def dependencies_from_pairs(
    pairs: DataFrame, services: DataFrame, needles: DataFrame
) -> DataFrame:
    # one row per directory before directories fan out to the services above
    per_dir = (
        pairs.select("project_id", "dir", "needle").distinct()
        .join(needles, ["project_id", "needle"])
        .select("project_id", "dir", "target").distinct()
    )
    return (
        with_owners(per_dir, services.withColumnRenamed("name", "source"), "source")
        .where(F.col("source") != F.col("target"))
        .select("project_id", "source", "target")
        .distinct()
    )


def graph_nodes(services_with_counts: DataFrame) -> DataFrame:
    """One node per service name (a later duplicate overwrites an earlier one)."""
    return services_with_counts.groupBy("project_id", "name").agg(
        F.lit("service").alias("type"),
        F.max_by("language", "path").alias("service_type"),
        F.max_by("endpoint_count", "path").alias("endpoints"),
    )


def graph_edges(dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("project_id", F.col("name").alias("target"))
    return dependencies.join(known, ["project_id", "target"], "left_semi").select(
        "project_id", "source", "target", F.lit("http_call").alias("type")
    )


def key_counts(services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """endpoint_count is rows; dependency_count is services with an entry."""
    entries = services.groupBy("project_id").agg(
        F.count_distinct("name").alias("dependency_count")
    )
    rows = endpoints.groupBy("project_id").agg(F.count("*").alias("endpoint_count"))
    return entries.join(rows, "project_id", "left").select(
        "project_id",
        F.coalesce("endpoint_count", F.lit(0)).cast("bigint").alias("endpoint_count"),
        "dependency_count",
    )
