"""The six tiers as DataFrame compositions, up to one wide row per project."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import paths
from knotmeter.operators import (
    endpoints, features, frameworks, history, inventory, models, scores, services, smells,
)
from knotmeter.operators.mentions import contains_pairs
from knotmeter.session import materialize


class Facts:
    """Relations every tier starts from, each computed when first asked for.

    The ones that come from file contents and feed many small aggregates are
    written to the shared folder once, so contents are scanned a fixed number of
    times however many metrics are asked for.
    """

    def __init__(self, files: DataFrame, glue_mode: str = "intended"):
        self.inventory = inventory.file_inventory(files)
        self.glue_mode = glue_mode

    def prepare(self, *more: str) -> None:
        """Store what the smells start from, and ``more`` relations. Those that do not need each other are written side
        by side, so that the short ones do not wait for the scan of the contents."""
        with ThreadPoolExecutor(5) as pool:
            for names in (("features", "services", "models"), ("pipelines", "service_facts", "consumers", "declared", *more)):
                list(pool.map(lambda name: getattr(self, name), names))

    @cached_property
    def features(self) -> DataFrame:
        return materialize(features.file_features(self.inventory, self.glue_mode))

    @cached_property
    def services(self) -> DataFrame:
        return materialize(services.detect_services(self.inventory))

    @cached_property
    def models(self) -> DataFrame:
        return materialize(models.detect_models(self.inventory))

    @cached_property
    def pipelines(self) -> DataFrame:
        # the stored features have the names of all files, and no content
        return materialize(services.detect_pipelines(self.features, list_files=False))

    @cached_property
    def service_facts(self) -> DataFrame:
        return materialize(smells.service_facts(self.features, self.services))

    @cached_property
    def consumers(self) -> DataFrame:
        return materialize(smells.actual_consumers(self.mentions, self.services))

    @cached_property
    def endpoints(self) -> DataFrame:
        return materialize(endpoints.detect_endpoints(self.inventory, self.services))

    @cached_property
    def _needles(self) -> DataFrame:
        return endpoints.service_needles(self.services)

    @cached_property
    def _pairs(self) -> DataFrame:
        """Models and services are looked up in the code in one scan."""
        wanted = self._needles.select("project_id", "needle").unionByName(
            self.models.select("project_id", F.col("name").alias("needle"))
        )
        calling = paths.has_extension(F.col("name"), rules.ENDPOINT_CODE)
        code = self.inventory.where(
            smells.consumer_code() | (calling & F.col("content").isNotNull())
        ).select("project_id", "dir", "path", "name", "extension", "ignored", "content")
        return materialize(contains_pairs(code, wanted))

    @cached_property
    def mentions(self) -> DataFrame:
        names = self.models.select("project_id", F.col("name").alias("needle")).distinct()
        return (
            self._pairs.where(
                paths.has_extension(F.col("name"), rules.CONSUMER_CODE)
                | F.col("extension").isin(rules.CONSUMER_CODE)
            )
            .join(names, ["project_id", "needle"], "left_semi")
            .withColumnRenamed("needle", "model")
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        calling = paths.has_extension(F.col("name"), rules.ENDPOINT_CODE)
        return endpoints.dependencies_from_pairs(
            self._pairs.where(calling), self.services, self._needles
        )

    @cached_property
    def declared(self) -> DataFrame:
        return materialize(smells.declared_consumers(self.inventory, self.services, self.models))


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("project_id").agg(F.count("*").alias(name))


def tier1(facts: Facts) -> DataFrame:
    """Files, language, type and the numbers of services, models, pipelines."""
    rows = facts.inventory
    out = inventory.inventory_counts(rows, facts.services, facts.models, facts.pipelines)
    return (
        out.withColumnRenamed("total_files", "files_count")
        .join(inventory.primary_language(rows), "project_id")
        .join(inventory.project_type(rows).drop("score"), "project_id")
    )


def tier2(facts: Facts) -> DataFrame:
    """Endpoint and dependency counts and the manifest frameworks."""
    found = frameworks.manifest_frameworks(facts.inventory).groupBy("project_id").agg(
        F.array_sort(F.collect_set("framework")).alias("frameworks")
    )
    return (
        endpoints.key_counts(facts.services, facts.endpoints)
        .join(_counts(facts.dependencies, "dependency_edges"), "project_id", "left")
        .join(found, "project_id", "left")
        .fillna(0, ["dependency_edges"])
    )


#: What is added up for a project.
SUMS = [
    "services_count", "direct_count", "glue_lines", "total_lines", "loops_count", "hidden_count", "complex_pipelines",
    "retrain_count", "shared_count", "impact", "model_names", "models_count", "pipelines_count",
]


def _project_sums(facts: Facts) -> DataFrame:
    """All SUMS of the projects that have a service: the rows of every measure in one relation, grouped once."""
    facts.prepare()
    one = F.lit(1)

    def part(rows: DataFrame, **measures: Column) -> DataFrame:
        return rows.select("project_id", *[measures.get(n, F.lit(0)).cast("bigint").alias(n) for n in SUMS])

    hit = F.col("loading_hits") + F.col("prediction_hits") > 0
    complexity = services.pipeline_complexity(facts.pipelines, facts.features)
    parts = [
        part(facts.services, services_count=one),
        part(
            facts.service_facts, direct_count=hit.cast("bigint"), glue_lines=F.col("glue_lines"),
            total_lines=F.col("total_lines"), loops_count=F.col("loops"),
        ),
        part(smells.hidden_consumers(facts.consumers, facts.declared), hidden_count=one),
        part(facts.consumers, impact=one),
        part(complexity, pipelines_count=one, complex_pipelines=F.col("is_complex").cast("bigint")),
        part(smells.retrain_events(facts.features), retrain_count=one),
        part(smells.shared_features(facts.features, facts.services), shared_count=one),
        part(facts.models.select("project_id", "name").distinct(), model_names=one),
        part(facts.models, models_count=one),
    ]
    sums = [F.sum(n).alias(n) for n in SUMS]
    return reduce(DataFrame.unionByName, parts).groupBy("project_id").agg(*sums).where("services_count > 0")


def tier3(facts: Facts) -> DataFrame:
    """All smells, one row per project that has a service."""
    none = F.lit(0.0)
    return _project_sums(facts).withColumns({
        "direct_ratio": F.col("direct_count") / F.col("services_count"),
        "glue_ratio": F.coalesce(F.try_divide("glue_lines", "total_lines"), none),
        "avg_impact": F.coalesce(F.try_divide("impact", "model_names"), none),
        "loop_strength": F.col("loops_count") / F.col("services_count"),
    }).drop("glue_lines", "total_lines", "impact", "model_names")


def tier4(facts: Facts, smell_rows: DataFrame | None = None) -> DataFrame:
    """Model entanglement score per project."""
    return scores.score_mes(smell_rows if smell_rows is not None else tier3(facts))


def tier5(
    facts: Facts, commits: DataFrame, commit_files: DataFrame, as_of: str
) -> DataFrame:
    """Churn, change impact, bugs and the maintainability score.

    Projects without commits fall back to estimates from their files.
    """
    changes = history.window_changes(commits, commit_files, as_of)
    concentration = history.change_concentration(history.top_changed(changes))
    impact = history.change_impact(
        history.change_impact_by_model(facts.mentions, facts.models)
    )
    logged = (
        commits.groupBy("project_id").agg(F.count("*").alias("commit_count"))
        .join(history.bug_rate(commits, as_of).drop("commits"), "project_id", "left")
        .join(concentration, "project_id", "left")
    )
    kept_files = facts.features.where(~F.col("ignored"))
    totals = _counts(kept_files, "est_commits")
    estimated = totals.join(
        history.estimate_bugs(facts.features).select(
            "project_id", F.col("bug_rate").alias("est_rate"), F.col("bug_count").alias("est_bugs")
        ),
        "project_id",
    )
    rows = (
        facts.features.select("project_id").distinct()
        .join(logged, "project_id", "left").join(estimated, "project_id", "left")
        .join(impact, "project_id", "left")
    )
    known = F.col("commit_count").isNotNull()
    zero = F.lit(0)

    def either(value, fallback):
        return F.when(known, F.coalesce(F.col(value), zero)).otherwise(F.coalesce(fallback, zero))

    files = F.coalesce("est_commits", zero)
    rows = rows.select(
        "project_id",
        either("commit_count", files).cast("bigint").alias("commit_count"),
        either("bug_count", F.col("est_bugs")).cast("bigint").alias("bug_count"),
        either("bug_rate", F.col("est_rate")).cast("double").alias("bug_rate"),
        either("top5_changes", F.least(files, F.lit(5))).cast("bigint").alias("top5_changes"),
        either("top20_changes", F.least(files, F.lit(20))).cast("bigint").alias("top20_changes"),
        F.coalesce("avg_change_impact", F.lit(0.0)).alias("avg_change_impact"),
        F.coalesce("max_change_impact", zero).cast("bigint").alias("max_change_impact"),
    )
    return scores.trends(scores.maintainability_score(rows))


def service_profile(facts: Facts, ml_libraries: DataFrame | None = None) -> DataFrame:
    """Per service the inputs of the isolation and violation scores."""
    key = ["project_id", "path"]
    impact = smells.impact_of_consumers(facts.consumers, facts.models)
    average = impact.groupBy("project_id").agg(F.avg("impact_radius").alias("avg_impact"))
    # these three are known by service name; of equal names the last path counts
    named = facts.service_facts.withColumnRenamed("service", "name")
    of_service = named.groupBy("project_id", "name").agg(
        F.when(F.bool_or(F.col("loading_hits") + F.col("prediction_hits") > 0), True).alias("is_direct"),
        F.max_by(F.try_divide("glue_lines", "total_lines"), F.when(F.col("total_lines") > 0, F.col("path"))).alias("glue_ratio"),
        F.when(F.bool_or(F.col("loops") > 0), True).alias("in_loop"),
    )
    rows = endpoints.endpoint_counts(facts.endpoints, facts.services)
    rows = rows.join(of_service, ["project_id", "name"], "left")
    rows = rows.join(average, "project_id", "left")
    if ml_libraries is None:
        rows = rows.withColumn("ml_libraries", F.array().cast("array<string>"))
    else:
        rows = rows.join(ml_libraries, key, "left")
    return rows.fillna(False, ["is_direct", "in_loop"]).fillna(0, ["avg_impact"])


def tier6(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Validation figures; ``rows`` holds the columns of tiers 4 and 5."""
    judged = scores.violation_scores(scores.isolation_scores(profile))
    out = rows.join(scores.isolation_means(judged), "project_id", "left")
    out = scores.significance(scores.mes_correlations(scores.degradation_ratio(out)))
    return scores.validation_interpretation(scores.accuracy_rate(out))


def analyze(
    files: DataFrame, commits: DataFrame, commit_files: DataFrame, as_of: str,
    glue_mode: str = "intended",
) -> DataFrame:
    """Everything: one wide row per project through all six tiers."""
    facts = Facts(files, glue_mode)
    facts.prepare("endpoints")
    first = tier1(facts).drop("services_count", "models_count", "pipelines_count")
    rows = (
        tier4(facts).join(tier5(facts, commits, commit_files, as_of), "project_id")
        .join(first, "project_id").join(tier2(facts), "project_id")
    )
    return tier6(rows, service_profile(facts))


def mes_report(files: DataFrame) -> DataFrame:
    """The flagship: entanglement per project, from files alone."""
    return tier4(Facts(files))


def language_report(tree: DataFrame) -> DataFrame:
    """Primary language, project type and build systems per project."""
    builds = inventory.build_systems(tree).groupBy("project_id").agg(
        F.array_sort(F.collect_set("build_system")).alias("build_systems")
    )
    return (
        inventory.primary_language_share(tree)
        .join(inventory.detector_project_type(tree), "project_id")
        .join(builds, "project_id", "left")
    )


def framework_report(tree: DataFrame) -> DataFrame:
    from knotmeter.sources import manifests

    from_files = frameworks.detect_frameworks_from_files(frameworks.framework_evidence(tree))
    from_deps = frameworks.detect_frameworks_from_dependencies(
        manifests.parse_requirements(tree), manifests.parse_package_json(tree),
        manifests.pom_files(tree),
    )
    return frameworks.framework_report(frameworks.detect_frameworks_all(from_files, from_deps))


def git_report(commits: DataFrame, as_of: str) -> DataFrame:
    """Repository facts beside the bug-fix ratio of the last 180 days."""
    recent = history.recent_commits(commits, as_of)
    return history.repo_info(commits).join(history.bug_rate(recent), "project_id", "left")


__all__ = [
    "Facts", "analyze", "framework_report", "git_report", "language_report",
    "mes_report", "service_profile", "tier1", "tier2", "tier3", "tier4", "tier5", "tier6",
]
