"""Registered queries: each operator over whole driver tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import text
from knotmeter.operators import (
    endpoints, features, frameworks, history, inventory, mlops, models, reports, repositories,
    scores, services, significance, smells,
)
from knotmeter.plans import corpus, tiers
from knotmeter.session import materialize, scratch_path
from knotmeter.sources import commit_log, files as file_sources, manifests, payloads, tree as tree_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = corpus.AS_OF


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str | Column, sep: str = "|") -> Column:
    return F.array_join(column, sep)


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def tree(spark, sf) -> DataFrame:
    return inventory.file_inventory(corpus.files(spark, sf))


def listing(spark, sf) -> DataFrame:
    """The tree for operators that use names and sizes only."""
    return inventory.file_inventory(corpus.files(spark, sf, read_content=False))


def file_table(spark, sf) -> DataFrame:
    """The corpus as a stored table, which is what the tiers read in practice."""
    return materialize(corpus.files(spark, sf))


def feats(spark, sf, mode="intended") -> DataFrame:
    return features.file_features(tree(spark, sf), mode)


def svcs(spark, sf) -> DataFrame:
    return services.detect_services(listing(spark, sf))


def artefacts(t: DataFrame) -> DataFrame:
    """Models are looked at several times per query, so they are stored once."""
    return materialize(models.detect_models(t))


# --- inventory -------------------------------------------------------------


@query
def file_inventory(spark, sf):
    return listing(spark, sf).select(
        "project_id", "path", "dir", "name", "extension", "size", "ignored", "name_ignored"
    )


@query
def find_files(spark, sf):
    return inventory.find_files(listing(spark, sf), "*_*.py").select("project_id", "path")


@query
def language_counts(spark, sf):
    return inventory.language_counts(listing(spark, sf))


@query
def primary_language(spark, sf):
    return inventory.primary_language(listing(spark, sf))


@query
def language_counts_scanner(spark, sf):
    return inventory.language_counts(listing(spark, sf), rules.SCANNER_LANGUAGE_FILES)


@query
def language_stats(spark, sf):
    return inventory.language_stats(listing(spark, sf))


@query
def language_hits(spark, sf):
    return inventory.language_hits(listing(spark, sf))


@query
def primary_language_share(spark, sf):
    return inventory.primary_language_share(listing(spark, sf))


@query
def project_type_scores(spark, sf):
    return inventory.project_type_scores(listing(spark, sf)).select("project_id", "project_type", "score")


@query
def project_type(spark, sf):
    return inventory.project_type(listing(spark, sf))


@query
def detector_project_type_scores(spark, sf):
    return inventory.detector_project_type_scores(listing(spark, sf)).select(
        "project_id", "project_type", "score"
    )


@query
def detector_project_type(spark, sf):
    return inventory.detector_project_type(listing(spark, sf))


@query
def project_types(spark, sf):
    t = listing(spark, sf)
    return inventory.project_types(
        t, services.detect_services_scanner(t), models.detect_model_files_scanner(t),
        services.detect_pipelines_scanner(t),
    ).select("project_id", joined("project_types").alias("project_types"))


@query
def build_systems(spark, sf):
    return inventory.build_systems(listing(spark, sf))


@query
def categorize_files(spark, sf):
    return inventory.categorize_files(listing(spark, sf)).select(
        "project_id", "path", joined("tags").alias("tags")
    )


@query
def file_statistics(spark, sf):
    return inventory.file_statistics(listing(spark, sf))


@query
def inventory_counts(spark, sf):
    t = tree(spark, sf)
    names = listing(spark, sf)
    return inventory.inventory_counts(
        names, services.detect_services(names), models.detect_models(t),
        services.detect_pipelines(names),
    )


@query
def directory_stats(spark, sf):
    return inventory.directory_stats(listing(spark, sf))


@query
def extreme_files(spark, sf):
    return inventory.extreme_files(listing(spark, sf)).select(
        "project_id", "list", "rank", "path", "size", stamp("modified").alias("modified")
    )


@query
def directory_size(spark, sf):
    return inventory.directory_size(listing(spark, sf))


@query
def directory_tree(spark, sf):
    return inventory.directory_tree(listing(spark, sf))


@query
def file_details(spark, sf):
    return inventory.file_details(tree(spark, sf)).withColumn("lines", F.coalesce("lines", F.lit(-1)))


# --- services and pipelines --------------------------------------------------


@query
def detect_services(spark, sf):
    return svcs(spark, sf).withColumn("indicators", joined("indicators"))


@query
def detect_services_scanner(spark, sf):
    return services.detect_services_scanner(listing(spark, sf)).select(
        "project_id", "name", "path", "language", joined("indicators").alias("indicators")
    )


@query
def files_in_services(spark, sf):
    return services.files_in_services(listing(spark, sf), svcs(spark, sf))


@query
def detect_pipelines(spark, sf):
    return services.detect_pipelines(listing(spark, sf)).withColumn("files", joined("files"))


@query
def detect_pipelines_scanner(spark, sf):
    return services.detect_pipelines_scanner(listing(spark, sf)).withColumn("files", joined("files"))


@query
def pipeline_files(spark, sf):
    t = listing(spark, sf)
    return services.pipeline_files(t, services.detect_pipelines(t))


@query
def pipeline_files_scanner(spark, sf):
    t = listing(spark, sf)
    return services.pipeline_files_scanner(t, services.detect_pipelines_scanner(t))


@query
def pipeline_complexity(spark, sf):
    # names are enough to find pipelines: the contents are rewritten for the features alone
    return services.pipeline_complexity(
        services.detect_pipelines(listing(spark, sf), list_files=False), feats(spark, sf)
    ).withColumns({"complexity": r6("complexity"), "branching_factor": r6("branching_factor")})


@query
def pipeline_complexity_scanner(spark, sf):
    return services.pipeline_complexity_scanner(
        services.detect_pipelines_scanner(listing(spark, sf)), feats(spark, sf)
    )


@query
def compose_attach(spark, sf):
    return services.compose_attach(svcs(spark, sf), corpus.compose(spark, sf)).select(
        "project_id", "name", "path", "compose_name", "image",
        joined("model_mounts").alias("model_mounts"),
    )


# --- models --------------------------------------------------------------------


@query
def detect_model_files(spark, sf):
    return models.detect_model_files(listing(spark, sf)).withColumn("modified", stamp("modified"))


@query
def detect_model_files_scanner(spark, sf):
    return models.detect_model_files_scanner(listing(spark, sf)).drop("modified", "detected_by")


@query
def model_file_facts(spark, sf):
    return models.model_file_facts(listing(spark, sf)).drop("modified").fillna("", ["version", "architecture"])


@query
def detect_model_code_refs(spark, sf):
    return models.detect_model_code_refs(tree(spark, sf))


@query
def model_references(spark, sf):
    return models.model_references(tree(spark, sf)).drop("occurrence").fillna("", ["model_reference"])


@query
def model_metadata_files(spark, sf):
    return models.model_metadata_files(listing(spark, sf))


@query
def model_detection_stats(spark, sf):
    t = tree(spark, sf)
    return models.model_detection_stats(
        models.model_file_facts(t), models.model_references(t), models.model_metadata_files(t)
    )


@query
def model_frameworks(spark, sf):
    return models.model_frameworks(models.model_file_facts(listing(spark, sf)))


@query
def missing_models(spark, sf):
    t = tree(spark, sf)
    return models.missing_models(models.model_references(t), models.model_file_facts(t)).select(
        "project_id", "path", "line", "framework", "pattern", "model_reference"
    )


@query
def model_issues(spark, sf):
    # sizes are scaled up so that the size rule has something to find
    t = tree(spark, sf).withColumn("size", F.col("size") * 100_000)
    return models.model_issues(models.model_file_facts(t), models.model_references(t))


@query
def model_code_refs_merge(spark, sf):
    t = tree(spark, sf)
    return models.model_code_refs_merge(
        models.detect_model_files_scanner(t), models.scanner_code_refs(t)
    )


# --- endpoints and dependencies ---------------------------------------------------


@query
def detect_endpoints(spark, sf):
    return endpoints.detect_endpoints(tree(spark, sf), svcs(spark, sf))


@query
def service_dependencies(spark, sf):
    return endpoints.service_dependencies(tree(spark, sf), svcs(spark, sf))


@query
def dependency_graph_nodes(spark, sf):
    found = svcs(spark, sf)
    hits = endpoints.detect_endpoints(tree(spark, sf), found)
    return endpoints.graph_nodes(endpoints.endpoint_counts(hits, found))


@query
def dependency_graph_edges(spark, sf):
    found = svcs(spark, sf)
    return endpoints.graph_edges(endpoints.service_dependencies(tree(spark, sf), found), found)


@query
def key_counts(spark, sf):
    found = svcs(spark, sf)
    return endpoints.key_counts(found, endpoints.detect_endpoints(tree(spark, sf), found))


# --- frameworks and manifests ---------------------------------------------------------


def _manifest_frameworks(t):
    return frameworks.detect_frameworks_from_dependencies(
        manifests.parse_requirements(t), manifests.parse_package_json(t), manifests.pom_files(t)
    )


def _all_frameworks(spark, sf):
    t = tree(spark, sf)
    return frameworks.detect_frameworks_all(
        frameworks.detect_frameworks_from_files(frameworks.framework_evidence(t)),
        _manifest_frameworks(t),
    )


@query
def manifest_frameworks(spark, sf):
    return frameworks.manifest_frameworks(tree(spark, sf))


@query
def code_frameworks(spark, sf):
    return frameworks.code_frameworks(tree(spark, sf))


@query
def framework_evidence(spark, sf):
    return frameworks.framework_evidence(tree(spark, sf))


@query
def detect_frameworks_from_files(spark, sf):
    return frameworks.detect_frameworks_from_files(frameworks.framework_evidence(tree(spark, sf)))


@query
def detect_frameworks_from_dependencies(spark, sf):
    return _manifest_frameworks(tree(spark, sf)).select(
        "project_id", "framework", "file", "dependency"
    )


@query
def detect_frameworks_all(spark, sf):
    return _all_frameworks(spark, sf)


@query
def frameworks_by_category(spark, sf):
    return frameworks.frameworks_by_category(_all_frameworks(spark, sf)).select(
        "project_id", "category",
        joined(F.transform("frameworks", lambda e: F.concat(e["name"], F.lit(":"), e["confidence"].cast("string"))))
        .alias("frameworks"),
    )


@query
def framework_report(spark, sf):
    return frameworks.framework_report(_all_frameworks(spark, sf)).withColumn(
        "primary_frameworks", joined("primary_frameworks")
    )


@query
def parse_requirements(spark, sf):
    return manifests.parse_requirements(tree(spark, sf)).drop("dir")


@query
def parse_package_json(spark, sf):
    return manifests.parse_package_json(tree(spark, sf)).drop("dir")


@query
def dependency_manifests(spark, sf):
    return manifests.dependency_manifests(tree(spark, sf)).select(
        "project_id", "dir", "type", "file", F.size("dependencies").cast("bigint").alias("entries")
    )


# --- the same over services in Go, Ruby, PHP and Java ---------------------------------------------------------


def polyglot_tree(spark, sf, read_content=True) -> DataFrame:
    return inventory.file_inventory(corpus.polyglot_files(spark, sf, read_content))


@query
def polyglot_services(spark, sf):
    found = services.detect_services(polyglot_tree(spark, sf, False))
    return found.withColumn("indicators", joined("indicators"))


@query
def polyglot_endpoints(spark, sf):
    return endpoints.detect_endpoints(
        polyglot_tree(spark, sf), services.detect_services(polyglot_tree(spark, sf, False))
    )


@query
def polyglot_manifests(spark, sf):
    return manifests.dependency_manifests(polyglot_tree(spark, sf)).select(
        "project_id", "dir", "type", "file", F.size("dependencies").cast("bigint").alias("entries")
    )


@query
def polyglot_frameworks(spark, sf):
    return _manifest_frameworks(polyglot_tree(spark, sf)).select("project_id", "framework", "file", "dependency")


# --- smells ------------------------------------------------------------------------------


@query
def direct_model_calls(spark, sf):
    return smells.direct_model_calls(feats(spark, sf), svcs(spark, sf))


@query
def direct_model_call_summary(spark, sf):
    found = svcs(spark, sf)
    return smells.direct_model_call_summary(
        smells.direct_model_calls(feats(spark, sf), found), found
    ).withColumn("direct_ratio", r6("direct_ratio"))


@query
def direct_model_call_details(spark, sf):
    return smells.direct_model_call_details(tree(spark, sf), svcs(spark, sf))


@query
def glue_code_by_service(spark, sf):
    return smells.glue_code_by_service(feats(spark, sf), svcs(spark, sf)).withColumn("ratio", r6("ratio"))


@query
def glue_code_ratio(spark, sf):
    return smells.glue_code_ratio(
        smells.glue_code_by_service(feats(spark, sf), svcs(spark, sf))
    ).withColumn("glue_ratio", r6("glue_ratio"))


@query
def glue_code_literal_mode(spark, sf):
    return smells.glue_code_ratio(
        smells.glue_code_by_service(feats(spark, sf, "reference"), svcs(spark, sf))
    ).withColumn("glue_ratio", r6("glue_ratio"))


@query
def declared_consumers(spark, sf):
    t = tree(spark, sf)
    return smells.declared_consumers(t, svcs(spark, sf), artefacts(t))


@query
def actual_consumers(spark, sf):
    t = tree(spark, sf)
    return smells.actual_consumers(
        smells.model_mentions(t, artefacts(t)), svcs(spark, sf)
    )


@query
def hidden_consumers(spark, sf):
    t = tree(spark, sf)
    found, known = svcs(spark, sf), artefacts(t)
    return smells.hidden_consumers(
        smells.actual_consumers(smells.model_mentions(t, known), found),
        smells.declared_consumers(t, found, known),
    )


@query
def impact_radius(spark, sf):
    t = tree(spark, sf)
    known = artefacts(t)
    return smells.impact_radius(
        smells.model_mentions(t, known), svcs(spark, sf), known
    )


@query
def retrain_events(spark, sf):
    return smells.retrain_events(feats(spark, sf))


@query
def feedback_loops(spark, sf):
    return smells.feedback_loops(feats(spark, sf), svcs(spark, sf))


@query
def feature_imports(spark, sf):
    return smells.feature_imports(feats(spark, sf), svcs(spark, sf))


@query
def shared_features(spark, sf):
    return smells.shared_features(feats(spark, sf), svcs(spark, sf))


@query
def service_model_matrix(spark, sf):
    t = tree(spark, sf)
    return smells.service_model_matrix(
        smells.model_mentions(t, artefacts(t)), svcs(spark, sf)
    )


# --- history ----------------------------------------------------------------------------------


@query
def recent_commits(spark, sf):
    return history.recent_commits(corpus.commits(spark, sf), AS_OF, 180).withColumn(
        "committed_at", stamp("committed_at")
    )


@query
def bug_fix_commits(spark, sf):
    return history.bug_fix_commits(corpus.commits(spark, sf)).withColumn(
        "committed_at", stamp("committed_at")
    )


@query
def file_history(spark, sf):
    return history.file_history(
        corpus.commits(spark, sf), corpus.commit_files(spark, sf), "svc1/models/model_1.pkl"
    ).select("project_id", "commit_id", "author", "message")


@query
def changed_files(spark, sf):
    return history.changed_files(corpus.commit_files(spark, sf), "77")


@query
def repo_info(spark, sf):
    return history.repo_info(corpus.commits(spark, sf)).select(
        "project_id", "commit_count", "contributors_count", stamp("created_at").alias("created_at"),
        F.col("last_commit.commit_id").alias("last_commit_id"),
        F.col("last_commit.author").alias("last_author"),
        F.col("last_commit.message").alias("last_message"),
    )


@query
def contributors(spark, sf):
    return history.contributors(corpus.commits(spark, sf))


@query
def commits_by_author(spark, sf):
    return history.commits_by_author(corpus.event_commits(spark, sf))


@query
def commits_by_date(spark, sf):
    return history.commits_by_date(corpus.event_commits(spark, sf)).withColumn(
        "date", F.col("date").cast("string")
    )


def _changes(spark, sf):
    return history.window_changes(corpus.commits(spark, sf), corpus.commit_files(spark, sf), AS_OF)


@query
def churn_by_file(spark, sf):
    return history.top_changed(_changes(spark, sf), 50)


@query
def top_changed_files(spark, sf):
    return history.top_changed(_changes(spark, sf), 20)


@query
def churn_by_service(spark, sf):
    return history.churn_by_service(_changes(spark, sf), svcs(spark, sf))


@query
def churn_lines(spark, sf):
    return history.churn_lines(corpus.commits(spark, sf), corpus.commit_files(spark, sf), AS_OF)


@query
def bug_rate(spark, sf):
    return history.bug_rate(corpus.commits(spark, sf), AS_OF).withColumn("bug_rate", r6("bug_rate"))


@query
def bug_rate_all_events(spark, sf):
    return history.bug_rate(corpus.event_commits(spark, sf)).withColumn("bug_rate", r6("bug_rate"))


@query
def bug_prone_files(spark, sf):
    return history.bug_prone_files(
        corpus.commits(spark, sf), corpus.commit_files(spark, sf), AS_OF
    )


@query
def change_concentration(spark, sf):
    return history.change_concentration(history.top_changed(_changes(spark, sf)))


@query
def estimate_churn(spark, sf):
    return history.estimate_churn(listing(spark, sf))


@query
def estimate_bugs(spark, sf):
    return history.estimate_bugs(feats(spark, sf)).withColumn("bug_rate", r6("bug_rate"))


@query
def estimate_bug_prone_files(spark, sf):
    return history.estimate_bug_prone_files(feats(spark, sf))


@query
def change_impact_by_model(spark, sf):
    t = tree(spark, sf)
    known = artefacts(t)
    return history.change_impact_by_model(smells.model_mentions(t, known), known)


@query
def change_impact(spark, sf):
    return history.change_impact(change_impact_by_model(spark, sf)).withColumn(
        "avg_change_impact", r6("avg_change_impact")
    )


@query
def bugs_by_model(spark, sf):
    return history.bugs_by_model(
        corpus.commits(spark, sf), corpus.commit_files(spark, sf),
        models.detect_model_files(listing(spark, sf)), AS_OF,
    )


def _log_records(spark, sf) -> DataFrame:
    """Each order line as one exported log record: a header and a numstat line."""
    lines, commits = corpus.commit_lines(spark, sf), corpus.commits(spark, sf)
    header = F.concat_ws("|", "commit_id", "author", stamp("committed_at"), "message")
    added = F.when(F.col("added") % 10 == 0, F.lit("-")).otherwise(F.col("added").cast("string"))
    stat = F.concat_ws("\t", added, F.col("deleted").cast("string"), "path")
    return lines.join(commits, ["project_id", "commit_id"]).select(
        "project_id", F.concat(header, F.lit("\n\n"), stat, F.lit("\n")).alias("record")
    )


@query
def commit_log_commits(spark, sf):
    return commit_log.commits_from_records(_log_records(spark, sf)).withColumn(
        "committed_at", stamp("committed_at")
    )


@query
def commit_log_files(spark, sf):
    return commit_log.commit_files_from_records(_log_records(spark, sf)).groupBy(
        "project_id", "commit_id", "path"
    ).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count("*").alias("rows"))


@query
def commit_log_lines(spark, sf):
    """orders and lineitem as numbered log lines without a record separator."""
    commits = corpus.commits(spark, sf)
    key = F.col("commit_id").cast("bigint") * 1000
    headers = commits.select(
        "project_id", key.alias("line_no"),
        F.concat_ws("|", "commit_id", "author", stamp("committed_at"), "message").alias("line"),
    )
    stats = corpus.commit_files(spark, sf).select(
        "project_id", (key + 1 + F.pmod(F.xxhash64("path"), F.lit(998))).alias("line_no"),
        F.concat_ws("\t", "added", "deleted", "path").alias("line"),
    )
    return commit_log.commit_files_from_lines(headers.unionByName(stats), 100_000)


# --- repositories ---------------------------------------------------------------------------------


@query
def search_repositories(spark, sf):
    return repositories.search_repositories(
        corpus.repositories(spark, sf), "nation_1", ["kubernetes"], 20
    ).withColumn("topics", joined("topics"))


@query
def search_repositories_by_forks(spark, sf):
    return repositories.search_repositories(
        corpus.repositories(spark, sf), "", [], 25, "forks", "asc"
    ).withColumn("topics", joined("topics"))


@query
def ranked_ml_repositories(spark, sf):
    return repositories.ranked_repositories(corpus.repositories(spark, sf)).select(
        "id", "full_name", "stars", "topic"
    )


@query
def ranked_microservice_repositories(spark, sf):
    return repositories.ranked_repositories(
        corpus.repositories(spark, sf), rules.MICROSERVICE_TOPICS
    ).select("id", "full_name", "stars", "topic")


@query
def language_byte_share(spark, sf):
    lines, parts = corpus.table(spark, sf, "lineitem"), corpus.table(spark, sf, "part")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_suppkey").alias("id"), F.col("p_type").alias("language"),
        F.col("l_quantity").cast("bigint").alias("bytes"),
    )
    return repositories.language_byte_share(rows)


@query
def top_contributors(spark, sf):
    rows = corpus.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("id"), F.concat(F.lit("dev"), F.col("l_orderkey") % 97).alias("login")
    ).agg(F.count("*").alias("contributions"))
    return repositories.top_contributors(rows)


@query
def latest_releases(spark, sf):
    rows = corpus.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("id"), F.concat(F.lit("v"), F.col("l_partkey")).alias("tag")
    ).agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("published"))
    return repositories.latest_releases(rows).withColumn("published", stamp("published"))


@query
def repositories_from_json(spark, sf):
    """Suppliers as exported repository documents, some fields left out."""
    key = F.col("s_suppkey")
    doc = F.to_json(
        F.struct(
            key.alias("id"), F.concat(F.lit("org/"), F.col("s_name")).alias("full_name"),
            F.when(key % 4 != 0, F.lower("s_name")).alias("description"),
            F.floor("s_acctbal").alias("stargazers_count"),
            F.when(key % 3 != 0, F.lit("Python")).alias("language"),
            F.when(key % 5 != 0, F.array(F.lit("docker"), F.lit("mlops"))).alias("topics"),
            F.when(key % 2 == 0, F.struct(F.col("s_name").alias("login"), F.lit("a").alias("avatar_url"))).alias("owner"),
        )
    )
    raw = corpus.table(spark, sf, "supplier").select(doc.alias("value"))
    return payloads.repositories_from_json(raw).select(
        "id", "full_name", "description", "stars", "forks", "language", "default_branch",
        joined("topics").alias("topics"), F.col("owner.login").alias("owner_login"),
    )


@query
def repo_url_parts(spark, sf):
    url = F.concat(
        F.when(F.col("page_id") % 3 == 0, F.lit("git@github.com:")).otherwise(F.lit("https://github.com/")),
        F.lit("org"), F.col("page_id") % 7, F.lit("/"), F.split_part("url", F.lit("/"), F.lit(3)),
        F.when(F.col("page_id") % 2 == 0, F.lit(".git")).otherwise(F.lit("")),
    )
    url = F.when(F.col("page_id") % 11 == 0, F.col("url")).otherwise(url)
    owner, name = text.repo_owner_and_name(F.col("repo_url"))
    return corpus.table(spark, sf, "pages").select("page_id", url.alias("repo_url")).select(
        "page_id", "repo_url", F.coalesce(owner, F.lit("")).alias("owner"),
        F.coalesce(name, F.lit("")).alias("repo"),
    )


# --- MLOps payloads --------------------------------------------------------------------------------


def _payloads(spark, sf, template: str) -> DataFrame:
    """One exported response per event, filled from the event's columns."""
    pieces = []
    for i, part in enumerate(template.split("@")):
        pieces.append(F.lit(part) if i % 2 == 0 else F.col(part).cast("string"))
    # seconds of the wall clock, whatever the session time zone
    events = corpus.table(spark, sf, "events").withColumn("seconds", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return events.select(F.concat(*pieces).alias("payload"))


KUBEFLOW_DOC = (
    '{"pipelines":[{"id":"@user_id@","name":"p@user_id@"}],'
    '"experiments":[{"id":"@event_type@","name":"x"}],'
    '"runs":[{"id":"@event_id@","pipeline_id":"@user_id@","name":"r"}]}'
)
MLFLOW_DOC = (
    '{"experiments":[{"experiment_id":"@event_type@","name":"n-@event_type@"}],'
    '"runs":[{"info":{"run_id":"@event_id@","experiment_id":"@event_type@","start_time":@seconds@}}],'
    '"registered_models":[{"name":"model-@user_id@"}]}'
)
BENTOML_DOC = (
    '{"bentos":[{"name":"@event_type@","version":"@user_id@"}],'
    '"models":[{"name":"m-@event_type@","version":"@user_id@"}]}'
)
SELDON_DOC = (
    '{"items":[{"metadata":{"name":"d@event_id@","namespace":"@event_type@"},"spec":{"predictors":'
    '[{"name":"main","graph":{"name":"g@user_id@"}},{"name":"shadow","graph":{}}]}}]}'
)


@query
def kubeflow_items(spark, sf):
    return mlops.kubeflow_items(_payloads(spark, sf, KUBEFLOW_DOC))


@query
def mlflow_runs(spark, sf):
    return mlops.mlflow_runs(_payloads(spark, sf, MLFLOW_DOC))


@query
def mlflow_item_counts(spark, sf):
    return mlops.item_counts(_payloads(spark, sf, MLFLOW_DOC), "mlflow")


@query
def kubeflow_item_counts(spark, sf):
    return mlops.item_counts(_payloads(spark, sf, KUBEFLOW_DOC), "kubeflow")


@query
def bentoml_item_counts(spark, sf):
    return mlops.item_counts(_payloads(spark, sf, BENTOML_DOC), "bentoml")


@query
def seldon_item_counts(spark, sf):
    return mlops.item_counts(_payloads(spark, sf, SELDON_DOC), "seldon")


def _damaged(payloads: DataFrame) -> DataFrame:
    """Some responses missing, some cut off, some no object."""
    kind = F.length("payload") % 5
    return payloads.select(
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.expr("left(payload, length(payload) - 1)")).when(kind == 2, F.lit("[1]"))
        .when(kind == 3, F.lit('{"runs": 7, "items": {"a": {}}}')).otherwise(F.col("payload")).alias("payload")
    )


@query
def quarantined_payloads(spark, sf):
    found = mlops.quarantined(_damaged(_payloads(spark, sf, KUBEFLOW_DOC)))
    return found.select(F.coalesce("payload", F.lit("")).alias("payload"), "reason")


@query
def bentoml_items(spark, sf):
    return mlops.bentoml_items(_payloads(spark, sf, BENTOML_DOC))


@query
def seldon_models(spark, sf):
    return mlops.seldon_models(_payloads(spark, sf, SELDON_DOC))


def _manifest(spark, sf, platform: str, template: str) -> DataFrame:
    manifest = payloads.write_collection(
        _payloads(spark, sf, template), platform, f"http://{platform}.example", "2024-01-31T00:00:00",
        scratch_path(spark), "out",
    )
    return manifest.select(
        "platform", "endpoint", "collection_time", "target_path",
        *[F.col("items_collected")[k].alias(k) for k in mlops.COUNTED[platform]],
    )


@query
def collection_manifest(spark, sf):
    return _manifest(spark, sf, "mlflow", MLFLOW_DOC)


@query
def kubeflow_manifest(spark, sf):
    return _manifest(spark, sf, "kubeflow", KUBEFLOW_DOC)


@query
def bentoml_manifest(spark, sf):
    return _manifest(spark, sf, "bentoml", BENTOML_DOC)


@query
def seldon_manifest(spark, sf):
    return _manifest(spark, sf, "seldon", SELDON_DOC)


# --- text functions, archives, sinks ------------------------------------------------------------------


@query
def text_functions(spark, sf):
    return corpus.table(spark, sf, "documents").select(
        "doc_id",
        text.human_size(F.col("n_chars") * F.col("n_chars") * 37).alias("size_long"),
        text.human_size(F.col("n_chars") * F.col("n_chars") * 37, True).alias("size_short"),
        text.line_count(F.col("text")).alias("lines"),
        F.length(text.truncate_readme(F.col("text"))).cast("bigint").alias("readme_length"),
        F.md5(text.truncate_readme(F.col("text"))).alias("readme_hash"),
        text.file_hash(F.col("text"), "sha256").alias("sha256"),
    )


@query
def safe_filenames(spark, sf):
    return corpus.table(spark, sf, "pages").select(
        "page_id",
        text.safe_filename(F.concat(F.col("url"), F.lit(":"), F.regexp_replace("html", "[^A-Za-z ]", ""), F.lit(".html")))
        .alias("safe"),
    )


@query
def fenced_json(spark, sf):
    fenced = F.concat(
        F.lit("Here it is:\n```json\n{\"turn\": "), F.col("turn").cast("string"), F.lit(", \"role\": \""),
        F.col("role"), F.lit("\"}\n```\n"), F.col("text"),
    )
    raw = F.when(F.col("role") == "assistant", fenced).otherwise(
        F.concat(F.lit(' {"turn": '), F.col("turn").cast("string"), F.lit("} "))
    )
    body = text.fenced_json(F.col("raw"))
    return corpus.table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw")).select(
        "conv_id", "turn", body.alias("body"),
        F.get_json_object(body, "$.turn").cast("bigint").alias("parsed_turn"),
    )


@query
def scan_files(spark, sf):
    """The documents as files of a tree in the shared folder, scanned without what the inventory ignores."""
    root = scratch_path(spark)
    tree_source.write_files(corpus.document_tree(spark, sf), root)
    return tree_source.scan_files(spark, root, rules.IGNORE_GLOBS).select(
        "project_id", "path", "size", F.coalesce(F.md5("content"), F.lit("")).alias("hash")
    )


@query
def expand_archives(spark, sf):
    """Each document zipped in its own archive, then expanded again."""
    def zipped(batches):
        for pdf in batches:
            out = []
            for doc, body in zip(pdf["doc_id"], pdf["text"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"repo/doc_{doc}.txt", body)
                    z.writestr("repo/src/", "")
                out.append((f"d{doc}", f"/in/d{doc}.zip", buffer.getvalue()))
            yield pd.DataFrame(out, columns=["project_id", "path", "content"])

    archives = corpus.table(spark, sf, "documents").select("doc_id", "text").mapInPandas(
        zipped, "project_id string, path string, content binary"
    )
    return file_sources.expand_archives(archives).select(
        "project_id", "path", "size", "archive", F.md5("content").alias("hash")
    )


@query
def normalize_project_root(spark, sf):
    raw = corpus.files(spark, sf, False).withColumn(
        "path", F.concat(F.when(F.col("project_id") != "src3", F.lit("main/")).otherwise(F.lit("")), "path")
    )
    return file_sources.normalize_project_root(raw).select("project_id", "path", "size")


@query
def normalize_project_root_scanner(spark, sf):
    """Trees below one directory, whose only marker is a Dockerfile, in projects with names of even length."""
    requirements = F.when(F.length("project_id") % 2 == 0, "main/Dockerfile").otherwise("main/setup.cfg")
    raw = corpus.files(spark, sf, False).withColumn("path", F.concat(F.lit("main/"), "path")).withColumn(
        "path", F.when(F.col("path") == "main/requirements.txt", requirements).otherwise(F.col("path"))
    )
    return file_sources.normalize_project_root(raw, rules.SCANNER_ROOT_MARKERS).select("project_id", "path", "size")


@query
def read_text_safely(spark, sf):
    grown = corpus.files(spark, sf).withColumn("size", F.col("size") * 8192)
    return file_sources.read_text_safely(grown).select(
        "project_id", "path", F.coalesce(F.length("content"), F.lit(-1)).cast("bigint").alias("chars"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def results_json(spark, sf):
    rows = history.bug_rate(corpus.commits(spark, sf))
    doc = payloads.results_json(rows)
    return doc.select(
        "project_id", F.get_json_object("document", "$.commits").cast("bigint").alias("commits"),
        F.get_json_object("document", "$.bug_count").cast("bigint").alias("bug_count"),
    )


# --- scores over metric rows -----------------------------------------------------------------------------


def scored(spark, sf) -> DataFrame:
    return scores.score_mes(corpus.metric_rows(spark, sf))


def validated(spark, sf) -> DataFrame:
    rows = scores.maintainability_score(scored(spark, sf))
    rows = scores.significance(scores.mes_correlations(scores.degradation_ratio(rows)))
    return scores.validation_interpretation(scores.accuracy_rate(rows))


@query
def mes_scores(spark, sf):
    return scored(spark, sf).select(
        "project_id", *[r6(c).alias(c) for c in scores.COMPONENTS], r6("mes_raw").alias("mes_raw"),
        "mes_level", "mes_interpretation",
    )


@query
def risk_factors(spark, sf):
    return scores.risk_factors(scored(spark, sf)).withColumn("value", r6("value"))


@query
def maintainability_scores(spark, sf):
    return scores.trends(scores.maintainability_score(corpus.metric_rows(spark, sf))).select(
        "project_id", "maintainability_score", joined("maintainability_factors").alias("factors"),
        "churn_trend", "bug_trend", "activity_trend",
    )


@query
def smell_summary(spark, sf):
    return scores.smell_summary(corpus.metric_rows(spark, sf)).select(
        "project_id", "critical_smells", "warning_smells", "total_smells",
        joined("top_issues.type").alias("issue_types"), joined("top_issues.severity").alias("severities"),
        joined("top_issues.message").alias("messages"),
    )


@query
def smell_radar(spark, sf):
    return scores.smell_radar(corpus.metric_rows(spark, sf)).withColumn("value", r6("value"))


@query
def degradation_ratio(spark, sf):
    return validated(spark, sf).select(
        "project_id", "avg_isolated_mes", "avg_non_isolated_mes", "degradation_ratio", "hypothesis_confirmed"
    )


@query
def mes_correlations(spark, sf):
    return validated(spark, sf).select(
        "project_id", "mes_churn", "mes_bug", "mes_impact", "combined", "p_value_degradation",
        "p_value_correlations", "confidence_level", "sample_size", "is_significant", "accuracy_rate",
    )


@query
def rank_correlations(spark, sf):
    return significance.rank_correlations(validated(spark, sf)).withColumn("rho", r6("rho"))


@query
def permutation_p_values(spark, sf):
    return significance.permutation_p_values(validated(spark, sf)).withColumn("rho", r6("rho"))


@query
def validation_interpretation(spark, sf):
    return validated(spark, sf).select("project_id", "interpretation")


@query
def correlation_matrix(spark, sf):
    return scores.correlation_matrix(validated(spark, sf))


@query
def project_profiles(spark, sf):
    rows = reports.smell_severity(
        reports.architecture_profile(reports.structure_profile(corpus.metric_rows(spark, sf)))
    )
    return rows.select(
        "project_id", joined("patterns").alias("patterns"), "architectural_style", "ai_maturity",
        "pattern", "communication_style", "bottleneck", F.coalesce("issue_type", F.lit("")).alias("issue_type"),
        "impact_prediction",
    )


@query
def debt_forecast(spark, sf):
    return reports.debt_forecast(scored(spark, sf)).select(
        "project_id", "predicted_increase", r6("six_month_forecast").alias("six_month_forecast"),
        r6("twelve_month_forecast").alias("twelve_month_forecast"), "intervention_timeline",
    )


@query
def risk_assessment(spark, sf):
    return reports.risk_assessment(scored(spark, sf)).select(
        "project_id", "overall_risk", "criticality_score",
        F.col("assessed_factors")[0]["factor"].alias("bug_factor"),
        F.col("assessed_factors")[0]["severity"].alias("bug_severity"),
        F.col("assessed_factors")[1]["severity"].alias("mes_severity"),
    )


@query
def architecture_proposal(spark, sf):
    rows = scored(spark, sf).withColumn(
        "first_services", F.lit(None).cast("array<struct<rn:int,name:string,language:string>>")
    )
    return reports.architecture_proposal(rows).select(
        "project_id", "architecture_name", joined("components.name").alias("components"),
        F.size("data_flow").cast("bigint").alias("flows"), joined("improvements").alias("improvements"),
        "estimated_effort", "expected_mes_reduction",
    )


@query
def proposed_architecture(spark, sf):
    """The proposal for each project of the corpus, with the services that were found in it."""
    facts = tiers.Facts(file_table(spark, sf))
    rows = tiers.tier4(facts).join(reports.first_services(facts.services), "project_id", "left")
    return reports.architecture_proposal(rows).select(
        "project_id", "architecture_name", joined("components.name").alias("components"),
        joined(F.flatten("components.technologies")).alias("technologies"),
    )


@query
def proposed_services(spark, sf):
    return reports.first_services(svcs(spark, sf)).select(
        "project_id", joined("first_services.name").alias("names"),
        joined("first_services.language").alias("languages"),
    )


@query
def insight_rows(spark, sf):
    return reports.insight_rows(corpus.metric_rows(spark, sf))


@query
def summary_tables(spark, sf):
    return reports.summary_tables(validated(spark, sf))


# --- whole tiers --------------------------------------------------------------------------------------------


@query
def service_isolation(spark, sf):
    profile = tiers.service_profile(tiers.Facts(file_table(spark, sf)))
    return scores.violation_scores(scores.isolation_scores(profile)).select(
        "project_id", "name", "path", "endpoint_count", "is_direct", "in_loop", "isolation_score",
        "violation_score", "is_isolated", "is_non_isolated",
    )


@query
def mes_report(spark, sf):
    return tiers.mes_report(file_table(spark, sf)).select(
        "project_id", "services_count", "models_count", "pipelines_count", "direct_count",
        "hidden_count", "complex_pipelines", "retrain_count", "loops_count", "shared_count",
        r6("glue_ratio").alias("glue_ratio"), r6("avg_impact").alias("avg_impact"),
        r6("mes_raw").alias("mes_raw"), "mes_level",
    )


@query
def maintainability_report(spark, sf):
    facts = tiers.Facts(file_table(spark, sf))
    return tiers.tier5(facts, corpus.commits(spark, sf), corpus.commit_files(spark, sf), AS_OF).select(
        "project_id", "commit_count", "bug_count", r6("bug_rate").alias("bug_rate"), "top5_changes",
        "top20_changes", r6("avg_change_impact").alias("avg_change_impact"), "max_change_impact",
        "maintainability_score", joined("maintainability_factors").alias("factors"),
    )


@query
def full_analysis(spark, sf):
    rows = tiers.analyze(
        file_table(spark, sf), corpus.commits(spark, sf), corpus.commit_files(spark, sf), AS_OF
    )
    return rows.select(
        "project_id", "language", "project_type", "files_count", "services_count", "models_count",
        "endpoint_count", "dependency_edges", "mes_score", "mes_level", "maintainability_score",
        "degradation_ratio", "accuracy_rate", joined("frameworks").alias("frameworks"),
    )


@query
def language_report(spark, sf):
    return tiers.language_report(listing(spark, sf)).select(
        "project_id", "language", "files", "total_files", "percentage", "project_type",
        joined("build_systems").alias("build_systems"),
    )


@query
def git_report(spark, sf):
    return tiers.git_report(corpus.commits(spark, sf), AS_OF).select(
        "project_id", "commit_count", "contributors_count", "commits", "bug_count",
        r6("bug_rate").alias("bug_rate"),
    )
