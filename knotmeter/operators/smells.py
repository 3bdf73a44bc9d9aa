"""Design smells around machine-learning models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import paths
from knotmeter.functions.matching import alternation, any_literal, count_matches, quoted
from knotmeter.operators.mentions import contains_pairs
from knotmeter.operators.services import relative_path, with_owners


def _named(services: DataFrame) -> DataFrame:
    return services.withColumnRenamed("name", "service")


def _is_loop() -> Column:
    stores = F.col("has_prediction") & F.col("has_storage")
    return F.col("is_python") & (stores | (F.col("is_training") & F.col("has_db_read")))


def service_facts(features: DataFrame, services: DataFrame) -> DataFrame:
    """Hits, lines and loops below each service that has any: one pass of all files up to their owners.

    What the whole-project figures need of :func:`direct_model_calls`, :func:`glue_code_by_service` and
    :func:`feedback_loop_counts` at once.
    """
    numbers = ["loading_hits", "prediction_hits", "glue_lines", "total_lines", "loops"]
    per_dir = (
        features.withColumns({"total_lines": F.col("code_lines"), "loops": _is_loop().cast("bigint")})
        .groupBy("project_id", "dir").agg(*[F.sum(n).alias(n) for n in numbers])
        .where(F.greatest(*numbers) > 0)
    )
    return (
        with_owners(per_dir, _named(services), "service")
        .groupBy("project_id", "service", F.col("owner_path").alias("path"))
        .agg(*[F.sum(n).alias(n) for n in numbers])
    )


def direct_model_calls(features: DataFrame, services: DataFrame) -> DataFrame:
    """Loading and prediction hits per service that has any."""
    per_dir = features.groupBy("project_id", "dir").agg(
        F.sum("loading_hits").alias("loading_hits"),
        F.sum("prediction_hits").alias("prediction_hits"),
    ).where(F.col("loading_hits") + F.col("prediction_hits") > 0)
    return (
        with_owners(per_dir, _named(services), "service")
        .groupBy("project_id", "service", F.col("owner_path").alias("path"))
        .agg(
            F.sum("loading_hits").alias("loading_hits"),
            F.sum("prediction_hits").alias("prediction_hits"),
        )
        .withColumn("hits", F.col("loading_hits") + F.col("prediction_hits"))
    )


def direct_model_call_summary(calls: DataFrame, services: DataFrame) -> DataFrame:
    total = services.groupBy("project_id").agg(F.count("*").alias("services_count"))
    direct = calls.groupBy("project_id").agg(F.count("*").alias("direct_count"))
    return total.join(direct, "project_id", "left").select(
        "project_id", "services_count",
        F.coalesce("direct_count", F.lit(0)).cast("bigint").alias("direct_count"),
        (F.coalesce("direct_count", F.lit(0)) / F.col("services_count")).alias("direct_ratio"),
    )


def direct_model_call_details(
    inventory: DataFrame, services: DataFrame, n: int = 5
) -> DataFrame:
    """The first n hits per service by file, rule and line, with their code."""
    table = [("loading", p) for p in rules.LOADING_PATTERNS] + [
        ("prediction", p) for p in rules.PREDICTION_PATTERNS
    ]
    any_rule = quoted(alternation([p for _, p in table]))
    numbered = (
        "explode(filter(transform(split(content, '\\n'), (code, i) -> "
        f"struct(bigint(i + 1) AS line, code)), s -> rlike(s.code, {any_rule})))"
    )
    counted = ", ".join(
        f"struct({i} AS ordinal, '{kind}' AS pattern, {count_matches('l.code', p)} AS n)"
        for i, (kind, p) in enumerate(table)
    )
    gated = F.expr(any_literal("content", rules.PREDICTION_GATE)).alias("gated")
    hits = (
        inventory.where(
            paths.has_extension(F.col("name"), rules.MODEL_CALL_CODE)
            & F.col("content").isNotNull()
        )
        .select("project_id", "dir", "path", gated, F.expr(numbered).alias("l"))
        .select("project_id", "dir", "path", "gated", "l", F.expr(f"explode(array({counted}))").alias("h"))
        .where((F.col("h.n") > 0) & ((F.col("h.pattern") == "loading") | F.col("gated")))
        .select(
            "project_id", "dir", "path", "h.ordinal", "h.pattern",
            F.col("l.line").alias("line"), F.trim("l.code").alias("code"),
            F.explode(F.sequence(F.lit(1), F.col("h.n").cast("int"))).alias("occurrence"),
        )
    )
    order = ["path", "ordinal", "line", "occurrence"]
    in_dir = Window.partitionBy("project_id", "dir").orderBy(*order)
    in_service = Window.partitionBy("project_id", "owner_path").orderBy(*order)
    leading = hits.withColumn("rank", F.row_number().over(in_dir)).where(F.col("rank") <= n)
    return (
        with_owners(leading, _named(services), "service")
        .withColumn("rank", F.row_number().over(in_service))
        .where(F.col("rank") <= n)
        .select(
            "project_id", "service", F.col("owner_path").alias("service_path"), "rank",
            relative_path(F.col("path"), F.col("owner_path")).alias("file"),
            "line", "pattern", "code",
        )
    )


def glue_code_by_service(features: DataFrame, services: DataFrame) -> DataFrame:
    """Glue lines against all lines per service; services without lines are left out."""
    per_dir = features.groupBy("project_id", "dir").agg(
        F.sum("glue_lines").alias("glue_lines"), F.sum("code_lines").alias("total_lines")
    ).where(F.col("total_lines") > 0)
    return (
        with_owners(per_dir, _named(services), "service")
        .groupBy("project_id", "service", F.col("owner_path").alias("path"))
        .agg(F.sum("glue_lines").alias("glue_lines"), F.sum("total_lines").alias("total_lines"))
        .withColumn("ratio", F.col("glue_lines") / F.col("total_lines"))
    )


def glue_code_ratio(glue_by_service: DataFrame) -> DataFrame:
    """Project ratio; a file of nested services counts once for each of them."""
    return glue_by_service.groupBy("project_id").agg(
        F.sum("glue_lines").alias("glue_lines"), F.sum("total_lines").alias("total_lines"),
        (F.sum("glue_lines") / F.sum("total_lines")).alias("glue_ratio"),
    )


def consumer_code() -> Column:
    """Files searched for models: by name for consumers, by lower-cased extension
    for change impact; :func:`consumers_only` tells them apart again."""
    by_name = paths.has_extension(F.col("name"), rules.CONSUMER_CODE)
    return (by_name | F.col("extension").isin(rules.CONSUMER_CODE)) & F.col("content").isNotNull()


def consumers_only(mentions: DataFrame) -> DataFrame:
    return mentions.where(paths.has_extension(F.col("name"), rules.CONSUMER_CODE))


def model_mentions(inventory: DataFrame, models: DataFrame) -> DataFrame:
    """(file, model name) for code that contains the name, with the last such line."""
    code = inventory.where(consumer_code()).select(
        "project_id", "dir", "path", "name", "extension", "ignored", "content"
    )
    return contains_pairs(
        code, models.select("project_id", F.col("name").alias("needle"))
    ).withColumnRenamed("needle", "model")


def declared_consumers(
    inventory: DataFrame, services: DataFrame, models: DataFrame
) -> DataFrame:
    """(model, consumer): the service's README names the model without its suffix."""
    readmes = inventory.where(
        F.col("path").rlike(r"(?:^|/)(?:README\.md|README\.txt)$") & F.col("content").isNotNull()
    )
    beside = F.when(F.col("name").isin("README.md", "README.txt"), F.col("dir"))
    # docs/README.md documents the directory above docs
    in_docs = F.when(
        (F.col("name") == "README.md") & F.col("dir").rlike(r"(?:^|/)docs$"),
        paths.dir_of(F.col("dir")),
    )
    texts = readmes.select(
        "project_id", beside.alias("beside"), in_docs.alias("in_docs"),
        F.lower("content").alias("content"),
    )
    stem = F.lower(F.replace(F.replace("name", F.lit(".pkl"), F.lit("")), F.lit(".h5"), F.lit("")))
    stems = models.select("project_id", F.col("name").alias("model"), stem.alias("needle")).distinct()
    named = (
        contains_pairs(texts, stems)
        .select(
            "project_id", "needle",
            F.explode(F.array("beside", "in_docs")).alias("path"),
        )
        .where(F.col("path").isNotNull())
        .distinct()
    )
    owners = services.select("project_id", "path", F.col("name").alias("consumer"))
    return (
        named.join(owners, ["project_id", "path"])
        .join(stems, ["project_id", "needle"])
        .select("project_id", "model", "consumer")
        .distinct()
    )


def actual_consumers(mentions: DataFrame, services: DataFrame) -> DataFrame:
    """(model, consumer) with the last file and line that mention the model."""
    last = F.max(F.struct("path", "last_line", "last_code")).alias("last")
    per_dir = consumers_only(mentions).groupBy("project_id", "dir", "model").agg(last)
    best = F.max(F.struct("last.path", "last.last_line", "last.last_code", "owner_path"))
    return (
        with_owners(per_dir, services.withColumnRenamed("name", "consumer"), "consumer")
        .groupBy("project_id", "model", "consumer")
        .agg(best.alias("b"))
        .select(
            "project_id", "model", "consumer",
            relative_path(F.col("b.path"), F.col("b.owner_path")).alias("file"),
            F.col("b.last_line").alias("line"), F.col("b.last_code").alias("code"),
        )
    )


def hidden_consumers(actual: DataFrame, declared: DataFrame) -> DataFrame:
    return actual.join(declared, ["project_id", "model", "consumer"], "left_anti").select(
        "project_id", "model", "consumer", F.lit("undocumented").alias("type"), "file", "line"
    )


def impact_of_consumers(actual: DataFrame, models: DataFrame) -> DataFrame:
    """:func:`impact_radius` from the consumers that :func:`actual_consumers` has found."""
    used = actual.groupBy("project_id", "model").agg(F.count("*").alias("services"))
    names = models.select("project_id", F.col("name").alias("model")).distinct()
    return names.join(used, ["project_id", "model"], "left").select(
        "project_id", "model", F.coalesce("services", F.lit(0)).cast("bigint").alias("impact_radius")
    )


def impact_radius(mentions: DataFrame, services: DataFrame, models: DataFrame) -> DataFrame:
    """Distinct service names whose code mentions each model name; 0 if none."""
    per_dir = consumers_only(mentions).select("project_id", "dir", "model").distinct()
    used = (
        with_owners(per_dir, _named(services), "service")
        .select("project_id", "model", "service").distinct()
        .groupBy("project_id", "model").agg(F.count("*").alias("services"))
    )
    names = models.select("project_id", F.col("name").alias("model")).distinct()
    return names.join(used, ["project_id", "model"], "left").select(
        "project_id", "model",
        F.coalesce("services", F.lit(0)).cast("bigint").alias("impact_radius"),
    )


def retrain_events(features: DataFrame) -> DataFrame:
    """Training scripts that are scheduled or triggered."""
    return features.where(F.col("has_schedule") | F.col("has_trigger")).select(
        "project_id", F.col("path").alias("file"), "has_schedule", "has_trigger",
        F.when(F.col("has_schedule"), F.lit("scheduled")).otherwise(F.lit("triggered")).alias("reason"),
    )


def feedback_loops(features: DataFrame, services: DataFrame) -> DataFrame:
    """Python files that store predictions or train on stored data, per service."""
    files = features.where(_is_loop()).select(
        "project_id", "dir", "path",
        F.when(F.col("has_prediction"), F.lit("prediction_to_storage"))
        .otherwise(F.lit("training_from_prod")).alias("type"),
    )
    return with_owners(files, _named(services), "service").select(
        "project_id", "service", F.col("owner_path").alias("service_path"),
        relative_path(F.col("path"), F.col("owner_path")).alias("file"), "type",
    )


def feedback_loop_counts(features: DataFrame, services: DataFrame) -> DataFrame:
    """Loops per service without listing the files (reduced per directory first)."""
    per_dir = (
        features.where(_is_loop())
        .groupBy("project_id", "dir").agg(F.count("*").alias("loops"))
    )
    return (
        with_owners(per_dir, _named(services), "service")
        .groupBy("project_id", "service", F.col("owner_path").alias("path"))
        .agg(F.sum("loops").alias("loops"))
    )


def feature_imports(features: DataFrame, services: DataFrame) -> DataFrame:
    """Distinct (module, service name) pairs."""
    per_dir = features.where("is_python").select(
        "project_id", "dir", F.explode("imports").alias("module")
    ).distinct()
    return (
        with_owners(per_dir, _named(services), "service")
        .select("project_id", "module", "service").distinct()
    )


def shared_features(features: DataFrame, services: DataFrame) -> DataFrame:
    """Modules imported by more than one service, with the number of services.

    The services themselves are the rows of :func:`feature_imports`; they are not
    collected into one array because a popular module has no bound on them.
    """
    return (
        feature_imports(features, services)
        .groupBy("project_id", "module")
        .agg(F.count("*").alias("services"))
        .where(F.col("services") > 1)
    )


def service_model_matrix(mentions: DataFrame, services: DataFrame) -> DataFrame:
    """The cells that are 1 in the service x model matrix (all others are 0)."""
    per_dir = consumers_only(mentions).select("project_id", "dir", "model").distinct()
    return (
        with_owners(per_dir, _named(services), "service")
        .select("project_id", "service", "model", F.lit(1).alias("depends")).distinct()
    )
