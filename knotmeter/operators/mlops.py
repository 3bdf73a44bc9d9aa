"""Exported payloads of MLOps platforms, as relations.

Each function takes a DataFrame with a ``payload`` column of JSON text (one exported response per row).  A payload is
parsed once, as a VARIANT, whatever the kinds of items in it; what cannot be parsed is kept
apart, with the reason, instead of vanishing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For each platform the kinds of items, the list that holds them in a response, and the
#: fields that tell two items of the kind apart.
PLATFORMS = {
    "kubeflow": {
        "pipelines": ("$.pipelines", ["$.id"]),
        "experiments": ("$.experiments", ["$.id"]),
        "runs": ("$.runs", ["$.id"]),
    },
    "mlflow": {
        "experiments": ("$.experiments", ["$.experiment_id"]),
        "runs": ("$.runs", ["$.info.experiment_id", "$.info.run_id", "$.info.start_time"]),
        "models": ("$.registered_models", ["$.name"]),
    },
    "bentoml": {
        "bentos": ("$.bentos", ["$.name", "$.version"]),
        "models": ("$.models", ["$.name", "$.version"]),
    },
    "seldon": {
        "deployments": ("$.items", ["$.metadata.namespace", "$.metadata.name"]),
    },
}
#: The kinds that a collection counts.
COUNTED = {
    "kubeflow": ["pipelines", "experiments"],
    "mlflow": ["experiments", "runs", "models"],
    "bentoml": ["bentos", "models"],
    "seldon": ["deployments"],
}


def _reason(payload: Column, parsed: Column) -> Column:
    """Why a payload has no items at all, or null."""
    return (
        F.when(payload.isNull(), "missing")
        .when(parsed.isNull(), "not JSON")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
    )


def quarantined(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payload, reason`` of the rows that are no JSON object: missing, not JSON, not an object.

    A key given twice is not JSON; what follows the first value of a text is not looked at.
    """
    parsed = payloads.select(F.col(column).alias("payload"), F.try_parse_json(column).alias("parsed"))
    return parsed.select("payload", _reason(F.col("payload"), F.col("parsed")).alias("reason")).where("reason IS NOT NULL")


def _objects(exploded: DataFrame) -> DataFrame:
    """The elements that are objects, as ``item``; those of an object in place of a list would have keys."""
    items = exploded.where("key IS NULL").withColumnRenamed("value", "item").drop("pos", "key")
    return items.where(F.schema_of_variant("item").startswith("OBJECT"))


def payload_items(payloads: DataFrame, platform: str, *kinds: str) -> DataFrame:
    """``kind, item``: a row for each object in the lists of the platform, or of the kinds named; ``item`` is a VARIANT.

    All lists come out of one scan and one parse of the payloads.
    """
    lists = {k: at for k, (at, _) in PLATFORMS[platform].items() if not kinds or k in kinds}
    parsed = payloads.select(F.try_parse_json("payload").alias("parsed"))
    each = parsed.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.try_variant_get("parsed", at, "variant").alias("list")) for k, at in lists.items()
    ])))
    elements = payloads.sparkSession.tvf.variant_explode(F.col("list").outer())
    return _objects(each.lateralJoin(elements)).select("kind", "item")


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("item", path, kind)


def _key(platform: str, kind: str) -> Column:
    return F.array(*[_field(path) for path in PLATFORMS[platform][kind][1]])


def collected_items(payloads: DataFrame, platform: str) -> DataFrame:
    """``kind, key, value, copies``: each item once, as JSON text, with how often it was exported.

    Items of one kind with equal key fields are one; of different texts the smallest stands.  Payloads without
    items for a reason are rows of kind 'quarantine', their key is the reason and the text.
    """
    lists = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.try_variant_get("parsed", at, "variant").alias("list"))
        for k, (at, _) in PLATFORMS[platform].items()
    ])
    reason = _reason(F.col("payload"), F.col("parsed"))
    bad = F.array(F.struct(
        F.lit("quarantine").alias("kind"),
        F.to_variant_object(F.array(F.struct("reason", "payload"))).alias("list"),
    ))
    parsed = payloads.select("payload", F.try_parse_json("payload").alias("parsed")).withColumn("reason", reason)
    each = parsed.select(F.inline(F.when(F.col("reason").isNull(), lists).otherwise(bad)))
    elements = payloads.sparkSession.tvf.variant_explode(F.col("list").outer())
    items = _objects(each.lateralJoin(elements))
    keys = F.when(F.col("kind") == "quarantine", F.array(_field("$.reason"), _field("$.payload")))
    for kind in PLATFORMS[platform]:
        keys = keys.when(F.col("kind") == kind, _key(platform, kind))
    return items.select("kind", keys.alias("key"), F.to_json("item").alias("value")).groupBy("kind", "key").agg(
        F.min("value").alias("value"), F.count("*").alias("copies")
    )


def counted_items(platform: str) -> list[Column]:
    """Over ``collected_items``: the number of items of each kind that counts, and of payloads in quarantine."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in COUNTED[platform]]
    return [*kinds, F.coalesce(F.sum(F.when(F.col("kind") == "quarantine", F.col("copies"))), F.lit(0)).alias("quarantined")]


def item_counts(payloads: DataFrame, platform: str) -> DataFrame:
    """``kind, items``: a row for each kind that a collection counts, zeros included."""
    row = collected_items(payloads, platform).agg(*counted_items(platform))
    entries = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in COUNTED[platform]]
    return row.select(F.inline(F.array(*entries)))


def kubeflow_items(payloads: DataFrame) -> DataFrame:
    """(kind, id, name, file) of pipelines, experiments and runs, each once."""
    kind, id_, pipeline = F.col("kind"), _field("$.id"), _field("$.pipeline_id")
    file = (
        F.when(kind == "pipelines", F.concat(F.lit("pipelines/pipeline_"), id_, F.lit(".yaml")))
        .when(kind == "experiments", F.concat(F.lit("experiments/experiment_"), id_, F.lit(".json")))
        .otherwise(F.concat(F.lit("pipelines/pipeline_"), pipeline, F.lit("_runs.json")))
    )
    return payload_items(payloads, "kubeflow").select(
        F.regexp_replace(kind, "s$", "").alias("kind"), id_.alias("id"), _field("$.name").alias("name"), file.alias("file")
    ).distinct()


def mlflow_runs(payloads: DataFrame, max_results: int | None = None) -> DataFrame:
    """All runs of each experiment, newest first; ``max_results`` is the size of a page, if only one is wanted."""
    runs = payload_items(payloads, "mlflow", "runs").select(
        _field("$.info.run_id").alias("run_id"), _field("$.info.experiment_id").alias("experiment_id"),
        _field("$.info.start_time", "bigint").alias("start_time"),
    ).distinct()
    w = Window.partitionBy("experiment_id").orderBy(F.col("start_time").desc(), "run_id")
    ranked = runs.withColumn("rank", F.row_number().over(w))
    return ranked if max_results is None else ranked.where(F.col("rank") <= max_results)


def bentoml_items(payloads: DataFrame) -> DataFrame:
    """Bentos and models keyed by (name, version)."""
    return payload_items(payloads, "bentoml").select(
        F.regexp_replace("kind", "s$", "").alias("kind"), _field("$.name").alias("name"), _field("$.version").alias("version")
    ).distinct()


def seldon_models(payloads: DataFrame) -> DataFrame:
    """(deployment, namespace, model, predictor) for predictors with a graph name."""
    deployments = payload_items(payloads, "seldon").select(
        _field("$.metadata.name").alias("deployment"), _field("$.metadata.namespace").alias("namespace"),
        _field("$.spec.predictors", "variant").alias("list"),
    )
    predictors = payloads.sparkSession.tvf.variant_explode(F.col("list").outer())
    return (
        _objects(deployments.lateralJoin(predictors))
        .select("deployment", "namespace", _field("$.graph.name").alias("model"), _field("$.name").alias("predictor"))
        .where(F.col("model").isNotNull() & (F.col("model") != ""))
    )
