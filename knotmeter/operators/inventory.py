"""File inventory: filters, languages, project types, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import paths, text
from knotmeter.functions.matching import (
    any_literal, count_literals, labels_where, lookup, quoted, sum_of, text_array,
)


def file_inventory(files: DataFrame, ignore: list[str] = rules.IGNORE_GLOBS) -> DataFrame:
    """Every file with dir, name, extension and two ignore flags.

    ``ignored`` prunes whole ignored directories; ``name_ignored`` looks at the
    file's own name only.  Inventory operators keep ``~ignored`` rows, content
    walks over services and pipelines see all rows.
    """
    name = paths.base_name(F.col("path"))
    return files.withColumns(
        {
            "dir": paths.dir_of(F.col("path")),
            "name": name,
            "extension": paths.extension_of(name),
            "ignored": paths.path_ignored(F.col("path"), ignore),
            "name_ignored": paths.name_matches(name, ignore),
        }
    )


def find_files(inventory: DataFrame, glob: str = "*", recursive: bool = True) -> DataFrame:
    found = inventory.where(paths.name_matches(F.col("name"), [glob]))
    return found if recursive else found.where(F.col("dir") == ".")


def kept(inventory: DataFrame) -> DataFrame:
    return inventory.where(~F.col("ignored"))


def _first_language(catalogue: dict[str, list[str]], by_name: bool = True) -> str:
    """Language whose list holds the extension or exact name; the first one wins."""
    rank_of: dict[str, str] = {}
    for i, entries in enumerate(catalogue.values()):
        for entry in entries:
            rank_of.setdefault(entry, str(i))
    keys = ["extension", "name"] if by_name else ["extension"]
    ranks = ", ".join(f"int({lookup(k, rank_of)})" for k in keys)
    rank = f"least({ranks})" if by_name else ranks
    return f"CASE WHEN extension <> '' THEN get({text_array(list(catalogue))}, {rank}) END"


def file_language(
    inventory: DataFrame, catalogue: dict[str, list[str]] = rules.LANGUAGE_FILES
) -> DataFrame:
    """One row per kept file with a known language (first match in catalogue order)."""
    return (
        kept(inventory)
        .select("project_id", "path", F.expr(_first_language(catalogue)).alias("language"))
        .where(F.col("language").isNotNull())
    )


def language_counts(
    inventory: DataFrame, catalogue: dict[str, list[str]] = rules.LANGUAGE_FILES
) -> DataFrame:
    return (
        file_language(inventory, catalogue)
        .groupBy("project_id", "language")
        .agg(F.count("*").alias("files"))
    )


def _language_order(catalogue) -> Column:
    return F.expr(
        f"int({lookup('language', {lang: str(i) for i, lang in enumerate(catalogue)})})"
    )


def primary_language(
    inventory: DataFrame, catalogue: dict[str, list[str]] = rules.LANGUAGE_FILES
) -> DataFrame:
    """The language with most files; catalogue order breaks ties; 'Unknown' if none."""
    best = (
        language_counts(inventory, catalogue)
        .groupBy("project_id")
        .agg(
            F.max_by("language", F.struct("files", (-_language_order(catalogue)).alias("o"))).alias(
                "language"
            )
        )
    )
    return (
        inventory.select("project_id").distinct().join(best, "project_id", "left")
        .select("project_id", F.coalesce("language", F.lit("Unknown")).alias("language"))
    )


def language_hits(
    inventory: DataFrame, catalogue: dict = rules.DETECTOR_LANGUAGES
) -> DataFrame:
    """A row per (file, language) credit: one for the extension (first language
    only) and one for each language with an indicator inside the file name."""
    by_extension = _first_language({lang: ext for lang, (ext, _) in catalogue.items()}, False)
    by_name = [
        f"CASE WHEN {any_literal('name', indicators)} THEN {quoted(lang)} END"
        for lang, (_, indicators) in catalogue.items()
        if indicators
    ]
    credits = f"filter(array({', '.join([by_extension, *by_name])}), x -> x IS NOT NULL)"
    return inventory.select("project_id", "path", F.expr(f"explode({credits})").alias("language"))


def language_stats(inventory: DataFrame, catalogue: dict = rules.DETECTOR_LANGUAGES) -> DataFrame:
    return (
        language_hits(inventory, catalogue)
        .groupBy("project_id", "language")
        .agg(F.count("*").alias("files"))
    )


def primary_language_share(
    inventory: DataFrame, catalogue: dict = rules.DETECTOR_LANGUAGES
) -> DataFrame:
    """Top language with its count and share of all files (may pass 100 %)."""
    order = _language_order(catalogue)
    top = (
        language_stats(inventory, catalogue)
        .groupBy("project_id")
        .agg(F.max(F.struct("files", (-order).alias("o"), "language")).alias("top"))
    )
    totals = inventory.groupBy("project_id").agg(F.count("*").alias("total_files"))
    percentage = F.bround(F.col("top.files") / F.col("total_files") * 100, 1)
    return totals.join(top, "project_id").select(
        "project_id",
        F.col("top.language").alias("language"),
        F.col("top.files").alias("files"),
        "total_files",
        percentage.alias("percentage"),
    )


def _long_scores(wide: DataFrame, names: list[str]) -> DataFrame:
    cells = ", ".join(
        f"struct({quoted(n)} AS project_type, {i} AS ordinal, s{i} AS score)"
        for i, n in enumerate(names)
    )
    return wide.select("project_id", F.expr(f"inline(array({cells}))")).where("score > 0")


def project_type_scores(
    inventory: DataFrame, catalogue: dict[str, list[str]] = rules.PROJECT_TYPE_PATTERNS
) -> DataFrame:
    """Score per type: one per (pattern, kept file) whose path holds the pattern,
    two more for each pattern that exists as a path from the project root."""

    def exists(pattern: str) -> str:
        found = f"startswith(path, {quoted(pattern.rstrip('/') + '/')})"
        if not pattern.endswith("/"):
            found += f" OR path = {quoted(pattern)}"
        return f"2 * int(bool_or({found}))"

    wide = inventory.groupBy("project_id").agg(
        *[
            F.expr(
                f"sum(CASE WHEN ignored THEN 0 ELSE {count_literals('path', patterns)} END)"
                f" + {sum_of([exists(p) for p in patterns])}"
            ).alias(f"s{i}")
            for i, patterns in enumerate(catalogue.values())
        ]
    )
    return _long_scores(wide, list(catalogue))


def best_type(scores: DataFrame, projects: DataFrame) -> DataFrame:
    best = scores.groupBy("project_id").agg(
        F.max_by("project_type", F.struct("score", (-F.col("ordinal")).alias("o"))).alias(
            "project_type"
        ),
        F.max("score").alias("score"),
    )
    return projects.join(best, "project_id", "left").select(
        "project_id",
        F.coalesce("project_type", F.lit("Unknown")).alias("project_type"),
        F.coalesce("score", F.lit(0)).cast("bigint").alias("score"),
    )


def project_type(inventory: DataFrame, catalogue=rules.PROJECT_TYPE_PATTERNS) -> DataFrame:
    return best_type(
        project_type_scores(inventory, catalogue), inventory.select("project_id").distinct()
    )


def detector_project_type_scores(
    inventory: DataFrame, catalogue: dict[str, list[str]] = rules.DETECTOR_PROJECT_TYPES
) -> DataFrame:
    """One per (indicator, file) hit; 'Full Stack' gets 2 for Python plus JavaScript."""
    wide = inventory.groupBy("project_id").agg(
        *[
            F.expr(f"sum({count_literals('path', patterns)})").alias(f"s{i}")
            for i, patterns in enumerate(catalogue.values())
        ]
    )
    mixed = language_stats(inventory).groupBy("project_id").agg(
        (F.count_if(F.col("language").isin("Python", "JavaScript")) == 2).alias("both")
    )
    names = [*catalogue, "Full Stack"]
    wide = wide.join(mixed, "project_id", "left").withColumn(
        f"s{len(catalogue)}", F.when(F.col("both"), F.lit(2)).otherwise(F.lit(0)).cast("bigint")
    )
    return _long_scores(wide, names)


def detector_project_type(inventory: DataFrame) -> DataFrame:
    """Best type; the confidence is 100 as soon as anything scores, else 0."""
    best = best_type(
        detector_project_type_scores(inventory), inventory.select("project_id").distinct()
    )
    return best.withColumn(
        "confidence", F.when(F.col("score") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    )


def project_types(
    inventory: DataFrame, services: DataFrame, models: DataFrame, pipelines: DataFrame
) -> DataFrame:
    """Array of types from six yes/no rules per project."""
    name, path = F.col("name"), F.col("path")
    flags = kept(inventory).groupBy("project_id").agg(
        F.bool_or(name.contains("package.json")).alias("pkg"),
        F.bool_or(name.endswith(".html")).alias("html"),
        F.bool_or(name.contains("train.py")).alias("train"),
        F.bool_or(path.contains("pipeline")).alias("pipe"),
        F.bool_or(name.isin("app.py", "main.py", "server.js", "api.py")).alias("api"),
        F.bool_or(name.isin("setup.py", "__init__.py")).alias("lib"),
    )
    for label, df in (("services", services), ("models", models), ("pipelines", pipelines)):
        flags = flags.join(
            df.groupBy("project_id").agg(F.count("*").alias(label)), "project_id", "left"
        )
    labels = [
        ("services > 1", "Microservices"),
        ("pkg AND html", "Web Application"),
        ("models > 0 OR train", "Machine Learning"),
        ("pipelines > 0 OR pipe", "Data Pipeline"),
        ("api", "API Service"),
        ("lib", "Library/Package"),
    ]
    return flags.fillna(0, ["services", "models", "pipelines"]).select(
        "project_id", F.expr(labels_where(labels)).alias("project_types")
    )


def build_systems(
    inventory: DataFrame, catalogue: dict[str, list[str]] = rules.BUILD_SYSTEMS
) -> DataFrame:
    wide = inventory.groupBy("project_id").agg(
        *[
            F.expr(f"int(bool_or({any_literal('path', indicators)}))").alias(f"s{i}")
            for i, indicators in enumerate(catalogue.values())
        ]
    )
    return _long_scores(wide, list(catalogue)).select(
        "project_id", F.col("project_type").alias("build_system")
    )


def categorize_files(inventory: DataFrame) -> DataFrame:
    """Tag each kept file as model, docker and/or config."""
    tags = F.array(
        F.when(F.col("extension").isin(rules.SCANNER_MODEL_EXTENSIONS), F.lit("model")),
        F.when(F.col("name").isin(rules.DOCKER_FILES), F.lit("docker")),
        F.when(F.col("extension").isin(rules.CONFIG_EXTENSIONS), F.lit("config")),
    )
    return kept(inventory).select(
        "project_id", "path", F.filter(tags, lambda t: t.isNotNull()).alias("tags")
    )


def file_statistics(inventory: DataFrame) -> DataFrame:
    """Files and bytes per extension, plus a total row (``extension`` 'all')."""
    ext = F.when(F.col("extension") == "", F.lit("no_extension")).otherwise(F.col("extension"))
    grouped = (
        kept(inventory)
        .withColumn("ext", ext)
        .rollup("project_id", "ext")
        .agg(
            F.count("*").alias("total_files"),
            F.sum("size").alias("total_size"),
            F.grouping("ext").alias("is_total"),
            F.grouping("project_id").alias("is_grand"),
        )
        .where(F.col("is_grand") == 0)
    )
    return grouped.select(
        "project_id",
        F.when(F.col("is_total") == 1, F.lit("all")).otherwise(F.col("ext")).alias("extension"),
        "total_files",
        "total_size",
        F.bround(F.col("total_size") / (1024 * 1024), 2).alias("total_size_mb"),
        text.human_size(F.col("total_size")).alias("total_size_hr"),
    )


def inventory_counts(
    inventory: DataFrame, services: DataFrame, models: DataFrame, pipelines: DataFrame
) -> DataFrame:
    """Project totals beside the numbers of services, models, pipelines, configs, dockers."""
    out = kept(inventory).groupBy("project_id").agg(
        F.count("*").alias("total_files"),
        F.sum("size").alias("total_size"),
        F.count_if(F.col("extension").isin(rules.CONFIG_EXTENSIONS)).alias("config_files_count"),
        F.count_if(F.col("name").isin(rules.DOCKER_FILES)).alias("docker_files_count"),
    )
    for label, df in (("services", services), ("models", models), ("pipelines", pipelines)):
        counted = df.groupBy("project_id").agg(F.count("*").alias(label + "_count"))
        out = out.join(counted, "project_id", "left").fillna(0, [label + "_count"])
    return out


def directory_stats(inventory: DataFrame) -> DataFrame:
    """Files, directories and bytes of the whole tree (nothing pruned)."""
    dirs = (
        inventory.select("project_id", "dir").distinct()
        .select("project_id", F.explode(paths.ancestor_dirs("dir")).alias("d"))
        .where(F.col("d") != ".")
        .distinct()
        .groupBy("project_id")
        .agg(F.count("*").alias("total_dirs"))
    )
    totals = inventory.groupBy("project_id").agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_size")
    )
    return totals.join(dirs, "project_id", "left").select(
        "project_id", "total_files",
        F.coalesce("total_dirs", F.lit(0)).cast("bigint").alias("total_dirs"),
        "total_size", text.human_size(F.col("total_size"), short=True).alias("total_size_hr"),
    )


def extreme_files(inventory: DataFrame, n: int = 10) -> DataFrame:
    """The n largest, newest and oldest files of each project, ranked."""
    orders = {
        "largest": [F.col("size").desc(), F.col("path")],
        "newest": [F.col("modified").desc(), F.col("path")],
        "oldest": [F.col("modified").asc(), F.col("path")],
    }
    parts = []
    for label, order in orders.items():
        w = Window.partitionBy("project_id").orderBy(*order)
        parts.append(
            inventory.select("project_id", "path", "size", "modified")
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n)
            .withColumn("list", F.lit(label))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def directory_size(
    inventory: DataFrame, ignore: list[str] = rules.SCANNER_IGNORE_GLOBS
) -> DataFrame:
    """Bytes per project outside ignored directories (ignored file names count)."""
    pruned = paths.path_ignored(F.concat(F.col("dir"), F.lit("/")), ignore)
    return inventory.where(~pruned).groupBy("project_id").agg(F.sum("size").alias("size"))


def directory_tree(inventory: DataFrame, max_depth: int = 3) -> DataFrame:
    """Directories and files down to ``max_depth``, each once, with kind and depth."""
    dirs = inventory.select("project_id", "dir").distinct().select(
        "project_id", F.explode(paths.ancestor_dirs("dir")).alias("path")
    ).where(F.col("path") != ".").distinct().withColumn("kind", F.lit("dir"))
    leaves = inventory.select("project_id", "path").withColumn("kind", F.lit("file"))
    return (
        dirs.unionByName(leaves)
        .withColumn("depth", (F.size(F.split("path", "/")) - 1).cast("bigint"))
        .where(F.col("depth") <= max_depth)
    )


def file_details(inventory: DataFrame, algorithm: str = "md5") -> DataFrame:
    """Per kept file: readable size, content hash, and line count of code files."""
    return kept(inventory).select(
        "project_id", "path", "size",
        text.human_size(F.col("size"), short=True).alias("size_hr"),
        text.file_hash(F.col("content"), algorithm).alias("hash"),
        F.when(
            paths.has_extension(F.col("name"), rules.LINE_COUNT_CODE),
            text.line_count(F.col("content")),
        ).alias("lines"),
    )
