"""Services, pipelines, and attributing files to the directories that own them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import paths
from knotmeter.functions.matching import any_of, quoted, quoted_list
from knotmeter.operators.mentions import contains_pairs


def _language(chain, extension_chain=()) -> Column:
    """First link of the chain found among the direct children of the directory."""
    cases = [
        (any_of([f"array_contains(markers, {quoted(m)})" for m in markers]), language)
        for markers, language in chain
    ] + [(f"ext{i}", language) for i, (_, language) in enumerate(extension_chain)]
    whens = " ".join(f"WHEN {c} THEN {quoted(language)}" for c, language in cases)
    return F.expr(f"CASE {whens} ELSE 'Unknown' END")


def detect_services(
    inventory: DataFrame,
    indicators: list[str] = rules.SERVICE_INDICATORS,
    language_chain: list = rules.SERVICE_LANGUAGE_CHAIN,
    extension_chain: list = (),
) -> DataFrame:
    """Directories holding an indicator file, unless a directory strictly between
    them and the project root holds one too (the root itself suppresses nothing)."""
    name = F.col("name")
    markers = sorted({m for names, _ in language_chain for m in names})
    aggregates = [
        F.collect_set(F.when(name.isin(indicators), name)).alias("found"),
        F.collect_set(F.when(name.isin(markers), name)).alias("markers"),
        F.count_if(~F.col("name_ignored")).alias("file_count"),
        F.bool_or(name == "Dockerfile").alias("has_docker"),
        F.bool_or(name.isin("requirements.txt", "package.json")).alias("has_requirements"),
    ] + [F.bool_or(name.endswith(e)).alias(f"ext{i}") for i, (e, _) in enumerate(extension_chain)]
    candidates = (
        inventory.groupBy("project_id", F.col("dir").alias("path"))
        .agg(*aggregates)
        .where(F.size("found") > 0)
        .select(
            "project_id",
            F.when(F.col("path") == ".", F.col("project_id"))
            .otherwise(paths.base_name(F.col("path")))
            .alias("name"),
            "path",
            _language(language_chain, extension_chain).alias("language"),
            F.expr(f"array_intersect(array({quoted_list(indicators)}), found)").alias("indicators"),
            "file_count",
            "has_docker",
            "has_requirements",
        )
    )
    return services_top_level(candidates)


def detect_services_scanner(inventory: DataFrame) -> DataFrame:
    return detect_services(
        inventory,
        rules.SCANNER_SERVICE_INDICATORS,
        rules.SCANNER_SERVICE_LANGUAGE_CHAIN,
        rules.SCANNER_SERVICE_EXTENSION_CHAIN,
    )


def services_top_level(candidates: DataFrame) -> DataFrame:
    chain = paths.ancestor_dirs("path")
    between = F.when(F.size(chain) > 2, F.slice(chain, F.lit(2), F.size(chain) - 2)).otherwise(
        F.array().cast("array<string>")
    )
    above = candidates.select("project_id", "path", F.explode(between).alias("parent"))
    parents = candidates.select("project_id", F.col("path").alias("parent"))
    nested = above.join(parents, ["project_id", "parent"], "left_semi").select("project_id", "path")
    return candidates.join(nested, ["project_id", "path"], "left_anti")


#: Groups into which the rows of a project's root owner are dealt.
ROOT_SALTS = 64


def owner_keys(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` once for each directory that may own them, as (project_id, owner_path, owner_salt).

    These are the directory and those above it.  The root stands above every row of a project, so it is
    a key only where the project has an owner there, and then as one of ROOT_SALTS keys; whether it has
    is a flag for each project, of which Spark sends out the list if it is small.
    """
    rooted = owners.where(F.col("path") == ".").select("project_id", F.lit(True).alias("_rooted"))
    salt = (F.pmod(F.xxhash64(*rows.columns), F.lit(ROOT_SALTS)) + 1).cast("int")
    above = F.filter(paths.ancestor_dirs("dir"), lambda d: d != ".")
    keys = F.transform(above, lambda d: F.struct(d.alias("owner_path"), F.lit(0).alias("owner_salt")))
    root = F.array(F.struct(F.lit(".").alias("owner_path"), salt.alias("owner_salt")))
    return (
        rows.join(rooted, "project_id", "left")
        .select(*rows.columns, F.inline(F.when(F.col("_rooted"), F.concat(keys, root)).otherwise(keys)))
    )


def with_owners(rows: DataFrame, owners: DataFrame, *columns: str) -> DataFrame:
    """Attribute rows keyed (project_id, dir) to each owner directory above them.

    ``owners`` needs (project_id, path), a row for each, and the columns named.  The prefix test
    becomes an equi-join on the directories above, so callers should
    reduce ``rows`` per directory first.
    """
    salts = F.when(F.col("path") == ".", F.sequence(F.lit(1), F.lit(ROOT_SALTS))).otherwise(F.array(F.lit(0)))
    spread_owners = owners.select(
        "project_id", F.col("path").alias("owner_path"), *columns, F.explode(salts).alias("owner_salt")
    )
    return owner_keys(rows, owners).join(spread_owners, ["project_id", "owner_path", "owner_salt"]).drop("owner_salt")


def files_below(files: DataFrame, owners: DataFrame, *columns: str) -> DataFrame:
    """Every (owner, file) pair, as ``with_owners``, for listings of files that hold no content.

    Owners are found for directories, of which there are fewer than files; files then join by directory.
    """
    owned = with_owners(files.select("project_id", "dir").distinct(), owners, *columns)
    return files.join(owned, ["project_id", "dir"])


def files_in_services(inventory: DataFrame, services: DataFrame) -> DataFrame:
    """Every (service, file) pair; a file of nested services appears once for each."""
    files = inventory.select("project_id", "dir", "path", "size")
    return files_below(files, services.withColumnRenamed("name", "service"), "service").select(
        "project_id", "service", "owner_path", "path", "size"
    )


def pipeline_files(
    inventory: DataFrame, pipelines: DataFrame, code: list[str] = rules.PIPELINE_CODE
) -> DataFrame:
    """All code files of each pipeline, a row for each; ``detect_pipelines`` names the first few."""
    files = inventory.where(paths.has_extension(F.col("name"), code)).select("project_id", "dir", "path")
    return files_below(files, pipelines, "name").select(
        "project_id", "name", F.col("owner_path").alias("path"),
        relative_path(F.col("path"), F.col("owner_path")).alias("file"),
    )


def pipeline_files_scanner(inventory: DataFrame, pipelines: DataFrame) -> DataFrame:
    return pipeline_files(inventory, pipelines, rules.SCANNER_PIPELINE_CODE)


def relative_path(path: Column, owner: Column) -> Column:
    return F.when(owner == ".", path).otherwise(
        F.substring(path, F.length(owner) + 2, F.length(path))
    )


def detect_pipelines(
    inventory: DataFrame,
    globs: list[str] = rules.PIPELINE_GLOBS,
    code: list[str] = rules.PIPELINE_CODE,
    keep_empty: bool = False,
    max_files: int = 10,
    list_files: bool = True,
) -> DataFrame:
    """Directories whose name, or a direct file's name, matches a pipeline glob.

    ``stages`` counts code files anywhere below; ``files`` names the first few by
    path, as the definition has it, and :func:`pipeline_files` has them all; without ``list_files`` the column is left out.  Directories without
    code files are dropped unless ``keep_empty``.
    """
    per_dir = inventory.groupBy("project_id", "dir").agg(
        F.bool_or(paths.name_matches(F.lower("name"), globs)).alias("by_file"),
        F.count_if(paths.has_extension(F.col("name"), code)).alias("code_files"),
    )
    by_file = per_dir.where("by_file").select("project_id", F.col("dir").alias("path"))
    all_dirs = per_dir.select(
        "project_id", F.explode(paths.ancestor_dirs("dir")).alias("path")
    ).distinct()
    own_name = F.when(F.col("path") == ".", F.col("project_id")).otherwise(
        paths.base_name(F.col("path"))
    )
    by_name = all_dirs.where(paths.name_matches(F.lower(own_name), globs))
    candidates = by_file.unionByName(by_name).distinct()
    stages = (
        with_owners(per_dir.where(F.col("code_files") > 0), candidates)
        .groupBy("project_id", F.col("owner_path").alias("path"))
        .agg(F.sum("code_files").alias("stages"))
    )
    joined = candidates.join(stages, ["project_id", "path"], "left" if keep_empty else "inner")
    found = [
        "project_id", own_name.alias("name"), "path", F.coalesce("stages", F.lit(0)).cast("bigint").alias("stages"),
    ]
    if not list_files:
        return joined.select(*found)
    # only the first files of a directory can be among the first of a pipeline
    in_dir = Window.partitionBy("project_id", "dir").orderBy("path")
    in_pipeline = Window.partitionBy("project_id", "owner_path").orderBy("path")
    leading = (
        inventory.where(paths.has_extension(F.col("name"), code))
        .select("project_id", "dir", "path")
        .withColumn("rn", F.row_number().over(in_dir))
        .where(F.col("rn") <= max_files)
    )
    listed = (
        with_owners(leading, candidates)
        .withColumn("rn", F.row_number().over(in_pipeline))
        .where(F.col("rn") <= max_files)
        .groupBy("project_id", F.col("owner_path").alias("path"))
        .agg(F.array_sort(F.collect_list("path")).alias("files"))
    )
    return joined.join(listed, ["project_id", "path"], "left").select(
        *found, F.coalesce("files", F.array().cast("array<string>")).alias("files")
    )


def detect_pipelines_scanner(inventory: DataFrame) -> DataFrame:
    return detect_pipelines(
        inventory, rules.SCANNER_PIPELINE_GLOBS, rules.SCANNER_PIPELINE_CODE, True, 20
    )


def pipeline_complexity(pipelines: DataFrame, features: DataFrame) -> DataFrame:
    """stages x branching factor; complex beyond 5 stages or a factor of 2."""
    per_dir = (
        features.where("is_python")
        .groupBy("project_id", "dir")
        .agg(F.sum("branches").alias("branches"), F.count("*").alias("py_files"))
    )
    below = (
        with_owners(per_dir, pipelines)
        .groupBy("project_id", F.col("owner_path").alias("path"))
        .agg(F.sum("branches").alias("branches"), F.sum("py_files").alias("py_files"))
    )
    factor = F.bround(
        F.coalesce(F.col("branches"), F.lit(0))
        / F.greatest(F.coalesce(F.col("py_files"), F.lit(0)), F.lit(1)) + 1, 2,
    )
    return (
        pipelines.join(below, ["project_id", "path"], "left")
        .withColumn("branching_factor", factor)
        .select(
            "project_id", "name", "path", "stages", "branching_factor",
            (F.col("stages") * F.col("branching_factor")).alias("complexity"),
            ((F.col("stages") > 5) | (F.col("branching_factor") > 2)).alias("is_complex"),
        )
    )


def pipeline_complexity_scanner(pipelines: DataFrame, features: DataFrame) -> DataFrame:
    """1 + a tenth per branch or loop, a fifth per function, a half per branching file."""
    per_dir = (
        features.where("is_python")
        .groupBy("project_id", "dir")
        .agg(
            F.sum("flow_words").alias("flow"),
            F.sum("defs").alias("defs"),
            F.count_if("mentions_branching").alias("branching_files"),
        )
    )
    below = (
        with_owners(per_dir, pipelines)
        .groupBy("project_id", F.col("owner_path").alias("path"))
        .agg(*[F.sum(c).alias(c) for c in ("flow", "defs", "branching_files")])
    )
    # tenths as whole numbers, so the sum does not depend on the order of rows
    tenths = F.col("flow") + F.col("defs") * 2 + F.col("branching_files") * 5
    return pipelines.join(below, ["project_id", "path"], "left").select(
        "project_id", "name", "path", "stages",
        F.bround(F.lit(1.0) + F.coalesce(tenths, F.lit(0)) / 10, 2).alias("complexity"),
    )


def compose_attach(services: DataFrame, compose: DataFrame) -> DataFrame:
    """Compose entries of a service: same name, or compose name inside the path.

    Also lists the volumes that mention a model or ML mount.
    """
    in_path = contains_pairs(
        services.select("project_id", "name", "path", F.col("path").alias("haystack")),
        compose.select("project_id", F.col("name").alias("needle")),
        text="haystack",
    ).select("project_id", "name", "path", F.col("needle").alias("compose_name"))
    by_name = services.select("project_id", "name", "path").join(
        compose.select("project_id", "name").distinct(), ["project_id", "name"]
    ).withColumn("compose_name", F.col("name"))
    links = in_path.unionByName(by_name).distinct()
    details = compose.select(
        "project_id", F.col("name").alias("compose_name"), "image", "ports", "environment",
        "volumes", "depends_on",
    )
    return links.join(details, ["project_id", "compose_name"]).withColumn(
        "model_mounts", F.filter("volumes", lambda v: F.lower(v).rlike("model|ml"))
    )
