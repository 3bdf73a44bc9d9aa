"""Framework detection from manifests, paths, code and dependency files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import paths
from knotmeter.functions.matching import (
    any_literal, any_of, has_match_any_case, labels_where, lookup, quoted,
)
from knotmeter.operators.inventory import kept


def _lower_code(inventory: DataFrame) -> DataFrame:
    """Code patterns ignore case: the content is lower-cased once for all of them."""
    return inventory.select("project_id", "path", "name", F.lower("content").alias("code"))


def _any_case(text: str, patterns: list[str]) -> str:
    return any_of([has_match_any_case(text, p) for p in patterns])


def manifest_frameworks(inventory: DataFrame) -> DataFrame:
    """Frameworks named in a dependency manifest of the project."""
    found = labels_where(
        [(any_literal("content", words), fw) for fw, words in rules.MANIFEST_FRAMEWORKS.items()]
    )
    return (
        kept(inventory).where(F.col("name").isin(rules.MANIFEST_NAMES))
        .select("project_id", F.expr(f"explode({found})").alias("framework"))
        .distinct()
    )


def code_frameworks(inventory: DataFrame) -> DataFrame:
    """Frameworks with a code pattern anywhere in the project."""
    found = labels_where(
        [(_any_case("code", pats), fw) for fw, pats in rules.CODE_FRAMEWORKS.items()]
    )
    return (
        _lower_code(inventory)
        .where(paths.has_extension(F.col("name"), rules.CODE_FRAMEWORK_CODE) & F.col("code").isNotNull())
        .select("project_id", F.expr(f"explode({found})").alias("framework"))
        .distinct()
    )


def framework_evidence(inventory: DataFrame, catalogue: dict = rules.FRAMEWORKS) -> DataFrame:
    """One row per piece of evidence: a path fragment (weight 1) or the first code
    pattern found in a file (weight 2)."""
    code = f"rlike(name, {quoted(paths.suffix_pattern(rules.FRAMEWORK_CODE))})"
    cells = []
    for framework, (category, patterns, fragments, _) in catalogue.items():

        def evidence(kind: str, value: str, weight: int) -> str:
            return (
                f"struct({quoted(framework)} AS framework, {quoted(category)} AS category, "
                f"'{kind}' AS kind, {quoted(value)} AS value, {weight}L AS weight)"
            )

        cells += [
            f"CASE WHEN contains(path, {quoted(f)}) THEN {evidence('file', f, 1)} END"
            for f in fragments
        ]
        first = " ".join(
            f"WHEN {_any_case('code', [p])} THEN {evidence('code', p, 2)}" for p in patterns
        )
        if patterns:
            cells.append(f"CASE WHEN {code} THEN CASE {first} END END")
    found = f"inline(filter(array({', '.join(cells)}), e -> e IS NOT NULL))"
    return _lower_code(inventory).select("project_id", "path", F.expr(found))


def detect_frameworks_from_files(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("project_id", "framework", "category").agg(
        F.least(F.lit(10), F.sum("weight")).cast("bigint").alias("confidence"),
        F.count("*").alias("file_evidence"),
    )


def detect_frameworks_from_dependencies(
    requirements: DataFrame, packages: DataFrame, poms: DataFrame,
    catalogue: dict = rules.FRAMEWORKS,
) -> DataFrame:
    """Evidence in the manifests at the project root: an exact package key, a part
    of a requirement name, or a part of the pom text."""
    pairs = [(dep, fw) for fw, (_, _, _, deps) in catalogue.items() for dep in deps]

    def owners(test: str) -> str:
        cells = ", ".join(
            f"CASE WHEN {test.format(quoted(dep))} THEN struct({quoted(fw)} AS framework, "
            f"{quoted(dep)} AS rule) END"
            for dep, fw in pairs
        )
        return f"inline(filter(array({cells}), x -> x IS NOT NULL))"

    npm = packages.where("dir = '.'").selectExpr(
        "project_id", "'package.json' AS file", "package AS dependency", "version",
        owners("package = {}"),
    )
    pip = requirements.where("dir = '.'").selectExpr(
        "project_id", "'requirements.txt' AS file", "package AS dependency",
        "string(NULL) AS version", owners("contains(package, {})"),
    )
    maven = poms.where("dir = '.'").selectExpr(
        "project_id", "'pom.xml' AS file", "string(NULL) AS version",
        owners("contains(content, {})"),
    ).withColumn("dependency", F.col("rule"))
    return npm.unionByName(pip).unionByName(maven)


def detect_frameworks_all(
    from_files: DataFrame, from_dependencies: DataFrame, catalogue: dict = rules.FRAMEWORKS
) -> DataFrame:
    """Full outer union of both kinds of evidence, with a combined confidence."""
    deps = from_dependencies.groupBy("project_id", "framework").agg(
        F.count("*").alias("dependency_evidence")
    )
    category = lookup("framework", {fw: cat for fw, (cat, *_) in catalogue.items()}, "'Unknown'")
    n_file = F.coalesce("file_evidence", F.lit(0))
    n_dep = F.coalesce("dependency_evidence", F.lit(0))
    return (
        from_files.select("project_id", "framework", "file_evidence")
        .join(deps, ["project_id", "framework"], "full_outer")
        .select(
            "project_id", "framework",
            F.expr(category).alias("category"),
            n_file.cast("bigint").alias("file_evidence"),
            n_dep.cast("bigint").alias("dependency_evidence"),
            F.least(F.lit(10), n_file * 2 + n_dep * 3).cast("bigint").alias("confidence"),
        )
    )


def frameworks_by_category(frameworks: DataFrame) -> DataFrame:
    """Names and confidences per category (at most the catalogue's size per group)."""
    entry = F.struct((-F.col("confidence")).alias("o"), "framework", "confidence")
    return frameworks.groupBy("project_id", "category").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(e["framework"].alias("name"), e["confidence"].alias("confidence")),
        ).alias("frameworks")
    )


def framework_report(frameworks: DataFrame, n: int = 5) -> DataFrame:
    """Totals and the first n frameworks with confidence 5 or more."""
    w = Window.partitionBy("project_id").orderBy(F.col("confidence").desc(), "framework")
    totals = frameworks.groupBy("project_id").agg(F.count("*").alias("total_frameworks"))
    primary = (
        frameworks.where(F.col("confidence") >= 5)
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= n)
        .groupBy("project_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "framework"))).alias("p"))
    )
    return totals.join(primary, "project_id", "left").select(
        "project_id", "total_frameworks",
        F.coalesce(F.col("p.framework"), F.array().cast("array<string>")).alias(
            "primary_frameworks"
        ),
    )
