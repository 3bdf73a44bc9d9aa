"""Model artefacts: files, code references, metadata, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import paths
from knotmeter.functions.matching import (
    alternation, any_match, call_heads, count_matches, has_match, is_call, literal_of, lookup, quoted,
)
from knotmeter.operators.inventory import kept
from knotmeter.operators.mentions import contains_pairs

# \w of the definition covers all letters and digits, Java's only ASCII
MODEL_VARIABLE = r"([\p{L}\p{N}_]*model[\p{L}\p{N}_]*)\s*="


def _found(value: Column) -> Column:
    return F.when(value != "", value)


def model_reference(
    source: Column, quoted: str = rules.QUOTED_MODEL_PATTERN, pretrained: bool = False
) -> Column:
    """A quoted model file, else an assigned ``*model*`` variable, else (optionally)
    the argument of ``from_pretrained``."""
    options = [
        _found(F.regexp_extract(source, quoted, 1)),
        _found(F.regexp_extract(source, MODEL_VARIABLE, 1)),
    ]
    if pretrained:
        options.append(_found(F.regexp_extract(source, rules.PRETRAINED_PATTERN, 1)))
    return F.coalesce(*options)


def detect_model_files(
    inventory: DataFrame,
    extensions: list[str] = rules.MODEL_EXTENSIONS,
    types: dict[str, str] = rules.MODEL_TYPES,
) -> DataFrame:
    """Kept files with a model extension, one per (path, size)."""
    return (
        kept(inventory)
        .where(F.col("extension").isin(extensions))
        .select(
            "project_id", "name", "path",
            F.expr(lookup("extension", types, "'Unknown'")).alias("type"),
            "size", "modified", F.lit("file_extension").alias("detected_by"),
        )
        .dropDuplicates(["project_id", "path", "size"])
    )


def detect_model_files_scanner(inventory: DataFrame) -> DataFrame:
    return detect_model_files(
        inventory, rules.SCANNER_MODEL_EXTENSIONS, rules.SCANNER_MODEL_TYPES
    )


def model_file_facts(inventory: DataFrame) -> DataFrame:
    """Model files of the whole tree with framework, sizes, version, architecture."""
    owner: dict[str, str] = {}
    for framework, extensions in rules.DETECTOR_MODEL_EXTENSIONS.items():
        for extension in extensions:
            owner.setdefault(extension, framework)
    cases = " ".join(
        f"WHEN contains(lower(name), {quoted(a)}) THEN {quoted(a)}" for a in rules.MODEL_ARCHITECTURES
    )
    architecture = F.expr(f"CASE {cases} END")
    size = F.col("size")
    return (
        inventory.withColumn("framework", F.expr(lookup("extension", owner)))
        .where(F.col("framework").isNotNull())
        .select(
            "project_id", "name", "path", "extension", "framework", "size",
            F.bround(size / 1024, 2).alias("size_kb"),
            F.bround(size / (1024 * 1024), 2).alias("size_mb"),
            "modified",
            _found(F.regexp_extract("name", rules.MODEL_VERSION_PATTERN, 0)).alias("version"),
            architecture.alias("architecture"),
        )
    )


def detect_model_code_refs(
    inventory: DataFrame, patterns: list[str] = rules.MODEL_REFERENCE_PATTERNS
) -> DataFrame:
    """Models named near a loading call, one row per (file, name).

    The 50 characters either side come from look-arounds, so neighbouring
    matches keep their own windows.
    """

    def hits(ordinal: int, pattern: str) -> str:
        # the first look-ahead fails fast, before the costlier look-behind
        wide = rf"(?s)(?={pattern})(?<=(\A.{{0,49}}|.{{50}}))({pattern})(?=(.{{0,50}}))"
        left, hit, right = (
            f"regexp_extract_all(content, {quoted(wide)}, {g})" for g in (1, 2, 3)
        )
        windows = f"zip_with(zip_with({left}, {hit}, (a, b) -> a || b), {right}, (a, b) -> a || b)"
        rows = f"transform({windows}, (w, i) -> struct({ordinal} AS ordinal, i, w AS context))"
        source = "heads" if is_call(literal_of(pattern)) else "content"
        return f"CASE WHEN {has_match(source, pattern)} THEN {rows} END"

    tables = ", ".join(hits(i, p) for i, p in enumerate(patterns))
    found = F.expr(f"inline(flatten(filter(array({tables}), a -> a IS NOT NULL)))")
    code = F.col("extension").isin(".py", ".js", ".java", ".r", ".ipynb")
    heads = F.expr(call_heads("content", [literal_of(p) for p in patterns]))
    return (
        kept(inventory).where(code)
        .select("project_id", "path", "content", heads.alias("heads"))
        .select("project_id", "path", found)
        .withColumn("name", model_reference(F.col("context")))
        .where(F.col("name").isNotNull())
        .groupBy("project_id", "path", "name")
        .agg(F.min(F.struct("ordinal", "i", "context")).alias("first"))
        .select(
            "project_id", "name", "path", F.lit("Inferred").alias("type"),
            F.lit("code_reference").alias("detected_by"),
            F.col("first.context").alias("context"),
        )
    )


def detect_models(inventory: DataFrame) -> DataFrame:
    """File models and code references in one relation."""
    return detect_model_files(inventory).unionByName(
        detect_model_code_refs(inventory), allowMissingColumns=True
    )


def _reference_rules() -> list[tuple[str, str, str, str]]:
    out = []
    for language, frameworks in rules.DETECTOR_LOADING.items():
        for framework, patterns in frameworks.items():
            out += [(language, "loading", framework, p) for p in patterns]
    for kind, table in (
        ("prediction", rules.DETECTOR_PREDICTION), ("training", rules.DETECTOR_TRAINING)
    ):
        for language, patterns in table.items():
            out += [(language, kind, "", p) for p in patterns]
    return out


def model_references(inventory: DataFrame) -> DataFrame:
    """Every loading, prediction and training hit with its line, by language."""
    name = F.col("name")
    language = (
        F.when(name.endswith(".py"), "python")
        .when(name.endswith(".r") | name.endswith(".R"), "r")
        .when(name.endswith(".js"), "javascript")
        .when(name.endswith(".java"), "java")
    )
    by_language: dict[str, list] = {}
    for lang, kind, framework, pattern in _reference_rules():
        by_language.setdefault(lang, []).append((kind, framework, pattern))
    lines, hits = "CASE language", "CASE language"
    for lang, table in by_language.items():
        any_rule = quoted(alternation([p for _, _, p in table]))
        lines += (
            f" WHEN '{lang}' THEN filter(transform(split(content, '\\n'), (code, i) -> "
            f"struct(bigint(i + 1) AS line, code)), s -> rlike(s.code, {any_rule}))"
        )
        counted = ", ".join(
            f"struct('{kind}' AS kind, '{framework}' AS framework, {quoted(pattern)} AS pattern, "
            f"{count_matches('l.code', pattern)} AS n)"
            for kind, framework, pattern in table
        )
        hits += f" WHEN '{lang}' THEN array({counted})"
    reference = model_reference(F.col("l.code"), rules.DETECTOR_QUOTED_MODEL_PATTERN, True)
    return (
        inventory.withColumn("language", language)
        .where(F.col("language").isNotNull() & F.col("content").isNotNull())
        .select("project_id", "path", "language", F.expr(f"explode({lines} END)").alias("l"))
        .select("project_id", "path", "language", "l", F.expr(f"explode({hits} END)").alias("h"))
        .where(F.col("h.n") > 0)
        .select(
            "project_id", "path", "language", F.col("l.line").alias("line"), "h.kind",
            "h.framework", "h.pattern", F.trim("l.code").alias("context"),
            F.when(F.col("h.kind") == "loading", reference).alias("model_reference"),
            F.explode(F.sequence(F.lit(1), F.col("h.n").cast("int"))).alias("occurrence"),
        )
    )


def model_metadata_files(inventory: DataFrame) -> DataFrame:
    """Files whose name starts like a metadata pattern ('.' matches any character)."""
    prefix = "^" + alternation([g.replace("*", ".*") for g in rules.MODEL_METADATA_GLOBS])
    name = F.col("name")
    kind = (
        F.when(name.contains("config"), "config")
        .when(name.contains("checkpoint"), "checkpoint")
        .otherwise("other")
    )
    return inventory.where(name.rlike(prefix)).select(
        "project_id", "name", "path", kind.alias("type"), "size"
    )


def model_detection_stats(
    facts: DataFrame, references: DataFrame, metadata: DataFrame
) -> DataFrame:
    models = facts.groupBy("project_id").agg(
        F.count("*").alias("total_models"),
        F.sum(F.col("size_mb").cast("decimal(18,2)")).cast("double").alias("total_size_mb"),
    )
    kinds = references.groupBy("project_id").agg(
        F.count("*").alias("total_references"),
        *[
            F.count_if(F.col("kind") == k).alias(f"{k}_references")
            for k in ("loading", "prediction", "training")
        ],
    )
    files = metadata.groupBy("project_id").agg(F.count("*").alias("metadata_files"))
    out = models.join(kinds, "project_id", "full").join(files, "project_id", "full")
    return out.fillna(0)


def model_frameworks(facts: DataFrame) -> DataFrame:
    return facts.groupBy("project_id", "framework").agg(F.count("*").alias("models"))


def missing_models(references: DataFrame, facts: DataFrame) -> DataFrame:
    """Loading references whose model is not the name of any model file."""
    named = references.where((F.col("kind") == "loading") & F.col("model_reference").isNotNull())
    names = facts.select("project_id", F.col("name").alias("model_reference")).distinct()
    return named.join(names, ["project_id", "model_reference"], "left_anti")


def model_issues(facts: DataFrame, references: DataFrame) -> DataFrame:
    large = facts.where(F.col("size_mb") > 100).select(
        "project_id", F.lit("large_model").alias("type"), F.lit("warning").alias("severity"),
        F.col("path").alias("file"), F.col("name").alias("model"),
        F.concat(
            F.lit("Model "), "name", F.lit(" is "), F.col("size_mb").cast("string"),
            F.lit("MB, consider optimization"),
        ).alias("message"),
    )
    missing = missing_models(references, facts).select(
        "project_id", F.lit("missing_model").alias("type"), F.lit("critical").alias("severity"),
        F.col("path").alias("file"), F.col("model_reference").alias("model"),
        F.concat(F.lit("Model "), "model_reference", F.lit(" referenced but not found")).alias(
            "message"
        ),
    )
    return large.unionByName(missing)


def scanner_code_refs(
    inventory: DataFrame, patterns: list[str] = rules.SCANNER_REFERENCE_PATTERNS
) -> DataFrame:
    """Loading calls with the model they name, their line and context window."""

    def hits(ordinal: int, pattern: str) -> str:
        grouped = "(" in pattern.replace(r"\(", "").replace("(?:", "")
        plain = pattern.replace("([^", "(?:[^")
        around = quoted(rf"(?s)(?={plain})(?<=(\A.{{0,49}}|.{{50}}))(?=(.{{0,50}}))" + pattern)
        p = quoted(pattern)
        # zipped fields are numbered: before, after, hit, reference, gap
        zipped = (
            f"arrays_zip(regexp_extract_all(content, {around}, 1), "
            f"regexp_extract_all(content, {around}, 2), "
            f"regexp_extract_all(content, {p}, 0), "
            f"regexp_extract_all(content, {p}, {int(grouped)}), "
            # the text between matches; the part after the last one is not needed
            f"slice(split(content, {p}, -1), 1, regexp_count(content, {p})))"
        )
        newlines = "length({0}) - length(replace({0}, '\\n', ''))"
        rows = (
            f"transform({zipped}, (z, i) -> struct({ordinal} AS ordinal, i, z.`3` AS ref, "
            f"bigint({newlines.format('z.`4`')}) AS gap_lines, "
            f"bigint({newlines.format('z.`2`')}) AS hit_lines, "
            "trim(translate(z.`0` || z.`1`, '\\n', ' ')) AS context))"
        )
        return f"CASE WHEN {has_match('content', pattern)} THEN {rows} END"

    tables = ", ".join(hits(i, p) for i, p in enumerate(patterns))
    found = F.expr(f"inline(flatten(filter(array({tables}), a -> a IS NOT NULL)))")
    rows = inventory.where(
        paths.has_extension(F.col("name"), [".py", ".ipynb", ".r", ".R", ".js"])
        & F.expr(any_match("content", patterns))
    ).select("project_id", F.col("path").alias("file"), found)
    # the line of a match: newlines in all gaps up to it and in the hits before it
    upto = Window.partitionBy("project_id", "file", "ordinal").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    line = F.sum(F.col("gap_lines") + F.col("hit_lines")).over(upto) - F.col("hit_lines") + 1
    return rows.select("project_id", "file", "ordinal", "i", "ref", line.alias("line"), "context")


def model_code_refs_merge(models: DataFrame, refs: DataFrame) -> DataFrame:
    """Attach each code reference to the first model (by path) whose name lies in
    the reference or whose path holds it; references without one become new
    'Inferred' models, one per distinct reference.

    Models of one name are reduced to the first path before they meet references, and the smallest
    path of a reference is taken in the stage that finds it, so neither the
    models of a popular name nor those of a popular path leave their task.
    """
    wanted = refs.select("project_id", "ref").distinct()
    names = models.groupBy("project_id", F.col("name").alias("needle")).agg(F.min("path").alias("path"))
    by_name = contains_pairs(wanted.withColumn("haystack", F.col("ref")), names, text="haystack").join(
        names, ["project_id", "needle"]
    ).select("project_id", "ref", "path")
    by_path = contains_pairs(
        models.select("project_id", "path", F.col("path").alias("haystack")),
        wanted.select("project_id", F.col("ref").alias("needle")),
        text="haystack",
    ).groupBy("project_id", F.col("needle").alias("ref")).agg(F.min("path").alias("path"))
    first = by_name.unionByName(by_path).groupBy("project_id", "ref").agg(
        F.min("path").alias("model_path")
    )
    attached = refs.join(first, ["project_id", "ref"], "left")
    known = models.select("project_id", F.col("path").alias("model_path"), "name", "type")
    merged = attached.join(known, ["project_id", "model_path"], "left")
    inferred = F.col("model_path").isNull()
    return merged.select(
        "project_id",
        F.when(inferred, paths.base_name(F.col("ref"))).otherwise(F.col("name")).alias("name"),
        F.coalesce("model_path", "ref").alias("path"),
        F.when(inferred, F.lit("Inferred")).otherwise(F.col("type")).alias("type"),
        F.col("file").alias("consumer_file"), "line", "context",
        inferred.alias("inferred"),
    )
