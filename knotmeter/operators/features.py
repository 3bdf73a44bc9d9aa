"""One pass over file contents.

Everything the metrics need from a file's text is computed here as narrow
columns, in the same stage as the scan, so content is read once and never
shuffled.  Catalyst drops the columns a query does not use.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from knotmeter import rules
from knotmeter.functions.matching import (
    any_literal,
    any_of,
    call_heads,
    count_matches,
    has_match,
    is_call,
    literal_of,
    matching_lines,
    occurrence_count,
    quoted,
    quoted_list,
    sum_of,
)
from knotmeter.functions.paths import suffix_pattern

# \w of the definition covers all letters and digits, Java's only ASCII
IMPORT_PATTERN = r"(?md)^(?:from|import)\s+([\p{L}\p{N}_.]+)"


def file_features(inventory: DataFrame, glue_mode: str = "intended") -> DataFrame:
    """Narrow per-file facts; ``glue_mode='reference'`` matches the glue patterns
    as literal text, 'intended' as regular expressions.

    The lower-cased text and the heads of its calls are columns of an own projection, so each is made once for a file
    of code however many rules look at it."""
    text, lower = "text", "lower_text"

    def code(extensions: list[str]) -> str:
        return f"rlike(name, {quoted(suffix_pattern(extensions))})"

    def where(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE 0L END"

    def words(*literals: str) -> str:
        return sum_of([occurrence_count(text, w) for w in literals])

    def source(pattern: str) -> str:
        return "heads" if is_call(literal_of(pattern)) else text

    def hits(patterns: list[str]) -> str:
        return sum_of([count_matches(source(p), p) for p in patterns])

    python = "endswith(name, '.py')"
    # inventory rules look at the lower-cased extension, content walks at the name
    commented = f"extension IN ({quoted_list(rules.CONSUMER_CODE)})"
    gate = any_literal(text, rules.PREDICTION_GATE)
    groups = list(rules.GLUE_PATTERNS.values())
    if glue_mode == "reference":
        groups = [[re.escape(p) for p in g] for g in groups]
    newlines = f"octet_length({text}) - octet_length(replace({text}, '\\n', ''))"
    lines = f"{newlines} + CASE WHEN {text} <> '' AND NOT endswith({text}, '\\n') THEN 1L ELSE 0L END"
    trains = "NOT ignored AND contains(lower(name), 'train')"
    columns = {
        "is_python": python,
        "loading_hits": where(
            code(rules.MODEL_CALL_CODE), hits(rules.LOADING_PATTERNS)
        ),
        "prediction_hits": where(
            f"{code(rules.MODEL_CALL_CODE)} AND {gate}",
            hits(rules.PREDICTION_PATTERNS),
        ),
        "code_lines": where(code(rules.GLUE_CODE), lines),
        "glue_lines": where(
            code(rules.GLUE_CODE), sum_of([matching_lines(lower, g, "lower_heads") for g in groups])
        ),
        "branches": where(python, words("if ", "elif ", "case ")),
        "flow_words": where(python, words("if ", "elif ", "else:", "for ", "while ")),
        "defs": where(python, words("def ")),
        "mentions_branching": f"{python} AND {any_literal(text, ['branch', 'case'])}",
        "has_prediction": f"{python} AND {any_of([has_match(source(p), p) for p in rules.PREDICTION_PATTERNS])}",
        "has_storage": f"{python} AND {any_literal(lower, rules.STORAGE_WORDS)}",
        "is_training": f"{python} AND (contains(name, 'train') OR contains({text}, 'fit'))",
        "has_db_read": f"{python} AND {any_literal(lower, rules.DB_READ_WORDS)}",
        "imports": (
            f"CASE WHEN {python} THEN array_distinct("
            f"regexp_extract_all({text}, {quoted(IMPORT_PATTERN)}, 1)) END"
        ),
        "has_schedule": f"{trains} AND {any_literal(lower, rules.SCHEDULE_WORDS)}",
        "has_trigger": f"{trains} AND {any_literal(lower, rules.TRIGGER_WORDS)}",
        "bug_name": "contains(lower(name), 'bug') OR contains(lower(name), 'fix')",
        "todos": where(commented, words("TODO", "FIXME")),
        "bug_marker": f"{commented} AND {any_literal(text, ['TODO', 'FIXME', 'BUG'])}",
    }
    names = ["project_id", "path", "dir", "name", "extension", "size", "ignored"]
    called = [literal_of(p) for g in (rules.LOADING_PATTERNS, rules.PREDICTION_PATTERNS, *groups) for p in g]
    calling = code([*rules.MODEL_CALL_CODE, *rules.GLUE_CODE, ".py"])
    return (
        inventory.selectExpr(*names, "coalesce(content, '') AS text")
        .selectExpr(
            *names, "text", f"CASE WHEN {calling} OR {trains} THEN lower(text) END AS lower_text",
            f"CASE WHEN {calling} THEN {call_heads(text, called)} END AS heads",
        )
        .selectExpr(*names, "text", "lower_text", "heads", "lower(heads) AS lower_heads")
        .selectExpr(*names, *[f"{expression} AS {name}" for name, expression in columns.items()])
    )
