"""Compiling rule tables to Spark SQL expressions.

Rule sets expand to dozens of predicates, so they are written as SQL text and
parsed once, instead of being assembled operator by operator from Python.  The
functions take and return SQL text; callers wrap the outermost one in ``F.expr``.
"""

from __future__ import annotations

import re


def quoted(value: str) -> str:
    """A Spark SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return "'" + escaped.replace("\t", "\\t") + "'"


def quoted_list(values: list[str]) -> str:
    return ", ".join(quoted(v) for v in values)


def text_array(values: list[str]) -> str:
    return f"array({quoted_list(values)})" if values else "cast(array() as array<string>)"


def literal_of(pattern: str) -> str | None:
    """The plain text a pattern stands for, or None when it is a real regex."""
    if re.search(r"(?<!\\)(?:\\\\)*[.^$*+?{}\[\]|()]", pattern) or re.search(r"\\\w", pattern):
        return None
    return re.sub(r"\\(.)", r"\1", pattern)


def occurrence_count(text: str, literal: str) -> str:
    """Non-overlapping occurrences of a literal (byte lengths are O(1) in Spark)."""
    removed = f"octet_length({text}) - octet_length(replace({text}, {quoted(literal)}, ''))"
    return f"(({removed}) div {len(literal.encode())})"


def count_matches(text: str, pattern: str) -> str:
    literal = literal_of(pattern)
    if literal is None:
        return f"cast(regexp_count({text}, {quoted(pattern)}) as bigint)"
    return occurrence_count(text, literal)


def has_match(text: str, pattern: str) -> str:
    literal = literal_of(pattern)
    if literal is None:
        return f"rlike({text}, {quoted(pattern)})"
    return f"contains({text}, {quoted(literal)})"


def any_of(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


def starts_of(pattern: str) -> list[str]:
    """Literals of which one starts every match: the leading literal, with each branch of a group of plain words behind it
    and the bracket after that; the empty text, which starts all, for a pattern of alternatives."""
    if "|" in re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", pattern):
        return [""]
    head = re.match(r"(?:(?:\\[^\w\s]|[^\\.^$*+?{}\[\]|()])(?![*?+{]))*", pattern).group()
    group = re.match(r"\(([\w|]+)\)((?:\\\()?)(?![*?+{])", pattern[len(head):])
    branches, after = (group[1].split("|"), group[2]) if group else ([""], "")
    return [re.sub(r"\\(.)", r"\1", head + branch + after) for branch in branches]


def sum_of(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0L"


def any_match(text: str, patterns: list[str]) -> str:
    return any_of([has_match(text, p) for p in patterns])


def any_literal(text: str, words: list[str]) -> str:
    return any_of([f"contains({text}, {quoted(w)})" for w in words])


def count_literals(text: str, words: list[str]) -> str:
    """How many of the words occur in the text."""
    return sum_of([f"int(contains({text}, {quoted(w)}))" for w in words])


def all_matches(text: str, patterns: list[str]) -> str:
    """Total matches, each pattern counted on its own (overlaps between them count)."""
    return sum_of([count_matches(text, p) for p in patterns])


def alternation(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def matching_lines(lower_text: str, patterns: list[str], lower_heads: str | None = None) -> str:
    """Number of lines of a lower-cased text with at least one match, in one scan.

    A match takes the rest of its line with it, so a line counts once.  Where all
    patterns are literals, they are looked for behind their last characters only, and a substring test
    first spares most texts the regex; ``lower_heads`` are the :func:`call_heads` of the text.
    """
    lowered = [p.lower() for p in patterns]
    literals = [literal_of(p) for p in lowered]
    if not lowered or not all(literals):
        return f"cast(regexp_count({lower_text}, {quoted(alternation(lowered) + '[^\\n]*')}) as bigint)"
    last = "".join(sorted({re.escape(v[-1]) for v in literals}))
    behind = alternation([f"(?<={p})" for p in lowered])
    count = f"regexp_count({lower_text}, {quoted(f'[{last}]{behind}[^\\n]*')})"
    found = any_of([
        f"contains({lower_heads if lower_heads and is_call(v) else lower_text}, {quoted(v)})" for v in literals
    ])
    return f"cast(CASE WHEN {found} THEN {count} ELSE 0 END as bigint)"


def is_call(literal: str | None) -> bool:
    """Whether a literal ends with its only bracket and stays on a line, so that heads show all of its places."""
    return literal is not None and len(literal) > 1 and literal.find("(") == len(literal) - 1 and "\n" not in literal


def call_heads(text: str, literals: list[str | None]) -> str:
    """What stands before each opening bracket, as far back as the longest literal that is a call reaches, a line each.

    A literal that ends with its only bracket occurs in the heads as often as in the text, and heads are short:
    counting many such literals reads the text once.
    """
    width = max((len(v) for v in literals if is_call(v)), default=1)
    return f"array_join(transform(split({text}, {quoted(r'\(')}), p -> right(p, {width})), '(\\n')"


def has_match_any_case(lower_text: str, pattern: str) -> str:
    """Case-insensitive test on a text that is lower-cased already."""
    literal = literal_of(pattern)
    if literal is None:
        return f"rlike({lower_text}, {quoted('(?i)' + pattern)})"
    return f"contains({lower_text}, {quoted(literal.lower())})"


def lookup(key: str, table: dict[str, str], default: str = "NULL") -> str:
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items())
    return f"coalesce(map({pairs})[{key}], {default})"


def labels_where(flags: list[tuple[str, str]]) -> str:
    """Array of the labels whose condition holds, in order."""
    items = ", ".join(f"CASE WHEN {c} THEN {quoted(label)} END" for c, label in flags)
    return f"filter(array({items}), x -> x IS NOT NULL)"
