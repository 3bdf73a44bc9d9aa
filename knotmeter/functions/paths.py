"""Column expressions over project-relative paths ('/'-separated, root is '.')."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSION_PATTERN = r"(?s)^\.*[^.].*(\.[^.]*)$"


def glob_regex(glob: str) -> str:
    """Regex for a file-name glob; ``*`` and ``?`` stay inside one path segment."""
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch)) for ch in glob)


def globs_regex(globs: list[str]) -> str:
    return "(?:" + "|".join(glob_regex(g) for g in dict.fromkeys(globs)) + ")"


def name_matches(name: Column, globs: list[str]) -> Column:
    return name.rlike("^" + globs_regex(globs) + "$")


def path_ignored(path: Column, globs: list[str]) -> Column:
    """True when the file name or any directory on the way to it matches a glob."""
    return path.rlike("(?:^|/)" + globs_regex(globs) + "(?:/|$)")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(
        F.regexp_replace(path, "/[^/]*$", "")
    )


def extension_of(name: Column) -> Column:
    """Lower-cased last extension with its dot; '' for names such as '.env'."""
    return F.lower(F.regexp_extract(name, EXTENSION_PATTERN, 1))


def ancestor_dirs(column: str) -> Column:
    """The directory itself and every directory above it, from the root '.' down."""
    parts = f"split({column}, '/')"
    return F.expr(
        f"CASE WHEN {column} = '.' THEN array('.') ELSE concat(array('.'), transform("
        f"sequence(1, size({parts})), i -> array_join(slice({parts}, 1, i), '/'))) END"
    )


def has_extension(name: Column, extensions: list[str]) -> Column:
    """Case-sensitive suffix test, as in ``str.endswith``."""
    return name.rlike(suffix_pattern(extensions))


def suffix_pattern(extensions: list[str]) -> str:
    return "(?:" + "|".join(re.escape(e) for e in extensions) + ")$"
