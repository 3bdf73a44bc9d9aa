"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotmeter.functions.paths import extension_of


def _size_text(size: Column, units: list[str], last: str, digits: int) -> Column:
    fmt = f"%.{digits}f "
    value = size.cast("double")
    out = F.when(value < 1024, F.format_string(fmt + units[0], F.bround(value, digits)))
    for unit in units[1:]:
        value = value / 1024
        out = out.when(value < 1024, F.format_string(fmt + unit, F.bround(value, digits)))
    return out.otherwise(F.format_string(fmt + last, F.bround(value / 1024, digits)))


def human_size(size: Column, short: bool = False) -> Column:
    """'1.50 KB' (B..PB, two digits) or, with ``short``, '1.5 KB' (B..TB, one digit)."""
    if short:
        return _size_text(size, ["B", "KB", "MB", "GB"], "TB", 1)
    return _size_text(size, ["B", "KB", "MB", "GB", "TB"], "PB", 2)


def newline_count(text: Column) -> Column:
    return (
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    ).cast("bigint")


def line_count(text: Column) -> Column:
    """Lines as a file iterator yields them: a trailing newline opens no new line."""
    return newline_count(text) + F.when(
        (F.octet_length(text) > 0) & ~text.endswith("\n"), F.lit(1)
    ).otherwise(F.lit(0))


def line_of(text: Column, position: Column) -> Column:
    """1-based line of the character at a 0-based position."""
    return newline_count(F.substring(text, F.lit(1), position)) + 1


def context_window(text: Column, position: Column, window: int = 50) -> Column:
    """``window`` characters either side of a 0-based position, on one line, trimmed."""
    start = F.greatest(position - window, F.lit(0))
    cut = F.substring(text, (start + 1).cast("int"), (position + window - start).cast("int"))
    return F.trim(F.translate(cut, "\n", " "))


def truncate_readme(text: Column, limit: int = 1000) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def safe_filename(name: Column) -> Column:
    """Replace reserved characters, drop control characters, keep 255 at most."""
    safe = F.regexp_replace(
        F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f]", ""
    )
    # the extension as written, not lower-cased
    ext = F.regexp_extract(safe, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(ext))
    cut = F.concat(F.substring(stem, F.lit(1), F.lit(255) - F.length(ext)), ext)
    return F.when(F.length(safe) > 255, cut).otherwise(safe)


def fenced_json(text: Column) -> Column:
    """The body of the first triple-backtick fence, else the trimmed text itself."""
    body = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    ws = r"^\s+|\s+$"
    return F.when(
        text.rlike(r"```(?:json)?\s*[\s\S]*?```"), F.regexp_replace(body, ws, "")
    ).otherwise(F.regexp_replace(text, ws, ""))


def file_hash(content: Column, algorithm: str = "md5") -> Column:
    """Hex digest of the content bytes."""
    data = content.cast("binary")
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(data, int(algorithm[3:]))
    raise ValueError(f"unsupported hash algorithm: {algorithm}")


def repo_owner_and_name(url: Column) -> tuple[Column, Column]:
    """Owner and name from a GitHub URL; both null when the URL is not one."""
    pattern = r"github\.com[/:]([^/]+)/([^/]+?)(?:\.git)?$"
    known = url.rlike(pattern)
    owner = F.when(known, F.regexp_extract(url, pattern, 1))
    name = F.when(known, F.replace(F.regexp_extract(url, pattern, 2), F.lit(".git"), F.lit("")))
    return owner, name


__all__ = [
    "context_window", "extension_of", "fenced_json", "file_hash", "human_size",
    "line_count", "line_of", "newline_count", "repo_owner_and_name", "safe_filename",
    "truncate_readme",
]
