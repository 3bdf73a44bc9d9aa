"""Archives as a ``files`` relation, project roots and safe texts; trees are in ``tree``."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.sources.tree import decode, is_text

_BATCH_BYTES = 32 * 1024 * 1024


def _stamp(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, tz=timezone.utc).replace(tzinfo=None)


def _members(path: str, data: bytes) -> Iterator[tuple[str, int, datetime, bytes]]:
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, datetime(*info.date_time), z.read(info)
        return
    modes = {".tar.gz": "r:gz", ".tgz": "r:gz", ".tar.bz2": "r:bz2", ".tar": "r:"}
    mode = next((m for suffix, m in modes.items() if path.endswith(suffix)), None)
    if mode is None:
        raise ValueError(f"Unsupported archive format: {path}")
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as t:
        for member in t:
            if member.isfile():
                yield member.name, member.size, _stamp(member.mtime), t.extractfile(member).read()


def expand_archives(archives: DataFrame) -> DataFrame:
    """(project_id, path, content binary) archives to one row per member file.

    Members are emitted in bounded batches and nothing is written to disk.
    """
    columns = [
        "project_id", "path", "size", "modified", "content", "archive", "archive_size",
    ]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for project, archive, data in zip(pdf["project_id"], pdf["path"], pdf["content"]):
                base = os.path.basename(archive)
                for name, size, modified, body in _members(archive, bytes(data)):
                    text = decode(body) if is_text(os.path.basename(name)) else None
                    rows.append((project, name.removeprefix("./"), size, modified, text, base, len(data)))
                    held += size
                    if held > _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return archives.select("project_id", "path", "content").mapInPandas(
        expand,
        "project_id string, path string, size bigint, modified timestamp, content string, "
        "archive string, archive_size bigint",
    )


def scan_archives(spark, path: str) -> DataFrame:
    """Archives below a folder; the project is the archive's base name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    project = F.regexp_replace(name, r"\.(zip|tar\.gz|tgz|tar\.bz2|tar)$", "")
    return expand_archives(raw.select(project.alias("project_id"), "path", "content"))


def normalize_project_root(
    files: DataFrame, markers: list[str] = rules.ROOT_MARKERS
) -> DataFrame:
    """Make the only top directory the root when it holds a marker and is not hidden.

    Only projects whose root moves are joined with their files, so that their list stays small enough to be sent out
    and contents need no exchange.  ``rules.SCANNER_ROOT_MARKERS`` are the markers of uploaded archives.
    """
    first = F.split_part("path", F.lit("/"), F.lit(1))
    second = F.split_part("path", F.lit("/"), F.lit(2))
    # two distinct entries already rule a prefix out, so keep the extremes only
    tops = files.groupBy("project_id").agg(
        F.min(first).alias("lo"), F.max(first).alias("hi"),
        F.bool_and(F.contains("path", F.lit("/"))).alias("is_dir"),
        F.bool_or(second.isin(markers)).alias("marked"),
    )
    prefix = F.when(
        (F.col("lo") == F.col("hi")) & F.col("is_dir") & F.col("marked") & ~F.col("lo").startswith("."),
        F.concat("lo", F.lit("/")),
    ).otherwise(F.lit(""))
    moved = tops.select("project_id", F.length(prefix).alias("_cut")).where(F.col("_cut") > 0)
    return (
        files.join(moved, "project_id", "left")
        .withColumn("path", F.substring(F.col("path"), F.coalesce("_cut", F.lit(0)) + 1, F.length("path")))
        .drop("_cut")
    )


def read_text_safely(files: DataFrame, max_size_mb: int | None = None) -> DataFrame:
    """Content with an error text; with a limit, larger files have a null and an error."""
    if max_size_mb is None:
        return files.withColumn("error", F.lit(None).cast("string"))
    small = F.col("size") <= max_size_mb * 1024 * 1024
    return files.withColumns(
        {
            "content": F.when(small, F.col("content")),
            "error": F.when(~small, F.lit(f"File exceeds {max_size_mb}MB limit")),
        }
    )
