"""Exported commit logs as ``commits`` and ``commit_files``.

Header lines are ``hash|author|date|subject`` (the subject may hold pipes); file
lines are ``added<TAB>deleted<TAB>path`` with '-' for binary files, or a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_SEPARATOR = "\x1e"


def read_commit_log(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """Log records (header line, then file lines) of one exported file or folder."""
    return (
        spark.read.option("lineSep", RECORD_SEPARATOR).text(path)
        .where(F.trim("value") != "")
        .select(F.lit(project_id).alias("project_id"), F.col("value").alias("record"))
    )


def _header(line: Column) -> list[Column]:
    parts = F.split(line, r"\|", 4)
    return [
        F.trim(parts[0]).alias("commit_id"), parts[1].alias("author"),
        F.try_to_timestamp(parts[2]).alias("committed_at"), parts[3].alias("message"),
    ]


def _file_columns(line: Column) -> list[Column]:
    parts = F.split(line, "\t", 3)
    numstat = F.size(parts) == 3

    def number(i: int) -> Column:
        # '-' marks a binary file
        return F.when(numstat, F.coalesce(parts[i].try_cast("bigint"), F.lit(0))).otherwise(
            F.lit(0)
        ).cast("bigint")

    return [
        F.when(numstat, parts[2]).otherwise(F.trim(line)).alias("path"),
        number(0).alias("added"), number(1).alias("deleted"),
    ]


def commits_from_records(records: DataFrame) -> DataFrame:
    line = F.split_part(F.ltrim("record"), F.lit("\n"), F.lit(1))
    whole = F.size(F.split(line, r"\|", 4)) == 4
    return (
        records.where(whole).select("project_id", *_header(line))
        .dropDuplicates(["project_id", "commit_id"])
    )


def commit_files_from_records(records: DataFrame) -> DataFrame:
    lines = F.split(F.ltrim("record"), "\n")
    commit = F.trim(F.split_part(lines[0], F.lit("|"), F.lit(1)))
    return (
        records.select(
            "project_id", commit.alias("commit_id"),
            F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"),
        )
        .where(F.trim("line") != "")
        .select("project_id", "commit_id", *_file_columns(F.col("line")))
    )


def commit_files_from_lines(lines: DataFrame, block: int = 100_000) -> DataFrame:
    """Numbered log lines (project_id, line_no, line) without a record separator.

    A header applies to the file lines after it.  Logs are cut into blocks, so
    that a long log is not one window in one task: the last header before each
    block is carried over from the few block rows.
    """
    is_header = F.size(F.split("line", r"\|", 4)) == 4
    commit = F.when(is_header, F.trim(F.split_part("line", F.lit("|"), F.lit(1))))
    marked = lines.select(
        "project_id", "line_no", "line", is_header.alias("is_header"), commit.alias("header"),
        F.floor(F.col("line_no") / block).alias("block"),
    )
    before = Window.partitionBy("project_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        marked.groupBy("project_id", "block")
        .agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line_no"))).alias("last"))
        .select("project_id", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    )
    upto = Window.partitionBy("project_id", "block").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        marked.withColumn("current", F.last("header", ignorenulls=True).over(upto))
        .where(~F.col("is_header") & (F.trim("line") != ""))
        .join(carried, ["project_id", "block"])
        .select(
            "project_id", F.coalesce("current", "carried").alias("commit_id"),
            *_file_columns(F.col("line")),
        )
        .where(F.col("commit_id").isNotNull())
    )
