"""Commit history: churn, bugs, contributors, maintainability inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions.matching import any_literal
from knotmeter.functions.paths import dir_of
from knotmeter.operators.inventory import kept
from knotmeter.operators.mentions import contains_pairs
from knotmeter.operators.services import with_owners


def since(as_of: str, months: int = 0, days: int = 0) -> Column:
    """Start of the window that ends at ``as_of`` (a parameter, never the clock)."""
    end = F.lit(as_of).cast("timestamp")
    return end - F.make_interval(months=F.lit(months), days=F.lit(days))


def is_bug_fix(message: str = "message", keywords: list[str] = rules.BUG_KEYWORDS) -> Column:
    return F.expr(any_literal(f"lower({message})", keywords))


def recent_commits(
    commits: DataFrame, as_of: str, days: int = 180, max_commits: int | None = None
) -> DataFrame:
    """Commits of the last ``days`` per project, ranked newest first if only ``max_commits`` are wanted."""
    window = commits.where(F.col("committed_at") >= since(as_of, days=days))
    if max_commits is None:
        return window
    w = Window.partitionBy("project_id").orderBy(F.col("committed_at").desc(), "commit_id")
    return window.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_commits)


def bug_fix_commits(
    commits: DataFrame, keywords: list[str] = rules.BUG_KEYWORDS, as_of: str | None = None, days: int = 180
) -> DataFrame:
    """Bug-fix commits; with ``as_of`` only those of the last ``days``."""
    found = commits.where(is_bug_fix("message", keywords))
    return found if as_of is None else found.where(F.col("committed_at") >= since(as_of, days=days))


def file_history(commits: DataFrame, commit_files: DataFrame, path: str) -> DataFrame:
    """Commits that touched one path."""
    touched = commit_files.where(F.col("path") == path).select("project_id", "commit_id").distinct()
    return commits.join(touched, ["project_id", "commit_id"], "left_semi")


def changed_files(commit_files: DataFrame, commit_id: str) -> DataFrame:
    return commit_files.where(F.col("commit_id") == commit_id).select("project_id", "path").distinct()


def repo_info(commits: DataFrame) -> DataFrame:
    """Commit and contributor counts, first and last commit per project."""
    moment = F.struct("committed_at", "commit_id")
    # by author first, so that counting rows counts contributors
    by_author = commits.groupBy("project_id", "author").agg(
        F.count("*").alias("n"), F.min("committed_at").alias("first"), F.max(moment).alias("moment"),
        F.max_by(F.struct("commit_id", "author", "committed_at", "message"), moment).alias("last"),
    )
    return by_author.groupBy("project_id").agg(
        F.sum("n").alias("commit_count"), F.min("first").alias("created_at"),
        F.max_by("last", "moment").alias("last_commit"), F.count("*").alias("contributors_count"),
    )


def contributors(commits: DataFrame) -> DataFrame:
    return commits.groupBy("project_id", "author").agg(F.count("*").alias("commits"))


def commits_by_author(commits: DataFrame) -> DataFrame:
    return contributors(commits)


def commits_by_date(commits: DataFrame) -> DataFrame:
    return commits.groupBy("project_id", F.to_date("committed_at").alias("date")).agg(
        F.count("*").alias("commits")
    )


def window_changes(
    commits: DataFrame, commit_files: DataFrame, as_of: str, months: int = 6
) -> DataFrame:
    """Changes per path in the window (commit_files holds a path once per commit).

    The commit comes first in the join: a sort by project first would compare whole rows, as most have the same project.
    """
    recent = commits.where(F.col("committed_at") >= since(as_of, months=months)).select(
        "project_id", "commit_id"
    )
    return (
        commit_files.join(recent, ["commit_id", "project_id"])
        .groupBy("project_id", "path").agg(F.count("*").alias("changes"))
    )


def top_changed(changes: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.col("changes").desc(), "path")
    return changes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def churn_by_service(changes: DataFrame, services: DataFrame) -> DataFrame:
    """Changes below each service directory (the root service owns all paths)."""
    per_dir = changes.groupBy("project_id", dir_of(F.col("path")).alias("dir")).agg(
        F.sum("changes").alias("changes")
    )
    owned = (
        with_owners(per_dir, services)
        .groupBy("project_id", F.col("owner_path").alias("path")).agg(F.sum("changes").alias("churn"))
    )
    return services.join(owned, ["project_id", "path"], "left").select(
        "project_id", F.col("name").alias("service"), "path",
        F.coalesce("churn", F.lit(0)).cast("bigint").alias("churn"),
    )


def churn_lines(commits: DataFrame, commit_files: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Added and deleted lines and commits by file, author, date, and in total.

    Grouping sets of one joined relation: by file, and by commit, from which the other levels follow.
    """
    recent = commits.where(F.col("committed_at") >= since(as_of, days=days)).select(
        "project_id", "commit_id", "author", F.to_date("committed_at").cast("string").alias("date")
    )
    rows = commit_files.join(recent, ["project_id", "commit_id"])
    sums = [F.sum("added").alias("added"), F.sum("deleted").alias("deleted")]
    # a path stands once in a commit, so rows count the commits of a file; those of a commit become one first
    parts = rows.groupingSets(
        [["project_id", "path"], ["project_id", "commit_id", "author", "date"]],
        "project_id", "path", "commit_id", "author", "date",
    ).agg(*sums, F.count("*").alias("rows"), F.grouping("path").alias("of_commit"))

    def at(level: str, key: Column, commits: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), key.alias("key"), commits.alias("commits"))

    one = F.lit(1).cast("bigint")
    of_commit = F.array(at("author", F.col("author"), one), at("date", F.col("date"), one), at("total", F.lit("all"), one))
    of_file = F.array(at("file", F.col("path"), F.col("rows")))
    out = parts.select(
        "project_id", "added", "deleted", F.inline(F.when(F.col("of_commit") == 1, of_commit).otherwise(of_file))
    ).groupBy("project_id", "level", "key").agg(*sums, F.sum("commits").alias("commits"))
    return out.select("project_id", "key", "added", "deleted", "commits", "level")


def bug_rate(commits: DataFrame, as_of: str | None = None, months: int = 6) -> DataFrame:
    rows = commits if as_of is None else commits.where(
        F.col("committed_at") >= since(as_of, months=months)
    )
    bugs = F.count_if(is_bug_fix())
    return rows.groupBy("project_id").agg(
        F.count("*").alias("commits"), bugs.alias("bug_count"),
        (bugs / F.count("*")).alias("bug_rate"),
    )


def bug_prone_files(
    commits: DataFrame, commit_files: DataFrame, as_of: str, months: int = 6,
    n: int = 20,
) -> DataFrame:
    """Paths counted over all bug commits of the window, top n per project."""
    latest = (
        bug_fix_commits(commits)
        .where(F.col("committed_at") >= since(as_of, months=months))
        .select("project_id", "commit_id")
    )
    counted = commit_files.join(latest, ["project_id", "commit_id"]).groupBy(
        "project_id", "path"
    ).agg(F.count("*").alias("bugs"))
    top = Window.partitionBy("project_id").orderBy(F.col("bugs").desc(), "path")
    return counted.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= n)


def bugs_by_model(
    commits: DataFrame, commit_files: DataFrame, models: DataFrame, as_of: str, months: int = 6,
) -> DataFrame:
    """Bug commits with a touched path that contains the model name."""
    bugs = bug_fix_commits(commits).where(
        F.col("committed_at") >= since(as_of, months=months)
    ).select("project_id", "commit_id")
    touched = commit_files.join(bugs, ["project_id", "commit_id"]).select(
        "project_id", "commit_id", "path"
    )
    pairs = contains_pairs(
        touched, models.select("project_id", F.col("name").alias("needle")),
        text="path",
    )
    return (
        pairs.select("project_id", "commit_id", F.col("needle").alias("model")).distinct()
        .groupBy("project_id", "model").agg(F.count("*").alias("bugs"))
    )


def change_impact_by_model(mentions: DataFrame, models: DataFrame) -> DataFrame:
    """Distinct kept source files that mention each model name; 0 if none."""
    used = (
        mentions.where(
            ~F.col("ignored") & F.col("extension").isin(rules.CONSUMER_CODE)
        )
        .groupBy("project_id", "model").agg(F.count("*").alias("files"))
    )
    names = models.select("project_id", F.col("name").alias("model")).distinct()
    return names.join(used, ["project_id", "model"], "left").select(
        "project_id", "model", F.coalesce("files", F.lit(0)).cast("bigint").alias("impact")
    )


def change_impact(by_model: DataFrame) -> DataFrame:
    return by_model.groupBy("project_id").agg(
        F.avg("impact").alias("avg_change_impact"), F.max("impact").alias("max_change_impact")
    )


def estimate_churn(inventory: DataFrame, n: int = 20) -> DataFrame:
    """Stand-in without history: every kept file changed once; first n by path."""
    w = Window.partitionBy("project_id").orderBy("path")
    files = kept(inventory)
    totals = files.groupBy("project_id").agg(F.count("*").alias("commit_count"))
    top = (
        files.select("project_id", "path", F.lit(1).cast("bigint").alias("changes"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    )
    return top.join(totals, "project_id")


def estimate_bugs(features: DataFrame) -> DataFrame:
    """Stand-in without history: file names and TODO/FIXME comments of kept files."""
    files = features.where(~F.col("ignored"))
    bugs = F.sum(F.col("bug_name").cast("bigint") + F.col("todos"))
    return files.groupBy("project_id").agg(
        bugs.alias("bug_count"),
        F.coalesce(F.try_divide(bugs, F.count("*")), F.lit(0.0)).alias("bug_rate"),
    )


def estimate_bug_prone_files(features: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.col("bugs").desc(), "path")
    flags = F.col("bug_name").cast("bigint") + F.col("bug_marker").cast("bigint")
    return (
        features.where(~F.col("ignored")).select("project_id", "path", flags.alias("bugs"))
        .where(F.col("bugs") > 0)
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    )


def change_concentration(top: DataFrame) -> DataFrame:
    """Changes in the first five and in all of the top-changed files."""
    return top.groupBy("project_id").agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("changes")).otherwise(F.lit(0))).alias("top5_changes"),
        F.sum("changes").alias("top20_changes"),
    )
