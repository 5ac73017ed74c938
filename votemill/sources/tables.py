"""Readers for the delivered parquet tables and the explodes of the nested history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE_TYPES = {"additions": "int", "deletions": "int", "changes": "int", "added_lines": "array<string>", "removed_lines": "array<string>"}
_COMMIT_TYPES = {"diff_index": "int", "included_in_windows": "array<int>"}
FILE_FIELDS = ("filename", "status", "additions", "deletions", "changes", "patch", "previous_filename", "added_lines", "removed_lines", "blob_url", "raw_url")
COMMIT_FIELDS = ("hash", "base_sha", "diff_index", "included_in_windows", "content_commit_sha", "commit_source", "url", "commit_author", "commit_date", "commit_message")
REPO_TYPES = {"history_id": "bigint", "repo": "string", "last_commit_date": "string", "total_diffs_found": "int", "acf_patterns": "array<string>", "delivered_at": "timestamp_ntz"}


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """One delivered table; a file or a folder of part files."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def history_schema(repo: tuple[str, ...] = (), commit: tuple[str, ...] = (), file: tuple[str, ...] = ()) -> str:
    """A read schema of git_history_diffs with only the named leaves.

    Spark prunes nested leaves through one explode at most, so the pruned schema is given to
    the scan: a query on messages reads no patch.
    """
    fields = [f"`{n}` {_FILE_TYPES.get(n, 'string')}" for n in file]
    files = [f"acf_files array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>>"] if fields else []
    inner = [f"`{n}` {_COMMIT_TYPES.get(n, 'string')}" for n in commit] + files
    commits = f", acf_commits array<struct<{', '.join(f.replace(' ', ': ', 1) for f in inner)}>>" if inner else ""
    names = ("history_id", *[n for n in repo if n != "history_id"])
    return ", ".join(f"{n} {REPO_TYPES[n]}" for n in names) + commits


def histories(spark: SparkSession, sf_dir: str, repo: tuple[str, ...] = (), commit: tuple[str, ...] = (), file: tuple[str, ...] = ()) -> DataFrame:
    """git_history_diffs with only the named leaves."""
    return table(spark, sf_dir, "git_history_diffs", history_schema(repo, commit, file))


def commit_units(h: DataFrame) -> DataFrame:
    """One row per non-null commit element: history_id, commit_pos and the struct ``c``.

    A null or empty array gives no row; a null element gives no row but keeps its place;
    a repeated delivery gives its rows again.
    """
    return h.select("history_id", F.posexplode("acf_commits").alias("commit_pos", "c")).where("c is not null")


def file_units(h: DataFrame) -> DataFrame:
    """One row per non-null file element: history_id, commit_pos, file_pos and the struct ``f``; as commit_units."""
    return commit_units(h).select("history_id", "commit_pos", F.posexplode("c.acf_files").alias("file_pos", "f")).where("f is not null")
