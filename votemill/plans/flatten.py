"""Queries of the nested histories (problem 1) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votemill.operators import nested
from votemill.sources.tables import histories, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit, file and added line of both history tables, named by its places."""
    typed = nested.typed_positions(histories(spark, sf_dir, repo=("delivered_at",), file=("filename", "added_lines")), "history_id", "delivered_at")
    raw = nested.text_positions(table(spark, sf_dir, "history_raw"), "record_id", "payload", "received_at")
    return nested.once(typed.unionByName(raw))


def _typed(spark: SparkSession, sf_dir: str, **fields: tuple[str, ...]) -> DataFrame:
    repo = ("delivered_at", *fields.pop("repo", ()))
    return nested.first_deliveries(histories(spark, sf_dir, repo=repo, **fields), "history_id", "delivered_at").withColumnRenamed("history_id", "record_id")


def _raw(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    """The rows of one level of the payloads."""
    return nested.text_rows(nested.first_deliveries(table(spark, sf_dir, "history_raw"), "record_id", "received_at"), "record_id", "payload", level)


def p1_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of repositories: one row per repository object of a delivery."""
    typed = _typed(spark, sf_dir, repo=("repo", "total_diffs_found")).select("record_id", F.lit(0).alias("repo_pos"), "repo", "total_diffs_found")
    raw = _raw(spark, sf_dir, 0).select("record_id", "repo_pos", F.col("fields")["repo"].alias("repo"), F.expr("try_cast(fields['total_diffs_found'] as int)").alias("total_diffs_found"))
    return typed.unionByName(raw)


def p1_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of commits; its parent is (record_id, repo_pos)."""
    names = ("hash", "base_sha", "commit_author", "commit_date", "commit_message")
    typed = _typed(spark, sf_dir, commit=names).select("record_id", F.lit(0).alias("repo_pos"), F.posexplode("acf_commits").alias("commit_pos", "c")).where("c is not null").select("record_id", "repo_pos", "commit_pos", "c.*")
    m = F.col("fields")
    raw = _raw(spark, sf_dir, 1).select("record_id", "repo_pos", "commit_pos", *[m[n].alias(n) for n in names[:-1]], F.coalesce(m["commit_message"], m["message"]).alias("commit_message"))
    return typed.unionByName(raw)


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of files; its parent is (record_id, repo_pos, commit_pos)."""
    names = ("filename", "status", "additions", "deletions", "changes", "patch", "previous_filename")
    commits = _typed(spark, sf_dir, file=names).select("record_id", F.lit(0).alias("repo_pos"), F.posexplode("acf_commits").alias("commit_pos", "c"))
    typed = commits.select("record_id", "repo_pos", "commit_pos", F.posexplode("c.acf_files").alias("file_pos", "f")).where("f is not null").select("record_id", "repo_pos", "commit_pos", "file_pos", "f.*")
    kinds = {"additions": "int", "deletions": "int", "changes": "int"}
    fields = [F.expr(f"try_cast(fields['{n}'] as {kinds[n]})").alias(n) if n in kinds else F.col("fields")[n].alias(n) for n in names]
    raw = _raw(spark, sf_dir, 2).select("record_id", "repo_pos", "commit_pos", "file_pos", *fields)
    return typed.unionByName(raw)


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of added lines; its parent is (record_id, repo_pos, commit_pos, file_pos)."""
    commits = _typed(spark, sf_dir, file=("added_lines",)).select("record_id", F.lit(0).alias("repo_pos"), F.posexplode("acf_commits").alias("commit_pos", "c"))
    files = commits.select("record_id", "repo_pos", "commit_pos", F.posexplode("c.acf_files").alias("file_pos", "f"))
    typed = files.select("record_id", "repo_pos", "commit_pos", "file_pos", F.posexplode("f.added_lines").alias("line_pos", "line")).where("line is not null")
    raw = _raw(spark, sf_dir, 3).select("record_id", "repo_pos", "commit_pos", "file_pos", "line_pos", F.col("value").alias("line"))
    return typed.unionByName(raw)


_SQL = """
with g as (select * from (select *, row_number() over (partition by history_id order by delivered_at) n from git_history_diffs) where n = 1),
gc as (select history_id record_id, 0 repo_pos, i - 1 commit_pos, acf_commits[i] c from (select *, unnest(range(1, len(acf_commits) + 1)) i from g) where acf_commits[i] is not null),
gf as (select record_id, repo_pos, commit_pos, j - 1 file_pos, c.acf_files[j] f from (select *, unnest(range(1, len(c.acf_files) + 1)) j from gc) where c.acf_files[j] is not null),
gl as (select record_id, repo_pos, commit_pos, file_pos, k - 1 line_pos, f.added_lines[k] line from (select *, unnest(range(1, len(f.added_lines) + 1)) k from gf) where f.added_lines[k] is not null),
h as (select record_id, cast(ltrim(payload, chr(65279)) as json) p from (select *, row_number() over (partition by record_id order by received_at) n from history_raw where trim(payload) <> '') where n = 1),
l0 as (select record_id, case json_type(p) when 'ARRAY' then json_extract(p, '$[*]') else [p] end xs from h),
hr as (select record_id, i - 1 repo_pos, xs[i] r from (select *, unnest(range(1, len(xs) + 1)) i from l0) where json_type(xs[i]) <> 'NULL'),
l1 as (select *, case json_type(r, '$.acf_commits') when 'ARRAY' then json_extract(r, '$.acf_commits[*]') when 'OBJECT' then [json_extract(r, '$.acf_commits')] end xs from hr),
hc as (select record_id, repo_pos, i - 1 commit_pos, xs[i] c from (select *, unnest(range(1, len(xs) + 1)) i from l1) where json_type(xs[i]) <> 'NULL'),
l2 as (select *, case json_type(c, '$.acf_files') when 'ARRAY' then json_extract(c, '$.acf_files[*]') when 'OBJECT' then [json_extract(c, '$.acf_files')] end xs from hc),
hf as (select record_id, repo_pos, commit_pos, i - 1 file_pos, xs[i] f from (select *, unnest(range(1, len(xs) + 1)) i from l2) where json_type(xs[i]) <> 'NULL'),
l3 as (select *, case json_type(f, '$.added_lines') when 'ARRAY' then json_extract(f, '$.added_lines[*]') when 'VARCHAR' then [json_extract(f, '$.added_lines')] end xs from hf),
hl as (select record_id, repo_pos, commit_pos, file_pos, i - 1 line_pos, xs[i] line from (select *, unnest(range(1, len(xs) + 1)) i from l3) where json_type(xs[i]) <> 'NULL')
"""
_I = "cast(record_id as bigint) record_id, cast(repo_pos as int) repo_pos, cast(commit_pos as int) commit_pos"

QUERIES = {"p1_found": p1_found, "p1_repos": p1_repos, "p1_commits": p1_commits, "p1_files": p1_files, "p1_lines": p1_lines}
SQL = {
    "p1_found": _SQL
    + f"""select {_I}, cast(file_pos as int) file_pos, cast(line_pos as int) line_pos from (
select record_id, repo_pos, commit_pos, -1 file_pos, -1 line_pos from gc union all select record_id, repo_pos, commit_pos, file_pos, -1 from gf union all select record_id, repo_pos, commit_pos, file_pos, line_pos from gl
union all select record_id, repo_pos, commit_pos, -1, -1 from hc union all select record_id, repo_pos, commit_pos, file_pos, -1 from hf union all select record_id, repo_pos, commit_pos, file_pos, line_pos from hl)""",
    "p1_repos": _SQL
    + """select history_id record_id, cast(0 as int) repo_pos, repo, total_diffs_found from g
union all select record_id, cast(repo_pos as int), r->>'$.repo', try_cast(r->>'$.total_diffs_found' as int) from hr""",
    "p1_commits": _SQL
    + f"""select {_I}, c.hash, c.base_sha, c.commit_author, c.commit_date, c.commit_message from gc
union all select {_I}, c->>'$.hash', c->>'$.base_sha', c->>'$.commit_author', c->>'$.commit_date', coalesce(c->>'$.commit_message', c->>'$.message') from hc""",
    "p1_files": _SQL
    + f"""select {_I}, cast(file_pos as int) file_pos, f.filename, f.status, f.additions, f.deletions, f.changes, f.patch, f.previous_filename from gf
union all select {_I}, cast(file_pos as int), f->>'$.filename', f->>'$.status', try_cast(f->>'$.additions' as int), try_cast(f->>'$.deletions' as int), try_cast(f->>'$.changes' as int), f->>'$.patch', f->>'$.previous_filename' from hf""",
    "p1_lines": _SQL
    + f"""select {_I}, cast(file_pos as int) file_pos, cast(line_pos as int) line_pos, line from gl
union all select {_I}, cast(file_pos as int), cast(line_pos as int), line->>'$' from hl""",
}
