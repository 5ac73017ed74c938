"""Queries over change histories: patches, trajectories, duplicates, rollups, upserts."""

from __future__ import annotations


from pyspark.sql import functions as F

from votemill.functions import text as X
from votemill.operators.history import with_position, with_prior
from votemill.operators.nested import first_deliveries
from votemill.sources.tables import commit_units, file_units, histories, table


def _diffs(spark, d):
    """Distinct rated diffs: repo, filename, commit_time, diff_id."""
    return table(spark, d, "recovered_20260714_204326").where("diff_id is not null").select("repo", "filename", "commit_time", "diff_id").distinct()





def prior_three(spark, d):
    """Up to three earlier diffs of the same file, the oldest first."""
    p = with_prior(_diffs(spark, d), ["repo", "filename"], ["commit_time", "diff_id"], F.substring("commit_time", 1, 7), F.col("diff_id"))
    return p.select("repo", "filename", "commit_time", "diff_id", F.array_join("prior", ",").alias("prior"))


def running_position(spark, d):
    """The place of each diff in the history of its file, and the length of that history."""
    return with_position(_diffs(spark, d), ["repo", "filename"], ["commit_time", "diff_id"], F.substring("commit_time", 1, 7))


def prefix_windows(spark, d):
    """Of the windows of 3, 5 and 10 newest diffs of a repository, those that hold a commit."""
    c = commit_units(histories(spark, d, commit=("hash", "diff_index"))).where("c.diff_index is not null")
    w = F.filter(F.array(F.lit(3), F.lit(5), F.lit(10)), lambda n: F.col("c.diff_index") <= n)
    return c.select("history_id", "commit_pos", F.array_join(w.cast("array<string>"), ",").alias("windows")).distinct()


def patch_counts(spark, d):
    """Added and removed lines, changed lines with blank ones, and a digest of the changed text, per file."""
    f = file_units(histories(spark, d, file=("patch",))).select("history_id", "commit_pos", "file_pos", F.col("f.patch").alias("p")).where("p is not null")
    x = f.select("history_id", "commit_pos", "file_pos", X.patch_profile(F.col("p")).alias("x"))
    added = F.aggregate("x.full", F.lit(0), lambda n, p: n + F.when(p["s"] == "+", 1).otherwise(0))
    text = F.array_join(F.transform("x.full", lambda p: F.concat(p["s"], F.lit(" "), p["t"])), "\n")
    y = x.select("history_id", "commit_pos", "file_pos", "x.changed", F.size("x.full").alias("full"), added.alias("added"), F.md5(text).alias("digest"))
    return y.select("history_id", "commit_pos", "file_pos", "added", (F.col("full") - F.col("added")).alias("removed"), "changed", "digest").distinct()


def patch_missing_reason(spark, d):
    """Why a file has no patch."""
    f = file_units(histories(spark, d, file=("patch", "status"))).select("f.*")
    why = F.when(F.col("status") == "renamed", "renamed_without_changes").when(F.col("status").isNull(), "status_missing").otherwise("too_large_or_binary")
    return f.where("coalesce(patch, '') = ''").groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def diff_text(spark, d):
    """A file's patch, or one rebuilt from removed and then added lines; files without either are left out."""
    f = file_units(histories(spark, d, file=("patch", "added_lines", "removed_lines"))).select("history_id", "commit_pos", "file_pos", "f.*")
    sign = lambda c, s: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(s), x))
    rebuilt = F.array_join(F.concat(sign(F.col("removed_lines"), "-"), sign(F.col("added_lines"), "+")), "\n")
    text = F.coalesce(F.nullif("patch", F.lit("")), F.nullif(rebuilt, F.lit("")))
    return f.select("history_id", "commit_pos", "file_pos", F.length(text).alias("chars"), F.md5(text).alias("digest")).where("digest is not null").distinct()


def duplicate_hashes(spark, d):
    """Hashes that one repository's delivered commits hold more than once; repeated deliveries count once."""
    h = first_deliveries(histories(spark, d, repo=("repo", "delivered_at"), commit=("hash",)), "history_id", "delivered_at")
    c = h.select("repo", F.explode("acf_commits.hash").alias("hash")).where("trim(hash) <> ''")
    return c.groupBy("repo", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def commit_rollup(spark, d):
    """Per commit: files, additions, deletions, the author or N/A; repeated deliveries count once."""
    h = first_deliveries(histories(spark, d, repo=("delivered_at",), commit=("hash", "commit_author"), file=("filename", "additions", "deletions")), "history_id", "delivered_at")
    c = commit_units(h).select("history_id", "commit_pos", F.coalesce(F.nullif(F.trim("c.commit_author"), F.lit("")), F.lit("N/A")).alias("author"), F.col("c.acf_files").alias("fs"))
    total = lambda f: F.aggregate(F.coalesce(F.transform("fs", lambda x: F.coalesce(x[f], F.lit(0)).cast("bigint")), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    files = F.size(F.filter(F.coalesce("fs", F.array().cast(h.schema["acf_commits"].dataType.elementType["acf_files"].dataType)), lambda x: x["filename"].isNotNull()))
    return c.select("history_id", "commit_pos", "author", files.alias("files"), total("additions").alias("additions"), total("deletions").alias("deletions"))


def top_commits(spark, d):
    """The ten commits with the most files and changes."""
    return commit_rollup(spark, d).withColumn("changes", F.col("additions") + F.col("deletions")).orderBy(F.desc("files"), F.desc("changes"), "history_id", "commit_pos").limit(10).select("history_id", "commit_pos", "files", "changes")


def top_contributors(spark, d):
    """The ten authors with the most commits, shown from the fewest."""
    t = commit_rollup(spark, d).groupBy("author").agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "author").limit(10)
    return t.orderBy("commits", F.desc("author"))


def repo_distribution(spark, d):
    """Repositories by their most delivered diffs: smallest, median, mean, largest, and how many reach 3, 5, 10."""
    r = table(spark, d, "git_history_diffs").groupBy("repo").agg(F.max("total_diffs_found").alias("n")).where("n is not null")
    # Equal numbers are counted first, so the percentile holds the distinct numbers only.
    c = r.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    at = [F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("k"))), F.lit(0)).alias(f"at_least_{k}") for k in (3, 5, 10)]
    return c.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("repos"), F.min("n").alias("least"), F.floor(F.percentile("n", 0.5, F.col("k"))).alias("median"), F.round(F.try_divide(F.sum(F.col("n") * F.col("k")), F.sum("k")), 6).alias("mean"), F.max("n").alias("most"), *at)


def valid_repo_semi(spark, d):
    """Histories of repositories with at least five diffs."""
    r = table(spark, d, "git_history_diffs")
    ok = r.groupBy("repo").agg(F.max("total_diffs_found").alias("n")).where("n >= 5").select("repo")
    return r.select("history_id", "repo").distinct().join(ok, "repo", "left_semi")


_EAST = "[\\u3040-\\u30FF\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F]"


def unicode_filter(spark, d):
    """Commits whose message holds kana or hangul."""
    m = commit_units(histories(spark, d, commit=("commit_message",)))
    return m.where(F.col("c.commit_message").rlike(_EAST)).select("history_id", "commit_pos").distinct()


def excluded_anti(spark, d):
    """Histories of repositories no message of which holds kana or hangul."""
    h = histories(spark, d, repo=("repo",), commit=("commit_message",))
    out = h.select("repo", F.explode("acf_commits").alias("c")).where(F.col("c.commit_message").rlike(_EAST)).select("repo").distinct()
    return h.select("history_id", "repo").distinct().join(out, "repo", "left_anti")


def resume_anti(spark, d):
    """Files' diffs that no model has rated yet."""
    h = histories(spark, d, commit=("hash",), file=("filename",))
    c = h.select(F.explode("acf_commits").alias("c")).select(F.col("c.hash").alias("hash"), F.explode("c.acf_files.filename").alias("filename"))
    ids = c.where("trim(hash) <> '' and filename is not null").select(F.concat_ws(":", "hash", "filename").alias("diff_id")).distinct()
    return ids.join(table(spark, d, "recovered_20260714_204326").select("diff_id").where("diff_id is not null"), "diff_id", "left_anti")


def upsert_merge(spark, d):
    """The ratings' messages merged into the histories' commits by repository and hash: non-empty new values win, unknown hashes are added.  A missing repository is blank."""
    h = histories(spark, d, repo=("repo",), commit=("hash", "commit_message")).select(F.coalesce("repo", F.lit("")).alias("repo"), F.explode("acf_commits").alias("c"))
    old = h.where("trim(c.hash) <> ''").groupBy("repo", "c.hash").agg(F.min("c.commit_message").alias("old"))
    new = table(spark, d, "recovered_20260714_204326").where("trim(commit_hash) <> ''").groupBy(F.coalesce("repo", F.lit("")).alias("repo"), F.col("commit_hash").alias("hash")).agg(F.max("commit_message").alias("new"))
    return old.join(new, ["repo", "hash"], "full").select("repo", "hash", F.md5(F.coalesce(F.nullif("new", F.lit("")), "old")).alias("digest"), F.col("old").isNull().alias("added"))


def nested_groups(spark, d):
    """Repositories with their commits and the files of each, from flat rows back to nested ones.

    A repository comes in slices by month, so that no row holds all of a large one.
    """
    f = _diffs(spark, d).where("repo is not null and commit_time is not null and filename is not null").select("repo", F.split("diff_id", ":")[0].alias("hash"), "commit_time", "filename")
    commits = f.groupBy("repo", "hash").agg(F.min("commit_time").alias("t"), F.array_join(F.sort_array(F.collect_set("filename")), ",").alias("files"))
    flat = commits.withColumn("x", F.concat_ws("|", "t", "hash", "files"))
    return flat.groupBy("repo", F.substring("t", 1, 7).alias("month")).agg(F.array_join(F.sort_array(F.collect_list("x")), "\n").alias("commits"))


def message_functions(spark, d):
    """First line, cleaned and cut text, marks of lost characters and a token estimate, per message."""
    m = commit_units(histories(spark, d, commit=("commit_message",))).select("history_id", "commit_pos", F.col("c.commit_message").alias("m")).where("m is not null")
    marks = (F.length("m") - F.length(F.replace("m", F.lit("?"), F.lit("")))) >= 3
    return m.select("history_id", "commit_pos", X.first_line(F.col("m")).alias("first_line"), X.truncate(F.col("m"), 80).alias("cut"), X.tokens_estimate(F.col("m")).alias("tokens"), marks.alias("marks")).distinct()


def url_anchor(spark, d):
    """Addresses of rated files within their commits."""
    r = _diffs(spark, d).where("filename is not null and repo is not null")
    return r.select("diff_id", F.concat(F.lit("https://git.example/"), "repo", F.lit("/commit/"), F.split("diff_id", ":")[0], X.anchor(F.col("filename"))).alias("url"), X.safe_name(F.col("diff_id")).alias("safe")).distinct()


def adjacent_pairs(spark, d):
    """Neighbouring commits of a history, the later and the earlier one."""
    h = first_deliveries(histories(spark, d, repo=("delivered_at",), commit=("hash",)), "history_id", "delivered_at")
    x = F.transform("acf_commits", lambda c, i: F.struct(i.alias("commit_pos"), c["hash"].alias("head"), F.get("acf_commits", i + 1)["hash"].alias("base")))
    return h.select("history_id", F.inline(x)).where("head is not null and base is not null")


_F = """with g as (select * from (select *, row_number() over (partition by history_id order by delivered_at) n from git_history_diffs) where n = 1),
c as (select history_id, repo, i - 1 commit_pos, acf_commits[i] c from (select *, unnest(range(1, len(acf_commits) + 1)) i from g) where acf_commits[i] is not null),
f as (select history_id, commit_pos, j - 1 file_pos, c.acf_files[j] f from (select *, unnest(range(1, len(c.acf_files) + 1)) j from c) where c.acf_files[j] is not null),
"""
_K = "cast(history_id as bigint) history_id, cast(commit_pos as int) commit_pos"
_D = "with df as (select distinct repo, filename, commit_time, diff_id from recovered_20260714_204326 where diff_id is not null), "
_SP = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_BR = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
_LN = _F + f"""ln as (select history_id, commit_pos, file_pos, string_split_regex(regexp_replace(f.patch, '(?:{_BR})$', ''), '{_BR}') ls from f where f.patch is not null),
st as (select *, [{{'s': x[1], 't': regexp_replace(x[2:], '^{_SP}|{_SP}$', '', 'g')}} for x in ls if x[1] in ('+', '-') and x[1:3] not in ('+++', '---')] ch from ln)
"""

QUERIES = {f.__name__: f for f in (prior_three, running_position, prefix_windows, patch_counts, patch_missing_reason, diff_text, duplicate_hashes, commit_rollup, top_commits, top_contributors, repo_distribution, valid_repo_semi, unicode_filter, excluded_anti, resume_anti, upsert_merge, nested_groups, message_functions, url_anchor, adjacent_pairs)}
_ROLL = _F + """ro as (select history_id, commit_pos, coalesce(nullif(trim(c.commit_author), ''), 'N/A') author, coalesce(len(list_filter(c.acf_files, lambda x: x.filename is not null)), 0) files, coalesce(list_sum([coalesce(x.additions, 0) for x in c.acf_files]), 0) additions, coalesce(list_sum([coalesce(x.deletions, 0) for x in c.acf_files]), 0) deletions from c)
"""
SQL = {
    "prior_three": _D + "x as (select 1) select repo, filename, commit_time, diff_id, coalesce(array_to_string(list(diff_id) over (partition by repo, filename order by commit_time nulls first, diff_id rows between 3 preceding and 1 preceding), ','), '') prior from df",
    "running_position": _D + "x as (select 1) select repo, filename, commit_time, diff_id, row_number() over (partition by repo, filename order by commit_time nulls first, diff_id) position, count(*) over (partition by repo, filename) total from df",
    "prefix_windows": _F + f"x as (select 1) select {_K}, array_to_string([w for w in [3, 5, 10] if c.diff_index <= w], ',') windows from c where c.diff_index is not null",
    "patch_counts": _LN + f"""select {_K}, cast(file_pos as int) file_pos, cast(len([x for x in ch if x.s = '+' and x.t <> '']) as int) added, cast(len([x for x in ch if x.s = '-' and x.t <> '']) as int) removed, cast(len(ch) as int) changed, md5(coalesce(array_to_string([x.s || ' ' || x.t for x in ch if x.t <> ''], chr(10)), '')) digest from st""",
    "patch_missing_reason": """with c as (select unnest(acf_commits) c from git_history_diffs), f as (select unnest(c.acf_files) f from c)
select case when f.status = 'renamed' then 'renamed_without_changes' when f.status is null then 'status_missing' else 'too_large_or_binary' end reason, count(*) files from f where f is not null and coalesce(f.patch, '') = '' group by 1""",
    "diff_text": _F + f"""t as (select history_id, commit_pos, file_pos, coalesce(nullif(f.patch, ''), nullif(array_to_string(list_concat([('-' || x) for x in coalesce(f.removed_lines, []) if x is not null], [('+' || x) for x in coalesce(f.added_lines, []) if x is not null]), chr(10)), '')) t from f)
select {_K}, cast(file_pos as int) file_pos, cast(length(t) as int) chars, md5(t) digest from t where t is not null""",
    "duplicate_hashes": _F + "x as (select 1) select repo, c.hash, count(*) n from c where trim(c.hash) <> '' group by 1, 2 having count(*) > 1",
    "commit_rollup": _ROLL + f"select {_K}, author, cast(files as int) files, cast(additions as bigint) additions, cast(deletions as bigint) deletions from ro",
    "top_commits": _ROLL + f"select {_K}, cast(files as int) files, cast(additions + deletions as bigint) changes from ro order by files desc, changes desc, history_id, commit_pos limit 10",
    "top_contributors": _ROLL + "select author, count(*) commits from ro group by 1 order by 2 desc, 1 limit 10",
    "repo_distribution": "select count(*) repos, min(n) least, cast(floor(quantile_cont(n, 0.5)) as bigint) median, round(avg(n), 6) mean, max(n) most, count(*) filter (n >= 3) at_least_3, count(*) filter (n >= 5) at_least_5, count(*) filter (n >= 10) at_least_10 from (select repo, max(total_diffs_found) n from git_history_diffs group by 1) where n is not null",
    "valid_repo_semi": "select distinct history_id, repo from git_history_diffs where repo in (select repo from git_history_diffs group by 1 having max(total_diffs_found) >= 5)",
    "unicode_filter": _F + f"x as (select 1) select {_K} from c where regexp_matches(c.commit_message, '[\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}]')",
    "excluded_anti": _F + "x as (select 1) select distinct history_id, repo from git_history_diffs g where not exists (select 1 from c where c.repo = g.repo and regexp_matches(c.commit_message, '[\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]'))",
    "resume_anti": _F + "i as (select distinct c.hash || ':' || f.filename diff_id from f join c using (history_id, commit_pos) where trim(c.hash) <> '' and f.filename is not null) select diff_id from i where diff_id not in (select diff_id from recovered_20260714_204326 where diff_id is not null)",
    "upsert_merge": _F + """o as (select coalesce(repo, '') repo, c.hash, min(c.commit_message) o from c where trim(c.hash) <> '' group by 1, 2), n as (select coalesce(repo, '') repo, commit_hash hash, max(commit_message) n from recovered_20260714_204326 where trim(commit_hash) <> '' group by 1, 2)
select repo, hash, md5(coalesce(nullif(n, ''), o)) digest, o is null added from o full join n using (repo, hash)""",
    "nested_groups": _D + """k as (select repo, split_part(diff_id, ':', 1) hash, min(commit_time) t, string_agg(distinct filename, ',' order by filename) files from df where repo is not null and commit_time is not null and filename is not null group by 1, 2)
select repo, t[1:7] "month", string_agg(t || '|' || hash || '|' || files, chr(10) order by t || '|' || hash || '|' || files) commits from k group by 1, 2""",
    "message_functions": _F + f"""m as (select history_id, commit_pos, c.commit_message m from c where c.commit_message is not null)
select {_K}, string_split_regex(m, '{_BR}')[1] first_line, case when length(m) > 80 then m[1:60] || chr(10) || '...TRUNCATED...' else m end cut, cast(greatest(1, length(m) // 4) as int) tokens, length(m) - length(replace(m, '?', '')) >= 3 marks from m""",
    "url_anchor": _D + "x as (select 1) select distinct diff_id, 'https://git.example/' || repo || '/commit/' || split_part(diff_id, ':', 1) || '#diff-' || sha256(filename) url, trim(regexp_replace(diff_id, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') safe from df where filename is not null and repo is not null",
    "adjacent_pairs": _F + f"x as (select history_id, i - 1 commit_pos, acf_commits[i].hash head, acf_commits[i + 1].hash base from (select *, unnest(range(1, len(acf_commits) + 1)) i from g)) select {_K}, head, base from x where head is not null and base is not null",
}
