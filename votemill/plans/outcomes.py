"""Queries on what became of the models' answers, on label spaces, and on texts as they are shown."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from votemill.functions import outcomes as O
from votemill.functions import responses as R
from votemill.functions import text as X
from votemill.operators import agreement as A
from votemill.operators import classify as C
from votemill.operators import gold as G
from votemill.operators import votes as V
from votemill.plans import basics, histories as H, panel, ratings
from votemill.sources import listings, taxonomy
from votemill.sources.tables import commit_units, file_units, histories, table

_R9 = lambda c: F.round(c, 9).alias(c)



def _ratings(spark, d):
    return table(spark, d, "recovered_20260714_204326").where("diff_id is not null")


def rescue_categories(spark, d):
    """The category a diff without any score would be given, per file with changed lines."""
    f = file_units(histories(spark, d, file=("patch",))).select("history_id", "commit_pos", "file_pos", F.col("f.patch").alias("p")).where("p is not null")
    mine = F.filter(X.lines(F.col("p")), lambda x: x.rlike("^[+-]") & ~x.startswith("+++") & ~x.startswith("---"))
    changed = F.array_join(F.transform(mine, lambda x: F.substring(x, 2, 2**31 - 1)), "\n")
    return f.where(F.size(mine) > 0).select("history_id", "commit_pos", "file_pos", O.rescue_category(changed).alias("category"), O.direction(F.array_join(X.patch_lines(F.col("p"), "+"), "\n")).alias("direction")).distinct()


def _outcome(spark, d):
    r = _ratings(spark, d)
    return r.select("diff_id", F.col("primary_result.model").alias("model"), "status", F.col("category_scores").alias("scores"), F.coalesce("chunk_plan.original_chars", F.lit(0)).alias("changed"), F.col("primary_result.validation_errors").alias("errors"), F.coalesce("primary_result.diff_retry_count", F.lit(0)).alias("tries"), F.col("primary_result.error").alias("error"))


def chunk_statuses(spark, d):
    """Records by the status their scores, errors and retries stand for."""
    s = O.chunk_status(F.col("scores"), F.col("changed"), F.col("errors"), F.col("tries") > 0)
    return _outcome(spark, d).groupBy(s.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def retry_candidates(spark, d):
    """Records whose answer should be asked for again, by model."""
    need = O.needs_retry(F.col("error").isNull(), F.col("errors"), F.col("scores"), F.col("changed"), F.col("tries"))
    return _outcome(spark, d).groupBy("model").agg(F.count(F.when(need, 1)).alias("again"), F.count(F.lit(1)).alias("n"), F.sum(F.when(need, O.back_off(F.col("tries") + 1)).otherwise(0.0)).alias("seconds"))


def missing_list_records(spark, d):
    """Diffs with a record whose answer had no list of categories."""
    return _outcome(spark, d).where(O.has_missing_list(F.col("errors"))).select("diff_id").distinct()


def error_split(spark, d):
    """Records with and without an error, and whether they have an axis of their own."""
    r = _ratings(spark, d)
    kind = F.when(F.col("primary_result.error").isNotNull(), "error").otherwise("answer")
    axis = (F.coalesce("maintenance.primary_maintenance_type", F.lit("")) != "") | (F.coalesce(F.size("maintenance.type_scores"), F.lit(0)) > 0)
    return r.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(axis), F.lit(False)).alias("has_maintenance"))


def eval_records(spark, d):
    """The flat record of each rating."""
    return _ratings(spark, d).select("diff_id", F.col("primary_result.model").alias("model"), "recorded_at", F.col("primary_result.primary_category").alias("primary_category"), F.greatest(F.coalesce(F.size("category_scores"), F.lit(0)), F.lit(0)).alias("scores"), F.greatest(F.coalesce(F.size("flagged_categories"), F.lit(0)), F.lit(0)).alias("flagged"), F.col("maintenance.primary_maintenance_type").alias("primary_maintenance_type"), F.coalesce("maintenance.maintenance_class", F.lit("")).alias("maintenance_class"), F.coalesce("maintenance.maintenance_base_type", F.lit("")).alias("maintenance_base_type"), F.coalesce("chunk_plan.chunk_count", F.lit(0)).alias("chunk_count"))


def result_lists(spark, d):
    """The scores above zero of each record with their rationales, the highest first; by content, with how many records have it."""
    x = _ratings(spark, d).select("diff_id", O.result_list(F.col("category_scores"), F.col("flagged_categories")).alias("r")).where("r is not null")
    shown = F.array_join(F.transform("r", lambda e: F.concat(e["category"], F.lit(": "), e["rationale"])), "\n")
    return x.select("diff_id", F.md5(shown).alias("digest"), F.size("r").alias("results")).groupBy("diff_id", "digest", "results").agg(F.count(F.lit(1)).alias("n"))


def reference_records(spark, d):
    """Each record as a reference: the first of its results, or blank, is its category."""
    x = _ratings(spark, d).select("diff_id", F.col("primary_result.model").alias("model"), O.result_list(F.col("category_scores"), F.col("flagged_categories")).alias("r"))
    first = F.coalesce(F.try_element_at("r", F.lit(1))["category"], F.lit(""))
    return x.groupBy("model", first.alias("primary_category")).agg(F.count(F.lit(1)).alias("n"))


def filled_rows(spark, d):
    """Documents whose text and path are neither null nor blank."""
    blank = lambda c: F.length(F.btrim(F.col(c), F.lit(" \t\r\n"))) > 0
    return table(spark, d, "documents").where(blank("text") & blank("file_path")).select("doc_id")


def rater_alignment(spark, d):
    """Diffs that any, and that all, of the aligned models rated, and how many drop out."""
    n = ratings._latest(spark, d, ratings.MODELS).groupBy("item").agg(F.countDistinct("rater").alias("k"))
    both = F.count(F.when(F.col("k") == len(ratings.MODELS), 1))
    return n.agg(F.count(F.lit(1)).alias("union"), both.alias("aligned"), (F.count(F.lit(1)) - both).alias("dropped"))


def rater_id_sets(spark, d):
    """For each two models, how many diffs both rated, and how many either did.

    An item holds at most one entry per model; pairs of models are counted before the shuffle.
    """
    g = ratings._latest(spark, d, None).groupBy("item").agg(F.sort_array(F.collect_set("rater")).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b > a), lambda b: F.struct(a.alias("rater_a"), b.alias("rater_b")))))
    both = g.select(F.inline(pairs)).groupBy("rater_a", "rater_b").agg(F.count(F.lit(1)).alias("common"))
    own = g.select(F.explode("v").alias("rater")).groupBy("rater").agg(F.count(F.lit(1)).alias("n"))
    x = both.join(own.select(F.col("rater").alias("rater_a"), F.col("n").alias("na")), "rater_a").join(own.select(F.col("rater").alias("rater_b"), F.col("n").alias("nb")), "rater_b")
    return x.select("rater_a", "rater_b", "common", (F.col("na") + F.col("nb") - F.col("common")).alias("either"))


def observed_keys(spark, d):
    """Every name that a record scores, listed or not, with its records."""
    k = _ratings(spark, d).select(F.explode(F.map_keys("category_scores")).alias("name"))
    return k.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("listed", F.col("name").isin(*G.CATEGORIES))


def taxonomy_lookup(spark, d):
    """Records by maintenance type, with class and base from the label space beside those delivered."""
    r = _ratings(spark, d).where("maintenance.primary_maintenance_type <> ''").select("maintenance.*")
    x = taxonomy.looked_up(r, F.col("primary_maintenance_type"), taxonomy.maintenance(spark))
    same = (F.coalesce("maintenance_class", F.lit("")) == F.col("looked_class")) & (F.coalesce("maintenance_base_type", F.lit("")) == F.col("looked_base"))
    return x.groupBy(F.col("primary_maintenance_type").alias("leaf"), "looked_class", "looked_base").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(same, 1)).alias("as_delivered"))


def file_match(spark, d):
    """The file of a commit that has a rated path as its name or its former name, the first in order; not_found where there is none.

    Paths meet commits by hash; the match runs within a commit's own files.
    """
    paths = _ratings(spark, d).where("commit_hash is not null and filename is not null").select("commit_hash", "filename").distinct()
    c = commit_units(histories(spark, d, commit=("hash",), file=("filename", "status", "previous_filename"))).where("trim(c.hash) <> ''")
    first = c.groupBy(F.col("c.hash").alias("hash")).agg(F.min(F.struct("history_id", "commit_pos", F.col("c.acf_files").alias("fs"))).alias("m"))
    j = paths.join(first, F.col("commit_hash") == F.col("hash"), "left")
    hit = F.try_element_at(F.filter("m.fs", lambda f: (f["filename"] == F.col("filename")) | (f["previous_filename"] == F.col("filename"))), F.lit(1))
    return j.select("commit_hash", "filename", F.when(hit.isNull(), "not_found").otherwise(F.coalesce(hit["status"], F.lit(""))).alias("status"))


def panel_vs_reference_category(spark, d):
    """Kappa of each rater against the reference, by category, present or not."""
    s = panel._sets(spark, d, (*V.RATERS, V.REFERENCE))
    g = s.groupBy("item").agg(F.collect_list(F.struct("rater", "labels")).alias("v"))
    ref = F.try_element_at(F.filter("v", lambda x: x["rater"] == V.REFERENCE), F.lit(1))["labels"]
    x = g.withColumn("ref", ref).where("ref is not null").select("ref", F.explode(F.filter("v", lambda x: x["rater"] != V.REFERENCE)).alias("x")).select("ref", F.col("x.rater").alias("rater"), F.col("x.labels").alias("mine"), F.explode(F.array(*map(F.lit, V.PANEL))).alias("category"))
    a, b = F.array_contains("mine", F.col("category")).cast("int"), F.array_contains("ref", F.col("category")).cast("int")
    t = x.groupBy("rater", "category").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum((a == b).cast("int")).alias("same"))
    pa, pb, po = F.col("a") / F.col("n"), F.col("b") / F.col("n"), F.col("same") / F.col("n")
    return t.select("rater", "category", F.round(V.kappa(po, pa * pb + (1 - pa) * (1 - pb)), 9).alias("kappa"))


def panel_pooled_category(spark, d):
    """Fleiss and alpha by category with the reference as one more rater."""
    return A.by_category(panel._sets(spark, d, (*V.RATERS, V.REFERENCE)), V.PANEL).select("category", *map(_R9, ("fleiss_kappa", "krippendorff_alpha")))


_BASES = tuple(dict.fromkeys(m[2] for m in G.MAINTENANCE))


def maintenance_by_type(spark, d):
    """Fleiss and alpha of the models on each maintenance type, given or not; a blank label is no type."""
    l = G.latest(_ratings(spark, d)).where("rater is not null")
    s = l.select("item", "rater", F.filter(F.array("base"), lambda b: F.coalesce(b, F.lit("")) != "").alias("labels"))
    return A.by_category(s, _BASES).select("category", *map(_R9, ("prevalence", "not_unanimous", "fleiss_kappa", "krippendorff_alpha")))


def maintenance_vs_reference(spark, d):
    """Agreement and kappa of each model with the first of the aligned models, on base type and class."""
    l = G.latest(_ratings(spark, d)).where("rater is not null")
    out = None
    for axis in ("base", "class"):
        b = l.select("item", "rater", F.coalesce(axis, F.lit("")).alias("label"), F.array(F.coalesce(axis, F.lit(""))).alias("labels"))
        v = A.versus(b, ratings.MODELS[0]).select(F.lit(axis).alias("axis"), "rater", "n", _R9("agreement"), _R9("kappa"))
        out = v if out is None else out.unionByName(v)
    return out


def gold_coverage(spark, d):
    """Label instances among the labelled diffs; categories without any are kept with 0."""
    n = G.gold_sets(table(spark, d, "gold_sheet")).select(F.explode("gold").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.categories(spark).select(F.col("name").alias("category")).join(n, "category", "left").na.fill(0, ["n"])


def lifecycle_sequence(spark, d):
    """The changes of the picked file in order: place, day, and class as a level (Correction 0, Enhancement 1, none 0.5)."""
    pick = basics.lifecycle_pick(spark, d).select("repo", "filename")
    l = G.latest(_ratings(spark, d)).where("class <> ''").groupBy("item").agg(F.min("class").alias("class"))
    r = table(spark, d, "recovered_20260714_204326").where("repo is not null and filename is not null").groupBy(F.col("diff_id").alias("item")).agg(F.min("repo").alias("repo"), F.min("filename").alias("filename"), F.min("commit_time").alias("t"))
    x = r.join(pick, ["repo", "filename"], "left_semi").join(l, "item")
    # One file's history: it was picked as the smallest.
    place = F.row_number().over(Window.partitionBy("repo", "filename").orderBy(F.coalesce("t", F.lit("")), "item"))
    level = F.when(F.col("class") == "Enhancement", 1.0).when(F.col("class") == "Correction", 0.0).otherwise(0.5)
    return x.select(place.alias("place"), F.when(F.coalesce("t", F.lit("")) != "", F.substring("t", 1, 10)).otherwise(F.concat(F.lit("#"), place.cast("string"))).alias("day"), level.alias("level"))


def ranked_categories(spark, d):
    """The panel's categories by kappa, from the lowest and from the highest, undefined ones last in both; ties by name."""
    k = panel.panel_category_agreement(spark, d)
    # As many rows as categories.
    rank = lambda o: F.row_number().over(Window.orderBy(o, "category"))
    return k.select("category", rank(F.asc_nulls_last("fleiss_kappa")).alias("from_lowest"), rank(F.desc_nulls_last("fleiss_kappa")).alias("from_highest"))


def bias_ranks(spark, d):
    """The categories' places by bias, by primary and by general count; ties by name."""
    b = panel.label_bias(spark, d)
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "category")).alias(f"by_{c}")
    return b.select("category", *map(rank, ("bias_delta", "primary_count", "general_count")))


def newest_diffs(spark, d):
    """The fifty newest rated diffs of all repositories, by parsed time."""
    x = _ratings(spark, d).where("commit_time is not null").select("diff_id", "commit_time").distinct()
    at = F.try_to_timestamp(F.substring(F.replace("commit_time", F.lit("Z"), F.lit("")), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return x.withColumn("at", at).where("at is not null").orderBy(F.desc("at"), "diff_id").limit(50).select("diff_id", F.substring("commit_time", 1, 10).alias("day"))


def sample_reuse(spark, d):
    """The earlier sample drawn again: its ids that are still rated, in their first order of id, with the labels filled in, the merged sheet first."""
    sheet = table(spark, d, "gold_sheet").where("trim(diff_id) <> ''")
    fill = lambda c: F.max(F.nullif(F.trim(c), F.lit(""))).alias(c)
    kept = sheet.groupBy("diff_id").agg(fill("labels_gold"), fill("maintenance_gold"))
    there = _ratings(spark, d).select("diff_id").distinct()
    return kept.join(there, "diff_id", "left_semi").select("diff_id", F.coalesce("labels_gold", F.lit("")).alias("labels_gold"), F.coalesce("maintenance_gold", F.lit("")).alias("maintenance_gold"))


def prior_displays(spark, d):
    """Each commit in one line, its message folded to ASCII, and patterns of its files' paths."""
    c = commit_units(histories(spark, d, commit=("commit_date", "commit_message"), file=("filename",)))
    paths = F.array_join(F.transform(F.filter("c.acf_files", lambda f: f["filename"].isNotNull()), lambda f: O.path_pattern(f["filename"])), "|")
    return c.select("history_id", "commit_pos", O.prior_display(F.col("c.commit_date"), F.col("c.commit_message")).alias("shown"), F.md5(O.ascii_only(O.without_controls(F.coalesce("c.commit_message", F.lit(""))))).alias("ascii"), F.coalesce(paths, F.lit("")).alias("paths")).distinct()


def message_cleaning(spark, d):
    """Messages cleaned and redacted, and the seconds one names to wait."""
    m = commit_units(histories(spark, d, commit=("commit_message",))).select("history_id", "commit_pos", F.col("c.commit_message").alias("m")).where("m is not null")
    return m.select("history_id", "commit_pos", F.md5(X.clean(F.col("m"))).alias("clean"), F.md5(X.redact(F.col("m"))).alias("redacted"), X.seconds_to_wait(F.col("m")).alias("wait")).distinct()


def repo_slugs(spark, d):
    """Repositories named by the last two parts of their address, and what a failed reading would be called for each."""
    r = table(spark, d, "git_history_diffs").where("repo is not null").select("repo").distinct()
    k = F.length("repo")
    return r.select("repo", X.slug(F.concat(F.lit("https://git.example/"), "repo", F.lit(".git"))).alias("slug"), O.access(F.when(k % 4 == 0, 200).otherwise(404), k % 4 != 1, k % 4 == 2).alias("access"))


def single_label_scores(spark, d):
    """Each record's category as a single label: gated by its score, its map scaled to 1, and the score spread over the others; sums by category."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("category_scores", F.col("primary_result.primary_category")), F.lit(0.0))))
    r = _ratings(spark, d).where("primary_result.primary_category is not null").select(F.col("primary_result.primary_category").alias("label"), s.alias("s"), F.map_filter("category_scores", lambda k, v: v > 0).alias("m"))
    g = r.select(R.gate(F.col("label"), F.col("s"), 0.5, "Impl. Details").alias("category"), "s", F.aggregate(F.map_values(R.normalised(F.col("m"))), F.lit(0.0), lambda a, x: a + x).alias("one"), F.try_element_at(R.spread(F.col("label"), F.col("s"), G.CATEGORIES), F.lit("UI/UX")).alias("rest"))
    return g.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("one"), 6).alias("scaled"), F.round(F.sum("rest"), 6).alias("on_last"))


def best_rationales(spark, d):
    """The rationale of each diff's best record, by category, over its flagged categories."""
    r = table(spark, d, "recovered_20260714_204326").where("diff_id is not null")
    blank = lambda c: F.coalesce(f"primary_result.{c}", F.lit(""))
    place = F.row_number().over(Window.partitionBy("diff_id").orderBy("recorded_at", "primary_result.model", blank("primary_category"), blank("summary"), F.array_join("primary_result.validation_errors", ";"))) - 1
    flags = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("flagged_categories", lambda x: F.struct(x["category"].alias("k"), x["score"].alias("s"), x["rationale"].alias("r"))))), lambda x: F.struct(x["k"], x["r"])))
    once = F.size(F.array_distinct(F.transform("flagged_categories", lambda x: x["category"]))) == F.size(F.array_distinct(F.transform("flagged_categories", lambda x: F.struct(x["category"], x["score"], x["rationale"]))))
    x = r.withColumn("index", place).where("category_scores is not null").select(F.col("diff_id").alias("item"), "index", F.col("category_scores").alias("scores"), F.when(once, flags).alias("rationales"))
    return C.best_rationale(x, G.CATEGORIES).where("rationale <> ''").select("item", "category", F.md5("rationale").alias("digest"))


def best_summaries(spark, d):
    """The summary of each diff, by the category with the highest mean score over its records."""
    p = basics._pieces(spark, d)
    mean = basics.chunk_aggregate_mean(spark, d)
    top = mean.groupBy("item").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("m")).select("item", F.col("m.category").alias("category"))
    return C.best_summary(p, top).select("item", F.md5("summary").alias("digest"))


def commit_windows(spark, d):
    """Three commits from the second of each history on, as a paged listing of two a page gives them; the newest where there is no second."""
    h = histories(spark, d, repo=("delivered_at",), commit=("hash",)).where("history_id is not null").groupBy("history_id").agg(F.min(F.struct("delivered_at", "acf_commits")).alias("m"))
    all_ = F.filter(F.transform("m.acf_commits", lambda c: c["hash"]), lambda x: F.trim(x) != "")
    x = h.select("history_id", all_.alias("hs")).where("size(hs) > 0")
    page = F.explode(F.sequence(F.lit(0), F.floor((F.size("hs") - 1) / 2).cast("int"))).alias("page")
    pages = x.select("history_id", "hs", page).select("history_id", "page", F.lit(200).alias("status"), F.slice("hs", F.col("page") * 2 + 1, 2).alias("commits"), F.lit("9").alias("remaining"))
    targets = x.select("history_id", F.get("hs", F.lit(1)).alias("target")).where("target is not null")
    return listings.windows(pages, targets, ["history_id"], 3).select("history_id", "source", F.col("step").cast("bigint").alias("step"), "hash")


def refetch_targets(spark, d):
    """Rated commits whose message has to be read again: missing in the histories, or with three or more question marks."""
    m = commit_units(histories(spark, d, commit=("hash", "commit_message"))).where("trim(c.hash) <> ''").groupBy(F.col("c.hash").alias("hash")).agg(F.max("c.commit_message").alias("m"))
    r = _ratings(spark, d).where("trim(commit_hash) <> ''").select(F.col("commit_hash").alias("hash")).distinct()
    marks = F.length("m") - F.length(F.replace("m", F.lit("?"), F.lit("")))
    return r.join(m, "hash", "left").where(F.col("m").isNull() | (marks >= 3)).select("hash")


_RATED = "from recovered_20260714_204326 where diff_id is not null"
_CATS = "['System Overview', 'AI Integration', 'Documentation', 'Architecture', 'Impl. Details', 'Build and Run', 'Testing', 'Conf.&Env.', 'DevOps', 'Development Process', 'Project Management', 'Maintenance', 'Debugging', 'Performance', 'Security', 'UI/UX']"
_OUT = f"""with o as (select diff_id, primary_result.model model, status, category_scores s, coalesce(chunk_plan.original_chars, 0) changed, coalesce(len(primary_result.validation_errors), 0) wrong, primary_result.validation_errors errs, coalesce(primary_result.diff_retry_count, 0) tries, primary_result.error error {_RATED}),
u as (select *, coalesce(len([x for x in map_values(s) if x > 0]) = 0, true) none_, coalesce(len([x for x in map_values(s) if x >= 0.5]) > 0, false) usable from o) """
_RES = f"""with x as (select diff_id, primary_result.model model, case when category_scores is null then null else list_sort([{{'o': -e.value, 'c': e.key}} for e in map_entries(category_scores) if e.value > 0]) end r, flagged_categories f {_RATED}) """
_LA = ratings._L + "al0 as (select item, rater, m from la where rater is not null), "
# DuckDB's word boundaries know ASCII letters alone; these know all.
_bounds = lambda p: re.sub(r"\\b(?=[a-z])", r"(?:^|[^\\pL\\pN_])", p).replace("\\b", r"(?:$|[^\pL\pN_])")
_RESCUE = "case " + " ".join(f"when regexp_matches(t, '{_bounds(p)}') then '{c}'" for p, c in O.RESCUE) + f" else '{O.RESCUE_DEFAULT}' end"
_MV = "case when pe >= 1 - 1e-12 then case when po >= 1 - 1e-12 then 1.0 end else (po - pe) / (1 - pe) end"

QUERIES = {f.__name__: f for f in (rescue_categories, chunk_statuses, retry_candidates, missing_list_records, error_split, eval_records, result_lists, reference_records, filled_rows, rater_alignment, rater_id_sets, observed_keys, taxonomy_lookup, file_match, panel_vs_reference_category, panel_pooled_category, maintenance_by_type, maintenance_vs_reference, gold_coverage, lifecycle_sequence, ranked_categories, bias_ranks, newest_diffs, sample_reuse, prior_displays, message_cleaning, repo_slugs, single_label_scores, best_rationales, best_summaries, commit_windows, refetch_targets)}
SQL = {
    "rescue_categories": H._LN + f""", rs as (select history_id, commit_pos, file_pos, lower(array_to_string([x[2:] for x in ls if x[1] in ('+', '-') and x[1:3] not in ('+++', '---')], chr(10))) t, len([x for x in ch if x.s = '+' and x.t <> '']) a, len(ch) n from st)
select {H._K}, cast(file_pos as int) file_pos, {_RESCUE} category, case when a > 0 then '+' else '-' end direction from rs where n > 0""",
    "chunk_statuses": _OUT + "select case when none_ and changed > 0 then 'fallback' when wrong = 0 then 'ok' when usable then 'recovered' when tries > 0 then 'retried_failed' else 'fallback' end outcome, count(*) n from u group by 1",
    "retry_candidates": _OUT + ", b as (select *, (error is not null or wrong > 0 or (changed > 0 and none_)) and not usable and tries < 5 again from u) select model, count(*) filter (again) again, count(*) n, sum(case when again then least(30.0, pow(2.0, tries)) else 0.0 end) \"seconds\" from b group by 1",
    "missing_list_records": _OUT + f"select distinct diff_id from (select diff_id, unnest(errs) e from o) where e = '{O.MISSING_LIST}' or (e like 'chunk%' and e like '%{O.MISSING_LIST}')",
    "error_split": f"select case when primary_result.error is not null then 'error' else 'answer' end kind, count(*) n, coalesce(bool_or(coalesce(maintenance.primary_maintenance_type, '') <> '' or coalesce(cardinality(maintenance.type_scores), 0) > 0), false) has_maintenance {_RATED} group by 1",
    "eval_records": f"select diff_id, primary_result.model model, recorded_at, primary_result.primary_category primary_category, cast(coalesce(cardinality(category_scores), 0) as int) scores, cast(coalesce(len(flagged_categories), 0) as int) flagged, maintenance.primary_maintenance_type primary_maintenance_type, coalesce(maintenance.maintenance_class, '') maintenance_class, coalesce(maintenance.maintenance_base_type, '') maintenance_base_type, coalesce(chunk_plan.chunk_count, 0) chunk_count {_RATED}",
    "result_lists": _RES + f""", y as (select diff_id, len(r) results, array_to_string([e.c || ': ' || coalesce([g.rationale for g in f if g.category = e.c][1], '{O.NO_RATIONALE}') for e in r], chr(10)) shown from x where r is not null)
select diff_id, md5(coalesce(shown, '')) digest, cast(results as int) results, count(*) n from y group by all""",
    "reference_records": _RES + "select model, coalesce(r[1].c, '') primary_category, count(*) n from x group by 1, 2",
    "filled_rows": "select doc_id from documents where length(trim(text, chr(32) || chr(9) || chr(13) || chr(10))) > 0 and length(trim(file_path, chr(32) || chr(9) || chr(13) || chr(10))) > 0",
    "rater_alignment": ratings._L + "x as (select item, count(distinct rater) k from pp group by 1) select count(*) \"union\", count(*) filter (k = 3) aligned, count(*) filter (k < 3) dropped from x",
    "rater_id_sets": _LA + "n as (select rater, count(*) n from al0 group by 1), p as (select a.rater rater_a, b.rater rater_b, count(*) common from al0 a join al0 b on a.item = b.item and a.rater < b.rater group by 1, 2) select rater_a, rater_b, common, x.n + y.n - common either from p join n x on x.rater = rater_a join n y on y.rater = rater_b",
    "observed_keys": f"select name, count(*) n, list_contains({_CATS}, name) listed from (select unnest(map_keys(category_scores)) name {_RATED} and category_scores is not null) group by 1",
    "taxonomy_lookup": f"""with t(leaf, class, base) as (values ('corrective', 'Correction', 'corrective'), ('preventive', 'Correction', 'preventive'), ('adaptive (enhancement)', 'Enhancement', 'adaptive'), ('adaptive (correction)', 'Correction', 'adaptive'), ('additive', 'Enhancement', 'additive'), ('perfective', 'Enhancement', 'perfective')),
r as (select maintenance.primary_maintenance_type l, coalesce(maintenance.maintenance_class, '') c, coalesce(maintenance.maintenance_base_type, '') b {_RATED} and maintenance.primary_maintenance_type <> '')
select l leaf, coalesce(class, '') looked_class, coalesce(base, l) looked_base, count(*) n, count(*) filter (c = coalesce(class, '') and b = coalesce(base, l)) as_delivered from r left join t on l = leaf group by 1, 2, 3""",
    "file_match": H._F + """p as (select distinct commit_hash, filename from recovered_20260714_204326 where diff_id is not null and commit_hash is not null and filename is not null),
q as (select c.hash hash, arg_min(c, (history_id, commit_pos)) c from c where trim(c.hash) <> '' group by 1),
j as (select commit_hash, filename, [f for f in q.c.acf_files if f.filename = p.filename or f.previous_filename = p.filename][1] hit from p left join q on commit_hash = hash)
select commit_hash, filename, case when hit is null then 'not_found' else coalesce(hit.status, '') end status from j""",
    "panel_vs_reference_category": panel._P + f"""k as (select unnest(['A-F', 'A-O', 'N-F', 'N-O', 'R-F', 'R-O']) category), b as (select x.rater, category, cast(list_contains(x.labels, category) as int) a, cast(list_contains(y.labels, category) as int) r from st x join st4 y on x.item = y.item and y.rater = 'ref_net', k),
q as (select rater, category, avg(cast(a = r as int)) po, avg(a) * avg(r) + (1 - avg(a)) * (1 - avg(r)) pe from b group by 1, 2) select rater, category, round({_MV}, 9) kappa from q""",
    "panel_pooled_category": panel._P + f"""k as (select unnest(['A-F', 'A-O', 'N-F', 'N-O', 'R-F', 'R-O']) category), bi as (select category, item, sum(cast(list_contains(labels, category) as int)) y, count(*) m from st4, k group by 1, 2),
q as (select category, sum(y) / sum(m) p, avg((y * y + (m - y) * (m - y) - m) / (m * (m - 1.0))) po, sum(m) t, sum((m * m - y * y - (m - y) * (m - y)) / (m - 1.0)) / sum(m) dd from bi group by 1), q2 as (select *, p * p + (1 - p) * (1 - p) pe from q)
select category, round({_MV}, 9) fleiss_kappa, round(1 - dd / ((t * t - t * t * pe) / (t * (t - 1.0))), 9) krippendorff_alpha from q2""",
    "maintenance_by_type": _LA + f"""k as (select unnest(['corrective', 'preventive', 'adaptive', 'additive', 'perfective']) category), bi as (select category, item, sum(cast(coalesce(m.maintenance_base_type, '') = category as int)) y, count(*) m from al0, k group by 1, 2),
q as (select category, sum(y) / sum(m) prevalence, avg(cast(y > 0 and y < m as int)) nu, avg((y * y + (m - y) * (m - y) - m) / (m * (m - 1.0))) filter (m > 1) po, sum(y) filter (m > 1) / sum(m) filter (m > 1) p, sum(m) filter (m > 1) t, (sum((m * m - y * y - (m - y) * (m - y)) / (m - 1.0)) filter (m > 1)) / sum(m) filter (m > 1) dd from bi group by 1), q2 as (select *, p * p + (1 - p) * (1 - p) pe from q)
select category, round(prevalence, 9) prevalence, round(nu, 9) not_unanimous, round({_MV}, 9) fleiss_kappa, round(1 - dd / ((t * t - t * t * pe) / (t * (t - 1.0))), 9) krippendorff_alpha from q2""",
    "maintenance_vs_reference": _LA + f"""v as (select 'base' axis, item, rater, coalesce(m.maintenance_base_type, '') l from al0 union all select 'class', item, rater, coalesce(m.maintenance_class, '') from al0),
r as (select x.axis, x.rater, x.l a, y.l b from v x join v y on x.axis = y.axis and x.item = y.item and y.rater = '{ratings.MODELS[0]}' and x.rater <> y.rater), n as (select axis, rater, count(*) n, avg(cast(a = b as int)) po from r group by 1, 2),
e as (select axis, rater, sum(na * nb) pe from (select axis, rater, a l, cast(count(*) as double) na from r group by 1, 2, 3) join (select axis, rater, b l, cast(count(*) as double) nb from r group by 1, 2, 3) using (axis, rater, l) group by 1, 2), q as (select axis, rater, n, po, coalesce(e.pe, 0) / (n * n) pe from n left join e using (axis, rater))
select axis, rater, n, round(po, 9) agreement, round({_MV}, 9) kappa from q""",
    "gold_coverage": ratings._L + "n as (select unnest(gold) category, count(*) n from gs group by 1) select category, coalesce(n, 0) n from cats left join n using (category)",
    "lifecycle_sequence": basics.SQL["lifecycle_pick"].replace("select *, case when classes >= 2", ", p as (select *, case when classes >= 2").replace("limit 1", "limit 1)") + """
, t as (select diff_id item, min(commit_time) t from recovered_20260714_204326 where repo is not null and filename is not null group by 1), s as (select item, c, t, row_number() over (order by coalesce(t, ''), item) place from r join l using (item) join t using (item) join p on r.repo = p.repo and r.filename = p.filename)
select cast(place as int) place, case when coalesce(t, '') <> '' then t[1:10] else '#' || place end "day", case c when 'Enhancement' then 1e0 when 'Correction' then 0e0 else 5e-1 end "level" from s""",
    "ranked_categories": "with k as (" + panel.SQL["panel_category_agreement"] + ") select category, cast(row_number() over (order by fleiss_kappa asc nulls last, category) as int) from_lowest, cast(row_number() over (order by fleiss_kappa desc nulls last, category) as int) from_highest from k",
    "bias_ranks": "with k as (" + panel.SQL["label_bias"] + ") select category, " + ", ".join(f"cast(row_number() over (order by {c} desc, category) as int) by_{c}" for c in ("bias_delta", "primary_count", "general_count")) + " from k",
    "newest_diffs": f"select diff_id, commit_time[1:10] \"day\" from (select distinct diff_id, commit_time, try_strptime(replace(commit_time, 'Z', '')[1:19], '%Y-%m-%dT%H:%M:%S') parsed {_RATED} and commit_time is not null) where parsed is not null order by parsed desc, diff_id limit 50",
    "sample_reuse": f"select diff_id, coalesce(max(nullif(trim(labels_gold), '')), '') labels_gold, coalesce(max(nullif(trim(maintenance_gold), '')), '') maintenance_gold from gold_sheet where trim(diff_id) <> '' and diff_id in (select diff_id {_RATED}) group by 1",
    "prior_displays": H._F + f"""m as (select history_id, commit_pos, trim(coalesce(c.commit_date, ''))[1:10] dy, trim(regexp_replace(coalesce(c.commit_message, ''), '{H._SP}', ' ', 'g')) m, coalesce(c.commit_message, '') raw, coalesce(array_to_string(['^' || replace(f.filename, '.', '\\.') || '$' for f in c.acf_files if f.filename is not null], '|'), '') paths from c)
select {H._K}, trim(dy || ' — ' || case when length(m) > 80 then rtrim(m[1:79]) || '…' else m end, ' —') shown, md5(regexp_replace(regexp_replace(raw, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[^\\x00-\\x7F]', '?', 'g')) ascii, paths from m""",
    "message_cleaning": H._F + f"""m as (select history_id, commit_pos, c.commit_message m from c where c.commit_message is not null)
select {H._K}, md5(trim(regexp_replace(replace(m, chr(65533), ''), '{H._SP}', ' ', 'g'))) clean, md5(regexp_replace(m, '\\b(?:sk|key|token)[-_][A-Za-z0-9]{{6,}}\\b', '[REDACTED]', 'g')) redacted, try_cast(nullif(regexp_extract(lower(m), '(?:in\\s+)?(\\d+(?:\\.\\d+)?)\\s*s', 1), '') as double) wait from m""",
    "commit_windows": """with h as (select history_id, arg_min(acf_commits, delivered_at) cs from git_history_diffs where history_id is not null group by 1), x as (select history_id, [c.hash for c in cs if trim(c.hash) <> ''] hs from h), y as (select history_id, hs, case when len(hs) > 1 then list_position(hs, hs[2]) else 1 end p from x where len(hs) > 0),
z as (select history_id, hs, p, unnest(range(0, 3)) step from y) select history_id, case when len(hs) > 1 then 'window' else 'latest' end source, step, hs[p + step] hash from z where p + step <= len(hs)""",
    "refetch_targets": "with u as (select unnest(acf_commits) c from git_history_diffs), m as (select c.hash hash, max(c.commit_message) txt from u where trim(c.hash) <> '' group by 1) select distinct commit_hash hash from recovered_20260714_204326 left join m on commit_hash = m.hash where diff_id is not null and trim(commit_hash) <> '' and (txt is null or length(txt) - length(replace(txt, '?', '')) >= 3)",
    "repo_slugs": "select distinct repo, replace(regexp_extract('https://git.example/' || repo || '.git', '([^/]+/[^/]+?)(?:\\.git)?/?$', 1), '/', '_') slug, case when length(repo) % 4 = 0 then 'public_repo' when length(repo) % 4 = 1 then 'owner_not_found' when length(repo) % 4 = 2 then 'access_denied_or_private' else 'repo_missing_or_private' end access from git_history_diffs where repo is not null",
    "single_label_scores": f"""with r as (select primary_result.primary_category l, least(1e0, greatest(0e0, coalesce(category_scores[primary_result.primary_category], 0e0))) s, [v for v in map_values(category_scores) if v > 0] vs {_RATED} and primary_result.primary_category is not null)
select case when s >= 0.5 then l else 'Impl. Details' end category, count(*) n, round(sum(case when vs is null then null when len(vs) = 0 then 0e0 else 1e0 end), 6) scaled, round(sum(case when l = 'UI/UX' then s else (1 - s) / 15 end), 6) on_last from r group by 1""",
    "best_rationales": f"""with r as (select diff_id item, category_scores s, flagged_categories f, row_number() over (partition by diff_id order by recorded_at, primary_result.model nulls first, coalesce(primary_result.primary_category, ''), coalesce(primary_result.summary, ''), array_to_string(primary_result.validation_errors, ';')) i {_RATED}),
x as (select item, i, category, s[category] sc, case when len(list_distinct([g.category for g in f])) = len(list_distinct(f)) then coalesce(trim([g.rationale for g in f if g.category = category][1]), '') else '' end t from r, (select unnest({_CATS}) category) where s is not null and s[category] is not null),
y as (select *, max(sc) over (partition by item, category order by i rows between unbounded preceding and 1 preceding) pm from x)
select item, category, md5(arg_max(t, i)) digest from y where sc > coalesce(pm, -1) and t <> '' group by 1, 2""",
    "best_summaries": f"""with w as ({basics.SQL['chunk_aggregate_mean']}), p as (select item, arg_min(category, (-score, category)) category from w group by 1),
x as (select diff_id item, category_scores s, primary_result.primary_category pc, trim(primary_result.summary) summary, row_number() over (partition by diff_id order by recorded_at, primary_result.model nulls first, coalesce(primary_result.primary_category, ''), coalesce(primary_result.summary, ''), array_to_string(primary_result.validation_errors, ';')) i {_RATED}),
y as (select item, summary, case when pc = category then 0 else 1 end a, case when pc = category then 0.0 else -coalesce(list_max(map_values(s)), 0.0) end b, i from x join p using (item) where summary <> '')
select item, md5(arg_min(summary, (a, b, i))) digest from y group by 1""",
}
