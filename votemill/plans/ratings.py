"""Queries over the models' ratings and the human labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import agreement as A
from votemill.operators import gold as G
from votemill.operators import votes as V
from votemill.sources.tables import table

#: The models of the aligned evaluation; the queries whose names end in _all evaluate every model of the ratings.
MODELS = ("basalt:31b-cloud", "kestrel-ultra:cloud", "quillon:70b-cloud")
_R = lambda c: F.round(c, 9).alias(c)


def _ratings(spark, d):
    return table(spark, d, "recovered_20260714_204326")


def _latest(spark, d, models):
    """The last records of some models, or of every named one."""
    return G.latest(_ratings(spark, d), models).where("rater is not null")


def _joined(spark, d, models):
    """Gold items that all of ``models`` rated, or each model's own where that is None, with gold and predicted sets."""
    p = _latest(spark, d, models).select("item", "rater", G.present(F.coalesce("scores", F.array().cast("array<struct<key:string,value:double>>"))).alias("pred"), "leaf")
    if models:
        p = V.aligned(p, len(models))
    return p.join(G.gold_sets(table(spark, d, "gold_sheet")), "item")


def latest_records(spark, d, models=MODELS):
    """The last record of each diff and model of the aligned evaluation: its category and the number of its labels."""
    return _latest(spark, d, models).select("item", "rater", "label", F.coalesce(F.size(G.present(F.col("scores"))), F.lit(-1)).alias("labels"))


def gold_multilabel_overall(spark, d, models=MODELS):
    o = G.overall(_joined(spark, d, models))
    return o.select("rater", "items", *[_R(c) for c in o.columns[2:]])


def gold_multilabel_per_label(spark, d, models=MODELS):
    return G.per_label(_joined(spark, d, models)).select("rater", "category", "tp", "fp", "fn", "support", *map(_R, ("precision", "recall", "f1")))


def _single(spark, d, models, collapse):
    j = _joined(spark, d, models).where("maintenance <> ''").select("rater", F.col("maintenance").alias("gold"), G.maintenance(F.col("leaf")).alias("pred"))
    if not collapse:
        return j, G.LEAVES
    base = lambda c: F.when(F.col(c).startswith("adaptive"), "adaptive").otherwise(F.col(c)).alias(c)
    return j.select("rater", base("gold"), base("pred")), tuple(dict.fromkeys(m[2] for m in G.MAINTENANCE))


def gold_single_label(spark, d, models=MODELS):
    s = G.single(*_single(spark, d, models, False))
    return s.select("rater", "class", "tp", "fp", "fn", "support", *map(_R, ("precision", "recall", "f1", "accuracy")))


def gold_single_base(spark, d, models=MODELS):
    s = G.single(*_single(spark, d, models, True))
    return s.select("rater", "class", "tp", "fp", "fn", "support", *map(_R, ("precision", "recall", "f1", "accuracy")))


def gold_divergence_items(spark, d, models=MODELS):
    g = G.divergence(_joined(spark, d, models))
    return g.select("item", *map(_R, ("category_divergence", "maintenance_entropy", "maintenance_disagreement", "mean_error")), "unanimous_categories", "unanimous_maintenance")


def gold_divergence_summary(spark, d, models=MODELS):
    s = G.divergence_summary(G.divergence(_joined(spark, d, models)))
    return s.select("items", *[_R(c) for c in s.columns[1:]])


def rating_agreement(spark, d):
    """Fleiss and alpha of all models' categories on the diffs that several rated."""
    return A.fleiss(G.latest(_ratings(spark, d)).select("item", "rater", "label")).select("items", "raters", _R("observed"), _R("expected"), _R("fleiss_kappa"), _R("krippendorff_alpha"))


def maintenance_agreement(spark, d):
    """As rating_agreement, on base type and class."""
    l = G.latest(_ratings(spark, d))
    v = l.select("item", "rater", F.inline(F.array(F.struct(F.lit("base").alias("axis"), F.coalesce("base", F.lit("")).alias("label")), F.struct(F.lit("class").alias("axis"), F.coalesce("class", F.lit("")).alias("label")))))
    return A.fleiss(v, by=("axis",)).select("axis", "items", _R("observed"), _R("fleiss_kappa"), _R("krippendorff_alpha"))


def status_counts(spark, d):
    """Records by status; a missing one is "else"."""
    return _ratings(spark, d).groupBy(F.coalesce("status", F.lit("else")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def three_level_distribution(spark, d):
    """Maintenance labels counted as leaf, base type and class, by grouping sets in one pass."""
    r = _ratings(spark, d).where("maintenance.primary_maintenance_type <> ''").select("maintenance.*")
    q = """select case grouping_id(primary_maintenance_type, maintenance_base_type, maintenance_class) when 3 then 'leaf' when 5 then 'base' else 'class' end level,
      coalesce(primary_maintenance_type, maintenance_base_type, maintenance_class, '') label, count(*) n from {m}
      group by grouping sets ((primary_maintenance_type), (maintenance_base_type), (maintenance_class))"""
    return r.sparkSession.sql(q, m=r)


def flagged_records(spark, d):
    """Flags of each record: labels by falling score with their rationale, counted and joined."""
    f = F.transform(F.array_sort(F.transform("flagged_categories", lambda x: F.struct((-x["score"]).alias("s"), x["category"].alias("c")))), lambda x: x["c"])
    return _ratings(spark, d).where("diff_id is not null and flagged_categories is not null").select("diff_id", F.col("primary_result.model").alias("model"), F.array_join(f, "; ").alias("flagged")).groupBy("model", "flagged").agg(F.count(F.lit(1)).alias("n"))


def category_argmax(spark, d):
    """The category with the highest score in canonical order; all-zero and missing maps give the first one."""
    cats = F.array(*[F.lit(c) for c in G.CATEGORIES])
    pairs = F.transform(cats, lambda c, i: F.struct((-F.coalesce(F.try_element_at("category_scores", c), F.lit(0.0))).alias("s"), i.alias("i")))
    best = F.array_min(pairs)["i"]
    return _ratings(spark, d).select("diff_id", F.element_at(cats, best + 1).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("diff_id").alias("diffs"))


def repo_fallback(spark, d):
    """Ratings by repository: the rating's own, else that of the history that holds the commit."""
    h = table(spark, d, "git_history_diffs").select("repo", F.explode("acf_commits.hash").alias("hash")).where("trim(hash) <> ''").groupBy("hash").agg(F.min("repo").alias("found"))
    r = _ratings(spark, d).select(F.expr("nullif(trim(repo), '')").alias("own"), "commit_hash")
    return r.join(h, r.commit_hash == h.hash, "left").groupBy(F.coalesce("own", "found", F.lit("N/A")).alias("repo")).agg(F.count(F.lit(1)).alias("n"))


_L = """with rr as (select diff_id item, primary_result.model rater, coalesce(primary_result.primary_category, '') label, category_scores s, maintenance m, recorded_at from recovered_20260714_204326 where diff_id <> ''),
la as (select * from (select *, row_number() over (partition by item, rater order by recorded_at desc, label desc, map_entries(s)[1].value desc) k from rr) where k = 1),
cats as (select unnest(['System Overview', 'AI Integration', 'Documentation', 'Architecture', 'Impl. Details', 'Build and Run', 'Testing', 'Conf.&Env.', 'DevOps', 'Development Process', 'Project Management', 'Maintenance', 'Debugging', 'Performance', 'Security', 'UI/UX']) category, unnest(range(16)) i),
pp as (select item, rater, label, m, s, case when s is null then [] else list_sort(list_intersect([e.key for e in map_entries(s) if e.value >= 0.5], ['System Overview', 'AI Integration', 'Documentation', 'Architecture', 'Impl. Details', 'Build and Run', 'Testing', 'Conf.&Env.', 'DevOps', 'Development Process', 'Project Management', 'Maintenance', 'Debugging', 'Performance', 'Security', 'UI/UX'])) end pred from la where rater in ('basalt:31b-cloud', 'kestrel-ultra:cloud', 'quillon:70b-cloud')),
g0 as (select diff_id item, min({'a': labels_gold, 'b': maintenance_gold}) g from gold_sheet where trim(diff_id) <> '' group by 1),
g1 as (select item, trim(regexp_replace(lower(trim(coalesce(g.b, ''))), '\\?+$', '')) maintenance, unnest(string_split(coalesce(g.a, ''), ';')) x from g0),
gs as (select item, any_value(maintenance) maintenance, list_sort(coalesce(list(distinct category) filter (category is not null), [])) gold from g1 left join cats on regexp_replace(replace(lower(x), '&', 'and'), '[^a-z0-9]', '', 'g') = regexp_replace(replace(lower(category), '&', 'and'), '[^a-z0-9]', '', 'g') group by 1),
al as (select item from pp group by 1 having count(distinct rater) = 3),
j as (select pp.item, rater, pred, gold, maintenance, coalesce(m.primary_maintenance_type, '') leaf from pp join al using (item) join gs using (item)),
fl as (select item, rater, category, cast(list_contains(gold, category) as int) g, cast(list_contains(pred, category) as int) p from j, cats),
pl as (select rater, category, sum(g * p) tp, sum((1 - g) * p) fp, sum(g * (1 - p)) fn from fl group by 1, 2),
pm as (select *, tp + fn support, coalesce(tp / nullif(tp + fp, 0), 0) pr, coalesce(tp / nullif(tp + fn, 0), 0) re from pl),
pf as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) f1 from pm),
"""
_JA = "case when len(list_distinct(list_concat({a}, {b}))) = 0 then 1.0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"
_SINGLE = _L + """sp as (select rater, {g} gold, {p} pred from (select rater, maintenance g, trim(regexp_replace(lower(trim(leaf)), '\\?+$', '')) p from j where maintenance <> '')),
ac as (select rater, avg(cast(gold = pred as int)) accuracy from sp group by 1),
cl as (select unnest({c}) class),
sc as (select rater, class, sum(cast(gold = class and pred = class as int)) tp, sum(cast(gold <> class and pred = class as int)) fp, sum(cast(gold = class and pred <> class as int)) fn from sp, cl group by 1, 2),
sm as (select *, coalesce(tp / nullif(tp + fp, 0), 0) pr, coalesce(tp / nullif(tp + fn, 0), 0) re from sc)
select rater, class, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, cast(tp + fn as bigint) support, round(pr, 9) \"precision\", round(re, 9) recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) f1, round(accuracy, 9) accuracy from sm join ac using (rater)"""
_DV = _L + """dp as (select x.item, avg(1 - """ + _JA.format(a="x.pred", b="y.pred") + """) cd from j x join j y on x.item = y.item and x.rater < y.rater group by 1),
de as (select item, avg(1 - """ + _JA.format(a="pred", b="gold") + """) me, cast(count(distinct pred) = 1 as int) uc from j group by 1),
dm as (select item, abs(-sum(c / 3.0 * log2(c / 3.0))) h, 1 - max(c) / 3.0 dis, cast(count(*) = 1 as int) um from (select item, leaf, count(*) c from j group by 1, 2) group by 1),
dv as (select * from dp join de using (item) join dm using (item))
"""
_FLEISS = """ic as (select {k}item, label, count(*) c from vv group by all), io as (select {k}item, sum(c) m, sum(c * c) ss from ic group by all having sum(c) > 1),
mg as (select {k}sum(c) t, sum(c * c) s from (select {k}label, cast(sum(c) as double) c from ic join io using ({k}item) group by all) group by all), ob as (select {k}count(*) items, cast(max(m) as int) raters, avg((ss - m) / (m * (m - 1.0))) o, sum((m * m - ss) / (m - 1.0)) / sum(m) d from io group by all)
"""

_BY_MODEL = (latest_records, gold_multilabel_overall, gold_multilabel_per_label, gold_single_label, gold_single_base, gold_divergence_items, gold_divergence_summary)
QUERIES = {f.__name__: f for f in (latest_records, gold_multilabel_overall, gold_multilabel_per_label, gold_single_label, gold_single_base, gold_divergence_items, gold_divergence_summary, rating_agreement, maintenance_agreement, status_counts, three_level_distribution, flagged_records, category_argmax, repo_fallback)}
SQL = {
    "latest_records": _L + "x as (select 1) select item, rater, label, cast(case when s is null then -1 else len(pred) end as int) labels from pp",
    "gold_multilabel_per_label": _L + "x as (select 1) select rater, category, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, cast(support as bigint) support, round(pr, 9) \"precision\", round(re, 9) recall, round(f1, 9) f1 from pf",
    "gold_multilabel_overall": _L + """o as (select rater, sum(tp) tp, sum(fp) fp, sum(fn) fn, avg(pr) mp, avg(re) mr, avg(f1) mf, coalesce(sum(pr * support) / nullif(sum(support), 0), 0) wp, coalesce(sum(re * support) / nullif(sum(support), 0), 0) wr, coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) wf from pf group by 1),
e as (select rater, count(*) items, avg(cast(gold = pred as int)) em, avg(""" + _JA.format(a="gold", b="pred") + """) mj from j group by 1),
u as (select *, coalesce(tp / nullif(tp + fp, 0), 0) up, coalesce(tp / nullif(tp + fn, 0), 0) ur from o join e using (rater))
select rater, items, round(up, 9) micro_precision, round(ur, 9) micro_recall, round(coalesce(2 * up * ur / nullif(up + ur, 0), 0), 9) micro_f1, round(mp, 9) macro_precision, round(mr, 9) macro_recall, round(mf, 9) macro_f1, round(wp, 9) weighted_precision, round(wr, 9) weighted_recall, round(wf, 9) weighted_f1, round(em, 9) exact_match, round(mj, 9) mean_jaccard, round((fp + fn) / (items * 16.0), 9) hamming_loss from u""",
    "gold_single_label": _SINGLE.replace("{g}", "g").replace("{p}", "p").replace("{c}", "['corrective', 'preventive', 'adaptive (enhancement)', 'adaptive (correction)', 'additive', 'perfective']"),
    "gold_single_base": _SINGLE.replace("{g}", "case when g like 'adaptive%' then 'adaptive' else g end").replace("{p}", "case when p like 'adaptive%' then 'adaptive' else p end").replace("{c}", "['corrective', 'preventive', 'adaptive', 'additive', 'perfective']"),
    "gold_divergence_items": _DV + "select item, round(cd, 9) category_divergence, round(h, 9) maintenance_entropy, round(dis, 9) maintenance_disagreement, round(me, 9) mean_error, uc unanimous_categories, um unanimous_maintenance from dv",
    "gold_divergence_summary": _DV + """, rk as (select *, row_number() over (order by cd, item) - 1 k, count(*) over () n from dv)
select count(*) items, round(avg(cd), 9) mean_divergence, round(avg(me), 9) mean_error, round(corr(cd, me), 9) pearson, round(avg(me) filter (k < n // 3), 9) error_low, round(avg(me) filter (k >= n // 3 and k < 2 * n // 3), 9) error_mid, round(avg(me) filter (k >= 2 * n // 3), 9) error_high from rk""",
    "rating_agreement": _L + "vv as (select item, label from la where rater is not null), " + _FLEISS.replace("{k}", "").replace("using (item) group by all) group by all)", "using (item) group by all))") + "select items, raters, round(o, 9) observed, round(s / (t * t), 9) expected, round((o - s / (t * t)) / (1 - s / (t * t)), 9) fleiss_kappa, round(1 - d / ((t * t - s) / (t * (t - 1))), 9) krippendorff_alpha from ob, mg",
    "maintenance_agreement": _L + "vv as (select 'base' axis, item, coalesce(m.maintenance_base_type, '') label from la union all select 'class', item, coalesce(m.maintenance_class, '') from la), " + _FLEISS.replace("{k}", "axis, ") + "select axis, items, round(o, 9) observed, round((o - s / (t * t)) / (1 - s / (t * t)), 9) fleiss_kappa, round(1 - d / ((t * t - s) / (t * (t - 1))), 9) krippendorff_alpha from ob join mg using (axis)",
    "status_counts": "select coalesce(status, 'else') status, count(*) n from recovered_20260714_204326 group by 1",
    "three_level_distribution": """with m as (select maintenance.primary_maintenance_type a, maintenance.maintenance_base_type b, maintenance.maintenance_class c from recovered_20260714_204326 where maintenance.primary_maintenance_type <> '')
select 'leaf' "level", a label, count(*) n from m group by 2 union all select 'base', coalesce(b, ''), count(*) from m group by 2 union all select 'class', coalesce(c, ''), count(*) from m group by 2""",
    "flagged_records": """select model, flagged, count(*) n from (select primary_result.model model, coalesce(array_to_string([e.c for e in list_sort([{'s': -x.score, 'c': x.category} for x in flagged_categories])], '; '), '') flagged from recovered_20260714_204326 where diff_id is not null and flagged_categories is not null) group by 1, 2""",
    "category_argmax": _L + """sx as (select diff_id, row_number() over () r, category_scores s from recovered_20260714_204326), k as (select r, diff_id, category, row_number() over (partition by r order by coalesce(s[category], 0) desc, i) q from sx, cats)
select category, count(*) n, count(distinct diff_id) diffs from k where q = 1 group by 1""",
    "repo_fallback": """with h as (select c.hash, min(repo) found from (select repo, unnest(acf_commits) c from git_history_diffs) where trim(c.hash) <> '' group by 1)
select coalesce(nullif(trim(repo), ''), found, 'N/A') repo, count(*) n from recovered_20260714_204326 left join h on commit_hash = hash group by 1""",
}

#: Every model, each on the gold items it rated; an item of one model has no divergence.
QUERIES |= {f"{f.__name__}_all": lambda spark, d, f=f: f(spark, d, None) for f in _BY_MODEL}
_EVERY = {
    "rater in ('basalt:31b-cloud', 'kestrel-ultra:cloud', 'quillon:70b-cloud')": "rater is not null",
    " having count(distinct rater) = 3": "",
    "from j x join j y on x.item = y.item and x.rater < y.rater group by 1": "from j x left join j y on x.item = y.item and x.rater < y.rater group by 1",
    "avg(1 - case when len(list_distinct(list_concat(x.pred, y.pred))) = 0": "avg(1 - case when y.pred is null then null when len(list_distinct(list_concat(x.pred, y.pred))) = 0",
    "abs(-sum(c / 3.0 * log2(c / 3.0))) h, 1 - max(c) / 3.0 dis": "abs(-sum(c / n * log2(c / n))) h, 1 - max(c / n) dis",
    "(select item, leaf, count(*) c from j group by 1, 2)": "(select item, leaf, count(*) c, cast(sum(count(*)) over (partition by item) as double) n from j group by 1, 2)",
    "count(*) over () n from dv)": "count(*) over () n from dv where cd is not null)",
}


def _every(sql: str) -> str:
    for old, new in _EVERY.items():
        sql = sql.replace(old, new)
    return sql


SQL |= {f"{f.__name__}_all": _every(SQL[f.__name__]) for f in _BY_MODEL}
