"""Queries of the line panel: three raters and a reference over the orders' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votemill.functions.scalars import with_totals
from votemill.operators import agreement as A
from votemill.operators import votes as V
from votemill.session import written
from votemill.sources.tables import table

_R9 = lambda c: F.round(c, 9).alias(c)


def _scores(spark: SparkSession, d: str, raters: tuple[str, ...] = V.RATERS) -> DataFrame:
    return V.line_panel(table(spark, d, "lineitem"), raters)


def _votes(spark: SparkSession, d: str, raters: tuple[str, ...] = V.RATERS) -> DataFrame:
    return V.primary_votes(_scores(spark, d, raters))


def _sets(spark: SparkSession, d: str, raters: tuple[str, ...] = V.RATERS) -> DataFrame:
    return V.label_sets(_scores(spark, d, raters))


_ALL = (*V.RATERS, V.REFERENCE)


def panel_full_agreement(spark, d):
    return A.full_agreement(_votes(spark, d)).select("items", _R9("full_agreement"))


def panel_pairwise_agreement(spark, d):
    return A.cohen(A.pair_counts(_votes(spark, d))).select("rater_a", "rater_b", "n", _R9("agreement"))


def panel_cohen_kappa(spark, d):
    return A.cohen(A.pair_counts(_votes(spark, d))).select("rater_a", "rater_b", _R9("kappa"))


def panel_fleiss_kappa(spark, d):
    return A.fleiss(_votes(spark, d)).select("items", _R9("observed"), _R9("expected"), _R9("fleiss_kappa"))


def panel_krippendorff_alpha(spark, d):
    return A.fleiss(_votes(spark, d)).select("items", _R9("krippendorff_alpha"))


def panel_item_jaccard(spark, d):
    return A.item_jaccard(_sets(spark, d)).select("item", _R9("jaccard"))


def panel_mean_jaccard(spark, d):
    return A.item_jaccard(_sets(spark, d)).agg(F.round(F.avg("jaccard"), 9).alias("mean_jaccard"), F.count(F.lit(1)).alias("items"))


def panel_category_agreement(spark, d):
    return A.by_category(_sets(spark, d), V.PANEL).select("category", *map(_R9, ("prevalence", "not_unanimous", "fleiss_kappa", "krippendorff_alpha", "mean_cohen")))


def panel_item_ambiguity(spark, d):
    return A.item_ambiguity(_votes(spark, d)).select("item", "votes", "plurality", *map(_R9, ("entropy", "entropy_norm", "disagreement")))


def panel_category_ambiguity(spark, d):
    """Mean normalised entropy of the items of each plurality; categories without items are kept with null."""
    g = A.item_ambiguity(_votes(spark, d)).groupBy(F.col("plurality").alias("category")).agg(F.avg("entropy_norm").alias("e"), F.count(F.lit(1)).alias("items"))
    all_ = spark.createDataFrame([(c,) for c in V.PANEL], "category string")
    return all_.join(g, "category", "left").select("category", F.round("e", 9).alias("mean_entropy_norm"), F.coalesce("items", F.lit(0)).alias("items"))


def panel_vs_reference(spark, d):
    return A.versus(V.ballots(_scores(spark, d, _ALL)), V.REFERENCE).select("rater", "n", *map(_R9, ("agreement", "kappa", "mean_jaccard")))


def panel_pooled(spark, d):
    """Jaccard per pair of raters, the reference among them."""
    g = _sets(spark, d, _ALL).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rater", F.col("labels").alias("label")))).alias("v"))
    p = g.select(F.inline(V.rater_pairs(F.col("v"))))
    ref = (F.col("rater_a") == V.REFERENCE) | (F.col("rater_b") == V.REFERENCE)
    return p.groupBy("rater_a", "rater_b").agg(F.round(F.avg(V.jaccard(F.col("a"), F.col("b"))), 9).alias("jaccard")).withColumn("ref_involved", ref)


def panel_class_agreement(spark, d):
    """Fleiss and full agreement on two coarser labels: the return flag and the line status."""
    v = _votes(spark, d).select("item", "rater", F.explode(F.array(F.struct(F.lit("flag").alias("axis"), F.split("label", "-")[0].alias("label")), F.struct(F.lit("status").alias("axis"), F.split("label", "-")[1].alias("label")))).alias("x"))
    return A.fleiss(v.select("item", "rater", "x.*"), by=("axis",)).select("axis", "items", *map(_R9, ("observed", "fleiss_kappa", "krippendorff_alpha")))


def label_bias(spark, d):
    """How often a category is the primary one, how often it is present at all, and the difference, in per cent of the items.

    One pass: an item's ballot gives its primary and its present categories, and itself once.
    """
    b = V.ballots(_scores(spark, d, ("by_qty",)))
    one = lambda c, p, g, n: F.struct(c.alias("category"), F.lit(p).alias("p"), F.lit(g).alias("g"), F.lit(n).alias("n"))
    rows = F.concat(F.array(one(F.lit(None).cast("string"), 0, 0, 1), one(F.col("label"), 1, 0, 0)), F.transform("labels", lambda c: one(c, 0, 1, 0)))
    t = b.select(F.inline(rows)).groupBy("category").agg(F.sum("p").alias("primary_count"), F.sum("g").alias("general_count"), F.sum("n").alias("n"))
    t = written(t)  # a row a category
    pct = lambda c: F.try_divide(F.col(c) * 100.0, F.col("items"))
    j = with_totals(t.where("category is not null").drop("n"), t.agg(F.sum("n").alias("items")))
    return j.select("category", "primary_count", "general_count", F.round(pct("general_count") - pct("primary_count"), 9).alias("bias_delta")).orderBy(F.desc("bias_delta"), "category")


def _cooc(spark, d):
    return V.label_sets(_scores(spark, d, ("by_qty",))).select(F.explode("labels").alias("a"), "labels").select("a", F.explode("labels").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def label_cooccurrence(spark, d):
    """Items that carry both labels; the diagonal counts the label itself."""
    return _cooc(spark, d)


def label_conditional(spark, d):
    """P(b | a)."""
    n = _cooc(spark, d)
    diag = n.where("a = b").select(F.col("a").alias("x"), F.col("n").alias("na"))
    return n.join(diag, n.a == diag.x).select("a", "b", F.round(F.try_divide(F.col("n").cast("double"), "na"), 9).alias("p"))


def label_activation(spark, d):
    """Items by the number of their labels, per rater."""
    return _sets(spark, d).groupBy("rater", F.size("labels").alias("labels")).agg(F.count(F.lit(1)).alias("items"))


def score_quartiles(spark, d):
    """Quartiles of the scores above zero, by category.

    Equal scores (of six digits) are counted before anything is gathered; the running sums are
    over the distinct scores of a category, of which there are a million at most.
    """
    n = _scores(spark, d, ("by_qty",)).where("score > 0").groupBy("category", "score").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category")
    x = n.withColumn("upto", F.sum("n").over(w.orderBy("score"))).withColumn("all", F.sum("n").over(w))

    def at(place):
        """The score at a place from 0."""
        return F.min(F.when(F.col("upto") > place, F.col("score")))

    def quartile(q):
        pos = (F.col("all") - 1) * q
        low = F.floor(pos)
        return [at(low).alias(f"low{q}"), at(F.ceil(pos)).alias(f"high{q}"), F.max(pos - low).alias(f"part{q}")]

    g = x.groupBy("category").agg(*[c for q in (0.25, 0.5, 0.75) for c in quartile(q)], F.min("score").alias("lo"), F.max("score").alias("hi"))
    value = lambda q: F.round(F.col(f"`low{q}`") + (F.col(f"`high{q}`") - F.col(f"`low{q}`")) * F.col(f"`part{q}`"), 6)
    return g.select("category", value(0.25).alias("q1"), value(0.5).alias("median"), value(0.75).alias("q3"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def flagged_labels(spark, d):
    """Labels at or above a half, best first; an item without one keeps its best label above zero."""
    s = _scores(spark, d, ("by_qty",)).groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "category"))).alias("x"))
    hit = F.filter("x", lambda e: e["s"] <= -0.5)
    kept = F.when(F.size(hit) > 0, hit).otherwise(F.slice(F.filter("x", lambda e: e["s"] < 0), 1, 1))
    return s.select("item", F.array_join(F.transform(kept, lambda e: e["category"]), "; ").alias("flagged"))


def sets_intersect_union(spark, d):
    """Of the label sets of two raters: intersection, difference, union."""
    s = _sets(spark, d, ("by_price", "by_qty"))
    g = s.groupBy("item").agg(F.max(F.when(F.col("rater") == "by_price", F.col("labels"))).alias("a"), F.max(F.when(F.col("rater") == "by_qty", F.col("labels"))).alias("b"))
    j = lambda c: F.array_join(F.array_sort(c), "|")
    return g.select("item", j(F.array_intersect("a", "b")).alias("common"), j(F.array_except("a", "b")).alias("only_a"), j(F.array_union("a", "b")).alias("either"))


_P = """with li as (select l_orderkey item, l_returnflag || '-' || l_linestatus category, sum(l_quantity) q, sum(l_extendedprice) p, cast(count(*) as double) n, sum(l_extendedprice * (1 - l_discount)) r from lineitem group by 1, 2),
sh as (select item, category, q / sum(q) over w q, p / sum(p) over w p, n / sum(n) over w n, r / sum(r) over w r from li window w as (partition by item)),
sc4 as (select item, 'by_qty' rater, category, round(q, 6) score from sh union all select item, 'by_price', category, round(p, 6) from sh union all select item, 'by_count', category, round(n, 6) from sh union all select item, 'ref_net', category, round(r, 6) from sh),
sc as (select * from sc4 where rater <> 'ref_net'),
v4 as (select item, rater, category label from (select *, row_number() over (partition by item, rater order by score desc, category) k from sc4) where k = 1),
v as (select * from v4 where rater <> 'ref_net'),
st4 as (select item, rater, list_sort(coalesce(list(category) filter (score >= 0.3), [])) labels from sc4 group by 1, 2),
st as (select * from st4 where rater <> 'ref_net'),
pr as (select x.item, x.rater rater_a, y.rater rater_b, x.label a, y.label b from v x join v y on x.item = y.item and x.rater < y.rater),
ck as (select rater_a, rater_b, count(*) n, avg(cast(a = b as int)) po from pr group by 1, 2),
pe as (select rater_a, rater_b, sum(na * nb) / (any_value(t) * any_value(t)) pe from (select rater_a, rater_b, a label, count(*) na from pr group by 1, 2, 3) join (select rater_a, rater_b, b label, count(*) nb from pr group by 1, 2, 3) using (rater_a, rater_b, label) join (select rater_a, rater_b, cast(count(*) as double) t from pr group by 1, 2) using (rater_a, rater_b) group by 1, 2),
ic as (select item, label, count(*) c from v group by 1, 2),
io as (select item, sum(c) m, sum(c * c) ss, max(c) top, -sum(c / 3.0 * log2(c / 3.0)) h from ic group by 1),
"""
_JAC = "case when len(list_distinct(list_concat(x.labels, y.labels))) = 0 then 1.0 else len(list_intersect(x.labels, y.labels)) / len(list_distinct(list_concat(x.labels, y.labels))) end"
_FL = "(o - e) / (1 - e)"

QUERIES = {f.__name__: f for f in (panel_full_agreement, panel_pairwise_agreement, panel_cohen_kappa, panel_fleiss_kappa, panel_krippendorff_alpha, panel_item_jaccard, panel_mean_jaccard, panel_category_agreement, panel_item_ambiguity, panel_category_ambiguity, panel_vs_reference, panel_pooled, panel_class_agreement, label_bias, label_cooccurrence, label_conditional, label_activation, score_quartiles, flagged_labels, sets_intersect_union)}
SQL = {
    "panel_full_agreement": _P + "x as (select 1) select count(*) items, round(avg(cast(top = m as int)), 9) full_agreement from io",
    "panel_pairwise_agreement": _P + "x as (select 1) select rater_a, rater_b, n, round(po, 9) agreement from ck",
    "panel_cohen_kappa": _P + "x as (select 1) select rater_a, rater_b, round((po - pe) / (1 - pe), 9) kappa from ck join pe using (rater_a, rater_b)",
    "panel_fleiss_kappa": _P + f"""m as (select sum(c * c) / (sum(c) * sum(c)) e from (select label, cast(count(*) as double) c from v group by 1)), o as (select count(*) items, avg((ss - m) / (m * (m - 1.0))) o from io)
select items, round(o, 9) observed, round(e, 9) expected, round({_FL}, 9) fleiss_kappa from o, m""",
    "panel_krippendorff_alpha": _P + """m as (select sum(c) t, sum(c * c) s from (select label, cast(count(*) as double) c from v group by 1)), o as (select count(*) items, sum((m * m - ss) / (m - 1.0)) / sum(m) d from io)
select items, round(1 - d / ((t * t - s) / (t * (t - 1))), 9) krippendorff_alpha from o, m""",
    "panel_item_jaccard": _P + f"j as (select x.item, avg({_JAC}) jaccard from st x join st y on x.item = y.item and x.rater < y.rater group by 1) select item, round(jaccard, 9) jaccard from j",
    "panel_mean_jaccard": _P + f"j as (select x.item, avg({_JAC}) jaccard from st x join st y on x.item = y.item and x.rater < y.rater group by 1) select round(avg(jaccard), 9) mean_jaccard, count(*) items from j",
    "panel_category_agreement": _P + """b as (select item, rater, category, cast(list_contains(labels, category) as int) y from st, (select unnest(['A-F', 'A-O', 'N-F', 'N-O', 'R-F', 'R-O']) category)),
bi as (select category, item, sum(y) y, count(*) m from b group by 1, 2),
bf as (select category, sum(y) / sum(m) p, avg(cast(y > 0 and y < m as int)) nu, avg((y * y + (m - y) * (m - y) - m) / (m * (m - 1.0))) o, sum(m) t, sum((m * m - y * y - (m - y) * (m - y)) / (m - 1.0)) / sum(m) dd from bi group by 1),
bp as (select x.category, x.rater ra, y.rater rb, avg(cast(x.y = y.y as int)) po, avg(x.y) pa, avg(y.y) pb from b x join b y on x.item = y.item and x.category = y.category and x.rater < y.rater group by 1, 2, 3),
bk as (select category, avg(case when pa * pb + (1 - pa) * (1 - pb) >= 1 - 1e-12 then case when po >= 1 - 1e-12 then 1.0 end else (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end) k from bp group by 1)
select category, round(p, 9) prevalence, round(nu, 9) not_unanimous, round((o - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 9) fleiss_kappa, round(1 - dd / ((t * t - t * t * (p * p + (1 - p) * (1 - p))) / (t * (t - 1.0))), 9) krippendorff_alpha, round(k, 9) mean_cohen from bf join bk using (category)""",
    "panel_item_ambiguity": _P + """a as (select item, string_agg(label, '|' order by rater) votes from v group by 1), p as (select item, label plurality from (select *, row_number() over (partition by item order by c desc, label) k from ic) where k = 1)
select item, votes, plurality, round(abs(h), 9) entropy, round(abs(h) / log2(3), 9) entropy_norm, round(1 - top / 3.0, 9) disagreement from io join a using (item) join p using (item)""",
    "panel_category_ambiguity": _P + """p as (select item, label plurality from (select *, row_number() over (partition by item order by c desc, label) k from ic) where k = 1)
select category, round(avg(abs(h) / log2(3)), 9) mean_entropy_norm, count(item) items from (select unnest(['A-F', 'A-O', 'N-F', 'N-O', 'R-F', 'R-O']) category) left join p on plurality = category left join io using (item) group by 1""",
    "panel_vs_reference": _P + f"""r as (select x.item, x.rater, x.label a, y.label b from v x join v4 y on x.item = y.item and y.rater = 'ref_net'),
rk as (select rater, count(*) n, avg(cast(a = b as int)) po from r group by 1),
re as (select rater, sum(na * nb) / (any_value(t) * any_value(t)) pe from (select rater, a label, count(*) na from r group by 1, 2) join (select rater, b label, count(*) nb from r group by 1, 2) using (rater, label) join (select rater, cast(count(*) as double) t from r group by 1) using (rater) group by 1),
rj as (select x.rater, avg({_JAC}) j from st x join st4 y on x.item = y.item and y.rater = 'ref_net' group by 1)
select rater, n, round(po, 9) agreement, round((po - pe) / (1 - pe), 9) kappa, round(j, 9) mean_jaccard from rk join re using (rater) join rj using (rater)""",
    "panel_pooled": _P + f"x as (select 1) select x.rater rater_a, y.rater rater_b, round(avg({_JAC}), 9) jaccard, x.rater = 'ref_net' or y.rater = 'ref_net' ref_involved from st4 x join st4 y on x.item = y.item and x.rater < y.rater group by 1, 2, 4",
    "panel_class_agreement": _P + """w as (select item, rater, 'flag' axis, split_part(label, '-', 1) label from v union all select item, rater, 'status', split_part(label, '-', 2) from v),
wi as (select axis, item, sum(c) m, sum(c * c) ss from (select axis, item, label, count(*) c from w group by 1, 2, 3) group by 1, 2),
wm as (select axis, sum(c) t, sum(c * c) s from (select axis, label, cast(count(*) as double) c from w group by 1, 2) group by 1),
wo as (select axis, count(*) items, avg((ss - m) / (m * (m - 1.0))) o, sum((m * m - ss) / (m - 1.0)) / sum(m) d from wi group by 1)
select axis, items, round(o, 9) observed, round((o - s / (t * t)) / (1 - s / (t * t)), 9) fleiss_kappa, round(1 - d / ((t * t - s) / (t * (t - 1))), 9) krippendorff_alpha from wo join wm using (axis)""",
    "label_bias": _P + """n as (select count(distinct item) n from sc), p as (select label category, count(*) primary_count from v where rater = 'by_qty' group by 1), g as (select category, count(*) general_count from sc where rater = 'by_qty' and score >= 0.3 group by 1)
select category, coalesce(primary_count, 0) primary_count, coalesce(general_count, 0) general_count, round(coalesce(general_count, 0) * 100.0 / n - coalesce(primary_count, 0) * 100.0 / n, 9) bias_delta from p full join g using (category), n""",
    "label_cooccurrence": _P + "s as (select item, unnest(labels) l from st where rater = 'by_qty') select x.l a, y.l b, count(*) n from s x join s y using (item) group by 1, 2",
    "label_conditional": _P + "s as (select item, unnest(labels) l from st where rater = 'by_qty'), n as (select x.l a, y.l b, count(*) n from s x join s y using (item) group by 1, 2) select n.a, n.b, round(n.n / m.n, 9) p from n join n m on n.a = m.a and m.a = m.b",
    "label_activation": _P + "x as (select 1) select rater, cast(len(labels) as int) labels, count(*) items from st group by 1, 2",
    "score_quartiles": _P + "x as (select 1) select category, round(quantile_cont(score, 0.25), 6) q1, round(quantile_cont(score, 0.5), 6) median, round(quantile_cont(score, 0.75), 6) q3, round(min(score), 6) lo, round(max(score), 6) hi from sc where rater = 'by_qty' and score > 0 group by 1",
    "flagged_labels": _P + """k as (select *, row_number() over (partition by item order by score desc, category) k from sc where rater = 'by_qty')
select item, coalesce(string_agg(category, '; ' order by k) filter (score >= 0.5), max(category) filter (k = 1 and score > 0), '') flagged from k group by 1""",
    "sets_intersect_union": _P + """s as (select x.item, x.labels a, y.labels b from st x join st y on x.item = y.item and x.rater = 'by_price' and y.rater = 'by_qty')
select item, array_to_string(list_sort(list_intersect(a, b)), '|') common, array_to_string(list_sort(list_filter(a, lambda e: not list_contains(b, e))), '|') only_a, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') either from s""",
}
