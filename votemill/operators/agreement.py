"""Agreement and ambiguity over votes and label sets.  Undefined values are null, never NaN.

All functions take long tables of ``votes.py`` and never loop over categories or raters: a
metric by category is the same plan with one more grouping column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votemill.operators.votes import items, jaccard, kappa, rater_pairs

_L = "transform(v, x -> x.label)"
_SQUARES = "aggregate(v, 0D, (s, x) -> s + size(filter(v, y -> y.label = x.label)))"


def full_agreement(votes: DataFrame) -> DataFrame:
    """items and the share of them on which all raters give one label."""
    one = items(votes).select((F.size(F.expr(f"array_distinct({_L})")) == 1).cast("double").alias("same"))
    return one.agg(F.count(F.lit(1)).alias("items"), F.avg("same").alias("full_agreement"))


def pair_counts(votes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, rater_a, rater_b, a, b, n: how often two raters give two labels to one item."""
    if by:
        grouped = votes.groupBy("item", *by).agg(F.sort_array(F.collect_list(F.struct("rater", F.coalesce("label", F.lit("")).alias("label")))).alias("v"))
    else:
        grouped = items(votes)
    return grouped.select(*by, F.inline(rater_pairs(F.col("v")))).groupBy(*by, "rater_a", "rater_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _kappa_of_cells(cells: str = "cells") -> tuple[Column, Column, Column]:
    """(n, agreement, kappa) of a table of two raters' labels, given as an array of a, b, n; as long as labels allow."""
    n = F.expr(f"aggregate({cells}, 0D, (s, x) -> s + x.n)")
    same = F.expr(f"aggregate({cells}, 0D, (s, x) -> s + if(x.a = x.b, x.n, 0))")
    both = F.expr(f"aggregate(array_distinct(transform({cells}, x -> x.a)), 0D, (s, l) -> s + aggregate({cells}, 0D, (t, x) -> t + if(x.a = l, x.n, 0)) * aggregate({cells}, 0D, (t, x) -> t + if(x.b = l, x.n, 0)))")
    po = F.try_divide(same, n)
    return n.cast("bigint"), po, kappa(po, F.try_divide(both, n * n))


def cohen(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, rater_a, rater_b, n, agreement, kappa; from pair_counts, whose rows are as few as labels allow."""
    key = [*by, "rater_a", "rater_b"]
    n, po, k = _kappa_of_cells()
    return counts.groupBy(*key).agg(F.collect_list(F.struct("a", "b", "n")).alias("cells")).select(*key, n.alias("n"), po.alias("agreement"), k.alias("kappa"))


def fleiss(votes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, items, raters, observed, expected, fleiss_kappa, krippendorff_alpha.

    Alpha comes from the coincidences: each item with m votes gives its ordered pairs of votes
    the weight 1/(m-1).  Items with one vote take part in neither.  One chain of aggregates:
    an item's own figures travel with the first of its votes.
    """
    v = votes.withColumn("label", F.coalesce("label", F.lit("")))
    per = v.groupBy("item", *by).agg(F.collect_list(F.struct("rater", "label")).alias("v")).withColumn("m", F.size("v")).where("m > 1")
    per = per.withColumn("ss", F.expr(_SQUARES))
    own = F.col("k") == 0
    m = F.col("m")
    labels = per.select(*by, "m", "ss", F.posexplode("v").alias("k", "x")).groupBy(*by, F.col("x.label").alias("label")).agg(
        F.count(F.lit(1)).alias("c"),
        F.count(F.when(own, 1)).alias("items"),
        F.max("m").alias("raters"),
        F.sum(F.when(own, (F.col("ss") - m) / (m * (m - 1))).otherwise(0.0)).alias("agree"),
        F.sum(F.when(own, (m * m - F.col("ss")) / (m - 1)).otherwise(0.0)).alias("apart"),
    )
    one = labels.groupBy(*by).agg(F.sum("items").alias("items"), F.max("raters").alias("raters"), F.try_divide(F.sum("agree"), F.sum("items")).alias("observed"), F.sum("apart").alias("apart"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    expected = F.try_divide(F.col("sq").cast("double"), F.col("total") * F.col("total"))
    do = F.try_divide(F.col("apart"), F.col("total"))
    de = F.try_divide((F.col("total") * F.col("total") - F.col("sq")).cast("double"), F.col("total") * (F.col("total") - 1))
    alpha = F.when(de <= 1e-15, F.when(do <= 1e-15, F.lit(1.0))).otherwise(1 - F.try_divide(do, de))
    return one.select(*by, F.coalesce("items", F.lit(0)).alias("items"), "raters", "observed", expected.alias("expected"), kappa(F.col("observed"), expected).alias("fleiss_kappa"), alpha.alias("krippendorff_alpha"))


def item_ambiguity(votes: DataFrame) -> DataFrame:
    """Per item: votes in rater order, plurality (ties by label), entropy in bits, entropy over log2 of the raters, share against the plurality."""
    counts = "transform(array_sort(array_distinct(ls)), l -> struct(-size(filter(ls, x -> x = l)) as n, l as label))"
    e = items(votes).withColumn("ls", F.expr(_L)).withColumn("c", F.expr(counts)).withColumn("n", F.size("ls"))
    top = F.array_min("c")
    bits = F.expr("aggregate(c, 0D, (s, x) -> s - (-x.n / n) * log2(-x.n / n))")
    entropy = F.when(F.size("c") == 1, F.lit(0.0)).otherwise(bits)
    return e.select(
        "item",
        F.array_join("ls", "|").alias("votes"),
        top["label"].alias("plurality"),
        entropy.alias("entropy"),
        F.when(F.col("n") > 1, entropy / F.log2("n")).alias("entropy_norm"),
        (1 + top["n"] / F.col("n")).alias("disagreement"),
    )


def item_jaccard(sets: DataFrame) -> DataFrame:
    """Per item the mean Jaccard index over pairs of raters; null for a single rater."""
    g = sets.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rater", F.col("labels").alias("label")))).alias("v"))
    pairs = F.transform(rater_pairs(F.col("v")), lambda p: jaccard(p["a"], p["b"]))
    mean = F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), F.size(pairs))
    return g.select("item", mean.alias("jaccard"))


def by_category(sets: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Per category: prevalence, share of items not unanimous, Fleiss, alpha, mean Cohen over pairs of raters.

    One scan and one chain: a rater's set is a number with a bit for each category, and items on
    which all sets are alike are counted before anything is made of them.  What is left gives, for
    each category, its count of votes and one entry per pair of raters; equal entries are counted
    again, and all metrics follow from the counts.
    """
    if len(categories) > 60:
        return by_category(sets, categories[:60]).unionByName(by_category(sets, categories[60:]))
    bits = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, 1 << i)]).cast("map<string,bigint>")
    mask = F.aggregate(F.array_distinct("labels"), F.lit(0).cast("bigint"), lambda a, l: a + F.coalesce(F.try_element_at(bits, l), F.lit(0).cast("bigint")))
    g = sets.select("item", F.struct("rater", mask.alias("label")).alias("r")).groupBy("item").agg(F.sort_array(F.collect_list("r")).alias("v"))
    alike = g.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    x = alike.select("v", "w", rater_pairs(F.col("v")).alias("pairs"), F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(1 << i).cast("bigint").alias("bit")) for i, c in enumerate(categories)])))
    has = lambda c: (c.bitwiseAND(F.col("bit")) != 0).cast("int")
    none = F.lit(None).cast("string")
    item = F.struct(none.alias("ra"), none.alias("rb"), F.size("v").alias("p"), F.size(F.filter("v", lambda r: r["label"].bitwiseAND(F.col("bit")) != 0)).alias("q"))
    pair = F.transform("pairs", lambda y: F.named_struct(F.lit("ra"), y["rater_a"], F.lit("rb"), y["rater_b"], F.lit("p"), has(y["a"]), F.lit("q"), has(y["b"])))
    n = x.select("category", "w", F.inline(F.concat(F.array(item), pair))).groupBy("category", "ra", "rb", "p", "q").agg(F.sum("w").alias("n"))

    m, y, w = F.col("p"), F.col("q"), F.col("n")
    whole = F.col("ra").isNull()
    ss = y * y + (m - y) * (m - y)
    only = lambda e: F.sum(F.when(whole, w * e))
    cells = F.collect_list(F.when(~whole, F.struct(m.alias("a"), y.alias("b"), "n")))
    t = n.groupBy("category", "ra", "rb").agg(
        only(F.lit(1)).alias("items"), only(m).alias("votes"), only(y).alias("yes"),
        only(((y > 0) & (y < m)).cast("int")).alias("split"),
        only(F.when(m > 1, 1).otherwise(0)).alias("rated"),
        only(F.when(m > 1, y).otherwise(0)).alias("yes2"), only(F.when(m > 1, m).otherwise(0)).alias("votes2"),
        only(F.when(m > 1, (ss - m) / (m * (m - 1))).otherwise(0.0)).alias("agree"),
        only(F.when(m > 1, (m * m - ss) / (m - 1)).otherwise(0.0)).alias("apart"),
        cells.alias("cells"),
    )
    _, _, k = _kappa_of_cells()
    c = t.withColumn("k", F.when(F.size("cells") > 0, k)).groupBy("category").agg(F.avg("k").alias("mean_cohen"), *[F.max(x).alias(x) for x in ("items", "votes", "yes", "split", "rated", "yes2", "votes2", "agree", "apart")])
    yes, total = F.col("yes2").cast("double"), F.col("votes2").cast("double")
    sq = yes * yes + (total - yes) * (total - yes)
    po, pe = F.try_divide("agree", "rated"), F.try_divide(sq, total * total)
    do, de = F.try_divide("apart", "votes2"), F.try_divide(total * total - sq, total * (total - 1))
    alpha = F.when(de <= 1e-15, F.when(do <= 1e-15, F.lit(1.0))).otherwise(1 - F.try_divide(do, de))
    return c.select("category", F.try_divide(F.col("yes").cast("double"), F.col("votes")).alias("prevalence"), F.try_divide(F.col("split").cast("double"), F.col("items")).alias("not_unanimous"), kappa(po, pe).alias("fleiss_kappa"), alpha.alias("krippendorff_alpha"), "mean_cohen")


def versus(ballots: DataFrame, reference: str) -> DataFrame:
    """Per rater against one reference: items in common, agreement, kappa, mean Jaccard; from item, rater, label, labels."""
    entry = F.struct("rater", F.coalesce("label", F.lit("")).alias("label"), "labels")
    g = ballots.groupBy("item").agg(F.collect_list(entry).alias("v"))
    others = g.withColumn("ref", F.try_element_at(F.filter("v", lambda x: x["rater"] == reference), F.lit(1))).where("ref is not null")
    rows = others.select("ref", F.explode(F.filter("v", lambda x: x["rater"] != reference)).alias("x")).select(F.col("x.rater").alias("rater"), F.col("x.label").alias("a"), F.col("ref.label").alias("b"), jaccard(F.col("x.labels"), F.col("ref.labels")).alias("j"))
    counts = rows.groupBy("rater", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("j").alias("j"))
    n, po, k = _kappa_of_cells()
    one = counts.groupBy("rater").agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"), F.try_divide(F.sum("j"), F.sum("n")).alias("mean_jaccard"))
    return one.select("rater", n.alias("n"), po.alias("agreement"), k.alias("kappa"), "mean_jaccard")
