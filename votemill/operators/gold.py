"""Evaluation of raters against human labels.

Labels are canonical category names.  Precision, recall and F1 are 0 where undefined; kappa and
Pearson are null.  All metrics of all raters and classes come from one pass over flags.

Edge cases: a repeated gold row counts once (the smallest by its fields); an item without gold
labels has the empty set; a predicted class outside the list only misses (fn); a gold class
outside the list counts towards accuracy alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the categories of the project, in their order.
CATEGORIES = (
    "System Overview", "AI Integration", "Documentation", "Architecture", "Impl. Details", "Build and Run", "Testing", "Conf.&Env.",
    "DevOps", "Development Process", "Project Management", "Maintenance", "Debugging", "Performance", "Security", "UI/UX",
)
# Fixed value: the maintenance types, their class and base type.
MAINTENANCE = (
    ("corrective", "Correction", "corrective"), ("preventive", "Correction", "preventive"), ("adaptive (enhancement)", "Enhancement", "adaptive"),
    ("adaptive (correction)", "Correction", "adaptive"), ("additive", "Enhancement", "additive"), ("perfective", "Enhancement", "perfective"),
)
LEAVES = tuple(m[0] for m in MAINTENANCE)


def name_key(c: Column) -> Column:
    """A category name without case, blanks and signs, so that spellings meet."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]", "")


def gold_sets(sheet: DataFrame, sep: str = ";") -> DataFrame:
    """item, gold (sorted canonical labels), maintenance; one row per item."""
    keys = F.create_map(*[F.lit(x) for c in CATEGORIES for x in ("".join(k for k in c.lower().replace("&", "and") if k.isalnum()), c)])
    one = sheet.where("trim(diff_id) <> ''").groupBy(F.col("diff_id").alias("item")).agg(F.min(F.struct("labels_gold", "maintenance_gold")).alias("g"))
    labels = F.transform(F.split(F.coalesce("g.labels_gold", F.lit("")), sep), lambda x: F.try_element_at(keys, name_key(x)))
    return one.select("item", F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("gold"), maintenance(F.col("g.maintenance_gold")).alias("maintenance"))


def maintenance(c: Column) -> Column:
    """A maintenance label in lower case without a question mark; blank for a missing one."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\?+$", ""))


def latest(ratings: DataFrame, raters: tuple[str, ...] | None = None) -> DataFrame:
    """One record per item and rater, the one recorded last; of equal times the one with the greatest category name."""
    r = ratings.where("diff_id <> ''").select(F.col("diff_id").alias("item"), F.col("primary_result.model").alias("rater"), F.coalesce("primary_result.primary_category", F.lit("")).alias("label"), "category_scores", F.col("maintenance").alias("m"), "recorded_at")
    if raters:
        r = r.where(F.col("rater").isin(*raters))
    entries = F.array_sort(F.map_entries("category_scores"))
    kept = r.withColumn("s", entries).groupBy("item", "rater").agg(F.max(F.struct("recorded_at", "label", "s", "m.primary_maintenance_type", "m.maintenance_base_type", "m.maintenance_class")).alias("k"))
    return kept.select("item", "rater", "k.label", F.col("k.s").alias("scores"), F.col("k.primary_maintenance_type").alias("leaf"), F.col("k.maintenance_base_type").alias("base"), F.col("k.maintenance_class").alias("class"))


def present(scores: Column, threshold: float = 0.5) -> Column:
    """The sorted canonical names whose score reaches the threshold."""
    names = F.transform(F.filter(scores, lambda e: e["value"] >= threshold), lambda e: e["key"])
    return F.array_sort(F.array_intersect(names, F.array(*[F.lit(c) for c in CATEGORIES])))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def per_label(joined: DataFrame) -> DataFrame:
    """rater, category, tp, fp, fn, support, precision, recall, f1; from rows of rater, gold and pred sets."""
    cats = joined.select("rater", "gold", "pred", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    g, p = F.array_contains("gold", F.col("category")).cast("int"), F.array_contains("pred", F.col("category")).cast("int")
    c = cats.groupBy("rater", "category").agg(F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"), F.sum(g * (1 - p)).alias("fn"))
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("rater", "category", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), prec.alias("precision"), rec.alias("recall"), f1(prec, rec).alias("f1"))


def overall(joined: DataFrame) -> DataFrame:
    """rater, items, micro, macro and weighted precision, recall and F1, exact match, mean Jaccard, Hamming loss."""
    c = per_label(joined)
    k = len(CATEGORIES)
    sums = c.groupBy("rater").agg(
        *[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "support")],
        *[F.avg(x).alias(f"macro_{x}") for x in ("precision", "recall", "f1")],
        *[F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{x}") for x in ("precision", "recall", "f1")],
    )
    union = F.size(F.array_union("gold", "pred"))
    jac = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("gold", "pred")) / union)
    row = joined.groupBy("rater").agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("exact_match"), F.avg(jac).alias("mean_jaccard"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    loss = ratio(F.col("fp") + F.col("fn"), F.col("items") * k)
    return row.join(sums, "rater").select("rater", "items", p.alias("micro_precision"), r.alias("micro_recall"), f1(p, r).alias("micro_f1"), *[f"{a}_{b}" for a in ("macro", "weighted") for b in ("precision", "recall", "f1")], "exact_match", "mean_jaccard", loss.alias("hamming_loss"))


def single(pairs: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """rater, class, tp, fp, fn, support, precision, recall, f1, accuracy (of the rater); rows of rater, gold and pred with gold given."""
    acc = pairs.groupBy("rater").agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))
    listed = F.array(*[F.lit(c) for c in classes])
    x = pairs.select("rater", "gold", "pred", F.explode(listed).alias("class"))
    g, p = (F.col("gold") == F.col("class")).cast("int"), (F.col("pred") == F.col("class")).cast("int")
    c = x.groupBy("rater", "class").agg(F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"), F.sum(g * (1 - p)).alias("fn"))
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("rater", "class", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), prec.alias("precision"), rec.alias("recall"), f1(prec, rec).alias("f1")).join(acc, "rater")


def divergence(joined: DataFrame) -> DataFrame:
    """Per item: mean Jaccard distance between raters, between raters and gold, entropy and disagreement of the maintenance votes."""
    g = joined.groupBy("item").agg(F.first("gold").alias("gold"), F.sort_array(F.collect_list(F.struct("rater", F.col("pred").alias("label")))).alias("v"), F.sort_array(F.collect_list(F.coalesce("leaf", F.lit("")))).alias("ls"))
    from votemill.operators.votes import jaccard, rater_pairs

    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    pairs = F.transform(rater_pairs(F.col("v")), lambda p: 1 - jaccard(p["a"], p["b"]))
    error = F.transform("v", lambda x: 1 - jaccard(x["label"], F.col("gold")))
    counts = F.transform(F.array_distinct("ls"), lambda l: F.size(F.filter("ls", lambda x: x == l)))
    n = F.size("ls")
    bits = F.aggregate(counts, F.lit(0.0), lambda s, x: s - (x / n) * F.log2(x / n))
    return g.select(
        "item",
        mean(pairs).alias("category_divergence"),
        F.when(F.size(F.array_distinct("ls")) == 1, 0.0).otherwise(bits).alias("maintenance_entropy"),
        (1 - F.array_max(counts) / n).alias("maintenance_disagreement"),
        mean(error).alias("mean_error"),
        (F.size(F.array_distinct(F.transform("v", lambda x: x["label"]))) == 1).cast("int").alias("unanimous_categories"),
        (F.size(F.array_distinct("ls")) == 1).cast("int").alias("unanimous_maintenance"),
    )


def divergence_summary(items: DataFrame) -> DataFrame:
    """Means, Pearson's r of divergence and error (null on a constant side), mean error by thirds of the divergence.

    Thirds are cut by position, [0, n/3), [n/3, 2n/3), rest, in order of divergence and item.
    Places are counted in buckets of the order (a divergence and the first two characters of the
    item); what comes before a bucket is a running sum, first over thousandths of the divergence.
    """
    x, y = F.col("category_divergence"), F.col("mean_error")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    order = [F.floor(x * 1000).alias("__a"), x.alias("__x"), F.substring("item", 1, 2).alias("__b")]
    rows = items.where("category_divergence is not null").select("item", "category_divergence", "mean_error", *order)
    key = ["__a", "__x", "__b"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    by_a = sizes.groupBy("__a").agg(F.sum("__n").alias("__m"))
    # A thousand and one rows at most.
    base = by_a.select("__a", (F.sum("__m").over(Window.orderBy("__a")) - F.col("__m")).alias("__base"), F.sum("__m").over(Window.partitionBy()).alias("__all"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("__a").orderBy("__x", "__b")) - F.col("__n")).join(base, "__a").select(*key, (F.col("__base") + F.col("__before")).alias("__base"), "__all")
    inside = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("item")) - 1)
    pos, n = F.col("__base") + F.col("__k"), F.col("__all")
    cut = inside.join(before, key).withColumn("third", F.when(pos < F.floor(n / 3), "low").when(pos < F.floor(2 * n / 3), "mid").otherwise("high"))
    t = lambda k: F.avg(F.when(F.col("third") == k, y))
    return cut.agg(F.count(F.lit(1)).alias("items"), F.avg(x).alias("mean_divergence"), F.avg(y).alias("mean_error"), r.alias("pearson"), t("low").alias("error_low"), t("mid").alias("error_mid"), t("high").alias("error_high"))
