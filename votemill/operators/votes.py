"""Long tables that every metric hangs on: scores, votes and label sets of raters.

``scores(item, rater, category, score)`` holds stored scores; an absent category means 0.
``votes(item, rater, label)`` holds one nominal label per rater.  Both stay partitioned by item
from the first shuffle on, so grouping by item or by item and rater needs no further one.

Edge cases: a rater without scores for an item casts no vote; a null label counts as the blank
label, which is a label like any other; the latest of a rater's records of an item counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATERS = ("by_count", "by_price", "by_qty")
REFERENCE = "ref_net"
PRESENT = 0.3
#: The panel's categories in canonical order.
PANEL = ("A-F", "A-O", "N-F", "N-O", "R-F", "R-O")


def line_panel(lineitem: DataFrame, raters: tuple[str, ...] = RATERS) -> DataFrame:
    """Scores of an order's lines: each rater scores the shares of (return flag, line status) by its own measure."""
    li = lineitem.select(F.col("l_orderkey").alias("item"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("category"), "l_quantity", "l_extendedprice", "l_discount").repartition("item")
    g = li.groupBy("item", "category").agg(
        F.sum("l_quantity").alias("by_qty"),
        F.sum("l_extendedprice").alias("by_price"),
        F.count(F.lit(1)).cast("double").alias("by_count"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ref_net"),
    )
    w = Window.partitionBy("item")
    shares = [F.struct(F.lit(r).alias("rater"), F.round(F.try_divide(F.col(r), F.sum(r).over(w)), 6).alias("score")) for r in raters]
    return g.select("item", "category", F.array(*shares).alias("s")).select("item", "category", F.inline("s")).select("item", "rater", "category", "score")


def primary_votes(scores: DataFrame) -> DataFrame:
    """The category with the highest score; ties go to the category that comes first."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "category"))
    return scores.groupBy("item", "rater").agg(best.alias("b")).select("item", "rater", F.col("b.category").alias("label"))


def label_sets(scores: DataFrame, threshold: float = PRESENT) -> DataFrame:
    """item, rater and the sorted set of categories at or above the threshold; empty sets are kept."""
    return scores.groupBy("item", "rater").agg(F.sort_array(F.collect_set(F.when(F.col("score") >= threshold, F.col("category")))).alias("labels"))


def ballots(scores: DataFrame, threshold: float = PRESENT) -> DataFrame:
    """item, rater, label and labels: primary vote and label set together, in one grouping."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "category"))
    present = F.collect_set(F.when(F.col("score") >= threshold, F.col("category")))
    return scores.groupBy("item", "rater").agg(best.alias("b"), present.alias("labels")).select("item", "rater", F.col("b.category").alias("label"), "labels")


def aligned(df: DataFrame, raters: int) -> DataFrame:
    """Rows of items that all raters know (an inner join over raters, by one count)."""
    n = F.size(F.collect_set("rater").over(Window.partitionBy("item")))
    return df.withColumn("__n", n).where(F.col("__n") == raters).drop("__n")


def items(votes: DataFrame) -> DataFrame:
    """item and its votes as an array ordered by rater; at most one entry per rater."""
    return votes.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rater", F.coalesce("label", F.lit("")).alias("label")))).alias("v"))


def rater_pairs(v: Column) -> Column:
    """Pairs of one item's raters, the first before the second; as many as raters allow, however many items there are."""
    return F.flatten(F.transform(v, lambda x: F.transform(F.filter(v, lambda y: y["rater"] > x["rater"]), lambda y: F.named_struct(F.lit("rater_a"), x["rater"], F.lit("rater_b"), y["rater"], F.lit("a"), x["label"], F.lit("b"), y["label"]))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common labels; two empty sets agree."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def kappa(po: Column, pe: Column) -> Column:
    """Chance-corrected agreement; where chance is certain, 1 for full agreement and undefined otherwise."""
    certain = pe >= 1 - 1e-12
    return F.when(certain, F.when(po >= 1 - 1e-12, F.lit(1.0))).otherwise(F.try_divide(po - pe, 1 - pe))
