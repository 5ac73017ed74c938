"""From the pieces of a diff back to the diff: scores, status, flags, rationale and summary.

Rows are pieces: item, index, scores (map), status, errors, rationales (map), primary, summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how bad a status is.
SEVERITY = {"ok": 0, "recovered": 1, "retried_failed": 2, "fallback": 3}
ANY = 0.5


def aggregate(pieces: DataFrame, names: tuple[str, ...], how: str = "max") -> DataFrame:
    """item, category, score: the highest score of the pieces, the mean with missing ones as 0, or 1 if any reaches ``ANY``.

    Pieces without scores do not count; an item without any has 0 everywhere.
    """
    n = F.count("scores")
    per = {
        "max": lambda s: F.coalesce(F.max(s), F.lit(0.0)),
        "mean": lambda s: F.coalesce(F.try_divide(F.sum(s), n), F.lit(0.0)),
        "any": lambda s: F.coalesce(F.max((s >= ANY).cast("double")), F.lit(0.0)),
    }[how]
    cols = [per(F.when(F.col("scores").isNotNull(), F.coalesce(F.try_element_at("scores", F.lit(c)), F.lit(0.0)))).alias(f"c{i}") for i, c in enumerate(names)]
    wide = pieces.groupBy("item").agg(*cols)
    return wide.select("item", F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"c{i}").alias("score")) for i, c in enumerate(names)])))


def worst_status(status: Column) -> Column:
    """The most severe status of a group; unknown ones count as ok."""
    order = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.max(F.struct(F.coalesce(F.try_element_at(order, status), F.lit(0)).alias("k"), F.coalesce(status, F.lit("ok")).alias("s")))["s"]


def error_tags(index: Column, errors: Column) -> Column:
    """Distinct codes of a group, each with its piece, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(errors, lambda e: F.concat(F.lit("chunk"), index, F.lit(":"), e))))))


def best_rationale(pieces: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """item, category, rationale of the piece that scores it highest, the first of equals.

    A blank rationale of a higher piece does not take the place of an earlier text, but a
    later one has to score above it.
    """
    x = pieces.where("scores is not null").select("item", "index", "scores", "rationales", F.explode(F.array(*[F.lit(c) for c in names])).alias("category"))
    x = x.select("item", "category", "index", F.try_element_at("scores", F.col("category")).alias("s"), F.trim(F.coalesce(F.try_element_at("rationales", F.col("category")), F.lit(""))).alias("r")).where("s is not null")
    seq = x.groupBy("item", "category").agg(F.array_sort(F.collect_list(F.struct("index", "s", "r"))).alias("p"))
    first = F.struct(F.lit(-1.0).alias("best"), F.lit("").alias("r"))
    fold = F.aggregate("p", first, lambda a, e: F.when(e["s"] > a["best"], F.struct(e["s"].alias("best"), F.when(e["r"] != "", e["r"]).otherwise(a["r"]).alias("r"))).otherwise(a))
    return seq.select("item", "category", fold["r"].alias("rationale"))


def best_summary(pieces: DataFrame, primary: DataFrame) -> DataFrame:
    """item, summary of the first piece whose own category is the item's, else of the piece with the highest score."""
    p = pieces.where("trim(summary) <> ''").join(primary.select("item", F.col("category").alias("__c")), "item")
    top = F.coalesce(F.array_max(F.map_values("scores")), F.lit(0.0))
    rank = F.struct(F.when(F.col("primary") == F.col("__c"), 0).otherwise(1).alias("a"), F.when(F.col("primary") == F.col("__c"), F.lit(0.0)).otherwise(-top).alias("b"), F.col("index").alias("c"), F.trim("summary").alias("s"))
    return p.groupBy("item").agg(F.min(rank).alias("m")).select("item", F.col("m.s").alias("summary"))
