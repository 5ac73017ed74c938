"""Windows over change histories that stay even when one history holds much of the data.

A plain window puts a whole history into one task.  Here a history is cut into buckets of its
order (such as months); a window runs within a bucket, and what a bucket needs from earlier
ones (a count, the last few rows) is carried over in a table of one small row per bucket.

Edge cases: rows with equal order values follow the tie columns; null order values come first;
null keys are a history of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``position`` of each row in its history, from 1, and ``total``, the rows of the history."""
    b = df.withColumn("__b", F.coalesce(bucket.cast("string"), F.lit("")))
    counts = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy(*keys)).alias("total"))
    same = F.col("__b") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = b.withColumn("__p", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*[F.asc_nulls_first(o) for o in order])))
    return inside.join(carried, same).withColumn("position", F.col("__base") + F.col("__p")).drop("__b", "__c", "__n", "__base", "__p", *[f"__k_{k}" for k in keys])


def with_prior(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, n: int = 3) -> DataFrame:
    """``prior``: the values of up to ``n`` earlier rows of the same history, the oldest first."""
    b = df.withColumn("__b", F.coalesce(bucket.cast("string"), F.lit(""))).withColumn("__v", value)
    asc = [F.asc_nulls_first(o) for o in order]
    within = b.withColumn("__in", F.collect_list("__v").over(Window.partitionBy(*keys, "__b").orderBy(*asc).rowsBetween(-n, -1)))
    last = b.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*[F.desc_nulls_last(o) for o in order]))).where(F.col("__r") <= n)
    tails = last.groupBy(*keys, "__b").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col("__v").alias("v")))), lambda x: x["v"]).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(-n, -1)  # a bucket holds one row at least
    carry = tails.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__c"), F.flatten(F.collect_list("__t").over(before)).alias("__f"))
    same = F.col("__b") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    every = F.concat("__f", "__in")
    prior = F.when(F.size(every) > n, F.slice(every, -n, n)).otherwise(every)
    return within.join(carry, same).withColumn("prior", prior).drop("__b", "__c", "__v", "__in", "__f", *[f"__k_{k}" for k in keys])
