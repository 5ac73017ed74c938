"""Scalars of a table as columns of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``df`` with the columns of ``totals``, an aggregate without keys: a scalar subquery, so no join of any kind is planned."""
    one = totals.select(F.struct(*totals.columns)).scalar()
    return df.withColumn("__totals", one).select("*", "__totals.*").drop("__totals")
