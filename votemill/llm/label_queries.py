"""Queries on the ratings of several models: consensus, agreement and reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votemill.llm import consensus
from votemill.session import checkpoint_dir
from votemill.sources.tables import table

_SCHEMA = "diff_id string, primary_result struct<model: string, primary_category: string, error: string>, category_scores map<string,double>, status string, recorded_at timestamp_ntz"


def _solved(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    checkpoint_dir(spark)
    v = consensus.votes(table(spark, sf_dir, "recovered_20260714_204326", _SCHEMA))
    v = v.checkpoint()
    names = [r.annotator for r in v.where("annotator is not null").select("annotator").distinct().orderBy("annotator").limit(consensus.MOST_ANNOTATORS + 1).collect()]
    return consensus.run(consensus.by_item(v, names), names)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus category of each rated diff."""
    return consensus.categories(_solved(spark, sf_dir)).select("diff_id", "category")


def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, confidence and agreement per diff, beside the divergence of the earlier evaluation.

    Of repeated earlier figures the mean counts; a diff without one has null.
    """
    earlier = table(spark, sf_dir, "model_divergence_per_item").groupBy("diff_id").agg(F.avg("category_divergence").alias("category_divergence"))
    found = consensus.categories(_solved(spark, sf_dir)).withColumn("disagreement", 1 - F.col("agreement"))
    rounded = [F.round(c, 6).alias(c) for c in ("confidence", "agreement", "disagreement", "entropy")]
    return found.join(earlier, "diff_id", "left").select("diff_id", "category", "votes", *rounded, F.round("category_divergence", 6).alias("category_divergence"))


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How reliable each model is, and whether the messages settled."""
    return consensus.reliability(spark, _solved(spark, sf_dir)).select("annotator", "rounds", "settled", *[F.round(c, 6).alias(c) for c in ("ratings", "reliability", "weight")])


QUERIES = {"p2_found": p2_found, "p2_items": p2_items, "p2_reliability": p2_reliability}
SQL: dict[str, str] = {}
