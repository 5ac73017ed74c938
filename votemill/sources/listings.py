"""Commit listings as they come from a paged service, already captured as a table; nothing here calls a service.

A listing is rows of key columns, page (from 0), status, commits (hashes, the newest first) and
remaining (requests left, as text).  It ends before the first page that failed or is empty, and
with the first page after which no request was left.

Edge cases: null and blank hashes are no commits; a listing whose first page failed gives its
status; a missing target gives the newest commits instead, marked so.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def commits(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place (from 0), hash: the commits of each listing, by running sums over its pages."""
    ended = (F.coalesce("status", F.lit(0)) != 200) | (F.coalesce(F.size("commits"), F.lit(0)) <= 0)
    last = pages.groupBy(*keys).agg(F.min(F.when(ended, F.col("page"))).alias("__end"), F.min(F.when(F.col("remaining") == "0", F.col("page"))).alias("__last"))
    kept = pages.join(last, keys).where("(__end is null or page < __end) and (__last is null or page <= __last)")
    real = F.filter("commits", lambda h: F.trim(h) != "")
    before = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sized = kept.select(*keys, "page", real.alias("__c")).withColumn("__before", F.coalesce(F.sum(F.size("__c")).over(before), F.lit(0)))
    return sized.select(*keys, "__before", F.posexplode("__c").alias("__i", "hash")).select(*keys, (F.col("__before") + F.col("__i")).alias("place"), "hash")


def windows(pages: DataFrame, targets: DataFrame, keys: list[str], needed: int) -> DataFrame:
    """keys, source, step (from 0), hash: ``needed`` commits from the target (keys, target) on, or the newest where it is not in the listing."""
    c = commits(pages, keys)
    at = c.join(targets, keys).where("hash = target").groupBy(*keys).agg(F.min("place").alias("__at"))
    x = c.join(at, keys, "left").withColumn("step", F.col("place") - F.coalesce("__at", F.lit(0)))
    return x.where((F.col("step") >= 0) & (F.col("step") < needed)).select(*keys, F.when(F.col("__at").isNull(), "latest").otherwise("window").alias("source"), "step", "hash")


def failures(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status of the listings whose first page failed."""
    return pages.where("page = 0 and coalesce(status, 0) <> 200").select(*keys, "status")


def settings(path: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a file of ``key=value`` lines; what the environment has already wins.  A missing file has none."""
    environ = os.environ if environ is None else environ
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, sign, value = line.strip().removeprefix("export ").partition("=")
                if sign and key.strip() and not key.startswith("#"):
                    found.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return found | {k: environ[k] for k in found if k in environ}
