"""Label spaces as data: categories and maintenance types from JSON files, and the project's own as default.

A categories file is a list, or an object with ``categories``, of names or of objects with name,
description and examples.  A maintenance file has ``maintenance_types`` (name, class, base_type,
description, examples) and may list leaf types under ``maintenance_classes`` (name, leaf_types).

Edge cases: entries without a name are left out, a repeated name keeps its first place, a type
without a base is its own, one without a class takes that of the class that lists it, else none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votemill.operators.gold import CATEGORIES, MAINTENANCE

CATEGORY_ROW = "place int, name string, description string, examples string"
TYPE_ROW = "place int, leaf string, class string, base string, description string, examples string"


def _read(spark: SparkSession, path: str) -> dict | list:
    """A settings file, read whole; it is as large as its label space."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0].lstrip("﻿"))


def examples(texts: list[str] | None) -> str:
    return " | ".join(f"Ex.{i}: {t}" for i, t in enumerate(texts or (), 1))


def _named(entries) -> list[dict]:
    found: dict[str, dict] = {}
    for e in entries or ():
        e = {"name": e} if isinstance(e, str) else e or {}
        name = str(e.get("name") or "").strip()
        if name:
            found.setdefault(name, e | {"name": name})
    return list(found.values())


def categories(spark: SparkSession, path: str | None = None) -> DataFrame:
    """place, name, description, examples of each category."""
    if path is None:
        return spark.createDataFrame([(i, c, "", "") for i, c in enumerate(CATEGORIES)], CATEGORY_ROW)
    data = _read(spark, path)
    rows = _named(data.get("categories") if isinstance(data, dict) else data)
    return spark.createDataFrame([(i, e["name"], e.get("description") or "", examples(e.get("examples"))) for i, e in enumerate(rows)], CATEGORY_ROW)


def maintenance(spark: SparkSession, path: str | None = None) -> DataFrame:
    """place, leaf, class, base, description, examples of each maintenance type."""
    if path is None:
        return spark.createDataFrame([(i, leaf, kind, base, "", "") for i, (leaf, kind, base) in enumerate(MAINTENANCE)], TYPE_ROW)
    data = _read(spark, path)
    listed = {leaf: c.get("name") for c in data.get("maintenance_classes") or () for leaf in c.get("leaf_types") or ()}
    rows = _named(data.get("maintenance_types"))
    return spark.createDataFrame([(i, e["name"], e.get("class") or listed.get(e["name"]) or "", e.get("base_type") or e["name"], e.get("description") or "", examples(e.get("examples"))) for i, e in enumerate(rows)], TYPE_ROW)


def looked_up(df: DataFrame, leaf: Column, types: DataFrame) -> DataFrame:
    """``df`` with looked_class and looked_base of a leaf: blank class and the leaf itself where it is unknown.

    The types are a label space, so their broadcast is bounded by it.
    """
    t = types.select(F.col("leaf").alias("__leaf"), F.col("class").alias("__class"), F.col("base").alias("__base"))
    j = df.withColumn("__l", leaf).join(F.broadcast(t), F.col("__l") == F.col("__leaf"), "left")
    return j.withColumn("looked_class", F.coalesce("__class", F.lit(""))).withColumn("looked_base", F.coalesce("__base", "__l", F.lit(""))).drop("__l", "__leaf", "__class", "__base")
