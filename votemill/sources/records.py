"""Readers of records in the forms they arrive in, and writers of reports.

No reader infers a schema from all data; JSON comes with a schema or as text.  Line numbers are
those of the file, whatever the partitioning: a block's first number is the sum of the blocks
before it, so no file is numbered in one task.
"""

from __future__ import annotations

import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The fields of a record and of a sheet, and the form of a log line.
RECORD = (
    "diff_id string, commit_hash string, commit_message string, timestamp string, filename string, status string, "
    "primary struct<model:string,primary_category:string,summary:string,validation_errors:array<string>>, category_scores map<string,double>"
)
SHEET = ("diff_id", "filename", "commit_url", "commit_date", "commit_message", "prev_change_1", "prev_change_2", "prev_change_3", "changed_lines", "labels_gold", "maintenance_gold")
LOG = r"^([0-9a-f]{40}) \| (.*?) \| (.*?) \| (.*) \| (\S+)$"


def read_csv(spark: SparkSession, path: str, sep: str = ",", limit: int = 0) -> DataFrame:
    """A table with a header and quoted line breaks, all columns text; ``limit`` 0 reads all."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).option("ignoreLeadingWhiteSpace", False).csv(path)
    return df.limit(limit) if limit else df


def read_sheet(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A label sheet; a byte order mark before the header is dropped, missing cells are blank."""
    df = read_csv(spark, path, sep)
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    return df.na.fill("")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (from 1) of text files."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = t.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.join(blocks.select("file", "block", (before - F.col("first") + 1).alias("shift")), ["file", "block"]).select("value", "file", (F.col("id") + F.col("shift")).alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str = RECORD, strict: bool = False) -> DataFrame:
    """One record a line with its file and line; blank lines and broken records are left out, or refused if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    parsed = text_lines(spark, path).where("trim(value) <> ''").select("file", "line", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), F.expr("try_parse_json(value) is not null").alias("ok"))
    return parsed.where("ok and r is not null").select("file", "line", "r.*")


def inputs(spark: SparkSession, folder: str, contains: str = "") -> list[str]:
    """The .json and .jsonl files of a folder by name, those with ``contains`` in it; no file is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = [str(f.getPath().toString()) for f in found]
    return sorted(n for n in names if n.endswith((".json", ".jsonl")) and contains in PurePosixPath(n).name)


def run_records(spark: SparkSession, folder: str, pinned: str | None = None) -> DataFrame:
    """The last record of each diff over the run files of a folder, or those of one pinned run."""
    paths = [n for n in inputs(spark, folder, "primary_") if pinned is None or PurePosixPath(n).name == f"primary_{pinned}.jsonl"]
    if not paths:
        raise FileNotFoundError(f"no run in {folder}")
    return latest_by_id(json_lines(spark, paths))


def diffs(spark: SparkSession, path: str, nested_schema: str) -> DataFrame:
    """diff_id, commit_hash, filename, patch of a file by its extension: lines of records, or nested histories.

    A nested file is one repository, a list of them (whose name goes with each diff), or a flat
    list of commits; files without a patch are left out.
    """
    if path.endswith(".jsonl"):
        r = json_lines(spark, path, "diff_id string, commit_hash string, filename string, patch string, diff_text string")
        r = r.withColumn("patch", F.coalesce(F.nullif("patch", F.lit("")), F.nullif("diff_text", F.lit("")))).where("patch is not null")
        return with_fallback_id(r).select(F.lit(None).cast("string").alias("repo"), "diff_id", "commit_hash", "filename", "patch")
    x = spark.read.schema(nested_schema).option("multiLine", True).json(path)
    commits = F.when(F.col("acf_commits").isNotNull(), F.col("acf_commits")).otherwise(F.array(F.struct(F.col("hash"), F.col("acf_files"))))
    c = x.select("repo", F.explode(commits).alias("c")).select("repo", F.col("c.hash").alias("commit_hash"), F.explode("c.acf_files").alias("f"))
    return c.where("f.patch <> ''").select("repo", F.concat_ws(":", "commit_hash", "f.filename").alias("diff_id"), "commit_hash", "f.filename", "f.patch")


def latest_by_id(records: DataFrame, key: str = "diff_id") -> DataFrame:
    """Of records with one id the last written: in the last file by name, on the last line; blank ids are left out."""
    w = Window.partitionBy(key).orderBy(F.desc("file"), F.desc("line"))
    return records.where(F.trim(key) != "").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def latest_file(names: list[str], prefix: str = "primary_", suffix: str = ".jsonl") -> str | None:
    """The name that sorts last among those that fit."""
    return max((n for n in names if PurePosixPath(n).name.startswith(prefix) and n.endswith(suffix)), default=None)


def with_fallback_id(df: DataFrame) -> DataFrame:
    """diff_id, else hash and filename, else hash, filename and place."""
    named = F.concat_ws(":", F.nullif("commit_hash", F.lit("")), F.nullif("filename", F.lit("")))
    return df.withColumn("diff_id", F.coalesce(F.nullif("diff_id", F.lit("")), F.when(named.contains(":"), named), F.concat_ws(":", named, F.col("line").cast("string"))))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """sha, date, author, message, url of log lines; other lines are left out."""
    return parse_log(spark.read.text(path), F.col("value"))


def parse_log(df: DataFrame, line: Column) -> DataFrame:
    names = ("sha", "date", "author", "message", "url")
    return df.where(line.rlike(LOG)).select(*[F.regexp_extract(line, LOG, i + 1).alias(n) for i, n in enumerate(names)])


def best_decoding(raw: Column) -> Column:
    """Bytes as text by the first charset that loses nothing: UTF-8 (with or without a byte order mark), Windows 1252 (which leaves five bytes undefined), Latin 1."""
    text = raw.cast("string")
    latin = F.decode(raw, "ISO-8859-1")
    undefined = latin.rlike("[\u0081\u008D\u008F\u0090\u009D]")
    signs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    windows = F.translate(latin, "".join(c for c, w in signs.items() if w), "".join(signs.values()))
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\uFEFF", "")).when(undefined, latin).otherwise(windows)


def first_filled(tables: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Several tables merged by key; each column from the first table where it is filled."""
    out = None
    for i, t in enumerate(tables):
        x = t.select(F.col(key), F.lit(i).alias("__i"), *[F.nullif(F.col(c), F.lit("")).alias(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in columns])
        out = x if out is None else out.unionByName(x)
    return out.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__i"))).alias(c) for c in columns])


def ids_in_order(df: DataFrame, key: str, place: str) -> DataFrame:
    """Distinct ids at their first place."""
    return df.where(F.trim(key) != "").groupBy(key).agg(F.min(place).alias(place))


def model_folder(model: str) -> str:
    """A model's name as a folder name; ``functions.text.safe_name`` is the same on columns."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", model).strip("._-")


def write_report(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A report as CSV with a header, NaN as empty, floats rounded if asked; reports are aggregates, so one file."""
    kinds = dict(df.dtypes)
    cols = [(F.bround(F.nanvl(c, F.lit(None).cast("double")), digits) if digits is not None else F.nanvl(c, F.lit(None).cast("double"))).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines, appended, in folders by model if there is one."""
    w = df.write.mode("append")
    (w.partitionBy("model") if "model" in df.columns else w).json(path)


def write_sheet(df: DataFrame, path: str, key_columns: tuple[str, ...], key_path: str) -> None:
    """A sheet for blind labelling, a CSV with a byte order mark and semicolons, without ``key_columns``; these go to a key file of JSON lines.

    A sheet is a sample that people read, so it is one file, in the order of its first column.
    """
    first = df.columns[0]
    shown = [F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes if c not in key_columns]
    sheet = df.select(*shown).orderBy(first).coalesce(1)
    sheet.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("sep", ";").option("escape", '"').csv(path)
    df.select(first, *key_columns).orderBy(first).coalesce(1).write.mode("overwrite").json(key_path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, as JSON knows neither."""
    kinds = dict(df.dtypes)
    fine = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c)
    return df.select(*[fine(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def write_summary(df: DataFrame, path: str) -> None:
    """A summary as JSON lines; aggregates, so one file."""
    finite(df).coalesce(1).write.mode("overwrite").json(path)


def write_nested(df: DataFrame, keys: list[str], path: str, name: str = "rows") -> None:
    """Rows as nested JSON: one object for each key with the list of its rows, which is as large as the largest key."""
    rest = [c for c in df.columns if c not in keys]
    df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name)).write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a finished table?"""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def publish(df: DataFrame, path: str) -> DataFrame:
    """A table written beside its place and then moved there, so that a reader sees the old one or the new one whole; it may be made from the old one."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    if not fs.rename(_fs(spark, staged)[1], p):
        raise OSError(f"{staged} could not be moved to {path}")
    return spark.read.schema(df.schema).parquet(path)


def snapshot(spark: SparkSession, path: str, to: str) -> None:
    """A copy of a folder, under a name of its own."""
    fs, p = _fs(spark, path)
    other, q = _fs(spark, to)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{path} could not be copied to {to}")


def cached(spark: SparkSession, name: str, folders: list[str], make) -> DataFrame:
    """The table of a name from the first folder that has it, else made and published in the first."""
    for f in folders:
        if exists(spark, f"{f}/{name}"):
            return spark.read.parquet(f"{f}/{name}")
    return publish(make(), f"{folders[0]}/{name}")
