"""Incremental ingestion: records once per id, sliding budgets, windows of event time.

Every stream runs on available data and stops; its state and its output lie under the shared
checkpoint folder.  Watermarks, session windows and late data are extensions beyond what the
batch pipeline needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votemill.session import checkpoint_dir


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema of the parquet files at ``path`` (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    glob = path[:-1] + "[" + path[-1] + "]"
    return spark.readStream.schema(schema).parquet(glob)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_append(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Run a stream over what is there, appending to parquet; what it wrote, as a table."""
    spark = stream.sparkSession
    base = _folder(spark)
    out = out or f"{base}/out"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_closed(rows: DataFrame, build: Callable[[DataFrame], DataFrame], time: str) -> DataFrame:
    """Run an aggregation with a watermark on ``time`` over what is there, in append mode; its finished groups, all of them, as a table.

    A first run takes in the rows; groups behind the watermark are written and their state is
    dropped.  A second run of the same query closes the others by one row at the end of time,
    which belongs to a group that stays open.  A stream that goes on needs the first alone.
    """
    spark = rows.sparkSession
    base = _folder(spark)
    spark.createDataFrame([], rows.schema).write.parquet(f"{base}/closing")
    out = build(rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{base}/closing")))
    for last in (False, True):
        if last:
            end = [F.lit("9000-01-01").cast("timestamp").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
            spark.range(1).select(*end).write.mode("append").parquet(f"{base}/closing")
        q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def run_replay(stream: DataFrame, key: str, store: str) -> DataFrame:
    """Events with what is known first: rows stored by earlier runs (``replayed``), then the new ones, which are stored; each id once.

    A batch is stored under its own number, so a batch that runs again replaces itself.
    """
    spark = stream.sparkSession

    def stored() -> DataFrame:
        return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{store}/rows")

    def keep(batch: DataFrame, n: int) -> None:
        fresh = batch.dropDuplicates([key]).where(F.col(key).isNotNull())
        known = stored().where(~F.col("_metadata.file_path").contains(f"/batch={n}/")).select(key)
        fresh.join(known, key, "left_anti").write.mode("overwrite").parquet(f"{store}/rows/batch={n}")

    checkpoint_dir(spark)
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{store}/rows/none")
    before = stored().select(key).distinct().withColumn("replayed", F.lit(True)).checkpoint()
    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stored().join(before, key, "left").na.fill(False, ["replayed"])


def once_per_id(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Records whose id was not seen before; an id is forgotten ``late`` after its time, so the state is bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, key: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows by window and key."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key: spells without a pause of ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def merged(streams: dict[str, DataFrame]) -> DataFrame:
    """Several producers as one stream, each row with its producer."""
    out = None
    for name, s in streams.items():
        s = s.withColumn("producer", F.lit(name))
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("no streams")
    return out


def sliding_budget(df: DataFrame, key: str, time: str, cost: str, seconds: int = 60) -> DataFrame:
    """Requests and costs of the same key within the last ``seconds`` (an event just that old is out), each row's own included.

    Rows also stand as context in the next stretch of ``seconds``, so a window runs within one
    stretch and its predecessor and a busy key is spread over as many tasks as stretches.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    step = seconds * 1_000_000
    x = df.withColumn("__t", us).withColumn("__b", F.explode(F.array(F.floor(us / step), F.floor(us / step) + 1)))
    w = Window.partitionBy(key, "__b").orderBy("__t").rangeBetween(-step + 1, 0)
    y = x.withColumn("requests", F.count(F.lit(1)).over(w)).withColumn("spent", F.sum(cost).over(w))
    return y.where(F.col("__b") == F.floor(F.col("__t") / step)).drop("__t", "__b")


def limiter_waits(df: DataFrame, key: str, time: str, cost: str, order: str, most_requests: int, most_cost: float, seconds: int = 60, pad: float = 0.05) -> DataFrame:
    """``wait``: the seconds a request of a key has to wait for its budget; 0 if it may go at once.  ``order`` tells requests of one time apart.

    With ``most_requests`` or more within the last ``seconds`` before it, a request waits until
    the oldest of them is ``seconds`` old.  Where their cost and its own are over ``most_cost``,
    it waits until so many of the oldest are that old that the rest fits; a request that is over
    it alone does not wait for that.  ``pad`` is added to a wait; the longer one counts.

    The release time is a look-up by prefix sums: sums and look-ups are rows of one window
    ordered by value.  Rows also stand in the next stretch of ``seconds``, as in
    ``sliding_budget``, so a busy key is spread over as many tasks as stretches.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    step = seconds * 1_000_000
    x = df.withColumn("__t", us).withColumn("__c", F.coalesce(F.col(cost).cast("double"), F.lit(0.0)))
    x = x.withColumn("__b", F.explode(F.array(F.floor(us / step), F.floor(us / step) + 1)))
    part = Window.partitionBy(key, "__b")
    rows, gone = part.orderBy("__t", order).rowsBetween(Window.unboundedPreceding, 0), part.orderBy("__t").rangeBetween(Window.unboundedPreceding, -step)
    y = x.withColumn("__k", F.count(F.lit(1)).over(rows)).withColumn("__s", F.sum("__c").over(rows))
    y = y.withColumn("__gone", F.coalesce(F.sum("__c").over(gone), F.lit(0.0))).withColumn("__before", F.col("__k") - 1 - F.count(F.lit(1)).over(gone)).withColumn("__oldest", F.min("__t").over(part.orderBy("__t").rangeBetween(-step + 1, 0)))
    asks = y.select(F.struct(*y.columns).alias("r"), key, "__b", (F.col("__s") - most_cost).alias("v"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("k"))
    sums = y.select(F.lit(None).cast(asks.schema["r"].dataType).alias("r"), key, "__b", F.col("__s").alias("v"), F.lit(1).alias("kind"), F.col("__t").alias("at"), F.col("__k").alias("k"))
    ahead = part.orderBy("v", "kind", "k").rowsBetween(0, Window.unboundedFollowing)
    found = asks.unionByName(sums).withColumn("freed", F.first(F.when(F.col("kind") == 1, F.struct("at", "k")), ignorenulls=True).over(ahead)).where("kind = 0").select("r.*", "freed")
    until = lambda t: (t + step - F.col("__t")) / 1e6 + pad
    crowded = F.when(F.col("__before") >= most_requests, until(F.col("__oldest"))).otherwise(0.0)
    dear = F.when((F.col("__s") - F.col("__gone") > most_cost) & (F.col("freed.k") < F.col("__k")) & (F.col("freed.at") > F.col("__t") - step), until(F.col("freed.at"))).otherwise(0.0)
    out = found.where(F.col("__b") == F.floor(F.col("__t") / step)).withColumn("wait", F.greatest(crowded, dear))
    return out.select(*df.columns, "wait")
