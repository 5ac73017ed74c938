"""Session defaults shared by tests, bench and scripts; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. Never used on a cluster."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("votemill")
    b = b.config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests on one machine) is a temporary folder made and set.  A cluster without one is
    refused, as its nodes would each write to a disk of their own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        named = "file://" + tempfile.mkdtemp(prefix="votemill-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: nothing behind it is run twice, and it survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers.

    Where the workers' path already holds it (PYTHONPATH, or the folder the session was started
    in) nothing is done; else Spark's own file server hands out a zip of the package.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]}:
        return
    sc = spark.sparkContext
    if getattr(sc, "_votemill_shipped", False):
        return
    import zipfile

    path = os.path.join(tempfile.mkdtemp(prefix="votemill-zip-"), "votemill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "votemill")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._votemill_shipped = True
