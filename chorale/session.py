"""Session helpers: where intermediate tables may be written and how lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "chorale", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it isn't installed."""
    env, root = spark.sparkContext.environment, str(Path(__file__).parent.parent)
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


_written: list[str] = []
_tables: list[str] = []
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop) is a temporary folder made,
    once a process, and removed when the process ends. On a cluster a missing name is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        named = jvm_dir.get() if jvm_dir.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "local" not in _made:
            _made["local"] = tempfile.mkdtemp(prefix="chorale-")
            atexit.register(shutil.rmtree, _made["local"], ignore_errors=True)
        named = _made["local"]
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that later stages read one fixed copy.

    The files are reliable (an executor may be lost) and every reader sees the same rows in the
    same partitions.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed Parquet table in the shared folder, and read from there.

    For tables that are read more than once and needn't keep their partitions: smaller than a
    checkpoint, and later readers take only the columns they need.
    """
    at = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def kept_in_buckets(df: DataFrame, buckets: int, by: str, order: tuple[str, ...]) -> DataFrame:
    """As ``kept``, in buckets by a column and sorted in each: what groups by that column needs no shuffle."""
    spark, at = df.sparkSession, folder(df.sparkSession)
    name = f"chorale_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(buckets, by).sortBy(*order).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def bucket_keys(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket in order a number that falls into it, so that every bucket can be given one partition."""
    tried = 32 * buckets
    while True:
        found = spark.range(tried).groupBy(F.expr(f"pmod(hash(id), {buckets})").alias("b")).agg(F.min("id").alias("k")).collect()
        if len(found) == buckets:
            return [r["k"] for r in sorted(found, key=lambda r: r["b"])]
        tried *= 4


def folder(spark: SparkSession, kind: str = "chorale") -> str:
    """A new folder name in the shared folder, which ``sweep`` removes."""
    at = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append(at)
    return at


def sweep(spark: SparkSession) -> int:
    """Removes the tables that this process wrote to the shared folder; to be called when no query needs them."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += at.getFileSystem(conf).delete(at, True)
    return n
