"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "utterlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` stays unset under spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Hash instead of sort where every measured partition of the build side is small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="utterlake-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


_SCOPE: ContextVar[str | None] = ContextVar("scratch folder of the running job", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_SCOPE.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A scratch folder of one job; whatever is written to scratch inside goes when the job ends.

    Results must be written elsewhere before the scope closes. Without a scope scratch tables stay.
    """
    path = scratch_path(spark, name)
    token = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once, read back: later branches scan a table and survive lost executors.

    ``path`` is a place outside the running scope for a table that is read after it.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that nothing holds any more; else they stay until the driver's memory is short."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores if it is estimated to be smaller than one file split for each core.

    A few small files would keep that many cores busy and no more. What moves is below cores times
    ``spark.sql.files.maxPartitionBytes``; any larger table, and any of unknown size, stays where it is read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * split else df


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """``df`` written once to scratch, dealt and sorted by ``key``: joins and groups on it do not move it again.

    A table that is ``dealt`` by this key as it is made is not dealt again, and its tasks write a file for each bucket.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df = df if dealt else df.repartition(parts, key)
    writer = df.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd")
    writer.bucketBy(parts, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
