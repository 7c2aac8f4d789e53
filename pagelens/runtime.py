"""Session-level helpers shared by every operator: table access, durable cuts of lineage, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Largest size, in bytes of Catalyst's estimate, of a side that operators hand to ``broadcast()``.
BROADCAST_BYTES = 64 << 20

_local_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without the setting gets a folder of its own (removed at exit); a cluster
    without the setting is an error, since a machine-local folder would not survive a lost executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    global _local_dir
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="pagelens-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once as a compressed table in the shared folder and read back.

    The result has no lineage behind the files, so a lost executor costs no recomputation of
    earlier rounds; iterative operators call this once a round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files behind a table that :func:`durable` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/pagelens/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (an upper bound for scans, projections and filters)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def collect_small(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size is bounded by ``limit``; more rows are an error, never cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the limit or split the input")
    return rows
