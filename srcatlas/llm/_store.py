"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from srcatlas import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        own = tempfile.mkdtemp(prefix="srcatlas-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


#: Arrow batches for Python, unless the session has been set otherwise: rows here are whole documents, or chunks of many.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def bound_batches(spark: SparkSession) -> None:
    """Before Python runs: workers get the package, and Arrow batches are smaller than Spark's own default."""
    ship.ensure(spark)
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def release() -> None:
    """Give memory that this process no longer uses back to the system: workers are kept for later stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: Spark's own setting: the shuffle files of a query go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, by: str | list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: this cuts lineage, survives lost executors, and frees the shuffle files behind it at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        written = df.write.option("compression", "zstd")
        (written.partitionBy(by) if by else written).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, name: str, key: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """As materialize, in buckets by key, so that grouping by it needs no shuffle of the table."""
    spark = df.sparkSession
    unique = name if path else f"{name}_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/{unique}"
    with freed(spark):
        written = df.write.option("compression", "zstd").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet")
        (written.partitionBy(by) if by else written).saveAsTable(unique)
    out = spark.table(unique)
    out._scratch, out._name = path, unique
    return out


def opened(spark: SparkSession, path: str, schema: str, by: str) -> DataFrame:
    """A bucketed table by its path: by its name if this session wrote it, else as plain files, which then have to be shuffled."""
    name = path.rsplit("/", 1)[-1]
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, and forget the table of its name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[-1]}`")


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def drop_part(df: DataFrame, *folders: str) -> None:
    """Delete parts of a table materialized by a column, which no plan reads any more."""
    for folder in folders:
        delete(df.sparkSession, f"{df._scratch}/{folder}")


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no plan reads any more."""
    for df in tables:
        delete(df.sparkSession, df._scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
