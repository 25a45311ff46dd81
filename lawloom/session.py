"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "lawloom") -> SparkSession:
    """A local session with adaptive execution on; clusters pass their own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAWLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it in spark.checkpoint.dir; only where that is unset
    (local runs) is a temporary folder of this machine chosen and remembered in the session."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lawloom.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        known = tempfile.mkdtemp(prefix="lawloom-")
        spark.conf.set("lawloom.checkpoint.dir", known)
    return known


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lawloom-{label}-{uuid.uuid4().hex}"
    written(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Tables and folders of streams that nothing has released yet.
_WRITTEN: list[str] = []


def written(*paths: str) -> None:
    """Note paths for ``release``."""
    _WRITTEN.extend(paths)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Around a query whose result is stored inside the block: what it wrote on its way is deleted at the end."""
    try:
        yield spark
    finally:
        release(spark)


def release(spark: SparkSession) -> int:
    """Delete the tables and folders of streams written so far and return their number. Frames built on them cannot be read
    afterwards, so call it when their results are stored."""
    jvm = spark._jvm
    done = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done += 1
    return done


def spread(df: DataFrame) -> DataFrame:
    """Rows handed round to all cores where the input has fewer partitions than there are cores, as a single small file
    has; any larger input stays as it is read. For steps that cost far more than moving their rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
