"""Session set-up and the shared folder that cut points and written tables use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. Cluster settings stay with the cluster:
    only what the results depend on (UTC) is fixed here."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split hot keys even where an aggregate on the join key follows and needs a shuffle then
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master, where driver and executors are
    one process; on a cluster an unset folder is an error, since a machine-local path
    would lose data with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="quayside-")
    return _local_dirs[context.applicationId]


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table below the shared folder that its maker has replaced by a later one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block delete their shuffle files when they end, instead of when the driver
    collects garbage. For jobs that write a table and whose plans are not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`settle`, shuffle files removed, with the path, for a caller that will :func:`remove` the table."""
    path = new_shared_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, label: str, remove_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives executor loss, and fixes values such as
    partition ids that could differ if the plan ran twice. With ``remove_shuffles`` the
    shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    with shuffles_removed(spark) if remove_shuffles else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
