"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a session on this machine alone gets a temporary folder; a cluster must name one, because executors do not see the driver's disk."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    path = f"{shared_dir(spark)}/tributary-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Spark's own switch: the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query that writes a table leaves no shuffle files behind. What it wrote is reread, so nothing needs them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str = "table", folder: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it. This cuts the lineage: a lost executor loses nothing of it."""
    path = f"{folder or work_dir(df.sparkSession)}/{name}"
    with dropping_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession) -> int:
    """Deletes all work folders of this application; to be called when the results that read them are no longer needed. Returns how many there were."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)
