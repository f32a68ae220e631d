"""Session defaults and the folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with this library's defaults; keyword arguments add settings (``a__b`` for ``a.b``)."""
    builder = SparkSession.builder.master(master).appName("vellumine")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer partitions than there are cores over all of them, ahead of work that is heavy for its size.

    A table that is large has more partitions than cores and is left as it is, so nothing of it is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A local session that names none gets a temporary one; on a cluster that raises RuntimeError, since
    executors would each write to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (context.master != "local" and not context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumine-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet into a folder of its own in the shared folder; returns its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a folder of its own in the shared folder, and read it again."""
    return df.sparkSession.read.parquet(written(df, name))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made and that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
