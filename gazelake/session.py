"""Session helpers shared by the multi-step operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The reliable checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master with
    nothing set gets a temporary one, because there the driver's disk is the
    only disk there is.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="gazelake-ckpt-")
    if folder is not None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new folder on the storage that all executors share; it goes when the session ends."""
    root = checkpoint_dir(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is run inside leaves no shuffle files behind when it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in a scratch folder, and the folder; no shuffle that led to it stays on disk."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders."""
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    Used where a later step reads the same rows several times, or where row
    placement has to stay as it is. A cluster has to name the folder: without one
    nothing is recomputed in silence.
    """
    if checkpoint_dir(df.sparkSession) is None:
        raise ValueError("set spark.checkpoint.dir: this operator needs a written copy of its input")
    return df.checkpoint(eager=True)


#: For callers whose result is wrong when rows move.
pinned = cut_lineage


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions.

    Giving the number keeps adaptive execution from packing rows that are small
    but costly to work on into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
