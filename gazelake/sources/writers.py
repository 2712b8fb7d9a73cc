"""Sinks for predictions, tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def write_records(df: DataFrame, path: str, mode="error") -> None:
    """Records as JSON lines or Parquet, by suffix; partitions write in parallel."""
    writer = df.write.mode(mode)
    if path.endswith(".parquet"):
        writer.parquet(path)
    elif path.endswith((".json", ".jsonl")):
        writer.json(path)
    else:
        raise ValueError(f"no writer for {path}")


def long_predictions(df: DataFrame) -> DataFrame:
    """One row per predicted fixation: image, width, height, username, x, y, timestamp."""
    points = F.posexplode(F.arrays_zip(F.col("px").alias("x"), F.col("py").alias("y"), F.col("pt").alias("timestamp")))
    long = df.select("image", "width", "height", "username", points.alias("pos", "p"))
    return long.select("image", "width", "height", "username", "p.x", "p.y", "p.timestamp")


def write_long_predictions(df: DataFrame, path: str, mode="error") -> None:
    long_predictions(df).write.mode(mode).csv(path, header=True)


def write_clusters(centers: DataFrame, strings: DataFrame, path: str, mode="error") -> None:
    centers.write.mode(mode).parquet(f"{path}/centers")
    strings.write.mode(mode).parquet(f"{path}/strings")


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/centers"), spark.read.parquet(f"{path}/strings")


def stored(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a table if it was written before, else build and write it first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.parquet(path)
    return spark.read.parquet(path)


def append_rewards(df: DataFrame, path: str) -> None:
    """Add rows to the reward log."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def report_rows(report: DataFrame, digits=4) -> DataFrame:
    """A metric row (or one per group) as rounded ``(metric, value)`` rows."""
    groups = [c for c, t in report.dtypes if t == "string"]
    values = [c for c in report.columns if c not in groups]
    doubles = report.select(*groups, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(groups, values, "metric", "value").withColumn("value", F.round("value", digits))


RECORD_SCHEMAS = {"predictions": schemas.PREDICTION, "samples": schemas.SAMPLE}
