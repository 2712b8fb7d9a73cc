"""Declared-schema readers; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import geometry as G
from ..operators import prepare
from . import json_records


def read_fixations(spark: SparkSession, path: str, order_col: str | None = None) -> DataFrame:
    """Fixation CSV with header, plus ``pos``, the fixation's place in its trial.

    Without an order column of the file, order is that of the lines: several files count as one,
    in the order of their names.
    """
    schema = schemas.FIXATION
    if order_col is not None and order_col not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(order_col, T.DoubleType())])
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    if order_col is None:
        # rows of one byte range lie in one partition, in their order
        line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("row"))
        rows, order_col = rows.withColumn("_line", line), "_line"
    rows = rows.withColumn("image", G.image_path("image"))
    return prepare.position_in_group(rows, "img_usr_tgt", order_col).drop("_line")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds a JSON array of records, or of arrays of records; read in byte ranges."""
    return json_records.read_json_records(spark, path, schema)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def uniform_samples(rows: DataFrame) -> DataFrame:
    """Rows of ``schemas.SAMPLE_FORMS`` in the one form of ``schemas.SAMPLE``.

    Media may be a string or the JSON text of a list; the plural name counts where
    the singular one is null. A turn is ``{role, content}`` if it has both, or only
    those names, else ``{from, value}``.
    """
    def media(one, many):
        text = F.coalesce(one, many)
        several = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))
        return F.when(text.isNotNull(), F.coalesce(several, F.array(text)))

    def turn(m):
        other = m["from"].isNotNull() | m["value"].isNotNull()
        named = m["role"].isNotNull() & (m["content"].isNotNull() | ~other)
        return F.struct(F.when(named, m["role"]).otherwise(m["from"]).alias("from"),
                        F.when(named, m["content"]).otherwise(m["value"]).alias("value"))

    made = {"image": media(F.col("image"), F.col("images")), "video": media(F.col("video"), F.col("videos")),
            "conversations": F.transform("conversations", turn)}
    return rows.withColumns(made).drop("images", "videos")


def read_annotations(spark: SparkSession, path: str, schema: T.StructType = schemas.SAMPLE) -> DataFrame:
    """Reader by file suffix: csv, jsonl, parquet, else a JSON array.

    JSON samples may have any form that ``uniform_samples`` takes.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    if schema == schemas.SAMPLE and suffix in ("json", "jsonl"):
        return uniform_samples(read_annotations(spark, path, schemas.SAMPLE_FORMS))
    if suffix == "csv":
        return read_fixations(spark, path)
    if suffix == "jsonl":
        return read_json_lines(spark, path, schema)
    if suffix == "parquet":
        return spark.read.schema(schema).parquet(path)
    if suffix == "json":
        return read_json_array(spark, path, schema)
    raise ValueError(f"no reader for {path}")


def read_lookup(spark: SparkSession, path: str, key="key", value="value") -> DataFrame:
    """A JSON object as a two-column table."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))))
    return pairs.select(F.col("key").alias(key), F.col("value").alias(value))


def read_split(spark: SparkSession, path: str, split: str, schema: T.StructType = schemas.RL_RECORD) -> DataFrame:
    """One split of a columnar dataset that is partitioned by ``split``."""
    full = T.StructType(schema.fields + [T.StructField("split", T.StringType())])
    return spark.read.schema(full).parquet(path).filter(F.col("split") == split).drop("split")


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all files below ``folder``, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    root = folder.rstrip("/") + "/"
    return files.select(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(root), F.lit(r"\E")), 2), -1).alias("path"))


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """Category rasters, one row per raster line."""
    return spark.read.schema(schemas.SEGMENTATION_ROW).parquet(path)


def raster_lines(pixels: DataFrame) -> DataFrame:
    """Raster lines from single pixels ``(image, y, x, category)``.

    A line is as long as the raster is wide.
    """
    rows = F.array_sort(F.collect_list(F.struct("x", "category")))
    return pixels.groupBy("image", "y").agg(F.transform(rows, lambda s: s["category"]).alias("categories"))
