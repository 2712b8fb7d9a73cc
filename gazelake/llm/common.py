"""Helpers that the text operators share: stages, Arrow columns, whole texts in batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gazelake.session import checkpoint_dir

#: Words of every word-based contract.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_CLASS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def stage_path(spark: SparkSession) -> str:
    """A new folder for a written table, on the storage that all executors share.

    It is removed when the session ends, unless ``drop_stage`` does so before.
    """
    root = checkpoint_dir(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def write_stage(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage by a written table: lost executors lose nothing of it."""
    spark, path = df.sparkSession, stage_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame) -> DataFrame:
    return write_stage(df)[0]


def drop_stage(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bits of the bitmap of ``among``: 8 MB, whatever the corpus.
BITS = 1 << 26


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``keys`` (distinct, under that name), and few others.

    To be put in front of a join, so that it shuffles little else. The bitmap that is
    broadcast has a fixed size: with very many keys it lets all rows pass.
    """
    place = F.pmod(F.xxhash64(column), F.lit(BITS)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bitmaps = (keys.select(bucket.alias("_bucket"), bit.alias("_bit")).repartition("_bucket")
               .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    hit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    found = rows.withColumn("_bucket", bucket).join(F.broadcast(bitmaps), "_bucket").filter(hit)
    return found.select(rows.columns)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of ``column`` (one row at least)."""
    sizes = np.diff(offsets(batch.column(column)))
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column; a null has no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1, np.int32)
    return raw[column.offset:column.offset + len(column) + 1].astype(np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, end to end, and each row's first byte, ended by the total."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grown(self, have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            with np.errstate(over="ignore"):
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up, self.down = self._grown(self.up, self.base, n), self._grown(self.down, self.inverse, n)
        return self.up, self.down


def held(make: Callable, *key):
    """``make(*key)``, kept by the worker until another operator keeps something: workers are used for many stages."""
    if (make, key) not in _HELD:
        _HELD.clear()
        POWERS.__init__(POWERS.base)
        pa.default_memory_pool().release_unused()
        _HELD[make, key] = make(*key)
    return _HELD[make, key]


_HELD: dict = {}
#: An odd multiplier of 64 random bits, and the byte values' codes.
POWERS = Powers(0x9E3779B97F4A7C15 | 5)
CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``h`` with ``h[i]`` the polynomial hash of the first ``i`` bytes (modulo 2^64)."""
    up, _ = POWERS.upto(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(CODES[data] * up[:len(data)], out=h[1:])
    return h


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[start, end)``: equal spans have equal hashes."""
    _, down = POWERS.upto(len(h))
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * down[start])
