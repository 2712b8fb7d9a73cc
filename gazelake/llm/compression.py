"""Compressors with raw-content dictionaries, and bounded labelled samples to fill them."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F


def compressor(content: bytes, level: int, min_match: int) -> zstandard.ZstdCompressor:
    """Compress small windows against ``content``: frames without magic, size or checksum."""
    parameters = zstandard.ZstdCompressionParameters.from_level(
        level, min_match=min_match, write_content_size=False, write_checksum=False, write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def labelled_rows(ids: DataFrame, docs: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` whole documents of each label, those of lowest hash: doc_id, the label, text.

    Ids are chosen without the texts. The rows of each label are counted first, and only ids with a hash so low
    that about twice ``per_label`` have it are ranked, however many rows a label has. Of rows with one id the text
    that sorts first counts; an id with two labels may be there with both; null ids, labels and texts never.
    """
    named = ids.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label)
    # one row a label; the model that is learned has far more bytes for each
    counts = F.broadcast(named.groupBy(label).agg(F.count("*").alias("_n")))
    order: Column = F.xxhash64("doc_id")
    share = order / F.lit(2.0 ** 64) + 0.5
    low = named.join(counts, label).filter(share * F.col("_n") <= 2 * per_label + 100).select("doc_id", label).distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order, "doc_id"))
    chosen = low.withColumn("_rank", rank).filter(F.col("_rank") <= per_label).drop("_rank")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    # the sample is small by its parameters
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))


def spread_out(n: int, most: int) -> list[int]:
    """At most ``most`` of ``n`` places, evenly over all of them; the first few lie far apart as well."""
    places = list(range(n)) if n <= most else [k * n // most for k in range(most)]
    # multiples of the golden ratio fill an interval evenly
    ranks = sorted(range(len(places)), key=lambda t: t * 0.6180339887498949 % 1)
    return [place for _, place in sorted(zip(ranks, places))]


def hash_order(doc_id: int) -> int:
    """A fixed scrambling of an id on the driver."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 20
