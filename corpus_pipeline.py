"""From documents to token ids: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gazelake.llm import bpe, mixing, near_copies, repeats, toxicity
from gazelake.llm.common import stage, table
from gazelake.operators.prepare import row_numbers

#: Near copies: five words a shingle, a similarity of 0.8.
NEAR = near_copies.Settings(words=5, percent=80, coordinates=64, matches=34)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.below(docs, toxicity.train_tables(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, then hash of the row; one without an id only if none has one.

    Rows are told apart by their number in that order, so rows with one id and different texts all stay.
    """
    numbered = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    # a sample of what rows are ordered by goes to the driver: no texts
    numbered = numbered.withColumn("hash", F.xxhash64(*numbered.columns))
    numbered = stage(row_numbers(numbered, F.col(name["doc_id"]).asc_nulls_last(), "hash", name="no").drop("hash"))
    rows = numbered.select(F.col("no").alias("doc_id"), F.col(name["text"]).alias("text"))
    kept = near_copies.near_copies(rows, NEAR).filter("kept").select(F.col("doc_id").alias("no"))
    return numbered.join(kept, "no", "left_semi").drop("no").toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that are there elsewhere too are cut out of the texts; n_chars follows."""
    # numbered names: a document's own columns may be called anything
    carry = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("text", "n_chars")}
    source = docs.select(F.col("text"), F.col("text").isNull().alias("none"), *[F.col(c).alias(n) for c, n in carry.items()])
    out = repeats.remove_repeats(source, carry=("none", *carry.values()), form="kept_text")
    text = F.when(~F.col("none"), F.col("kept_text"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[(made[c] if c in made else F.col(carry[c])).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and decoded bytes."""
    return bpe.token_ids(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("mixing", mix_sources),
          ("bpe", encode)]
#: The stages hash, draw and tokenize beyond what SQL can say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
