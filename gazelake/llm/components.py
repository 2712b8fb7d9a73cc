"""Connected components of links, by distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_stage, write_stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): for each end of a link the smallest id it reaches.

    Each round hangs all neighbours of a node on the smallest of them, first the
    larger ones, then the smaller ones; the number of rounds grows with the
    logarithm of the longest path. Minima are pre-aggregated before they are
    shuffled and joined back, so a node with very many links is no single task.
    Every round is written to the shared folder, and only a count returns. Links
    of a row with itself and repeated links do no harm; no links give no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, path = write_stage(edges)
    before = None
    while True:
        # all of u's larger neighbours hang on the smallest node of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = write_stage(large)
        # u and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small, small_path = write_stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stage(spark, path)
        drop_stage(spark, large_path)
        edges, path = small, small_path
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
