"""Fixations to trials, lookups, splits and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..functions.geometry import col
from ..session import pinned

TRIAL_ATTRIBUTES = ("image", "width", "height", "username", "target_id",
                    "target_x", "target_y", "target_width", "target_height")


def position_in_group(df: DataFrame, group, order, bucket: Column | None = None, name="pos") -> DataFrame:
    """Zero-based position of each row in its group.

    With ``bucket`` (a coarse, order-preserving cut of the order column, such as
    the hour of a timestamp) a large group is numbered bucket by bucket and the
    counts of earlier buckets are added, so no task holds a whole group.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)
    if bucket is None:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w) - 1)
    cut = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
               .select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (cut.withColumn("_rank", F.row_number().over(within) - 1)
            .join(offsets, [*group, "_bucket"])
            .withColumn(name, F.col("_offset") + F.col("_rank"))
            .drop("_bucket", "_rank", "_offset"))


def build_trials(fixations: DataFrame, key="img_usr_tgt", order_col="pos", attributes=None,
                 values=("x", "y", "t")) -> DataFrame:
    """One row per trial: attributes of its first fixation and ordered arrays."""
    keys = [key] if isinstance(key, str) else list(key)
    if attributes is None:
        attributes = [c for c in (*TRIAL_ATTRIBUTES, "ui_type") if c in fixations.columns and c not in keys]
    rows = F.collect_list(F.struct(order_col, *values))
    first = [F.min_by(F.struct(*attributes), order_col).alias("_first")] if attributes else []
    grouped = fixations.groupBy(*keys).agg(*first, F.array_sort(rows).alias("_rows"))
    return grouped.select(
        *keys, *[F.col(f"_first.{a}").alias(a) for a in attributes],
        *[F.col(f"_rows.{v}").alias(v) for v in values])


def attach_targets(trials: DataFrame, target2text: DataFrame) -> DataFrame:
    """Add the target text; a target without text is an error.

    ``target2text`` is ``(target_key, target)``.
    """
    keyed = trials.withColumn("target_key", G.target_key("target_id"))
    joined = keyed.join(target2text.select("target_key", "target"), "target_key", "left").drop("target_key")
    missing = F.raise_error(F.concat(F.lit("no text for target "), "target_id")).cast("string")
    return joined.withColumn("target", F.when(F.col("target").isNull(), missing).otherwise(F.col("target")))


def attach_types(trials: DataFrame, image_types: DataFrame) -> DataFrame:
    """Add ``ui_type``; an image without type is an error. ``image_types`` is ``(image, ui_type)``."""
    joined = trials.join(image_types.select("image", "ui_type"), "image", "left")
    missing = F.raise_error(F.concat(F.lit("no type for image "), F.coalesce("image", F.lit("null")))).cast("string")
    return joined.withColumn("ui_type", F.when(F.col("ui_type").isNull(), missing).otherwise(F.col("ui_type")))


def unknown_images(trials: DataFrame, image_types: DataFrame) -> DataFrame:
    return trials.join(image_types, "image", "left_anti")


def keep_type(trials: DataFrame, image_types: DataFrame, ui_type: str) -> DataFrame:
    return attach_types(trials, image_types).filter(F.col("ui_type") == ui_type)


def uncovered_trials(trials: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Rows of ``trials`` in none of the parts; empty for a complete partition."""
    covered = parts[0]
    for part in parts[1:]:
        covered = covered.unionAll(part)
    return trials.exceptAll(covered.select(trials.columns))


def exclude_images(trials: DataFrame, images) -> DataFrame:
    """Leave out named images (a list, or a DataFrame with an ``image`` column)."""
    if isinstance(images, DataFrame):
        return trials.join(images.select("image"), "image", "left_anti")
    return trials.filter(~F.col("image").isin(list(images)))


def leaked_keys(train: DataFrame, test: DataFrame, keys=("image", "target_id")) -> DataFrame:
    """Keys that occur on both sides of a split; should be empty."""
    return train.select(*keys).intersect(test.select(*keys))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Concatenate annotation tables, each tagged with its ``data_path``."""
    out = None
    for data_path, df in sources.items():
        tagged = df.withColumn("data_path", F.lit(data_path))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def normalize(df: DataFrame, x="x", y="y", width="width", height="height", min_len=G.MIN_FIXATIONS,
              to_width=G.CANVAS_WIDTH, to_height=G.CANVAS_HEIGHT, t=None) -> DataFrame:
    """Scale a path to the canvas and pad it to ``min_len`` fixations."""
    out = (df.withColumn(x, G.padded(G.rescale(x, width, to_width), min_len))
           .withColumn(y, G.padded(G.rescale(y, height, to_height), min_len)))
    return out if t is None else out.withColumn(t, G.padded(t, min_len))


def trim_paths(df: DataFrame, x="x", y="y", t="t", sentinel=-1.0) -> DataFrame:
    """Cut the sentinel tail: the length is the count of real x values."""
    n = G.sentinel_length(x, sentinel)
    return df.select("*", n.alias("_n")).withColumns(
        {c: G.prefix(c, "_n") for c in (x, y, t)}).drop("_n")


def equal_lengths(df: DataFrame, x="x", y="y", t="t") -> DataFrame:
    """Cut y and t to the length of x."""
    return df.withColumns({c: G.prefix(c, F.size(x)) for c in (y, t)})


# --- order, sampling ---------------------------------------------------------

# number of hash ranges a sample is located in; 2**16 counts fit anywhere
HASH_RANGES = 65_536


def hash_order(*key, seed=0) -> Column:
    return F.xxhash64(*[col(k) for k in key], F.lit(seed))


def shuffled(df: DataFrame, *key, seed=0) -> DataFrame:
    """Repeatable random order: range-sorted by a hash of the key."""
    return df.orderBy(hash_order(*key, seed=seed), *key)


def exact_sample(df: DataFrame, *key, rate=None, size=None, seed=0) -> DataFrame:
    """Exactly ``int(rows * rate)`` (or ``size``) rows, those of lowest hash.

    Rows are counted per hash range first. Ranges below the cut are kept by a
    filter; only the range that holds the cut is ranked, so nothing is gathered.
    The key has to identify a row.
    """
    h = hash_order(*key, seed=seed)
    span = F.shiftright(h, 48) + F.lit(HASH_RANGES // 2)
    tagged = df.withColumns({"_hash": h, "_range": span})
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = tagged.groupBy("_range").agg(F.count("*").alias("_n"))
    wanted = F.lit(size) if size is not None else F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(rate))
    ranges = counts.select(
        "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), "_n", wanted.alias("_wanted"))
    placed = tagged.join(F.broadcast(ranges), "_range")  # at most HASH_RANGES rows
    whole = placed.filter(F.col("_before") + F.col("_n") <= F.col("_wanted"))
    cut = placed.filter((F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") > F.col("_wanted")))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", *key))
    taken = cut.withColumn("_rank", rank).filter(F.col("_before") + F.col("_rank") <= F.col("_wanted"))
    return whole.select(df.columns).unionByName(taken.select(df.columns))


def repeat_sample(df: DataFrame, *key, times, seed=0) -> DataFrame:
    """Every record ``times`` times, copies adjacent, records in random order."""
    copies = df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return copies.orderBy(hash_order(*key, seed=seed), *key, "copy_no")


def row_numbers(df: DataFrame, *order, name="row_no") -> DataFrame:
    """Dense global row number from 0 in the given order, without one big sort task.

    Rows are range-partitioned and sorted, written once so that they stay where
    they are, numbered inside their partition, and shifted by the row counts of
    the partitions before.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    placed = pinned(placed.select("*", F.shiftright(local, 33).alias("_part"),
                                  local.bitwiseAND(F.lit((1 << 33) - 1)).alias("_local")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per partition
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset"))


def in_batches(df: DataFrame, *order, size=256, name="batch") -> DataFrame:
    """Consecutive batches of ``size`` rows in the given order."""
    return (row_numbers(df, *order, name="_row")
            .withColumn(name, F.floor(F.col("_row") / F.lit(size))).drop("_row"))
