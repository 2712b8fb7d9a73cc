"""Cluster and category sequence scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import comparisons as C
from ..functions import geometry as G

MAX_LENGTH = 20
# fixed values: the parts of a cluster key by dataset; a name loses the given number of characters at its end
KEY_PARTS = {
    "AiR-D": (("split", 0), ("question_id", 0), ("image_id", 4)),
    "OSIE": (("split", 0), ("name", 4)),
    "COCO-TP": (("split", 0), ("condition", 0), ("task", 0), ("name", 4)),
    "COCO-TA": (("split", 0), ("condition", 0), ("task", 0), ("name", 4)),
    "VISGUI": (("image_name", 0), ("target_id", 0)),
}


def dataset_key(dataset="dataset", columns=None, parts=KEY_PARTS) -> Column:
    """The cluster key of a row by the pattern of its dataset; one table may hold several.

    ``columns`` maps names of the patterns to other columns or expressions. A dataset without a pattern, or none,
    is an error when the row is read. A part that is null makes the key null.
    """
    columns = columns or {}

    def part(name, cut):
        value = G.col(columns.get(name, name)).cast("string")
        return F.substring(value, F.lit(1), F.greatest(F.length(value) - F.lit(cut), F.lit(0))) if cut else value

    dataset = G.col(dataset)
    key = F.raise_error(F.concat(F.lit("no key pattern for dataset "), F.coalesce(dataset.cast("string"), F.lit("null"))))
    for name, pieces in parts.items():
        spaced = [x for p in pieces for x in (F.lit("-"), part(*p))][1:]
        key = F.when(dataset == name, F.concat(*spaced)).otherwise(key)
    return key


def packed_centers(centers: DataFrame, groups) -> DataFrame:
    """One row per group with aligned arrays, ordered by cluster id.

    As long as the list of clusters of a key, which do not overlap on the canvas.
    """
    rows = F.array_sort(F.collect_list(F.struct("cluster_id", "cx", "cy")))
    return centers.groupBy(*groups).agg(rows.alias("_c")).select(
        *groups, F.col("_c.cluster_id").alias("_ids"), F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))


def symbolize(trials: DataFrame, centers: DataFrame, keys=("image", "target_id"), x="x", y="y",
              name="symbols") -> DataFrame:
    """Add the nearest cluster of every fixation, lowest id on ties.

    ``centers`` is ``keys + (cluster_id, cx, cy)``; trials are joined to the
    packed centres of their key. A trial whose key has no centres stays, with null.
    """
    joined = trials.join(packed_centers(centers, keys), list(keys), "left")
    return joined.withColumn(name, C.nearest_clusters(x, y, "_ids", "_cx", "_cy")).drop("_ids", "_cx", "_cy")


def subject_strings(symbolized: DataFrame, order, keys=("image", "target_id"), subject="username") -> DataFrame:
    """One symbol string per key and subject: the last trial wins."""
    return symbolized.groupBy(*keys, subject).agg(F.max_by("symbols", order).alias("symbols"))


def transition_rate(symbolized: DataFrame, centers: DataFrame, keys=("image", "target_id")) -> DataFrame:
    """(changes - repeats) / clusters over all paths of a key; null without clusters."""
    sums = symbolized.groupBy(*keys).agg(
        F.sum(G.symbol_changes("symbols") - G.symbol_repeats("symbols")).alias("_net"))
    sizes = centers.groupBy(*keys).agg(F.count("*").alias("clusters"))
    return sums.join(sizes, list(keys), "left").select(*keys, (F.col("_net") / F.col("clusters")).alias("rate"))


def _timed(symbols, durations, temp_bin, max_len):
    return G.repeat_by_duration(G.prefix(symbols, max_len), G.prefix(durations, max_len), temp_bin, "floor")


def sequence_score(df: DataFrame, centers: DataFrame, strings: DataFrame, keys=("image", "target_id"),
                   subject="username", max_len=MAX_LENGTH, temp_bin=50) -> DataFrame:
    """Cluster sequence scores ``ss`` and, with durations, ``ss_time``.

    The padded prediction ``px, py`` is symbolised with the key's centres and
    compared with the stored string of the subject. ``t`` are the durations of
    the trial itself, ``pt`` the predicted ones. An empty stored string scores 0.
    A trial without centres or without a stored string stays, with null scores.
    """
    symbolized = symbolize(df, centers, keys, "px", "py", "_pred")
    joined = symbolized.join(strings.withColumnRenamed("symbols", "_human"), [*keys, subject], "left")
    plain = C.match_ratio(G.prefix("_pred", max_len), G.prefix("_human", max_len))
    timed = C.match_ratio(_timed("_pred", "pt", temp_bin, max_len), _timed("_human", "t", temp_bin, max_len))
    empty = (F.size("_human") == 0) & F.col("_pred").isNotNull()
    scored = joined.withColumns({"ss": plain, "ss_time": timed})
    return scored.withColumns({c: F.when(empty, F.lit(0.0)).otherwise(F.col(c)) for c in ("ss", "ss_time")}
                              ).drop("_pred", "_human")


def categories(df: DataFrame, segmentation: DataFrame, id_cols, x="x", y="y", name="categories",
               width=G.CANVAS_WIDTH, height=G.CANVAS_HEIGHT, to_width=512, to_height=320) -> DataFrame:
    """Category of each fixation from raster lines ``(image, y, categories)``.

    Fixations are scaled to the raster, joined to their line and looked up; the
    result is one array per ``id_cols``, null when the image has no raster.
    """
    points = df.select("image", *id_cols, F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("pos", "p"))
    placed = points.select(
        "image", *id_cols, "pos",
        G.whole(F.col("p.x") / F.lit(float(width)) * F.lit(float(to_width))).alias("_x"),
        G.whole(F.col("p.y") / F.lit(float(height)) * F.lit(float(to_height))).alias("y"))
    # a negative index counts from the far edge; beyond the raster has no category
    placed = placed.withColumns({
        "_x": F.when(F.col("_x") < 0, F.col("_x") + to_width).otherwise(F.col("_x")),
        "y": F.when(F.col("y") < 0, F.col("y") + to_height).otherwise(F.col("y"))})
    # a raster grows with the images, and the size Spark takes its array lines for is far too small: it is never sent whole
    hit = placed.join(segmentation.hint("merge"), ["image", "y"], "left").select(
        *id_cols, "pos", F.get("categories", F.col("_x")).alias("category"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "category")))
    return hit.groupBy(*id_cols).agg(F.transform(rows, lambda s: s["category"]).alias(name))


def semantic_score(df: DataFrame, segmentation: DataFrame, id_cols, max_len=MAX_LENGTH, temp_bin=50) -> DataFrame:
    """Category sequence scores ``sss`` and ``sss_time``; NaN without a raster.

    Both paths are looked up in one join: their points are laid end to end and
    split again afterwards.
    """
    both = df.withColumns({"_ax": F.concat("x", "px"), "_ay": F.concat("y", "py")})
    found = categories(both, segmentation, list(id_cols), "_ax", "_ay", "_cats")
    scored = df.join(found, list(id_cols), "left")
    n = F.size("x")
    scored = scored.withColumns({
        "_human": F.slice("_cats", F.lit(1), n),
        "_pred": F.slice("_cats", n + 1, F.size("px"))})
    usable = (F.size("_cats") > 0) & ~F.exists("_cats", lambda c: c.isNull()) & (n > 0)
    nan = F.lit(float("nan"))
    empty = F.array().cast("array<int>")
    scored = scored.withColumns({c: F.when(usable, F.col(c)).otherwise(empty) for c in ("_human", "_pred")})
    out = scored.withColumns({
        "sss": C.match_ratio(G.prefix("_pred", max_len), G.prefix("_human", max_len)),
        "sss_time": C.match_ratio(_timed("_pred", "pt", temp_bin, max_len), _timed("_human", "t", temp_bin, max_len))})
    ok = F.coalesce(usable, F.lit(False))
    return out.withColumns({c: F.when(ok, F.col(c)).otherwise(nan) for c in ("sss", "sss_time")}
                           ).drop("_human", "_pred", "_cats")
