"""Comparison of predicted and human scanpaths, one row per trial.

Input has the human arrays ``x, y, t`` and the predicted ``px, py, pt`` on the
scoring canvas, padded. Output is the input row plus score columns. All scores
are narrow: no operator here shuffles (a custom region mask is a join). The canvas
size is a number, or a column name when it differs by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import comparisons as C
from ..functions import geometry as G

HUMAN = ("x", "y", "t")
PREDICTED = ("px", "py", "pt")


def _symbols(path, width, height, xbin, ybin, offset, temp_bin):
    s = G.grid_symbols(path[0], path[1], width, height, xbin, ybin, offset)
    if temp_bin:
        return G.repeat_by_duration(s, path[2], temp_bin)
    return s


def scanmatch(df: DataFrame, xbin=16, ybin=12, threshold=3.5, gap=0.0, temp_bin=0, offset=(0, 0), eps=0.0,
              table=None, width=G.CANVAS_WIDTH, height=G.CANVAS_HEIGHT, name="scanmatch") -> DataFrame:
    """Grid sequence alignment; with ``temp_bin`` symbols repeat by duration."""
    human = _symbols(HUMAN, width, height, xbin, ybin, offset, temp_bin)
    pred = _symbols(PREDICTED, width, height, xbin, ybin, offset, temp_bin)
    return df.withColumn(name, C.sequence_alignment(human, pred, xbin, ybin, threshold, gap, eps, table))


def scanmatch_align(df: DataFrame, xbin=16, ybin=12, threshold=3.5, gap=0.0, temp_bin=0, offset=(0, 0), table=None,
                    width=G.CANVAS_WIDTH, height=G.CANVAS_HEIGHT) -> DataFrame:
    """One output row per step of the alignment: ``step, a, b``, -1 for a gap."""
    human = _symbols(HUMAN, width, height, xbin, ybin, offset, temp_bin)
    pred = _symbols(PREDICTED, width, height, xbin, ybin, offset, temp_bin)
    pairs = df.withColumn("_pairs", C.sequence_pairs(human, pred, xbin, ybin, threshold, gap, table))
    kept = [c for c in df.columns if c not in (*HUMAN, *PREDICTED)]
    return pairs.select(*kept, F.posexplode("_pairs").alias("step", "pair")).select(
        *kept, "step", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))


def custom_regions(df: DataFrame, mask: DataFrame, x="x", y="y", key="pos", trial="img_usr_tgt") -> DataFrame:
    """Symbol strings from a custom region mask ``(y, x, symbol)`` instead of the grid.

    ``df`` is the long form with integer pixel coordinates; the join is on the pixel.
    """
    hit = df.join(mask.select(F.col("y").alias("_my"), F.col("x").alias("_mx"), "symbol"),
                  (F.col(y) == F.col("_my")) & (F.col(x) == F.col("_mx")), "left")
    rows = F.array_sort(F.collect_list(F.struct(key, "symbol")))
    return hit.groupBy(trial).agg(F.transform(rows, lambda s: s["symbol"]).alias("symbols"))


def merge_rare_symbols(mask: DataFrame, threshold: int, merged: int) -> DataFrame:
    """Replace symbols of at most ``threshold`` cells by one, number densely.

    Adds ``symbol_no``; counts and numbers are per symbol, so the lookup joined
    back is as long as the list of symbols.
    """
    counts = mask.groupBy("symbol").agg(F.count("*").alias("_n"))
    kept = F.when(F.col("_n") <= threshold, F.lit(merged)).otherwise(F.col("symbol"))
    lookup = counts.select("symbol", kept.alias("kept"))
    numbers = lookup.select("kept").distinct().select(
        "kept", (F.row_number().over(Window.orderBy("kept")) - 1).alias("symbol_no"))
    return mask.join(lookup, "symbol").join(numbers, "kept").drop("symbol").withColumnRenamed("kept", "symbol")


def multimatch(df: DataFrame, size=(G.CANVAS_WIDTH, G.CANVAS_HEIGHT), grouping=False,
               t_dir=0.0, t_dur=0.0, t_amp=0.0, name="multimatch") -> DataFrame:
    """Struct of vector, direction, length, position and duration similarity."""
    return df.withColumn(name, C.vector_similarity(
        PREDICTED, HUMAN, *size, grouping=grouping, t_dir=t_dir, t_dur=t_dur, t_amp=t_amp))


def edit_distance(df: DataFrame, n=5, substitution=1, width=G.CANVAS_WIDTH, height=G.CANVAS_HEIGHT,
                  name="sed") -> DataFrame:
    """Edit distance of the letter strings on an n x n grid."""
    return df.withColumn(name, _letter_distance(n, substitution, width, height))


def _letter_distance(n, substitution, width, height):
    human = G.open_cells(*HUMAN[:2], width, height, n)
    pred = G.open_cells(*PREDICTED[:2], width, height, n)
    if substitution == 1:
        return C.edit_distance(*G.common_letters(human, pred))
    # cells that have no number have no letter either
    return C.edit_distance(F.array_compact(human), F.array_compact(pred), substitution)


def time_delay(df: DataFrame, k=3, mode="mean", name="time_delay") -> DataFrame:
    """Time-delay embedding distance for windows of ``k``; mode mean or hausdorff."""
    return df.withColumn(name, C.time_delay_distance(HUMAN[:2], PREDICTED[:2], k, mode))


def scaled_time_delay(df: DataFrame, similarity=True, width=G.CANVAS_WIDTH, height=G.CANVAS_HEIGHT,
                      name="stde") -> DataFrame:
    return df.withColumn(name, C.scaled_time_delay(HUMAN[:2], PREDICTED[:2], width, height, similarity))


def point_distance(df: DataFrame, name="point_distance") -> DataFrame:
    """Sum of point distances of equally long paths, else null."""
    return df.withColumn(name, G.point_distance_sum(*HUMAN[:2], *PREDICTED[:2]))


def score_trials(df: DataFrame, width=G.CANVAS_WIDTH, height=G.CANVAS_HEIGHT) -> DataFrame:
    """All path-to-path scores in one pass.

    The UDF columns sit in one projection, so each batch goes to Python once.
    """
    mm = C.vector_similarity(PREDICTED, HUMAN, width, height)
    grid = [_symbols(p, width, height, 16, 12, (0, 0), 0) for p in (HUMAN, PREDICTED)]
    timed = [_symbols(p, width, height, 16, 12, (0, 0), 50) for p in (HUMAN, PREDICTED)]
    scored = df.select(
        "*",
        C.sequence_alignment(*grid).alias("sm_wo_d"),
        C.sequence_alignment(*timed).alias("sm_w_d"),
        mm.alias("_mm"),
        _letter_distance(5, 1, width, height).alias("sed"),
        C.scaled_time_delay(HUMAN[:2], PREDICTED[:2], width, height).alias("stde"))
    return scored.select("*", *[F.col(f"_mm.{f}").alias(f"mm_{f}") for f in C.MULTIMATCH_FIELDS]).drop("_mm")

