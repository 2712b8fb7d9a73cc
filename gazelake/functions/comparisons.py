"""Arrow UDFs over array columns, one batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from . import kernels
from .geometry import CANVAS_HEIGHT, CANVAS_WIDTH, col, size_of


def _ratio(numerator, denominator):
    with np.errstate(invalid="ignore", divide="ignore"):
        return pa.array(np.asarray(numerator, dtype=np.float64) / denominator)


def _sequences(a, b):
    """Two Arrow list columns as lists of NumPy arrays, and the longer length of each row."""
    empty = np.empty(0, np.int64)
    a, b = ([empty if v is None else v for v in c.to_pandas().tolist()] for c in (a, b))
    return a, b, np.array([max(len(p), len(q)) for p, q in zip(a, b)], dtype=np.float64)


def _known(result, *inputs):
    """Null where an input is null."""
    missing = inputs[0].is_null()
    for column in inputs[1:]:
        missing = pc.or_(missing, column.is_null())
    return pc.if_else(missing, pa.scalar(None, result.type), result)


# Scores are returned as Arrow arrays: from pandas a NaN would become a null.

def _alignment_udf(matrix, gap=0.0, eps=0.0):
    @arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q, longest = _sequences(a, b)
        _, best = kernels.align_scores(p, q, lambda u, v: matrix[u, v], gap, edge=1)
        return _known(_ratio(best, matrix.max() * longest + eps), a, b)

    return score


def _match_udf(gap=0.0):
    @arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right, longest = _sequences(a, b)
        if gap == 0.0:
            return _known(_ratio([kernels.lcs_length(p.tolist(), q.tolist()) for p, q in zip(left, right)], longest), a, b)
        last, _ = kernels.align_scores(left, right, lambda u, v: (u == v).astype(np.float64), gap)
        return _known(_ratio(last, longest), a, b)

    return score


def _common_udf():
    @arrow_udf("int")
    def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else kernels.lcs_length(p, q) for p, q in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return lcs


MULTIMATCH_FIELDS = ("vector", "direction", "length", "position", "duration")


def _multimatch_udf(thresholds=None):
    @arrow_udf(", ".join(f"{f} double" for f in MULTIMATCH_FIELDS))
    def compare(x: pa.Array, y: pa.Array, t: pa.Array, px: pa.Array, py: pa.Array, pt: pa.Array,
                width: pa.Array, height: pa.Array) -> pa.Array:
        first, second = (list(zip(*(c.to_pandas() for c in side))) for side in ((x, y, t), (px, py, pt)))
        scores = kernels.multimatch_scores(first, second, width.to_numpy(False), height.to_numpy(False), thresholds)
        return pa.StructArray.from_arrays([pa.array(scores[:, i]) for i in range(5)], names=list(MULTIMATCH_FIELDS))

    return compare


def _time_delay_udf(kernel):
    @arrow_udf("double")
    def score(x: pa.Array, y: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        human, simulated = (list(zip(*(c.to_pandas() for c in side))) for side in ((x, y), (px, py)))
        return pa.array(kernel(human, simulated))

    return score


def _grid_matrix(xbin, ybin, threshold, table):
    return kernels.grid_similarity(xbin, ybin, threshold) if table is None else np.asarray(table, dtype=np.float64)


def sequence_alignment(a, b, xbin=16, ybin=12, threshold=3.5, gap=0.0, eps=0.0, table=None) -> Column:
    """Alignment score of two grid symbol sequences, 0/0 is NaN.

    ``table`` replaces the distance-based symbol similarities by a matrix.
    """
    return _alignment_udf(_grid_matrix(xbin, ybin, threshold, table), gap, eps)(col(a), col(b))


def sequence_pairs(a, b, xbin=16, ybin=12, threshold=3.5, gap=0.0, table=None) -> Column:
    """The alignment itself: ``array<struct<a,b>>`` with -1 for a gap."""
    matrix = _grid_matrix(xbin, ybin, threshold, table)

    @arrow_udf("array<struct<a:int,b:int>>")
    def align(a: pa.Array, b: pa.Array) -> pa.Array:
        sizes, first, second = kernels.alignment_steps(*_sequences(a, b)[:2], matrix, gap)
        steps = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=["a", "b"])
        return _known(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), steps), a, b)

    return align(col(a), col(b))


def common_length(a, b) -> Column:
    """Longest common subsequence length of two arrays of any symbol type."""
    return _common_udf()(col(a), col(b))


def match_ratio(a, b, gap=0.0) -> Column:
    """0/1 alignment score over the longer length; NaN when both are empty.

    Without gap cost that score is the longest common subsequence.
    """
    return _match_udf(gap)(col(a), col(b))


def edit_distance(a, b, substitution=1) -> Column:
    """Distance of two strings, by the built-in for unit costs; with other costs also of two integer arrays."""
    if substitution == 1:
        return F.levenshtein(col(a), col(b))

    @arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        texts = pa.types.is_string(a.type) or pa.types.is_large_string(a.type)
        sides = [[v or "" for v in c.to_pylist()] for c in (a, b)] if texts else _sequences(a, b)[:2]
        found = kernels.edit_distances(*sides, substitution)
        return _known(pa.array(found, pa.int32()), a, b)

    return distance(col(a), col(b))


def vector_similarity(first, second, width=CANVAS_WIDTH, height=CANVAS_HEIGHT, grouping=False,
                      t_dir=0.0, t_dur=0.0, t_amp=0.0) -> Column:
    """Struct of the five vector similarities of two (x, y, t) column triples.

    The size may be given per row as columns.
    """
    thresholds = (t_amp, t_dir, t_dur) if grouping else None
    sizes = (size_of(v).cast("double") for v in (width, height))
    return _multimatch_udf(thresholds)(*(col(c) for c in (*first, *second)), *sizes)


def nearest_clusters(xs, ys, ids, cxs, cys) -> Column:
    """Id of the closest centre of every fixation; the first listed one on ties. Null without centres or path."""
    @pandas_udf("array<int>")
    def nearest(x: pd.Series, y: pd.Series, ids: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else kernels.nearest_ids(*row) for row in zip(x, y, ids, cx, cy)], dtype=object)

    return nearest(*(col(c) for c in (xs, ys, ids, cxs, cys)))


def simplified(x, y, t, t_dir=0.0, t_dur=0.0, t_amp=0.0) -> Column:
    """Saccades left after merging; the last duration belongs to the end point."""
    @pandas_udf("saccades array<struct<x:double,y:double,dx:double,dy:double>>, durations array<double>")
    def merge(x: pd.Series, y: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for path in zip(x, y, t):
            v = kernels.saccade_vectors(*path)
            p = kernels.simplify(kernels.SaccadeList(v["x"], v["y"], v["dx"], v["dy"], v["t"]), t_amp, t_dir, t_dur)
            rows.append(([{"x": a, "y": b, "dx": c, "dy": d} for a, b, c, d in zip(p.x, p.y, p.dx, p.dy)], p.t))
        return pd.DataFrame(rows, columns=["saccades", "durations"])

    return merge(col(x), col(y), col(t))


def time_delay_distance(human, simulated, k, mode="mean") -> Column:
    """Time-delay embedding distance for windows of k; null when a path is shorter."""
    d = _time_delay_udf(lambda h, s: kernels.time_delay(h, s, k, mode))(*(col(c) for c in (*human, *simulated)))
    return F.when((F.size(col(human[0])) >= k) & (F.size(col(simulated[0])) >= k), d)


def _scaled_time_delay_udf(similarity=True):
    @arrow_udf("double")
    def score(x: pa.Array, y: pa.Array, px: pa.Array, py: pa.Array, scale: pa.Array) -> pa.Array:
        human, simulated = (list(zip(*(c.to_pandas() for c in side))) for side in ((x, y), (px, py)))
        return pa.array(kernels.scaled_time_delay(human, simulated, scale.to_numpy(False), similarity))

    return score


def scaled_time_delay(human, simulated, width=CANVAS_WIDTH, height=CANVAS_HEIGHT, similarity=True) -> Column:
    """Mean time-delay similarity (or distance) over all window lengths."""
    scale = F.greatest(size_of(width), size_of(height), F.lit(3)).cast("double")
    return _scaled_time_delay_udf(similarity)(*(col(c) for c in (*human, *simulated)), scale)


def register(spark: SparkSession) -> None:
    """SQL names for the comparisons with default parameters.

    ``multimatch`` and ``stde`` take the size last: width and height, or the larger one.
    """
    for name, udf in {
        "scanmatch": _alignment_udf(kernels.grid_similarity(16, 12, 3.5)),
        "multimatch": _multimatch_udf(),
        "stde": _scaled_time_delay_udf(),
        "nw_score": _match_udf(),
        "lcs_len": _common_udf(),
    }.items():
        spark.udf.register(name, udf)
