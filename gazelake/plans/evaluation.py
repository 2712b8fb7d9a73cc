"""The evaluation report: trial scores, key scores, means overall and per type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import answers as A
from ..functions import geometry as G
from ..operators import clusters, saliency, scanpath, sequences
from ..session import cut_lineage

# fixed values: report names of the trial and key scores
TRIAL_METRICS = {
    "sm_score_wo_d": "sm_wo_d", "sm_score_w_d": "sm_w_d",
    "mm_score_Vec": "mm_vector", "mm_score_Dir": "mm_direction", "mm_score_Len": "mm_length",
    "mm_score_Pos": "mm_position", "mm_score_Dur": "mm_duration",
    "sed_score": "sed", "stde_score": "stde", "ss_score": "ss", "ss_score_time": "ss_time",
    "sss_score": "sss", "sss_score_time": "sss_time",
}
KEY_METRICS = {"CC": "cc", "AUC": "auc", "NSS": "nss", "sAUC": "sauc", "KLD": "kld", "SIM": "sim"}
REPORTED = ("sm_score_wo_d", "mm_score_Vec", "mm_score_Dir", "mm_score_Len", "mm_score_Pos", "sed_score",
            "stde_score", "ss_score", "CC", "AUC", "NSS", "sAUC")
OVERALL = "all"


def from_predictions(records: DataFrame, order=None) -> DataFrame:
    """Trials to evaluate from prediction records ``(..., prediction array<array<int>>)``.

    Malformed points are repaired, images and targets reduced to their keys.
    ``order`` names the column that says which trial of a subject is the last;
    without it the order of one file is taken.
    """
    repaired = records.withColumns({
        "_p": A.repaired("prediction", "width", "height"),
        "trial": F.monotonically_increasing_id() if order is None else F.col(order)})
    return repaired.select(
        "img_usr_tgt", G.image_stem("image").alias("image"), G.target_key("target_id").alias("target_id"), "username",
        "width", "height", "x", "y", "t", "trial",
        F.transform("_p", lambda p: p[0].cast("double")).alias("px"), F.transform("_p", lambda p: p[1].cast("double")).alias("py"))


def on_canvas(trials: DataFrame, pad: bool) -> DataFrame:
    """Raw trials with human ``x, y, t`` (s) and predicted ``px, py`` on the canvas, in ms."""
    out = trials.withColumns({
        **{c: G.rescale(c, "width", G.CANVAS_WIDTH) for c in ("x", "px")},
        **{c: G.rescale(c, "height", G.CANVAS_HEIGHT) for c in ("y", "py")},
        "t": G.to_millis("t"), "pt": F.transform("px", lambda _: F.lit(0.0))})
    return out.withColumns({c: G.padded(c) for c in ("x", "y", "t", "px", "py", "pt")}) if pad else out


def points(trials: DataFrame, x, y, columns) -> DataFrame:
    """Long form of one path per row."""
    zipped = F.explode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y")))
    return trials.select(*columns, zipped.alias("p")).select(*columns, F.col("p.x").alias(x), F.col("p.y").alias(y))


def means(scores: DataFrame, metrics: dict, by=None) -> DataFrame:
    """Plain averages, overall and (with ``by``) per group in one grouping-sets pass."""
    columns = [F.avg(c).alias(n) for n, c in metrics.items() if c in scores.columns]
    if by is None:
        return scores.agg(*columns).withColumn("subset", F.lit(OVERALL))
    sets = scores.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("_g"), *columns)
    label = F.when(F.col("_g") == 1, F.lit(OVERALL)).otherwise(F.col(by))
    return sets.withColumn("subset", label).drop(by, "_g")


def report(trial_scores: DataFrame, key_scores: DataFrame, by=None) -> DataFrame:
    """Metric means per ``subset``.

    ``key_scores`` carries its own ``subset`` column, because the shuffled AUC
    of all data is not the mean over its parts.
    """
    trial_part = means(trial_scores, TRIAL_METRICS, by)
    key_part = key_scores.groupBy("subset").agg(*[F.avg(c).alias(n) for n, c in KEY_METRICS.items()])
    return trial_part.join(key_part, "subset")


def key_scores(trials: DataFrame, keys, by=None) -> DataFrame:
    """Saliency scores per key, with shuffle maps of all data and of every group."""
    unpadded = on_canvas(trials, pad=False)
    # a row counts for all data and, when asked, for its own group
    labels = F.array(F.lit(OVERALL)) if by is None else F.array(F.lit(OVERALL), F.col(by))
    tagged = unpadded.withColumn("subset", F.explode(labels))
    columns = ["subset", *keys]
    return saliency.saliency_scores(points(tagged, "x", "y", columns), points(tagged, "px", "py", columns),
                                    columns, subset=["subset"])


def evaluate(trials: DataFrame, keys=("image", "target_id"), by=None, centers=None, strings=None,
             history=None, segmentation=None, id_cols=("img_usr_tgt",), order="trial") -> DataFrame:
    """All metrics of raw trials with predictions, one row per subset.

    Clusters come from ``centers`` and ``strings``, or are fitted on ``history``
    (by default the human paths of the trials themselves); of a subject's trials
    the last in ``order`` gives the string.
    """
    keys = list(keys)
    trials = cut_lineage(trials)
    if centers is None:
        centers, strings = clusters.fit_clusters(trials if history is None else history, keys, order=order)
    scored = scanpath.score_trials(on_canvas(trials, pad=True))
    scored = sequences.sequence_score(scored, centers, strings, keys)
    if segmentation is not None:
        # read on both sides of a join
        scored = cut_lineage(scored)
        scored = sequences.semantic_score(scored, segmentation, list(id_cols))
    return report(scored, key_scores(trials, keys, by), by)


def long_report(wide: DataFrame) -> DataFrame:
    """``(subset, metric, value)`` rounded to four digits."""
    names = [c for c in wide.columns if c != "subset"]
    return wide.unpivot("subset", names, "metric", "value").withColumn("value", F.round("value", 4))

