"""Rewards of logged answers, advantages, token statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import answers as A
from ..functions import comparisons as C
from ..functions import geometry as G

# fixed values: divisor guard of the path reward, guard of the advantage
REWARD_EPS = 1e-7
ADVANTAGE_EPS = 1e-4
EVALUATION_ONLY = ("prompt", "completion", "image_path")


def path_symbols(points, width, height) -> Column:
    """Grid symbols of parsed points, scaled to the canvas and padded."""
    xs = G.padded(G.rescale(F.transform(points, lambda p: p["x"].cast("double")), width, G.CANVAS_WIDTH))
    ys = G.padded(G.rescale(F.transform(points, lambda p: p["y"].cast("double")), height, G.CANVAS_HEIGHT))
    return G.grid_symbols(xs, ys)


def scanpath_reward(df: DataFrame, name="accuracy_scanpath") -> DataFrame:
    """Grid alignment of the answer with the solution, in [0, 1].

    An answer without points scores 0, and so does one that cannot be scored: a null
    text, a size that is not positive, a score that is not a number. The whole solution
    text is searched for points; one without any is padded like a short path.
    """
    parsed = df.withColumns({
        "_said": A.answer_points("content"),
        "_true": A.points(A.normalized(A.stripped("solution")))})
    usable = F.coalesce(F.col("_said").isNotNull() & F.col("_true").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    none = F.array().cast("array<int>")
    symbols = parsed.withColumn("_usable", usable).withColumns({
        "_a": F.when(F.col("_usable"), path_symbols(F.col("_said"), "width", "height")).otherwise(none),
        "_b": F.when(F.col("_usable"), path_symbols(F.col("_true"), "width", "height")).otherwise(none)})
    score = C.sequence_alignment("_b", "_a", eps=REWARD_EPS)
    # a NaN sorts above all numbers
    clipped = F.least(F.greatest(F.nanvl(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (symbols.withColumn("_score", clipped)
            .withColumn(name, F.when(~F.col("_usable") | (F.size("_said") == 0), F.lit(0.0)).otherwise(F.coalesce("_score", F.lit(0.0))))
            .drop("_said", "_true", "_a", "_b", "_score", "_usable"))


def format_reward(df: DataFrame, name="format") -> DataFrame:
    return df.withColumn(name, A.format_reward("content"))


REWARDS = {"accuracy_scanpath": scanpath_reward, "format": format_reward}


def register_reward(name: str, function) -> None:
    """Add a reward: ``function(df, name)`` adds the column ``name``."""
    REWARDS[name] = function


def rewards(completions: DataFrame, names=("accuracy_scanpath",), weights=None) -> DataFrame:
    """Evaluate named rewards and add their sum as ``reward``."""
    out = completions.drop(*EVALUATION_ONLY)
    for name in names:
        out = REWARDS[name](out, name)
    terms = [F.col(n) * F.lit(float((weights or {}).get(n, 1.0))) for n in names]
    return out.withColumn("reward", reduce(lambda a, b: a + b, terms))


def with_prompts(completions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Repeat the prompt columns for each of its answers."""
    return completions.join(prompts, "prompt_id")


def group_statistics(df: DataFrame, group="prompt_id", reward="reward") -> DataFrame:
    """Mean and sample deviation per group; the deviation of one answer is NaN."""
    return df.groupBy(group).agg(
        F.avg(reward).alias("reward_mean"),
        F.coalesce(F.stddev_samp(reward), F.lit(float("nan"))).alias("reward_std"))


def advantages(df: DataFrame, group="prompt_id", reward="reward", eps=ADVANTAGE_EPS) -> DataFrame:
    """Group-relative advantage ``(reward - mean) / (std + eps)``.

    Statistics are aggregated first and joined back, so a very large group is
    combined map-side and its rows may be split over tasks; a window would send
    them all to one. ``reward`` is read twice: write costly rewards beforehand.
    """
    joined = df.join(group_statistics(df, group, reward), group)
    return joined.withColumn("advantage", (F.col(reward) - F.col("reward_mean")) / (F.col("reward_std") + F.lit(eps)))


# --- token statistics --------------------------------------------------------

def answer_length(token_ids, end_token) -> Column:
    """Tokens up to and including the first end token; all when there is none."""
    ids = G.col(token_ids)
    at = F.array_position(ids, F.lit(end_token)).cast("int")
    return F.when(at > 0, at).otherwise(F.size(ids))


def masked(values, length) -> Column:
    return G.prefix(values, length)


def token_kl(ref_logps, logps) -> Column:
    """Per token ``exp(d) - d - 1`` with d = reference - model."""
    return F.zip_with(G.col(ref_logps), G.col(logps), lambda r, p: F.exp(r - p) - (r - p) - 1)


def array_mean(values) -> Column:
    """Mean of an array, NaN when it is empty."""
    v = G.col(values)
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(v) > 0, total / F.size(v)).otherwise(F.lit(float("nan")))


def kl_tokens(df: DataFrame, end_token="R") -> DataFrame:
    """Add the answer length, the masked per-token KL and its mean."""
    cut = df.withColumn("answer_length", answer_length("token_ids", end_token))
    kl = cut.withColumn("kl", masked(token_kl("ref_logps", "logps"), "answer_length"))
    return kl.withColumn("mean_kl", array_mean("kl"))


def objective(df: DataFrame, beta=0.04, advantage="advantage") -> DataFrame:
    """Logged objective per answer: mean over tokens of ``-(advantage - beta * kl)``."""
    per_token = F.transform("kl", lambda k: -(F.col(advantage) - F.lit(float(beta)) * k))
    return df.withColumn("loss", array_mean(per_token))


def last_tokens(ids, n) -> Column:
    """The last ``n`` entries; all when there are fewer."""
    c = G.col(ids)
    return F.slice(c, F.greatest(F.size(c) - F.lit(n - 1), F.lit(1)), F.lit(n))


def step_metrics(df: DataFrame, names=("accuracy_scanpath",), step="step", group="prompt_id",
                 length="answer_length", kl="mean_kl") -> DataFrame:
    """Per step: mean answer length, rewards, mean group deviation, mean KL.

    The group deviation counts once per answer, as it is repeated for each.
    """
    per_group = df.groupBy(step, group).agg(
        F.count("*").alias("_n"), F.stddev_samp("reward").alias("_std"),
        *[F.sum(c).alias(f"_s{i}") for i, c in enumerate((length, *names, "reward", kl))])
    # a group holds one deviation however many answers it has
    n = F.sum("_n")
    std = F.coalesce("_std", F.lit(float("nan")))
    labels = ["completion_length", *[f"rewards/{r}" for r in names], "reward", "kl"]
    return per_group.groupBy(step).agg(
        *[(F.sum(f"_s{i}") / n).alias(label) for i, label in enumerate(labels)],
        (F.sum(std * F.col("_n")) / n).alias("reward_std"))


def logged_metrics(metrics: DataFrame, every: int, step="step", prefix="") -> DataFrame:
    """Average of step metrics between log points as ``(log_no, metric, value)``."""
    names = [c for c in metrics.columns if c != step]
    long = metrics.withColumn("log_no", F.floor(F.col(step) / F.lit(every))).unpivot("log_no", names, "metric", "value")
    return long.groupBy("log_no", F.concat(F.lit(prefix), "metric").alias("metric")).agg(F.avg("value").alias("value"))
