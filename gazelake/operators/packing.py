"""Training-set lengths, packs and masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import words as W
from ..functions.geometry import col
from ..session import spread
from . import prepare

# fixed values: token budget of media, sample, pack and batch; ignored label
IMAGE_TOKENS = 128
SAMPLE_OVERHEAD = 21
PACK_TOKENS = 4096
BATCH_ROWS = 256
IGNORE = -100
HEADER_TOKENS = 3


def turn_words(conversations) -> Column:
    return F.aggregate(F.transform(col(conversations), lambda m: F.size(W.words(m["value"]))),
                       F.lit(0), lambda acc, n: acc + n)


def estimated_length(conversations, has_image) -> Column:
    """Words of all turns plus a fixed amount for an image."""
    return turn_words(conversations) + F.when(has_image, F.lit(IMAGE_TOKENS)).otherwise(F.lit(0))


def signed_length(conversations, has_media) -> Column:
    """Words of all turns; negative for text-only samples."""
    n = turn_words(conversations)
    return F.when(has_media, n).otherwise(-n)


def stored_length(num_tokens) -> Column:
    return F.coalesce(col(num_tokens), F.lit(1))


def token_count(text_tokens, grid=None) -> Column:
    """Fixed overhead, text tokens and a quarter of the grid cells of all media.

    ``grid`` is ``array<struct<t,h,w>>``; a medium that is missing has a null entry.
    """
    total = F.lit(SAMPLE_OVERHEAD) + text_tokens
    if grid is None:
        return total
    cells = F.transform(col(grid), lambda g: F.coalesce(F.floor(g["t"] * g["h"] * g["w"] / 4), F.lit(0)))
    return total + F.coalesce(F.aggregate(cells, F.lit(0).cast("bigint"), lambda acc, n: acc + n), F.lit(0))


def lengths(samples: DataFrame, image="image", video="video", conversations="conversations") -> DataFrame:
    """Add the length estimate, the signed length and the token count."""
    with_image = F.size(image) > 0
    with_media = with_image | (F.size(video) > 0)
    return samples.withColumns({
        "length": estimated_length(conversations, with_image),
        "modality_length": signed_length(conversations, with_media),
        "num_tokens": token_count(turn_words(conversations))})


def best_fit(tokens, capacity):
    """Bin number of each weight: heaviest first into the fullest bin that has room.

    Equal weights keep their order. A weight above the capacity gets a bin alone.
    """
    bins = np.empty(len(tokens), dtype=np.int32)
    load: list[float] = []
    for i in np.argsort(-np.asarray(tokens), kind="stable"):
        room = [(used, -b) for b, used in enumerate(load) if used + tokens[i] <= capacity]
        if room:
            b = -max(room)[1]
        else:
            b = len(load)
            load.append(0)
        bins[i] = b
        load[b] += tokens[i]
    return bins


def pack(samples: DataFrame, order, size=PACK_TOKENS, batch=BATCH_ROWS, tokens="num_tokens") -> DataFrame:
    """Assign samples to packs of at most ``size`` tokens within batches of ``batch``.

    ``order`` (one column that identifies a sample) sets the batches and breaks
    ties. Adds ``batch, pack``. A group is one batch, so it is bounded.
    """
    batched = prepare.in_batches(samples.select(order, tokens), order, size=batch)
    schema = batched.select("batch", order, tokens).schema.add("pack", "integer")

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        return group.assign(pack=best_fit(group[tokens].to_numpy(), size))[schema.fieldNames()]

    return spread(batched, "batch").groupBy("batch").applyInPandas(assign, schema)


def pack_offsets(packed: DataFrame, order, tokens="num_tokens") -> DataFrame:
    """Start of each sample in its pack, and its end (cumulative tokens)."""
    so_far = Window.partitionBy("batch", "pack").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(tokens).over(so_far)
    return packed.withColumns({"start": end - F.col(tokens), "end": end})


def merge_packs(packed: DataFrame, samples: DataFrame, order, sequences=("input_ids", "labels")) -> DataFrame:
    """One row per pack: sequences laid end to end and cumulative lengths from 0.

    A pack holds at most one batch, so the collected list is bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, *sequences)))
    grouped = packed.select("batch", "pack", order).join(samples.select(order, *sequences), order).groupBy(
        "batch", "pack").agg(rows.alias("_r"))
    parts = F.transform("_r", lambda s: F.size(s[sequences[0]]))
    cumulative = F.aggregate(parts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return grouped.select("batch", "pack", *[F.flatten(F.col(f"_r.{c}")).alias(c) for c in sequences],
                          cumulative.alias("cumulative_lengths"))


def label_mask(turns) -> Column:
    """Labels of tokenised turns ``array<struct<role, ids>>``.

    System and user tokens and the first three tokens of an answer are ignored.
    """
    def of_turn(m):
        answer = ~m["role"].isin("system", "user")
        return F.transform(m["ids"], lambda t, i: F.when(answer & (i >= HEADER_TOKENS), t).otherwise(F.lit(IGNORE)))

    return F.flatten(F.transform(col(turns), of_turn))


def frame_plan(frames, fps, interval=4, least=4, most=8) -> Column:
    """Distinct frame numbers of a video: one per interval, evenly spaced.

    The count is rounded half to even and kept within ``least`` and ``most``.
    """
    frames, fps = col(frames), col(fps)
    n = F.least(F.greatest(F.bround(frames / fps / F.lit(float(interval))), F.lit(float(least))), F.lit(float(most))).cast("int")
    step = (frames - 1) / F.greatest(n - 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * step).cast("int")))


def seconds_per_grid(frames, fps, plan, patch=2, repeats=3) -> Column:
    """Temporal patch over the sampled frame rate, repeated."""
    rate = F.size(col(plan)) / (col(frames) / col(fps))
    return F.array_repeat(F.lit(float(patch)) / rate, repeats)
