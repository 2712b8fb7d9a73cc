"""Saliency scores per key from fixation counts.

Fixations are counted per pixel with a partial aggregate first. What reaches the
task of a key is therefore at most one row per canvas pixel, however many
fixations the key has. The shuffle map of a subset is a bitmap of 24 kB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..session import cut_lineage, spread

WIDTH, HEIGHT = G.CANVAS_WIDTH, G.CANVAS_HEIGHT
SIGMA = 22.4
# fixed values: smoothing constants of the scores
EPS = 1e-15
EPS_SECOND_FORM = 1e-12
THRESHOLD_STEP = 0.01
SCORES = ("cc", "auc", "nss", "sauc", "kld", "sim")
# bits of one built-in bitmap bucket
BUCKET_BITS = 32_768
# copies of a shuffle map for each shuffle partition, so that the keys of a subset are many tasks
COPIES = 4
# bins that tell values of a map apart, and output rows that are smoothed together
BINS = 1 << 16
BAND = 48


def pixels(fixations: DataFrame, keys, x, y, human: bool) -> DataFrame:
    """``keys + (pixel)`` of long-form canvas fixations; pixel = row * width + column."""
    row, column = G.pixel_index(F.col(y), HEIGHT, human), G.pixel_index(F.col(x), WIDTH, human)
    return fixations.select(*keys, (row * WIDTH + column).alias("pixel"))


def heatmap(fixations: DataFrame, keys, x="x", y="y", human=True) -> DataFrame:
    """Fixation count per key and pixel ``(y, x, n)``."""
    counted = pixels(fixations, keys, x, y, human).groupBy(*keys, "pixel").agg(F.count("*").alias("n"))
    return counted.select(*keys, F.floor(F.col("pixel") / WIDTH).cast("int").alias("y"),
                          (F.col("pixel") % WIDTH).alias("x"), "n")


def shuffle_map(fixations: DataFrame, subset=(), x="x", y="y") -> DataFrame:
    """Distinct human pixels of each subset of the data."""
    return (pixels(fixations, subset, x, y, True).distinct()
            .select(*subset, F.floor(F.col("pixel") / WIDTH).cast("int").alias("y"), (F.col("pixel") % WIDTH).alias("x")))


def shuffle_bits(human_pixels: DataFrame, subset=()) -> DataFrame:
    """The same as one packed bitmap per subset, built by map-side bitmap aggregates."""
    position = F.col("pixel").cast("bigint") + 1
    buckets = human_pixels.groupBy(*subset, F.bitmap_bucket_number(position).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("_bits"))
    return buckets.groupBy(*subset).agg(
        F.map_from_entries(F.collect_list(F.struct("_bucket", "_bits"))).alias("shuffle_bits"))


def blur_kernel(size, sigma=SIGMA, truncate=4.0):
    """Gaussian smoothing as a matrix: normalised, cut off, mirrored at the edges."""
    radius = int(truncate * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    weights /= weights.sum()
    matrix = np.zeros((size, size))
    source = np.arange(size)[:, None] + offsets
    period = source % (2 * size)
    mirrored = np.where(period < size, period, 2 * size - 1 - period)
    np.add.at(matrix, (np.repeat(np.arange(size), len(offsets)), mirrored.ravel()), np.tile(weights, size))
    return matrix


def blurred(pixel, count, rows, columns):
    """Smoothed map of sparse counts divided by its maximum; NaN when there are none."""
    py, px = pixel // columns.shape[0], pixel % columns.shape[0]
    if len(pixel) < rows.shape[0]:
        out = (rows[:, py] * count) @ columns[:, px].T
    else:
        dense = np.zeros((rows.shape[0], columns.shape[0]))
        dense[py, px] = count
        out = rows @ dense @ columns.T
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / out.max()


def _distribution(values):
    shifted = values + EPS
    shifted /= shifted.sum()
    return shifted.ravel()


def _correlation(p, g):
    p, g = p - p.mean(), g - g.mean()
    sp, sg = np.sqrt(p @ p), np.sqrt(g @ g)
    flat = 1e-8 * np.sqrt(len(p))
    return 1.0 if sp <= flat or sg <= flat else float(p @ g / (sp * sg))


def _divergence(p, g, eps=EPS):
    ratio = p + eps
    np.divide(g, ratio, out=ratio)
    ratio += eps
    np.log(ratio, out=ratio)
    return float(g @ ratio)


def correlation(pred, gt):
    """Pearson correlation; 1 when a map is flat."""
    return _correlation(_distribution(pred), _distribution(gt))


def similarity(pred, gt):
    return float(np.minimum(_distribution(pred), _distribution(gt)).sum())


def divergence(pred, gt, second_form=False):
    """KL divergence of the human map from the predicted one."""
    if second_form:
        p, g = ((m / m.sum() if m.any() else m).ravel().astype(float) for m in (pred, gt))
        return _divergence(p, g, EPS_SECOND_FORM)
    return _divergence(_distribution(pred), _distribution(gt))


def scanpath_saliency(pred, pixel, count, second_form=False):
    """Mean standardised map value at the human fixations.

    The second form scales by the maximum, uses the sample deviation and counts
    a pixel once.
    """
    if not len(pixel):
        return float("nan")
    if second_form:
        m = pred / pred.max() if pred.max() != 0 else pred
        deviation = m.std(ddof=1)
        m = (m - m.mean()) / deviation if deviation != 0 else m
        return float(m.ravel()[pixel].mean())
    m = pred - pred.mean()
    if m.max() > 0:
        m = m / m.std()
    return float(np.average(m.ravel()[pixel], weights=count))


def _share(values, w, thresholds):
    """Share of the values that reach each threshold, the highest threshold first."""
    edges = np.append(thresholds, np.inf)
    slot = np.minimum((values / THRESHOLD_STEP).astype(np.int64), len(thresholds) - 1)
    # division may be off by one step next to a threshold
    slot -= thresholds[slot] > values
    slot += values >= edges[slot + 1]
    slot += 1
    above = np.bincount(slot, weights=w, minlength=len(thresholds) + 1)[::-1].cumsum()
    return above[:-1] / (len(values) if w is None else w.sum())


def _roc_area(at_fixations, weights, negatives):
    """Area under the curve for thresholds 0, 0.01, ... below the largest value."""
    if not len(at_fixations) or not len(negatives):
        return float("nan")
    top = max(at_fixations.max(), negatives.max())
    if np.isnan(top):
        return float("nan")
    thresholds = np.arange(0, top, THRESHOLD_STEP)
    tp = np.concatenate([[0.0], _share(at_fixations, weights, thresholds), [1.0]])
    fp = np.concatenate([[0.0], _share(negatives, None, thresholds), [1.0]])
    return float(np.trapezoid(tp, fp))


def roc_area(pred, pixel, count):
    """AUC with all pixels as negatives: what random negatives give on average."""
    values = pred.ravel()
    return _roc_area(values[pixel], count.astype(float), values)


def shuffled_roc_area(pred, pixel, count, shuffle):
    """AUC with the human pixels of other images as negatives."""
    m = pred - pred.min()
    if m.max() > 0:
        m = m / m.max()
    values = m.ravel()
    others = shuffle.copy()
    others[pixel] = False
    return _roc_area(values[pixel], count.astype(float), values[others])


def judd_roc_area(pred, pixel, jitter_seed=None):
    """AUC with the map values at the fixated pixels as thresholds.

    Jitter is off unless a seed is given.
    """
    if not len(pixel):
        return float("nan")
    m = pred.astype(float)
    if jitter_seed is not None:
        m = m + np.random.default_rng(jitter_seed).random(m.shape) / 1e7
    with np.errstate(invalid="ignore", divide="ignore"):
        m = (m - m.min()) / (m.max() - m.min())
    if np.isnan(m).all():
        return float("nan")
    values = m.ravel()
    thresholds = np.sort(values[np.unique(pixel)])[::-1]
    n = len(thresholds)
    ranked = np.sort(values)
    above = len(values) - np.searchsorted(ranked, thresholds, side="left")
    tp = np.concatenate([[0.0], np.arange(1, n + 1) / n, [1.0]])
    fp = np.concatenate([[0.0], (above - np.arange(n)) / (len(values) - n), [1.0]])
    return float(np.trapezoid(tp, fp))


class Scorer:
    """The scores of a key with buffers that all keys of a task share.

    Maps are scaled to 0..1. Sums of centred maps serve correlation and both standardised
    values, and one histogram of fine bins serves both ROC areas of all pixels: only values in the
    bin of a threshold are compared with it.
    """

    def __init__(self, sigma=SIGMA) -> None:
        self.rows, self.columns = blur_kernel(HEIGHT, sigma), blur_kernel(WIDTH, sigma)
        self.across = np.ascontiguousarray(self.columns.T)
        # first and last source row that reaches a band of output rows
        self.bands = []
        for a in range(0, HEIGHT, BAND):
            reach = np.flatnonzero((self.rows[a:a + BAND] != 0).any(axis=0))
            self.bands.append((a, min(a + BAND, HEIGHT), int(reach[0]), int(reach[-1]) + 1))
        self.pred, self.gt, self.one, self.two = (np.empty((HEIGHT, WIDTH)) for _ in range(4))
        self.bins = np.empty(HEIGHT * WIDTH, dtype=np.int64)
        self.subset, self.others = None, None

    def smoothed(self, pixel, count, out):
        """``blurred`` into a buffer: lines within reach only, and many points of a line as one."""
        line = pixel // WIDTH
        spread_out = self.across[pixel % WIDTH]
        spread_out *= count[:, None]
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        if len(first) * 4 < len(line):
            line, spread_out = line[first], np.add.reduceat(spread_out, first, axis=0)
        for a, b, low, high in self.bands:
            k, m = np.searchsorted(line, (low, high))
            np.matmul(self.rows[a:b, line[k:m]], spread_out[k:m], out=out[a:b])
        out /= out.max()
        return out

    def at_least(self, values, thresholds):
        """How many values, all within 0..1, reach each threshold."""
        np.multiply(values, BINS - 1, out=self.one.ravel())
        np.copyto(self.bins, self.one.ravel(), casting="unsafe")
        upto = np.bincount(self.bins, minlength=BINS).cumsum()
        bin_of = (thresholds * (BINS - 1)).astype(np.int64)
        asked = np.zeros(BINS, dtype=bool)
        asked[bin_of] = True
        close = np.sort(values[asked[self.bins]])
        # of the values close to any threshold: those from it on that share its bin
        from_bin = (close * (BINS - 1)).astype(np.int64)
        same = np.searchsorted(from_bin, bin_of, side="right") - np.searchsorted(close, thresholds)
        return len(values) - upto[bin_of] + same

    def negatives(self, subset, bits, pixel):
        """Human pixels of the subset without those of the key itself."""
        if self.others is None or subset != self.subset:
            self.subset, self.others = subset, np.flatnonzero(_unpacked(bits()))
        return self.others[~np.isin(self.others, pixel)]

    def scores(self, pixel, human_n, pred_n, subset, bits, extra=False):
        """cc, auc, nss, sauc, kld, sim and the second forms of one key; ``pixel`` ascends."""
        human, said = human_n > 0, pred_n > 0
        at, weight = pixel[human], human_n[human]
        if not human.any() or not said.any():
            return self.undefined(at, weight, pixel[said], pred_n[said], bits, extra)
        pred, gt = self.smoothed(pixel[said], pred_n[said], self.pred), self.smoothed(at, weight, self.gt)
        p, g, one, two = (m.ravel() for m in (pred, gt, self.one, self.two))
        low = p.min()
        if not low < 1 or not g.min() < 1:
            return self.plain(pred, gt, at, weight, bits, extra)
        n, p_sum, g_sum = len(p), p.sum(), g.sum()
        p_total, g_total = p_sum + n * EPS, g_sum + n * EPS
        fixated = p[at]
        # all pixels as negatives, and the thresholds of the second form
        steps = np.arange(0, 1.0, THRESHOLD_STEP)
        own = np.sort(fixated)[::-1] if extra else fixated[:0]
        above = self.at_least(p, np.concatenate([steps[::-1], own]))
        tp = np.concatenate([[0.0], _share(fixated, weight.astype(float), steps), [1.0]])
        auc = float(np.trapezoid(tp, np.concatenate([[0.0], above[:len(steps)] / n, [1.0]])))
        # the human pixels of other keys as negatives, on the map stretched to 0..1
        others = p[self.negatives(subset, bits, at)]
        sauc = _roc_area((fixated - low) / (1 - low), weight.astype(float), (others - low) / (1 - low))
        # centred maps
        p_mean = p_sum / n
        np.subtract(p, p_mean, out=one)
        np.subtract(g, g_sum / n, out=two)
        p_square, g_square = one @ one, two @ two
        sp, sg, flat = np.sqrt(p_square) / p_total, np.sqrt(g_square) / g_total, 1e-8 * np.sqrt(n)
        cc = 1.0 if sp <= flat or sg <= flat else float(one @ two / np.sqrt(p_square * g_square))
        nss = float(np.average(fixated - p_mean, weights=weight) / np.sqrt(p_square / n))
        line = [cc, auc, nss, sauc]
        # distributions
        np.add(p, EPS, out=one)
        one /= p_total
        np.add(g, EPS, out=two)
        two /= g_total
        ratio = one + EPS
        np.divide(two, ratio, out=ratio)
        ratio += EPS
        line.append(float(two @ np.log(ratio, out=ratio)))
        line.append(float(np.minimum(one, two, out=ratio).sum()))
        if extra:
            k = len(own)
            found = np.concatenate([[0.0], np.arange(1, k + 1) / k, [1.0]])
            false = np.concatenate([[0.0], (above[len(steps):] - np.arange(k)) / (n - k), [1.0]])
            line.append(float(np.trapezoid(found, false)))
            np.divide(p, p_sum, out=ratio)
            ratio += EPS_SECOND_FORM
            np.divide(g, g_sum, out=two)
            np.divide(two, ratio, out=ratio)
            ratio += EPS_SECOND_FORM
            line.append(float(two @ np.log(ratio, out=ratio)))
            line.append(float((fixated - p_mean).mean() / np.sqrt(p_square / (n - 1))))
        return line

    def undefined(self, at, weight, said, times, bits, extra):
        """A side without fixations has a map of NaN."""
        gt, pred = blurred(at, weight, self.rows, self.columns), blurred(said, times, self.rows, self.columns)
        return self.plain(pred, gt, at, weight, bits, extra)

    @staticmethod
    def plain(pred, gt, at, weight, bits, extra):
        ps, gs = _distribution(pred), _distribution(gt)
        line = [_correlation(ps, gs), roc_area(pred, at, weight), scanpath_saliency(pred, at, weight),
                shuffled_roc_area(pred, at, weight, _unpacked(bits())), _divergence(ps, gs), float(np.minimum(ps, gs).sum())]
        if extra:
            line += [judd_roc_area(pred, at), divergence(pred, gt, True), scanpath_saliency(pred, at, weight, True)]
        return line


def _unpacked(bits):
    """Boolean map from the bucketed bitmap."""
    out = np.zeros(WIDTH * HEIGHT, dtype=bool)
    for bucket, packed in dict(bits if bits is not None else {}).items():
        start = (int(bucket) - 1) * BUCKET_BITS
        flags = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little")
        stop = min(start + len(flags), len(out))
        out[start:stop] = flags[:stop - start]
    return out


def counts_per_pixel(human: DataFrame, predicted: DataFrame, keys, human_xy=("x", "y"), pred_xy=("px", "py")) -> DataFrame:
    """``keys + (pixel, human_n, pred_n)`` from long-form canvas fixations."""
    h = pixels(human, keys, *human_xy, True).select(*keys, "pixel", F.lit(1).alias("h"), F.lit(0).alias("p"))
    p = pixels(predicted, keys, *pred_xy, False).select(*keys, "pixel", F.lit(0).alias("h"), F.lit(1).alias("p"))
    return h.unionByName(p).groupBy(*keys, "pixel").agg(F.sum("h").alias("human_n"), F.sum("p").alias("pred_n"))


def saliency_scores(human: DataFrame, predicted: DataFrame, keys, subset=(), sigma=SIGMA,
                    human_xy=("x", "y"), pred_xy=("px", "py"), extra=False) -> DataFrame:
    """Six scores per key: cc, auc, nss, sauc, kld, sim.

    ``human`` and ``predicted`` are long form, unpadded, on the canvas.
    ``subset`` (columns among ``keys``) says what a shuffle map is built from.
    ``extra`` adds the second forms: auc_judd, kld2, nss2.
    """
    keys, subset = list(keys), list(subset)
    # at most one row per key and canvas pixel; written once, read twice
    counts = cut_lineage(counts_per_pixel(human, predicted, keys, human_xy, pred_xy))
    packed = spread(counts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pixel", "human_n", "pred_n"))).alias("_c"))
    packed = packed.select(*keys, F.col("_c.pixel").alias("pixel"), F.col("_c.human_n").alias("human_n"),
                           F.col("_c.pred_n").alias("pred_n"))
    bits = shuffle_bits(counts.filter(F.col("human_n") > 0), subset)
    if not subset:
        joined = packed.withColumn("shuffle_bits", bits.select("shuffle_bits").scalar())
    else:
        # subsets may be few and hold many keys: the map of a subset goes to each share of its keys
        shares = COPIES * int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = F.pmod(F.xxhash64(*keys), F.lit(shares)).alias("_share")
        copies = counts.select(*subset, share).distinct().join(bits, subset)
        joined = spread(packed.select("*", share), *subset, "_share").join(copies, [*subset, "_share"], "left").drop("_share")
    names = list(SCORES) + (["auc_judd", "kld2", "nss2"] if extra else [])
    schema = packed.select(*keys).schema
    for n in names:
        schema = schema.add(n, "double")

    def score(batches):
        scorer = Scorer(sigma)
        for batch in batches:
            flat = {c: (batch.column(c).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(c).offsets.to_numpy()).cumsum())
                    for c in ("pixel", "human_n", "pred_n")}
            parts = {c: np.split(values, ends[:-1]) for c, (values, ends) in flat.items()}
            subsets = list(zip(*(batch.column(c).to_pylist() for c in subset))) if subset else [()] * batch.num_rows
            lines = [scorer.scores(*(parts[c][i].astype(np.int64) for c in ("pixel", "human_n", "pred_n")), subsets[i],
                                   batch.column("shuffle_bits")[i].as_py, extra) for i in range(batch.num_rows)]
            scores = np.array(lines, dtype=np.float64).reshape(len(lines), len(names))
            # Arrow out, as NaN from pandas would become null
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(scores[:, i]) for i in range(len(names))],
                                             names=[*keys, *names])

    return joined.mapInArrow(score, schema)
