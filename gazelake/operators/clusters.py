"""Mean-shift clusters of fixations per key, spread over tasks.

Fixations are floored to whole raw pixels and counted, so a key has at most
width x height weighted points however many trials it has; a weighted flat kernel
gives the same means as the repeated points. The points of a key lie in the lines of
its pixel grid, with running sums along each line. What is within reach of a place is
one run of points a line, found by two binary searches, so a step costs the lines
within reach and not the points. The starting points of a key are dealt to units of
work, at most ``UNITS`` a key, and each unit fits all bandwidth factors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import comparisons as C
from ..functions import geometry as G
from ..session import cut_lineage, spread
from . import sequences

# fixed values: bandwidth factors tried, neighbour share; defaults: stopping rule
FACTORS = (0.2, 0.5, 0.8, 1.0, 1.2, 1.5, 1.8)
NEIGHBOUR_SHARE = 0.3
STOP_SHARE = 1e-3
MAX_ITERATIONS = 300
# starting points of one unit of work, and units of a key at most
CHUNK = 1024
UNITS = 64
# points up to which all of them are compared, and cells (starting point x line or point) in memory at once
FEW = 4096
CELLS = 1 << 20
# ends of one Arrow batch
FLUSH_ENDS = 100_000
# distances are found to this part of the canvas
RESOLUTION = 1e-12
# digits that tell two ends of a search apart
DIGITS = 9


def weighted_points(trials: DataFrame, keys) -> DataFrame:
    """``keys + (cx, cy, weight)``: distinct whole pixels on the canvas.

    ``trials`` has raw ``x, y, width, height``.
    """
    exploded = trials.select(*keys, "width", "height", F.explode(
        F.arrays_zip(F.col("x").alias("x"), F.col("y").alias("y"))).alias("p"))
    px = F.floor("p.x") / F.col("width") * F.lit(float(G.CANVAS_WIDTH))
    py = F.floor("p.y") / F.col("height") * F.lit(float(G.CANVAS_HEIGHT))
    return exploded.groupBy(*keys, px.alias("cx"), py.alias("cy")).agg(F.count("*").alias("weight"))


def _packed(points: DataFrame, keys) -> DataFrame:
    """One row per key and unit of starting points, with all points of the key in line order."""
    rows = F.array_sort(F.collect_list(F.struct("cy", "cx", "weight")))
    packed = points.groupBy(*keys).agg(rows.alias("_p")).select(
        *keys, F.col("_p.cx").alias("cx"), F.col("_p.cy").alias("cy"), F.col("_p.weight").alias("weight"))
    units = F.least(F.ceil(F.size("cx") / F.lit(CHUNK)), F.lit(UNITS)).cast("int")
    return packed.withColumn("units", units).select("*", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("chunk"))


class Field:
    """Weighted points in the lines of a pixel grid: sums of what lies within a distance of any place.

    ``cx, cy`` come in line order: ascending ``cy``, then ``cx``.
    """

    def __init__(self, cx, cy, weight) -> None:
        self.cx, self.cy, self.weight = cx, cy, weight
        self.lines, self.first = np.unique(cy, return_index=True)
        self.span = float(cx.max() - cx.min()) + 2.0
        self.left = float(cx.min()) - 1.0
        line = np.searchsorted(self.lines, cy)
        self.place = line * self.span + (cx - self.left)
        self.ends = np.append(self.first, len(cx))
        self.mass, self.moment = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weight, weight * cx))
        self.sums = np.column_stack([weight, weight * cx, weight * cy])

    def _runs(self, x, y, line, reach):
        """First point and the one behind the last within reach, for each (place, line)."""
        above = self.lines[line] - y
        half = np.sqrt(np.maximum(reach ** 2 - above ** 2, 0.0))
        low, high = self.ends[line], self.ends[line + 1]

        def near(i, inside):
            at = np.where(inside, i, low)
            return inside & ((self.cx[at] - x) ** 2 + above ** 2 <= reach ** 2)

        def found(edge):
            edge = np.clip(edge - self.left, 0.0, self.span - 0.5)
            return np.searchsorted(self.place, line * self.span + edge)

        # rounding may put a border off by one point: look at the points themselves
        start, stop = np.clip(found(x - half), low, high), np.clip(found(x + half), low, high)
        start = start + ((start < high) & ~near(start, start < high) & (start < stop))
        start = start - near(start - 1, start > low)
        stop = stop + near(stop, stop < high)
        return start, np.maximum(start, stop)

    def within(self, x, y, reach):
        """Mass and first moments of the points within ``reach`` (one, or one a place) of each place."""
        reach = np.broadcast_to(np.asarray(reach, dtype=np.float64), x.shape)
        if len(self.cx) <= FEW:
            return self._compared(x, y, reach)
        low, high = np.searchsorted(self.lines, y - reach), np.searchsorted(self.lines, y + reach, side="right")
        counts = high - low
        out = np.zeros((3, len(x)))
        blocks = np.searchsorted(np.cumsum(counts), np.arange(CELLS, counts.sum() + CELLS, CELLS))
        for a, b in zip(np.r_[0, blocks[:-1] + 1], blocks + 1):
            n = counts[a:b]
            if not n.sum():
                continue
            who = np.repeat(np.arange(a, min(b, len(x))), n)
            line = np.arange(len(who)) - np.repeat(np.cumsum(n) - n - low[a:b], n)
            start, stop = self._runs(x[who], y[who], line, reach[who])
            mass = self.mass[stop] - self.mass[start]
            for k, value in enumerate((mass, self.moment[stop] - self.moment[start], mass * self.lines[line])):
                out[k] += np.bincount(who, value, len(x))
        return out

    def _compared(self, x, y, reach):
        out = np.zeros((3, len(x)))
        step = max(1, CELLS // len(self.cx))
        for a in range(0, len(x), step):
            part = slice(a, a + step)
            far, above = x[part, None] - self.cx, y[part, None] - self.cy
            far *= far
            above *= above
            far += above
            out[:, part] = ((far <= reach[part, None] ** 2).astype(float) @ self.sums).T
        return out

    def kth_distances(self, seeds, k):
        """Distance of each starting point to its k-th neighbour, repeats counted: halved until it is known."""
        x, y = self.cx[seeds], self.cy[seeds]
        low, high = np.full(len(x), -1.0), np.full(len(x), np.hypot(np.ptp(self.cx), np.ptp(self.cy)) + 1.0)
        if len(self.cx) <= FEW:
            return self._sorted_distances(x, y, k)
        for _ in range(int(np.ceil(np.log2(1 / RESOLUTION)))):
            middle = (low + high) / 2
            enough = self.within(x, y, np.maximum(middle, 0.0))[0] >= k
            high, low = np.where(enough, middle, high), np.where(enough, low, middle)
        return np.maximum(high, 0.0)

    def _sorted_distances(self, x, y, k):
        out, step = np.zeros(len(x)), max(1, CELLS // len(self.cx))
        for a in range(0, len(x), step):
            d = np.hypot(x[a:a + step, None] - self.cx, y[a:a + step, None] - self.cy)
            order = np.argsort(d, axis=1)
            at = (np.cumsum(self.weight[order], axis=1) >= k).argmax(axis=1)
            out[a:a + step] = d[np.arange(len(d)), order[np.arange(len(d)), at]]
        return out


def shift_means(field: Field, seeds, bandwidth, stop_share=STOP_SHARE, most=MAX_ITERATIONS):
    """Where each starting point ends: (x, y, points within reach)."""
    mx, my = field.cx[seeds].astype(float), field.cy[seeds].astype(float)
    within = np.zeros(len(mx))
    active = np.arange(len(mx))
    for _ in range(most + 1):
        mass, sx, sy = field.within(mx[active], my[active], bandwidth)
        within[active] = mass
        hit = mass > 0
        active, mass = active[hit], mass[hit]
        nx, ny = sx[hit] / mass, sy[hit] / mass
        moved = np.hypot(nx - mx[active], ny - my[active])
        mx[active], my[active] = nx, ny
        active = active[moved > stop_share * bandwidth]
        if not len(active):
            break
    return np.round(mx, DIGITS), np.round(my, DIGITS), within


def separate_centers(cx, cy, within, bandwidth):
    """Indices of the strongest centres that are further apart than the bandwidth."""
    order = np.lexsort((cy, cx, within))[::-1]
    x, y = cx[order], cy[order]
    alive = np.ones(len(order), dtype=bool)
    kept = []
    for i in range(len(order)):
        if alive[i]:
            kept.append(order[i])
            alive &= (x - x[i]) ** 2 + (y - y[i]) ** 2 > bandwidth ** 2
    return np.asarray(kept, dtype=np.int64)


def bandwidths(points: DataFrame, keys) -> DataFrame:
    """Mean distance to the neighbour that is 30 % of the points away, per key."""
    keys = list(keys)
    packed = spread(_packed(points, keys), *keys, "chunk")
    schema = packed.select(*keys).schema.add("_sum", "double").add("_n", "double")

    def partial(batches):
        for batch in batches:
            sums, sizes = [], []
            for x, y, w, units, chunk in zip(*(batch[c] for c in _UNIT)):
                x, y, w = (np.asarray(v, dtype=np.float64) for v in (x, y, w))
                k = max(1, int(w.sum() * NEIGHBOUR_SHARE))
                seeds = slice(chunk, None, units)
                sums.append(float(Field(x, y, w).kth_distances(seeds, k) @ w[seeds]))
                sizes.append(float(w[seeds].sum()))
            yield batch[keys].assign(_sum=sums, _n=sizes)

    parts = packed.mapInPandas(partial, schema)
    return parts.groupBy(*keys).agg((F.sum("_sum") / F.sum("_n")).alias("bandwidth"))


_UNIT = ("cx", "cy", "weight", "units", "chunk")


def mean_shift(points: DataFrame, bandwidth: DataFrame, keys, factors=FACTORS, stop_share=STOP_SHARE,
               most=MAX_ITERATIONS) -> DataFrame:
    """``keys + (factor, cluster_id, cx, cy, within)`` for every bandwidth factor.

    A search ends when it moves by at most ``stop_share`` of the bandwidth, or after
    ``most`` steps. With bandwidth 0 no point reaches another, and each distinct point
    is a cluster. Clusters are numbered by the fixations within reach, then position.
    """
    keys = list(keys)
    units = spread(_packed(points, keys).join(bandwidth, keys), *keys, "chunk")
    named = units.select(*keys).schema.add("factor", "double")
    ends = T.StructType([*named.fields]).add("bandwidth", "double")
    for name in _END:
        ends = ends.add(name, T.ArrayType(T.DoubleType()))

    def shift(batches):
        for batch in batches:
            rows, reached = [], []
            for i, (bandwidth, units, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bandwidth", "units", "chunk")))):
                x, y, w = (np.asarray(batch.column(c)[i].values, dtype=np.float64) for c in ("cx", "cy", "weight"))
                field, seeds = Field(x, y, w), slice(chunk, None, units)
                for factor in factors:
                    reach = bandwidth * factor
                    mx, my, within = shift_means(field, seeds, reach, stop_share, most) if reach > 0 else (x[seeds], y[seeds], w[seeds])
                    some = np.flatnonzero(within > 0)
                    _, first = np.unique(mx[some] + 1j * my[some], return_index=True)
                    some = some[first]
                    rows.append((i, float(factor), bandwidth))
                    reached.append((mx[some], my[some], within[some]))
                if i + 1 == batch.num_rows or sum(len(x) for x, _, _ in reached) >= FLUSH_ENDS:
                    at, factor, width = zip(*rows)
                    offsets = pa.array(np.cumsum([0, *(len(x) for x, _, _ in reached)]).astype(np.int32))
                    yield _with_keys(batch, keys, at, ends, [
                        pa.array(factor), pa.array(width), *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v))) for v in zip(*reached))])
                    rows, reached = [], []

    # no more ends than distinct pixels of the key; an end that several units reached counts once, with the most within reach
    grouped = units.mapInArrow(shift, ends).groupBy(*keys, "factor").agg(
        F.first("bandwidth").alias("bandwidth"), F.collect_list(F.struct(*_END)).alias("_e")).select(
        *keys, "factor", "bandwidth", *[F.flatten(f"_e.{c}").alias(c) for c in _END])
    result = T.StructType([*named.fields]).add("cluster_id", "integer")
    for name in _END:
        result = result.add(name, "double")

    def separate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            chosen = []
            for i, (factor, bandwidth) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("factor", "bandwidth")))):
                found = [np.asarray(batch.column(c)[i].values, dtype=np.float64) for c in _END]
                kept = separate_centers(*found, float(bandwidth * factor))
                chosen.append((np.full(len(kept), i), np.arange(len(kept), dtype=np.int32), *(v[kept] for v in found)))
            at, *columns = map(np.concatenate, zip(*chosen))
            yield _with_keys(batch, [*keys, "factor"], at, result, [pa.array(v) for v in columns])

    return grouped.mapInArrow(separate, result)


#: An end: its place and the fixations within reach.
_END = ("cx", "cy", "within")


def _with_keys(batch, keys, at, schema, columns) -> pa.RecordBatch:
    """``columns`` behind the keys of the rows ``at``."""
    at = pa.array(np.asarray(at, dtype=np.int64))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns], names=schema.fieldNames())


def fit_clusters(trials: DataFrame, keys=("image", "target_id"), factors=FACTORS, order="trial",
                 subject="username") -> tuple[DataFrame, DataFrame]:
    """Clusters of every key and the symbol string of every subject.

    All factors are fitted; per key the first one with the best transition rate
    is kept. Returns ``(centers, strings)``.
    """
    keys = list(keys)
    points = cut_lineage(weighted_points(trials, keys))
    candidates = cut_lineage(mean_shift(points, bandwidths(points, keys), keys, factors))
    paths = trials.withColumns({
        "_X": G.rescale(G.floored("x"), "width", G.CANVAS_WIDTH),
        "_Y": G.rescale(G.floored("y"), "height", G.CANVAS_HEIGHT)})
    rates = factor_rates(paths, candidates, keys)
    # first maximum: the smallest of the best factors, as factors ascend
    best = rates.groupBy(*keys).agg(F.max_by("factor", F.struct("rate", -F.col("factor"))).alias("factor"))
    centers = cut_lineage(candidates.join(best, [*keys, "factor"]).select(*keys, "cluster_id", "cx", "cy"))
    symbolized = sequences.symbolize(paths, centers, keys, "_X", "_Y")
    return centers, sequences.subject_strings(symbolized, order, keys, subject)


def factor_rates(paths: DataFrame, candidates: DataFrame, keys) -> DataFrame:
    """Transition rate of every key and factor; paths are ``_X, _Y`` on the canvas."""
    keys = list(keys)
    fits = sequences.packed_centers(candidates, [*keys, "factor"])
    symbols = C.nearest_clusters("_X", "_Y", "_ids", "_cx", "_cy")
    per_trial = paths.select(*keys, "_X", "_Y").join(fits, keys).select(
        *keys, "factor", F.size("_ids").alias("clusters"), symbols.alias("s"))
    net = G.symbol_changes("s") - G.symbol_repeats("s")
    return per_trial.groupBy(*keys, "factor", "clusters").agg(F.sum(net).alias("net")).select(
        *keys, "factor", (F.col("net") / F.col("clusters")).alias("rate"))


def test_and_train(test: DataFrame, train: DataFrame, columns, order="trial") -> DataFrame:
    """Test and train trials in one table, ordered test first in ``trial``."""
    def part(df, source):
        return df.select(*columns, F.struct(F.lit(source).alias("source"), F.col(order).alias("no")).alias("trial"))

    return part(test, 0).unionByName(part(train, 1))
