"""Columns on scanpath arrays: scaling, padding, trimming, grid symbols."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: scoring canvas in pixels
CANVAS_WIDTH = 512
CANVAS_HEIGHT = 384
# fixed values: fixations a scored path has at least, and the filler
MIN_FIXATIONS = 3
FILLER = 1.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size_of(v) -> Column:
    """A size given as a number or as a column (name)."""
    return F.lit(v) if isinstance(v, (int, float)) else col(v)


def image_stem(path) -> Column:
    """``a/b/f4b47d.png`` -> ``f4b47d``."""
    return F.split(F.element_at(F.split(col(path), "/"), -1), r"\.")[0]


def target_key(target_id) -> Column:
    """Target id without its four-character prefix."""
    return F.substr(col(target_id), F.lit(5))


# fixed values: folder and suffix of stored screenshots
IMAGE_FOLDER = "vsgui10k-images"
IMAGE_SUFFIX = ".png"


def image_path(image, folder=IMAGE_FOLDER, suffix=IMAGE_SUFFIX) -> Column:
    return F.concat(F.lit(folder + "/"), col(image), F.lit(suffix))


def rescale(values, size, target) -> Column:
    """Scaled coordinates; null where the size is 0."""
    size, target = col(size), F.lit(float(target))
    return F.transform(col(values), lambda v: F.try_divide(v, size) * target)


def denormalize(values, mean, std) -> Column:
    """``v * std + mean``; the inverse of standardising a coordinate."""
    mean, std = (F.lit(float(v)) if isinstance(v, (int, float)) else col(v) for v in (mean, std))
    return F.transform(col(values), lambda v: v * std + mean)


def to_millis(seconds) -> Column:
    return F.transform(col(seconds), lambda s: s * F.lit(1000.0))


def floored(values) -> Column:
    return F.transform(col(values), lambda v: F.floor(v).cast("double"))


def padded(values, length=MIN_FIXATIONS, filler=FILLER) -> Column:
    """Append ``filler`` until the array has ``length`` entries."""
    values = col(values)
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(values))
    return F.concat(values, F.array_repeat(F.lit(float(filler)), missing))


def sentinel_length(xs, sentinel=-1.0) -> Column:
    """How many entries are not the sentinel."""
    return F.size(F.filter(col(xs), lambda v: v != F.lit(float(sentinel))))


def prefix(values, length) -> Column:
    length = F.lit(length) if isinstance(length, int) else col(length)
    return F.slice(col(values), F.lit(1), length)


def stop_length(stops) -> Column:
    """Length up to and including the first stop flag; all if none is set."""
    stops = col(stops)
    first = F.array_position(stops, F.lit(1).cast("int")).cast("int")
    return F.when(first > 0, first).otherwise(F.size(stops))


def clamped_cell(v, size) -> Column:
    """Screen coordinate as an integer inside [0, size - 1]."""
    size = size_of(size)
    v = F.greatest(v, F.lit(0.0))
    return F.when(v >= size, size - 1).otherwise(v).cast("int")


def pixel_index(v, size, human) -> Column:
    """Heatmap index of a coordinate.

    Human coordinates are one-based, predicted ones zero-based. The far edge is
    clamped, a negative index counts from the far edge, and NaN is 0.
    """
    shifted = (v - F.lit(1.0)) if human else v
    return F.pmod(F.least(whole(shifted), F.lit(size - 1)), F.lit(size)).cast("int")


def grid_symbols(xs, ys, xres=CANVAS_WIDTH, yres=CANVAS_HEIGHT, xbin=16, ybin=12, offset=(0, 0)) -> Column:
    """Cell number ``row * xbin + column`` of every fixation on an xbin x ybin grid.

    The size may be a column, so that every row has its own.
    """
    def cell(p):
        cx = F.floor(clamped_cell(p["x"] - F.lit(float(offset[0])), xres) * F.lit(xbin) / size_of(xres))
        cy = F.floor(clamped_cell(p["y"] - F.lit(float(offset[1])), yres) * F.lit(ybin) / size_of(yres))
        return (cy * F.lit(xbin) + cx).cast("int")

    return F.transform(F.arrays_zip(col(xs).alias("x"), col(ys).alias("y")), cell)


def whole(v) -> Column:
    """The integer part as a long; values no screen has stay at the bounds, NaN is 0."""
    return F.least(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(-4e15)), F.lit(4e15)).cast("bigint")


def open_cells(xs, ys, width=CANVAS_WIDTH, height=CANVAS_HEIGHT, n=5) -> Column:
    """Cell number of every fixation on an n x n grid that goes on beyond the screen.

    The cell size is the integer part of size / n, and nothing is clamped: a
    point beyond the last full column takes the first cell of the next row.
    """
    step_x, step_y = (F.floor(size_of(v) / F.lit(n)) for v in (width, height))
    return F.transform(F.arrays_zip(col(xs).alias("x"), col(ys).alias("y")), lambda p: (
        F.floor(whole(p["x"]) / step_x) + F.floor(whole(p["y"]) / step_y) * F.lit(n)))


def _letter(code) -> Column:
    """The character of a code point; ``chr`` alone would repeat after 256 of them."""
    return F.when(code < 250, F.chr(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def grid_letters(xs, ys, width=CANVAS_WIDTH, height=CANVAS_HEIGHT, n=5) -> Column:
    """One letter per fixation on an open n x n grid, as a string, from ``a`` for cell 0.

    Cells beyond all characters share the last one; compare cells by ``common_letters``.
    """
    def letter(cell):
        code = F.greatest(F.lit(97) + cell, F.lit(1))
        # code points of half characters are skipped
        return _letter(F.least(F.when(code >= 0xD800, code + 0x800).otherwise(code), F.lit(0x10FFFF)))

    return F.array_join(F.transform(open_cells(xs, ys, width, height, n), letter), "")


def common_letters(a, b) -> tuple[Column, Column]:
    """Two cell arrays as strings in which the same cell has the same letter, whatever its number."""
    # a list of one: inside the lambda the cells are a value, which is not worked out again for every letter
    known = F.array(F.array_distinct(F.concat(a, b)))

    def letters(cells):
        return F.get(F.transform(known, lambda k: F.array_join(
            F.transform(cells, lambda c: _letter(F.array_position(k, c) + F.lit(96))), "")), F.lit(0))

    return letters(a), letters(b)


def repeat_by_duration(symbols, durations, bin_ms=50, rounding="half_even") -> Column:
    """Repeat each symbol once per time bin.

    ``half_even`` rounds the whole milliseconds (grid alignment), ``floor``
    drops the rest (cluster and category sequences). A duration that is not finite has no bin.
    """
    def copies(z):
        finite = F.nanvl(z["t"] * F.lit(0.0), F.lit(1.0)) == 0
        t = F.when(finite, F.greatest(z["t"], F.lit(0.0))).otherwise(F.lit(0.0))
        n = F.bround(whole(t) / F.lit(float(bin_ms))) if rounding == "half_even" else whole(t / F.lit(float(bin_ms)))
        return F.array_repeat(z["s"], F.least(n, F.lit(2_000_000_000)).cast("int"))

    shared = F.least(F.size(col(symbols)), F.size(col(durations)))
    zipped = F.arrays_zip(F.slice(col(symbols), F.lit(1), shared).alias("s"),
                          F.slice(col(durations), F.lit(1), shared).alias("t"))
    return F.flatten(F.transform(zipped, copies))


def target_center(df_x="target_x", df_w="target_width", anchor="corner") -> Column:
    """Centre of the target box; ``anchor`` says what the stored point is."""
    if anchor == "center":
        return F.floor(col(df_x))
    return F.floor(col(df_x) + col(df_w) / 2)


def saccades(xs, ys) -> Column:
    """Start, displacement, length and angle between consecutive fixations."""
    pts = F.arrays_zip(col(xs).alias("x"), col(ys).alias("y"))
    n = F.size(col(xs))
    head = F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0)))

    def saccade(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), dx.alias("dx"), dy.alias("dy"),
                        F.sqrt(dx * dx + dy * dy).alias("length"), F.atan2(dy, dx).alias("theta"))

    return F.zip_with(head, tail, saccade)


def turn_angles(saccade_array) -> Column:
    """Degrees between consecutive saccades; NaN where one has no length."""
    s = col(saccade_array)
    m = F.greatest(F.size(s) - 1, F.lit(0))

    def angle(a, b):
        dot = a["dx"] * b["dx"] + a["dy"] * b["dy"]
        cosine = dot / (a["length"] * b["length"])
        return F.when((a["length"] == 0) | (b["length"] == 0), F.lit(float("nan"))).otherwise(
            F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))))

    return F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), angle)


def windows_of(values, k) -> Column:
    """All runs of k consecutive entries; none when the array is shorter."""
    values = col(values)
    n = F.size(values)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - F.lit(k - 1)), lambda i: F.slice(values, i, F.lit(k)))
                  ).otherwise(F.slice(F.array(values), F.lit(1), F.lit(0)))


def point_distance_sum(xs, ys, pxs, pys) -> Column:
    """Sum of point distances of two paths of one length, null otherwise."""
    a = F.arrays_zip(col(xs).alias("x"), col(ys).alias("y"))
    b = F.arrays_zip(col(pxs).alias("x"), col(pys).alias("y"))
    dist = F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)))
    return F.when(F.size(a) == F.size(b), F.aggregate(dist, F.lit(0.0), lambda acc, v: acc + v))


def symbol_changes(symbols) -> Column:
    """How many neighbours differ."""
    s = col(symbols)
    m = F.greatest(F.size(s) - 1, F.lit(0))
    same = F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: a == b)
    return F.size(F.filter(same, lambda v: ~v))


def symbol_repeats(symbols) -> Column:
    """How many neighbours are equal."""
    s = col(symbols)
    m = F.greatest(F.size(s) - 1, F.lit(0))
    same = F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: a == b)
    return F.size(F.filter(same, lambda v: v))

