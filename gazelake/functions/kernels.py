"""NumPy kernels for the alignment family, vectorised over the rows of a batch.

Each takes whole Arrow batches: sequences are ordered by length and padded in
blocks, or stacked by equal shape, so the Python loop runs over positions and
not over rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

# cells of one block; bounds the memory of a batched kernel
BLOCK_CELLS = 2_000_000


def _lengths(seqs):
    return np.fromiter((len(s) for s in seqs), dtype=np.int64, count=len(seqs))


def _padded(seqs, lens, fill, dtype):
    out = np.full((len(seqs), max(int(lens.max(initial=0)), 1)), fill, dtype=dtype)
    mask = np.arange(out.shape[1]) < lens[:, None]
    if mask.any():
        out[mask] = np.concatenate([np.asarray(s, dtype=dtype) for s in seqs if len(s)])
    return out


def length_blocks(na, nb):
    """Row blocks of similar length whose padded matrices stay small."""
    order = np.lexsort((nb, na))
    start = 0
    while start < len(order):
        stop = start + 1
        width = int(na[order[start]] + nb[order[start]]) + 2
        while stop < len(order):
            width = max(width, int(na[order[stop]] + nb[order[stop]]) + 2)
            if (stop + 1 - start) * width > BLOCK_CELLS // 8:
                break
            stop += 1
        yield order[start:stop]
        start = stop


def align_scores(a_seqs, b_seqs, similarity, gap=0.0, edge=0):
    """Global alignment of every pair: (last cell, best cell) of the score matrix.

    ``similarity(a_column, b_matrix)`` scores symbols; ``edge`` shifts the gap
    count of the first row and column. Only two matrix rows are kept.
    """
    na, nb = _lengths(a_seqs), _lengths(b_seqs)
    last, best = np.zeros(len(na)), np.zeros(len(na))
    for rows in length_blocks(na, nb):
        la, lb = na[rows], nb[rows]
        a = _padded([a_seqs[r] for r in rows], la, 0, np.int64)
        b = _padded([b_seqs[r] for r in rows], lb, 0, np.int64)
        cols = np.arange(b.shape[1] + 1)
        valid = cols <= lb[:, None]
        each = np.arange(len(rows))
        prev = np.tile(gap * (cols + edge), (len(rows), 1)).astype(np.float64)
        top = np.where(valid, prev, -np.inf).max(axis=1)
        end = prev[each, lb]
        for i in range(1, int(la.max(initial=0)) + 1):
            cur = np.empty_like(prev)
            cur[:, 0] = gap * (i + edge)
            np.maximum(prev[:, :-1] + similarity(a[:, i - 1:i], b), prev[:, 1:] + gap, out=cur[:, 1:])
            # a gap run along the row is a running maximum
            if gap == 0.0:
                np.maximum.accumulate(cur, axis=1, out=cur)
            else:
                ramp = gap * cols
                cur = np.maximum.accumulate(cur - ramp, axis=1) + ramp
            live = i <= la
            top = np.where(live, np.maximum(top, np.where(valid, cur, -np.inf).max(axis=1)), top)
            end = np.where(i == la, cur[each, lb], end)
            prev = cur
        last[rows], best[rows] = end, top
    return last, best


def grid_similarity(xbin, ybin, threshold):
    """Threshold minus the distance of two grid cells, as a lookup table."""
    cell = np.arange(xbin * ybin)
    cx, cy = cell % xbin, cell // xbin
    # the plain root: ties between paths are decided by its last digit
    return threshold - np.sqrt((cx[:, None] - cx) ** 2 + (cy[:, None] - cy) ** 2)


def alignment_pairs(a, b, table, gap):
    """Best alignment of one pair as (a symbol, b symbol), -1 where there is a gap.

    Going back from the end, a match is preferred, then a symbol of ``a`` alone.
    """
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1))
    score[:, 0] = gap * (np.arange(n + 1) + 1)
    score[0, :] = gap * (np.arange(m + 1) + 1)
    sub = table[np.asarray(a, dtype=np.int64)[:, None], np.asarray(b, dtype=np.int64)] if n and m else np.zeros((n, m))
    for i in range(n):
        for j in range(m):
            score[i + 1, j + 1] = max(score[i, j] + sub[i, j], score[i + 1, j] + gap, score[i, j + 1] + gap)
    out = []
    i, j = n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + sub[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((int(a[i]), int(b[j])))
        elif i and (not j or score[i, j] == score[i - 1, j] + gap):
            i -= 1
            out.append((int(a[i]), -1))
        else:
            j -= 1
            out.append((-1, int(b[j])))
    return out[::-1]


def alignment_steps(a_seqs, b_seqs, table, gap):
    """``alignment_pairs`` of every pair, vectorised over the pairs: steps of each, then both symbols of all steps."""
    na, nb = _lengths(a_seqs), _lengths(b_seqs)
    sizes, done = np.zeros(len(na), dtype=np.int64), []
    for block in length_blocks(na, nb):
        most = (int(na[block].max()) + 1) * (int(nb[block].max()) + 1)
        for rows in np.array_split(block, -(-len(block) * most // BLOCK_CELLS)):
            if len(rows):
                at, first, second = _steps_back([a_seqs[r] for r in rows], [b_seqs[r] for r in rows], table, gap)
                sizes[rows] = np.bincount(at, minlength=len(rows))
                done.append((rows[at], first, second))
    if not done:
        return sizes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, first, second = map(np.concatenate, zip(*done))
    order = np.argsort(row, kind="stable")
    return sizes, first[order], second[order]


def _steps_back(a_seqs, b_seqs, table, gap):
    """Row, a symbol and b symbol of every step, in the order of rows and steps."""
    la, lb = _lengths(a_seqs), _lengths(b_seqs)
    a, b = _padded(a_seqs, la, 0, np.int64), _padded(b_seqs, lb, 0, np.int64)
    (rows, n), m = a.shape, b.shape[1]
    score = np.zeros((rows, n + 1, m + 1))
    score[:, :, 0] = gap * (np.arange(n + 1) + 1)
    score[:, 0, :] = gap * (np.arange(m + 1) + 1)
    sub = table[a[:, :, None], b[:, None, :]]
    # cells of a diagonal do not need each other, and get the sums of the plain recursion to the last digit
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        score[:, i + 1, j + 1] = np.maximum(np.maximum(score[:, i, j] + sub[:, i, j], score[:, i + 1, j] + gap), score[:, i, j + 1] + gap)
    steps, each = [], np.arange(rows)
    i, j = la.copy(), lb.copy()
    while True:
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here, in_a, in_b = score[each, i, j], i > 0, j > 0
        both = in_a & in_b & (here == score[each, up, left] + sub[each, up, left])
        only_a = live & ~both & in_a & (~in_b | (here == score[each, up, j] + gap))
        only_b = live & ~both & ~only_a
        who = np.flatnonzero(live)
        steps.append((who, np.where(only_b, -1, a[each, up])[who], np.where(only_a, -1, b[each, left])[who]))
        i, j = i - (both | only_a), j - (both | only_b)
    if not steps:
        return (np.zeros(0, np.int64),) * 3
    who, first, second = (np.concatenate(c) for c in zip(*steps[::-1]))
    order = np.argsort(who, kind="stable")
    return who[order], first[order], second[order]


def lcs_length(a, b):
    """Longest common subsequence, one machine word per 64 symbols of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    where = {}
    for j, symbol in enumerate(b):
        where[symbol] = where.get(symbol, 0) | (1 << j)
    full = (1 << len(b)) - 1
    free = full
    for symbol in a:
        hit = free & where.get(symbol, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return len(b) - free.bit_count()


def edit_distance(a, b, substitution=1):
    """Edit distance with unit insertions and a chosen substitution cost."""
    row = np.arange(len(b) + 1)
    codes = np.asarray([ord(c) for c in b]) if isinstance(b, str) else np.asarray(b)
    ramp = np.arange(len(b) + 1)
    for i, symbol in enumerate(a, 1):
        symbol = ord(symbol) if isinstance(symbol, str) else symbol
        cur = np.empty_like(row)
        cur[0] = i
        cur[1:] = np.minimum(row[:-1] + substitution * (codes != symbol), row[1:] + 1)
        row = np.minimum.accumulate(cur - ramp) + ramp
    return int(row[-1])


def edit_distances(a_texts, b_texts, substitution=1):
    """``edit_distance`` of every pair of strings or integer arrays, vectorised over the pairs."""
    def codes(text):
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") if isinstance(text, str) else text

    na, nb = _lengths(a_texts), _lengths(b_texts)
    out = np.zeros(len(na), dtype=np.int64)
    for rows in length_blocks(na, nb):
        la, lb = na[rows], nb[rows]
        a, b = (_padded([codes(texts[r]) for r in rows], lens, 0, np.int64) for texts, lens in ((a_texts, la), (b_texts, lb)))
        ramp, each = np.arange(b.shape[1] + 1), np.arange(len(rows))
        row = np.tile(ramp, (len(rows), 1))
        end = row[each, lb]
        for i in range(1, int(la.max(initial=0)) + 1):
            cur = np.empty_like(row)
            cur[:, 0] = i
            np.minimum(row[:, :-1] + substitution * (a[:, i - 1:i] != b), row[:, 1:] + 1, out=cur[:, 1:])
            row = np.minimum.accumulate(cur - ramp, axis=1) + ramp
            end = np.where(i == la, row[each, lb], end)
        out[rows] = end
    return out


def nearest_ids(x, y, ids, cx, cy):
    """Id of the centre closest to each point."""
    dx, dy = np.subtract.outer(x, cx), np.subtract.outer(y, cy)
    return np.asarray(ids)[(dx * dx + dy * dy).argmin(axis=1)] if len(x) else np.empty(0, dtype=np.int32)


def shape_groups(na, nb):
    """Row indices of every (length a, length b) shape in the batch."""
    order = np.lexsort((nb, na))
    if not len(order):
        return
    cuts = np.flatnonzero((np.diff(na[order]) != 0) | (np.diff(nb[order]) != 0)) + 1
    for rows in np.split(order, cuts):
        n, m = int(na[rows[0]]), int(nb[rows[0]])
        step = max(1, BLOCK_CELLS // max(1, n * m))
        for start in range(0, len(rows), step):
            yield n, m, rows[start:start + step]


def _stack(values, rows, dtype=np.float64):
    return np.stack([np.asarray(values[r], dtype=dtype) for r in rows])


# --- vector comparison -------------------------------------------------------

def cheapest_paths(weights):
    """Row and column of each step of the cheapest corner-to-corner path.

    Steps go right, down or diagonally and cost the entered cell. Equal costs
    prefer diagonal, then down, then right. Returns two (rows, steps) arrays
    padded with -1.
    """
    b, n, m = weights.shape
    cost = np.full((b, n + 1, m + 1), np.inf)
    cost[:, 1, 1] = 0.0
    move = np.zeros((b, n, m), dtype=np.int8)
    for d in range(1, n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        options = np.stack([cost[:, i, j], cost[:, i, j + 1], cost[:, i + 1, j]])
        move[:, i, j] = options.argmin(axis=0)
        cost[:, i + 1, j + 1] = weights[:, i, j] + options.min(axis=0)
    steps_i = np.full((b, n + m - 1), -1)
    steps_j = np.full((b, n + m - 1), -1)
    each = np.arange(b)
    i, j = np.full(b, n - 1), np.full(b, m - 1)
    for s in range(n + m - 1):
        live = (i >= 0) & (j >= 0)
        if not live.any():
            break
        steps_i[live, s], steps_j[live, s] = i[live], j[live]
        step = move[each, np.maximum(i, 0), np.maximum(j, 0)]
        done = (i == 0) & (j == 0)
        i = np.where(done, -1, i - (step != 2))
        j = np.where(done, -1, j - (step != 1))
    return steps_i, steps_j


def _path_median(values, used):
    """Median over the used entries of each row; NaN when one of them is NaN."""
    count = used.sum(axis=1)
    each = np.arange(len(values))
    ranked = np.sort(np.where(used, values, np.inf), axis=1)
    middle = (ranked[each, (count - 1) // 2] + ranked[each, count // 2]) / 2
    return np.where((np.isnan(values) & used).any(axis=1), np.nan, middle)


def saccade_vectors(x, y, t):
    """Start, displacement, length, angle and durations in single precision."""
    x, y, t = (np.asarray(v, dtype=np.float32) for v in (x, y, t))
    dx, dy = np.diff(x, axis=-1), np.diff(y, axis=-1)
    return {"x": x[..., :-1], "y": y[..., :-1], "dx": dx, "dy": dy,
            "rho": np.sqrt(dx ** 2 + dy ** 2), "theta": np.arctan2(dy, dx), "t": t}


def compare_vectors(s1, s2, width, height):
    """Five similarities of stacked saccade lists of one shape.

    Shape, direction, length, position and duration, each the median along the
    cheapest path, scaled by 2 x diagonal, pi, diagonal, diagonal and 1.
    """
    def pair(name):
        return s1[name].astype(np.float64)[:, :, None], s2[name].astype(np.float64)[:, None, :]

    (ax, bx), (ay, by) = pair("dx"), pair("dy")
    shape = np.sqrt((ax - bx) ** 2 + (ay - by) ** 2)
    i, j = cheapest_paths(shape)
    used = i >= 0
    each = np.arange(len(i))[:, None]
    at1, at2 = (each, np.maximum(i, 0)), (each, np.maximum(j, 0))

    def along(name):
        return s1[name][at1], s2[name][at2]

    def circle(angle):
        return np.where(angle < 0, angle + np.float32(2 * np.pi), angle)

    th1, th2 = along("theta")
    turn = np.abs(circle(th1) - circle(th2)).astype(np.float64)
    turn = np.where(turn > np.pi, 2 * np.pi - turn, turn)
    r1, r2 = along("rho")
    (x1, x2), (y1, y2) = along("x"), along("y")
    t1, t2 = (v.astype(np.float64) for v in along("t"))
    with np.errstate(invalid="ignore", divide="ignore"):
        lag = np.abs(t1 - t2) / np.abs(np.maximum(t1, t2))
    position = np.sqrt((x1 - x2).astype(np.float64) ** 2 + (y1 - y2).astype(np.float64) ** 2)
    diagonal = np.hypot(width, height)  # one number, or one per row
    return np.stack([
        1 - _path_median(shape[each, at1[1], at2[1]], used) / (2 * diagonal),
        1 - _path_median(turn, used) / np.pi,
        1 - _path_median(np.abs(r1 - r2).astype(np.float64), used) / diagonal,
        1 - _path_median(position, used) / diagonal,
        1 - _path_median(lag, used),
    ], axis=1)


class SaccadeList:
    """One path during simplification: merged saccades and fixation durations."""

    def __init__(self, x, y, dx, dy, t):
        self.x, self.y, self.dx, self.dy, self.t = (list(map(float, v)) for v in (x, y, dx, dy, t))

    def merged(self, first_of_pair, close_last=None):
        """Join saccade i with i + 1 wherever the predicate holds, left to right."""
        out = SaccadeList([], [], [], [], [])
        n, i = len(self.dx), 0
        while i < n:
            if i + 1 < n and first_of_pair(i):
                out._add(self.x[i], self.y[i], self.dx[i] + self.dx[i + 1], self.dy[i] + self.dy[i + 1], self.t[i])
                i += 2
            elif i + 1 == n and out.dx and close_last is not None and close_last():
                # a short last saccade is folded into the one before it
                out.dx[-1], out.dy[-1] = self.dx[-2] + self.dx[-1], self.dy[-2] + self.dy[-1]
                out.t.append(self.t[i - 1])
                i += 1
            else:
                out._add(self.x[i], self.y[i], self.dx[i], self.dy[i], self.t[i])
                i += 1
        out.t.append(self.t[-1])
        return out

    def _add(self, x, y, dx, dy, t):
        for values, v in ((self.x, x), (self.y, y), (self.dx, dx), (self.dy, dy), (self.t, t)):
            values.append(v)

    def angle(self, i):
        u, v = np.array([self.dx[i], self.dy[i]]), np.array([self.dx[i + 1], self.dy[i + 1]])
        size = np.hypot(*u) * np.hypot(*v)
        return np.degrees(np.arccos(np.clip(u @ v / size, -1, 1))) if size else np.nan


def simplify(path, t_amp, t_dir, t_dur):
    """Merge saccades of similar direction, then short ones, until nothing changes.

    A path is passed over at most as often as it has fixations left.
    """
    passes = 0
    while True:
        before = len(path.dx)
        if before:
            path = path.merged(lambda i, p=path: p.angle(i) < t_dir and p.t[i + 1] < t_dur)
            path = path.merged(
                lambda i, p=path: np.hypot(p.dx[i], p.dy[i]) < t_amp and (p.t[i + 1] < t_dur or p.t[i] < t_dur),
                lambda p=path: np.hypot(p.dx[-1], p.dy[-1]) < t_amp and (p.t[-1] < t_dur or p.t[-2] < t_dur))
        passes += 1
        if len(path.dx) == before or passes >= len(path.t):
            return path


def _merged(p, pair, close_last=None):
    """``SaccadeList.merged`` of stacked paths: ``pair`` and ``close_last`` say for each row what the predicates say."""
    n, width = p["n"], p["dx"].shape[1]
    place, each = np.arange(width), np.arange(len(n))
    pair = pair & (place + 1 < n[:, None])
    starts, joined = np.zeros((len(n), width), dtype=bool), np.zeros((len(n), width), dtype=bool)
    taken = np.zeros(len(n), dtype=bool)
    for i in range(width):
        starts[:, i] = (i < n) & ~taken
        joined[:, i] = taken = starts[:, i] & pair[:, i]
    last = np.maximum(n - 1, 0)
    if close_last is None:
        folded = np.zeros(len(n), dtype=bool)
    else:
        folded = (n > 1) & starts[each, last] & close_last
    kept = starts.copy()
    kept[folded, last[folded]] = False
    to = kept.cumsum(axis=1) - 1
    row, at = np.nonzero(kept)
    out = {"n": kept.sum(axis=1)}
    for name in ("x", "y", "dx", "dy"):
        values = p[name]
        if name in ("dx", "dy"):
            values = np.where(joined, values + np.roll(values, -1, axis=1), values)
        out[name] = np.zeros_like(p[name])
        out[name][row, to[row, at]] = values[row, at]
        if name in ("dx", "dy"):
            who = np.flatnonzero(folded)
            out[name][who, out["n"][who] - 1] = p[name][who, n[who] - 2] + p[name][who, n[who] - 1]
    out["t"] = np.zeros_like(p["t"])
    out["t"][row, to[row, at]] = p["t"][row, at]
    who = np.flatnonzero(folded)
    out["t"][who, out["n"][who]] = p["t"][who, n[who] - 2]
    end = out["n"] + folded
    out["t"][each, end] = p["t"][each, p["nt"] - 1]
    out["nt"] = end + 1
    return out


def simplified_paths(paths, t_amp, t_dir, t_dur):
    """``simplify`` of many ``(x, y, dx, dy, t)`` saccade lists, vectorised over the lists."""
    out = [None] * len(paths)
    sizes = _lengths([p[2] for p in paths])
    for block in length_blocks(sizes, _lengths([p[4] for p in paths])):
        rows, n = block, sizes[block]
        # a place is spared for the duration that a folded saccade leaves behind
        p = {"n": n, "nt": _lengths([paths[r][4] for r in rows])}
        for k, name in enumerate(("x", "y", "dx", "dy", "t")):
            values = [np.asarray(paths[r][k], dtype=np.float64) for r in rows]
            if name != "t":
                values = [v[:size] for v, size in zip(values, n)]
            p[name] = np.pad(_padded(values, _lengths(values), 0.0, np.float64), ((0, 0), (0, 2)))
        width = max(p[c].shape[1] for c in ("x", "t"))
        for name in ("x", "y", "dx", "dy", "t"):
            p[name] = np.pad(p[name], ((0, 0), (0, width - p[name].shape[1])))
        passes = 0
        while len(rows):
            before = p["n"]
            following = np.roll(p["t"], -1, axis=1)
            ndx, ndy = np.roll(p["dx"], -1, axis=1), np.roll(p["dy"], -1, axis=1)
            size = np.hypot(p["dx"], p["dy"]) * np.hypot(ndx, ndy)
            with np.errstate(invalid="ignore", divide="ignore"):
                angle = np.degrees(np.arccos(np.clip((p["dx"] * ndx + p["dy"] * ndy) / size, -1, 1)))
            q = _merged(p, (size != 0) & (angle < t_dir) & (following < t_dur))
            small, brief = np.hypot(q["dx"], q["dy"]) < t_amp, q["t"] < t_dur
            each, last = np.arange(len(rows)), np.maximum(q["n"] - 1, 0)
            close = small[each, last] & (brief[each, q["nt"] - 1] | brief[each, np.maximum(q["nt"] - 2, 0)])
            q = _merged(q, small & (np.roll(brief, -1, axis=1) | brief), close)
            # a path without saccades stays as it is
            q = {c: np.where(before > 0, v, p[c]) if v.ndim == 1 else np.where((before > 0)[:, None], v, p[c]) for c, v in q.items()}
            passes += 1
            ended = (q["n"] == before) | (passes >= q["nt"])
            for k in np.flatnonzero(ended).tolist():
                size, times = int(q["n"][k]), int(q["nt"][k])
                out[rows[k]] = tuple(q[c][k, :size] for c in ("x", "y", "dx", "dy")) + (q["t"][k, :times],)
            rows, p = rows[~ended], {c: v[~ended] for c, v in q.items()}
    return out


def multimatch_scores(first, second, width, height, thresholds=None):
    """Five similarities for lists of (x, y, t) paths; NaN below three fixations."""
    out = np.full((len(first), 5), np.nan)
    width, height = (np.broadcast_to(np.asarray(v, dtype=np.float64), len(first)) for v in (width, height))
    sides = []
    for paths in (first, second):
        side = []
        for x, y, t in paths:
            side.append(saccade_vectors(x, y, t))
        if thresholds is not None:
            long = [r for r, v in enumerate(side) if len(v["t"]) >= 3]
            merged = simplified_paths([tuple(side[r][c] for c in ("x", "y", "dx", "dy", "t")) for r in long], *thresholds)
            for r, (px, py, dx, dy, pt) in zip(long, merged):
                side[r] = {"x": px, "y": py, "dx": dx, "dy": dy, "rho": np.hypot(dx, dy), "theta": np.arctan2(dy, dx), "t": pt}
        sides.append(side)
    long_enough = np.array([len(a[0]) >= 3 and len(b[0]) >= 3 for a, b in zip(first, second)], dtype=bool)
    usable = np.flatnonzero(long_enough & np.array(
        [len(a["dx"]) > 0 and len(b["dx"]) > 0 for a, b in zip(*sides)], dtype=bool))
    na = _lengths([sides[0][r]["dx"] for r in usable])
    nb = _lengths([sides[1][r]["dx"] for r in usable])
    for n, m, rows in shape_groups(na, nb):
        rows = usable[rows]

        def stacked(side, size):
            return {k: np.stack([side[r][k][:size] for r in rows]) for k in ("x", "y", "dx", "dy", "rho", "theta", "t")}

        out[rows] = compare_vectors(stacked(sides[0], n), stacked(sides[1], m), width[rows], height[rows])
    return out


# --- time-delay embedding ----------------------------------------------------

def delay_distances(hx, hy, sx, sy, k_values, reduce_windows):
    """Window distances of stacked pairs: one column per window length.

    For each window of the simulated path the closest human window is taken;
    ``reduce_windows`` turns those distances into one number.
    """
    single = np.sqrt((sx[:, :, None] - hx[:, None, :]) ** 2 + (sy[:, :, None] - hy[:, None, :]) ** 2)
    total, out = single, []
    for k in range(1, max(k_values) + 1):
        if k > 1:
            total = total[:, :-1, :-1] + single[:, k - 1:, k - 1:]
        if k in k_values:
            out.append(reduce_windows(total.min(axis=2) / k))
    return np.stack(out, axis=1)


def time_delay(human, simulated, k, mode="mean"):
    """Distance for one window length; NaN when a path is shorter than it."""
    reduce_windows = {"mean": lambda d: d.mean(axis=1), "hausdorff": lambda d: d.max(axis=1)}[mode]
    out = np.full(len(human), np.nan)
    for n, m, rows in shape_groups(_lengths([p[0] for p in human]), _lengths([p[0] for p in simulated])):
        if min(n, m) >= k:
            stacks = [_stack([p[c] for p in side], rows) for side in (human, simulated) for c in (0, 1)]
            out[rows] = delay_distances(*stacks, {k}, reduce_windows)[:, 0]
    return out


def scaled_time_delay(human, simulated, scale, similarity=True):
    """Mean over all window lengths, coordinates divided by ``scale``."""
    out = np.full(len(human), np.nan)
    scale = np.broadcast_to(np.asarray(scale, dtype=np.float64), len(human))
    for n, m, rows in shape_groups(_lengths([p[0] for p in human]), _lengths([p[0] for p in simulated])):
        if min(n, m):
            stacks = [_stack([p[c] for p in side], rows) / scale[rows, None] for side in (human, simulated) for c in (0, 1)]
            d = delay_distances(*stacks, set(range(1, min(n, m) + 1)), lambda v: v.mean(axis=1))
            out[rows] = (np.exp(-d) if similarity else d).mean(axis=1)
    return out


# --- word bags ---------------------------------------------------------------

def ngram_bags(texts, k):
    """Count of every run of k words, one bag per text."""
    split = [t.split() for t in texts]
    return [Counter(zip(*(w[j:] for j in range(k)))) for w in split]


def clipped_matches(hyp, refs, n):
    """Per order: hypothesis n-grams that occur in a reference, at most as often."""
    out = []
    for k in range(1, n + 1):
        said, *true = ngram_bags([hyp, *refs], k)
        out.append(sum(min(c, max(t[g] for t in true)) for g, c in said.items()))
    return out


def count_differences(hyp, refs):
    """Per reference, for each distinct hypothesis word: the difference in counts.

    A word the reference lacks is compared with one occurrence.
    """
    said = Counter(hyp)
    out = []
    for ref in refs:
        true = Counter(ref)
        out.append([abs(true[w] - c) if w in true else c - 1 for w, c in said.items()])
    return out
