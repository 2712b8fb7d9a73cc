import heapq
import itertools

import numpy as np
import pytest

from gazelake.functions import kernels as K
from gazelake.operators.packing import best_fit

rng = np.random.default_rng(7)


def plain_alignment(a, b, sim, gap, edge):
    f = np.zeros((len(a) + 1, len(b) + 1))
    f[:, 0] = gap * (np.arange(len(a) + 1) + edge)
    f[0, :] = gap * (np.arange(len(b) + 1) + edge)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        f[i, j] = max(f[i - 1, j - 1] + sim(a[i - 1], b[j - 1]), f[i - 1, j] + gap, f[i, j - 1] + gap)
    return f[-1, -1], f.max()


@pytest.mark.parametrize("gap,edge", [(0.0, 1), (-0.7, 1), (-1.0, 0)])
def test_batched_alignment_equals_plain(gap, edge):
    table = K.grid_similarity(16, 12, 3.5)
    a = [rng.integers(0, 192, n) for n in (0, 1, 5, 12, 30, 3, 0)]
    b = [rng.integers(0, 192, n) for n in (4, 1, 7, 9, 2, 41, 0)]
    last, best = K.align_scores(a, b, lambda u, v: table[u, v], gap, edge)
    for i in range(len(a)):
        end, top = plain_alignment(a[i], b[i], lambda u, v: table[u, v], gap, edge)
        assert last[i] == pytest.approx(end) and best[i] == pytest.approx(top)


def test_grid_similarity_is_the_shifted_distance():
    table = K.grid_similarity(16, 12, 3.5)
    assert table.max() == 3.5 and table[0, 17] == pytest.approx(3.5 - 2 ** 0.5)
    assert table[0, 191] == pytest.approx(3.5 - np.hypot(15, 11))


def test_lcs_and_edit_distance_against_plain():
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 15)).tolist() for _ in range(2))
        lcs, _ = plain_alignment(a, b, lambda u, v: float(u == v), 0.0, 0)
        assert K.lcs_length(a, b) == lcs
        assert K.edit_distance(a, b, 2) == len(a) + len(b) - 2 * lcs
    assert K.edit_distance("kitten", "sitting") == 3
    long = ["w%d" % i for i in range(5000)]
    assert K.lcs_length(long, [w for i, w in enumerate(long) if i % 5]) == 4000


def test_alignment_pairs_keep_both_sequences_and_the_score():
    table = K.grid_similarity(16, 12, 3.5)
    for _ in range(50):
        a, b = (rng.integers(0, 192, rng.integers(0, 9)).tolist() for _ in range(2))
        pairs = K.alignment_pairs(a, b, table, 0.0)
        assert [u for u, _ in pairs if u >= 0] == a and [v for _, v in pairs if v >= 0] == b
        matched = sum(table[u, v] for u, v in pairs if u >= 0 and v >= 0)
        assert matched == pytest.approx(plain_alignment(a, b, lambda u, v: table[u, v], 0.0, 1)[0])


def shortest(weights):
    n, m = weights.shape
    done, queue = set(), [(0.0, 0, 0)]
    while queue:
        d, i, j = heapq.heappop(queue)
        if (i, j) == (n - 1, m - 1):
            return d
        if (i, j) in done:
            continue
        done.add((i, j))
        for u, v in ((i, j + 1), (i + 1, j), (i + 1, j + 1)):
            if u < n and v < m:
                heapq.heappush(queue, (d + weights[u, v], u, v))


def test_cheapest_path_costs_what_dijkstra_finds():
    for n, m in [(1, 1), (1, 5), (4, 1), (6, 9), (11, 8)]:
        w = rng.random((20, n, m))
        si, sj = K.cheapest_paths(w)
        for r in range(len(w)):
            steps = [(i, j) for i, j in zip(si[r], sj[r]) if i >= 0][::-1]
            assert steps[0] == (0, 0) and steps[-1] == (n - 1, m - 1)
            assert sum(w[r][s] for s in steps[1:]) == pytest.approx(shortest(w[r]))


def test_equal_costs_prefer_the_diagonal():
    si, sj = K.cheapest_paths(np.zeros((1, 3, 3)))
    assert [(i, j) for i, j in zip(si[0], sj[0]) if i >= 0] == [(2, 2), (1, 1), (0, 0)]


def path(n):
    return rng.random(n) * 500, rng.random(n) * 380, rng.random(n) * 400 + 50


def test_multimatch_of_a_path_with_itself_is_one():
    p = [path(n) for n in (3, 7, 12)]
    assert np.allclose(K.multimatch_scores(p, p, 512, 384), 1.0)
    assert np.isnan(K.multimatch_scores([path(2)], [path(5)], 512, 384)).all()


def test_multimatch_durations():
    x, y, t = path(5)
    zero = np.zeros(5)
    one = K.multimatch_scores([(x, y, zero)], [(x, y, t)], 512, 384)[0]
    both = K.multimatch_scores([(x, y, zero)], [(x, y, zero)], 512, 384)[0]
    assert one[4] == 0 and np.isnan(both[4]) and np.allclose(both[:4], 1)


def test_multimatch_does_not_depend_on_the_batch():
    a, b = [path(n) for n in (3, 9, 9, 4, 12)], [path(n) for n in (5, 7, 7, 4, 3)]
    together = K.multimatch_scores(a, b, 512, 384)
    for i in range(len(a)):
        assert np.allclose(together[i], K.multimatch_scores(a[i:i + 1], b[i:i + 1], 512, 384)[0])


def test_simplification_merges_short_and_straight_saccades():
    straight = K.SaccadeList([0, 10], [0, 0], [10, 10], [0, 0], [1, 1, 1])
    out = K.simplify(straight, 0.0, 45.0, 300.0)
    assert out.dx == [20.0] and out.dy == [0.0] and out.t == [1.0, 1.0]
    kept = K.simplify(straight, 0.0, 45.0, 0.5)
    assert kept.dx == [10.0, 10.0]
    assert K.simplify(K.SaccadeList([0], [0], [5], [0], [1, 1]), 100, 45, 300).dx == [5.0]
    short = K.simplify(K.SaccadeList([0, 50], [0, 0], [50, 0], [0, 3], [900, 900, 10]), 5.0, 0.0, 300.0)
    assert short.dx == [50.0] and short.dy == [3.0]


def test_time_delay_against_plain():
    for _ in range(20):
        h, s = path(rng.integers(1, 8))[:2], path(rng.integers(1, 8))[:2]
        n, m = len(h[0]), len(s[0])

        def plain(k):
            best = []
            for u in range(m - k + 1):
                best.append(min(sum(np.hypot(s[0][u + o] - h[0][v + o], s[1][u + o] - h[1][v + o]) for o in range(k)) / k
                                for v in range(n - k + 1)))
            return best

        for k in (1, 3):
            got = K.time_delay([h], [s], k)[0], K.time_delay([h], [s], k, "hausdorff")[0]
            if min(n, m) < k:
                assert np.isnan(got).all()
            else:
                assert got == pytest.approx((np.mean(plain(k)), max(plain(k))))
        scaled = np.mean([np.exp(-np.mean(plain(k)) / 512) for k in range(1, min(n, m) + 1)])
        assert K.scaled_time_delay([h], [s], 512.0)[0] == pytest.approx(scaled)


def test_best_fit_packs_lose_nothing():
    for _ in range(30):
        tokens = rng.integers(1, 5000, rng.integers(1, 60))
        bins = best_fit(tokens, 4096)
        for b in range(bins.max() + 1):
            inside = tokens[bins == b]
            assert len(inside) >= 1 and (inside.sum() <= 4096 or len(inside) == 1)


def test_word_bags():
    assert K.clipped_matches("a b a b c", ["a b x", "b a b"], 3) == [3, 2, 1]
    assert K.clipped_matches("", ["a"], 2) == [0, 0]
    assert K.count_differences(["a", "a", "b", "z"], [["a", "b", "b"], []]) == [[1, 1, 0], [1, 0, 0]]
