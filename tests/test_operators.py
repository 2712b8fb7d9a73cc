import json
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from gazelake.functions import comparisons as C, geometry as G
from gazelake.operators import clusters, packing, prepare, rewards as R, saliency as L, scanpath, sequences, text_scores as T, validation
from gazelake import schemas
from gazelake.plans import evaluation, testviews as V
from gazelake.sources import readers
from conftest import SF

rng = np.random.default_rng(3)


# --- order and skew ----------------------------------------------------------

def hot_rows(spark, n=3000):
    """One group holds a third of all rows."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("g"))


def test_positions_by_bucket_equal_a_plain_window(spark):
    df = hot_rows(spark)
    plain = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1)
    cut = prepare.position_in_group(df, "g", "id", bucket=F.floor(F.col("id") / 100))
    assert cut.select("id", "g", "pos").exceptAll(plain.select("id", "g", "pos")).count() == 0 and cut.count() == 3000


@pytest.mark.parametrize("rate", [0.0, 0.013, 0.5, 1.0])
def test_exact_sample_size(spark, rate):
    got = prepare.exact_sample(hot_rows(spark), "id", rate=rate, seed=4)
    ids = [r["id"] for r in got.collect()]
    assert len(ids) == int(3000 * rate) == len(set(ids))


def test_exact_sample_of_a_tiny_table(spark):
    assert prepare.exact_sample(spark.range(3), "id", size=2).count() == 2


def test_row_numbers_are_dense_and_ordered(spark):
    df = hot_rows(spark).repartition(7)
    rows = prepare.row_numbers(df, "g", "id").orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == list(range(3000))
    assert [(r["g"], r["id"]) for r in rows] == sorted((r["g"], r["id"]) for r in rows)


def test_shuffle_is_repeatable(spark):
    ids = [[r["id"] for r in prepare.shuffled(spark.range(50).repartition(n), "id", seed=1).collect()] for n in (1, 5)]
    assert ids[0] == ids[1] and ids[0] != sorted(ids[0])
    copies = prepare.repeat_sample(spark.range(5), "id", times=3).collect()
    assert [r["copy_no"] for r in copies] == [1, 2, 3] * 5


def test_missing_target_text_raises(spark):
    trials = spark.sql("SELECT 'txt_A' AS target_id")
    texts = spark.sql("SELECT 'B' AS target_key, 'b' AS target")
    with pytest.raises(Exception, match="no text"):
        prepare.attach_targets(trials, texts).collect()


# --- paths -------------------------------------------------------------------

def test_path_scores_of_identical_paths(spark):
    df = V.canvas_pairs(spark, SF).withColumns({"px": F.col("x"), "py": F.col("y"), "pt": F.col("t")})
    row = scanpath.score_trials(df).agg(*[F.min(c).alias(c) for c in (
        "sm_wo_d", "sm_w_d", "stde", "mm_vector", "mm_duration")], F.max("sed").alias("sed")).collect()[0]
    assert row["sed"] == 0 and all(row[c] == pytest.approx(1) for c in row.asDict() if c != "sed")


def test_size_per_row_equals_the_constant_size(spark):
    df = V.canvas_pairs(spark, SF).select("img_usr_tgt", "gen_no", "x", "y", "t", "px", "py", "pt")
    by_row = df.withColumns({"w": F.when(F.col("gen_no") % 2 == 0, 512).otherwise(640), "h": F.when(F.col("gen_no") % 2 == 0, 384).otherwise(480)})
    names = ["sm_wo_d", "sm_w_d", "sed", "stde", *[f"mm_{f}" for f in C.MULTIMATCH_FIELDS]]
    rows = scanpath.score_trials(by_row, "w", "h").select("img_usr_tgt", "gen_no", *names).toPandas()
    for parity, size in ((0, (512, 384)), (1, (640, 480))):
        fixed = scanpath.score_trials(df, *size).filter(F.col("gen_no") % 2 == parity).select("img_usr_tgt", "gen_no", *names).toPandas()
        mine = rows[rows["gen_no"] % 2 == parity]
        both = fixed.merge(mine, on=["img_usr_tgt", "gen_no"])
        assert len(both) == len(fixed)
        for n in names:
            assert np.allclose(both[n + "_x"], both[n + "_y"], equal_nan=True)


def test_key_without_predicted_points_is_nan(spark):
    h = spark.sql("SELECT 'a' AS k, 5D AS x, 5D AS y")
    p = spark.sql("SELECT 'a' AS k, 5D AS px, 5D AS py").limit(0)
    row = L.saliency_scores(h, p, ["k"]).collect()[0]
    assert math.isnan(row["cc"]) and math.isnan(row["auc"]) and math.isnan(row["kld"])


def test_empty_timed_sequences(spark):
    df = spark.sql("SELECT cast(array() as array<int>) AS a, cast(array() as array<int>) AS b, array(1) AS c")
    row = df.select(C.sequence_alignment("a", "b"), C.sequence_alignment("a", "c"), C.match_ratio("a", "b"), C.match_ratio("a", "c")).collect()[0]
    assert math.isnan(row[0]) and row[1] == 0 and math.isnan(row[2]) and row[3] == 0


def test_custom_table_and_sql_names(spark):
    df = spark.sql("SELECT array(0, 1) AS a, array(1, 0) AS b")
    table = np.array([[0.0, 2.0], [2.0, 0.0]])
    assert df.select(C.sequence_alignment("a", "b", table=table)).collect()[0][0] == pytest.approx(1.0)
    C.register(spark)
    row = spark.sql("SELECT scanmatch(array(1, 2), array(1, 2)), nw_score(array(1, 2), array(2)), lcs_len(array('a', 'b'), array('b')), "
                    "stde(array(1D), array(1D), array(1D), array(1D), 512D), multimatch(array(1D,2D,9D), array(1D,5D,2D), array(1D,1D,1D), "
                    "array(1D,2D,9D), array(1D,5D,2D), array(1D,1D,1D), 512D, 384D).vector").collect()[0]
    assert list(row) == [1.0, 0.5, 1, 1.0, 1.0]


def test_regions_and_rare_symbols(spark):
    mask = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (1, 0, 7), (1, 1, 9)], "y int, x int, symbol int")
    merged = {(r["y"], r["x"]): (r["symbol"], r["symbol_no"]) for r in scanpath.merge_rare_symbols(mask, 1, 0).collect()}
    assert merged == {(0, 0): (5, 1), (0, 1): (5, 1), (1, 0): (0, 0), (1, 1): (0, 0)}
    fx = spark.createDataFrame([("a", 0, 1, 1), ("a", 1, 0, 0)], "img_usr_tgt string, pos int, x int, y int")
    assert scanpath.custom_regions(fx, mask).collect()[0]["symbols"] == [9, 5]


def test_last_trial_of_a_subject_wins_and_empty_string_scores_zero(spark):
    s = spark.createDataFrame([("i", "t", "u", 1, [1]), ("i", "t", "u", 3, [3]), ("i", "t", "u", 2, [2])],
                              "image string, target_id string, username string, trial int, symbols array<int>")
    assert sequences.subject_strings(s, "trial").collect()[0]["symbols"] == [3]
    pair = spark.sql("SELECT 'i' AS image, 't' AS target_id, 'u' AS username, array(1D) AS px, array(1D) AS py, array(0D) AS pt, array(1D) AS t")
    centers = spark.sql("SELECT 'i' AS image, 't' AS target_id, 0 AS cluster_id, 1D AS cx, 1D AS cy")
    empty = spark.sql("SELECT 'i' AS image, 't' AS target_id, 'u' AS username, cast(array() as array<int>) AS symbols")
    row = sequences.sequence_score(pair, centers, empty).collect()[0]
    assert row["ss"] == 0 and row["ss_time"] == 0


def test_semantic_score_without_raster_is_nan(spark):
    pair = spark.sql("SELECT 'i' AS image, 1 AS id, array(1D) AS x, array(1D) AS y, array(60D) AS t, array(1D) AS px, array(1D) AS py, array(60D) AS pt")
    none = spark.sql("SELECT 'other' AS image, 0 AS y, array(1) AS categories")
    assert math.isnan(sequences.semantic_score(pair, none, ["id"]).collect()[0]["sss"])
    some = spark.sql("SELECT 'i' AS image, 0 AS y, array(1, 2) AS categories")
    assert sequences.semantic_score(pair, some, ["id"]).collect()[0]["sss"] == 1.0


# --- saliency ----------------------------------------------------------------

def test_blur_matches_direct_convolution():
    sigma, size = 2.0, 40
    k = L.blur_kernel(size, sigma)
    signal = rng.random(size)
    padded = np.pad(signal, 8, mode="symmetric")
    w = np.exp(-0.5 * (np.arange(-8, 9) / sigma) ** 2)
    assert np.allclose(k @ signal, np.convolve(padded, w / w.sum(), mode="valid"))


def brute_area(fixated, negatives):
    thr = np.arange(0, max(fixated.max(), negatives.max()), 0.01)[::-1]
    tp = [0.0] + [np.mean(fixated >= t) for t in thr] + [1.0]
    fp = [0.0] + [np.mean(negatives >= t) for t in thr] + [1.0]
    return np.trapezoid(tp, fp)


def test_roc_areas_against_brute_force():
    pred = rng.random((384, 512))
    pred.ravel()[:100] = np.arange(100) * 0.01
    pixel, count = np.array([3, 57, 99, 4000]), np.array([1, 2, 1, 3])
    values = pred.ravel()
    assert L.roc_area(pred, pixel, count) == pytest.approx(brute_area(np.repeat(values[pixel], count), values))
    shuffle = np.zeros(values.size, dtype=bool)
    shuffle[[3, 10, 20, 30, 5000]] = True
    m = ((pred - pred.min()) / (pred - pred.min()).max()).ravel()
    assert L.shuffled_roc_area(pred, pixel, count, shuffle) == pytest.approx(
        brute_area(np.repeat(m[pixel], count), m[[10, 20, 30, 5000]]))
    assert L.scanpath_saliency(pred, pixel, count) == pytest.approx(np.repeat((pred - pred.mean()).ravel()[pixel] / pred.std(), count).mean())
    assert 0 <= L.judd_roc_area(pred, pixel) <= 1


def test_map_scores():
    g = rng.random((384, 512))
    assert L.correlation(g, g) == pytest.approx(1) and L.similarity(g, g) == pytest.approx(1)
    assert L.divergence(g, g) == pytest.approx(0, abs=1e-9) and L.divergence(g, g, True) == pytest.approx(0, abs=1e-6)
    assert L.correlation(np.ones((384, 512)), g) == 1
    assert np.isnan(L.blurred(np.array([], dtype=int), np.array([]), L.blur_kernel(384), L.blur_kernel(512))).all()


def test_saliency_query_equals_single_key_computation(spark):
    human = pd.DataFrame({"k": "a", "d": 1, "x": rng.random(40) * 512, "y": rng.random(40) * 384})
    pred = pd.DataFrame({"k": "a", "d": 1, "px": rng.random(30) * 512, "py": rng.random(30) * 384})
    other = pd.DataFrame({"k": "b", "d": 1, "x": rng.random(9) * 512, "y": rng.random(9) * 384})
    h = spark.createDataFrame(pd.concat([human, other]))
    p = spark.createDataFrame(pd.concat([pred, other.rename(columns={"x": "px", "y": "py"})]))
    with_subset = {r["k"]: r for r in L.saliency_scores(h, p, ["k", "d"], ["d"]).collect()}
    without = {r["k"]: r for r in L.saliency_scores(h, p, ["k"]).collect()}

    def address(x, y, shift):
        return np.trunc(y - shift).astype(int) % 384 * 512 + np.trunc(x - shift).astype(int) % 512

    ky, kx = L.blur_kernel(384), L.blur_kernel(512)
    hp, hn = np.unique(address(human.x, human.y, 1), return_counts=True)
    pp, pn = np.unique(address(pred.px, pred.py, 0), return_counts=True)
    gt, pr = L.blurred(hp, hn, ky, kx), L.blurred(pp, pn, ky, kx)
    shuffle = np.zeros(384 * 512, dtype=bool)
    shuffle[np.concatenate([hp, address(other.x, other.y, 1)])] = True
    expected = {"cc": L.correlation(pr, gt), "auc": L.roc_area(pr, hp, hn), "sauc": L.shuffled_roc_area(pr, hp, hn, shuffle),
                "nss": L.scanpath_saliency(pr, hp, hn), "kld": L.divergence(pr, gt), "sim": L.similarity(pr, gt)}
    for name, value in expected.items():
        assert with_subset["a"][name] == pytest.approx(value) and without["a"][name] == pytest.approx(value)


# --- clusters ----------------------------------------------------------------

def naive_mean_shift(points, bandwidth):
    ends = {}
    for seed in points:
        mean = seed
        for _ in range(301):
            near = points[((points - mean) ** 2).sum(axis=1) <= bandwidth ** 2]
            if not len(near):
                break
            old, mean = mean, near.mean(axis=0)
            if np.linalg.norm(mean - old) <= 1e-3 * bandwidth:
                break
        if len(near):
            ends[tuple(np.round(mean, 9))] = len(near)
    ranked = sorted(ends.items(), key=lambda e: (e[1], e[0]), reverse=True)
    kept = []
    for center, _ in ranked:
        if all(np.hypot(center[0] - k[0], center[1] - k[1]) > bandwidth for k in kept):
            kept.append(center)
    return kept


def cluster_trials(spark):
    rows = []
    for t in range(12):
        spot = np.array([[100, 100], [600, 400], [300, 500]])[rng.integers(0, 3, 8)]
        xy = spot + rng.integers(-25, 25, (8, 2))
        rows.append(("im", "txt_a", f"u{t % 5}", t, 800.0, 600.0, xy[:, 0].astype(float).tolist(), xy[:, 1].astype(float).tolist()))
    return rows, spark.createDataFrame(rows, "image string, target_id string, username string, trial int, width double, height double, x array<double>, y array<double>")


def test_clusters_match_a_plain_mean_shift_and_ignore_chunks(spark, monkeypatch):
    rows, trials = cluster_trials(spark)
    pts = np.array([(x / 800 * 512, y / 600 * 384) for r in rows for x, y in zip(r[6], r[7])])
    d = np.sort(np.hypot(*(pts[:, None] - pts[None]).transpose(2, 0, 1)), axis=1)
    bandwidth = d[:, max(1, int(len(pts) * 0.3)) - 1].mean()
    keys = ["image", "target_id"]
    points = clusters.weighted_points(trials, keys)
    assert clusters.bandwidths(points, keys).collect()[0]["bandwidth"] == pytest.approx(bandwidth)
    for chunk in (1024, 10):
        monkeypatch.setattr(clusters, "CHUNK", chunk)
        found = clusters.mean_shift(points, clusters.bandwidths(points, keys), keys, (0.2, 0.5)).collect()
        for f in (0.2, 0.5):
            mine = [(r["cx"], r["cy"]) for r in sorted((r for r in found if r["factor"] == f), key=lambda r: r["cluster_id"])]
            assert np.allclose(mine, naive_mean_shift(pts, bandwidth * f), atol=1e-6)


@pytest.mark.parametrize("n, side", [(500, 40), (9000, 150)])
def test_sums_along_lines_are_sums_over_points(n, side, monkeypatch):
    """Any place and reach, also on points, and distances to the k-th neighbour, against all points."""
    raw = np.unique(np.random.default_rng(n).normal(side / 2, side / 5, (n, 2)).clip(0, side - 1).astype(int), axis=0)
    cx, cy = raw[:, 0] / side * 512, raw[:, 1] / side * 384
    order = np.lexsort((cx, cy))
    cx, cy, w = cx[order], cy[order], rng.integers(1, 4, len(raw)).astype(float)
    field = clusters.Field(cx, cy, w)
    places = [(rng.uniform(-20, 540, 200), rng.uniform(-20, 400, 200)), (cx[:200], cy[:200])]
    monkeypatch.setattr(clusters, "FEW", 0)
    monkeypatch.setattr(clusters, "CELLS", 5000)
    for x, y in places:
        for reach in (0.0, 512 / side, 3 * 384 / side, 77.7, 1000.0):
            near = (x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2 <= reach ** 2
            assert np.allclose(field.within(x, y, reach), (near @ np.column_stack([w, w * cx, w * cy])).T)
    k = int(w.sum() * 0.3)
    lines = field.kth_distances(slice(0, 100), k)
    monkeypatch.setattr(clusters, "FEW", 10 ** 9)
    assert np.allclose(lines, field.kth_distances(slice(0, 100), k), atol=1e-8)


def test_fitted_strings_follow_the_centres(spark):
    rows, trials = cluster_trials(spark)
    centers, strings = clusters.fit_clusters(trials)
    c = sorted(centers.collect(), key=lambda r: r["cluster_id"])
    for s in strings.collect():
        last = max((r for r in rows if r[2] == s["username"]), key=lambda r: r[3])
        xy = np.column_stack([np.array(last[6]) / 800 * 512, np.array(last[7]) / 600 * 384])
        nearest = [int(np.argmin([(k["cx"] - x) ** 2 + (k["cy"] - y) ** 2 for k in c])) for x, y in xy]
        assert s["symbols"] == nearest


def test_too_few_points_make_one_cluster_each(spark):
    trials = spark.sql("SELECT 'i' AS image, 't' AS target_id, 'u' AS username, 1 AS trial, 512D AS width, 384D AS height, array(5D, 90D) AS x, array(5D, 90D) AS y")
    centers, _ = clusters.fit_clusters(trials)
    assert sorted((r["cx"], r["cy"]) for r in centers.collect()) == [(5.0, 5.0), (90.0, 90.0)]


# --- captions ----------------------------------------------------------------

@pytest.fixture(scope="module")
def captions(spark):
    return spark.createDataFrame([
        (1, "a cat sat on the mat", ["a cat sat on a mat", "the cat sat"]), (2, "a dog ran", ["a dog ran"]), (3, "", ["some text here"]),
        (4, "### !!!", ["other words"])], "image_id int, hyp string, refs array<string>")


def test_rouge_by_hand(captions):
    got = {r["image_id"]: r["rouge_l"] for r in T.rouge_l(captions).collect()}
    p, r = 5 / 6, 5 / 6
    assert got[1] == pytest.approx(2.44 * p * r / (r + 1.44 * p)) and got[2] == 1.0 and got[3] == 0.0


def test_bleu_by_hand(captions):
    got = {r["image_id"]: r for r in T.bleu(captions).collect()}
    assert got[1]["bleu_1"] == pytest.approx(6 / 6) and got[1]["bleu_2"] == pytest.approx(math.sqrt(6 / 6 * 3 / 5))
    assert got[2]["bleu_3"] == pytest.approx(1.0) and got[3]["bleu_1"] == 0.0


def test_cider_r_edges(captions):
    got = {r["image_id"]: r["cider_r"] for r in T.cider_r(captions).collect()}
    assert got[3] == 0.0 and math.isnan(got[4]) and got[2] > 0
    rep = {r["image_id"]: r["repetition"] for r in T.repetition_penalty(captions).collect()}
    assert rep[2] == [1.0] and rep[1][0] == pytest.approx(0.5 ** (1 / 6))
    half = {r["image_id"]: r["repetition"] for r in T.repetition_penalty(captions, lambda d: F.exp(-d)).collect()}
    assert half[1][0] == pytest.approx(math.exp(-1 / 6))


def test_suite_and_pairing(spark, captions):
    wide = T.text_scores(captions)
    assert wide.count() == 4 and {"bleu_4", "rouge_l", "cider", "cider_r"} <= set(wide.columns)
    assert {r["metric"] for r in T.corpus_scores(captions).collect()} == {"bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge_l", "cider", "cider_r"}
    hyps = spark.createDataFrame([(1, "a"), (2, "b")], "image_id int, caption string")
    refs = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "image_id int, caption string")
    assert sorted(T.pair_captions(hyps, refs).collect()[0]["refs"]) == ["x", "y"]
    assert {(r["image_id"], r["side"]) for r in T.unpaired_captions(hyps, refs).collect()} == {(2, "hypothesis"), (3, "reference")}
    assert T.tokenized(captions).filter("image_id = 4").collect()[0]["hyp"] == "# # #"


def test_consensus_does_not_depend_on_blocks(spark):
    """A word in every caption, a caption far longer than a block, ids that repeat, empty and null captions."""
    rows = [(k % 7, f"the {k % 5} cat {'sat ' * (k % 3)}", [f"the cat {k % 4} sat", f"the {k}", ""][:1 + k % 3]) for k in range(60)]
    rows += [(90, "the " * 3000, ["the long " * 2000]), (91, None, ["the cat"]), (92, "the cat", [])]
    df = spark.createDataFrame(rows, "image_id int, hyp string, refs array<string>").repartition(3, "image_id")
    found = []
    for words in (400_000, 40):
        found.append(sorted((r["image_id"], r["hyp_bigrams"], r["hyp_empty"], r["bigrams"], [round(c, 9) for c in r["cosines"]])
                            for r in T.consensus(df, block_words=words).collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    # by hand: one image's 1-grams
    images = len(rows)
    grams = lambda text: Counter((text or "").split())
    df_of = Counter(g for _, _, refs in rows for g in set().union(*map(grams, refs)))
    value = lambda bag: {g: n * (math.log(images) - math.log(max(1, df_of[g]))) for g, n in bag.items()}
    h, r = value(grams(rows[4][1])), value(grams(rows[4][2][0]))
    norm = math.sqrt(sum(v * v for v in h.values())) * math.sqrt(sum(v * v for v in r.values()))
    want = sum(min(h.get(g, 0), v) * v for g, v in r.items()) / norm
    one = T.consensus(df, 1).filter("image_id = 4 and hyp_bigrams = 3").collect()
    assert any(c == pytest.approx(want) for row in one for c in row["cosines"])


# --- rewards -----------------------------------------------------------------

def test_advantages_of_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.5), ("b", 0.5), ("c", 0.7)], "prompt_id string, reward double")
    got = R.advantages(df).groupBy("prompt_id").agg(F.sum("advantage").alias("s"), F.max("advantage").alias("m")).collect()
    by = {r["prompt_id"]: r for r in got}
    assert by["a"]["s"] == pytest.approx(0, abs=1e-9) and by["a"]["m"] == pytest.approx(0.5 / (0.5 ** 0.5 + 1e-4))
    assert by["b"]["m"] == 0 and math.isnan(by["c"]["m"])


def test_rewards_of_odd_answers(spark):
    sol = "The scanpath is [100, 100] [200, 200] [300, 300]"
    df = spark.createDataFrame([
        ("p", 0, f"<think>a</think><answer>{sol}</answer>", sol, 512.0, 384.0), ("p", 1, "No Objects", sol, 512.0, 384.0),
        ("p", 2, "[ 100, 100 ] [200-200]", sol, 512.0, 384.0), ("p", 3, sol, "nothing", 512.0, 384.0)],
        "prompt_id string, gen_no int, content string, solution string, width double, height double")
    got = {r["gen_no"]: r for r in R.rewards(df, ("accuracy_scanpath", "format")).collect()}
    assert got[0]["accuracy_scanpath"] == pytest.approx(1, abs=1e-6) and got[0]["reward"] == pytest.approx(2, abs=1e-6)
    assert got[1]["reward"] == 0 and 0 < got[2]["accuracy_scanpath"] < 1 and got[2]["format"] == 0 and got[3]["accuracy_scanpath"] >= 0


def test_own_reward(spark):
    R.register_reward("length", lambda df, name: df.withColumn(name, F.length("content").cast("double")))
    df = spark.sql("SELECT 'abc' AS content, 'x' AS image_path")
    out = R.rewards(df, ("length",), {"length": 2.0})
    assert out.collect()[0]["reward"] == 6.0 and "image_path" not in out.columns
    R.REWARDS.pop("length")


# --- training sets -----------------------------------------------------------

def test_packs_keep_every_sample(spark):
    df = spark.range(700).select("id", (1 + F.col("id") * 7919 % 5000).cast("int").alias("num_tokens"))
    rows = packing.pack(df, "id").toPandas()
    assert sorted(rows["id"]) == list(range(700)) and rows.groupby("batch").size().tolist() == [256, 256, 188]
    for _, g in rows.groupby(["batch", "pack"]):
        assert g["num_tokens"].sum() <= 4096 or len(g) == 1
    again = packing.pack(df.repartition(5), "id").toPandas()
    assert again.sort_values("id")["pack"].tolist() == rows.sort_values("id")["pack"].tolist()


def test_merged_packs(spark):
    packed = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 3)], "batch int, pack int, id int")
    seqs = spark.createDataFrame([(2, [3], [30]), (1, [1, 2], [10, 20]), (3, [4], [40])], "id int, input_ids array<int>, labels array<int>")
    got = {r["pack"]: r for r in packing.merge_packs(packed, seqs, "id").collect()}
    assert got[0]["input_ids"] == [1, 2, 3] and got[0]["labels"] == [10, 20, 30] and got[0]["cumulative_lengths"] == [0, 2, 3]
    assert got[1]["cumulative_lengths"] == [0, 1]


def test_validation_reasons(spark):
    turn = "named_struct('from', '{}', 'value', '{}')"
    df = spark.sql(" UNION ALL ".join(
        f"SELECT {i} AS id, cast(array({im}) as array<string>) AS image, cast(array({vi}) as array<string>) AS video, array({', '.join(turn.format(*t) for t in turns)}) AS conversations"
        for i, im, vi, turns in [
            (1, "'a.png'", "", [("human", "<image> q"), ("gpt", "ok")]), (2, "'a.png'", "", [("human", "q"), ("gpt", "<image>")]),
            (3, "'gone.png'", "'v.mp4'", [("human", "<image><video>"), ("gpt", "ok")]), (4, "'a.png'", "'v.mp4'", [("human", "q"), ("gpt", "x")])]))
    listing = spark.createDataFrame([("a.png",), ("v.mp4",)], "path string")
    valid, bad, stats = validation.validate_media(df, listing, "id")
    assert [r["id"] for r in valid.collect()] == [1]
    reasons = {r["id"]: [p["type"] for p in r["validation_problems"]] for r in bad.collect()}
    assert reasons == {2: ["token_mismatch", "gpt_media_token"], 3: ["missing_files"], 4: ["token_mismatch"]}
    s = stats.collect()[0]
    assert (s["total_entries"], s["valid_entries"], s["mixed"], s["image_only"]) == (4, 1, 2, 2)


def test_report_means_keep_nan(spark):
    scores = spark.createDataFrame([("web", 1.0, float("nan")), ("desktop", 3.0, 2.0)], "ui_type string, sed double, sss double")
    got = {r["subset"]: r for r in evaluation.means(scores, {"sed_score": "sed", "sss_score": "sss"}, "ui_type").collect()}
    assert got["all"]["sed_score"] == 2.0 and math.isnan(got["all"]["sss_score"]) and got["desktop"]["sss_score"] == 2.0


def test_prediction_file_to_report(spark, tmp_path):
    def record(i, prediction):
        return {"img_usr_tgt": str(i), "image": "shots/im.png", "width": 1024.0, "height": 768.0, "username": f"u{i}", "target_id": "txt_a",
                "x": [100.0, 500.0, 900.0], "y": [100.0, 300.0, 700.0], "t": [0.1, 0.2, 0.3], "prediction": prediction}

    same = [[100, 100], [500, 300], [900, 700]]
    (tmp_path / "p.json").write_text(json.dumps([record(0, same), record(1, same + [[7]]), record(2, [[1, 2, 3]])]))
    records = readers.read_json_array(spark, str(tmp_path / "p.json"), schemas.PREDICTION)
    trials = evaluation.from_predictions(records)
    assert [r["px"] for r in trials.orderBy("img_usr_tgt").collect()] == [[100.0, 500.0, 900.0]] * 2 + [[512.0]]
    got = {r["metric"]: r["value"] for r in evaluation.long_report(evaluation.evaluate(trials)).collect()}
    assert set(evaluation.REPORTED) <= set(got) and got["sed_score"] == pytest.approx(1.0) and 0.6 < got["sm_score_wo_d"] < 1


def test_test_and_train_order(spark):
    a = spark.sql("SELECT 'k' AS image, 9 AS trial")
    b = spark.sql("SELECT 'k' AS image, 1 AS trial")
    both = clusters.test_and_train(a, b, ["image"])
    assert both.agg(F.max_by("trial", "trial")).collect()[0][0]["source"] == 1


def test_cells_far_off_the_screen_differ(spark):
    from gazelake.operators import scanpath
    df = spark.createDataFrame([([1.0] * 3, [1.0] * 3, [110.0] * 3, [3880.0] * 3), ([1e300, float("nan"), -5e9], [0.0] * 3, [1e300, 0.0, 7.0], [0.0] * 3)],
                               "x array<double>, y array<double>, px array<double>, py array<double>")
    assert [r["sed"] for r in scanpath.edit_distance(df).collect()] == [3, 1]


def test_answers_that_cannot_be_scored_get_0(spark):
    from gazelake.operators import rewards
    good = "<think>t</think><answer>[10, 20], [30, 40]</answer>"
    rows = [(good, good, 100, 100), (None, good, 100, 100), (good, None, 100, 100), (good, good, 0, 100), (good, good, None, 100),
            (good.replace("10", "9" * 30), good, 100, 100)]
    got = rewards.scanpath_reward(spark.createDataFrame(rows, "content string, solution string, width int, height int")).collect()
    assert got[0]["accuracy_scanpath"] > 0.99 and [r["accuracy_scanpath"] for r in got[1:5]] == [0.0] * 4
    assert 0 <= got[5]["accuracy_scanpath"] <= 1


def test_sequence_scores_of_nulls_are_null(spark):
    from gazelake.functions import comparisons as C
    df = spark.createDataFrame([(None, [1, 2]), ([1], None), ([1, 2], [1, 2])], "a array<int>, b array<int>")
    got = df.select(C.sequence_alignment("a", "b").alias("s"), C.match_ratio("a", "b").alias("m")).collect()
    assert [(r["s"], r["m"]) for r in got[:2]] == [(None, None)] * 2 and got[2]["m"] == 1.0


def test_trials_without_centres_or_string_stay(spark):
    trials = spark.sql("""SELECT image, 't' AS target_id, username, array(1D, 5D) AS px, array(1D, 5D) AS py, array(60D, 60D) AS pt, array(60D, 60D) AS t
                          FROM VALUES ('i', 'u'), ('new', 'u'), ('i', 'new') AS v(image, username)""")
    centers = spark.sql("SELECT 'i' AS image, 't' AS target_id, id AS cluster_id, 4D * id AS cx, 4D * id AS cy FROM range(2)")
    strings = spark.sql("SELECT 'i' AS image, 't' AS target_id, 'u' AS username, array(0, 1) AS symbols")
    # a subject can have a string, also an empty one, of a key that has no centres
    more = strings.unionAll(spark.sql("SELECT 'new', 't', 'u', cast(array() as array<int>)"))
    for known in (strings, more):
        got = sequences.sequence_score(trials, centers, known).collect()
        assert sorted((r["image"], r["username"], r["ss"], r["ss_time"]) for r in got if r["ss"] is not None) == [("i", "u", 1.0, 1.0)]
        assert {(r["image"], r["username"]) for r in got if r["ss"] is None and r["ss_time"] is None} == {("new", "u"), ("i", "new")}
        assert len(got) == 3
    symbols = sequences.symbolize(trials, centers, x="px", y="py")
    assert {(r["image"], r["username"]): r["symbols"] for r in symbols.collect()} == {
        ("i", "u"): [0, 1], ("new", "u"): None, ("i", "new"): [0, 1]}
    assert {r["image"]: r["rate"] for r in sequences.transition_rate(symbols, centers).collect()}["new"] is None


def test_image_without_type_is_an_error(spark):
    trials = spark.createDataFrame([("a", "i"), ("b", "new")], "img_usr_tgt string, image string")
    types = spark.createDataFrame([("i", "web")], "image string, ui_type string")
    assert [r["ui_type"] for r in prepare.attach_types(trials.filter("image = 'i'"), types).collect()] == ["web"]
    with pytest.raises(Exception, match="no type for image new"):
        prepare.attach_types(trials, types).collect()
    with pytest.raises(Exception, match="no type for image new"):
        prepare.keep_type(trials, types, "web").collect()


def test_report_averages_all_trials(spark):
    """A trial of a screen without history counts in the scores that need no clusters."""
    rows = [(f"{i}_u", i, "t", "u", 1280, 768, [100, 300 + 100 * k, 500], [100, 200, 300], [0.2, 0.2, 0.2], k,
             [100.0, 300.0 + 100 * k, 500.0 - 200 * k], [100.0, 200.0, 300.0]) for k, i in enumerate(("a", "b"))]
    schema = ("img_usr_tgt string, image string, target_id string, username string, width int, height int, x array<int>, y array<int>, "
              "t array<double>, trial long, px array<double>, py array<double>")
    trials = spark.createDataFrame(rows, schema)
    whole = evaluation.evaluate(trials).collect()[0]
    known = evaluation.evaluate(trials, history=trials.filter("image = 'a'")).collect()[0]
    assert known["sed_score"] == whole["sed_score"] and known["sm_score_wo_d"] == whole["sm_score_wo_d"]
    assert known["ss_score"] is not None


def test_keys_of_five_datasets(spark):
    row = {"split": "s", "question_id": 7, "image_id": "im.jpg", "name": "pic.png", "condition": "c", "task": "t", "image_name": "n.png", "target_id": "x"}
    names = ["AiR-D", "OSIE", "COCO-TP", "COCO-TA", "VISGUI"]
    df = spark.createDataFrame([{"dataset": d, **row} for d in names])
    got = {r["dataset"]: r["key"] for r in df.select("dataset", sequences.dataset_key().alias("key")).collect()}
    assert got == {"AiR-D": "s-7-im", "OSIE": "s-pic", "COCO-TP": "s-c-t-pic", "COCO-TA": "s-c-t-pic", "VISGUI": "n.png-x"}
    for other in ("MIT", None):
        with pytest.raises(Exception, match="no key pattern"):
            spark.createDataFrame([{"dataset": "OSIE", **row}, {**row, "dataset": other}]).select(sequences.dataset_key().alias("key")).collect()


def test_odd_coordinates_and_durations_do_not_end_the_job(spark):
    odd = [1e12, -1e12, float("nan"), float("inf"), -float("inf"), 1e300]
    df = spark.createDataFrame([("k", float(v), float(u)) for v in odd for u in odd], "key string, x double, y double")
    for human in (True, False):
        rows = L.heatmap(df, ["key"], human=human).collect()
        assert sum(r["n"] for r in rows) == 36 and all(0 <= r["x"] < 512 and 0 <= r["y"] < 384 for r in rows)
    path = spark.createDataFrame([([1, 2, 3, 4, 5], [100.0, float("nan"), float("inf"), -50.0, 60.0])], "s array<int>, t array<double>")
    for rounding, want in (("floor", [1, 1, 5]), ("half_even", [1, 1, 5])):
        assert path.select(G.repeat_by_duration("s", "t", rounding=rounding).alias("r")).first()["r"] == want
