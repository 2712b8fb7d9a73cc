"""Steps that once grew faster than their input: what they cost, and that they give what the plain form gives."""

import json
import os
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gazelake.functions import comparisons as C, geometry as G, kernels, words as W
from gazelake.operators import clusters, ngram_blocks, saliency, sequences, text_scores
from gazelake.sources import json_records
from gazelake.streaming import live


def test_raster_is_not_sent_whole(spark):
    paths = spark.sql("SELECT 'i' AS image, 1 AS id, array(1D, 2D, 3D) AS x, array(1D, 2D, 3D) AS y, array(50D, 50D, 50D) AS t, "
                      "array(1D, 2D, 3D) AS px, array(1D, 2D, 3D) AS py, array(50D, 50D, 50D) AS pt")
    lines = spark.range(320).select(F.lit("i").alias("image"), F.col("id").cast("int").alias("y"), F.array_repeat(F.lit(7), 512).alias("categories"))
    scored = sequences.semantic_score(paths, lines, ["id"])
    assert scored.select("sss").first()[0] == 1.0
    # whatever size Spark takes it for
    assert "rightHint=(strategy=merge)" in scored._jdf.queryExecution().optimizedPlan().toString()


def test_saliency_shares_a_subset_among_tasks(spark):
    rows = spark.range(400).select(F.lit("all").alias("subset"), (F.col("id") % 100).alias("key"), (F.col("id") * 37 % 512).cast("double").alias("x"),
                                   (F.col("id") * 11 % 384).cast("double").alias("y"))
    found = saliency.saliency_scores(rows, rows.withColumnsRenamed({"x": "px", "y": "py"}), ["subset", "key"], ["subset"])
    tasks = [r[0] for r in found.select(F.spark_partition_id()).distinct().collect()]
    assert found.count() == 100
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions")) // 2


def test_saliency_scorer_is_the_plain_scores():
    rng, scorer = np.random.default_rng(3), saliency.Scorer()
    shuffle = rng.random(saliency.WIDTH * saliency.HEIGHT) < 0.05
    packed = np.packbits(shuffle, bitorder="little").tobytes()
    bits = lambda: {i + 1: packed[i * 4096:(i + 1) * 4096] for i in range(6)}
    for size in (1, 2, 40, 300, 3000):
        pixel = np.unique(np.concatenate([rng.integers(0, len(shuffle), size), rng.integers(0, 20_000, size)]))
        human, said = rng.integers(0, 3, len(pixel)), rng.integers(0, 3, len(pixel))
        if size == 1:
            said[:] = 0
        at, weight = pixel[human > 0], human[human > 0]
        maps = [saliency.blurred(pixel[n > 0], n[n > 0], scorer.rows, scorer.columns) for n in (said, human)]
        plain = saliency.Scorer.plain(*maps, at, weight, bits, True)
        np.testing.assert_allclose(scorer.scores(pixel, human, said, ("all",), bits, True), plain, rtol=1e-9, atol=1e-9)


def test_simplified_paths_are_the_plain_ones():
    rng, paths = np.random.default_rng(5), []
    for _ in range(300):
        n = rng.integers(3, 14)
        v = kernels.saccade_vectors(rng.integers(0, 8, n) * 40.0, rng.integers(0, 8, n) * 40.0, rng.integers(1, 6, n) * 100.0)
        paths.append(tuple(v[c] for c in ("x", "y", "dx", "dy", "t")))
    for limits in ((80.0, 45.0, 300.0), (200.0, 90.0, 400.0), (1e9, 0.0, 1e9), (0.0, 0.0, 0.0)):
        for path, found in zip(paths, kernels.simplified_paths(paths, *limits)):
            plain = kernels.simplify(kernels.SaccadeList(*path), *limits)
            assert [c.tolist() for c in found] == [plain.x, plain.y, plain.dx, plain.dy, plain.t]


def test_letters_do_not_look_up_their_cells_again(spark):
    df = spark.sql("SELECT array(1D, 200D, 500D) AS x, array(1D, 2D, 300D) AS y, array(500D, 1D) AS px, array(300D, 1D) AS py")
    a, b = G.common_letters(G.open_cells("x", "y"), G.open_cells("px", "py"))
    letters = df.select(a.alias("a"), b.alias("b"))
    assert tuple(letters.first()) == ("abc", "ca")
    # the list of known cells is a value inside the lambda, not an expression
    assert "array_position(array_distinct" not in letters._jdf.queryExecution().optimizedPlan().toString()


def test_edit_distances_are_the_plain_ones():
    rng = np.random.default_rng(7)
    for cost in (1, 2, 3):
        a, b = ([rng.integers(0, 4, rng.integers(0, 9)) for _ in range(200)] for _ in range(2))
        plain = [kernels.edit_distance(p, q, cost) for p, q in zip(a, b)]
        assert kernels.edit_distances(a, b, cost).tolist() == plain
        texts = [["".join(map("abc\u00e9".__getitem__, p)) for p in side] for side in (a, b)]
        assert kernels.edit_distances(*texts, cost).tolist() == plain


def test_edit_distance_of_cells_and_strings(spark):
    df = spark.sql("SELECT 'abc' AS a, 'axc' AS b, array(1, 2, 3) AS p, array(1, 9, 3) AS q, cast(null AS string) AS n")
    assert tuple(df.select(C.edit_distance("a", "b", 2), C.edit_distance("p", "q", 2), C.edit_distance("a", "n", 2)).first()) == (2, 2, None)


def test_alignment_steps_are_the_plain_ones():
    rng, table = np.random.default_rng(9), kernels.grid_similarity(16, 12, 3.5)
    for gap in (0.0, -0.7, 0.3):
        a, b = ([rng.integers(0, 5, rng.integers(0, 9)) for _ in range(200)] for _ in range(2))
        sizes, first, second = kernels.alignment_steps(a, b, table, gap)
        ends = np.cumsum(sizes)
        for p, q, start, stop in zip(a, b, ends - sizes, ends):
            assert list(zip(first[start:stop].tolist(), second[start:stop].tolist())) == kernels.alignment_pairs(p, q, table, gap)


def test_averages_write_one_state_a_batch():
    rows = pd.DataFrame({"log_no": [0, 1, 1, 2], "metric": ["a", "a", "b", "a"], "at": [5, 7, 9, 20], "value": [1.0, 2.0, None, 4.0]})
    calls, state = [], {}

    class Value:
        def get(self):
            return state.get("open")

        def update(self, value):
            calls.append("update")
            state["open"] = value

        def clear(self):
            calls.append("clear")
            state.pop("open", None)

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            calls.append(at)

    class Times:
        def __init__(self, now):
            self.now = now

        def getExpiryTimeInMs(self):
            return self.now

        def getCurrentWatermarkInMs(self):
            return self.now

    averages = live._Averages()
    averages.init(Handle())
    list(averages.handleInputRows((1, True, 0), iter([rows]), Times(0)))
    assert calls == [5, "update"]
    out = next(averages.handleExpiredTimer((1, True, 0), Times(10), Times(10)))
    assert [tuple(r)[1:3] + tuple(r)[4:] for r in out.itertuples(index=False)] == [(0, "a", 1), (1, "a", 1), (1, "b", 0)]
    assert calls == [5, "update", 20, "update"]
    list(averages.handleExpiredTimer((1, True, 0), Times(20), Times(20)))
    assert calls[-1] == "clear" and not state


def test_averages_of_many_runs_are_one_state():
    # each run had a state and a timer of its own, and each cost as much as hundreds of rows
    rows = pd.DataFrame({"run": ["1", "2", None, "2", "1"], "log_no": [0, 0, 0, 1, 0], "metric": ["a", "a", "a", "b", "a"],
                         "at": [5, 7, 6, 20, 6], "value": [1.0, 2.0, 4.0, None, 3.0]})
    calls, state = [], {}

    class Value:
        def get(self):
            return state.get("open")

        def update(self, value):
            calls.append("update")
            state["open"] = value

        def clear(self):
            state.pop("open", None)

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            calls.append(at)

    class Times:
        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: 10

    averages = live._Averages()
    averages.init(Handle())
    list(averages.handleInputRows((3, 0), iter([rows]), None))
    assert calls == [6, "update"]
    out = next(averages.handleExpiredTimer((3, 0), Times(), Times()))
    assert sorted(out.astype(object).itertuples(index=False, name=None), key=str) == [("1", 0, "a", 2.0, 2), ("2", 0, "a", 2.0, 1), (None, 0, "a", 4.0, 1)]
    assert calls[2:] == [20, "update"] and state["open"][:3] == (["2"], [1], [20])


def test_json_ranges_are_read_in_pieces(monkeypatch):
    texts = ['{"a": "' + '}{\\"' * (k % 4) + '", "b": {"c": ' + str(k) for k in range(50)]
    data = "".join(t + "}},\n" for t in texts) + '{"open": {"x": '
    values = data.split("}")

    def run(step, depth=0, string=0, values=values):
        batches = [pa.RecordBatch.from_pydict({"_file": ["f"] * len(values[k:k + step]), "_start": [0] * len(values[k:k + step]),
                                               **({} if depth is None else {"string": [string] * len(values[k:k + step]), "depth": [depth] * len(values[k:k + step])}),
                                               "value": values[k:k + step]}) for k in range(0, len(values), step)]
        rows = (json_records._counted if depth is None else json_records._cut)(iter(batches))
        return [tuple(r.values()) for b in rows for r in b.to_pylist()]

    monkeypatch.setattr(json_records, "PIECE", 64)
    pieces = [run(7), run(7, depth=1), run(7, depth=None)]
    assert max(len(d) for _, d in json_records._pieces(iter([pa.RecordBatch.from_pydict({"f": ["f"] * len(values), "value": values})]))) < 200
    monkeypatch.setattr(json_records, "PIECE", 1 << 20)
    assert pieces == [run(1000), run(1000, depth=1), run(1000, depth=None)]
    assert [json.loads(r[5])["b"]["c"] for r in pieces[0] if not r[4]] == list(range(50))
    assert pieces[0][-1][4:] == (True, '{"open": {"x": }')


def _plain_bags(text, k):
    return kernels.ngram_bags([text], k)[0]


def _captions():
    rng = np.random.default_rng(13)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "dd", "é"], rng.integers(0, 12)))
    return [[text() for _ in range(rng.integers(1, 4))] for _ in range(60)] + [["", ""], ["a"], ["", "a a\x1cb  a"], ["a a a", "a", "a a"]]


def test_blocks_count_like_plain_bags():
    for texts in (_captions(), [["", ""]], []):
        block = ngram_blocks.Block.of(texts)
        found = block.tallies(4)
        plain = {}
        for c, text in enumerate(t for image in texts for t in image):
            for k in range(4):
                plain |= {(c, k, gram): count for gram, count in _plain_bags(text, k + 1).items()}
        words = block.texts.to_pylist()
        grams = [tuple(words[w] for w in block.words[first:first + k + 1]) for first, k in zip(found.word, found.order)]
        assert {(c, found.order[p], grams[p]): n for c, p, n in zip(found.caption, found.place, found.count)} == plain
        assert len(set(grams)) == len(grams) and (np.sort(found.keys) == found.keys).all()


def test_keys_alike_in_their_high_bits_are_told_apart():
    key = np.array([5, 4, 5, 4, 9, 5], np.uint64)
    assert ngram_blocks._ranked(key).tolist() == [1, 3, 0, 2, 5, 4]


def test_matches_of_a_block_are_the_plain_ones(spark):
    # the blocks of a batch are counted at once, not a text and an order at a time
    texts = _captions()
    plain = [kernels.clipped_matches(h, refs, 4) if refs else [0] * 4 for h, *refs in texts]
    assert ngram_blocks.Block.of(texts).clipped(4).tolist() == plain
    rows = [(i, h, refs) for i, (h, *refs) in enumerate(texts)] + [(None, None, [None, "x"]), (-1, "x y", None)]
    got = text_scores.bleu_parts(spark.createDataFrame(rows, "image_id int, hyp string, refs array<string>")).collect()
    by_id = {r["image_id"]: r for r in got}
    assert [[by_id[i][f"correct_{k}"] for k in range(1, 5)] for i in range(len(texts))] == plain
    assert by_id[0]["hyp_len"] == len(texts[0][0].split())
    assert by_id[None]["hyp_len"] is None and by_id[-1]["hyp_len"] == 2 and by_id[-1]["ref_len"] is None


def test_document_frequency_sends_an_ngram_of_a_block_once(spark):
    # rows grow with the distinct n-grams of blocks, not with those of images
    rows = [(i, "", ["a b a b", "b é"]) for i in range(50)] + [(50, "only here", []), (51, "x", None), (52, "x", [None])]
    captions = spark.createDataFrame(rows, "image_id int, hyp string, refs array<string>").coalesce(1)
    found = text_scores.document_frequency(captions, 2)
    assert {(r["n"], r["gram"]): r["df"] for r in found.collect()} == {
        (1, "a"): 50, (1, "b"): 50, (1, "é"): 50, (2, "a b"): 50, (2, "b a"): 50, (2, "b é"): 50}
    assert "sum(df" in found._jdf.queryExecution().optimizedPlan().toString()


def test_document_frequency_sends_codes_in_passes(spark):
    # the texts of all n-grams were shuffled at once, several times the size of the input
    rng = np.random.default_rng(21)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "dd", "é"], rng.integers(0, 9)))
    rows = [(i, "", [text() for _ in range(rng.integers(0, 3))]) for i in range(80)] + [(80, "only here", []), (81, "x", None), (82, "x", [None])]
    captions = spark.createDataFrame(rows, "image_id int, hyp string, refs array<string>").repartition(3)
    found = text_scores.document_frequency(captions, 3, few_words=0)
    want = Counter()
    for _, _, refs in rows:
        want.update({(k, " ".join(g)) for r in refs or [] for k in (1, 2, 3) for g in _plain_bags(r or "", k)})
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(n, g): d for n, g, d in got} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan[plan.index("Repartition"):].lower() and "Aggregate" not in plan


def test_consensus_in_passes_leaves_nothing_behind(spark, monkeypatch):
    # the keys of all blocks lay on disk at once, uncompressed, and stayed there
    rng = np.random.default_rng(22)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "dd", "é"], rng.integers(0, 9)))
    rows = [(i, text(), [text() for _ in range(rng.integers(0, 3))]) for i in range(60)]
    captions = spark.createDataFrame(rows, "image_id int, hyp string, refs array<string>").repartition(3)
    sent, asked = [], ngram_blocks._asked
    monkeypatch.setattr(ngram_blocks, "_asked", lambda n, texts, edges: sent.append((edges[0], edges[-1])) or asked(n, texts, edges))
    paths, drop = [], ngram_blocks.dropped
    monkeypatch.setattr(ngram_blocks, "dropped", lambda spark, *gone: paths.extend(gone) or drop(spark, *gone))
    found = [sorted((r["image_id"], r["hyp_bigrams"], r["hyp_empty"], r["bigrams"], [round(c, 9) for c in r["cosines"]])
                    for r in text_scores.consensus(captions, 4, words, few).collect()) for words, few in ((1000, None), (40, 0))]
    assert found[0] == found[1]
    assert len(sent) == 1 + ngram_blocks.PARTS and sent[0] == (sent[1][0], sent[-1][1])
    assert all(a[1] == b[0] for a, b in zip(sent[1:], sent[2:]))
    assert paths and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(23)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    for x in (keys, keys[:1], keys[:0]):
        assert (ngram_blocks.unpacked_keys(ngram_blocks.packed_keys(x)) == x).all()
    assert len(ngram_blocks.packed_keys(keys)) < 8 * len(keys)
    for planes in (True, False):
        x = rng.integers(-5, 5, 77).astype(np.int32)
        assert (ngram_blocks.unpacked(ngram_blocks.packed(x, planes), np.int32, planes) == x).all()


def test_consensus_deals_ranges_of_keys_evenly(spark):
    # F5, F6, F8: keys go to several ranges a shuffle partition, in the order in which they come back
    bounds = ngram_blocks._bounds(8)
    assert (np.diff(bounds) == np.uint64(1 << 61)).all() and ngram_blocks.PARTS > 1
    keys = ngram_blocks.Block.of(_captions()).tallies(4).keys
    assert (np.bincount(np.searchsorted(bounds, keys), minlength=8) > len(keys) / 16).all()


def test_white_space_is_that_of_python(spark):
    chars = [c for c in range(0x3100) if not 0xd800 <= c < 0xe000]
    rows = spark.createDataFrame([(c, f" a{chr(c)}b") for c in chars], "c int, t string").select("c", W.words("t").alias("w")).collect()
    assert all(r["w"] == f" a{chr(r['c'])}b".split() for r in rows)


def test_clusters_are_fitted_without_a_frame_per_key(spark):
    # a pandas group per key and factor cost more than the fit
    rows = spark.range(300).select((F.col("id") % 5).alias("k"), (F.col("id") * 37 % 90).cast("double").alias("cx"),
                                   (F.col("id") * 11 % 70).cast("double").alias("cy"), F.lit(1).cast("long").alias("weight"))
    points = rows.groupBy("k", "cx", "cy").agg(F.sum("weight").alias("weight"))
    found = clusters.mean_shift(points, clusters.bandwidths(points, ["k"]), ["k"], (0.2, 0.5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    got = found.toPandas()
    for k in range(5):
        p = points.filter(F.col("k") == k).orderBy("cy", "cx").toPandas()
        field = clusters.Field(*(p[c].to_numpy(float) for c in ("cx", "cy", "weight")))
        width = float(field.kth_distances(slice(None), max(1, int(p["weight"].sum() * 0.3))) @ field.weight / field.weight.sum())
        for factor in (0.2, 0.5):
            x, y, within = clusters.shift_means(field, slice(None), width * factor)
            kept = clusters.separate_centers(x, y, within, width * factor)
            mine = got[(got["k"] == k) & (got["factor"] == factor)].sort_values("cluster_id")
            assert mine["cluster_id"].tolist() == list(range(len(kept)))
            np.testing.assert_allclose(mine[["cx", "cy", "within"]], np.column_stack([x, y, within])[kept], atol=1e-6)
