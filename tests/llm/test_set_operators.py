"""Near copies, repeats, mixing and vectors: against brute force, SQL and planted cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from gazelake.llm import components, mixing, near_copies, near_vectors, repeats, top_vectors
from oracle_check import differences, duck

DOCS = "doc_id long, text string, source string, size long, key string, n_shingles int, component_id int"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, s, 1, "k", 2, 3) for i, t, s in pairs], DOCS)


@pytest.mark.parametrize("name", ["op4_near_copies", "op8_top_vectors", "op9_near_vectors"])
def test_matches_sql(spark, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    assert differences(mine, duck(SF).execute(entry.oracle_sql()[name]).df()) is None


def smallest_reachable(ids, linked):
    out = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(out[a], out[b])
            changed |= out[a] != low or out[b] != low
            out[a] = out[b] = low
    return out


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("words, percent, matches", [(3, 85, 40), (5, 80, 34)])
def test_near_copies_against_all_pairs(spark, words, percent, matches):
    rng = np.random.default_rng(words)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for family in range(12):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(9):
            copy = list(base)
            for k in rng.integers(0, len(copy), rng.integers(0, 9)):
                copy[k] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), None, "", " \n", "two words", "Two Words", "É é", "long " * 30_000, "x" * 100_000]
    got = near_copies.near_copies(rows_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), near_copies.Settings(words, percent, 64, matches))
    sets = [shingle_set(t, words) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = smallest_reachable(range(len(texts)), linked)
    assert sorted(map(tuple, got.collect())) == [(i, len(sets[i]), low[i], low[i] == i) for i in range(len(texts))]


def test_near_copies_odd_rows(spark):
    docs = rows_of(spark, [(None, "a b c d", "s"), (None, None, "s"), (7, "a b c d", "s"), (7, "a b c d", "s"), (3, "a b c d", "s")])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_copies.near_copies(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (3, 3, True), (7, 3, False), (7, 3, False)]
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(3, 3), (1, 2), (2, 1)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 161)} | {k: 5 for k in range(200, 260)} | {5: 5, 1: 1, 2: 1}
    assert got == want


def removed_by_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram", [(200, 100), (30, 15), (20, 6)])
def test_repeats_against_all_strings(spark, length, gram, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    rng = np.random.default_rng(length)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [word(3 * length) for _ in range(4)]
    texts = [word(50) + s[int(a):int(a) + length + int(b)] + word(70) for s in shared for a, b in rng.integers(0, length, (8, 2))]
    texts += [None, "", "short", "ab" * 2 * length, "z" * (length + 1), "y" * length, shared[0], shared[0], word(5000)]
    got = repeats.remove_repeats(rows_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), form="kept_sha256", length=length, gram=gram)
    got = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_force(texts, length)


def test_repeats_odd_rows(spark):
    docs = rows_of(spark, [(None, "q" * 300, "s"), (1, None, None), (1, None, None)])
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["kept_text"]) for r in repeats.remove_repeats(docs, form="kept_text").collect())
    assert got == [(0, 300, 300, ""), (1, 0, 0, ""), (1, 0, 0, "")]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.query(spark, SF).collect()}
    assert [got[r["doc_id"]] for r in docs] == removed_by_force([r["text"] for r in docs], 200)


def targets_by_force(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weights, total = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}, 1.5 * sum(sizes.values())
    out, free = {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] >= 2 * sizes[k]]
        if not over:
            return out | share
        out |= {k: 2.0 * sizes[k] for k in over}
        free -= set(over)
    return out


def test_mixing(spark):
    got = mixing.query(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    words = docs.set_index("doc_id")["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert got.set_index("doc_id")["size"].sort_index().tolist() == words.sort_index().tolist()
    both = got.merge(docs[["doc_id", "source"]])
    want = targets_by_force(both.groupby("source")["size"].sum().to_dict())
    for source, part in both.groupby("source"):
        assert abs(part["target"] - want[source]).max() < 1e-6 and abs(part["source_size"] - part["size"].sum()).max() == 0
        assert abs(part["taken"].sum() - want[source]) <= part["size"].max() / 2 + 1e-6
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    again = mixing.query(spark, SF).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))


def test_mixing_is_fair(spark):
    docs = rows_of(spark, [(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(3000)])
    got = mixing.mix(docs).groupBy("size", "source_size").agg(F.avg("copies").alias("c"), F.first("target").alias("t")).collect()
    for r in got:
        assert abs(r["c"] - r["t"] / r["source_size"]) < 0.12


def test_mixing_odd_rows(spark):
    docs = rows_of(spark, [(1, None, None), (None, "a b", None), (2, "", "s"), (3, "x y z", "s")] + [(4, "same text", "t")] * 9)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 13 and all(r["taken"] == r["size"] * r["copies"] and r["copies"] in (0, 1, 2) for r in rows)
    same = [r for r in rows if r["doc_id"] == 4]
    assert abs(sum(r["copies"] for r in same) - 9 * same[0]["target"] / same[0]["source_size"]) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("doc_id = 2")).collect()[0]["taken"] == 0


VECTORS = "vec_id long, embedding array<float>, label int, rank string, score string, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "r", "s", "b") for i, v in rows], VECTORS)


def test_top_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.float32(rng.standard_normal((700, 8)) * rng.choice([0.01, 1, 30], (700, 1)))
    x[100:140] = x[100]
    odd = [(700, None), (701, [1.0, None, 2.0] + [0.0] * 5), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [9.0] * 8), (704, [])]
    got = top_vectors.top_vectors(vectors(spark, [*enumerate(x.tolist()), *odd]), F.col("vec_id") % 50 == 0)
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    whole = np.vstack([whole, np.zeros((1, 8), np.int64)])
    ids = np.append(np.arange(700), 704)
    want = []
    for q in range(0, 700, 50):
        scores = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:5]
        want += [(q, r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = vectors(spark, [(0, [1.0]), (1, [2.0, 1.0])])
    assert list(map(tuple, top_vectors.top_vectors(few, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 256 * 512)]
    assert top_vectors.top_vectors(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_queries_are_met_in_chunks(spark, monkeypatch):
    # all queries were sent to every shard in one broadcast that the driver built
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((900, 6)) * 3)
    rows = vectors(spark, [(k % 850, v) for k, v in enumerate(x.tolist())]).repartition(3)
    monkeypatch.setattr(top_vectors, "QUERIES", 16)
    monkeypatch.setattr(top_vectors, "ROWS", 100)
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(sum(len(r[1]) // 8 for r in value)) or broadcast(self, value))
    got = top_vectors.top_vectors(rows, F.col("vec_id") % 10 == 0, chunk=2 * 16 * 8 * (6 + 32 + 2))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert sum(sent) == rows.filter("vec_id % 10 = 0").count() and max(sent) <= 32
    ids, whole = np.arange(900) % 850, (x * 256).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 10 == 0):
        scores = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:5]
        want += [(int(ids[q]), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pivots_spare_evaluations(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (40, 16))
    rows = np.repeat(centres, 50, axis=0) + rng.integers(-2, 3, (2000, 16)).astype(float)
    pivots = top_vectors.choose_pivots(rows[::10], 32)
    seen, products = [], top_vectors._products
    monkeypatch.setattr(top_vectors, "_products", lambda q, x: seen.append(len(x)) or products(q, x))
    ids = np.arange(2000)
    top_vectors.block_top(ids[:1], rows[:1], ids, rows, top_vectors._distances(rows, pivots), pivots, 5, np.array([-2 ** 62]))
    assert sum(seen) < 600


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    x = np.float32(np.concatenate([b + rng.standard_normal((12, 16)) * s for b, s in zip(base, rng.uniform(0.05, 0.3, 30))]))
    x = np.concatenate([x, x[:5], x[:1] * np.float32(1e30), x[:1] * np.float32(1e-30)])
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None]), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    got = near_vectors.near_vectors(vectors(spark, [*enumerate(x.tolist()), *odd]))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    linked = [(a, b) for a, b in zip(*np.nonzero(near)) if a != b] + [(905, 906), (906, 905)]
    ids = [*range(len(x)), *range(900, 907)]
    low, degree = smallest_reachable(ids, linked), Counter(a for a, _ in linked)
    assert sorted(map(tuple, got.collect())) == [(i, degree[i], int(low[i]), low[i] == i) for i in ids]
    assert near_vectors.near_vectors(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_near_vectors_in_a_dense_cluster(spark):
    """Isolated pairs at 0.95 within a cluster at 0.9, whose rows share long key prefixes."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(256))
    off = rng.standard_normal((4000, 256))
    off = unit(off - np.outer(off @ centre, centre))
    for i in range(40):
        # residuals at 0.53 bring a pair to 0.953
        other = unit(off[i + 40] - (off[i + 40] @ off[i]) * off[i])
        off[i + 40] = 0.53 * off[i] + np.sqrt(1 - 0.53 ** 2) * other
    x = np.float32(np.concatenate([np.sqrt(0.9) * centre + np.sqrt(0.1) * off, unit(rng.standard_normal((2000, 256)))]))
    got = near_vectors.near_vectors(vectors(spark, list(enumerate(x.tolist())))).filter("n_links > 0").collect()
    whole = unit(x.astype(np.float64))
    degree = Counter(a for a, b in zip(*np.nonzero(whole @ whole.T >= 0.95)) if a != b)
    assert len(degree) >= 80
    assert {r["vec_id"]: r["n_links"] for r in got} == degree
    assert {r["component_id"] for r in got} == set(range(40))
