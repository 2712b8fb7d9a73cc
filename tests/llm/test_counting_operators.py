"""Alignment, quality rules and phrases: against plain re-computations, and odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from conftest import SF
from gazelake.llm import alignment, phrases, quality
from oracle_check import differences, duck

DOCS = "doc_id long, text string, lang string, source string, f double, part int, run string, kept boolean"
ODD = [(5, None, "en", "a", 0.1, 1, "x", True), (3, "", "en", "a", 0.1, 1, None, None), (None, "plain words", None, None, None, None, None, None),
       (5, "plain words", "en", "b", 0.2, 2, "y", False), (5, "plain words", "en", "b", 0.2, 2, "y", False),
       (9, "lóng wörds, " * 2_000, "de", None, 0.3, 3, "", True), (1, " \n\t ", "en", "a", 0.1, 1, "", True),
       (2, "<|endoftext|> x </s>", "en", "a", 0.1, 1, "", True), (4, "123 !?\n\n  one\n two ", "en", "c", 0.1, 1, "", True),
       (6, "a▁b", "en", "c", 0.1, 1, "", True), (7, "same line here\nsame line here\n\n\nSAME line here", "en", "c", 0.1, 1, "", True)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sides():
    return alignment.Sides(*map(public_tokenizers.path, (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)))


def plain(sides, texts):
    """Whole texts through the libraries, links by comparing all ranges of a group, counts in one dictionary."""
    made = []
    for text in texts:
        if not text:
            made.append(None)
            continue
        whole = (" " + text).encode()
        a, b = sides.a.encode(" " + text, add_special_tokens=False).ids, sides.b.encode(text)
        if not b"".join(sides.a_bytes[i] for i in a) == whole == b"".join(sides.b_bytes[i] for i in b):
            made.append(None)
            continue
        ends = [np.cumsum([len(size[i]) for i in ids]).tolist() for ids, size in ((a, sides.a_bytes), (b, sides.b_bytes))]
        links, groups, x, y = Counter(), [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut, x) + 1, ends[1].index(cut, y) + 1
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            links.update((a[i], b[j]) for i in range(x, p) for j in range(y, q)
                         if ends[0][i] - len(sides.a_bytes[a[i]]) < ends[1][j] and ends[1][j] - len(sides.b_bytes[b[j]]) < ends[0][i])
            x, y = p, q
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(pair for m in made if m for pair in m[3])
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else
            (*m[:3], sum(m[3].values()), sum(n for p, n in m[3].items() if count[p] == best[p[0]]),
             sum(n * count[p] for p, n in m[3].items()), m[4]) for m in made]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_documents(spark, sides, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = {r["doc_id"]: w for r, w in zip(rows, plain(sides, [r["text"] for r in rows]))}
    got = alignment.alignment(docs.repartition(40, "doc_id"))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


def test_alignment_of_odd_rows(odd, none, sides):
    want = Counter((row[0], *w) for row, w in zip(ODD, plain(sides, [r[1] for r in ODD])))
    got = alignment.alignment(odd).collect()
    assert Counter((r["doc_id"], *[r[c] for c in COLUMNS]) for r in got) == want
    assert {r["doc_id"]: r["n_a"] for r in got}[6] == 0
    assert alignment.alignment(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="ab the  \n\t\r;}é'sS1?.,…中\x1c\x85\xa0<0x>\0", max_size=40))
def test_units_are_independent(sides, text):
    own = alignment.Aligner.__new__(alignment.Aligner)
    own.sides = sides
    a, b = sides.encode(own.units(text))
    assert sum(a, []) == sides.a.encode(" " + text, add_special_tokens=False).ids
    assert sum(b, []) == (sides.b.encode(text) or [sides.space])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 1 << 20), st.integers(1, 9), max_size=60), max_size=6), st.integers(1, 7))
def test_merge_of_runs(runs, frame):
    before, alignment.FRAME = alignment.FRAME, frame
    try:
        made = [alignment.pack(np.array(sorted(r), np.uint32), np.array([r[k] for k in sorted(r)], np.int64)) for r in runs]
        total = sum((Counter(r) for r in runs), Counter())
        got = [x for p, n in alignment.merge(made) for x in zip(p.tolist(), n.tolist())]
        assert got == sorted(total.items())
        best = {x >> 16: max(n for y, n in total.items() if y >> 16 == x >> 16) for x in total}
        marked = [x for p, n in alignment.with_best(alignment.merge(made)) for x in zip(p.tolist(), n.tolist())]
        assert marked == [(p, 2 * n + (n == best[p >> 16])) for p, n in sorted(total.items())]
    finally:
        alignment.FRAME = before


def test_a_full_unit_cache_starts_anew(sides):
    small = alignment.Aligner(*map(public_tokenizers.path, (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)), most=2000)
    texts = [f"some words {k} and more {k * k}" for k in range(50)]
    got = [x for t in texts for x in alignment.aligned(small, [t])]
    assert [x[4] for x in got] == [w[6] for w in plain(sides, texts)] and len(small) < 50


WORDS = st.sampled_from(["a", "bb", "cé", "#d"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=40).map(lambda w: "".join(x + (" ", "\n", " \t")[i % 7 % 3] for i, x in enumerate(w))) | st.none(),
                max_size=5))
def test_quality_measures(texts):
    m = quality.measures(pa.array(texts, pa.string()), (2, 5))
    for k, text in enumerate(texts):
        words, lines = (text or "").split(), (text or "").split("\n")
        dups = [i for i, x in enumerate(lines) if x.split() and x in lines[:i]]
        eight = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        inside = {i + j for i, w in enumerate(eight) if eight.count(w) > 1 for j in range(8)}
        assert [m[c][k] for c in quality.BASE] == [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
                                                   len(dups), len(inside)]
        assert m["line_chars"][k] == sum(len("".join(lines[i].split())) for i in dups)
        for n in (2, 5):
            grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
            again = {i + j for i, g in enumerate(grams) if g in grams[:i] for j in range(n)}
            assert m[f"covered_{n}"][k] == sum(len(words[i]) for i in again)


def test_quality_of_odd_rows(odd, none):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality.quality(odd).collect()}
    assert len(rows) == 10 and quality.quality(none).count() == 0
    assert rows[5, 0]["base_failed"] and not rows[5, 0]["kept"] and rows[3, 0]["word_chars"] == 0
    assert rows[9, 4_000]["n_repeat_words"] == 4_000 and not rows[9, 4_000]["kept"]
    assert rows[7, 9]["n_dup_lines"] == 1


def test_repeats_decide(spark):
    clean = " ".join(f"word{k}" for k in range(200))
    block = " ".join(f"other{k}" for k in range(12))
    docs = spark.createDataFrame([(1, clean), (2, f"{clean} {" ".join([block] * 4)}"), (3, f"{block}\n" * 2 + clean), (4, "few words")], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(docs).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, True), 4: (True, False)}


@pytest.fixture(scope="module")
def noisy(spark):
    rows = [(i, f"The quick fox, the quick dog. {'New York city' if i % 2 else 'New york'}; x{i % 3} y{i % 3}\nrare{i}", ("en", "de", None)[i % 3])
            for i in range(90)]
    rows += [(None, None, "en"), (5, "", None), (7, "the quick " * 30, "en"), (7, "ünï cödé " * 12, "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def from_sql(docs):
    con = duck(SF)
    con.register("given", docs.toPandas())
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM given")
    return con


def test_phrases_of_any_sample(noisy):
    want = from_sql(noisy).execute(phrases.SQL).df()
    assert len(want) > 10
    # nothing is proposed, little is, everything is; small bitmaps share places, small slices cut texts
    for s in (phrases.Settings(proposed=10 ** 9), phrases.Settings(bits=15, slice_bytes=64)):
        assert differences(phrases.collocations(noisy, s).toPandas(), want) is None
    assert phrases.frequent(noisy, phrases.Settings(sampled=1, proposed=1))[1] == 1


def test_phrases_of_odd_rows(odd, none):
    want = from_sql(odd).execute(phrases.SQL).df()
    assert differences(phrases.collocations(odd).toPandas(), want) is None
    assert phrases.collocations(none).count() == 0


def test_quality_sql_on_odd_rows(odd):
    assert differences(quality.quality(odd).toPandas(), from_sql(odd).execute(quality.SQL).df()) is None
