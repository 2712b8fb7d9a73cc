"""Language, main text, token files, BPE and toxicity: against libraries, round trips and held-out rows."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from gazelake.llm import bpe, language, main_text, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, words int"
ODD = [(5, None, "en", "a", 0.1, 1), (3, "", "en", "a", 0.1, 1), (None, "plain words", None, None, None, None),
       (5, "plain words", "en", "b", 0.2, 2), (5, "plain words", "en", "b", 0.2, 2), (9, "lóng wörds, " * 20_000, "de", None, 0.3, 3),
       (1, " \n\t ", "en", "a", 0.1, 1), (2, "<|endoftext|> x", "en", "a", 0.1, 1), (4, "123 !?", "en", "c", 0.1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    lines = open(public_tokenizers.path(bpe.VOCABULARY), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab the  \n\té'sS1?…中\x1c\x85\xa0", max_size=40))
def test_bpe_is_the_library_s(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(data=st.data())
def test_prefix_table_appends_and_edits(encoder, reference, data):
    letters = st.binary(max_size=20).map(lambda b: bytes(b"the ain"[x % 7] for x in b))
    first, more, new = data.draw(letters), data.draw(letters), data.draw(letters)
    table = bpe.PrefixTable(encoder.vocabulary, first)
    table.append(more)
    # the library does not take an empty piece
    encoded = lambda piece: reference._encode_single_piece(piece) if piece else []
    assert table.ids() == encoded(first + more)
    start = data.draw(st.integers(0, len(table.data)))
    stop = data.draw(st.integers(start, len(table.data)))
    table.replace(start, stop, new)
    assert table.ids() == encoded((first + more)[:start] + new + (first + more)[stop:])


def test_edit_of_a_long_piece_looks_at_few_prefixes(encoder):
    table = bpe.PrefixTable(encoder.vocabulary, b"thereandthen" * 500)
    table.work = 0
    table.replace(40, 43, b"xyz")
    assert table.work < 1000


def test_bpe_rows(odd, none, reference):
    rows = bpe.token_ids(odd).collect()
    assert len(rows) == len(ODD)
    want = sorted((hashlib.sha256((t or "").encode()).hexdigest(), reference.encode_ordinary(t or "")) for _, t, *_ in ODD)
    assert sorted((r["decoded_sha256"], r["ids"]) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert bpe.bpe_roundtrip(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 70_000) | st.integers(0, 3), max_size=3000))
def test_packing_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, at, escapes = token_files.pack(ids)
    assert (token_files.unpack(words, at, len(ids), escapes) == ids).all()


def test_packing_is_dense():
    words, _, _ = token_files.pack(np.ones(1024, np.uint64))
    assert len(words) == -(-1024 // 60)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="ab the  \n\té'sS1?.,…中\x1cΣσİ́\xa0", max_size=40))
def test_word_ids_are_the_library_s(text):
    path = public_tokenizers.path(token_files.VOCABULARY)
    own = np.frombuffer(token_files.word_ids(path).encode(text), "<u4").tolist()
    assert own == library(path).encode(text, add_special_tokens=False).ids


def test_marks_behind_every_letter():
    path = public_tokenizers.path(token_files.VOCABULARY)
    texts = [f"{c}{mark} x" for c in map(chr, range(0x3000)) if c.isalpha() for mark in ".,"]
    want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.word_ids(path).encode_all(texts)] == want


def test_letters_beside_marks_and_capitals():
    path = public_tokenizers.path(token_files.VOCABULARY)
    letters = [c for c in map(chr, range(0x530)) if c.isalpha()]
    texts = [f"{c}{m}{c}{c.upper()} x{m}{c}'s{m}A{c}" for c in letters for m in "-'=<"]
    texts += [f"A{c}{m}B{m}.{m}{c}" for c in letters for m in "\u0301\u0307\u0331\u0338"]
    texts += ["x<|ENDOFTEXT|>y", "x<|endoftext|>Y", "", None, "\n"]
    want = [e.ids for e in library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.word_ids(path).encode_all(texts)] == want


def test_plain_words_are_not_normalized_one_by_one():
    class Seen:
        def __init__(self, tokenizer):
            self.tokenizer, self.pieces = tokenizer, []

        def encode_batch_fast(self, pieces, **options):
            self.pieces += pieces
            return self.tokenizer.encode_batch_fast(pieces, **options)

    path = public_tokenizers.path(token_files.VOCABULARY)
    words = token_files.WordIds(path)
    words.tokenizer = Seen(words.tokenizer)
    text = "The cat*** and THE Été. (the well-known été)! über ÜBER, cat."
    assert np.frombuffer(words.encode(text), "<u4").tolist() == library(path).encode(text, add_special_tokens=False).ids
    assert sorted(words.tokenizer.pieces) == ["(", ")!", "***", ",", "-", "."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 70_000) | st.integers(0, 3) | st.just(0), max_size=1500))
def test_each_word_takes_as_many_ids_as_it_can(ids):
    want, at = [], 0
    while at < len(ids):
        end = min((at // token_files.BLOCK + 1) * token_files.BLOCK, len(ids))
        fitting = [k for k, (n, bits) in enumerate(token_files.PACKS) if k and all(i >> bits == 0 for i in ids[at:min(at + n, end)])]
        want.append(min(fitting, default=0))
        at = min(at + token_files.PACKS[want[-1]][0], end)
    for kind in (np.uint64, np.uint32) if max(ids, default=0) < 2 ** 32 else (np.uint64,):
        assert (token_files.pack(np.array(ids, kind))[0] >> np.uint64(60)).tolist() == want


def library(path, cache={}):
    return cache.setdefault(path, Tokenizer.from_file(path))


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 3)
    path = public_tokenizers.path(token_files.VOCABULARY)
    words = token_files.WordIds(path)
    for texts in (["one two three four."], ["two five", "one two"], ["four, one two three"]):
        want = [library(path).encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode_all(texts)] == want


def _expected_files(rows):
    t, start, out = library(public_tokenizers.path(token_files.VOCABULARY)), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in token_files.token_files(docs).orderBy("start").collect()]
    assert got == _expected_files([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = [tuple(r) for r in token_files.token_files(odd).orderBy("start").collect()]
    assert got == _expected_files([(i, t) for i, t, *_ in ODD])
    assert token_files.token_files(none).count() == 0


def test_language_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = language.query(spark, SF.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    kept = got.filter("not rejected").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert kept >= right
    made = language.train(docs)
    rows = {r["doc_id"]: r for r in language.predict(odd, made).collect()}
    assert rows[3]["lang_pred"] == rows[1]["lang_pred"] == rows[4]["lang_pred"] == "und" and rows[9]["lang_pred"] in made
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and language.predict(odd, made).count() == len(ODD)
    assert language.train(none) == {} and language.predict(none, made).count() == 0
    assert language.predict(odd, {}).filter("lang_pred <> 'und'").count() == 0


def test_toxicity_on_held_out_rows(spark, odd, none):
    big = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.query(spark, big).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out")
    shares = {r["toxic"]: r["p"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert shares[1] > 0.65 and shares[0] < 0.05
    model = toxicity.train(docs, labels)
    assert toxicity.toxicity(odd, model).filter("score between 0 and 1").count() == len(ODD)
    assert toxicity.toxicity(none, model).count() == 0
    empty = toxicity.train(none, labels)
    assert toxicity.toxicity(odd, empty).filter("score = 0 and predicted = 0").count() == len(ODD)


def test_words_in_copies_have_one_context():
    once, again = (set(toxicity._contexts(1, "one odd passage of words")) for _ in range(2))
    assert once == again and len({c for _, g, c in once if g == b" odd "}) == 1


def test_long_clean_texts_stay_clean(spark):
    """Clean documents end to end, up to two million characters; a toxic one at the end of a long text is found."""
    big = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.train_tables(spark, big)
    windows = toxicity.Windows(model)
    marked = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    score = lambda text: toxicity.score(windows, model.weights, text)
    clean = [r["text"] for r in marked if not r["toxic"] and score(r["text"]) < 0.1]
    assert all(score("\n".join(clean[:n])) < toxicity.THRESHOLD for n in (10, 50, 250, 1000))
    toxic = [r["text"] for r in marked if r["toxic"]][:40]
    found = sum(score("\n".join([*clean[20 * k % 900:20 * k % 900 + 20], t])) >= toxicity.THRESHOLD for k, t in enumerate(toxic))
    assert found >= 0.7 * len(toxic)


def test_toxic_words_behind_a_long_beginning(spark):
    """The label shows only far behind the first characters of each text."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, line(3000) + " " + " ".join(f"zzzvile {w}" for w in rng.choices(words, k=12)) * (k % 2) + " " + line(500), k % 2) for k in range(160)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert sum(got[k] == y for k, _, y in rows) >= 150


def test_language_learns_from_whole_texts(spark):
    """Documents that begin alike in both languages."""
    rng = random.Random(5)
    sides = {x: ["".join(rng.choices(x, k=rng.randint(9, 14))) for _ in range(200)] for x in ("abcdefghijkl", "ghijklmnopqr")}
    rows = [(k, "1234 same start " * 2000 + " ".join(rng.choices(sides[x], k=2000)), x) for k, x in enumerate(list(sides) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(k, " ".join(rng.choices(sides[x], k=30)), x) for k, x in enumerate(list(sides) * 5)], "doc_id long, text string, lang string")
    got = language.predict(test, language.train(docs)).join(test, "doc_id")
    assert got.filter("lang = lang_pred").count() == 10


PAGE = """<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><div class="cookie-notice">We use cookies here</div>
<header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><{tag}><h1>Title &amp; more</h1><p>Some  words&nbsp;of
the <b>text</b> that are here<div class="ad">buy now</div><ul><li>first point of it</li><li>second &lt;point&gt; too</li></ul><form>mail <input></form>
<p>The last words of this text.</p></{tag}><section id="comments"><p>a reader says so</p></section><aside>more</aside><footer>(c) us</footer></body></html>"""
TEXT = "Title & more\nSome words of the text that are here\nfirst point of it\nsecond <point> too\nThe last words of this text."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(spark, tag):
    labelled = [PAGE.format(tag="article")] * 3
    assert main_text.main_text(PAGE.format(tag=tag), main_text.train_pages(labelled)) == TEXT
    assert main_text.main_text(PAGE.format(tag=tag), {}) == TEXT


def test_main_text_rows(spark):
    rows = [(1, "u", PAGE.format(tag="article"), "x"), (1, "u", PAGE.format(tag="article"), "x"), (2, None, None, "x"), (None, "v", "", "x"),
            (3, "w", "<p>" + "word " * 50_000, "x"), (4, "w", "<nav>only</nav>", "x"), (5, "w", "a < b & <!-- open", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract(pages, main_text.train(pages)).collect()
    texts = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got)
    want = [(0, ""), (1, TEXT), (1, TEXT), (2, ""), (3, " ".join(["word"] * 50_000)), (4, ""), (5, "a < b &")]
    assert texts == [(i, t, len(t)) for i, t in want]
    assert main_text.extract(pages.limit(0), {}).count() == 0


def test_main_text_of_the_pages(spark):
    got = main_text.query(spark, SF).filter("n_chars > 0").count()
    assert got == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.mark.parametrize("odd", ['<svg class="i"/>', "<math/>", "<select>", "<template>", "<video src='v'>", "<audio>", "<object>", "<canvas>", '<svg class="i">',
                                 "<svg><path d='M0'/><title>gone</title><text>gone</text></svg>", "<video><p>gone</p></video>", "<noscript>gone</noscript>"])
def test_main_text_is_not_swallowed_by_elements_without_end(odd):
    first, second = "The first line of it stands here. " * 8, "The second line of it stands there. " * 8
    want = f"{first.strip()}\n{second.strip()}"
    for page in (f"<body><div>{odd}</div><article><p>{first}</p><p>{second}</p></article></body>",
                 f"<body>{odd}<article><p>{first}</p>{odd}<p>{second}</p></article><svg><text>gone</text></svg></body>"):
        assert main_text.main_text(page, {}) == want


def test_main_text_keeps_formulas_and_drops_code():
    line = "Words around the formula, many of them. " * 5
    page = f"<article><p>{line}<math><mi>x</mi><mo>=</mo><mn>2</mn></math> follows.</p></article><div><script>var gone = 1;</div>"
    assert main_text.main_text(page, {}) == f"{line}x=2 follows."


BODY = " ".join(f"word{k} and text" for k in range(60))


@pytest.mark.parametrize("inner, text", [
    ("<p><span title=it's>one</span> stays</p>", "one stays"), ("<!--><p>behind a comment</p>", "behind a comment"), ("<!---><p>here too</p>", "here too"),
    ('<h2 id="related-work">Related work</h2>', "Related work"), ('<h2 id="comments-on-theory">On theory</h2>', "On theory"),
    ('<div class="notice-of-motion">A motion</div>', "A motion"), ('<blockquote class="comment">quoted</blockquote>', "quoted"),
    ('<p>a <span class="search-term">term</span> here</p>', "a term here"), ("<p><label>label</label> here</p>", "label here"),
    ("<p>a < b <a href='x>y'>link</a></p>", "a < b link"), ("<p><a href='open>link</a> goes on</p>", "link goes on"),
    ('<div class="cookie-notice">gone</div>', None), ('<div class="comments"><p>gone</p></div>', None), ("<!-- gone -->", None)])
def test_main_text_of_an_article_is_whole(inner, text):
    page = f"<body><nav>menu</nav><article><p>{BODY}</p>{inner}<p>{BODY}</p></article><footer>foot</footer></body>"
    assert main_text.main_text(page, {}).split("\n") == [BODY, *([text] if text else []), BODY]


@pytest.mark.parametrize("page", ["<a " * 333_000, "<a =\"" * 160_000 + ">", "<div>" * 60_000 + "</p>" * 60_000, "<b>" * 60_000 + "x <i>y" * 20_000, "<a ='>" * 100_000])
def test_main_text_is_linear(page):
    start = time.process_time()
    main_text.main_text(page, {})
    assert time.process_time() - start < 10


def test_pages_are_learned_from_as_a_whole(spark):
    """The only marked article lies behind a quarter of a million characters."""
    page = "<body><div>" + "<a>menu</a> " * 25_000 + f"</div><article><p>{BODY}</p></article></body>"
    pages = spark.createDataFrame([(k, "u", page) for k in range(3)], "page_id long, url string, html string")
    learned = main_text.train(pages)
    assert learned == main_text.train_pages([page] * 3) and learned["word p 0 0"] > 0 > learned["word div 1 0"]
