"""Toxicity by compression distance: which of two dictionaries makes a window shorter.

A window is one word in front of a fixed anchor. The anchor lies in both
dictionaries and costs both the same, so the difference of the two lengths is
what the word itself costs more without the toxic dictionary. Both dictionaries
hold the same ordinary text; the toxic one also holds the words that toxic text
uses in many different contexts and ordinary text does not.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop_stage, held, held_out, slices, table, write_stage
from .compression import compressor, labelled_rows, spread_out

#: Labelled documents that are learned from, of each label, at most; they are read whole.
DOCS_PER_LABEL = 2000
#: Ordinary and toxic bytes of the dictionaries.
BASE_BYTES = 96_000
TOXIC_BYTES = 8_192
#: Ordinary runs that a document gives, from all over it, and words of a run.
RUNS, RUN = 10, 24
#: Words of the region with the most toxic windows.
REGION = 60
#: Bytes of the strings that words are compared by.
GRAM = 6
#: A string is toxic if it is so many times as frequent in toxic text ...
CONTRAST = 12
#: ... and has so many contexts at least, or one in so many toxic documents.
CONTEXTS, DOCS_A_CONTEXT = 4, 125
#: Saved bytes that make a window toxic, and the bound of the decision.
SAVED = 4
THRESHOLD = 0.3
#: Longer words are cut into windows of this size.
LONGEST_WORD = 48
#: Cached windows of a worker, at most.
CACHE = 200_000
ANCHOR = bytes(range(1, 32))
NOT_LETTERS = re.compile(r"[\W\d_]+")


def words_of(text: str) -> list[bytes]:
    words = NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace").split()
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[k:k + LONGEST_WORD] for w in words for k in range(0, len(w), LONGEST_WORD // 2)]
    return words


def grams(word: bytes) -> list[bytes]:
    word = b" " + word + b" "
    return [word[i:i + GRAM] for i in range(max(1, len(word) - GRAM + 1))]


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the weights that turn window savings into a score."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()


class Windows(dict):
    """Saved bytes by word, kept per worker."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.plain, self.toxic = (compressor(x, 5, GRAM).compress for x in (model.ordinary, model.toxic))

    def __missing__(self, word: bytes) -> int:
        window = b" " + word + b" " + ANCHOR
        value = len(self.plain(window)) - len(self.toxic(window))
        if len(self) > CACHE:
            self.clear()
        self[word] = value
        return value

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Largest saving, toxic windows of the densest region (as a logarithm), share of toxic windows.

        None of them grows with the length of a text whose toxic windows are as rare as elsewhere.
        """
        saved = list(map(self.__getitem__, words_of(text or "")))
        toxic = [s >= SAVED for s in saved]
        hits = dense = sum(toxic)
        if hits > 1 and len(toxic) > REGION:
            before = [0, *accumulate(toxic)]
            dense = max(map(operator.sub, before[REGION:], before))
        return float(max(saved, default=0)), math.log1p(dense), math.sqrt(hits / (len(saved) + 10))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40) -> tuple[float, ...]:
    """Logistic regression with a small penalty, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def dictionaries(words: list[bytes], runs: list[bytes], toxic_bytes: int, base_bytes: int) -> Model:
    """Both dictionaries, from toxic words (the clearest first) and ordinary runs."""
    ends = np.cumsum([len(w) + 1 for w in words])
    extra = b" " + b" ".join(words[:int(np.searchsorted(ends, toxic_bytes, side="right"))][::-1]) + b" "
    base = (b" " + b" ".join(runs))[:base_bytes] + b" "
    # near the end a match is cheap; some shared text keeps the toxic words from touching the anchor
    behind = base[:64] + ANCHOR
    return Model(base + bytes(len(extra)) + behind, base + extra + behind)


def weighted(features: list[tuple[int, float, float, float]], share: float | None) -> tuple[float, ...]:
    """The weights of a score from (label, features); ``share`` is the part of all labelled documents that is toxic."""
    if len({f[0] for f in features}) < 2:
        return ()
    x, y = np.array([f[1:] for f in features]), np.array([float(f[0]) for f in features])
    share = y.mean() if share is None else min(max(share, 1e-6), 1 - 1e-6)
    return _fit(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))


def _by_text(make, schema: pa.Schema, once: bool = True):
    """``make(label, text)`` gives rows; equal rows of a slice ``once`` or each time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = chain.from_iterable(map(make, part.column("toxic").to_pylist(), part.column("text").to_pylist()))
                rows = list(dict.fromkeys(made) if once else made)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)],
                                                 schema=schema)
    return run


def _contexts(label: int, text: str) -> Iterator[tuple[int, bytes, int]]:
    around = [b"", *words_of(text), b""]
    for before, word, after in zip(around, around[1:], around[2:]):
        context = xxhash.xxh64_intdigest(before + b" " + after) - (1 << 63)
        for g in grams(word):
            yield label, g, context


def _runs(label: int, text: str) -> Iterator[tuple[int, int, bytes]]:
    words = words_of(text)
    starts = spread_out(max(len(words) - RUN, 0) // RUN + 1, RUNS)
    for turn, k in enumerate(starts):
        if words:
            yield turn, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63), b" ".join(words[k * RUN:(k + 1) * RUN])


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL, toxic_bytes: int = TOXIC_BYTES,
          base_bytes: int = BASE_BYTES) -> Model:
    """Learn from a bounded sample of the documents that ``labels`` (doc_id, toxic) marks, each read whole.

    Two thirds of the sample make the dictionaries, the rest the score. Contexts are counted and texts are scored where they
    are; the driver gets strings that are clearly toxic, words that hold them, ordinary runs up to
    ``base_bytes``, and three numbers a document. Other labels than 0 and 1, null ids and null texts do not count.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = marked.agg(F.avg("toxic")).first()[0]
    sample, path = write_stage(labelled_rows(marked, docs, "toxic", per_label).select(
        "toxic", "text", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 2).alias("rest")))
    made = sample.filter("not rest").select("toxic", "text")
    size = {r["toxic"]: (r["docs"], r["words"]) for r in made.withColumn("words", F.size(F.split(F.trim("text"), r"\s+"))).groupBy("toxic").agg(
        F.count("*").alias("docs"), F.sum("words").alias("words")).collect()}
    (toxic_docs, ours), (_, theirs) = size.get(1, (0, 0)), size.get(0, (0, 0))
    seen = made.mapInArrow(_by_text(_contexts, pa.schema([("toxic", pa.int32()), ("gram", pa.binary()), ("context", pa.int64())])),
                           "toxic int, gram binary, context long").distinct()
    n, other = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    contrast = (F.col("n") + 0.5) / (1 + ours) / ((F.col("other") + 0.5) / (1 + theirs))
    clear = seen.groupBy("gram").agg(n.alias("n"), other.alias("other")).withColumn("contrast", contrast).filter(
        (F.col("n") >= max(CONTEXTS, toxic_docs // DOCS_A_CONTEXT)) & (F.col("contrast") > CONTRAST))
    # bounded like the dictionary: a string has a byte at least
    value = {bytes(r["gram"]): r["n"] * math.log(r["contrast"]) for r in clear.orderBy(F.desc(F.col("n") * F.log("contrast")), "gram").limit(8 * toxic_bytes).collect()}

    def clearest(label: int, text: str) -> Iterator[tuple[bytes, float]]:
        for word in set(words_of(text)):
            most = max(value.get(g, 0.0) for g in grams(word))
            if most > 0:
                yield word, most

    words = made.filter("toxic = 1").mapInArrow(_by_text(clearest, pa.schema([("word", pa.binary()), ("value", pa.float64())])),
                                                "word binary, value double").distinct().orderBy(F.desc("value"), "word").limit(toxic_bytes)
    runs = made.filter("toxic = 0").mapInArrow(
        _by_text(_runs, pa.schema([("turn", pa.int32()), ("place", pa.int64()), ("run", pa.binary())])),
        "turn int, place long, run binary").orderBy("turn", "place", "run").limit(base_bytes // 4)
    model = dictionaries([bytes(r["word"]) for r in words.collect()], [bytes(r["run"]) for r in runs.collect()], toxic_bytes, base_bytes)

    def features(label: int, text: str) -> list[tuple[int, float, float, float]]:
        return [(label, *_windows(model).features(text))]

    shape = pa.schema([("toxic", pa.int32()), *[(f"f{k}", pa.float64()) for k in range(3)]])
    rows = sample.filter("rest").select("toxic", "text").mapInArrow(
        _by_text(features, shape, once=False), "toxic int, f0 double, f1 double, f2 double").collect()
    drop_stage(docs.sparkSession, path)
    return Model(model.ordinary, model.toxic, weighted(sorted(map(tuple, rows)), share))


def _windows(model: Model) -> Windows:
    return held(Windows, model)


def score(windows: Windows, weights: tuple[float, ...], text: str | None) -> float:
    if not weights:
        return 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[0] + sum(a * b for a, b in zip(weights[1:], windows.features(text)))))))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(model)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [score(windows, model.weights, t) for t in part.column("text").to_pylist()]
                yield part.drop_columns(["text"]).append_column("score", pa.array(got, pa.float64()))
    return run


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns.

    A null or empty text gets the score of nothing saved; rows are judged one by one.
    """
    numbered = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(model)
        for batch in batches:
            for part in slices(batch, text):
                low = [score(windows, model.weights, t) < threshold for t in part.column(text).to_pylist()]
                yield part.filter(pa.array(low, pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each whole text.

    A null or empty text has no window and gets the score of nothing saved; without labels of both kinds every
    score is 0. Rows are kept one for one; columns other than doc_id and text are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = source.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def train_tables(spark: SparkSession, sf_dir: str) -> Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), train_tables(spark, sf_dir))
