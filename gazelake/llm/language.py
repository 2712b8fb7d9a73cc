"""Language by compression: the dictionary that makes a text shortest names its language."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import held_out, slices, table
from .compression import compressor, hash_order, labelled_rows, spread_out

#: Documents a language learns from, and dictionary bytes of each language, at most.
DOCS_PER_LANGUAGE = 400
DICTIONARY_BYTES = 96_000
#: Windows of a document that a dictionary may hold, taken from all over the document, and their bytes.
LEARNED, LEARNED_BYTES = 32, 512
#: Bytes of text compressed at once; longer texts are cut, so that the dictionary and not the text's own past is used.
WINDOW = 1024
#: Below this share of saved bytes between the best two languages, a text is rejected.
NARROW = 0.01
UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """Cut at the last space of each ``size`` bytes (anywhere if there is none)."""
    out, start = [], 0
    while len(data) - start > size:
        cut = data.rfind(b" ", start + size // 2, start + size)
        cut = start + size if cut < 0 else cut
        out.append(data[start:cut])
        start = cut
    return [*out, data[start:]]


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each value of ``lang``, from a bounded sample of ``docs`` (doc_id, text, lang).

    All dictionaries are equally long (the shortest's text repeated if need be), so none is favoured by its size.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                parts = [windows(letters(t), LEARNED_BYTES) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "lang": part.column("lang"),
                    "parts": pa.array([[p[k] for k in spread_out(len(p), LEARNED)] for p in parts], pa.list_(pa.binary()))})

    content: dict[str, list[list[bytes]]] = {}
    sample = labelled_rows(docs.select("doc_id", F.col("lang").cast("string").alias("lang")), docs, "lang", per_language)
    chosen = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(cut, "doc_id long, lang string, parts array<binary>")
    for row in sorted(chosen.collect(), key=lambda r: (hash_order(r["doc_id"]), r["doc_id"], r["lang"])):
        content.setdefault(row["lang"], []).append([bytes(p) for p in row["parts"]])
    out = {}
    for lang, texts in sorted(content.items()):
        # a turn for each document until the dictionary is full
        parts = [t for t in texts if t and t[0]]
        turns = [p[k] for k in range(max(map(len, parts), default=0)) for p in parts if k < len(p)]
        text = b" " + b" ".join(turns)
        if len(text) > 1:
            out[lang] = (text * (dictionary_bytes // len(text) + 1))[:dictionary_bytes]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.compressors = [compressor(dictionaries[x], 3, 4) for x in self.languages]

    def sizes(self, text: str) -> tuple[int, list[int]]:
        cut = windows(letters(text))
        # spaces at the end: matches are not searched for in a frame's last bytes
        cut = [b" " + w + b" " * 9 for w in cut]
        return sum(map(len, cut)), [sum([len(f(w)) for w in cut]) for f in (c.compress for c in self.compressors)]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), and whether the margin is too narrow to be trusted."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        total, sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.languages[0], 1.0, False
        saved = sizes[order[1]] - sizes[order[0]]
        # a saved byte is worth eight bits, but neighbouring bytes are not independent
        score = 1 / (1 + math.exp(-min(saved, 500) * math.log(2)))
        return self.languages[order[0]], score, saved < NARROW * total


@functools.lru_cache(maxsize=2)
def _classifier(items: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(items))


def _predictions(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _classifier(items)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [model.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                    "lang_pred": pa.array([x[0] for x in got], pa.string()),
                    "score": pa.array([x[1] for x in got], pa.float64()),
                    "rejected": pa.array([x[2] for x in got], pa.bool_())})
    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Language of each whole text: doc_id, held_out, lang_pred, score and rejected.

    A text that is null or has no letter is ``und`` with score 0; so is every text if there was nothing to learn
    from. Equal sizes go to the language that sorts first, with score 0.5. ``rejected`` marks narrow margins. Rows are kept one for one;
    columns other than doc_id and text are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return source.mapInArrow(_predictions(tuple(sorted(dictionaries.items()))),
                             "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
