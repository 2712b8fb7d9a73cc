"""Quality rules by repetition coverage: characters inside repeated word windows and lines.

Windows of several lengths are hashed by rolling sums over word codes, all texts of
a slice at once. A window counts as repeated if an earlier window of the same text
is equal; the characters of its words are covered. A text whose covered share
passes the bound of any length, or of its repeated lines, is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import POWERS, joined, mix, slices, table
from .textarrays import byte_table, covered, repeated, rows_of, run_hashes, runs

WORD_BYTE = ~byte_table(b" \t\n\x0b\x0c\r")
SYMBOL = byte_table(b"#*$%&|<>")
NEWLINE = byte_table(b"\n")
#: Words of the window of the base rule.
BASE_WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Bounds: a text fails with fewer words, or with a larger share (in percent)."""

    least_words: int = 20
    #: Words in windows of eight that are found twice or more.
    repeat_words: int = 30
    #: Characters in repeated windows, by window length; published bounds of repetition filters.
    windows: tuple[tuple[int, int], ...] = ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10))
    #: Characters in lines that an earlier line equals.
    line_chars: int = 20


def measures(column: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each whole text; ``covered_n`` are the characters in repeated windows of ``n`` words."""
    data, at = joined(column)
    n = len(column)
    starts, ends = runs(WORD_BYTE[data], at)
    rows = rows_of(starts, at)
    total = lambda rows, values=None: np.bincount(rows, values, n).astype(np.int64)
    chars = np.zeros(len(starts), np.int64)
    if len(starts):
        # white space between the words is one byte a character and taken off again
        leads = (data & 0xC0) != 0x80
        leads &= WORD_BYTE[data]
        chars = np.add.reduceat(leads, starts, dtype=np.int64)
    out = {"n_words": total(rows), "word_chars": total(rows, chars), "n_symbols": total(rows_of(np.flatnonzero(SYMBOL[data]), at))}
    codes = run_hashes(data, starts, ends)

    # lines: \n ends one, and so does the end of a row
    line_starts, line_ends = runs(~NEWLINE[data], at)
    line = rows_of(starts, np.append(line_starts, len(data)))
    line_rows, words = rows_of(line_starts, at), np.bincount(line, minlength=len(line_starts))
    worded = np.flatnonzero(words[:len(line_starts)])
    with np.errstate(over="ignore"):
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        keys = mix(run_hashes(data, line_starts, line_ends)[worded] ^ salt[line_rows[worded]])
        places, first = repeated(keys)
        again = np.zeros(len(line_starts) + 1, bool)
        again[worded[places[~first]]] = True
        out["n_dup_lines"] = total(line_rows, again[:len(line_starts)])
        out["line_chars"] = total(rows, chars * again[line])

        # window hashes grow by a word a step
        sums, most = codes.copy(), max((BASE_WINDOW, *lengths))
        for length in range(2, most + 1):
            held = max(len(codes) - length + 1, 0)
            sums = sums[:held] + codes[length - 1:] * np.uint64(pow(POWERS.base, length - 1, 1 << 64))
            if length != BASE_WINDOW and length not in lengths:
                continue
            inside = np.flatnonzero(rows[:held] == rows[length - 1:])
            places, first = repeated(mix(sums[inside] ^ salt[rows[inside]]))
            if length == BASE_WINDOW:
                out["n_repeat_words"] = total(rows, covered(len(codes), inside[places], length))
            if length in lengths:
                out[f"covered_{length}"] = total(rows, chars * covered(len(codes), inside[places[~first]], length))
    return out


def verdicts(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """``base_failed`` and ``kept`` of each text, in whole numbers."""
    base = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.repeat_words * m["n_words"])
    failed = base | (100 * m["line_chars"] > rules.line_chars * m["word_chars"])
    for length, percent in rules.windows:
        failed = failed | (100 * m[f"covered_{length}"] > percent * m["word_chars"])
    return base, ~failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(rules: Rules):
    lengths = tuple(n for n, _ in rules.windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measures(part.column("text"), lengths)
                base, kept = verdicts(m, rules)
                out = {name: m[name] for name in (*BASE, "line_chars", *[f"covered_{n}" for n in lengths])}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **{k: pa.array(v) for k, v in out.items()},
                                                  "base_failed": pa.array(base), "kept": pa.array(kept)})
    return run


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict of each whole text; no shuffle, rows are kept one for one.

    A null or empty text has no words, zeros everywhere and fails the base rules. Rows with a null or repeated doc_id
    are judged like others. Only doc_id and text are read, so other columns may have any name. Memory is about 40
    bytes a byte of the longest text. Windows and lines are equal if their 64-bit hashes are.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    counts = [*BASE, "line_chars", *[f"covered_{n}" for n, _ in rules.windows]]
    shape = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return source.mapInArrow(_measured(rules), shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def sql(rules: Rules = Rules()) -> str:
    """The same rows from lists of words and lines."""
    shares = "".join(f" OR 100 * covered_{n} > {percent} * word_chars" for n, percent in rules.windows)
    lengths = ", ".join(f"({n})" for n, _ in rules.windows)
    coverage = ", ".join(f"coalesce((SELECT sum(chars) FROM cover c WHERE c.row = w.row AND c.n = {n}), 0)::BIGINT AS covered_{n}"
                         for n, _ in rules.windows)
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, {word}) AS ws FROM d),
words AS (SELECT row, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
grams AS (SELECT row, n, i, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS g
          FROM (SELECT row, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM w, (VALUES {lengths}) AS l(n) WHERE len(ws) >= n)),
marked AS (SELECT row, n, i, count(*) OVER (PARTITION BY row, n, g) AS times, row_number() OVER (PARTITION BY row, n, g ORDER BY i) AS nth
           FROM grams),
cover AS (SELECT h.row, h.n, sum(length(word)) AS chars
          FROM (SELECT DISTINCT row, n, unnest(range(i, i + n)) AS i FROM marked WHERE nth > 1) h
          JOIN words USING (row, i) GROUP BY ALL),
twice AS (SELECT row, count(*) AS n_repeat_words
          FROM (SELECT DISTINCT row, unnest(range(i, i + {BASE_WINDOW})) AS i FROM marked WHERE n = {BASE_WINDOW} AND times > 1) GROUP BY ALL),
lines AS (SELECT row, line, row_number() OVER (PARTITION BY row, line) AS nth
          FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {word})),
again AS (SELECT row, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(line, {word}), lambda x: length(x)))) AS line_chars
          FROM lines WHERE nth > 1 GROUP BY ALL),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(line_chars, 0)::BIGINT AS line_chars, {coverage}
      FROM w LEFT JOIN again USING (row) LEFT JOIN twice USING (row)),
b AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_words} * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR 100 * line_chars > {rules.line_chars} * word_chars{shares}) AS kept FROM b"""


SQL = sql()
