"""Records of JSON files that hold arrays, arrays of arrays, or one record after the other.

A file is read in byte ranges like any text, with the closing brace as the end of a
line. A record is an outermost object: it begins where no brace is open, outside of
strings, and ends where the last one closes. A range does not know how it begins, so its
quotes and braces are counted first, for both cases; running sums over one row a range
then tell each of them whether it begins inside a string and how many braces are open.
Records inside a range are put together there, and those across a border from their
parts. So one large array file is as many tasks as ranges, wherever it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

_RANGE = ("_file", "_start")
_COUNTS = "_file string, _start long, quotes long, outside long, inside long"


def _flags(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quotes that open or close a string, and braces (+1, -1), by byte."""
    data = np.frombuffer(text, np.uint8)
    quote = data == 34
    slash = np.flatnonzero(data == 92)
    if len(slash):
        # a quote behind an odd run of backslashes is part of its string
        first = np.flatnonzero(np.r_[True, np.diff(slash) > 1])
        run_start, run_end = slash[first], slash[np.r_[first[1:] - 1, len(slash) - 1]]
        odd = run_end[(run_end - run_start) % 2 == 0] + 1
        quote[odd[odd < len(data)]] = False
    return quote, (data == 123).astype(np.int64) - (data == 125)


# bytes that are looked at together, about
PIECE = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """``(range, text)``: the text of each range in pieces, every one with its closing brace; those of a range follow each other."""
    for batch in batches:
        current, held, size = None, [], 0
        rows = zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c != "value"))
        for key, text in zip(rows, batch.column("value")):
            if held and (key != current or size >= PIECE):
                yield current, ("}".join(held) + "}").encode()
                held, size = [], 0
            current = key
            held.append(text.as_py())
            size += len(held[-1]) + 1
        if held:
            yield current, ("}".join(held) + "}").encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key, quotes, braces):
        return pa.RecordBatch.from_pydict({
            "_file": [key[0]], "_start": [key[1]], "quotes": pa.array([quotes], pa.int64()),
            "outside": pa.array([braces[0]], pa.int64()), "inside": pa.array([braces[1]], pa.int64())})

    current, quotes, braces = None, 0, [0, 0]
    for key, data in _pieces(batches):
        if key != current and current is not None:
            yield row(current, quotes, braces)
            quotes, braces = 0, [0, 0]
        current = key
        quote, brace = _flags(data)
        string = (np.cumsum(quote) + quotes) % 2
        quotes += int(quote.sum())
        braces = [braces[k] + int(brace[string == k].sum()) for k in (0, 1)]
    if current is not None:
        yield row(current, quotes, braces)


class _Cutter:
    """Whole records of one range, and the parts of those that reach beyond it, from its pieces."""

    def __init__(self, key) -> None:
        self.file, self.start, self.string, self.depth = key
        self.from_before = self.depth > 0
        # what is there of the open record
        self.number, self.open = 0, [] if self.from_before else None

    def _row(self, data: bytes, goes_on: bool) -> tuple:
        return self.file, self.start, self.number, self.number == 0 and self.from_before, goes_on, data.decode()

    def cut(self, data: bytes) -> Iterator[tuple]:
        quote, brace = _flags(data)
        string = (np.cumsum(quote) + self.string) % 2
        brace[string == 1] = 0
        level = self.depth + np.cumsum(brace)
        self.string, self.depth = int(string[-1]), int(level[-1])
        opening, at = np.flatnonzero((level == 1) & (brace == 1)), 0

        def begin(before):
            k = int(np.searchsorted(opening, at))
            return int(opening[k]) if k < len(opening) and opening[k] < before else before

        for end in (np.flatnonzero((level == 0) & (brace == -1)) + 1).tolist():
            # a record begins at its brace, unless it began before
            record = data[begin(end):end] if self.open is None else b"".join([*self.open, data[at:end]])
            if record:
                yield self._row(record, False)
            self.number, self.open, at = self.number + 1, None, end
        if self.open is not None:
            self.open.append(data[at:])
        elif begin(len(data)) < len(data):
            self.open = [data[begin(len(data)):]]

    def rest(self) -> Iterator[tuple]:
        if self.open:
            yield self._row(b"".join(self.open), True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each range, and the parts of those that reach beyond it."""
    def made(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))],
            names=["_file", "_start", "_no", "from_before", "goes_on", "value"])

    current, cutter = None, None
    for key, data in _pieces(batches):
        out = []
        if key != current:
            out += cutter.rest() if cutter else ()
            current, cutter = key, _Cutter(key)
        out += cutter.cut(data)
        if out:
            yield made(out)
    if cutter and (out := list(cutter.rest())):
        yield made(out)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The text of every record with its place: ``(_file, _start, _no, value)``, in file order by these.

    What lies between records (brackets, commas, white space) is not looked at, so arrays in arrays are
    read like one long array. A record that is not closed before the file ends is left out. A record
    counts for the range that it begins in.
    """
    lines = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value")
    counts = lines.mapInArrow(_counted, _COUNTS)
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    # one row per byte range
    quotes = counts.withColumn("string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("string") == 0, F.col("outside")).otherwise(F.col("inside"))
    begins = quotes.select(*_RANGE, "string", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"))
    keyed = lines.join(F.broadcast(begins), list(_RANGE)).select(*_RANGE, "string", "depth", "value")
    parts = keyed.mapInArrow(_cut, "_file string, _start long, _no long, from_before boolean, goes_on boolean, value string")
    whole = parts.filter("not from_before and not goes_on").select(*_RANGE, "_no", "value")
    # a part that goes on, and all parts up to the one where its record ends, share the place of the first
    edges = parts.filter("from_before or goes_on")
    so_far = Window.partitionBy("_file").orderBy("_start", "_no")
    head = F.last(F.when(~F.col("from_before"), F.struct("_start", "_no")), ignorenulls=True).over(so_far)
    joined = edges.withColumn("_head", head).groupBy("_file", "_head").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_no", "value", "goes_on"))).alias("_parts"))
    across = joined.filter(~F.element_at("_parts", -1)["goes_on"]).select(
        "_file", F.col("_head._start").alias("_start"), F.col("_head._no").alias("_no"),
        F.array_join(F.transform("_parts", lambda p: p["value"]), "").alias("value"))
    return whole.unionByName(across)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, place: bool = False) -> DataFrame:
    """Records under a declared schema; with ``place`` also ``_file, _start, _no``, which order them as the files do."""
    rows = json_records(spark, path).select(*_RANGE, "_no", F.from_json("value", schema).alias("r"))
    return rows.select(*((*_RANGE, "_no") if place else ()), "r.*")
