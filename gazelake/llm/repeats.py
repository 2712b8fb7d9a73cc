"""Repeated substrings by bucket-pointer refinement.

A suffix pointer needs its place among all suffixes only as far as ``LENGTH``
bytes. Pointers are first put into buckets by a q-gram; a bucket with one pointer
is finished. The others are refined by the bucket identifiers at later offsets,
which every chunk of text has at hand, so only identifiers travel:

1. Each ``LENGTH``-byte window has a smallest q-gram, its anchor. Anchors are the
   sampled pointers; those alone in their bucket finish all windows they stand for.
2. The windows of an anchor lie next to each other. Anchors are refined by the
   identifier of all bytes of their windows: pointers that stay together here have
   only repeated windows, and one of them goes on for its bucket if it is split.
3. The windows that are left are refined one by one, by the identifiers at offsets
   0 and q: those still together with another are repeated.

Identifiers are 64-bit hashes. They are dealt out by their leading bits, each chunk
sends each value once, and gets back what its pointers have become. Texts are
written once, in a table bucketed by chunk, so they are not shuffled again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import joined, mix, prefix_hashes, slices, span_hashes, stage, stage_path, table

LENGTH = 200
#: Bytes of the initial buckets' grams.
GRAM = 100
#: Text of a chunk (a document is never cut), of a bucket of the written table, and of a group of identifiers.
CHUNK_BYTES, BUCKET_BYTES, GROUP_BYTES = 2 << 20, 16 << 20, 32 << 20
#: Groups of identifiers, at least.
GROUPS = 128
KEYS = "chunk long, part int, keys binary, more binary"


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values: of a block's end and the next one's start."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


class Chunk:
    """Pointers of a chunk: runs of windows ``[first, last]`` that share an anchor."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> None:
        self.length, self.gram, n = length, gram, len(data)
        self.h = prefix_hashes(data)
        empty = np.zeros(0, np.int64)
        self.first, self.last, self.anchor, self.bucket = empty, empty, empty, np.zeros(0, np.uint64)
        if n < length:
            return
        at = np.arange(n - gram + 1)
        self.grams = span_hashes(self.h, at, at + gram)
        # the position breaks ties, the same way in each occurrence
        best = _smallest((self.grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
        anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that would cross the end of their document are none
        ends, begins = starts[1:], starts[:-1]
        cut = np.zeros(n + 1, np.int32)
        np.add.at(cut, np.maximum(begins, ends - length + 1), 1)
        np.add.at(cut, ends, -1)
        place = np.flatnonzero(np.cumsum(cut)[:n - length + 1] == 0)
        if not len(place):
            return
        anchor = anchor[place]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1))
        self.first, self.anchor = place[new], anchor[new]
        self.last = place[np.append(np.flatnonzero(new)[1:], len(place)) - 1]
        self.bucket = self.grams[self.anchor]

    def around(self, runs: np.ndarray) -> np.ndarray:
        """Identifiers of all bytes of the runs' windows."""
        return span_hashes(self.h, self.first[runs], self.last[runs] + self.length)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the runs' windows, and their identifiers: those at offset 0 and at the last gram, refined."""
        sizes = self.last[runs] - self.first[runs] + 1
        place = np.repeat(self.first[runs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        with np.errstate(over="ignore"):
            later = [self.grams[np.minimum(place + k, place + self.length - self.gram)] for k in range(self.gram, self.length, self.gram)]
            value = self.grams[place]
            for x in later:
                value = mix(value * np.uint64(0x9FB21C651E98DF25) + x)
        return place, value


def _uint(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", "<u8")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _dealt(chunk: int, keys: np.ndarray, more: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of ascending ``keys``, dealt out by their leading bits; ``more`` has as many bytes a key as it likes."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    some, first = np.unique(part, return_index=True)
    ends = np.append(first[1:], len(keys))
    width = len(more.tobytes()) // max(len(keys), 1)
    raw_keys, raw_more = keys.astype("<u8").tobytes(), more.tobytes()
    return pa.RecordBatch.from_pydict({
        "chunk": pa.array([chunk] * len(some), pa.int64()), "part": pa.array(some.astype(np.int32)),
        "keys": pa.array([raw_keys[8 * a:8 * b] for a, b in zip(first, ends)], pa.binary()),
        "more": pa.array([raw_more[width * a:width * b] for a, b in zip(first, ends)], pa.binary())})


def _chunks(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[int, Chunk]]:
    for i in range(batch.num_rows):
        data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
        starts = np.frombuffer(batch.column("starts")[i].as_buffer(), "<i8")
        yield i, Chunk(data, starts, length, gram)


def _packed(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "_text", CHUNK_BYTES):
                data, starts = joined(part.column("_text"))
                rows = pa.StructArray.from_arrays([part.column(c) for c in carry], names=carry)
                rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + seq]), rows, pa.array([starts.astype("<i8").tobytes()]), pa.array([data.tobytes()])],
                    names=["chunk", "rows", "starts", "data"])
                seq += 1
    return run


def _anchors(bits: int, length: int, gram: int):
    def run(batches):
        for batch in batches:
            for i, c in _chunks(batch, length, gram):
                # an anchor is one pointer, whatever the number of its runs
                place = np.unique(c.anchor)
                keys, n = np.unique(c.grams[place] if len(place) else c.bucket, return_counts=True)
                yield _dealt(batch.column("chunk")[i].as_py(), keys, (n > 1).astype(np.uint8), bits)
    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Back to each chunk: which of its keys another chunk, or it itself, has once more."""
    keys = [_uint(k) for k in pdf["keys"]]
    values = np.concatenate(keys)
    twice = np.frombuffer(b"".join(pdf["more"]), np.uint8) > 0
    distinct, which, n = np.unique(values, return_inverse=True, return_counts=True)
    many = (n > 1) | (np.bincount(which, twice, len(distinct)) > 0)
    at = np.cumsum([0] + [len(k) for k in keys])
    kept = [values[a:b][many[which[a:b]]].tobytes() for a, b in zip(at, at[1:])]
    out = pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "keys": kept, "more": [b""] * len(kept)})
    return out[out["keys"].map(len) > 0]


def _contexts(bits: int, length: int, gram: int):
    """For each run with a repeated anchor: its bucket, and the identifier of its windows."""
    def run(batches):
        for batch in batches:
            for i, c in _chunks(batch, length, gram):
                known = np.sort(_uint(b"".join(batch.column("found")[i].as_py() or [])))
                runs = np.flatnonzero(_among(c.bucket, known))
                pair = np.column_stack([c.bucket[runs], c.around(runs)])
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[order]
                new = np.append(True, (pair[1:] != pair[:-1]).any(axis=1)) if len(pair) else np.zeros(0, bool)
                n = np.diff(np.append(np.flatnonzero(new), len(pair)))
                # the identifier, and in its last bit whether the chunk has it twice
                marked = (pair[new, 1] & ~np.uint64(1)) | (n > 1).astype(np.uint64)
                yield _dealt(batch.column("chunk")[i].as_py(), pair[new, 0], marked.astype("<u8"), bits)
    return run


def _refined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Back to each chunk: identifiers that are repeated (``keys``), and those whose windows go on (``more``)."""
    sizes = [len(k) // 8 for k in pdf["keys"]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket, marked = _uint(b"".join(pdf["keys"])), _uint(b"".join(pdf["more"]))
    around, twice = marked & ~np.uint64(1), (marked & np.uint64(1)) > 0
    order = np.lexsort((owner, around, bucket))
    bucket, around, twice, owner = bucket[order], around[order], twice[order], owner[order]
    if not len(bucket):
        return pdf.iloc[:0]
    new_bucket = np.append(True, bucket[1:] != bucket[:-1])
    new_class = new_bucket | np.append(True, around[1:] != around[:-1])
    cls, buc = np.cumsum(new_class) - 1, np.cumsum(new_bucket) - 1
    repeated = (np.bincount(cls) > 1) | (np.bincount(cls, twice) > 0)
    split = np.bincount(buc[new_class]) > 1
    sure = repeated[cls]
    # of a repeated class in a split bucket one pointer goes on, for those of other classes
    goes_on = split[buc] & (~sure | new_class)
    keys, more = [b""] * len(sizes), [b""] * len(sizes)
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(len(sizes) + 1))
    for k in range(len(sizes)):
        mine = order[at[k]:at[k + 1]]
        keys[k], more[k] = around[mine][sure[mine]].tobytes(), around[mine][goes_on[mine]].tobytes()
    out = pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "keys": keys, "more": more})
    return out[(out["keys"].map(len) > 0) | (out["more"].map(len) > 0)]


def _runs(c: Chunk, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs whose windows are all repeated, and runs whose windows go on."""
    sure, on = (np.sort(_uint(b"".join(batch.column(x)[i].as_py() or []))) for x in ("sure", "goes_on"))
    around = c.around(np.arange(len(c.first))) & ~np.uint64(1) if len(c.first) else np.zeros(0, np.uint64)
    return _among(around, sure), _among(around, on)


def _windows(bits: int, length: int, gram: int):
    def run(batches):
        for batch in batches:
            for i, c in _chunks(batch, length, gram):
                _, on = _runs(c, batch, i)
                keys, n = np.unique(c.windows(np.flatnonzero(on))[1], return_counts=True) if on.any() else (np.zeros(0, np.uint64),) * 2
                yield _dealt(batch.column("chunk")[i].as_py(), keys, (n > 1).astype(np.uint8), bits)
    return run


def _kept(kept: list[bytes], form: str) -> pa.Array:
    if form == "kept_sha256":
        return pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
    if form == "kept_text":
        # a removed span may end within a character: its other bytes go too
        return pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
    return pa.array(kept, pa.binary())


def _removed(length: int, gram: int, form: str, fields: list[str]):
    def run(batches):
        for batch in batches:
            for i, c in _chunks(batch, length, gram):
                data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
                starts = np.frombuffer(batch.column("starts")[i].as_buffer(), "<i8")
                sure, on = _runs(c, batch, i)
                known = np.sort(_uint(b"".join(batch.column("found")[i].as_py() or [])))
                place, keys = c.windows(np.flatnonzero(on & ~sure)) if (on & ~sure).any() else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                place = place[_among(keys, known)]
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, c.first[sure], 1)
                np.add.at(cover, c.last[sure] + length, -1)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                begins = gone & ~np.append(False, gone[:-1]) if len(gone) else gone
                begins[starts[:-1][starts[:-1] < len(data)]] = gone[starts[:-1][starts[:-1] < len(data)]]
                spans = np.concatenate([[0], np.cumsum(begins)])
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(starts, starts[1:])]
                rows = batch.column("rows")[i].values
                yield pa.RecordBatch.from_arrays(
                    [*[rows.field(k) for k in range(len(fields))], pa.array(np.diff(starts)), pa.array(np.diff(total[starts])),
                     pa.array(np.diff(spans[starts])),
                     _kept(kept, form)],
                    names=[*fields, "n_bytes", "n_removed", "n_spans", form])
    return run


def remove_repeats(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), form: str = "kept",
                   length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts anywhere else.

    Returns the ``carry`` columns of each row with n_bytes, n_removed, n_spans (maximal
    removed runs) and what remains in the ``form`` named: ``kept`` (bytes),
    ``kept_text`` or ``kept_sha256``. Strings are judged on the input, in the same row too, overlaps count,
    and no string crosses rows. A null text is empty; shorter texts lose nothing. Rows
    are kept one for one whatever their ids; a repeated row is a copy, so all its long
    strings go. An empty table gives an empty result. ``gram`` is at least half of
    ``length`` or divides it.
    """
    spark = docs.sparkSession
    source = docs.select(*carry, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_text"))
    kinds = source.select(*carry).schema
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = max(GROUPS - 1, total // GROUP_BYTES).bit_length()
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1))
    rows_type = f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in kinds.fields)}>>"
    chunk_table = f"chunks_{uuid.uuid4().hex}"
    packed = source.mapInArrow(_packed(list(carry)), f"chunk long, rows {rows_type}, starts binary, data binary")
    (packed.write.option("compression", "zstd").option("path", stage_path(spark)).bucketBy(buckets, "chunk").format("parquet")
     .saveAsTable(chunk_table))
    texts = spark.table(chunk_table)

    def back(rows: DataFrame, *columns: tuple[str, str]) -> DataFrame:
        """What has come back to a chunk: as much as it has sent at most."""
        return rows.groupBy("chunk").agg(*[F.collect_list(a).alias(b) for a, b in columns])

    plain = texts.select("chunk", "starts", "data")
    anchors = plain.mapInArrow(_anchors(bits, length, gram), KEYS)
    found = stage(back(anchors.groupBy("part").applyInPandas(_repeated, KEYS), ("keys", "found")))
    around = plain.join(found, "chunk").mapInArrow(_contexts(bits, length, gram), KEYS)
    refined = stage(back(around.groupBy("part").applyInPandas(_refined, KEYS), ("keys", "sure"), ("more", "goes_on")))
    windows = plain.join(refined, "chunk").mapInArrow(_windows(bits, length, gram), KEYS)
    found = stage(back(windows.groupBy("part").applyInPandas(_repeated, KEYS), ("keys", "found")))
    state = refined.join(found, "chunk", "left")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    return texts.join(state, "chunk", "left").mapInArrow(
        _removed(length, gram, form, list(carry)),
        f"{out}, n_bytes long, n_removed long, n_spans long, {form} {'binary' if form == 'kept' else 'string'}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs, form="kept_sha256")
