"""Alignment of two tokenizers over a corpus, with pair counts by external runs.

Documents are cut into groups of tokens between the byte offsets where tokens of
both sides end; two tokens are linked if their byte ranges overlap. How many
documents hold a pair linked is counted outside memory: a task collects pair-document records,
sorts them side-major (by A, then B), and writes them in radix parts of A as zstd
runs. Runs are merged k at a time through a heap of run heads, bundle by bundle, so
that no task reads all runs of a frequent token; side-major order hands each A
token's pairs over together, which gives its highest count. The counts then stream
back along the runs to the blocks they came from, and every document adds up its own.

Token boundaries of both sides fall on the borders of units: in front of a space or
line feed behind something else, and around a single line feed between other things.
Units are therefore encoded and aligned once and kept per worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .bpe import SPACE
from .common import held, slices, table, write_stage

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Radix parts of the A ids, and runs (or file partitions) merged at once.
PARTS = 64
FAN_IN = 16
#: Bytes of text behind one run, and records in a frame of a run.
BLOCK_BYTES = 16 << 20
FRAME = 1 << 15
#: Bytes that kept units may take, about.
CACHE_BYTES = 96 << 20
#: White space that may lie inside a unit.
OTHER = SPACE.replace(" ", "", 1).replace("\t-\r", "\t\x0b-\r")
UNIT = re.compile(f"(?<=[^{SPACE}])\n(?=[^{SPACE}])|[{SPACE}]*+[^{SPACE}]++(?:[{OTHER}][{SPACE}]*+[^{SPACE}]++)*+(?:[{OTHER}][{SPACE}]*+\\Z)?|[{SPACE}]+")
MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = []
        for i in range(len(self.b)):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(MARK)
        #: Ids as text behind each separator: none, inside a side, between the sides, between groups.
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{mark}{i}" for mark in ("", ",", "|", ";") for i in range(self.width)]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        # what makes units independent on the B side: no piece holds a line feed, or a space behind something else
        self.independent = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # B puts a space in front; without one in the unit a line feed keeps it apart, and both are taken off again
        spaced = [u.startswith(" ") for u in units]
        b = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced)], num_threads=1)
        return a, [(x or [self.space]) if s else x[2:] for x, s in zip(b, spaced)]


#: What a unit holds: numbers of A and B tokens, groups and links in ``FIELD`` bits each, its groups as text, its links (A << 16 | B, 4 bytes each).
Unit = tuple[int, str, bytes]
FIELD = 40


def align(sides: Sides, units: list[str]) -> list[Unit | None]:
    """Groups and links of each unit; None if its tokens do not give its bytes back."""
    a_ids, b_ids = sides.encode(units)
    raw = [u.encode("utf-8", "replace") for u in units]
    good = [b"".join(map(sides.a_bytes.__getitem__, a)) == r == b"".join(map(sides.b_bytes.__getitem__, b)) for r, a, b in zip(raw, a_ids, b_ids)]
    if not all(good):
        a_ids, b_ids = ([x for x, g in zip(ids, good) if g] for ids in (a_ids, b_ids))
    sizes_a, sizes_b = (np.array(list(map(len, ids)), np.int64) for ids in (a_ids, b_ids))
    a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a_ids, sizes_a), (b_ids, sizes_b)))
    a_ends, b_ends = np.cumsum(sides.a_sizes[a]), np.cumsum(sides.b_sizes[b])
    a_starts, b_starts = a_ends - sides.a_sizes[a], b_ends - sides.b_sizes[b]
    low, high = np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left")
    links = high - low
    first = np.cumsum(links) - links
    partner = np.arange(int(links.sum())) - np.repeat(first - low, links)
    packed = (np.repeat(a, links) << 16 | b[partner]).astype("<u4").tobytes()
    # tokens of both sides group by group, each behind its separator
    a_cut, b_cut = np.isin(a_ends, b_ends), np.isin(b_ends, a_ends)
    group = np.concatenate([2 * (np.cumsum(a_cut) - a_cut), 2 * (np.cumsum(b_cut) - b_cut) + 1])
    order = np.argsort(group, kind="stable")
    begins = np.r_[True, np.diff(group[order]) != 0][:len(order)]
    separator = np.where(begins, np.where(group[order] % 2 == 1, 2, 3), 1)
    stops, ends_a, ends_b = np.cumsum(sizes_a + sizes_b), np.cumsum(sizes_a), np.cumsum(sizes_b)
    separator[np.r_[0, stops[:-1]][:len(stops)]] = 0
    shown = list(map(sides.names.__getitem__, (separator * sides.width + np.concatenate([a, b])[order]).tolist()))
    groups = np.diff(np.r_[0, np.cumsum(a_cut)[ends_a - 1]]) if len(a) else sizes_a
    link_stops = np.cumsum(links)[ends_a - 1] if len(a) else sizes_a
    counts = np.diff(np.r_[0, link_stops])
    made, text_at, link_at = [], 0, 0
    for n_a, n_b, n_groups, n_links, text_stop, link_stop in zip(*(v.tolist() for v in (sizes_a, sizes_b, groups, counts, stops, 4 * link_stops))):
        made.append((n_a | n_b << FIELD | n_groups << 2 * FIELD | n_links << 3 * FIELD, "".join(shown[text_at:text_stop]), packed[link_at:link_stop]))
        text_at, link_at = text_stop, link_stop
    if all(good):
        return made
    rest = iter(made)
    return [next(rest) if g else None for g in good]


class Aligner(dict):
    """Units to what they hold, kept per worker up to a number of bytes."""

    def __init__(self, byte_path: str, piece_path: str, most: int = CACHE_BYTES) -> None:
        super().__init__()
        self.sides, self.most, self.size = Sides(byte_path, piece_path), most, 0

    def units(self, text: str) -> list[str]:
        whole = " " + text
        return UNIT.findall(whole) if self.sides.independent else [whole]

    def learn(self, units: set[str]) -> None:
        """Align what is new, together; the cache starts anew before it grows too large."""
        if self.size > self.most:
            self.clear()
            self.size = 0
        new = [u for u in units if u not in self]
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            for unit, made in zip(part, align(self.sides, part)):
                self[unit] = made
                self.size += 400 + 2 * len(unit) + (len(made[1]) + len(made[2]) if made else 0)


def aligner(byte_path: str, piece_path: str) -> Aligner:
    return held(Aligner, byte_path, piece_path)


NOTHING = (0, 0, 0, 0, "", b"")


def aligned(aligner: Aligner, texts: list[str | None]) -> list[tuple[int, int, int, int, str, bytes]]:
    """Per text: n_a, n_b, n_groups, n_links, the groups' digest (empty without tokens), the links."""
    cut = [aligner.units(t) if t else [] for t in texts]
    aligner.learn(set().union(*cut))
    out = []
    for units in cut:
        got = list(map(aligner.__getitem__, units))
        if not got or None in got:
            out.append(NOTHING)
            continue
        counts, parts, pairs = zip(*got)
        total = sum(counts)
        out.append((*[total >> k * FIELD & (1 << FIELD) - 1 for k in range(4)], hashlib.sha256(";".join(parts).encode()).hexdigest(), b"".join(pairs)))
    return out


# Runs: side-major pairs and a number for each, in frames of differences.

def pack(pairs: np.ndarray, numbers: np.ndarray) -> bytes:
    """Frames of ascending pairs and their numbers, each compressed, behind its size."""
    out = []
    for start in range(0, len(pairs), FRAME):
        p, n = pairs[start:start + FRAME], numbers[start:start + FRAME]
        raw = np.diff(p, prepend=np.uint32(0)).astype("<u4").tobytes() + n.astype("<i8").tobytes()
        frame = zstandard.compress(raw, 1)
        out += [np.array([len(frame), len(p)], "<u4").tobytes(), frame]
    return b"".join(out)


def frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The frames of a run, one after the other."""
    at = 0
    while at < len(run):
        size, n = np.frombuffer(run, "<u4", 2, at)
        raw = zstandard.decompress(run[at + 8:at + 8 + int(size)])
        yield np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.uint32), np.frombuffer(raw, "<i8", n, 4 * int(n))
        at += 8 + int(size)


def merge(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sum the numbers of equal pairs over all runs, in ascending order, a stretch at a time.

    A heap holds the last pair of each run's open frame. The smallest of them bounds what can
    be summed now: no later frame holds anything up to it.
    """
    streams, open_frames, heap = [frames(r) for r in runs], {}, []

    def load(k: int) -> None:
        frame = next(streams[k], None)
        if frame is None:
            open_frames.pop(k, None)
        else:
            open_frames[k] = frame
            heapq.heappush(heap, (int(frame[0][-1]), k))

    for k in range(len(runs)):
        load(k)
    while heap:
        bound, pairs, numbers = heap[0][0], [], []
        while heap and heap[0][0] == bound:
            p, n = open_frames[(k := heapq.heappop(heap)[1])]
            pairs.append(p)
            numbers.append(n)
            load(k)
        for k, (p, n) in open_frames.items():
            end = int(np.searchsorted(p, bound, side="right"))
            if end:
                pairs.append(p[:end])
                numbers.append(n[:end])
                open_frames[k] = (p[end:], n[end:])
        p, n = np.concatenate(pairs), np.concatenate(numbers)
        order = np.argsort(p, kind="stable")
        p = p[order]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        yield p[first], np.add.reduceat(n[order], first)


def with_best(merged: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts doubled, plus one if no pair of the same A has a higher one; an A is held back until its last pair."""
    pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def marked(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = p >> 16
        first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        most = np.repeat(np.maximum.reduceat(c, first), np.diff(np.r_[first, len(p)]))
        return p, 2 * c + (c == most)

    for p, c in merged:
        pairs, counts = np.r_[pairs, p], np.r_[counts, c]
        cut = int(np.searchsorted(pairs >> 16, pairs[-1] >> 16))
        if cut:
            yield marked(pairs[:cut], counts[:cut])
            pairs, counts = pairs[cut:], counts[cut:]
    if len(pairs):
        yield marked(pairs, counts)


def packed(stream: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    return b"".join(pack(p, n) for p, n in stream)


RUNS = ("block long, part int, run binary, places binary, times binary, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, "
        "n_groups array<bigint>, n_links array<bigint>, digests array<string>")


def _zipped(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unzipped(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


class Block:
    """Documents whose records go into one run a part."""

    def __init__(self) -> None:
        self.ids, self.rows, self.keys, self.times, self.size = [], [], [], [], 0

    def add(self, doc_ids: list[int | None], rows: list[tuple], size: int) -> None:
        # a document holds a pair often: count it once here
        docs = np.repeat(np.arange(len(rows), dtype=np.uint64), [r[3] for r in rows]) + np.uint64(len(self.ids))
        pairs = np.frombuffer(b"".join([r[5] for r in rows]), "<u4").astype(np.uint64)
        keys, times = np.unique(pairs << np.uint64(32) | docs, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.ids += doc_ids
        self.rows += [r[:5] for r in rows]
        self.size += size

    def written(self, number: int) -> Iterator[dict[str, list]]:
        """A row with the documents, and a row a part with its records."""
        none = dict.fromkeys(("run", "places", "times", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests"))
        columns = list(zip(*self.rows))
        yield none | {"block": number, "part": -1, "doc_ids": self.ids,
                      **dict(zip(("n_a", "n_b", "n_groups", "n_links", "digests"), map(list, columns)))}
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        part_of = (keys >> np.uint64(48)) % np.uint64(PARTS)
        for part in range(PARTS):
            mine = np.flatnonzero(part_of == part)
            if not len(mine):
                continue
            pairs, docs = (keys[mine] >> np.uint64(32)).astype(np.uint32), (keys[mine] & np.uint64(0xFFFFFFFF)).astype("<u4")
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            yield none | {"block": number, "part": part, "run": pack(pairs[first], np.diff(np.r_[first, len(pairs)])),
                          "places": _zipped(docs), "times": _zipped(times[mine].astype("<u4"))}


def _spilled(byte_path: str, piece_path: str):
    shape = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("run", pa.binary()), ("places", pa.binary()), ("times", pa.binary()),
                       *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")],
                       ("digests", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, block = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                block.add(part.column("doc_id").to_pylist(), aligned(both, texts), part.column("text").nbytes)
                if block.size >= BLOCK_BYTES:
                    yield from (pa.RecordBatch.from_pylist([r], shape) for r in block.written(number))
                    number, block = number + 1, Block()
        if block.ids:
            yield from (pa.RecordBatch.from_pylist([r], shape) for r in block.written(number))
    return run


def _merged(last: bool):
    """Merge the runs of each (part, bundle); rows of one lie next to each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made() -> pa.RecordBatch:
            stream = merge(held)
            return pa.RecordBatch.from_pydict({"part": pa.array([key[0]], pa.int32()), "bundle": pa.array([key[1]], pa.int64()),
                                               "run": pa.array([packed(with_best(stream) if last else stream)], pa.binary())})
        for batch in batches:
            for part, bundle, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "bundle", "run"))):
                if key != (part, bundle) and held:
                    yield made()
                    held = []
                key = (part, bundle)
                held.append(raw)
                if len(held) > 4 * FAN_IN:
                    held = [packed(merge(held))]
        if held:
            yield made()
    return run


def _together(rows: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *keys).sortWithinPartitions(*keys, *order)


def totals(runs: DataFrame, partitions: int) -> DataFrame:
    """(part, run): all pairs of a part with their counts and marks, merged ``FAN_IN`` partitions at a time."""
    rows, width = runs.select("part", (F.col("block") / (1 << 32)).cast("long").alias("bundle"), "run"), partitions
    while True:
        width = -(-width // FAN_IN)
        rows = rows.select("part", F.floor(F.col("bundle") / FAN_IN).alias("bundle"), "run")
        rows = _together(rows, "part", "bundle").mapInArrow(_merged(width <= 1), "part int, bundle long, run binary")
        if width <= 1:
            return rows.select("part", "run")


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run the counts of its pairs, looked up in its part's totals, which come first."""
    pairs = counts = None
    for batch in batches:
        for part, block, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "run"))):
            if block < 0:
                parts = list(frames(raw))
                pairs, counts = (np.concatenate([f[k] for f in parts]) for k in (0, 1))
                continue
            found = [counts[np.searchsorted(pairs, p)] for p, _ in frames(raw)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()),
                                              "reply": pa.array([_zipped(np.concatenate(found).astype("<i8"))], pa.binary())})


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's documents (part -1, first) add up what its records and, behind them, their replies say."""
    docs = asked = None

    def made() -> pa.RecordBatch:
        names = ("doc_ids", "n_a", "n_b", "n_groups", "n_links")
        out = {("doc_id" if c == "doc_ids" else c): pa.array(docs[c], pa.int64()) for c in names}
        return pa.RecordBatch.from_pydict(out | {"n_best": pa.array(best), "count_sum": pa.array(sums),
                                                 "groups_sha256": pa.array(docs["digests"], pa.string())})
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["part"] < 0:
                if docs:
                    yield made()
                docs, best, sums = row, np.zeros(len(row["doc_ids"]), np.int64), np.zeros(len(row["doc_ids"]), np.int64)
            elif row["reply"] is None:
                asked = row
            else:
                sizes = np.concatenate([n for _, n in frames(asked["run"])])
                value, times = np.repeat(_unzipped(row["reply"], "<i8"), sizes), _unzipped(asked["times"], "<u4").astype(np.int64)
                places = _unzipped(asked["places"], "<u4")
                np.add.at(sums, places, times * (value >> 1))
                np.add.at(best, places, times * (value & 1))
    if docs:
        yield made()


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Numbers of tokens, groups, links, best links, the sum of counts and the digest of the groups, per document.

    A null or empty text, and one that either side does not give back byte by byte, has no tokens: zeros and ''. Every
    row is a document of its own, also with a null or repeated doc_id; ties for an A id's highest count are all best.
    Only doc_id and text are read. Runs are written to the shared folder, so lost executors lose none of them. A worker
    holds a block of texts (or one longer text), and later the pairs of one part.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    paths = byte_path or public_tokenizers.path(BYTE_VOCABULARY), piece_path or public_tokenizers.path(PIECE_VOCABULARY)
    blocks, _ = write_stage(source.mapInArrow(_spilled(*paths), RUNS))
    runs = blocks.filter("part >= 0").select("block", "part", "run")
    last = runs.agg(F.max("block")).first()[0]
    counts, _ = write_stage(totals(runs, 1 if last is None else (last >> 32) + 1))
    # the totals of a part go along with each bundle of its runs, so that no task gets all runs of a part
    bundle = F.floor(F.col("block") / (FAN_IN << 32))
    bundles = runs.select("part", bundle.alias("bundle")).distinct()
    sent = counts.join(bundles, "part").select("part", "bundle", F.lit(-1).cast("long").alias("block"), "run")
    asked = sent.unionByName(runs.select("part", bundle.alias("bundle"), "block", "run"))
    replies = _together(asked, "part", "bundle", order=("block",)).select("part", "block", "run").mapInArrow(
        _replies, "block long, part int, reply binary")
    answered = blocks.unionByName(replies, allowMissingColumns=True)
    return _together(answered, "block", order=("part", "reply")).mapInArrow(_documents, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
