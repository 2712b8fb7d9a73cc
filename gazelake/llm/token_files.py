"""Token ids in binary files: word-aligned packing of whole documents, with offsets.

A file row is a segment of consecutive documents. Its ids are cut into blocks of
``BLOCK`` ids. A block is a run of 64-bit words: the top four bits select how many
ids the word holds and in how many bits each. Ids too wide for a word go to the
segment's ``escapes``; the word keeps their index. ``word_offsets`` gives each
block's first word, so blocks are decoded independently, and the words of a
selector all at once.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from .common import held, joined, slices, stage_path, table

BLOCK = 1024
#: Ids per word and bits per id, by selector; selector 0 is an escape.
PACKS = [(1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
         (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in PACKS], np.int64)
#: Cached words of a worker, at most.
CACHE = 800_000
#: What a byte is to the pre-tokenizer: white space between pieces, a letter, an ASCII mark, the apostrophe, or any other.
SPACE, LETTER, MARK, APOSTROPHE = 1, 2, 3, 4
KINDS = bytes(SPACE if c in " \n" else APOSTROPHE if c == "'" else MARK if c in string.punctuation else 0 for c in map(chr, range(256)))
END = 1
VOCABULARY = "word_bpe_49k.json"
FILE_SCHEMA = ("part int, seq int, first long, doc_ids array<bigint>, doc_tokens array<bigint>, n_ids long, "
               "word_offsets binary, words binary, escapes binary")


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place, the selector that takes most ids from there on; fewer than a word holds are enough at a block's end."""
    n, top, widths = len(ids), int(ids.max()), PACKS[1:]
    blocks = -(-n // BLOCK)
    # how many of the widths are too narrow for the widest of the next ids; nothing follows a block
    narrow = np.zeros(blocks * BLOCK, np.uint8)
    for _, bits in widths:
        if top >> bits:
            narrow[:n] += ids >= ids.dtype.type(1 << bits)
    widest = np.zeros((blocks, BLOCK + widths[0][0] - 1), np.uint8)
    widest[:, :BLOCK] = narrow.reshape(blocks, BLOCK)
    fitting, seen = np.zeros((blocks, BLOCK), np.uint8), 1
    for selector in range(len(widths), 0, -1):
        more = PACKS[selector][0] - seen
        if more:
            widest, seen = np.maximum(widest[:, :-more], widest[:, more:]), seen + more
        fitting += widest[:, :BLOCK] < selector
    # who takes more ids has narrower ones: the selectors that fit are the last ones
    return ((len(PACKS) - fitting) % len(PACKS)).ravel()[:n]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escaped ids, for unsigned 64-bit ``ids``.

    At each place the selector that takes most ids is known at once for all
    places; the blocks are then walked side by side, a word a step.
    """
    ids = np.asarray(ids)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    choice = _selectors(ids)
    at, begins = np.arange(0, n, BLOCK), np.zeros(n, bool)
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        begins[at] = True
        at = at + COUNTS[choice[at]]
        live = at < ends
        at, ends = at[live], ends[live]
    starts, ids, escapes = np.flatnonzero(begins), ids.astype(np.uint64), np.flatnonzero(choice == 0)
    chosen, words = choice[starts], np.zeros(len(starts), np.uint64)
    stops = np.minimum(starts + COUNTS[chosen], np.minimum((starts // BLOCK + 1) * BLOCK, n))
    for selector, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero(chosen == selector)
        if not len(mine):
            continue
        if selector == 0:
            words[mine] = np.searchsorted(escapes, starts[mine]).astype(np.uint64)
            continue
        first, last = starts[mine], stops[mine]
        word = np.full(len(mine), np.uint64(selector << 60))
        for k in range(count):
            inside = first + k < last
            word[inside] |= ids[first[inside] + k] << np.uint64(k * bits)
        words[mine] = word
    return words, np.searchsorted(starts, np.arange(0, n, BLOCK)).astype(np.uint32), ids[escapes]


def unpack(words: np.ndarray, word_offsets: np.ndarray, n_ids: int, escapes: np.ndarray) -> np.ndarray:
    """All ids of a segment; the words of one selector are decoded together."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    block = np.searchsorted(word_offsets, np.arange(len(words)), side="right") - 1
    first = before - before[word_offsets[block]] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n_ids)
    for selector, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero(selectors == selector)
        if not len(mine):
            continue
        if selector == 0:
            out[first[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        for k in range(count):
            inside = mine[first[mine] + k < stop[mine]]
            out[first[inside] + k] = (words[inside] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out


class WordIds:
    """The library's ids of the pieces of texts, kept per worker.

    Pieces are what the pre-tokenizer parts anyway, so they are encoded
    independently of each other: white space never survives it, and no match of
    its pattern goes from a letter to a mark or from a mark (but the apostrophe)
    to a letter. That holds for ``letters``, which the normalizer turns into one
    letter each whatever is beside them. A piece of nothing else is one word of
    the model, which is asked for it without normalizing it again.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        # a word is asked for once
        self.model = self.tokenizer.model
        self.model._resize_cache(0)
        self.letters = self._letters()
        self.plain = re.compile(f"[{''.join(self.letters)}]+")
        self.word = str.maketrans({c: self._parts(x)[0] for c, x in self.letters.items()})
        self.kinds, self.fold, self.pairs = bytearray(KINDS), bytearray(range(256)), np.zeros((256, 256), bool)
        for c, x in self.letters.items():
            code = c.encode()
            if len(code) == 1:
                self.kinds[code[0]], self.fold[code[0]] = LETTER, ord(x)
            else:
                self.pairs[tuple(code)] = True
        self._forget()

    def _parts(self, text: str) -> list[str]:
        return [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _letters(self) -> dict[str, str]:
        """Letters of one or two bytes with their normal forms; none of them is ever joined with the letter before it."""
        forms = {}
        for c in filter(str.isalpha, map(chr, range(0x530))):
            x = self.tokenizer.normalizer.normalize_str(c)
            if unicodedata.category(c) in ("Lu", "Ll") and unicodedata.category(x[0]) == "Ll" and len(x) == len(self._parts(f"a{x}a")) == 1:
                forms[c] = x
        return forms

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.stop = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        rest = [p for p in pieces if not self.plain.fullmatch(p)]
        found = dict(zip(rest, [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]))
        ids, stop = [], []
        for piece in pieces:
            self.place[piece] = len(self.place)
            ids += found[piece] if piece in found else [t.id for t in self.model.tokenize(piece.translate(self.word))]
            stop.append(len(ids))
        self.stop = np.append(self.stop, len(self.ids) + np.array(stop, np.int64))
        self.ids = np.append(self.ids, np.array(ids, np.uint32))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and the number of them before each text and in all."""
        data, at = joined(pc.binary_join_element_wise(texts, "", "\n"))
        # capitals of ASCII, unless a mark may go with them
        data = np.where(np.append(data[1:], np.uint8(0)) < 128, _mapped(data, self.fold), data)
        kind, high = _mapped(data, self.kinds), np.flatnonzero(data >= 128)
        gap, mark, letter_ends = kind == SPACE, kind >= MARK, kind == LETTER
        letter_begins = letter_ends.copy()
        letter_ends[high], letter_begins[high] = self.pairs[data[high - 1], data[high]], self.pairs[data[high], data[high + 1]]
        begins = np.ones(len(data), bool)
        begins[1:] = gap[:-1] | letter_ends[:-1] & mark[1:] | (kind[:-1] == MARK) & letter_begins[1:]
        begins &= ~gap
        kept = data[~gap]
        bounds = np.append(np.flatnonzero(begins[~gap]), len(kept))
        pieces = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
        return pieces, np.searchsorted(np.flatnonzero(begins), at)

    def rows(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts (null: empty); pieces that are not known yet are encoded once."""
        if not len(texts):
            return []
        if len(self.place) > CACHE:
            # before the pieces of these texts are looked up
            self._forget()
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        pieces, before = self._cut(pc.if_else(pa.array(~whole), texts, ""))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([p for p in distinct if p not in self.place])
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        first, n = self.stop[place], self.stop[place + 1] - self.stop[place]
        stop = np.append(0, np.cumsum(n))
        ids = self.ids[np.repeat(first - stop[:-1], n) + np.arange(stop[-1])]
        rows = np.split(ids, stop[before[1:-1]])
        for k in np.flatnonzero(whole):
            rows[k] = np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        return rows

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [ids.astype("<u4").tobytes() for ids in self.rows(pa.array(texts, pa.string()))]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def word_ids(path: str) -> WordIds:
    return held(WordIds, path)


def _segments(path: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, part, seq, first = word_ids(path), TaskContext.get().partitionId(), 0, 0
        last = np.array([end], np.uint32)
        for batch in batches:
            for part_batch in slices(batch, "text"):
                rows = words_of.rows(part_batch.column("text"))
                counts = [len(ids) + 1 for ids in rows]
                ids = np.concatenate([x for ids in rows for x in (ids, last)])
                words, at, escapes = pack(ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": pa.array([first]),
                    "doc_ids": pa.array([part_batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "doc_tokens": pa.array([counts], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)]),
                    "word_offsets": pa.array([at.astype("<u4").tobytes()], pa.binary()),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    "escapes": pa.array([escapes.astype("<u8").tobytes()], pa.binary())})
                seq, first = seq + 1, first + len(ids)
    return write


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Encode ``docs`` (doc_id, text) and write the segments to ``path`` in ascending doc_id order.

    File ``i`` holds smaller ids than file ``i + 1``. A null text is empty (the
    end id alone), a null doc_id comes first, rows with the same doc_id lie next
    to each other, ordered by text. Other columns are not read. Spark's commit makes lost tasks harmless.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(_segments(tokenizer or public_tokenizers.path(VOCABULARY), end), FILE_SCHEMA).write.parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["word_offsets"], "<u4"), row["n_ids"],
                         np.frombuffer(row["escapes"], "<u8")).astype("<u4")
            stop = np.cumsum(row["doc_tokens"])
            start = stop - np.array(row["doc_tokens"])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([row["part"]] * len(stop), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(start + row["first"]), "n_tokens": pa.array(stop - start),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(start, stop)], pa.int64())})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens and the checksum of its ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written file
    shift = files.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    docs = files.mapInArrow(_digests, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(shift), "part").select(
        "doc_id", (F.col("start") + F.col("_shift")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Write all documents to token files on the shared storage and describe them from there."""
    path = stage_path(docs.sparkSession)
    write_token_files(docs, path, tokenizer, end)
    return read_token_files(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
