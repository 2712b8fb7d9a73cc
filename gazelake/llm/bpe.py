"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has exactly one last token in its BPE encoding.
Keeping that token for each prefix is the whole state: the last token of the next
prefix is the only vocabulary entry that ends there and stands validly behind the
last token of the prefix it leaves. Appending goes on from the last prefix, an
edit goes on from its first byte and ends where the old column is met again.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import held, slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Cached units of a worker, and cached pieces, at most.
CACHE = 300_000
#: The characters with the property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: White space and what follows it up to the next white space: no match of the
#: vocabulary's pattern crosses the end of such a unit.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


class Vocabulary:
    """Ranks, the two parts each token was merged from, and which tokens may stand side by side."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.parts = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._parts()

    def _merge_down(self, token: bytes) -> list[bytes]:
        """Merge single bytes by rank until two parts (or no further merge) are left."""
        pieces = [token[i:i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            ranks = [self.ranks.get(a + b, len(self.ranks)) for a, b in zip(pieces, pieces[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == len(self.ranks):
                break
            pieces[k:k + 2] = [pieces[k] + pieces[k + 1]]
        return pieces

    def _parts(self) -> None:
        for token, rank in self.ranks.items():
            pieces = self._merge_down(token) if len(token) > 1 else []
            if len(pieces) == 2:
                self.parts[rank] = (self.ranks[pieces[0]], self.ranks[pieces[1]])

    @functools.cached_property
    def reachable(self) -> set[int]:
        """Tokens that are the encoding of their own bytes."""
        return {i for i, t in self.bytes.items() if len(t) == 1 or i in self.parts}

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens.

        Undo the merges at the border, the latest first. A merge across the border
        that comes before the one just undone would have been made instead.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self._side_by_side(left, right)
        return known

    def _side_by_side(self, left: int, right: int) -> bool:
        # merges across the border count if made before `limit`; on a tie the one further left is made
        limit = len(self.ranks) + 1
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < limit:
                return False
            undo_left = left in self.parts and (left > right or right not in self.parts)
            if undo_left:
                limit, left = left, self.parts[left][1]
            elif right in self.parts:
                limit, right = right + 1, self.parts[right][0]
            else:
                return True


class PrefixTable:
    """The encoding of one piece: for each byte prefix, its last token.

    ``append`` and ``replace`` keep the table exact; ``work`` counts the prefixes
    that they had to look at.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last, self.work = vocabulary, b"", [], 0
        self.append(data)

    def _token_at(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        self.work += 1
        for start in range(max(0, end - v.longest), end):
            token = v.ranks.get(data[start:end])
            if token is not None and token in v.reachable and (not start or v.side_by_side(last[start - 1], token)):
                return token
        raise ValueError(f"no token ends at byte {end}")

    def append(self, data: bytes) -> None:
        start, self.data = len(self.data), self.data + data
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._token_at(end))

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Replace bytes ``[start, stop)``; prefixes before ``start`` stay as they are.

        Behind the edit, the old column holds again once every token of the
        longest length that could reach back to the edit has come out as before.
        """
        tail, old = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start] + data + tail, self.last[:start]
        settled = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._token_at(end)
            self.last.append(token)
            at = end - start - len(data) - 1
            settled = settled + 1 if at >= 0 and old[at] == token else 0
            if settled > self.vocabulary.longest:
                self.last += old[at + 1:]
                return

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Batch:
    """Prefix tables of many short pieces side by side, a byte a step for all of them.

    Tokens that end at a byte are found backwards through a trie of reversed tokens; of those, the one that may
    stand behind the last token of the prefix it leaves is the last token here. Pairs of tokens are looked up in
    a table of fixed size and worked out once if they are not there.
    """

    #: Pieces up to this many bytes, and places in the table of pairs.
    LONGEST, PAIRS = 32, 1 << 20

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        states, edges, self.sizes = {b"": 0}, {}, np.zeros(len(vocabulary.ranks), np.int64)
        tokens = {}
        for token, i in vocabulary.ranks.items():
            self.sizes[i] = len(token)
            if len(token) > self.LONGEST or i not in vocabulary.reachable:
                continue
            state = 0
            for k in range(len(token) - 1, -1, -1):
                ending = token[k:]
                if ending not in states:
                    states[ending] = len(states)
                    edges[state << 8 | token[k]] = states[ending]
                state = states[ending]
            tokens[state] = i
        self.edges = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.token = np.full(len(states), -1, np.int64)
        self.token[list(tokens)] = list(tokens.values())
        self.numbers = list(range(len(vocabulary.ranks)))
        self.keys, self.fits = np.full(self.PAIRS, -1, np.int64), np.zeros(self.PAIRS, bool)

    def _side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        slot = (keys * 0x9E3779B1 >> 11) & (self.PAIRS - 1)
        missing = np.flatnonzero(self.keys[slot] != keys)
        out = self.fits[slot]
        if len(missing):
            new, at = np.unique(keys[missing], return_inverse=True)
            made = np.array([self.vocabulary._side_by_side(k >> 20, k & 0xFFFFF) for k in new.tolist()], bool)
            out[missing] = made[at]
            place = (new * 0x9E3779B1 >> 11) & (self.PAIRS - 1)
            self.keys[place], self.fits[place] = new, made
        return out

    def ids(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, none of them empty or longer than ``LONGEST``."""
        if not pieces:
            return []
        sizes = np.array(list(map(len, pieces)))
        order = np.argsort(-sizes, kind="stable")
        sizes, width = sizes[order], int(sizes.max())
        data = np.zeros((len(pieces), width), np.uint8)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8)
        # last[:, e] is the last token of the first e bytes
        last = np.full((len(pieces), width + 1), -1, np.int64)
        for end in range(1, width + 1):
            live = np.arange(int(np.searchsorted(-sizes, -end, side="right")))
            state, found = np.zeros(len(live), np.int64), []
            for back in range(1, end + 1):
                edge = state << 8 | data[live, end - back]
                at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                go = self.edges[at] == edge
                live, state = live[go], self.next[at[go]]
                if not len(live):
                    break
                token = self.token[state]
                has = token >= 0
                found.append((back, live[has], token[has]))
            for back, who, token in reversed(found):
                open_ones = last[who, end] < 0
                who, token = who[open_ones], token[open_ones]
                if back < end:
                    fits = self._side_by_side(last[who, end - back], token)
                    who, token = who[fits], token[fits]
                last[who, end] = token
        # back from the end, all pieces at once
        out, steps, rows, end = [None] * len(pieces), [], np.arange(len(pieces)), sizes.copy()
        while len(rows):
            token = last[rows, end[rows]]
            steps.append((rows, token))
            end[rows] -= self.sizes[token]
            rows = rows[end[rows] > 0]
        rows, token = (np.concatenate([s[k] for s in steps[::-1]]) for k in (0, 1))
        by_row = np.argsort(rows, kind="stable")
        ends = np.cumsum(np.bincount(rows, minlength=len(pieces)))
        # the same number object for the same token
        flat = [*map(self.numbers.__getitem__, token[by_row].tolist())]
        start = 0
        for i, stop in zip(order.tolist(), ends.tolist()):
            out[i] = flat[start:stop]
            start = stop
        return out


class Encoder(dict):
    """Units of text to their ids, kept per worker."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        super().__init__()
        self.vocabulary, self.pattern, self.pieces = Vocabulary(path), regex.compile(pattern), {}
        self.batch = Batch(self.vocabulary)
        self.names = [str(i) for i in range(len(self.vocabulary.ranks))]

    def cut(self, unit: str) -> list[str]:
        """The matches of the pattern in a unit."""
        # a space and letters are one match; letters of later alphabets are left to the pattern
        if unit[0] == " " and unit[1:].isalpha() and max(unit) < "\u0530":
            return [unit]
        return self.pattern.findall(unit)

    def learn(self, units: set[str]) -> None:
        """Encode the units that are not known yet together, each distinct piece once."""
        if len(self) > CACHE:
            self.clear()
            self.pieces.clear()
        new = [(u, self.cut(u)) for u in units if u not in self]
        pieces = {p: p.encode("utf-8", "replace") for _, cut in new for p in cut if p not in self.pieces}
        short = {p: raw for p, raw in pieces.items() if len(raw) <= Batch.LONGEST}
        self.pieces.update(zip(short, self.batch.ids(list(short.values()))))
        # longer pieces are filled one by one
        self.pieces.update((p, PrefixTable(self.vocabulary, raw).ids()) for p, raw in pieces.items() if p not in short)
        for unit, cut in new:
            self[unit] = self.pieces[cut[0]] if len(cut) == 1 else [i for p in cut for i in self.pieces[p]]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        cut = list(map(UNIT.findall, texts))
        self.learn(set().union(*cut))
        return [list(chain.from_iterable(map(self.__getitem__, units))) for units in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """Digests of the ids and of the decoded bytes."""
        text = " ".join(map(self.names.__getitem__, ids))
        return hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def encoder(path: str) -> Encoder:
    return held(Encoder, path)


def _roundtrips(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = e.encode_all(texts)
                got = list(map(e.digests, ids))
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(list(map(len, ids)), pa.int64()),
                       "ids_sha256": pa.array([x[0] for x in got], pa.string()), "decoded_sha256": pa.array([x[1] for x in got], pa.string())}
                if with_ids:
                    ends = np.cumsum([0] + list(map(len, ids))).astype(np.int32)
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_pydict(out)
    return run


def _mapped(docs: DataFrame, vocabulary: str | None, with_ids: bool) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return source.mapInArrow(_roundtrips(vocabulary or public_tokenizers.path(VOCABULARY), with_ids), shape)


def token_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, the ids of each whole text, and the digests of ``bpe_roundtrip``."""
    return _mapped(docs, vocabulary, True)


def bpe_roundtrip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, digests of ids and decoded bytes.

    A null text is empty; rows are kept one for one, null and repeated doc_ids too; other columns are not read.
    """
    return _mapped(docs, vocabulary, False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"))
