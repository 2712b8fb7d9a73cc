"""Texts as byte arrays: runs of bytes, their hashes, and repeats among them, with memory of a few bytes a byte."""

from __future__ import annotations

import numpy as np

from .common import CODES, POWERS, mix

#: Bytes hashed at once.
CHUNK = 1 << 18


def byte_table(chars: bytes) -> np.ndarray:
    """A table of 256 flags: whether a byte is among ``chars``."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, none across the row bounds ``at``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rows_of(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each byte place lies in; empty rows hold none."""
    return np.searchsorted(at, places, side="right") - 1


def _prefixes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The polynomial hash of all bytes before each of the ascending ``places``, chunk by chunk."""
    up, _ = POWERS.upto(CHUNK + 1)
    out, carry, scale = np.zeros(len(places), np.uint64), np.uint64(0), 1
    local = np.zeros(CHUNK + 1, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(data) + 1, CHUNK):
            part = data[start:start + CHUNK]
            np.cumsum(CODES[part] * up[:len(part)], out=local[1:len(part) + 1])
            a, b = np.searchsorted(places, [start, start + CHUNK])
            out[a:b] = carry + local[places[a:b] - start] * np.uint64(scale)
            carry = carry + local[len(part)] * np.uint64(scale)
            scale = scale * pow(POWERS.base, CHUNK, 1 << 64) % (1 << 64)
    return out


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs (ascending starts, ascending ends): equal runs have equal hashes."""
    _, down = POWERS.upto(CHUNK + 1)
    chunks = np.arange(len(data) // CHUNK + 1)
    far = np.array([pow(POWERS.inverse, int(k) * CHUNK, 1 << 64) for k in chunks], np.uint64)
    with np.errstate(over="ignore"):
        back = down[starts % CHUNK] * far[starts // CHUNK]
        value = (_prefixes(data, ends) - _prefixes(data, starts)) * back
        return mix(value ^ mix((ends - starts).astype(np.uint64)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that occur twice or more, and whether each of them is a key's first one."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    places = np.flatnonzero(twice[slot] == keys)
    first = np.zeros(len(places), bool)
    first[np.unique(slot[places], return_index=True)[1]] = True
    return places, first


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the windows of ``length`` places at ``starts``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0
