"""Vectorised text segmentation over Arrow string buffers.

Words of many documents are cut and hashed with a handful of array operations, so that Python's
interpreter never sees a single word. Memory stays bounded: rows are taken in groups of about
GROUP bytes, and one longer document is cut into pieces at white space.

A word is identified by a 64-bit hash of its bytes, eight at a time, each step mixed (a polynomial of the bytes wouldn't do: words of the
Thue-Morse form collide for every base). Among 10 million different words the chance of any collision is about 3e-6. Words beyond
LONG bytes are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 4 << 20
PIECE = 1 << 19

#: Longer words are hashed one by one.
LONG = 256
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)
#: Masks of the first k of eight bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What is not in a word of the licence scan: ASCII but digits and lower-case letters (after lower-casing).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(32))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of data[s:e] for each range; another seed gives an independent hash."""
    length = ends - starts
    out = mix(length.astype(np.uint64) * _SEED + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((data.size + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    left, at, which = length, starts, None
    if length.size and length.max() > LONG:
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        which = np.flatnonzero(length <= LONG)
        left, at = left[which], at[which]
    while at.size:
        step = mix((eights[at] & _KEEP[np.minimum(left, 8)]) ^ (out if which is None else out[which])) * _STEP
        if which is None:
            out = step
        else:
            out[which] = step
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        left, at = left[more] - 8, at[more] + 8
    return out


def hash_words(words: list[str | bytes]) -> np.ndarray:
    """The hashes that `words` gives these words."""
    raw = [w.encode() if isinstance(w, str) else w for w in words]
    lengths = np.array([len(w) for w in raw], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return range_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), starts, ends)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, at least a row each."""
    i, n = 0, offsets.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cut(data: np.ndarray, space: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most `limit` bytes that end behind white space where there is any; else longer."""
    out, at = [], 0
    while at < data.size:
        to = at + limit
        if to >= data.size:
            to = data.size
        else:
            back = np.flatnonzero(space[data[at:to]])
            if back.size:
                to = at + int(back[-1]) + 1
            else:
                while to < data.size:
                    ahead = np.flatnonzero(space[data[to : to + limit]])
                    if ahead.size:
                        to += int(ahead[0]) + 1
                        break
                    to = min(data.size, to + limit)
        out.append((at, to))
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, lower: bool = True, hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Words of the documents data[offsets[i]:offsets[i+1]].

    Returns (starts, ends, firsts, hashes): byte ranges; document i has the words firsts[i]:firsts[i+1].
    """
    starts, ends, found = [], [], []
    breaks = np.zeros(data.size + 1, dtype=bool)
    breaks[offsets] = True
    i, n = 0, offsets.size - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1))
        base, top = int(offsets[i]), int(offsets[j])
        parts = [(0, top - base)] if top - base <= PIECE else _cut(data[base:top], space, PIECE)
        for a, b in parts:
            piece = data[base + a : base + b]
            if lower:
                piece = LOWER[piece]
            if not piece.size:
                continue
            inside = ~space[piece]
            edge = breaks[base + a : base + b + 1]
            first = inside.copy()
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | edge[1:-1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            starts.append(s + (base + a))
            ends.append(e + (base + a))
            if hashes:
                found.append(range_hashes(piece, s, e))
        i = j
    empty = np.zeros(0, np.int64)
    s = np.concatenate(starts) if starts else empty
    e = np.concatenate(ends) if ends else empty
    h = (np.concatenate(found) if found else np.zeros(0, np.uint64)) if hashes else None
    return s, e, np.searchsorted(s, offsets), h


def documents(batches: Iterator[pa.RecordBatch], text: str, limit: int = GROUP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of row groups, from the batches of mapInArrow."""
    for batch in batches:
        data, off = string_buffers(batch.column(batch.schema.get_field_index(text)))
        for i, j in row_groups(off, limit):
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
