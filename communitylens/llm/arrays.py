"""Texts of an Arrow batch as numpy arrays: words, word hashes, and word ranges per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once (a longer text is worked on alone).
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes of the class [^\x20\x09-\x0D].
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[0x09:0x0E] = NONSPACE[0x20] = False

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_ODD1, _ODD2, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x * _ODD1
    x ^= x >> np.uint64(29)
    x *= _ODD2
    x ^= x >> np.uint64(32)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes."""
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``kept`` bytes within rows, and each row's first word (n + 1 entries)."""
    inside = kept[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        bounds = offsets[(offsets > 0) & (offsets < len(data))]
        before[bounds] = after[bounds - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def long_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one little-endian number each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    eight = long_words(data)
    left = ends - starts
    out = mix(left.astype(np.uint64) ^ _SEED)
    active, at = slice(None), starts
    while len(at):
        out[active] = mix(out[active] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        active = np.arange(len(out))[active][more]
        at, left = at[more] + 8, left[more] - 8
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive hashes, by the first one's place; row bounds are the caller's affair."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, _SEED ^ np.uint64(n))
    for k in range(n):
        out = mix(out ^ hashes[k:len(hashes) - n + 1 + k])
    return out


def starts_within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and word number of every n consecutive words that lie within one row."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return rows, np.arange(len(rows)) - np.repeat(ends - counts, counts) + np.repeat(first[:-1], counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def set_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set in a bitmap of 64-bit numbers (a power of two of them)."""
    mask = np.uint64(len(bits) * 64 - 1)
    a, b = hashes & mask, (hashes >> np.uint64(32)) & mask
    low, six = np.uint64(63), np.uint64(6)
    return ((bits[a >> six] >> (a & low)) & (bits[b >> six] >> (b & low)) & np.uint64(1)).astype(bool)
