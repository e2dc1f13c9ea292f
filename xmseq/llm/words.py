"""Words of whole texts as 64-bit hashes, in numpy over the bytes of an Arrow column.

A word is a run of bytes other than space and \\x09-\\x0D. These separators are ASCII, so UTF-8 bytes can be looked at
without decoding. Work goes through slices of a few MB of text, so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
ROLL = np.uint64(0x9E3779B97F4A7C15)
S32, S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> S32)) * M1
    x = (x ^ (x >> S29)) * M2
    return x ^ (x >> S32)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and the offsets of its rows; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about `most` bytes each; a longer row comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1)
        yield at, to
        at = to


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes at a time; `lower` folds A-Z first."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    if lower:
        padded[(padded >= 65) & (padded <= 90)] |= 32
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) + ROLL)
    todo, at = np.arange(len(starts)), starts.astype(np.int64)
    while len(todo):
        left = ends[todo] - at
        part = eights[at]
        short = left < 8
        if short.any():
            part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[todo] = mix((out[todo] ^ part) * ROLL + np.uint64(1))
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes: position i covers i..i+k-1. Shorter by k-1 than `h`."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total, width, block, size, power = None, 0, h, 1, ROLL
    while True:
        if k & size:
            if total is None:
                total, width = block, size
            else:  # what is done so far, followed by this block
                n = len(h) - width - size + 1
                total = total[:n] * power + block[width : width + n]
                width += size
        if width == k:
            return total
        n = len(h) - 2 * size + 1
        block = block[:n] * power + block[size : size + n]
        size *= 2
        power = np.uint64(int(power) ** 2 % 2**64)


def runs(counts: np.ndarray) -> np.ndarray:
    """Position of each item within its row, for rows of `counts` items."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and their number per row; a row of fewer words has one, of all its words.

    Rows without words have none. Repeats stay.
    """
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    rolled = rolling(h, k)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(own.sum()), np.uint64)
    at = np.cumsum(own) - own
    full = counts >= k
    n = np.where(full, own, 0)
    out[np.repeat(at, n) + runs(n)] = rolled[np.repeat(first, n) + runs(n)]
    for i in np.flatnonzero(~full & (counts > 0)):
        whole = h[first[i] : first[i] + counts[i]]
        out[at[i] : at[i] + 1] = rolling(whole, len(whole)) + counts[i : i + 1].astype(np.uint64) * M1
    return mix(out), own
