"""Words of Arrow strings as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: 0 spaces, 1 letters, digits and all that is not ASCII, 2 other characters.
KIND = np.where(SPACE, 0, 2)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Bytes with A-Z lower-cased.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
ODD = np.random.default_rng(20240229).integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
#: Of a word with this many bytes or more, eight at a time by numpy, only these many; what follows is hashed by blake2b.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text, one row at least; what is made of a slice is gone before the next."""
    _, offsets = strings(batch.column(column))
    i = 0
    while i < len(batch):
        j = max(int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1, i + 1)
        yield batch.slice(i, j - i)
        i = j


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def tokens_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_bounds, but punctuation and other ASCII marks are runs of their own."""
    kind = KIND[data]
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    new[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(new)
    at = at[at < len(data)]
    ends = np.r_[at[1:], len(data)]
    real = kind[at] > 0
    starts, ends = at[real], ends[real]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """64-bit hashes of the words' exact bytes, A-Z as a-z if folded. Words of up to eight bytes of one length never share one.

    Each step takes the next eight bytes of all words that have some left, and mixes them in."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        # blocks of whole words bound the memory
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, side="right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        block = np.zeros(b - a + 8, np.uint8)
        block[: b - a] = FOLDED[data[a:b]] if folded else data[a:b]
        eight = np.ndarray((b - a + 1,), "<u8", block, strides=(1,))
        s, n = starts[i:j] - a, ends[i:j] - starts[i:j]
        h = n.astype(np.uint64) * ODD[0]
        live, step = np.arange(j - i), 0
        while len(live) and step < LONG:
            left = n[live] - step
            x = eight[s[live] + step]
            short = left < 8
            x[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            h[live] = mix(h[live] ^ x) + ODD[7]
            live, step = live[left > 8], step + 8
        for k in live.tolist():
            rest = hashlib.blake2b(block[s[k] + LONG : s[k] + n[k]].tobytes(), digest_size=8).digest()
            h[k] = mix(h[k] ^ np.frombuffer(rest, "<u8"))[0]
        out[i:j] = mix(h)
        i = j
    return out


def shingles(words: np.ndarray, firsts: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    rows = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        rows += words[k : k + len(rows)] * ODD[k + 1]
    rows = mix(rows)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rows[a : b - size + 1]))
        elif b > a:
            short = np.uint64(int(b - a))
            out.append(mix((words[a:b] * ODD[1 : 1 + b - a]).sum(dtype=np.uint64, keepdims=True) + short * ODD[7]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
