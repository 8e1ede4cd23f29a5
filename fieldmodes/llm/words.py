"""Columnar word splitting shared by the text operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, the pattern
``[^\\x20\\x09-\\x0D]+``.  A batch of texts is split by Arrow kernels into one
flat array of dictionary codes, so per-word work happens once per distinct
word of a batch and everything else is NumPy over integers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
BATCH_BYTES = 2 << 20  # text handled at once inside a task


class Words(NamedTuple):
    """Text ``i`` has the words ``vocab[codes[offsets[i]:offsets[i+1]]]``."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def as_text(col) -> pa.Array:
    """A text column as one string array, null as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "")


def split_words(texts) -> Words:
    lists = pc.ascii_split_whitespace(as_text(texts))
    flat = lists.flatten()
    offs = lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=ends[1:])
    d = flat.filter(full).dictionary_encode()
    return Words(ends[offs - offs[0]], d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary)


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string's UTF-8 bytes."""
    h = xxhash.xxh64_intdigest
    raw = strings.cast(pa.binary()) if not pa.types.is_binary(strings.type) else strings
    return np.fromiter((h(b, seed) for b in raw.to_pylist()), dtype=np.uint64, count=len(raw))


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and what one stage needed adds to the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each carries about ``max_bytes`` of text (one text at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(as_text(b.column(text_col))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield b.slice(start, stop - start)
            give_back()
            start = stop


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants), salted."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def window_hash(ids: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive ids (positional, 64 bits)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mult = np.uint64(mix64(np.array([salt + 1], dtype=np.uint64))[0] | np.uint64(1))
        # doubling: hash of 2k words from two hashes of k words
        out, have, acc, pos = {1: mix64(ids, salt)}, 1, None, 0
        power = {1: mult}
        while have * 2 <= width:
            a = out[have]
            out[have * 2] = a[: len(a) - have] * power[have] + a[have:]
            power[have * 2] = power[have] * power[have]
            have *= 2
        for k in sorted(out, reverse=True):
            while width - pos >= k:
                part = out[k][pos : pos + n]
                acc = part.copy() if acc is None else acc * power[k] + part
                pos += k
        return mix64(acc)
