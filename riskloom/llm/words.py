"""Texts of an Arrow batch cut into words or lines on their bytes, without an object per word."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)


def byte_set(*values: int) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(values)] = True
    return held


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (none null), and where each begins; the last number is the end."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def cut(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of ``inside`` bytes that stay within a text, and the number of the first run of each text (last: of all)."""
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    breaks = begins[1 : len(data)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | breaks
    last[:-1] &= ~inside[1:] | breaks
    starts = np.flatnonzero(first)
    offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts))
    return _strings(offsets, data[inside]), np.searchsorted(starts, bounds)


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines between newlines: their texts, text numbers, and where they begin and end."""
    breaks = np.flatnonzero(data == 10)
    own = np.concatenate([np.searchsorted(bounds, breaks, "right") - 1, np.arange(len(bounds) - 1)])
    order = np.lexsort((np.concatenate([breaks, bounds[1:]]), own))
    ends, row = np.concatenate([breaks, bounds[1:]])[order], own[order]
    is_first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    starts = np.where(is_first, bounds[row], np.append(0, ends[:-1] + 1))
    kept = np.append(0, np.cumsum(data != 10))
    return _strings(np.append(kept[starts], kept[-1]), data[data != 10]), row, starts, ends


def numbered(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each string in the list of different ones, and that list."""
    if not len(strings):
        return np.zeros(0, np.int64), strings
    d = strings.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def pairs(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, int]:
    """Numbers of the different pairs (exact), and how many there are; ``b`` is below ``n_b``."""
    codes, found = pd.factorize(a * n_b + b)
    return codes.astype(np.int64), len(found)


def seed_mix(x: np.ndarray) -> np.ndarray:
    """A full-width hash of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
