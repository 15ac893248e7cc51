"""Hashed n-gram counts of whole documents, as dense rows, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from veilframe.llm.common import BLOCK, LOWER, blocks, text_bytes, words

#: Counts of repetition that end a row of quality_features.
REPETITIONS = 4
#: Documents whose dense rows are held at once.
ROWS = 256

#: Classes of bytes: the shape of a text apart from its letters.
SHAPE = np.full(256, 7, np.uint8)
SHAPE[97:123] = 1
SHAPE[65:91] = 2
SHAPE[48:58] = 3
SHAPE[128:] = 1
SHAPE[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
SHAPE[0x0A] = 5
for _mark, _class in zip(b".,!?|#*$%&<>", (6, 6, 8, 9, 10, 11, 12, 13, 14, 15, 10, 10), strict=True):
    SHAPE[_mark] = _class


def dense_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of blocks of at most ROWS documents."""
    data, offsets = text_bytes(column)
    for lo, hi in blocks(offsets, BLOCK):
        for a in range(lo, hi, ROWS):
            b = min(a + ROWS, hi)
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def ngram_counts(data: np.ndarray, offsets: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Counts of the byte n-grams of each document by hash bucket: documents x 2**bits."""
    docs = len(offsets) - 1
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros((docs, 1 << bits), np.float32)
    code = data[:n].astype(np.uint64)
    for j in range(1, width):
        code |= data[j : n + j].astype(np.uint64) << np.uint64(8 * j)
    with np.errstate(over="ignore"):
        code *= np.uint64(0x9E3779B97F4A7C15)
    slot = (code >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    inside = owner[:n] == owner[width - 1 : n + width - 1]
    slot += owner[:n] << bits
    return np.bincount(slot[inside], minlength=docs << bits).reshape(docs, 1 << bits).astype(np.float32)


def language_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Unit rows of square roots of the counts of lower-cased bigrams and trigrams."""
    low = LOWER[data]
    rows = np.concatenate([np.sqrt(ngram_counts(low, offsets, n, bits)) for n in (2, 3)], axis=1)
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


def quality_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Term counts of documents: byte trigrams, shape 4-grams, and four counts of repetition."""
    hashes, _, bounds = words(data, offsets)
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    extra = np.zeros((docs, REPETITIONS), np.float32)
    for k, gap in enumerate((1, 2, 3)):
        same = (hashes[gap:] == hashes[:-gap]) & (owner[gap:] == owner[:-gap])
        extra[:, k] = np.bincount(owner[gap:][same], minlength=docs)
    # words that are not the first of their kind beyond what a long text has anyway
    order = np.lexsort((hashes, owner))
    again = np.bincount(owner[order][1:][(hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])], minlength=docs) if len(hashes) else np.zeros(docs)
    extra[:, 3] = np.maximum(0, again - 0.7 * np.diff(bounds))
    shape = SHAPE[data]
    return np.concatenate([ngram_counts(data, offsets, 3, bits), ngram_counts(shape, offsets, 4, bits - 1), extra], axis=1)
