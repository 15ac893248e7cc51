"""Packing tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END_ID = 4096, 2
#: Documents that are packed together, on average.
GROUP = 4096
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: White space to Python's split() but not to the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The tokenizer's pattern (a fixed value), and words whose normal form is simple:
#: printable ASCII, or with Latin letters of one form.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = regex.compile(_PATTERN)
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ASCII = re.compile("[!-~]+")
_LATIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: its own where
    that is printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + k for k, b in enumerate(rest)}


_LETTERS = byte_letters()
_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer with a memory of words.

    Its pattern never matches across white space, and white space yields no ids,
    so a text's ids are those of its words one after the other. Texts in which
    that may not hold (special tokens, control characters) are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        tokenize, known, rest = self.whole.model.tokenize, self.known, []
        for word in new:
            if _ASCII.fullmatch(word):
                parts = _SPLIT_ASCII.findall(word.lower())
            elif _LATIN.fullmatch(word):
                low = unicodedata.normalize("NFC", word).lower()
                parts = [x.encode().decode("latin-1").translate(_LETTERS) for x in _SPLIT.findall(low)]
            else:
                rest.append(word)
                continue
            ids = [token.id for part in parts for token in tokenize(part)]
            known[word] = struct.pack(f"<{len(ids)}I", *ids)
        for lo in range(0, len(rest), 2000):
            self._learn_whole(rest[lo : lo + 2000])

    def _learn_whole(self, some: list[str]) -> None:
        got = self.whole.encode(" ".join(some), add_special_tokens=False)
        ids = np.asarray(got.ids, "<u4")
        begins = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
        at = np.fromiter((x[0] for x in got.offsets), np.int64, len(ids))
        to = np.append(np.searchsorted(at, begins), len(ids))
        raw = ids.tobytes()
        for k, word in enumerate(some):
            self.known[word] = raw[4 * to[k] : 4 * to[k + 1]]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if _SPECIAL.search(text) or _ODD_SPACE.search(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split()
        known = self.known
        try:
            return b"".join([known[w] for w in parts])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            self._learn([w for w in dict.fromkeys(parts) if w not in known])
            return b"".join([known[w] for w in parts])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, ident: str, text: str, path: str, sequence: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the
    end id, cut every `sequence` ids."""
    end = np.asarray([end_id], "<u4").tobytes()
    step = 4 * sequence

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(value.as_py() or "") + end
                for lo in range(0, len(ids), step):
                    part = ids[lo : lo + step]
                    for to, x in zip(out, (doc, lo // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, items by falling length, ties by position.

    A tournament tree over the bins holds the largest free capacity below each
    node; the first bin that takes an item is found by one walk from the root.
    """
    n = len(lengths)
    order = np.lexsort((np.arange(n), -lengths))
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in order.tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= need
        node //= 2
        while node:
            a, b = free[2 * node], free[2 * node + 1]
            top = a if a > b else b
            if free[node] == top:
                break
            free[node] = top
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP, seed: int = 17) -> DataFrame:
    """Pack documents into sequences of at most `sequence` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens. A document longer than a sequence is
    cut every `sequence` tokens; its full pieces are sequences of their own. The
    pieces are dealt by a seeded hash into groups of about `group` documents, and
    the last pieces of each group are packed by first-fit decreasing.

    Null and empty texts are the end id alone. Rows that repeat an id are packed
    as documents of their own; ties in length are broken by id. Other columns are
    ignored. An empty table gives no rows. A null id is kept as null.
    """
    path = path or tokenizer_path()
    pieces = cut(token_pieces(docs, ident, text, path, sequence, end_id), "pieces")
    groups = max(1, -(-pieces.where(f"start + length = doc_tokens").count() // group))
    key = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed), F.col("doc_tokens"), F.col("start")), F.lit(groups)).cast("long")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = part["length"].to_numpy()
        full = lengths == sequence
        bins, offsets = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        bins[~full], offsets[~full] = first_fit_decreasing(lengths[~full], sequence)
        used = bins[~full].max() + 1 if (~full).any() else 0
        bins[full] = used + np.arange(full.sum())
        part["sequence_id"] = (int(part["g"].iloc[0]) << 32) + bins
        part["offset"] = offsets
        part["sequence_tokens"] = part.groupby("sequence_id")["length"].transform("sum")
        return part.drop(columns="g")

    keyed = pieces.withColumn("g", key)
    return keyed.groupBy("g").applyInPandas(fill, PIECE + ", sequence_id long, offset long, sequence_tokens long")
