"""Removal of byte strings that also stand in an earlier document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import BYTE_CODE, cut, free_name, group_min, mix, partitions, remove, text_bytes
from veilframe.llm.gsaca import suffix_array

#: Bytes of a repeated string, and of the anchor within it.
LENGTH, ANCHOR = 50, 16
_REACH = LENGTH - ANCHOR
#: Bytes of text that are worked on at once.
SLICE = 1 << 19
_BITS = np.uint64(22)
#: Anchors and text pieces of a bucket on average, and fewest buckets.
BUCKET_ANCHORS, BUCKET_PIECES, BUCKETS = 1_200_000, 60_000, 48
#: Pieces of which the suffixes are ordered at once; a group of more stays whole.
ORDERED = 256
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, doc, q, a, b) of the anchors of documents, q, a and b from the
    document's start: the strings of LENGTH bytes that start at a..b have the same
    least anchor, the ANCHOR bytes at q. Which anchor a string has depends on its
    bytes alone, so equal strings have equal anchors at the same place."""
    got = []
    docs = len(offsets) - 1
    lo = 0
    while lo < docs:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi == lo + 1 and end - begin > SLICE:  # one long text, in overlapping parts
            for at in range(begin, end - LENGTH + 1, SLICE):
                h, _, q, a, b = _anchors(data[at : min(end, at + SLICE + LENGTH - 1)], np.array([0, min(end, at + SLICE + LENGTH - 1) - at]))
                shift = at - begin
                got.append((h, np.full(len(h), lo), q + shift, a + shift, b + shift))
        else:
            h, d, q, a, b = _anchors(data[begin:end], offsets[lo : hi + 1] - begin)
            got.append((h, d + lo, q, a, b))
        lo = hi
    if not got:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    with np.errstate(over="ignore"):
        h, r, width = BYTE_CODE[data], _STEP, 1
        while width < ANCHOR:
            h = h[:-width] + h[width:] * r
            r, width = r * r, 2 * width
        h = mix(h)
    low = (np.uint64(1) << _BITS) - np.uint64(1)
    best = h & ~low | np.arange(len(h), dtype=np.uint64)
    span, width = _REACH + 1, 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[:n], best[span - width : span - width + n])
    at = (best & low).astype(np.int64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    good = owner[:n] == owner[LENGTH - 1 : n + LENGTH - 1]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:n] != owner[: n - 1]) | ~good[:-1]
    starts = np.flatnonzero(new & good)
    if not len(starts):
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    change = np.flatnonzero(new | ~good)
    nxt = np.searchsorted(change, starts, "right")
    ends = np.where(nxt < len(change), change[np.minimum(nxt, len(change) - 1)], n) - 1
    doc, q = owner[starts], at[starts]
    return h[q], doc, q - offsets[doc], starts - offsets[doc], ends - offsets[doc]


# ---------------------------------------------------------------- anchors that repeat


#: Kinds of a bucket's rows: what is still to be decided there, and what is known.
ASKED, KNOWN = 0, 1


def _pack_anchors(buckets: int):
    """Anchors of a batch, packed by bucket of the hash. Of equal texts in the batch
    only the smallest id takes part. An anchor that stands in several texts of the
    batch is known to repeat: its places are listed as such, and one is sent to the
    bucket for all, so a frequent anchor sends a row a batch and not one a document."""

    def run(batches):
        for batch in batches:
            ident, code = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            data, offsets = text_bytes(batch.column(1))
            by = np.lexsort((ident, code))
            keep = np.zeros(len(ident), bool)
            keep[by[np.concatenate([[True], code[by][1:] != code[by][:-1]])]] = True
            h, doc, q, _, _ = anchors(data, offsets)
            some = keep[doc]
            h, doc, q = h[some], doc[some], q[some]
            if not len(h):
                continue
            by = np.lexsort((q, doc, h))
            h, doc, q = h[by], doc[by], q[by]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            number = np.cumsum(first) - 1
            several = np.bincount(number[first | np.concatenate([[True], doc[1:] != doc[:-1]])])[number] > 1
            yield from _blobs(h, ident, code, doc, q, first & several, ~several | first, buckets)
            if several.any():
                home = int(mix(ident[doc[:1]].astype(np.uint64))[0] % np.uint64(buckets))
                blob = np.int64(several.sum()).tobytes() + ident[doc[several]].tobytes() + q[several].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([KNOWN], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])

    return run


def _blobs(h, ident, code, doc, q, flag, sent, buckets: int):
    h, doc, q, flag = h[sent], doc[sent], q[sent], flag[sent]
    bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((doc, bucket))
    to = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(to)).tolist():
        i = by[to[k] : to[k + 1]]
        owners, counts = np.unique(doc[i], return_counts=True)
        place = q[i].astype(np.uint32)
        head = np.array([len(owners), len(i)], np.int64).tobytes()
        short = (h[i] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        blob = b"".join([head, ident[owners].tobytes(), code[owners].tobytes(), counts.astype(np.uint32).tobytes(), (place & 0xFFFF).astype(np.uint16).tobytes(), (place >> 16).astype(np.uint16).tobytes(), np.packbits(flag[i]).tobytes(), short.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([ASKED], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])


def _unpack_anchors(blob: bytes) -> tuple[np.ndarray, ...]:
    owners, n = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16
    ident = np.frombuffer(blob, np.int64, owners, at)
    code = np.frombuffer(blob, np.uint64, owners, at := at + 8 * owners)
    counts = np.frombuffer(blob, np.uint32, owners, at := at + 8 * owners)
    low = np.frombuffer(blob, np.uint16, n, at := at + 4 * owners)
    high = np.frombuffer(blob, np.uint16, n, at := at + 2 * n)
    flag = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at := at + 2 * n), count=n).astype(bool)
    short = np.zeros((n, 8), np.uint8)
    short[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, at + -(-n // 8)).reshape(n, 5)
    return short.reshape(-1).view(np.uint64), np.repeat(code, counts), np.repeat(ident, counts), low.astype(np.int64) | high.astype(np.int64) << 16, flag


def _repeated(batches):
    """(doc_id, q) of anchors that stand in two or more different texts. Equal texts
    have equal anchors; the smallest id stands for all."""
    got = []
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = blob.as_py()
            if kind == ASKED:
                got.append(_unpack_anchors(raw))
                continue
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            yield from _places(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64))
    if not got:
        return
    h, code, ident, q, flag = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    by = np.lexsort((ident, code, h))
    h, code, ident, q, flag = h[by], code[by], ident[by], q[by], flag[by]
    group = np.concatenate([[True], h[1:] != h[:-1]])
    text = group | np.concatenate([[True], code[1:] != code[:-1]])
    number = np.cumsum(group) - 1
    several = (np.bincount(number[text]) > 1) | (np.bincount(number, flag) > 0)
    first = ident[np.flatnonzero(text)[np.cumsum(text) - 1]]
    keep = several[number] & (ident == first) & ~flag
    yield from _places(ident[keep], q[keep])


def _places(ident: np.ndarray, q: np.ndarray):
    for lo in range(0, len(q), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(ident[lo : lo + 200_000]), pa.array(q[lo : lo + 200_000])], names=["doc_id", "q"])


# ---------------------------------------------------------------- pieces of text


def _rows(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bytes around anchors at `at`, `left` before and `right` after them, zeros beyond."""
    span = np.arange(-_REACH, ANCHOR + _REACH)
    inside = (span >= -left[:, None]) & (span < ANCHOR + right[:, None])
    return np.where(inside, data[np.clip(at[:, None] + span, 0, max(len(data) - 1, 0))], np.uint8(0))


def _signature(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    width = -(-rows.shape[1] // 8)
    words = np.zeros((len(rows), 8 * width), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(np.uint64)
    with np.errstate(over="ignore"):
        total = mix(left.astype(np.uint64) * np.uint64(257) + right.astype(np.uint64) + np.uint64(1))
        for k in range(width):
            total = mix((total ^ words[:, k]) * _STEP + np.uint64(k))
    return total


def _pack_pieces(buckets: int):
    """The text around each repeated anchor, once for each batch of documents, with
    the places where it stands in the smallest id. Where it stands in a larger id of
    the batch, all its strings are known to be repeated: those runs are listed."""

    def run(batches):
        for batch in batches:
            ident = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            wanted = np.sort((np.repeat(np.arange(len(ident)), np.diff(ends)) << 40) | flat[ends[0] : ends[-1]])
            h, doc, q, a, b = anchors(data, offsets)
            key = doc << 40 | q
            place = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
            some = wanted[place] == key if len(wanted) else np.zeros(len(key), bool)
            h, doc, q, a, b = h[some], doc[some], q[some], a[some], b[some]
            if not len(h):
                continue
            left, right = q - a, b + LENGTH - q - ANCHOR
            sign = np.empty(len(h), np.uint64)
            for lo in range(0, len(h), 20_000):
                x = slice(lo, lo + 20_000)
                sign[x] = _signature(_rows(data, q[x] + offsets[doc[x]], left[x], right[x]), left[x], right[x])
            _, first, number = np.unique(sign, return_index=True, return_inverse=True)
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, number, ident[doc])
            later = ident[doc] > least[number]
            if later.any():
                home = int(mix(ident[:1].astype(np.uint64))[0] % np.uint64(buckets))
                blob = np.int64(later.sum()).tobytes() + ident[doc[later]].tobytes() + a[later].astype(np.uint32).tobytes() + b[later].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([KNOWN], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
                h, doc, q, left, right, number = h[~later], doc[~later], q[~later], left[~later], right[~later], number[~later]
                first = np.unique(number, return_index=True)[1]
            bucket = (mix(h[first]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            rank = np.empty(len(first), np.int64)
            rank[by] = np.arange(len(first))
            to = np.searchsorted(bucket[by], np.arange(buckets + 1))
            owner = np.argsort(rank[number], kind="stable")
            own_to = np.searchsorted(rank[number][owner], to)
            for k in np.flatnonzero(np.diff(to)).tolist():
                i, o = first[by[to[k] : to[k + 1]]], owner[own_to[k] : own_to[k + 1]]
                rows = _rows(data, q[i] + offsets[doc[i]], left[i], right[i])
                blob = b"".join([
                    np.array([len(i), len(o)], np.int64).tobytes(), h[i].tobytes(), ident[doc[o]].tobytes(), (rank[number[o]] - to[k]).astype(np.uint32).tobytes(), q[o].astype(np.uint32).tobytes(),
                    left[i].astype(np.uint8).tobytes(), right[i].astype(np.uint8).tobytes(), rows.tobytes(),
                ])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([ASKED], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])

    return run


def _unpack_pieces(blob: bytes) -> tuple[tuple, tuple]:
    n, m = np.frombuffer(blob, np.int64, 2)
    h = np.frombuffer(blob, np.uint64, n, 16)
    ident = np.frombuffer(blob, np.int64, m, at := 16 + 8 * n)
    row = np.frombuffer(blob, np.uint32, m, at := at + 8 * m)
    q = np.frombuffer(blob, np.uint32, m, at := at + 4 * m)
    left = np.frombuffer(blob, np.uint8, n, at := at + 4 * m)
    right = np.frombuffer(blob, np.uint8, n, at := at + n)
    wide = ANCHOR + 2 * _REACH
    rows = np.frombuffer(blob, np.uint8, n * wide, at + n).reshape(n, wide)
    return (h, left.astype(np.int64), right.astype(np.int64), rows), (row.astype(np.int64), ident, q.astype(np.int64))


def _shared(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row, the longest beginning (of at most `size`) that it shares with
    another row of its group."""
    n, width = rows.shape
    pad = np.zeros((n, -(-width // 8) * 8), np.uint8)
    pad[:, :width] = rows
    words = pad.view(">u8")
    # zeros beyond a row's size may equal zeros of a text: of such rows the shorter goes first
    by = np.lexsort((size, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group))
    best = np.zeros(n, np.int64)
    if n > 1:
        a, b = by[:-1], by[1:]
        same = np.minimum(size[a], size[b])
        differs = rows[a] != rows[b]
        first = np.where(differs.any(1), differs.argmax(1), width)
        common = np.where(group[a] == group[b], np.minimum(first, same), 0)
        np.maximum.at(best, a, common)
        np.maximum.at(best, b, common)
    return best


def equal_strings(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, text, start) of every string of LENGTH bytes in `texts`: equal strings
    have equal classes. The suffixes of all texts are ordered, and neighbours that
    agree in LENGTH bytes are one class."""
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    whole = np.ones(begin[-1], np.int64)
    for at, t in zip(begin[:-1], texts, strict=True):
        whole[at : at + len(t)] = t.astype(np.int64) + 2
    order = np.array(suffix_array([*whole.tolist(), 0]))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    order = order[order < len(whole)]
    start = order - begin[owner[order]]
    good = start + LENGTH <= sizes[owner[order]]
    order, start = order[good], start[good]
    window = whole.astype(np.int16)[order[:, None] + np.arange(LENGTH)]
    new = np.ones(len(order), bool)
    new[1:] = (window[1:] != window[:-1]).any(1)
    return np.cumsum(new) - 1, owner[order], start


def _cut_down(h: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much of each piece's left and right side stays: what it shares with another
    piece around the same anchor. A string can be elsewhere only within that; a piece
    that stands in two documents is all shared."""
    _, group = np.unique(h, return_inverse=True)
    back = np.where(both, left, np.minimum(left, _shared(group, rows[:, _REACH - 1 :: -1], left)))
    ahead = np.where(both, right, np.minimum(right, _shared(group, rows[:, _REACH + ANCHOR :], right)))
    return back, ahead


def _chunks(group: np.ndarray):
    """Ranges of rows, in order of their groups, of about ORDERED rows; groups stay whole."""
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    lo = 0
    for hi, end in zip(bounds[1:-1].tolist(), bounds[2:].tolist(), strict=True):
        if end - lo > ORDERED:
            yield lo, hi
            lo = hi
    if len(group):
        yield lo, len(group)


def _find(batches):
    """(doc_id, s, e): runs of starts of strings that also stand in a smaller id."""
    got = []
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = blob.as_py()
            if kind == ASKED:
                got.append(_unpack_pieces(raw))
                continue
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            s, e = (np.frombuffer(raw, np.uint32, n, at).astype(np.int64) for at in (8 + 8 * n, 8 + 12 * n))
            yield from _runs(np.frombuffer(raw, np.int64, n, 8), s, e)
    if not got:
        return
    h, left, right, rows = (np.concatenate(x) for x in zip(*(g[0] for g in got), strict=True))
    shift = np.repeat(np.cumsum([0, *(len(g[0][0]) for g in got[:-1])]), [len(g[1][0]) for g in got])
    row, ident, q = (np.concatenate(x) for x in zip(*(g[1] for g in got), strict=True))
    row = row + shift
    del got
    # equal pieces of different batches become one
    sign = _signature(rows, left, right) ^ mix(h)
    _, first, number = np.unique(sign, return_index=True, return_inverse=True)
    h, left, right, rows, row = h[first], left[first], right[first], rows[first], number[row]
    low, high = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), np.iinfo(np.int64).min)
    np.minimum.at(low, row, ident)
    np.maximum.at(high, row, ident)
    back, ahead = _cut_down(h, left, right, rows, low < high)
    open_ = back + ANCHOR + ahead >= LENGTH
    span = np.arange(-_REACH, ANCHOR + _REACH)
    inside = (span >= -back[:, None]) & (span < ANCHOR + ahead[:, None])
    cut_rows = np.where(inside, rows, np.uint8(0))
    sign = _signature(cut_rows, back, ahead) ^ mix(h)
    _, first, number = np.unique(sign, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, number, low)
    _, group = np.unique(h, return_inverse=True)
    members = np.bincount(group[first][open_[first]], minlength=group.max() + 1)
    # smallest id of each string: of the piece where it is alone in its group, else
    # by the order of the group's suffixes
    wide = ANCHOR + 2 * _REACH - LENGTH + 1
    smallest = np.full((len(first), wide), np.iinfo(np.int64).max)
    alone = members[group[first]] == 1
    smallest[alone] = least[alone][:, None]
    rest = np.flatnonzero(~alone & open_[first])
    rest = rest[np.argsort(group[first[rest]], kind="stable")]
    for lo, hi in _chunks(group[first[rest]]):
        some = rest[lo:hi]
        lead = _REACH - back[first[some]]
        texts = [cut_rows[first[k], s : _REACH + ANCHOR + ahead[first[k]]] for k, s in zip(some, lead, strict=True)]
        kind, text, start = equal_strings(texts)
        value = np.full(kind[-1] + 1 if len(kind) else 0, np.iinfo(np.int64).max)
        np.minimum.at(value, kind, least[some[text]])
        smallest[some[text], lead[text] + start] = value[kind]
    # back to the places
    place = number[row]
    earlier = (smallest[place] < ident[:, None]) & open_[row][:, None]
    column = np.arange(wide)
    earlier &= (column >= _REACH - back[row][:, None]) & (column + LENGTH <= _REACH + ANCHOR + ahead[row][:, None])
    edge = np.diff(np.pad(earlier, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, s = np.nonzero(edge == 1)
    _, e = np.nonzero(edge == -1)
    base = q[r] - _REACH
    yield from _runs(ident[r], base + s, base + e - 1)


def _runs(ident: np.ndarray, s: np.ndarray, e: np.ndarray):
    for lo in range(0, len(s), 200_000):
        x = slice(lo, lo + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(ident[x]), pa.array(s[x]), pa.array(e[x])], names=["doc_id", "s", "e"])


# ---------------------------------------------------------------- the operator


def removed_runs(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the bytes covered by strings that start in s..e, merged."""
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by]) + LENGTH
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] if len(s) else e


def repeated_starts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, s, e) for (doc_id, text): runs of starts of LENGTH-byte strings that
    also start in a text of a smaller id. `copies` (doc_id) are those whose text
    equals that of a smaller id: all their strings do, and they are left out."""
    spark = docs.sparkSession
    kind = "bucket long, kind int, blob binary"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, partitions(spark), total // 18 // BUCKET_ANCHORS)
    coded = docs.select("doc_id", "text", F.xxhash64("text").alias("code"))
    packed = coded.mapInArrow(_pack_anchors(buckets), kind)
    found = _by_bucket(packed, buckets).mapInArrow(_repeated, "doc_id long, q long")
    found = cut(found, "repeated")
    pieces = found.count()
    listed = found.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_list("q").alias("q"))
    buckets = max(BUCKETS, partitions(spark), pieces // BUCKET_PIECES)
    both = docs.join(listed, "doc_id").select("doc_id", "text", "q")
    starts = cut(_by_bucket(both.mapInArrow(_pack_pieces(buckets), kind), buckets).mapInArrow(_find, "doc_id long, s long, e long"), "starts")
    remove(found)
    return starts


def _by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    """A partition for each bucket: no two buckets share one."""
    return packed.repartitionById(buckets, F.col("bucket").cast("int"))


def _with_runs(docs: DataFrame, copies: DataFrame) -> DataFrame:
    starts = repeated_starts(docs, copies)
    runs = starts.groupBy("doc_id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    return docs.join(runs, "doc_id").select("doc_id", "text", "s", "e")


def _copies(facts: DataFrame) -> DataFrame:
    """(doc_id): those with LENGTH bytes whose text equals that of a smaller id."""
    some = facts.where(f"doc_id is not null and n_bytes >= {LENGTH}")
    return cut(group_min(some, "sha", "doc_id").where("doc_id <> leader").select("doc_id").distinct(), "copies")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy()


def _summarise(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        (at, s), (_, e) = _lists(batch.column(2)), _lists(batch.column(3))
        out: list[list] = [[], [], []]
        for d in range(batch.num_rows):
            begin, end = removed_runs(s[at[d] : at[d + 1]], e[at[d] : at[d + 1]])
            text = data[offsets[d] : offsets[d + 1]]
            keep = np.ones(len(text), bool)
            for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                keep[x:y] = False
            out[0].append(int((~keep).sum()))
            out[1].append(len(begin))
            out[2].append(hashlib.sha256(text[keep].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], names=["doc_id", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """What is left of each document without the strings of earlier ones.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row:
    every byte covered by a string of LENGTH bytes that also starts in a document
    of a smaller id goes. Strings are those of the input, not of what is left.

    Equal strings hold the same least anchor (a 16-byte substring chosen by hash),
    so only anchors that stand in two texts need to be looked at, and text around
    equal anchors meets in one task. There, equal pieces are merged, pieces are cut
    to what they share with another one, and the suffixes of those that still
    differ are ordered by linear grouping; strings that agree are neighbours then. What a batch of documents can decide by
    itself does not travel: it sends a piece of text once, with its smallest id.

    Null texts count as empty. A text equal to one of a smaller id goes as a whole
    if it has LENGTH bytes. Rows that repeat an id (with one text) keep it alike;
    a null id removes nothing and loses nothing. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    facts = cut(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "facts")
    copies = _copies(facts)
    changed = cut(_with_runs(rows.where("doc_id is not null"), copies).mapInArrow(_summarise, "doc_id long, n_removed long, n_spans long, kept_sha256 string"), "changed")
    changed = changed.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "_d")
    out = facts.join(copies.select(F.col("doc_id").alias("_c")), F.col("doc_id") == F.col("_c"), "left").join(changed, F.col("doc_id") == F.col("_d"), "left")
    gone = F.col("_c").isNotNull()
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _rewrite(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        (at, s), (_, e) = _lists(batch.column(2)), _lists(batch.column(3))
        texts = []
        for d in range(batch.num_rows):
            text = data[offsets[d] : offsets[d + 1]]
            keep = np.ones(len(text), bool)
            for x, y in zip(*(v.tolist() for v in removed_runs(s[at[d] : at[d + 1]], e[at[d] : at[d + 1]])), strict=True):
                keep[x:y] = False
            texts.append(text[keep].tobytes().decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_d", "_left"])


def cut_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """`docs` with repeated strings taken out of the text, and without the documents
    of which no word is left. Half characters at the cuts go too. `size`, where it
    is a column, gets the new number of characters. Null and empty texts that were
    so before, and null ids, stay. Rows that repeat an id (with one text) are cut
    alike; all other columns stay as they are, whatever their names. An empty table
    stays empty."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    found = _copies(rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").alias("n_bytes")))
    copies = found.select(F.col("doc_id").alias("_d"), F.lit("").alias("_left"))
    changed = _with_runs(rows, found).mapInArrow(_rewrite, "_d long, _left string")
    changed = cut(changed.join(copies.select("_d"), "_d", "left_anti").union(copies).dropDuplicates(["_d"]), "changed")
    by, left = free_name(docs, "_d"), free_name(docs, "_left")
    out = docs.join(changed.withColumnsRenamed({"_d": by, "_left": left}), docs[ident] == F.col(by), "left")
    out = out.where(F.col(left).isNull() | F.col(left).rlike("[^\\x20\\x09-\\x0D]"))
    new = {text: F.coalesce(left, text)}
    if size in docs.columns:
        new[size] = F.when(F.col(left).isNull(), F.col(size)).otherwise(F.length(left)).cast(docs.schema[size].dataType)
    return out.withColumns(new).drop(by, left)
