"""Jaccard self-join of documents on word n-grams, filtered by several token orders."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import LOWER, _forest, blocks, components, cut, free_name, group_min, mix, partitions, remove, shingles, text_bytes, words

#: Words of a shingle, and the similarity of a link as a fraction.
WIDTH = 5
SHARE = (80, 100)
#: Counters of the frequency sketch, and the parts in which it is summed.
SKETCH, SLICES = 1 << 23, 64
#: Token orders that a pair must agree under: by a ring of token hashes, begun at
#: another third of it in each order.
ORDERS = 3
_RING = 57
_THIRD = np.uint64((1 << _RING) // ORDERS)
#: Values of a token's place in its third, as documents are marked with it.
_PLACES = 1 << 16
#: A document's pairs are dealt by portions: a share of all pairs, or so many if that is more.
PORTIONS, PORTION = 1024, 64
#: Documents whose list may be broadcast to fetch their texts; more are joined by shuffle.
FETCHED = 100_000
#: Bytes of marks, and of zipped texts, of the pairs that are compared at once.
MARKED, ZIPPED = 1 << 20, 1 << 18
#: Bytes by which prefix tokens are told apart; equal ones make candidates, not links.
SHORT = 6
#: Rounds in which documents of a token meet one of another component, before all
#: pairs that are still open are compared.
ROUNDS = 2
#: A token with more open documents than this is crowded: its documents are compared
#: by blocks, of so many documents and so many tokens on average.
CROWD = 64
BLOCK_DOCS, BLOCK_TOKENS = 512, 1_000_000
#: Columns of a dense incidence matrix; products of sparse tokens at once.
COLUMNS, PRODUCTS = 2048, 4_000_000
#: Postings of a bucket on average, rows of a frequent token in a piece.
POSTINGS, PIECE = 1_000_000, 1024
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def needed(n: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Least overlap that a set of n needs with any set it links with."""
    return -(-n * share[0] // share[1])


def token_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles, sorted, one after the other, and bounds."""
    hashes, _, bounds = words(LOWER[data], offsets)
    every, at = shingles(hashes, bounds, width)
    for d in range(len(at) - 1):
        every[at[d] : at[d + 1]].sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    new[at[:-1][at[:-1] < len(every)]] = True
    return every[new], np.concatenate([[0], np.cumsum(new)])[at]


def many_token_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """`token_sets` of a column of texts, a block of bytes at a time."""
    data, offsets = text_bytes(column)
    got = [token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width) for lo, hi in blocks(offsets)]
    sizes = [np.diff(b) for _, b in got]
    return np.concatenate([t for t, _ in got] or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))])


def by_bytes(batch: pa.RecordBatch, columns: tuple[int, ...], limit: int):
    """Slices of a batch with about `limit` bytes in `columns`, at least one row."""
    total = sum(np.diff(text_bytes(batch.column(k))[1]) for k in columns)
    for lo, hi in blocks(np.concatenate([[0], np.cumsum(total)]), limit):
        yield batch.slice(lo, hi - lo)


def steps(counts: np.ndarray) -> np.ndarray:
    """For each counter 0, or how many times its excess over what other tokens put
    there can be halved, plus 1."""
    mean = float(counts.mean())
    over = np.maximum(counts - (mean + 6 * mean**0.5 + 4), 0)
    return np.where(over > 0, np.log2(over + 1).astype(np.int64) + 1, 0).astype(np.uint8)


def step_of(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)


def ring(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ _SEEDS[0]) >> np.uint64(64 - _RING)


def order_keys(tokens: np.ndarray, step: np.ndarray, order: int) -> np.ndarray:
    """Ranks of tokens under one global order: seldom tokens first, in steps of a
    power of two of the excess; then along the ring from the order's own third, so
    that prefixes under different orders hold different tokens."""
    with np.errstate(over="ignore"):
        turned = (ring(tokens) - np.uint64(order) * _THIRD) & np.uint64((1 << _RING) - 1)
    return step << np.uint64(_RING) | turned


def marks(tokens: np.ndarray, bounds: np.ndarray, step: np.ndarray, share: tuple[int, int]) -> list[bytes]:
    """Each document's prefixes under all orders in short: its set size, and for each
    order a limit, a count and the places of the prefix's tokens of step 0 in the
    order's third. A document's tokens of step 0 in a third, below that limit, are
    all among them."""
    n = np.diff(bounds)
    length = n - needed(n, share) + 1
    own = np.repeat(np.arange(len(n)), n)[step == 0]
    at = ring(tokens[step == 0])
    third = np.minimum(at // _THIRD, np.uint64(ORDERS - 1))
    inside = at - third * _THIRD < _THIRD
    own, third, at = own[inside], third[inside].astype(np.int64), at[inside]
    place = ((at - third.astype(np.uint64) * _THIRD) * np.uint64(ORDERS) >> np.uint64(_RING - 16)).astype(np.int64)
    code = np.sort((own * ORDERS + third) * _PLACES + place)
    slot, place = code // _PLACES, code % _PLACES
    begin = np.searchsorted(slot, np.arange(len(n) * ORDERS + 1))
    total = np.diff(begin)
    kept = np.minimum(total, np.repeat(length, ORDERS))
    limit = np.full(len(total), _PLACES)
    more = np.flatnonzero(total > kept)
    limit[more] = place[begin[more] + kept[more]]
    take = np.arange(len(code)) - begin[slot] < kept[slot]
    flat = place[take].astype(np.uint16)
    to = np.concatenate([[0], np.cumsum(kept)])[::ORDERS]
    heads = np.concatenate([n[:, None], limit.reshape(-1, ORDERS), kept.reshape(-1, ORDERS)], 1).astype(np.uint32)
    return [heads[d].tobytes() + flat[to[d] : to[d + 1]].tobytes() for d in range(len(n))]


def read_marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, limits, codes, owners) of a column of `marks`; a code is an order
    and a place in one number."""
    raw, offsets = text_bytes(column)
    wide = 4 * (1 + 2 * ORDERS)
    head = raw[offsets[:-1][:, None] + np.arange(wide)].reshape(-1).view(np.uint32).reshape(-1, 1 + 2 * ORDERS).astype(np.int64)
    n, limit, kept = head[:, 0], head[:, 1 : 1 + ORDERS], head[:, 1 + ORDERS :]
    own = kept.sum(1)
    at = np.repeat(offsets[:-1] + wide - 2 * (np.cumsum(own) - own), own) + 2 * np.arange(own.sum())
    place = raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8
    order = np.repeat(np.tile(np.arange(ORDERS), len(n)), kept.reshape(-1))
    return n, limit, order * _PLACES + place, np.repeat(np.arange(len(n)), own)


def agree(one: pa.Array, two: pa.Array, share: tuple[int, int]) -> np.ndarray:
    """Which pairs of `marks` can link. Below the smaller of two documents' limits,
    the tokens of both are known under every order, and the thirds are apart; so the
    overlap is at most what is equal there and what either has elsewhere. A pair
    without an equal prefix token under some order cannot reach what it needs."""
    (na, la, ca, oa), (nb, lb, cb, ob) = read_marks(one), read_marks(two)
    least = np.minimum(la, lb)
    known = []
    for code, own in ((ca, oa), (cb, ob)):
        low = code % _PLACES < least[own, code // _PLACES]
        known.append((np.bincount(own[low], minlength=len(na)), *np.unique(own[low] * (ORDERS * _PLACES) + code[low], return_counts=True)))
    (ka, xa, ta), (kb, xb, tb) = known
    both, i, j = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    common = np.bincount(both // (ORDERS * _PLACES), np.minimum(ta[i], tb[j]), len(na)).astype(np.int64)
    most = common + np.minimum(na - ka, nb - kb)
    return most * (share[0] + share[1]) >= share[0] * (na + nb)


def prefixes(tokens: np.ndarray, bounds: np.ndarray, keys: np.ndarray, share: tuple[int, int]) -> list[np.ndarray]:
    """Positions of each document's prefix: so many first tokens in the order that
    two linked documents have one in common."""
    out = []
    size = np.diff(bounds)
    for d, p in enumerate((size - needed(size, share) + 1).tolist()):
        lo, n = bounds[d], size[d]
        if not n:
            out.append(np.zeros(0, np.int64))
        elif p >= n:
            out.append(np.arange(lo, lo + n))
        else:
            out.append(lo + np.argpartition(keys[lo : lo + n], p - 1)[:p])
    return out


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Steps of the documents per counter, for every token of every document: a fixed
    size.

    `docs` is (doc_id, text). Each task sums its own documents; parts of the
    counters are then summed apart."""

    def count(batches):
        total, waiting, held = np.zeros(SKETCH, np.uint32), [], 0

        def flush():
            slots, n = np.unique((np.concatenate(waiting) & np.uint64(SKETCH - 1)).astype(np.uint32), return_counts=True)
            total[slots] += n.astype(np.uint32)

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in blocks(offsets):
                waiting.append(token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0])
                held += len(waiting[-1])
                if held > 2_000_000:
                    flush()
                    waiting, held = [], 0
        if waiting:
            flush()
        parts = total.reshape(SLICES, -1)
        if total.any():
            for k in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.astype(np.uint32).tobytes(), 1) for v in total.values()], pa.binary())], names=["slice", "counts"])

    summed = docs.mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary")
    sketch = np.zeros((SLICES, SKETCH // SLICES), np.uint32)
    for k, raw in summed.collect():
        sketch[k] = np.frombuffer(zlib.decompress(raw), np.uint32)
    return steps(sketch.reshape(-1))


def describe(docs: DataFrame, sketch, share: tuple[int, int]) -> DataFrame:
    """(doc_id, n, key, prefix): set size, a 128-bit signature of the set, and the
    prefix tokens under the first order, by SHORT bytes each."""

    def run(batches):
        counts = sketch.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            sizes, keys, heads = [], [], []
            for lo, hi in blocks(offsets):
                tokens, bounds = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(bounds)
                with np.errstate(over="ignore"):
                    a = np.concatenate([[0], np.cumsum(mix(tokens ^ _SEEDS[3]))]).astype(np.uint64)
                    b = np.concatenate([[0], np.cumsum(mix(tokens * np.uint64(3) + np.uint64(1)))]).astype(np.uint64)
                    sign = np.stack([a[bounds[1:]] - a[bounds[:-1]], b[bounds[1:]] - b[bounds[:-1]]], 1)
                ranks = order_keys(tokens, step_of(tokens, counts), 0)
                sizes += n.tolist()
                keys += [s.tobytes() for s in sign]
                heads += [_bytes_of(tokens[p])[:, :SHORT].tobytes() for p in prefixes(tokens, bounds, ranks, share)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(heads, pa.binary())], names=["doc_id", "n", "key", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, prefix binary")


def marked(docs: DataFrame, sketch, share: tuple[int, int]) -> DataFrame:
    """(doc_id, mark) of documents (doc_id, text): see `marks`."""

    def run(batches):
        counts = sketch.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            short = []
            for lo, hi in blocks(offsets):
                tokens, bounds = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                short += marks(tokens, bounds, step_of(tokens, counts), share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["doc_id", "mark"])

    return docs.mapInArrow(run, "doc_id long, mark binary")


def _bytes_of(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)


def _planes(x: np.ndarray) -> bytes:
    """First bytes, then second bytes and so on: high bytes of small numbers compress."""
    return _bytes_of(x).T.tobytes()


def _numbers(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def _tokens(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // SHORT, 8), np.uint8)
    wide[:, :SHORT] = raw.reshape(-1, SHORT)
    return wide.reshape(-1).view(np.uint64)


def postings(described: DataFrame, sketch, buckets: int) -> DataFrame:
    """(bucket, posts): the prefix tokens of a batch of documents, packed by bucket
    of the token. A frequent token's documents are spread over several buckets."""

    def run(batches):
        counts = sketch.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            if not len(raw):
                continue
            tokens = _tokens(raw[offsets[0] : offsets[-1]])
            each = np.diff(offsets) // SHORT
            doc = np.repeat(batch.column(0).to_numpy(), each)
            size = np.repeat(batch.column(1).to_numpy(), each)
            pieces = (np.uint64(1) << step_of(tokens, counts)) // np.uint64(2 * PIECE) + np.uint64(1)
            piece = mix(doc.astype(np.uint64)) % pieces
            bucket = ((mix(tokens ^ _SEEDS[3]) + piece * np.uint64(0x9E3779B9)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            to = np.searchsorted(bucket[by], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(to))
            parts = [by[to[k] : to[k + 1]] for k in full]
            posts = [b"".join([_bytes_of(tokens[i])[:, :SHORT].tobytes(), _planes(doc[i]), _planes(size[i].astype(np.uint32)), (pieces[i] > 1).tobytes()]) for i in parts]
            for lo in range(0, len(full), 64):
                yield pa.RecordBatch.from_arrays([pa.array(full[lo : lo + 64], pa.int64()), pa.array(posts[lo : lo + 64], pa.binary())], names=["bucket", "posts"])

    return described.mapInArrow(run, "bucket long, posts binary")


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n = len(raw) // (SHORT + 13)
    tokens = _tokens(np.frombuffer(raw, np.uint8, SHORT * n))
    return tokens, _numbers(raw, np.int64, n, SHORT * n), _numbers(raw, np.uint32, n, (SHORT + 8) * n).astype(np.int64), np.frombuffer(raw, bool, n, (SHORT + 12) * n)


#: What `gather` gives: pairs of documents to compare, the documents of a token,
#: and the representatives of a piece of a frequent token.
PAIR, MEMBER, HEAD = 0, 1, 2


def gather(share: tuple[int, int]):
    """Of each token with several documents: pairs of every document with the
    smallest - a number linear in its documents - and, where these leave other pairs
    open (three documents or more), the documents themselves."""

    def run(batches):
        got = [_unpack(x.as_py()) for batch in batches for x in batch.column(1)]
        if not got:
            return
        token, doc, size, spread = (np.concatenate(x) for x in zip(*got, strict=True))
        by = np.lexsort((doc, size, token))
        token, doc, size, spread = token[by], doc[by], size[by], spread[by]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        least = np.minimum.reduceat(doc, first)
        some = np.repeat(count, count) > 1
        head = np.repeat(least, count)
        size_of_head = np.repeat(size[np.flatnonzero(doc == head)[np.searchsorted(np.flatnonzero(doc == head), first)]], count)
        near = np.minimum(size, size_of_head) * share[1] >= np.maximum(size, size_of_head) * share[0]
        star = some & near & (doc != head)
        pairs = np.unique(np.stack([head[star], doc[star]], 1), axis=0)
        signed = token.view(np.int64)
        member = (np.repeat(count, count) > 2) | spread
        heads = first[spread[first]]
        rows = [(PAIR, pairs[:, 0], pairs[:, 1], None), (MEMBER, signed[member], doc[member], size[member]), (HEAD, signed[heads], least[spread[first]], None)]
        for kind, x, y, z in rows:
            for lo in range(0, len(x), 200_000):
                part = slice(lo, lo + 200_000)
                third = np.zeros(len(x[part]), np.int64) if z is None else z[part]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[part]), kind, np.int32)), pa.array(x[part]), pa.array(y[part]), pa.array(third)], names=["kind", "x", "y", "z"])

    return run


def zipped(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with each text compressed: less to shuffle and to keep."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            texts = [pack(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text binary")


def busy(pairs: DataFrame) -> DataFrame:
    """(doc_id, ways) of documents that more than one portion of the pairs (a, b)
    lies at: over so many keys they are dealt. As a portion is a PORTIONS-th of the
    pairs, no more than 4 * PORTIONS documents are listed, whatever the input."""
    portion = max(PORTION, pairs.count() // PORTIONS)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id")
    return ends.agg(F.ceil(F.count(F.lit(1)) / portion).cast("int").alias("ways")).where("ways > 1")


def spread(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """A row of `rows` (doc_id, ...) for each way of its document, numbered `way`: one
    for documents that `hot` (doc_id, ways) does not list."""
    if hot is None:
        return rows.withColumn("way", F.lit(0))
    ways = F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)
    return rows.join(F.broadcast(hot), "doc_id", "left").withColumn("way", F.explode(ways)).drop("ways")


def beside(pairs: DataFrame, side: DataFrame, hot: DataFrame, value: str) -> DataFrame:
    """(a, b, value_a, value_b): `pairs` with the values of both documents in `side`
    (doc_id, way, value). A document's pairs go to a way by their other end, so that
    one which is in a large share of all pairs is met in many tasks."""
    for end, other in (("a", "b"), ("b", "a")):
        ways = hot.select(F.col("doc_id").alias(end), "ways")
        way = F.pmod(F.xxhash64(other), F.coalesce("ways", F.lit(1))).cast("int")
        dealt = pairs.join(F.broadcast(ways), end, "left").withColumn("way", way).drop("ways")
        pairs = dealt.join(side.select(F.col("doc_id").alias(end), "way", F.col(value).alias(f"{value}_{end}")), [end, "way"]).drop("way")
    return pairs.select("a", "b", f"{value}_a", f"{value}_b")


def texts_of(rows: DataFrame, ids: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, way) of the documents in `ids` (doc_id, distinct), zipped, one
    row an id and way. A list of at most FETCHED ids is broadcast, a longer one joined."""
    if ids.count() <= FETCHED:
        return spread(zipped(rows.join(F.broadcast(ids), "doc_id", "left_semi")), hot).dropDuplicates(["doc_id", "way"])
    return spread(zipped(rows), hot).join(spread(ids, hot), ["doc_id", "way"], "left_semi").dropDuplicates(["doc_id", "way"])


def screen(pairs: DataFrame, short: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that agree under all orders; `short` is (doc_id, mark). Rows
    that repeat an id count once."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    hot = cut(busy(pairs), "busy")
    if ids.count() <= FETCHED:
        asked = spread(short.join(F.broadcast(ids), "doc_id", "left_semi"), hot)
    else:
        asked = spread(short, hot).join(spread(ids, hot), ["doc_id", "way"], "left_semi")

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, (2, 3), MARKED):
                keep = pa.array(agree(part.column(2), part.column(3), share))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    both = beside(pairs, asked.dropDuplicates(["doc_id", "way"]), hot, "mark")
    return both.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, rows: DataFrame, share: tuple[int, int], width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) that link, by exact counts of their texts' shingles; `pairs`
    is a table, `rows` all documents (doc_id, text)."""

    def run(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in by_bytes(batch, (2, 3), ZIPPED):
                ids = np.concatenate([part.column(0).to_numpy(), part.column(1).to_numpy()])
                _, first, where = np.unique(ids, return_index=True, return_inverse=True)  # each text is read once
                texts = [unzip(part.column(2 + k // part.num_rows)[k % part.num_rows].as_py()) for k in first.tolist()]
                tokens, bounds = many_token_sets(pa.array(texts, pa.large_binary()), width)
                keep = np.zeros(part.num_rows, bool)
                for d, (x, y) in enumerate(zip(where[: part.num_rows].tolist(), where[part.num_rows :].tolist(), strict=True)):
                    one, two = tokens[bounds[x] : bounds[x + 1]], tokens[bounds[y] : bounds[y + 1]]
                    common = len(np.intersect1d(one, two, True))
                    keep[d] = common * share[1] >= share[0] * (len(one) + len(two) - common)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep))], names=["a", "b"])

    hot = cut(busy(pairs), "busy")
    texts = texts_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), hot)
    both = beside(pairs, texts, hot, "text")
    return both.mapInArrow(run, "a long, b long")


def overlaps(tokens: np.ndarray, bounds: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of tokens that documents `one` and `two` share.

    Tokens that many pairs share are counted by products of incidence matrices, the
    others pair by pair."""
    common = np.zeros(len(one) * len(two), np.int64)
    codes = np.unique(tokens, return_inverse=True)[1]
    ends = []
    for side in (one, two):
        size = np.diff(bounds)[side]
        at = np.repeat(bounds[:-1][side] - np.cumsum(size) + size, size) + np.arange(size.sum())
        code, row = codes[at], np.repeat(np.arange(len(side)), size)
        by = np.argsort(code, kind="stable")
        ends.append((code[by], row[by]))
    (code_a, row_a), (code_b, row_b) = ends
    total = int(codes.max()) + 1 if len(codes) else 0
    count_a, count_b = np.bincount(code_a, minlength=total), np.bincount(code_b, minlength=total)
    work = count_a * count_b
    crowded = work * 256 > len(one) * len(two)
    columns = np.flatnonzero(crowded)
    for lo in range(0, len(columns), COLUMNS):
        part = columns[lo : lo + COLUMNS]
        sides = []
        for (code, row), n in zip(ends, (len(one), len(two)), strict=True):
            a, b = np.searchsorted(code, [part[0], part[-1] + 1])
            inside = crowded[code[a:b]]
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[row[a:b][inside], np.searchsorted(part, code[a:b][inside])] = 1
            sides.append(matrix)
        common += (sides[0] @ sides[1].T).astype(np.int64).reshape(-1)
    begin = np.concatenate([[0], np.cumsum(count_b)])
    seldom = np.flatnonzero(~crowded[code_a] & (work[code_a] > 0))
    reach = np.cumsum(count_b[code_a[seldom]])
    lo = 0
    while lo < len(seldom):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + PRODUCTS, "right")))
        mine = seldom[lo:hi]
        times = count_b[code_a[mine]]
        other = np.repeat(begin[code_a[mine]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        common += np.bincount(np.repeat(row_a[mine], times) * len(two) + row_b[other], minlength=len(common))
        lo = hi
    return common.reshape(len(one), len(two))


def compare_blocks(sketch, share: tuple[int, int], width: int = WIDTH):
    """For `applyInArrow`: (a, b) links between the documents of two blocks, one
    forest of them.

    Pairs must lie in different components, fit in size and share a prefix token
    under every order; if any are left, their overlaps are counted exactly."""

    def run(key, group):
        import zstandard

        counts, unzip = sketch.value, zstandard.ZstdDecompressor().decompress
        left, right = (k.as_py() for k in key)
        cell, doc, part = (group.column(c).to_numpy() for c in ("cell", "doc", "part"))
        tokens, bounds = many_token_sets(pa.array([unzip(x) for x in group.column("text").to_pylist()], pa.large_binary()), width)
        size = np.diff(bounds)
        one, two = np.flatnonzero(cell == left), np.flatnonzero(cell == right)
        n, m = size[one][:, None], size[two][None, :]
        open_ = (part[one][:, None] != part[two][None, :]) & (np.minimum(n, m) * share[1] >= np.maximum(n, m) * share[0])
        step = step_of(tokens, counts)
        for order in range(ORDERS):
            if not open_.any():
                break
            heads = prefixes(tokens, bounds, order_keys(tokens, step, order), share)
            open_ &= overlaps(tokens[np.concatenate(heads)], np.concatenate([[0], np.cumsum([len(h) for h in heads])]), one, two) > 0
        some, others = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        a = b = np.zeros(0, np.int64)
        if len(some):
            common = overlaps(tokens, bounds, one[some], two[others])
            union = n[some] + m[:, others] - common
            x, y = np.nonzero(open_[np.ix_(some, others)] & (common * share[1] >= share[0] * union))
            a, b = _forest((doc[one[some[x]]], doc[two[others[y]]])) if len(x) else (a, b)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def by_blocks(open_: DataFrame, rows: DataFrame, sketch, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Links between documents of different components that share a crowded token,
    and the rows of `open_` (token, doc, n, part) of the other tokens.

    Each document has one home: the most crowded of its tokens, and its size in
    steps of which linked documents are at most one apart. A home's documents are
    dealt to blocks of limited size; two blocks are compared, once, if a crowded
    token has documents in both. A document is sent to as many tasks as its block is
    compared with others, and only a forest of the links comes back."""
    step = max(-float(np.log(share[0] / share[1])), 1e-9) * 1.0001
    crowds = cut(open_.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > CROWD), "crowds")
    crowded = open_.join(crowds, "token")
    homes = crowded.groupBy("doc").agg(F.max(F.struct("docs", "token"))["token"].alias("home"), F.first("n").alias("n"), F.first("part").alias("part"))
    homes = cut(homes.withColumn("grade", F.floor(F.log("n") / step)), "homes")
    counted = homes.groupBy("home", "grade").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    dealt = homes.join(counted, ["home", "grade"])
    cells = cut(dealt.select("doc", "part", "grade", F.xxhash64("home", "grade", F.pmod(F.xxhash64("doc"), "blocks")).alias("cell")), "cells")
    where = cut(crowded.select("token", "doc").join(cells, "doc").select("token", "cell", "grade").distinct(), "where")
    l, r = where.alias("l"), where.alias("r")
    meet = (F.col("l.token") == F.col("r.token")) & (F.col("l.cell") <= F.col("r.cell")) & (F.abs(F.col("l.grade") - F.col("r.grade")) <= 1)
    both = cut(l.join(r, meet).select(F.col("l.cell").alias("left"), F.col("r.cell").alias("right")).distinct(), "both")
    texts = texts_of(rows, cells.select(F.col("doc").alias("doc_id")))
    full = cut(cells.join(texts, F.col("doc") == F.col("doc_id")).select("cell", "doc", "part", "text"), "full")
    sent = both.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("cell")).join(full, "cell")
    links = cut(sent.groupBy("left", "right").applyInArrow(compare_blocks(sketch, share), "a long, b long"), "block_links")
    for done in (where, full, homes):
        remove(done)
    return links, open_.join(crowds, "token", "left_anti")


def jaccard_components(docs: DataFrame, ident: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE) -> DataFrame:
    """Set size and component of every document.

    Returns (doc_id, n_shingles, component_id), one row per row of `docs`. Two
    documents link if share[1] * |intersection| >= share[0] * |union| of their
    sets of WIDTH-word shingles (A-Z lower-cased; words are runs of other bytes
    than ASCII white space). component_id is the smallest id reachable.

    Documents with equal sets are one document from the start. Tokens are ordered
    by a sketch of their frequency, so that prefixes hold seldom tokens. Candidates
    share a prefix token under the first order; they go on only if their prefixes
    under all orders, held in short, allow the overlap that a link needs; only then
    are texts fetched and counted. Of the documents that share a token, each is
    paired with the smallest, then in a few rounds with one of another component;
    then all documents that share a token and are not in one component yet are
    compared, by blocks where many share it, so no link between components is lost,
    a large group of copies costs as many comparisons as it has members, and no
    pairs of a large group are made.

    Null and empty texts have size 0 and link with nothing; with fewer words than
    WIDTH the whole sequence is the one shingle. Shingles are 64-bit hashes. Rows
    that repeat an id count once for linking (their texts should be equal). A null
    id links with nothing and has a null component. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(rows))
    described = cut(describe(rows, sketch, share), "described")
    classes = cut(group_min(described.where("n > 0 and doc_id is not null"), "key", "doc_id").select("doc_id", "leader"), "classes")
    leaders = classes.where("doc_id = leader").select("doc_id").distinct()
    total = described.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    parts = max(partitions(spark), total // SHORT // POSTINGS + 1)
    posts = postings(described.where("n > 0").join(leaders, "doc_id", "left_semi").select("doc_id", "n", "prefix"), sketch, 4 * parts)
    found = cut(posts.repartition(parts, "bucket").mapInArrow(gather(share), "kind int, x long, y long, z long"), "found")
    sizes = cut(described.select("doc_id", F.col("n").alias("n_shingles")), "sizes")
    remove(described)

    def linked(candidates: DataFrame) -> DataFrame:
        agreed = cut(screen(candidates, short, share), "agreed")
        out = cut(verify(agreed, rows, share), "links")
        remove(agreed)
        return out

    members = found.where(f"kind = {MEMBER}").select(F.col("x").alias("token"), F.col("y").alias("doc"), F.col("z").alias("n"))
    tops = found.where(f"kind = {HEAD}").select(F.col("x").alias("token"), F.col("y").alias("doc")).distinct()
    top = tops.groupBy("token").agg(F.min("doc").alias("least"))
    across = tops.join(top, "token").where("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b"))
    pairs = cut(found.where(f"kind = {PAIR}").select(F.col("x").alias("a"), F.col("y").alias("b")).union(across).distinct(), "pairs")
    asked = found.where(f"kind = {MEMBER}").select(F.col("y").alias("doc_id")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    short = cut(marked(rows, sketch, share).join(asked, "doc_id", "left_semi"), "marks")
    links = linked(pairs)
    known = cut(components(links), "known")

    fits = lambda a, b: F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    open_, spent = members, found
    for turn in range(ROUNDS + 1):
        placed = open_.join(known, open_["doc"] == known["node"], "left").select("token", "doc", "n", F.coalesce("component", "doc").alias("part"))
        hub = F.min_by(F.struct("doc", "n", "part"), F.xxhash64(F.lit(turn), "doc"))
        mixed = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), hub.alias("hub")).where("lo < hi").select("token", "hub")
        open_ = cut(placed.join(mixed, "token"), "open")
        remove(spent)
        spent = open_
        if turn == ROUNDS:
            break
        met = open_.where((F.col("part") != F.col("hub.part")) & fits("n", "hub.n")).select(*ordered("doc", "hub.doc")).distinct()
        met = cut(met.join(pairs, ["a", "b"], "left_anti"), "met")
        links = cut(links.union(linked(met)), "links")
        pairs = cut(pairs.union(met), "pairs")
        known = cut(components(links), "known")
        open_ = open_.select("token", "doc", "n")
    blocked, open_ = by_blocks(open_.select("token", "doc", "n", "part"), rows, sketch, share)
    one, two = open_.alias("l"), open_.alias("r")
    near = fits("l.n", "r.n") & (F.col("l.part") < F.col("r.part"))
    rest = one.join(two, F.col("l.token") == F.col("r.token")).where(near)
    rest = cut(rest.select(*ordered("l.doc", "r.doc")).distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    remove(spent)
    more = cut(linked(rest).union(blocked), "more")
    remove(short)
    solved = known if more.isEmpty() else cut(components(links.union(more)), "solved")
    return place(sizes, classes, solved)


def place(sizes: DataFrame, classes: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows of `sizes` with their component: of the class's leader, else themselves."""
    whole = classes.distinct().join(solved, F.col("leader") == F.col("node"), "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "leader").alias("_c"))
    return sizes.join(cut(whole, "whole"), F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, each as often as it
    is there; null ids and texts without words stay. Other columns are not looked at,
    whatever their names. An empty table stays empty."""
    gone = free_name(docs, "_gone")
    found = jaccard_components(docs, ident, text, share).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs[ident] == F.col(gone), "left_anti")
