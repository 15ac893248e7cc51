"""Language-model scoring by prediction by partial matching over byte contexts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import LOWER, blocks, cut, fold, mix, text_bytes, words

#: Bytes of the longest context; symbols: 256 bytes and the end of a text.
ORDER, END, SYMBOLS = 4, 256, 257
SYMBOL_BITS = 9
#: Words whose counts are sent to every task; the others' are joined.
COMMON = 1 << 17
#: Parts into which counts are dealt.
PARTS = 128
#: Bytes of the documents that ask for costs together, and how many such rows a task
#: is handed at once.
ASKING, AT_ONCE = 1 << 21, 2
_MASKS = [np.uint64((1 << SYMBOL_BITS * k) - 1) for k in range(ORDER + 2)]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of documents, each followed by END and led by ORDER of
    them, as one sequence; and the positions at which documents begin in it."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(size + 1)]) + ORDER
    out = np.full(at[-1], END, np.uint16)
    # END separates documents: a context that reaches over it is cut there
    place = np.arange(len(data)) + np.repeat(np.arange(docs) + ORDER, size)
    out[place] = LOWER[data]
    return out, at


def grams(seq: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ORDER + 1 symbols that end at each position of the documents, packed;
    symbols of an earlier document are read as END."""
    n = len(seq) - ORDER
    code = np.zeros(n, np.uint64)
    first = np.repeat(starts[:-1], np.diff(starts))
    position = np.arange(ORDER, len(seq))
    for back in range(ORDER, -1, -1):
        symbol = seq[ORDER - back : len(seq) - back].astype(np.uint64)
        if back:
            symbol = np.where(position - back < first, np.uint64(END), symbol)
        code = code << np.uint64(SYMBOL_BITS) | symbol
    return code


def few_rows(df: DataFrame, name: str) -> DataFrame:
    """`cut`, with so few rows in an Arrow batch that rows may be large."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(AT_ONCE))
    try:
        return cut(df, name)
    finally:
        conf.set(key, before)


def pack_blocks(rows: DataFrame) -> DataFrame:
    """(block, ids, held, sizes, data): documents (doc_id, held_out, text) in blocks of
    about ASKING bytes, one row a block."""

    def pack(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in blocks(offsets, ASKING):
                ids, held = (pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(k).slice(lo, hi - lo)) for k in (0, 1))
                sizes = pa.array([np.diff(offsets[lo : hi + 1]).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, held, sizes, pa.array([data[offsets[lo] : offsets[hi]].tobytes()], pa.binary())], names=["ids", "held", "sizes", "data"])

    return rows.mapInArrow(pack, "ids array<long>, held array<boolean>, sizes binary, data binary").withColumn("block", F.monotonically_increasing_id())


def unpack(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the documents of a batch's row k, without copying."""
    sizes, data = (np.frombuffer(raw, kind) if (raw := batch.column(name)[k].as_buffer()).size else np.zeros(0, kind) for name, kind in (("sizes", np.int64), ("data", np.uint8)))
    return data, np.concatenate([[0], np.cumsum(sizes)])


def part_of(codes: np.ndarray) -> np.ndarray:
    """The part of packed n-grams: by the two symbols before the last, so that a part has
    all that follows its contexts of two symbols and more."""
    return (mix((codes >> np.uint64(SYMBOL_BITS)) & _MASKS[2]) % np.uint64(PARTS)).astype(np.int64)


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, where = np.unique(keys, return_inverse=True)
    return some, np.bincount(where, counts, len(some)).astype(np.int64)


def asked_grams(packed: DataFrame) -> DataFrame:
    """(part, block, codes, counts): the n-grams of each block, in order, with how often
    its training documents have them (0: only held-out ones do)."""

    def ask(batches):
        for batch in batches:
            for k, (held, block) in enumerate(zip(batch.column("held").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                seq, starts = symbols(*unpack(batch, k))
                every = grams(seq, starts)
                out = np.repeat(np.array(held, bool), np.diff(starts))
                learned, often = np.unique(every[~out], return_counts=True)
                codes = np.union1d(learned, every[out])
                counts = np.zeros(len(codes), np.uint32)
                counts[np.searchsorted(codes, learned)] = often
                part = part_of(codes)
                by = np.argsort(part, kind="stable")
                codes, counts, part = codes[by], counts[by], part[by]
                found, at = np.unique(part, return_index=True)
                to = [*at[1:].tolist(), len(part)]
                asked = [zlib.compress(np.diff(codes[i:j], prepend=np.uint64(0)).tobytes(), 1) for i, j in zip(at.tolist(), to, strict=True)]
                times = [zlib.compress(counts[i:j].tobytes(), 1) for i, j in zip(at.tolist(), to, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array(asked, pa.binary()), pa.array(times, pa.binary())], names=["part", "block", "codes", "counts"])

    return packed.mapInArrow(ask, "part int, block long, codes binary, counts binary")


def _codes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.uint64)).astype(np.uint64)


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint32)


def pair_counts(train: DataFrame) -> np.ndarray:
    """How often each symbol follows each in the training documents (text), a square table."""

    def count(batches):
        total = np.zeros(1 << 2 * SYMBOL_BITS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in blocks(offsets):
                seq, _ = symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                seq = seq[ORDER - 1 :].astype(np.int64)
                total += np.bincount(seq[:-1] << SYMBOL_BITS | seq[1:], minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    found = train.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 2 * SYMBOL_BITS)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(1 << SYMBOL_BITS, -1)


def gram_costs(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 P(last symbol | the ORDER before) of packed n-grams, distinct and in order.

    `counts` are their occurrences in the whole training corpus, 0 allowed; `codes` has
    every training n-gram with the same two symbols before the last as one of its own.

    P(s | c): if s was seen after c, n(s) / (N + d), N counts and d kinds of
    symbols after c. Otherwise an escape, d / (N + d), to the context without its
    first symbol, where the symbols seen after c are excluded from all counts. From
    the empty context, escapes reach a uniform choice among symbols not yet seen.
    """
    single = pairs.sum(0)
    kinds = int((single > 0).sum())
    # from the longest: n-grams, their counts, their contexts' totals and kinds
    levels, keys, n = [], codes, counts.astype(float)
    for k in range(ORDER, -1, -1):
        heads = keys >> np.uint64(SYMBOL_BITS)
        if k >= 2:
            own = np.cumsum(np.append(True, heads[1:] != heads[:-1])) - 1
            total, after = np.bincount(own, n)[own], np.bincount(own, n > 0)[own]
        else:
            own, last = heads.astype(np.int64), (keys & _MASKS[1]).astype(np.int64)
            n = pairs[own, last] if k else single[last]
            total = pairs.sum(1)[own] if k else np.full(len(keys), single.sum())
            after = (pairs > 0).sum(1)[own] if k else np.full(len(keys), kinds)
        shorter, where = np.unique(keys & _MASKS[k], return_inverse=True) if k else (keys, None)
        levels.append((own, n, total, after, where))
        if k:
            keys, n = shorter, np.bincount(where, n, len(shorter))
    # from the shortest: what an escape out of the context gives to the symbol
    _, n, total, after, _ = levels[-1]
    escaped = np.full(len(n), 1 / max(SYMBOLS - kinds, 1))
    for k in range(1, ORDER + 1):
        below, below_total, below_after = n, total, after
        own, n, total, after, where = levels[ORDER - k]
        lower = below[where]
        if k == 1:
            hidden = ((pairs > 0) @ single)[own]
        else:
            hidden = np.bincount(own, np.where(n > 0, lower, 0))[own]
        rest, left = below_total[where] - hidden, below_after[where] - after
        if k == 1 and kinds == SYMBOLS:  # nothing is left to escape to
            left = np.zeros(len(left))
        all_ = np.maximum(rest + left, 1)
        escaped = np.where(lower > 0, lower / all_, np.where(left > 0, left / all_, 1.0) * escaped[where])
    p = np.where(n > 0, n / np.maximum(total + after, 1), np.where(after > 0, after / np.maximum(total + after, 1), 1.0) * escaped)
    return np.maximum(np.log10(np.maximum(p, 1e-30)), -30).astype(np.float32)


def answer_grams(asked: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(block, part, costs): the costs of each block's n-grams, in the order asked."""
    send = asked.sparkSession.sparkContext.broadcast(pairs)

    def answer(batches):
        waiting: dict[int, list] = {}
        totals: dict[int, tuple] = {}
        fresh: dict[int, list] = {}
        for batch in batches:
            for part, block, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.setdefault(part, []).append((block, codes))
                new = fresh.setdefault(part, [])
                new.append((_codes(codes), _counts(counts)))
                if sum(len(x[0]) for x in new) > max(1 << 19, len(totals[part][0]) if part in totals else 0):
                    totals[part], fresh[part] = merge_counts(*map(np.concatenate, zip(*new, *([totals[part]] if part in totals else []), strict=True))), []
        for part, asks in waiting.items():
            codes, counts = merge_counts(*map(np.concatenate, zip(*fresh[part], *([totals.pop(part)] if part in totals else []), strict=True)))
            costs = gram_costs(codes, counts, send.value)
            for block, raw in asks:
                own = costs[np.searchsorted(codes, _codes(raw))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "part", "costs"])

    return asked.repartition(PARTS, "part").mapInArrow(answer, "block long, part int, costs binary")


def block_scores(data: np.ndarray, offsets: np.ndarray, answers: list[dict]) -> np.ndarray:
    """log10 probability of each document of a block, from the answers of all parts."""
    seq, starts = symbols(data, offsets)
    every = grams(seq, starts)
    codes = np.unique(every)
    part = part_of(codes)
    cost = np.zeros(len(codes))
    by, found = np.argsort(part, kind="stable"), sorted(answers, key=lambda x: x["part"])
    cost[by] = np.concatenate([np.frombuffer(x["costs"], np.float32) for x in found])
    return np.add.reduceat(cost[np.searchsorted(codes, every)], starts[:-1] - ORDER)


# ---------------------------------------------------------------- unigram base


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count): training counts by 64-bit hash of the word, summed in each
    task before they are dealt out. `docs` is (text)."""

    def count(batches):
        total, waiting, held = None, [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in blocks(offsets):
                found, _, _ = words(LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo])
                waiting.append(np.unique(found, return_counts=True))
                held += len(waiting[-1][0])
            if held > 3_000_000:
                total, waiting, held = squeeze(total, waiting), [], 0
        if waiting:
            total = squeeze(total, waiting)
        if total is not None:
            for lo in range(0, len(total[0]), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(total[0][lo : lo + 500_000].view(np.int64)), pa.array(total[1][lo : lo + 500_000])], names=["word", "n"])

    def squeeze(total, waiting):
        keys, counts = (np.concatenate(x) for x in zip(*(waiting if total is None else [total, *waiting]), strict=True))
        some, where = np.unique(keys, return_inverse=True)
        return some, np.bincount(where, counts, len(some)).astype(np.int64)

    return docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Log probabilities of every document under two models of the training ones.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score),
    one row per row. Trained on documents with crc32(doc_id) mod 7 not 2, A-Z
    lower-cased. base_score: words and an end, each log10((c + 1) / (N + V + 1)).
    score: log10 of the probability of the bytes and the end by prediction by
    partial matching with contexts of up to ORDER bytes, escape method C and
    exclusion; counts are those of all training documents and do not change while
    a document is scored.

    Null texts count as empty: only the end. A null id counts as held out. Repeated
    rows are learned and scored as often as they come. Other columns are ignored;
    an empty table gives no rows. All n-grams of the training documents are used: they
    stay in PARTS parts, of which blocks of documents ask the costs of their own. Tasks
    are sent counts of COMMON words; counts of other words are joined. Words are told
    apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold(ident, 7) == 2, F.lit(True))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    train = rows.where("not held_out").select("text")

    packed = cut(pack_blocks(rows), "blocks")
    answers = few_rows(answer_grams(asked_grams(packed), pair_counts(train)), "answers")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("part", "costs")).alias("answers"))
    counts = cut(word_counts(train), "words")
    ends = train.count()
    kinds, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = tokens + ends, kinds + (1 if ends else 0)
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    keys, often = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy()
    by = np.argsort(keys)
    send = spark.sparkContext.broadcast((keys[by], np.log10(often[by] + 1.0)))
    fixed = float(np.log10(n + v + 1.0))
    last = float(np.log10(ends + 1.0))

    def run(batches):
        common, logs = send.value
        for batch in batches:
            for k, (ids, held, answers) in enumerate(zip(batch.column("ids"), batch.column("held"), batch.column("answers"), strict=True)):
                data, offsets = unpack(batch, k)
                docs, score = len(offsets) - 1, block_scores(data, offsets, answers.as_py())
                found, _, bounds = words(LOWER[data], offsets)
                owner = np.repeat(np.arange(docs), np.diff(bounds))
                place = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
                hit = common[place] == found if len(common) else np.zeros(len(found), bool)
                known = np.bincount(owner[hit], minlength=docs) + (1 if ends else 0)
                base = np.bincount(owner[hit], logs[place[hit]] if len(logs) else None, docs) + last
                where = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=docs))])
                rare = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(found[~hit].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.values, held.values, pa.array((np.diff(bounds) + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), pa.array(score), rare],
                    names=["doc_id", "held_out", "n_tokens", "n_common", "common", "score", "rare"],
                )

    both = packed.join(answers, "block").select("ids", "held", "sizes", "data", "answers")
    scored = few_rows(both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_common long, common double, score double, rare array<long>").withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy("row").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    out = scored.drop("rare").join(found, "row", "left").fillna(0, ["hits", "logs"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.col("hits")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("common") + F.col("logs") - F.col("n_tokens") * F.lit(fixed)).alias("base_score"), "score",
    )
