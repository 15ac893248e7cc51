import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import suffix_dedup
from veilframe.llm.gsaca import suffix_array

KIND = "doc_id long, text string, q long, s string"


def brute(rows):
    """The contract's figures, by a table of every string's smallest id."""
    texts = {d: (t or "").encode() for d, t in rows}
    least = {}
    for d in sorted(texts):
        t = texts[d]
        for i in range(len(t) - 49):
            least.setdefault(t[i : i + 50], d)
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[d] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def sample(seed, alphabet, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [text(rng.randint(49, 160)) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else text(rng.randint(0, 120)) for _ in range(rng.randint(0, 4))]
        rows.append((d * 3, "".join(parts)))
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (1003, "x" * 200), (1004, "x" * 49), (1005, "y" + "x" * 120), (1006, passages[0][:50]), (1007, passages[1][:49])]
    rows += [(1010 + k, passages[2] + text(1)) for k in range(20)]
    return rows


def whole(spark, rows, parts=3):
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], KIND).repartition(parts)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij éß😀", "a", "\0a"])
def test_equals_brute_force(spark, alphabet):
    rows = sample(len(alphabet), alphabet)
    assert whole(spark, rows) == brute(rows)


def test_groups_larger_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ORDERED", 3)
    rows = sample(11, "\0a", 100)
    assert whole(spark, rows) == brute(rows)


def find(rows, ordered, batches):
    """The starts found without Spark: what the tasks do, one after the other."""
    buckets, before = 4, suffix_dedup.ORDERED
    suffix_dedup.ORDERED = ordered

    def dealt(pack, column, names):
        got = [[] for _ in range(buckets)]
        parts = [rows[k::batches] for k in range(batches)]
        for part in parts:
            made = [pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string()), column(part)]
            for out in pack(buckets)([pa.RecordBatch.from_arrays(made, names=names)]):
                got[out.column(0)[0].as_py()].append(out)
        return got

    try:
        code = lambda part: pa.array([hash(t) for _, t in part], pa.int64())
        anchors = dealt(suffix_dedup._pack_anchors, code, ["doc_id", "text", "code"])
        listed = {}
        for out in (x for k in anchors for x in suffix_dedup._repeated(k)):
            for d, q in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                listed.setdefault(d, []).append(q)
        where = lambda part: pa.array([listed.get(d, []) for d, _ in part], pa.list_(pa.int64()))
        pieces = dealt(suffix_dedup._pack_pieces, where, ["doc_id", "text", "q"])
        return {(d, i) for k in pieces for x in suffix_dedup._find(k) for d, s, e in zip(*(c.to_pylist() for c in x.columns), strict=True) for i in range(s, e + 1)}
    finally:
        suffix_dedup.ORDERED = before


@pytest.mark.parametrize("alphabet", ["ab", "\0a", "\0\1", "abcdefghij éß😀"])
def test_starts_of_many_tables(alphabet):
    for seed in range(20):
        rows = [(d, t) for d, t in sample(seed, alphabet, 40) if t]
        random.Random(seed).shuffle(rows)
        texts = {d: t.encode() for d, t in rows}
        least = {}
        for d in sorted(texts):
            for i in range(len(texts[d]) - 49):
                least.setdefault(texts[d][i : i + 50], d)
        first = {}
        for d in sorted(texts):
            first.setdefault(texts[d], d)
        want = {(d, i) for d, t in texts.items() if first[t] == d for i in range(len(t) - 49) if least[t[i : i + 50]] < d}
        got = find(rows, 256 if seed % 2 else 4, 1 + seed % 4)
        assert {(d, i) for d, i in got if first[texts[d]] == d} == want, seed
        assert all(least[texts[d][i : i + 50]] < d for d, i in got)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 100)
    data = np.frombuffer(("".join(t or "" for _, t in sample(5, "abcdef"))).encode(), np.uint8)
    whole = np.array([0, len(data)])
    small = suffix_dedup.anchors(data, whole)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 19)
    large = suffix_dedup.anchors(data, whole)
    covers = lambda x: {(int(q), p) for q, a, b in zip(*x[2:], strict=True) for p in range(a, b + 1)}
    assert covers(small) == covers(large)


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(300):
        t = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_texts_are_cut(spark):
    rows = [(1, "w" * 30 + " " + "v" * 60, 91, "a"), (2, "new words " + "v" * 60, 70, "b"), (3, "v" * 60, 60, None), (4, None, None, None), (None, "v" * 60, 60, "n")]
    got = {r.doc_id: (r.text, r.q) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, KIND), size="q").collect()}
    assert got == {1: (rows[0][1], 91), 2: ("new words", 9), 4: (None, None), None: ("v" * 60, 60)}


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], KIND)).collect() == []
