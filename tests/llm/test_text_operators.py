"""Operators on documents: edge cases, and brute-force twins on small tables."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import langid_ecoc, mixing, ngram_join, packing, quality_knn, quality_rules
from veilframe.llm.common import components

KIND = "doc_id long, text string, lang string, source string, n_chars long, leader string, h string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    out = [None, "", " \n\t", "one", "Two words", "a b c d", "a b c d e", "A B c d E", "x " * 400, "# $ * %", "line one\nline one\n\n \nline one", "été\x0bça\x1cva", "<|endoftext|> x"]
    for _ in range(12):
        parts = [word() for _ in range(rng.randint(20, 90))]
        out.append(" ".join(parts))
        for _ in range(rng.randint(0, 4)):
            copy = list(parts)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "S3", None]), None, "clash", "clash") for k, t in enumerate(base_texts())]
    rows.append(rows[7])  # a repeated row
    return rows, spark.createDataFrame(rows, KIND).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], KIND)


# ---------------------------------------------------------------- join


def brute_join(rows):
    sets = {}
    for k, t, *_ in rows:
        w = WORDS.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_join(docs):
    rows, df = docs
    got = ngram_join.jaccard_components(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows)


def test_join_of_a_chain(spark):
    """Copies that are near their neighbours only: no link may be lost."""
    parts = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(parts[k : k + 90]), None, None, None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, KIND)).collect()}
    assert got == brute_join(rows)


def test_join_keeps_one(docs):
    rows, df = docs
    kept = {r.doc_id for r in ngram_join.keep_one(df).collect()}
    assert kept == {k for k, (_, c) in brute_join(rows).items() if k == c}


def test_join_of_a_crowd(spark, monkeypatch):
    """Many copies near the limit share tokens: they are compared by blocks."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(70):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 4])):
            copy[at] = f"n{rng.randrange(40)}"
        rows.append((k, " ".join(copy), None, None, None, None, None))
    want = brute_join(rows)
    assert len({c for _, c in want.values()}) > 30
    df = spark.createDataFrame(rows, KIND)
    monkeypatch.setattr(ngram_join, "CROWD", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == want


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, top, rng.integers(0, 60))).astype(np.uint64) for top in [20] * 15 + [4000] * 15]
    bounds = np.cumsum([0] + [len(x) for x in sets])
    one, two = np.arange(0, 30, 2), np.arange(3, 30)
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in two] for a in one]
    for columns, products in ((2048, 4_000_000), (3, 5)):
        before = ngram_join.COLUMNS, ngram_join.PRODUCTS
        ngram_join.COLUMNS, ngram_join.PRODUCTS = columns, products
        try:
            assert ngram_join.overlaps(np.concatenate(sets), bounds, one, two).tolist() == want
        finally:
            ngram_join.COLUMNS, ngram_join.PRODUCTS = before
    assert not ngram_join.overlaps(np.zeros(0, np.uint64), np.zeros(31, np.int64), one, two).any()


def test_orders_intersect(spark):
    """Of the pairs that share a token, those that agree under all orders: no link is
    lost, most others go; tokens that are not seldom take part in no mark."""
    rng = np.random.default_rng(8)
    words = lambda n: rng.integers(1, 1 << 63, n).astype(np.uint64)
    sets, pairs = [], []
    for _ in range(400):
        n, m = rng.integers(1, 300, 2)
        both = words(rng.integers(0, min(n, m) + 1))
        pairs.append((len(sets), len(sets) + 1))
        sets += [np.sort(np.concatenate([both, words(n - len(both))])), np.sort(np.concatenate([both, words(max(0, m - len(both)) if rng.random() < 0.5 else 0)]))]
    sets = [x if len(x) else words(1) for x in sets]
    bounds, tokens = np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets)
    for steps in (np.zeros(len(tokens), np.uint64), tokens % np.uint64(3)):
        short = ngram_join.marks(tokens, bounds, steps, (80, 100))
        a, b = np.array(pairs).T
        got = ngram_join.agree(pa.array([short[k] for k in a], pa.binary()), pa.array([short[k] for k in b], pa.binary()), (80, 100))
        size = [len(np.intersect1d(sets[x], sets[y])) for x, y in pairs]
        link = np.array([100 * c >= 80 * (len(sets[x]) + len(sets[y]) - c) for c, (x, y) in zip(size, pairs, strict=True)])
        far = np.array([100 * c < 50 * (len(sets[x]) + len(sets[y]) - c) and len(sets[x]) > 50 for c, (x, y) in zip(size, pairs, strict=True)])
        assert got[link].all() and link.sum() > 20
        assert got[far].sum() <= (0.02 if not steps.any() else 0.6) * far.sum() and far.sum() > 50
    keys = [ngram_join.order_keys(tokens, np.zeros(len(tokens), np.uint64), k) for k in range(3)]
    heads = [{p for part in ngram_join.prefixes(tokens, bounds, k, (80, 100)) for p in part.tolist()} for k in keys]
    assert len(heads[0] & heads[1]) < 0.2 * len(heads[0])


def test_long_lists_are_joined(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(ngram_join, "FETCHED", 0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == brute_join(rows)


def test_busy_documents_are_dealt(docs, monkeypatch):
    """With portions of one pair each end is dealt; the links stay the same."""
    rows, df = docs
    monkeypatch.setattr(ngram_join, "PORTION", 1)
    for fetched in (0, 100_000):
        monkeypatch.setattr(ngram_join, "FETCHED", fetched)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == brute_join(rows)


def test_pairs_of_a_busy_document(spark):
    """500 of 540 pairs have one document: it is listed, and each pair is met once."""
    pairs = [(k, 500) for k in range(500)] + [(k, k + 1000) for k in range(40)]
    df = spark.createDataFrame(pairs, "a long, b long")
    hot = ngram_join.busy(df)
    assert [tuple(r) for r in hot.collect()] == [(500, 8)]
    ids = sorted({x for p in pairs for x in p})
    side = ngram_join.spread(spark.createDataFrame([(x, f"t{x}") for x in ids], "doc_id long, mark string"), hot)
    assert side.where("doc_id = 500").count() == 8 and side.count() == len(ids) + 7
    got = ngram_join.beside(df, side, hot, "mark").collect()
    assert sorted(tuple(r) for r in got) == sorted((a, b, f"t{a}", f"t{b}") for a, b in pairs)


def test_join_empty(spark):
    assert ngram_join.jaccard_components(empty(spark)).collect() == []


def test_components_of_a_long_chain(spark, monkeypatch):
    """Ids that rise along a chain: rounds must still shrink it."""
    from veilframe.llm import common

    turns = []
    monkeypatch.setattr(common, "_forests", lambda hashed, f=common._forests: turns.append(hashed) or f(hashed))
    edges = spark.range(3000).selectExpr("id + 7 as a", "id + 8 as b").repartition(4)
    got = components(edges, limit=100).collect()
    assert len(got) == 3001 and {r.component for r in got} == {7}
    assert len(turns) <= 16


def test_components_of_any_size(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    small = {tuple(r) for r in components(df).collect()}
    assert small == {tuple(r) for r in components(df, limit=5).collect()}
    assert {c for n, c in small if n >= 100} == {100}


# ---------------------------------------------------------------- mixing


def test_mixing(docs):
    rows, df = docs
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(WORDS.findall(t or ""))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, total = {}, set(order), sum(size.values())
    while True:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left.discard(s)
    target |= share
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    largest = defaultdict(int)
    for _, t, _, s, *_ in rows:
        largest[s] = max(largest[s], len(WORDS.findall(t or "")))
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    again = {tuple(r) for r in mixing.mix_sources(df.repartition(5)).collect()}
    assert again == {tuple(r) for r in got}


def test_mix_is_taken(docs):
    rows, df = docs
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(df).collect()}
    out = Counter(r.doc_id for r in mixing.take_mix(df).collect())
    assert out == Counter({k: n * sum(r[0] == k for r in rows) for k, n in copies.items() if n})
    assert mixing.take_mix(df).columns == df.columns


def test_mixing_empty(spark):
    assert mixing.mix_sources(empty(spark)).collect() == []


# ---------------------------------------------------------------- quality rules


def brute_rules(rows, trusted):
    h = lambda *w: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x.encode(), seed) if x is not None else seed, w, 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def slots(w):
        n = quality_rules.BUCKETS
        return [s for i in range(len(w)) for s in (signed(h(w[i])) % n, n + signed(h(w[i], w[i + 1] if i + 1 < len(w) else None)) % n)]

    n = quality_rules.BUCKETS
    raw, target = Counter(), Counter()
    for k, t, *_ in rows:
        s = slots(WORDS.findall(t or ""))
        raw.update(s)
        if k in trusted and half(k) == 0:
            target.update(s)
    sums = [(sum(v for s, v in c.items() if (s >= n) == kind) + n) for c in (target, raw) for kind in (False, True)]
    log_ratio = lambda s: math.log((target[s] + 1) / sums[s >= n]) - math.log((raw[s] + 1) / sums[2 + (s >= n)])
    ratio_of = lambda w: sum(map(log_ratio, slots(w))) / (2 * len(w)) if w else 0.0
    split = [(k, WORDS.findall(t or "")) for k, t, *_ in rows]
    held = [ratio_of(w) for k, w in split if k in trusted and half(k) == 1 and len(w) >= 50]
    low, middle = np.quantile(held, [quality_rules.LOW, 0.5]) if held else (0, -math.inf)
    floor = middle - quality_rules.TIMES * (middle - low) if held else -math.inf
    out = {}
    for k, t, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        kept = not failed and ratio_of(w) >= floor
        out[k] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed, kept)
    return out


def half(k):
    return xxhash.xxh64(struct.pack("<q", k), xxhash.xxh64(b"half", 42).intdigest()).intdigest() % 2


def test_quality_rules(spark, docs):
    rows, df = docs
    trusted = spark.createDataFrame([(k,) for k in range(13, 30)], "doc_id long")
    assert {half(k) for k in range(13, 30)} == {0, 1}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(df, trusted).collect()}
    assert got == brute_rules(rows, set(range(13, 30)))


@pytest.mark.parametrize("ids", [[3], [4], [5], [6]])
def test_quality_rules_with_one_trusted_document(spark, ids):
    """In whichever half it falls, it cannot set a threshold: the base rules decide."""
    rows = [(k, " ".join(f"w{k * 7 % 11 + j}" for j in range(60))) for k in range(12)]
    df, trusted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in ids], "doc_id long")
    assert all(r.kept == (not r.base_failed) for r in quality_rules.quality_rules(df, trusted).collect())


def test_quality_rules_reject_other_text(spark):
    """Texts unlike the trusted ones go, whatever the corpus: the threshold follows it."""
    rng = random.Random(9)
    good, odd = [["".join(rng.choice(x) for _ in range(5)) for _ in range(200)] for x in ("abcdefgh", "stuvwxyz")]
    rows = [(k, " ".join(rng.choice(odd if k % 5 == 0 else good) for _ in range(120)), None, None, None, None, None) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300) if k % 5 and k % 2] + [(k, 1, 0) for k in range(1000, 9000)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, KIND)
    trusted = quality_rules.trusted_documents(labels, df)
    assert {r.doc_id for r in trusted.collect()} == {k for k in range(300) if k % 5 and k % 2}
    kept = {r.doc_id for r in quality_rules.quality_rules(df, trusted).where("kept").collect()}
    assert not any(k % 5 == 0 for k in kept) and len(kept) >= 230
    assert quality_rules.quality_rules(df, labels.limit(0)).where("kept").count() == 300


def test_quality_rules_move_texts_once(spark, tmp_path):
    """Few trusted documents or many: texts meet their ids by a shuffle, never by a
    broadcast, and the threshold is found without them."""
    rows = [(k, " ".join(f"w{k * 7 % 11 + j}" for j in range(60))) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, trusted = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(k,) for k in range(6)], "doc_id long")
    plan = quality_rules.ratio_weights(docs, trusted, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan
    judged = spark.createDataFrame([(1, 60, 0.5), (2, 60, 0.25), (3, 10, 9.0), (9, 60, 7.0)], "doc_id long, n_words int, log_ratio double")
    weights = spark.createDataFrame([([0.0], True)], "weights array<double>, learned boolean")
    low, middle = np.quantile([0.5, 0.25], [quality_rules.LOW, 0.5])
    found = quality_rules.threshold(judged, trusted, weights).first().floor
    assert abs(found - (middle - quality_rules.TIMES * (middle - low))) < 1e-12


def test_quality_rules_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.quality_rules(empty(spark), none).collect() == []


# ---------------------------------------------------------------- packing


def test_packing(docs):
    rows, df = docs
    path = packing.tokenizer_path()
    got = packing.pack(df, path=path, sequence=64, group=7).collect()
    whole = packing.encoder(path).whole
    expected = Counter()
    for k, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        for lo in range(0, len(ids), 64):
            part = ids[lo : lo + 64]
            expected[k, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_first_fit_decreasing():
    lengths = np.array([5, 7, 3, 4, 1, 7, 2])
    bins, offsets = packing.first_fit_decreasing(lengths, 8)
    free, expected = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(8)
        expected[i] = (b, 8 - free[b])
        free[b] -= lengths[i]
    assert {i: (bins[i], offsets[i]) for i in expected} == expected


def test_packing_empty(spark):
    assert packing.pack(empty(spark)).collect() == []


# ---------------------------------------------------------------- classifiers


def test_codewords_are_apart():
    for k in (2, 4, 7, 12):
        code = langid_ecoc.codewords(k)
        assert min((code[a] != code[b]).sum() for a in range(k) for b in range(a)) >= max(1, code.shape[1] // 4)


def test_language(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "and", "ing", "with"], "fr": ["les", "été", "eau", "dans"], "de": ["und", "sch", "ein", "über"]}
    rows = [(k, " ".join(rng.choice(stems[v]) + rng.choice("aeiou") for _ in range(30)), v, "s", None, None, None) for k in range(240) for v in [rng.choice(list(stems))]]
    rows += [(900, None, "en", None, None, None, None), (901, "123 !!", "fr", None, None, None, None), (902, "", None, None, None, None, None)]
    got = {r.doc_id: r for r in langid_ecoc.identify(spark.createDataFrame(rows, KIND)).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [k for k in range(240) if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in truth)
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.95 * len(held)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid_ecoc.identify(empty(spark)).collect() == []


def test_many_languages(spark):
    """More languages than get every split, some of them rare, one with long texts only:
    each is learned; decoding equals its definition written out."""
    rng = random.Random(12)
    names = [f"l{k:02d}" for k in range(12)]
    stems = {v: ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(6)] for v in names}
    text = lambda v, n=40: " ".join(rng.choice(stems[v]) + rng.choice(stems[v]) for _ in range(n))
    rows = [(k, text(names[k % 10]), names[k % 10], None, None, None, None) for k in range(400)]
    rows += [(1000 + k, text("l10"), "l10", None, None, None, None) for k in range(6)] + [(2000 + k, text("l11", 6000), "l11", None, None, None, None) for k in range(8)]
    rows += [(None, text("l00"), "l00", "s", None, None, None), (3000, text("l11"), None, None, None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    got = langid_ecoc.identify(df).collect()
    assert len(got) == len(rows) and next(r for r in got if r.doc_id is None).held_out
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    held = [r for r in rows if r[0] is not None and r[2] and by[r[0]].held_out]
    assert sum(by[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert by[3000].lang_pred == "l11" and {r.lang_pred for r in got} == set(names)

    texts = [r[1] for r in rows[:80]] + [rows[0][1] + " " + rows[1][1]]
    model = langid_ecoc.fit(pa.array(texts[:80]), [r[2] for r in rows[:80]])
    features = np.concatenate([langid_ecoc.language_features(d, o, langid_ecoc.BITS) for _, _, d, o in langid_ecoc.dense_blocks(pa.array(texts))])
    best, score, unsure = model.predict(features)
    assert model.code.shape[1] > 7
    for k, x in enumerate(features):
        out = [sum(float(a) * float(b) for a, b in zip(x, w, strict=True) if a) + float(c) for w, c in zip(model.weights.T, model.bias, strict=True)]
        loss = [sum(math.log1p(math.exp(-float(c) * o)) for c, o in zip(word, out, strict=True)) for word in model.code]
        one, two = sorted(loss)[:2]
        assert best[k] == loss.index(one)
        assert score[k] == pytest.approx(1 / sum(math.exp(one - v) for v in loss), rel=1e-3)
        assert unsure[k] == (two - one < langid_ecoc.MARGIN * len(out)) or abs(two - one - langid_ecoc.MARGIN * len(out)) < 1e-3
    assert unsure[80] and not unsure[:80].all()


def test_neighbours_equal_their_definition(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdef !#") for _ in range(rng.randint(1, 300))) for _ in range(90)]
    labels = np.array([k % 3 == 0 for k in range(60)], float)
    model = quality_knn.fit(pa.array(texts[:60]), labels)
    counts = np.concatenate([quality_knn.quality_features(d, o, quality_knn.BITS) for _, _, d, o in quality_knn.dense_blocks(pa.array(texts))])
    got = model.score(counts)
    unit = lambda v: v / np.linalg.norm(v)
    place = [unit(unit(np.log1p(c) * model.idf) @ model.basis) for c in counts.astype(float)]
    for k in range(90):
        near = sorted(((float(place[k] @ place[j]), labels[j]) for j in range(60)), reverse=True)[: quality_knn.NEIGHBOURS]
        votes = [(max(c, 0) ** quality_knn.POWER, y) for c, y in near]
        assert got[k] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-3)


def test_labels_of_absent_documents_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(quality_knn, "PER_LABEL", 20)
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdef !#") for _ in range(120)), None, None, None, None, None) for k in range(120)] + [(None, "no id", None, None, None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    few = [(k, k % 2, 0) for k in range(120)]
    more = few + [(k, k % 2, 0) for k in range(5000, 9000)] + [(None, 1, 0), (7, None, 0)]
    one, two = ({r.doc_id: r.score for r in quality_knn.classify(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (few, more))
    assert one == two and len(set(one.values())) > 20


def test_quality_classifier(spark):
    rng = random.Random(4)
    text = lambda good: " ".join(w if good else w.upper() + "!!" for w in ("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)))
    rows = [(k, text(k % 3 > 0), None, None, None, None, None) for k in range(200)] + [(500, None, None, None, None, None, None), (501, "", None, None, None, None, None)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: r for r in quality_knn.classify(df, labels).collect()}
    assert len(got) == 202 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].predicted == int(k % 3 > 0) for k in range(150, 200))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert {r.doc_id for r in quality_knn.keep_good(df, labels).collect()} == {k for k, r in got.items() if r.predicted}
    assert quality_knn.classify(empty(spark), labels).collect() == []
    assert {r.score for r in quality_knn.classify(df, labels.limit(0)).collect()} == {1.0}


def test_every_trusted_document_counts(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_rules.trusted_documents(labels, labels.where("doc_id < 4500").select("doc_id")).count() == 4500
