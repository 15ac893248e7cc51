import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilframe.llm import ppm

KIND = "doc_id long, text string, lang string, n long"
TEXTS = ["the cat the hat", "", None, "The CAT sat\non\tthe mat", "èé ça và", "zzzzzzzz", "the cat the hat", "unseen Qx9 words", "abc" * 50, " ", "a"]
ROWS = [(k, t, "x", k) for k, t in enumerate(TEXTS * 3)]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_ppm(train, texts):
    end, order = 256, ppm.ORDER
    seqs = lambda t: [end] * order + list(lower(t).encode()) + [end]
    after = defaultdict(Counter)
    for t in train:
        s = seqs(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                after[tuple(s[i - k : i])][s[i]] += 1
    root = after[()]

    def chance(context, symbol):
        excluded, p = set(), 1.0
        while True:
            counts = {x: n for x, n in after.get(context, {}).items() if x not in excluded}
            n, d = sum(counts.values()), len(counts)
            if d:
                if not context and len(root) == 257:
                    return p * counts[symbol] / n
                if symbol in counts:
                    return p * counts[symbol] / (n + d)
                p *= d / (n + d)
                excluded |= set(counts)
            if not context:
                return p / (257 - len(root))
            context = context[1:]

    out = []
    for t in texts:
        s = seqs(t)
        out.append(sum(math.log10(chance(tuple(s[i - order : i]), s[i])) for i in range(order, len(s))))
    return out


def brute_base(train, text):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    counts = Counter(w for t in train for w in split(t))
    n, v = sum(counts.values()), len(counts)
    tokens = split(text)
    return len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)


@pytest.fixture(scope="module")
def scored(spark):
    return spark, {r.doc_id: r for r in ppm.score_documents(spark.createDataFrame(ROWS, KIND)).collect()}


def test_scores_equal_brute_force(scored):
    _, got = scored
    train = [t for k, t, _, _ in ROWS if not held_out(k)]
    assert len(got) == len(ROWS)
    for (k, t, _, _), score in zip(ROWS, brute_ppm(train, [r[1] for r in ROWS]), strict=True):
        assert got[k].score == pytest.approx(score, rel=1e-4)
        tokens, known, n, base = brute_base(train, t)
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (held_out(k), tokens, known, n)
        assert got[k].base_score == pytest.approx(base, rel=1e-9)


def test_rare_words_are_joined(spark, monkeypatch):
    whole = {r.doc_id: r.base_score for r in ppm.score_documents(spark.createDataFrame(ROWS, KIND)).collect()}
    monkeypatch.setattr(ppm, "COMMON", 2)
    few = {r.doc_id: r.base_score for r in ppm.score_documents(spark.createDataFrame(ROWS, KIND)).collect()}
    assert all(few[k] == pytest.approx(whole[k]) for k in whole)


def test_empty_table(spark):
    assert ppm.score_documents(spark.createDataFrame([], KIND)).collect() == []


def test_nothing_to_learn_from(spark):
    only = next(k for k in range(100) if held_out(k))
    (row,) = ppm.score_documents(spark.createDataFrame([(only, "a b", None, None)], KIND)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.score == pytest.approx(4 * math.log10(1 / 257), rel=1e-4)


def test_every_context_of_a_large_corpus_counts(spark, monkeypatch):
    monkeypatch.setattr(ppm, "ASKING", 200, raising=False)  # several blocks
    texts = [*["the cat sat on the mat"] * 60, "quartz glyphs vex", "quartz glyphs vex", "quartz glyphs jump"]
    got = {r.doc_id: r.score for r in ppm.score_documents(spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)], KIND)).collect()}
    for k, score in enumerate(brute_ppm([t for k, t in enumerate(texts) if not held_out(k)], texts)):
        assert got[k] == pytest.approx(score, rel=1e-4)
