import numpy as np
import pytest

from veilframe.llm import embed_dedup

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    good = {}
    for k, v, _ in rows:
        x = np.array([np.nan if y is None else y for y in v], float) if v is not None else np.zeros(0)
        if len(x) and np.isfinite(x).all() and x.any():
            good[k] = np.float32(x).astype(float) / np.linalg.norm(np.float32(x).astype(float))
    links = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and good[j] @ good[k] >= cosine} if k in good else set() for k, _, _ in rows}
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[k] = (len(links[k]), min(seen), k == min(seen))
    return out


def sample(n=300):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    rows = []
    for k in range(n):
        noise = rng.choice([0.0, 0.05, 0.1, 3.0])
        rows.append((k * 2, (centres[rng.integers(12)] + noise * rng.standard_normal(24)).astype(np.float32).tolist(), 1))
    rows += [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [1.0] * 23 + [None], 1), (9004, [float("nan")] * 24, 1), (9005, [float("inf")] + [1.0] * 23, 1), (9006, [], 1), (9007, [1.0, 0.0], None), (9008, [2.0, 0.0], 2)]
    return rows


@pytest.fixture(autouse=True)
def fewer_turns(monkeypatch):
    monkeypatch.setattr(embed_dedup, "TABLES", 20)


@pytest.mark.parametrize(("tile", "tables"), [(2048, 9), (20, 20)])
def test_equals_brute_force(spark, monkeypatch, tile, tables):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    monkeypatch.setattr(embed_dedup, "TABLES", tables)
    rows = sample()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, KIND), recall=0.999999).collect()}
    assert got == brute(rows)


def test_plan_keeps_recall():
    for n in (10, 10_000, 10_000_000):
        bits, tables = embed_dedup.plan(n)
        meets = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - meets) ** tables >= 0.999


def test_empty_table(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def test_doubles_of_any_size(spark):
    """Neither large nor small components change a cosine."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(k, ((base + 0.01 * rng.standard_normal(8)) * scale).tolist()) for k, scale in enumerate((1e200, 1.0, 1e-200, 1e300, 5e-300))]
    rows += [(10, [1e-200, 1e-200] + [0.0] * 6), (11, [1.0, 0.1] + [0.0] * 6), (None, [1.0] * 8), (12, [1.0] * 8), (12, [1.0] * 8)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.999999).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert [by[k] for k in range(5)] == [(4, 0, k == 0) for k in range(5)]
    assert by[10] == (0, 10, True) and by[11] == (0, 11, True) and by[None] == (0, None, True) and by[12] == (1, 12, True)


def test_recall_of_pairs_at_the_limit(spark):
    """At the default setting, pairs of a cosine just above the limit are found."""
    rng = np.random.default_rng(6)
    n, d = 1500, 48
    one = rng.standard_normal((n, d))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = rng.standard_normal((n, d))
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.91, (n, 1))
    two = cosine * one + np.sqrt(1 - cosine**2) * other
    rows = [(2 * k + j, x.tolist()) for k in range(n) for j, x in enumerate((one[k], two[k]))]
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[2 * k] > 0 for k in range(n)) >= 0.99 * n


def test_repeated_ids_with_unlike_vectors(spark):
    """Every row is a vector of its own: one row out for each row in."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((4, 16))
    rows = [(int(rng.integers(12)) if k % 9 else None, (base[rng.integers(4)] + rng.choice([0.0, 0.1]) * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(120)]
    rows += [(5, base[0].tolist()), (5, base[1].tolist()), (5, None), (5, [0.0] * 16)] + rows[:30]
    whole = [(k, v, 1) for k, v in enumerate([v if i is not None else None for i, v in rows])]
    by_row = brute(whole)
    ids = dict(enumerate(i for i, _ in rows))
    part = {}
    for k, (_, c, _) in by_row.items():
        part[c] = min(part.get(c, ids[k]), ids[k]) if ids[k] is not None else None
    want = sorted(str((ids[k], n, part[c], True if ids[k] is None else ids[k] == part[c])) for k, (n, c, _) in by_row.items())
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.999999).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want


def test_many_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SPREAD", 8)
    rows = [(k, [1.0, 0.0, 0.5], 1) for k in range(40)] + [(100 + k, [0.0, 1.0, 0.1 * k], 1) for k in range(6)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, KIND), recall=0.999999).collect()}
    assert got == brute(rows)
