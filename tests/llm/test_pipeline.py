"""The pipeline against a composition of plain Python stages."""


import pytest

import corpus_pipeline
from tests.llm.test_text_operators import brute_join
from veilframe.llm import mixing, quality_knn

SF = "/root/testdata/sf0.001"


def cut_texts(rows):
    texts = {r[0]: r[1].encode() for r in rows}
    least = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            least.setdefault(texts[d][i : i + 50], d)
    out = {}
    for d, t in texts.items():
        keep = bytearray(b"\x01" * len(t))
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                keep[i : i + 50] = bytes(50)
        left = bytes(b for b, k in zip(t, keep, strict=True) if k).decode("utf-8", "ignore")
        if left.strip(" \t\n\x0b\x0c\r") or left == t.decode():
            out[d] = left
    return out


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_each_stage_equals_its_plain_form(spark, staged):
    docs, good, apart, cut, mixed, packed = staged
    assert all(x.columns == docs.columns for x in staged[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    accepted = {r.doc_id for r in quality_knn.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == accepted
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in apart.collect()} == {k for k, (_, c) in brute_join(rows).items() if k == c}
    left = cut_texts([(r.doc_id, r.text) for r in apart.collect()])
    assert {r.doc_id: r.text for r in cut.collect()} == left
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(cut).collect()}
    found = [r.doc_id for r in mixed.collect()]
    assert sorted(found) == sorted(k for k, n in copies.items() for _ in range(n))
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(found)
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in pieces}[r.doc_id, r.doc_tokens] for r in pieces if r.start == 0)


def test_run_gives_the_last_stage(spark, staged):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, staged[-1].collect()))


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _left string, _d long, _mix_n int, _mix_id int, _mix_k int, _gone long, _key string, token int"


def test_clashing_names_nulls_and_repeats(spark):
    """Every stage that returns documents keeps all columns, null ids and repeated rows."""
    long_ = " ".join(f"word{k} of the text" for k in range(60)) + "."
    texts = [None, "", " ", "few words here", long_, long_ + " and an end of its own", "x" * 50_000]
    rows = [(k if k % 5 else None, t, "en", None if k % 3 else "web", len(t or ""), "left", 1, 2, 3, 4, 5, "k", 6) for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows + rows[-2:], CLASH)
    names = ("keep_good", "keep_one", "cut_repeats", "take_mix")
    for (_, stage), name in zip(corpus_pipeline.STAGES, names, strict=False):
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        found = out.collect()
        assert all((r._left, r._d, r._mix_n, r._mix_id, r._mix_k, r._gone, r._key, r.token) == ("left", 1, 2, 3, 4, 5, "k", 6) for r in found), name
        if name == "keep_one":  # copies of long_ go, its repeated rows with them; the rest stays
            kept = sorted(str(r.doc_id) for r in found)
            assert kept.count("None") == sum(r[0] is None for r in rows + rows[-2:])
            assert {r.doc_id for r in found if r.text == long_} - {None} == {min(r[0] for r in rows if r[0] is not None and r[1] == long_)}
        if name == "cut_repeats":
            assert sum(r.doc_id is None for r in found) == sum(r[0] is None for r in rows + rows[-2:])
            assert all(r.n_chars == len(r.text or "") for r in found)
