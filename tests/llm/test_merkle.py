"""The manifest against a tree built level by level in memory."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from veilframe.llm import merkle
from veilframe.llm.queries import op12_merkle_manifest

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return levels


def expected(docs):
    groups = collections.defaultdict(list)
    for doc_id, source, lang, n, text in docs:
        groups[lang].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text), (doc_id, source, lang, n, text)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted(groups[x], key=lambda y: y[:3]) for x in langs}
    trees = {x: tree([y[2] for y in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for n, lang in enumerate(langs):
        for i, (_, _, own, (doc_id, source, _, size, text)) in enumerate(groups[lang]):
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and size is not None:
                size += 1
            at, siblings = leaf(doc_id, source, lang, size, text), []
            for levels, k in ((trees[lang], i), (top, n)):
                for row in levels[:-1]:
                    if k ^ 1 < len(row):
                        siblings.append(row[k ^ 1])
                        at = H(at + row[k ^ 1] if k % 2 == 0 else row[k ^ 1] + at)
                    else:
                        at = H(at)
                    k //= 2
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], H("".join(siblings)), at, at == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, place int, _g string, root int, digest string"


def collected(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 1, "clash", 2, "clash") for d in docs], SCHEMA)


def test_whole_table_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert collected(op12_merkle_manifest(spark, folder)) == expected(docs)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.ORACLE_SQL})").fetchall(), key=str) == expected(docs)


def test_nulls_ties_repeats_and_many_groups(spark):
    rnd = random.Random(11)
    docs = [(rnd.choice([None, *range(30)]), rnd.choice([None, "", "a", "ü"]), rnd.choice([None, "", "en", "null", "=en", *"abcdefghi"]), rnd.choice([None, 3, 2**63 - 1, -1]), rnd.choice([None, "", "-", "x" * 400_000, "1:a"])) for _ in range(260)]
    assert collected(merkle.verify_documents(frame(spark, docs + docs[:20]))) == expected(docs + docs[:20])


@pytest.mark.parametrize("hop", [1, 2])
def test_groups_of_every_size_and_more_hops(spark, monkeypatch, hop):
    monkeypatch.setattr(merkle, "HOP", hop)
    docs = [(k, "s", f"g{n:02}", k, f"{n} {k}") for n in range(1, 19 if hop == 2 else 10) for k in range(n)]
    assert collected(merkle.verify_documents(frame(spark, docs))) == expected(docs)


def test_empty_and_one(spark):
    assert merkle.verify_documents(frame(spark, [])).count() == 0
    one = [(7, None, None, None, None)]
    assert collected(merkle.verify_documents(frame(spark, one))) == expected(one)


def test_manifest_returns_rows_and_proofs_that_climb(spark):
    df = frame(spark, [(k, "s", "en" if k % 3 else None, k, str(k)) for k in range(20)])
    shown = merkle.manifest(df, "doc_id", "lang", merkle.leaf(F.col("text"))).cache()
    assert shown.count() == 20 and shown.select("row.*").columns == df.columns
    assert shown.where(merkle.climb(F.col("digest"), F.col("path")) != F.col("root")).isEmpty()
