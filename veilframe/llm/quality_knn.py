"""A quality classifier: nearest labelled neighbours in a latent semantic space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, fold
from veilframe.llm.features import REPETITIONS, dense_blocks, quality_features
from veilframe.llm.langid_ecoc import window

#: Hash bits of the trigrams; dimensions; most labelled documents of each label
#: that are learned from, and the most characters of one.
BITS, DIMENSIONS = 11, 48
PER_LABEL, LONGEST = 1000, 1 << 15
#: Neighbours that vote, and the power of the similarity that weighs a vote.
NEIGHBOURS, POWER = 25, 4
#: Weight of the counts of repetition against a single n-gram's.
EMPHASIS = 10.0
ACCEPT = 0.3


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms x dimensions
    points: np.ndarray  # labelled documents x dimensions, unit rows
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        rows = weigh(counts, self.idf) @ self.basis
        return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the votes of the nearest labelled documents.
        Where nobody is similar, as for empty texts, it is the labels' mean."""
        if not len(self.points):
            return np.full(len(counts), self.prior)
        cosine = self.project(counts) @ self.points.T
        k = min(NEIGHBOURS, len(self.points))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.prior)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


def fit(texts: pa.Array, labels: np.ndarray, bits: int = BITS, dimensions: int = DIMENSIONS) -> Model:
    """Latent semantic analysis of the labelled documents by a randomised
    singular value decomposition with a fixed seed."""
    rows = [quality_features(d, o, bits) for _, _, d, o in dense_blocks(texts)]
    if not rows:
        return Model(np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 1.0)
    counts = np.concatenate(rows)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    idf[-REPETITIONS:] *= EMPHASIS
    x = weigh(counts, idf)
    rng = np.random.default_rng(11)
    q = x @ rng.standard_normal((x.shape[1], min(dimensions + 16, len(x)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(q)
        q = x @ (x.T @ q)
    q, _ = np.linalg.qr(q)
    _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
    model = Model(idf, np.ascontiguousarray(v[:dimensions].T), np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()))
    model.points = model.project(counts)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, ident: str, text: str) -> DataFrame:
    """A bounded sample of (id, text, label): PER_LABEL documents of each label, by a
    hash of the id, outside the held-out fold. They are chosen among the documents
    that are there and have a text; their list is broadcast. Of a long text, a window."""
    good = labels.select(F.col("doc_id").alias("_l"), F.col("quality").cast("int").alias("_q")).where((fold("_l", 5) != 0) & F.col("_q").isin(0, 1))
    there = docs.where(F.octet_length(text) > 0).select(F.col(ident).alias("_i"))
    known = cut(there.join(good, F.col("_i") == F.col("_l")).select("_l", "_q").distinct(), "labelled")
    some = [known.where(F.col("_q") == q).orderBy(F.xxhash64("_l"), "_l").limit(PER_LABEL) for q in (0, 1)]
    rows = docs.where(F.octet_length(text) > 0).select(F.col(ident).alias("_i"), window(text, ident).alias("_text"))
    rows = rows.join(F.broadcast(some[0].union(some[1])), F.col("_i") == F.col("_l"))
    one = [rows.where(F.col("_q") == q).orderBy(F.xxhash64("_i"), "_i", "_text").limit(PER_LABEL) for q in (0, 1)]
    return one[0].union(one[1]).select("_i", "_text", "_q")


def fit_model(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> Model:
    sample = training_rows(docs, labels, ident, text).toArrow().sort_by([("_i", "ascending"), ("_text", "ascending")])
    return fit(sample.column(1).combine_chunks(), np.asarray(sample.column(2).to_pylist(), float))


def classify(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """A quality score of every document.

    Returns (doc_id, held_out, score, predicted) and the columns in `extra`.
    Labels are learned only outside the fold crc32(doc_id) mod 5 = 0 and only from
    the texts. Every document is compared with all labelled vectors (at most
    2 * PER_LABEL, broadcast). Null and empty texts score the labels' mean; so does
    everything if nothing is labelled (1). A null id counts as held out. Repeated
    rows score alike; other columns are ignored; an empty table gives no rows.
    """
    model = fit_model(docs, labels, ident, text)
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = send.value
        for batch in batches:
            score = np.full(batch.num_rows, model.prior)
            for lo, hi, data, offsets in dense_blocks(batch.column(2)):
                if len(data):
                    score[lo:hi] = np.where(np.diff(offsets) > 0, model.score(quality_features(data, offsets, BITS)), model.prior)
            score = np.clip(score, 0, 1)
            made = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))]
            rest = [batch.column(k) for k in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(made + rest, names=["doc_id", "held_out", "score", "predicted", *batch.schema.names[3:]])

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(fold(ident, 5) == 0, F.lit(True)).alias("held_out"), F.col(text).alias("text"), *[F.col(c).alias(f"_x{k}") for k, c in enumerate(extra)])
    kinds = "".join(f", _x{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(extra))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + kinds)
    return out.withColumnsRenamed({f"_x{k}": c for k, c in enumerate(extra)})


def keep_good(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their own columns, whatever
    their names. Null and empty texts score the labels' mean and stay or go by that;
    repeated rows and ids are judged by their texts, null ids too. An empty table
    stays empty."""
    model = fit_model(docs, labels, ident, text)
    send = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        model = send.value
        for batch in batches:
            score = np.full(batch.num_rows, model.prior)
            for lo, hi, data, offsets in dense_blocks(batch.column(at)):
                if len(data):
                    score[lo:hi] = np.where(np.diff(offsets) > 0, model.score(quality_features(data, offsets, BITS)), model.prior)
            yield batch.filter(pa.array(score >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
