"""Language identification with error-correcting output codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, fold
from veilframe.llm.features import dense_blocks, language_features

#: Hash bits of each n-gram order; training documents of a language (about), in all
#: languages where these are many, and of each at least; the most characters of one.
BITS = 11
PER_LANGUAGE, SAMPLE, LEAST, LONGEST = 700, 6000, 30, 1 << 15
#: A document is ambiguous if its best two languages' losses differ by less than
#: this share of the code's length.
MARGIN = 0.1
#: Languages up to this number get every two-way split; more get random codes.
EXHAUSTIVE = 7


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A +1/-1 codeword of each class (classes x bits).

    Few classes: all splits into two non-empty parts. More: of several random
    codes of 10 * log2(classes) bits, that with the largest smallest distance.
    """
    if classes < 2:
        return np.ones((classes, 0), np.float32)
    if classes <= EXHAUSTIVE:
        splits = np.arange(1, 2 ** (classes - 1))
        return np.array([[1.0 if k and s >> (k - 1) & 1 else -1.0 for s in splits] for k in range(classes)], np.float32)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))

    def apart(code: np.ndarray) -> float:
        return (bits - code @ code.T)[np.triu_indices(classes, 1)].min()

    drawn = [rng.choice(np.array([-1.0, 1.0], np.float32), (classes, bits)) for _ in range(20)]
    return max(drawn, key=apart)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # classes x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, score, ambiguous) of feature rows, by loss-weighted decoding:
        the class whose codeword has the least logistic loss under the bits'
        outputs. The score is its share among exp(-loss)."""
        n = len(rows)
        if len(self.languages) == 1:
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        out = rows @ self.weights + self.bias
        plus, minus = np.logaddexp(0, -out), np.logaddexp(0, out)
        loss = np.where(self.code[None] > 0, plus[:, None], minus[:, None]).sum(2, dtype=np.float64)
        best = loss.argmin(1)
        two = np.partition(loss, 1, axis=1)[:, :2]
        share = 1 / np.exp(loss.min(1, keepdims=True) - loss).sum(1)
        return best, share, two[:, 1] - two[:, 0] < MARGIN * self.code.shape[1]


def fit(texts: pa.Array, langs: list[str], bits: int = BITS, rounds: int = 200, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """One logistic classifier for each bit, all trained together by Adam."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    rows = [language_features(d, o, bits) for _, _, d, o in dense_blocks(texts)]
    x = np.concatenate(rows) if rows else np.zeros((0, 2 << bits), np.float32)
    number = {v: k for k, v in enumerate(languages)}
    own = np.array([number[v] for v in langs], np.int64)
    y = code[own] if langs else np.zeros((0, 0), np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    weight = (1 / np.bincount(own).astype(np.float32))[own][:, None] / max(len(languages), 1) if langs else None
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1 if code.shape[1] else 1):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * weight
        grad = x.T @ slope + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 2 * slope.sum(0)
    return Model(languages, code, w, b)


def window(text: str, ident: str):
    """A text's characters, or LONGEST of them from a place chosen by hash."""
    begin = F.pmod(F.xxhash64(F.lit("window"), F.col(ident)), F.greatest(F.length(text) - LONGEST, F.lit(0)) + 1) + 1
    return F.substr(F.col(text), begin.cast("int"), F.lit(LONGEST))


def training_rows(docs: DataFrame, ident: str, text: str, lang: str) -> DataFrame:
    """A bounded sample of the labelled documents outside the held-out fold, by a hash
    of the id: of each language about PER_LANGUAGE, or SAMPLE divided by the number of
    languages, but LEAST at any rate. A language with fewer gives all it has."""
    rows = docs.where((fold(ident, 4) != 2) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(ident).alias("_i"), window(text, ident).alias("_text"), F.col(lang).alias("_lang"))
    counts = cut(rows.groupBy("_lang").count(), "languages")
    each = max(LEAST, min(PER_LANGUAGE, SAMPLE // max(1, counts.count())))
    share = counts.select(F.col("_lang").alias("_l"), (F.lit(float(each)) / F.col("count")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("_i")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(share, F.col("_lang") == F.col("_l")).where(draw < F.col("_share")).select("_i", "_text", "_lang")


def identify(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The language of every document, learned from the labelled ones.

    Returns (doc_id, held_out, lang_pred, score, ambiguous), one row per row.
    Documents with crc32(doc_id) mod 4 = 2 are held out of the training, as are
    those without `lang`; only the text is an input. Null texts and texts without
    a letter are `und` with score 0; so is everything if nothing is labelled.
    A null id counts as held out. Repeated rows are predicted alike; other columns
    are ignored; an empty table gives no rows. Every language that is labelled can be
    predicted. The model, which grows with the languages and not with the documents,
    is sent to every task. Of a long text a window of LONGEST characters is learned;
    predictions read whole texts.
    """
    sample = training_rows(docs, ident, text, lang).toArrow().sort_by([("_i", "ascending"), ("_text", "ascending")])
    model = fit(sample.column(1).combine_chunks(), sample.column(2).to_pylist())
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = send.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            n = batch.num_rows
            lettered = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            best, score, unsure = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n, bool)
            if model.languages:
                for lo, hi, data, offsets in dense_blocks(batch.column(2)):
                    best[lo:hi], score[lo:hi], unsure[lo:hi] = model.predict(language_features(data, offsets, BITS))
            best[~lettered], score[~lettered], unsure[~lettered] = len(names) - 1, 0, False
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(unsure)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(
        F.col(ident).cast("long").alias("doc_id"), F.coalesce(fold(ident, 4) == 2, F.lit(True)).alias("held_out"), F.col(text).alias("text"),
        F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("lettered"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
