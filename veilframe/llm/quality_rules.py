"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut
from veilframe.operators.ordered import column_quantiles

#: Hash buckets of the one-word and of the two-word features.
BUCKETS = 1 << 13  # a power of two: a bucket is the low bits of a hash
#: The threshold lies below the other half's median by so many times the distance to
#: its low quantile.
LOW, TIMES = 0.01, 1.5
MIN_WORDS, REPEAT_SHARE = 50, 50
_SYMBOL = "[#*$%&|<>]"
_IN_WORD = "[^\\x20\\x09-\\x0D]"
_GAP = "[\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def _low(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _word_slot(word: Column) -> Column:
    return _low(F.xxhash64(word))


def _pair_slot(words: Column, word: Column, i: Column) -> Column:
    """Bucket of a word with its successor; the last word has none."""
    return _low(F.xxhash64(word, F.get(words, i + 1))).bitwiseOR(F.lit(BUCKETS))


def _repeats(hashes: Column) -> Column:
    """The document's three-word windows sorted by hash, to find those that occur twice
    or more: n log n, with no lookups between windows. Empty where all differ."""
    sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), sorted_).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _windows(words: Column, n: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """doc_id, words, and the base counts of each document."""
    base = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("words", word_array(F.col("text")))
    base = base.withColumn("n", F.size("words"))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(_IN_WORD)))
    base = base.withColumn("hashes", _windows(F.col("words"), F.col("n")))
    base = base.withColumn("windows", _repeats(F.col("hashes")))
    same = lambda i: F.get("windows", i)["h"]
    base = base.withColumn("hits", F.filter("windows", lambda x, i: (same(i - 1) == x["h"]) | (same(i + 1) == x["h"])))
    base = base.withColumn("at", F.sort_array(F.transform("hits", lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return base.select(
        "doc_id", "words",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def ratio_weights(docs: DataFrame, trusted: DataFrame, ident: str, text: str) -> DataFrame:
    """One row (weights, learned): log(p_target / p_raw) by bucket, both with one added,
    and whether the target has any words.

    Raw counts come from every document, target counts from all of `trusted` (doc_id),
    whose ids grow with the documents: texts meet them by a shuffle at any size, the only
    one that texts take, and are not sorted for it.
    """
    marks = trusted.select(F.col("doc_id").alias("_t")).distinct().hint("shuffle_hash")
    marked = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("_text")).join(marks, F.col("doc_id") == F.col("_t"), "left")
    words = marked.select("_t", word_array(F.coalesce("_text", F.lit(""))).alias("words"))
    every_slot = F.concat(F.transform("words", _word_slot), F.transform("words", lambda word, i: _pair_slot(F.col("words"), word, i)))
    slots = words.select(F.col("_t").isNotNull().cast("long").alias("t"), F.explode(every_slot).alias("slot"))
    counts = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(2 * BUCKETS).select(F.col("id").cast("int").alias("slot")).join(counts, "slot", "left").fillna(0)
    kind = (F.col("slot") >= BUCKETS).cast("int")
    total = every.groupBy(kind.alias("kind")).agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    both = every.join(F.broadcast(total), kind == F.col("kind"))
    log_ratio = F.log((F.col("target") + 1) / (F.col("targets") + BUCKETS)) - F.log((F.col("raw") + 1) / (F.col("raws") + BUCKETS))
    listed = both.select("slot", "target", log_ratio.alias("w")).agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("x"), (F.sum("target") > 0).alias("learned"))
    return listed.select(F.transform("x", lambda x: x["w"]).alias("weights"), "learned")


def log_ratio(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """`rows` (words, n_words, ...) with their mean log ratio a feature."""
    of_word = F.transform("words", lambda word, i: F.get("weights", _word_slot(word)) + F.get("weights", _pair_slot(F.col("words"), word, i)))
    sums = F.aggregate(of_word, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.col("n_words") > 0, F.try_divide(sums, 2.0 * F.col("n_words"))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(weights)).withColumn("log_ratio", mean).drop("weights", "learned")


def threshold(rows: DataFrame, measure: DataFrame, weights: DataFrame) -> DataFrame:
    """One row (floor): the least ratio of a kept document, from the ratios in `rows`
    (doc_id, n_words, log_ratio) of the trusted documents `measure` (doc_id), which the
    weights have not seen. Null if there are none, or if the weights have seen no trusted
    words."""
    some = rows.where(F.col("n_words") >= MIN_WORDS).join(measure, "doc_id", "left_semi")
    low_, middle = column_quantiles(cut(some.select("log_ratio"), "ratios"), {"log_ratio": (F.col("log_ratio"), [LOW, 0.5])})["log_ratio"]
    found = rows.sparkSession.createDataFrame([([low_, middle],)], "q array<double>")
    low = F.when(F.col("learned"), F.col("q")[1] - TIMES * (F.col("q")[1] - F.col("q")[0]))
    return found.crossJoin(F.broadcast(weights.select("learned"))).select(low.alias("floor"))


def quality_rules(docs: DataFrame, trusted: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of each document and whether it is kept.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_ratio, kept. Kept documents pass the base rules and have a mean
    log ratio of at least the threshold that the corpus's own trusted documents set
    (see `threshold`): one fixed rule for every document, without draws.

    Null texts count as empty: all counts 0, failed, not kept. A null id is judged
    like any other. Repeated rows are judged alike. Other columns are ignored.
    Without trusted words in either half the base rules alone decide. An empty table
    gives no rows.
    """
    trusted = cut(trusted.select("doc_id").distinct(), "trusted")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    weights = cut(ratio_weights(docs, trusted.where(half == 0), ident, text), "weights")
    # ratios are written with the counts, so that the threshold needs no texts
    judged = cut(log_ratio(statistics(docs, ident, text), weights).drop("words"), "judged")
    floor = cut(threshold(judged, trusted.where(half == 1), weights), "floor")
    rows = judged.crossJoin(F.broadcast(floor))
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * n)
    passed = F.col("log_ratio") >= F.coalesce("floor", F.lit(float("-inf")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "log_ratio", (~failed & passed).alias("kept"),
    )


def trusted_documents(labels: DataFrame, docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """All ids labelled good, of those that `docs` has. Half of them, by a hash of the id,
    make the target multinomial; the other half's ratios set the threshold."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.join(docs.select(F.col(ident).alias("_t")), F.col("doc_id") == F.col("_t"), "left_semi")
