"""Near-duplicate embeddings by random-hyperplane hashing and exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import SALTS, _forest, components, cut, group_min, partitions, remove, text_bytes

#: Least cosine of a link, and the share of pairs at just that cosine that a set of
#: tables must bring together.
COSINE, RECALL = 0.9, 0.999
#: Vectors of a bucket on average; above TILE a bucket is compared in tiles.
BUCKET, TILE = 256, 2048
#: Tables whose buckets are compared at once: so many copies of the vectors travel.
TABLES = 2
#: Buckets above TILE whose list may be broadcast; a longer one is joined by shuffle.
LISTED = 100_000
#: Copies of a vector above which their rows are dealt over SALTS tasks.
SPREAD = 1024


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors: buckets keep their size as n grows, and tables
    are added so that a pair at `cosine` meets in one of them with chance `recall`."""
    bits = min(24, max(4, round(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 4))
    meets = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-meets))


def planes(dimensions: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([29, dimensions]).standard_normal((dimensions, bits * tables))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, by way of their largest component: squares neither overflow
    nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _sign(bits: int, tables: int):
    """Each vector's bytes, dimensions, and its sign bits under every table's planes."""

    def run(batches):
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            size = np.diff(at)
            for d in np.unique(size).tolist():
                if d not in drawn:
                    drawn[d] = planes(d, bits, tables)
                own = np.flatnonzero(size == d)
                for lo in range(0, len(own), 2000):
                    some = own[lo : lo + 2000]
                    x = np.ascontiguousarray(flat[at[some][:, None] + np.arange(d)])
                    side = (unit(x.astype(np.float64)) @ drawn[d] > 0).reshape(len(some), tables, bits)
                    sign = (side * (1 << np.arange(bits))).sum(2).astype(np.int32)
                    ends = np.arange(len(some) + 1, dtype=np.int32)
                    raw = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends * x.itemsize * d), pa.py_buffer(x.tobytes())])
                    signs = pa.ListArray.from_arrays(pa.array(ends * tables), pa.array(sign.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(2).take(pa.array(some)), pa.array(np.full(len(some), d, np.int32)), raw, signs], names=["vec_id", "weight", "d", "vec", "signs"])

    return run


LINKS = "kind int, a long, b long"


#: What one bucket, or two blocks of a large one, are told by.
TILED = ["t", "d", "sign", "i", "j"]


def _compare(cosine: float, kind: type):
    """Links within each bucket or tile: how many each vector has (kind 0: a, b links)
    and a forest that joins the linked ones (kind 1: a, b). A pair counts in the
    first table in which it meets."""

    def links(t: int, one: tuple, two: tuple, same: bool):
        (ia, wa, xa, sa), (ib, wb, xb, sb) = one, two
        step = max(1, 4_000_000 // max(len(ib), 1))
        for lo in range(0, len(ia), step):
            close = xa[lo : lo + step] @ xb.T >= cosine
            if same:
                close &= np.arange(len(ib)) > np.arange(lo, lo + len(close))[:, None]
            i, j = np.nonzero(close)
            i = i + lo
            if t:
                fresh = np.ones(len(i), bool)
                for k in range(0, len(i), 200_000):
                    x = slice(k, k + 200_000)
                    fresh[x] = ~(sa[i[x]] == sb[j[x]]).any(1)
                i, j = i[fresh], j[fresh]
            if len(i):
                yield ia[i], ib[j], wa[i], wb[j]

    def solve(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held)
        t, first, second = (rows.column(c)[0].as_py() for c in ("t", "i", "j"))
        own, ident, weight = (rows.column(c).to_numpy() for c in ("own", "vec_id", "weight"))
        data, offsets = text_bytes(rows.column("vec"))
        x = unit(data[offsets[0] : offsets[-1]].copy().view(kind).reshape(len(own), -1).astype(np.float64))
        earlier = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("earlier").chunks]).reshape(len(own), t)
        parts = {r: tuple(v[own == r] for v in (ident, weight, x, earlier)) for r in {first, second}}
        found = list(links(t, parts[first], parts[second], first == second))
        if found:
            a, b, wa, wb = (np.concatenate(x) for x in zip(*found, strict=True))
            ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
            yield 0, ids, np.bincount(where, np.concatenate([wb, wa]), len(ids)).astype(np.int64)
            node, root = _forest((a, b))
            yield 1, node, root

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in TILED], 1)
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()] if len(key) else []
            for lo, hi in zip(starts, [*starts[1:], len(key)], strict=False):
                if held and not (key[lo] == last).all():
                    yield from pack(solve(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key[lo]
        if held:
            yield from pack(solve(held))

    def pack(found):
        for kind, a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return run


def links_of_tables(signed: DataFrame, tables: range, n: int, cosine: float, kind: type) -> DataFrame:
    """Links of pairs that meet in one of `tables` and in none before it."""
    some = signed.withColumn("t", F.explode(F.array(*map(F.lit, tables)))).withColumn("sign", F.get("signs", F.col("t")))
    large = cut(some.groupBy("t", "d", "sign").count().where(F.col("count") > TILE).withColumn("blocks", F.ceil(F.col("count") / TILE).cast("int")).drop("count"), "large")
    listed = large.count()
    if listed:
        some = some.join(F.broadcast(large) if listed <= LISTED else large, ["t", "d", "sign"], "left")
    else:
        some = some.withColumn("blocks", F.lit(1))
    some = some.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    some = some.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    some = some.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "earlier": F.slice("signs", F.lit(1), F.col("t"))})
    some = some.select(*TILED, "own", "vec_id", "weight", "vec", "earlier")
    parts = max(partitions(signed.sparkSession), n * len(tables) // 100_000)
    dealt = some.repartition(parts, *TILED).sortWithinPartitions(*TILED, "vec_id")
    found = cut(dealt.mapInArrow(_compare(cosine, kind), LINKS), "links")
    remove(large)
    return found


def near_duplicates(vectors: DataFrame, ident: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Links between embeddings of a cosine of at least `cosine`.

    Returns (vec_id, n_links, component_id, kept), one row per row. Candidates meet
    in a bucket of sign bits under one of several sets of random hyperplanes; every
    pair of a bucket is compared exactly in double precision, so no link is false,
    and a pair at the threshold is found with chance `recall`. TABLES tables are
    compared at a time, so no more copies of the vectors are under way, however many
    tables there are. Buckets above TILE vectors are compared in tiles of blocks,
    each a group of its own.

    Null and zero vectors and those with null, NaN or infinite components link with
    nothing; so do vectors of different lengths. Equal vectors are compared as one
    and count as links of each other. Every row is a vector of its own, whatever its
    id: rows that repeat an id with one vector are copies, those with unlike vectors
    link each for itself. Rows with a null id link with nothing and have a null
    component. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    real = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{real}>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(usable, F.col("vec")).alias("vec")), "rows")
    classes = cut(group_min(rows.where("vec is not null"), "vec", "row").select("row", "leader", "members", "vec"), "classes")
    leaders = classes.where("row = leader").select(F.col("row").alias("vec_id"), "vec", "members")
    n = leaders.count()
    bits, tables = plan(n, cosine, recall)
    signed = cut(leaders.mapInArrow(_sign(bits, tables), "vec_id long, weight long, d int, vec binary, signs array<int>"), "signed")
    kind = np.float32 if real == "float" else np.float64
    found = signed.sparkSession.createDataFrame([], LINKS)
    for lo in range(0, tables, TABLES):
        found = found.union(links_of_tables(signed, range(lo, min(lo + TABLES, tables)), n, cosine, kind))
    remove(signed)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("_l")).agg(F.sum("b").alias("links"))
    solved = components(found.where("kind = 1").select("a", "b"))
    members = classes.select("row", "leader").join(rows.select("row", "vec_id"), "row")
    least = members.groupBy("leader").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"))
    facts = least.join(counts, F.col("leader") == F.col("_l"), "left").join(solved, F.col("leader") == F.col("node"), "left")
    facts = cut(facts.select("leader", "least", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "members", F.coalesce("component", "leader").alias("part")), "facts")
    lowest = facts.groupBy("part").agg(F.min("least").alias("c"))
    facts = facts.join(lowest, "part").withColumn("salt", F.explode(F.when(F.col("members") > SPREAD, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    dealt = classes.select("row", "leader", F.when(F.col("members") > SPREAD, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    placed = dealt.join(facts, ["leader", "salt"]).select(F.col("row").alias("_r"), "n", "c")
    out = rows.select("row", "vec_id").join(placed, F.col("row") == F.col("_r"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
