"""Shared pieces of the corpus operators: durable intermediates, skew-safe
grouping, connected components, and byte-level text kernels on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.storage import cut, new_path, shared_dir  # noqa: F401

#: Edges that one union-find task may take; larger graphs are contracted first.
UNION_FIND_EDGES = 1 << 18
#: Ways in which a key's rows are dealt out before they are grouped.
SALTS = 16


# ---------------------------------------------------------------- storage


def remove(df: DataFrame) -> None:
    """Delete the files of a `cut` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/veilframe/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or one like it that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(col: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


# ---------------------------------------------------------------- grouping


def group_min(df: DataFrame, key: str, ident: str) -> DataFrame:
    """(ident, key, leader, members): the smallest `ident` with the same `key`.

    Rows of a frequent key are dealt over SALTS tasks, aggregated there first, and
    joined back salted, so no task sees more than 1/SALTS of a key's rows.
    Null keys form one group. Only groups of two or more enter the join.
    """
    base = df.select(F.col(ident).alias("_id"), F.col(key).alias("_key"))
    base = base.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    part = base.groupBy("_key", "_salt").agg(F.min("_id").alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy("_key").agg(F.min("_m").alias("_leader"), F.sum("_n").alias("_members")).where("_members > 1")
    spread = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_key", "_k2")
    same = F.col("_key").eqNullSafe(F.col("_k2")) & (base["_salt"] == spread["_salt"])
    return base.join(spread, same, "left").select(
        F.col("_id").alias(ident),
        F.col("_key").alias(key),
        F.coalesce("_leader", "_id").alias("leader"),
        F.coalesce("_members", F.lit(1).cast("long")).alias("members"),
    )


# ---------------------------------------------------------------- components


def _forest(pairs: tuple[np.ndarray, np.ndarray], hashed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node that is not the smallest of its component, or not
    that with the smallest hash."""
    nodes, codes = np.unique(np.concatenate(pairs), return_inverse=True)
    if hashed:
        by = np.argsort(mix(nodes.view(np.uint64)))
        rank = np.empty(len(nodes), np.int64)
        rank[by] = np.arange(len(nodes))
        nodes, codes = nodes[by], rank[codes]
    half = len(pairs[0])
    a, b = codes[:half], codes[half:]
    root = np.arange(len(nodes))
    while True:  # hooking and pointer jumping, all edges at once
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[open_], b[open_]
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _forests(hashed: bool):
    def run(batches):
        got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if got:
            a, b = (np.concatenate(x) for x in zip(*got, strict=True))
            node, root = _forest((a, b), hashed)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return run


def components(edges: DataFrame, limit: int = UNION_FIND_EDGES) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long): component is the
    smallest node reachable.

    Up to `limit` edges are solved in one task. More are dealt over tasks, each
    replaces its share by a spanning forest, and nodes that are nobody's root
    leave the graph; what is left is a smaller graph over roots, again and again.
    Roots are chosen by a hash: of a chain's nodes about a third leave in a round,
    in whatever order their ids come. Each component's smallest node is found last.
    """
    spark = edges.sparkSession
    graph = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    all_nodes = graph.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if graph.count() <= limit:
        solved = cut(graph.coalesce(1).mapInArrow(_forests(False), "node long, root long"), "solved")
        return all_nodes.join(solved, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    every, kept = cut(all_nodes, "nodes"), []
    while graph.count() > limit:
        dealt = graph.repartition(partitions(spark), "a", "b")
        local = cut(dealt.mapInArrow(_forests(True), "node long, root long"), "forest")
        least = cut(local.groupBy("node").agg(F.min_by("root", F.xxhash64("root")).alias("root")), "least")
        roots = cut(local.select(F.col("root").alias("node")).distinct(), "roots")
        kept.append(cut(least.join(roots, "node", "left_anti"), "leaves"))
        among = local.join(roots, "node", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b"))
        across = local.alias("l").join(least.alias("m"), "node").where("l.root <> m.root").select(F.col("l.root").alias("a"), F.col("m.root").alias("b"))
        before, graph = graph, cut(among.union(across).distinct(), "edges")
        for done in (before, local, least, roots):
            remove(done)
    solved = cut(graph.coalesce(1).mapInArrow(_forests(True), "node long, root long"), "solved")
    for leaves in reversed(kept):
        lifted = leaves.join(solved.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("root") == F.col("_n"), "left")
        before, solved = solved, cut(solved.union(lifted.select("node", F.coalesce("_r", "root"))), "solved")
        for done in (before, leaves):
            remove(done)
    placed = cut(every.join(solved, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy(F.col("root").alias("_r")).agg(F.min("node").alias("component"))
    return placed.join(least, F.col("root") == F.col("_r")).select("node", "component")


# ---------------------------------------------------------------- byte kernels

_rng = np.random.Generator(np.random.PCG64(20240607))
#: Fixed random multipliers of the hash functions, the same in every process.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_CODE = np.where(SPACE, np.uint64(0), BYTE_CODE)
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: list[np.ndarray] = []
#: Bytes of a block of documents that is worked on at once.
BLOCK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK)
        with np.errstate(over="ignore"):
            out = []
            for base in (_BASE % 2**64, pow(_BASE, -1, 2**64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, limit: int = BLOCK):
    """Ranges [lo, hi) of documents with about `limit` bytes each, at least one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of documents, the words' first bytes, and for each
    document the range of its words. `offsets` are relative to `data`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SPACE[data]
    first = ~gap
    begins = np.zeros(n, bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    first[1:] &= gap[:-1] | begins[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    power, inverse = powers(n)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(WORD_CODE[data] * power, starts)
        hashes = mix(total * inverse[starts])
    return hashes, starts, np.searchsorted(starts, offsets)


_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `width` words in a row within a document, and each document's
    range of them. A document of fewer words has its whole sequence as one."""
    count = np.diff(bounds)
    n = len(hashes)
    with np.errstate(over="ignore"):
        total = np.zeros(max(n - width + 1, 0), np.uint64)
        for j in range(width):
            total += hashes[j : n - width + 1 + j] * _SHINGLE[j] if n >= width else 0
        total = mix(total)
        own = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
        to = np.concatenate([[0], np.cumsum(own)])
        out = np.empty(to[-1], np.uint64)
        long_ = count >= width
        take = np.arange(to[-1]) - np.repeat(to[:-1] - bounds[:-1], own)
        full = np.repeat(long_, own)
        out[full] = total[take[full]]
        for d in np.flatnonzero(~long_ & (count > 0)):
            part = hashes[bounds[d] : bounds[d + 1]]
            out[to[d]] = mix(np.array([(part * _SHINGLE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))], np.uint64))[0]
    return out, to
