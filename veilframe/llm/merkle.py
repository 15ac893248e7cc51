"""A Merkle manifest of a table: leaves by group, one root, and proofs by coordinates.

A node's coordinate is (group, level, place). A leaf's place and its group's size say
which siblings its proof needs; the coordinates are joined to the stored table of nodes.

No key is hot: places come from a range partitioning, nodes are built in blocks of
2**HOP leaves, and a proof is looked up in hops of HOP levels. At most 2**HOP rows ask
for any node within a hop; above it, the node at the hop's top asks once for all of
them. Digests are kept as 32 bytes and hashed as hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import cut, fold, partitions

#: Levels that are built, and looked up, at once.
HOP = 8


def field_text(value: Column) -> Column:
    """A field so that no two lists of fields read alike: its bytes counted first."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields; nulls count as themselves."""
    return digest(F.concat(*[field_text(f) for f in fields]))


def joined(digests: Column) -> Column:
    """The digest of an array of digests, as hex texts in a row."""
    return digest(F.array_join(F.transform(digests, hexed), ""))


# ---------------------------------------------------------------- places


def place(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows plus `place`, from 0 within each group by `order` (nulls first), and `size`,
    the group's rows. Written once, so a place never changes.

    Rows are range-partitioned by group and order; a row's place is its place in its
    part and the rows of its group in the parts before. Only those sums, one row for
    each part and group, are ordered in one task by group."""
    keys = [F.asc_nulls_first(c) for c in (*group, *order)]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    stored = cut(dealt.withColumn("_part", F.shiftright(number, 33)).withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    parts = stored.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0).cast("long"))).withColumn("size", F.sum("_n").over(Window.partitionBy(*group)))
    parts = parts.withColumnsRenamed({c: f"_{c}" for c in group} | {"_part": "_p"}).drop("_n")
    same = stored["_part"] == F.col("_p")
    for c in group:
        same &= stored[c].eqNullSafe(F.col(f"_{c}"))
    found = stored.join(parts, same).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return found.drop("_part", "_at", "_first", "_before", "_p", *[f"_{c}" for c in group])


def depth(size: Column) -> Column:
    """Levels above the leaves of so many: where one node is left."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


# ---------------------------------------------------------------- nodes


def _levels(digests: Column, levels: Column) -> Column:
    """Arrays of nodes, level by level, above a block's digests: at most HOP levels."""
    up = lambda below: F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), lambda k: joined(F.slice(below, k * 2 + 1, F.lit(2))))
    grow = lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1))))
    return F.aggregate(F.sequence(F.lit(1), levels), F.array(digests), grow)


def build(leaves: DataFrame, max_size: int) -> DataFrame:
    """(grp, level, place, digest): all nodes above `leaves` (grp, place, size, digest), and
    those themselves. `grp` is any column that no row lacks."""
    out, below = leaves.select("grp", F.lit(0).alias("level"), "place", "digest", "size"), leaves.select("grp", "place", "size", "digest")
    base = 0
    while max_size > 1 << base:
        block = F.shiftright("place", HOP)
        rows = below.groupBy("grp", block.alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        levels = F.least(F.lit(HOP), depth(F.col("size")) - base)
        grown = rows.where(levels > 0).select("grp", "block", "size", levels.alias("levels"), _levels(F.col("nodes.digest"), levels).alias("nodes"))
        each = grown.select("grp", "block", "size", F.posexplode("nodes").alias("up", "row")).where("up > 0").select("grp", "block", "size", "up", F.posexplode("row").alias("at", "digest"))
        place_ = F.expr(f"shiftleft(block, {HOP} - up) + at")
        made = cut(each.select("grp", (F.col("up") + base).cast("int").alias("level"), place_.alias("place"), "digest", "size"), "nodes")
        out = out.union(made)
        base += HOP
        below = made.where(F.col("level") == base).select("grp", "place", "size", "digest")
    return out


# ---------------------------------------------------------------- proofs


def lookup(rows: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
    """rows (grp, place, size) at level `base` plus `path`: for each of the next HOP
    levels of their group, whether the node is a left one and its sibling's digest (null
    if it has none).

    Each row makes the coordinates of its siblings, joins them to the nodes, and takes
    what was found in the order of levels."""
    top = F.least(F.lit(base + HOP), depth(F.col("size")))
    levels = F.when(top > base, F.sequence(F.lit(base), top - 1)).otherwise(F.array().cast("array<int>"))
    asked = rows.select("grp", "place", "size", F.explode(levels).alias("level"))
    up = F.expr(f"shiftright(place, level - {base})")
    asked = asked.select("grp", "place", "level", (up % 2 == 0).alias("left"), F.when(up % 2 == 0, up + 1).otherwise(up - 1).alias("at"))
    known = nodes.where(F.col("level").between(base, base + HOP - 1)).select(F.col("grp").alias("_g"), F.col("level").alias("_l"), F.col("place").alias("_p"), "digest")
    found = asked.join(known, (F.col("grp") == F.col("_g")) & (F.col("level") == F.col("_l")) & (F.col("at") == F.col("_p")), "left")
    paths = found.groupBy("grp", "place").agg(F.array_sort(F.collect_list(F.struct("level", "left", "digest"))).alias("path"))
    paths = paths.select(F.col("grp").alias("_g"), F.col("place").alias("_p"), "path")
    return rows.join(paths, (F.col("grp") == F.col("_g")) & (F.col("place") == F.col("_p")), "left").drop("_g", "_p")


PATH = "array<struct<level:int,left:boolean,digest:binary>>"


def proofs(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, max_size: int) -> DataFrame:
    """leaves (grp, place, size, ...) plus `path`, from the leaf to the root, and what
    `tops` (grp, path, ...) says of their group, whose path goes on from its root."""
    hops = lambda size: F.ceil(depth(size) / HOP).cast("int")
    none = F.array().cast(PATH)
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    upper = tops.select(F.col("grp").alias("_g"), F.lit(0).cast("long").alias("_at"), F.col("path").alias("_path"), *carried)
    upper = upper.join(leaves.groupBy("grp").agg(hops(F.max("size")).alias("_hop")), F.col("_g") == F.col("grp")).drop("grp")
    base = HOP * max(0, -(-max(max_size - 1, 0).bit_length() // HOP) - 1)
    while True:
        rows = leaves if base == 0 else nodes.where(F.col("level") == base).select("grp", "place", "size").where(hops(F.col("size")) * HOP > base)
        hop = F.least(F.lit(base // HOP + 1), hops(F.col("size")))
        looked = lookup(rows, nodes, base)
        same = (F.col("grp") == F.col("_g")) & (hop == F.col("_hop")) & (F.shiftright("place", HOP) == F.col("_at"))
        whole = looked.join(upper, same).withColumn("path", F.concat(F.coalesce("path", none), "_path"))
        if base == 0:
            return whole.drop("_g", "_hop", "_at", "_path")
        next_ = whole.select(F.col("grp").alias("_g"), F.col("place").alias("_at"), F.col("path").alias("_path"), *carried, F.lit(base // HOP).alias("_hop"))
        upper = cut(next_.unionByName(upper.select("_g", "_at", "_path", *carried, "_hop")), "upper")
        base -= HOP


def climb(start: Column, path: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    step = lambda at, x: digest(F.when(x["digest"].isNull(), hexed(at)).when(x["left"], F.concat(hexed(at), hexed(x["digest"]))).otherwise(F.concat(hexed(x["digest"]), hexed(at))))
    return F.aggregate(path, start, step)


def manifest(rows: DataFrame, ident: str, group: str, value: Column) -> DataFrame:
    """(row, digest, subroot, root, path): each row whole, its leaf `value`, the roots of
    its group and of all, and its proof. Rows of a group stand by ident (nulls first),
    equal ids by digest; groups by name (null first). Rows of one id and digest are leaves
    of their own. A table without rows has no manifest. As a row is kept as one struct,
    no name of its columns can clash."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))
    kept = rows.select(F.struct(*rows.columns).alias("row"), key.alias("grp"), F.col(ident).alias("ident"), value.alias("digest"))
    leaves = cut(place(kept, ["grp"], ["ident", "digest"]), "leaves")
    largest = leaves.agg(F.max("size").alias("n")).first()["n"] or 0
    nodes = build(leaves, largest)
    ends = nodes.where(F.col("level") == depth(F.col("size"))).select(F.when(F.col("grp") != "null", F.expr("substring(grp, 2)")).alias("name"), F.col("grp").alias("of"), "digest")
    heads = cut(place(ends.withColumn("grp", F.lit("groups")), ["grp"], ["name"]), "groups")
    many = heads.agg(F.max("size").alias("n")).first()["n"] or 0
    above = build(heads, many)
    root = above.where(F.col("level") == depth(F.col("size"))).select("grp", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = proofs(heads.withColumnRenamed("digest", "subroot"), above, root, many)
    tops = cut(tops.select(F.col("of").alias("grp"), "subroot", "root", "path"), "tops")
    return proofs(leaves, nodes, tops, largest).select("row", "digest", "subroot", "root", "path")


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, and whether each one still leads to the
    root after some were tampered with (one more in n_chars, where 7 divides the id's
    crc32)."""
    fields = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    touched = (fold("doc_id", 7) == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = docs.select("doc_id", "lang", fields(F.col("n_chars")).alias("whole"), F.when(touched, fields(more)).alias("changed"))
    shown = manifest(rows, "doc_id", "lang", F.col("whole"))
    siblings = F.array_compact(F.col("path.digest"))
    folded = climb(F.coalesce("row.changed", "digest"), F.col("path"))
    out = shown.select("row.doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), hexed(joined(siblings)).alias("proof_sha256"), hexed(folded).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a text of ASCII characters, in SQL: its polynomial bit by bit.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _walk_sql(start: str, nodes: str) -> str:
    """Rows (rid, grp, i, n, cur, sib) of a tree's leaves, step by step to its root."""
    step = "sha256(CASE WHEN s.h IS NULL THEN cur WHEN w.i % 2 = 0 THEN cur || s.h ELSE s.h || cur END)"
    return f"""SELECT rid, grp, 0 AS lvl, i, n, cur, sib FROM {start} UNION ALL
      SELECT rid, w.grp, w.lvl + 1, w.i // 2, (w.n + 1) // 2, {step}, sib || coalesce(s.h, '')
      FROM {{walk}} w LEFT JOIN {nodes} s ON s.grp = w.grp AND s.lvl = w.lvl AND s.i = xor(w.i, 1::BIGINT) WHERE w.n > 1"""


ORACLE_SQL = f"""WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, 'null') AS grp, lang, {_leaf_sql("n_chars::VARCHAR")} AS leaf,
    CASE WHEN {CRC.format(text="doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars::HUGEINT + 1)::VARCHAR")} ELSE {_leaf_sql("n_chars::VARCHAR")} END AS cur, row_number() OVER () AS rid FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n, '' AS sib FROM d),
nodes AS (SELECT grp, 0 AS lvl, i, n, leaf AS h FROM leaves UNION ALL
  SELECT grp, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY grp, lvl, i // 2, n),
walked AS ({_walk_sql("leaves", "nodes").format(walk="walked")}),
heads AS (SELECT 'top' AS grp, t.grp AS of, h AS subroot, row_number() OVER (ORDER BY t.grp <> 'null', t.grp) - 1 AS i, count(*) OVER () AS n FROM nodes t WHERE n = 1),
above AS (SELECT grp, 0 AS lvl, i, n, subroot AS h FROM heads UNION ALL
  SELECT grp, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY grp, lvl, i // 2, n),
begun AS (SELECT w.rid, 'top' AS grp, e.i, e.n, w.cur, w.sib FROM walked w JOIN heads e ON w.grp = e.of WHERE w.n = 1),
climbed AS ({_walk_sql("begun", "above").format(walk="climbed")})
SELECT l.doc_id, l.leaf, e.subroot, r.h AS root, sha256(c.sib) AS proof_sha256, c.cur AS folded_root, c.cur = r.h AS verified
FROM leaves l JOIN heads e ON l.grp = e.of JOIN climbed c ON c.rid = l.rid AND c.n = 1 JOIN above r ON r.n = 1"""
