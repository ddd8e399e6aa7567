"""Merkle manifest of a dataset: leaves, group roots, one root, and a proof for every row.

Every row is a leaf, the SHA-256 of its columns. Leaves of one group (``lang``)
are numbered in order and dealt to aligned blocks of ``fanout ** depth``. A
block holds a level of its tree as one string of 64 hex digits a node; the next
level is the hashes of its substrings of fixed width, and the siblings of a
node are the substrings on both sides of it in its run. Block roots are the
nodes of the next round, group roots the leaves of the last tree, so that no
task ever sees more than one block, whatever the size of a group.

Edge cases: a null column is ``-``, an empty text ``0:``; very long texts are
hashed whole, in the task that reads them, and do not travel; rows with equal
ids are ordered by their leaf (equal leaves can stand in any order, the result
is the same), a null id comes first; a null group is a group of its own, before
all others; a row without a sibling has the hash of nothing as its proof, and a
single row is the root itself; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import column, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, DEPTH = 2, 8
WIDTH = 64  # hex digits of a node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Hash of a row's values: byte count, colon, value; ``-`` for null."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _numbered(nodes: DataFrame, label: str) -> DataFrame:
    """``nodes`` with the place ``idx`` of each within its tree, in the order of its other columns, and the tree's size ``total``.

    Rows are dealt out in ranges and sorted, whatever tree they belong to; a
    small table of counts a range and tree gives each stretch its first number.
    The written table pins which row lies where.
    """
    order = [F.col(c) for c in nodes.columns]
    spread = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(spread, label).withColumn("_range", F.shiftright("_at", 33))
    size = kept.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # as many rows as there are ranges and trees, whatever the number of nodes
    within = Window.partitionBy("tree")
    size = size.withColumns({"_before": F.sum("_n").over(within.orderBy("_range")) - F.col("_n"), "total": F.sum("_n").over(within)}).drop("_n")
    out = kept.join(size, ["tree", "_range"])
    return out.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


def _levels(fanout: int, depth: int, last: str) -> Column:
    """All levels of a block, from its nodes up to its root, each as the bytes of one hex string.

    A block that is its whole tree ends where one node is left (``last``),
    another goes up by ``depth`` levels.
    """
    run = WIDTH * fanout
    up = f"CAST(array_join(transform(sequence(0, CAST((octet_length(x) - 1) DIV {run} AS INT)), i -> sha2(substring(x, i * {run} + 1, {run}), 256)), '') AS BINARY)"
    return F.expr(f"""aggregate(sequence(1, {depth}), array(level), (a, k) ->
        CASE WHEN {last} AND octet_length(element_at(a, -1)) = {WIDTH} THEN a
             ELSE concat(a, transform(array(element_at(a, -1)), x -> {up})) END)""")


def _path(fanout: int) -> str:
    """The siblings of node ``p`` on each level but the root's, as the stretches on its left and right."""
    step = f"CAST(power({fanout}, l) AS INT)"
    q, run = f"(p DIV {step})", f"(p DIV {step} DIV {fanout} * {fanout})"
    cut = lambda begin, n: f"CAST(substring(levels[l], CAST({begin} * {WIDTH} + 1 AS INT), CAST(({n}) * {WIDTH} AS INT)) AS STRING)"
    sides = f"named_struct('l', {cut(run, f'{q} - {run}')}, 'r', {cut(f'({q} + 1)', f'{run} + {fanout} - {q} - 1')})"
    return f"CASE WHEN size(levels) = 1 THEN CAST(array() AS array<struct<l:string,r:string>>) ELSE transform(sequence(0, size(levels) - 2), l -> {sides}) END"


def fold(node: Column, path: Column) -> Column:
    """The root that a node leads to with its siblings."""
    return F.aggregate(path, node, lambda a, s: F.sha2(F.concat(s["l"], a, s["r"]), 256))


def proof(path: Column) -> Column:
    """Hash of all siblings, from the lowest level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def _blocks(nodes: DataFrame, carry: list[str], fanout: int, depth: int, label: str) -> DataFrame:
    """(tree, block, total, items, levels): numbered nodes of each aligned block, and its levels."""
    size = fanout**depth
    items = F.sort_array(F.collect_list(F.struct((F.col("idx") % size).alias("p"), F.col("node").alias("node"), *map(F.col, carry))))
    by = nodes.groupBy("tree", F.floor(F.col("idx") / size).alias("block"), "total").agg(items.alias("items"))
    by = by.withColumn("level", F.array_join("items.node", "").cast("binary"))
    return materialize(by.withColumn("levels", _levels(fanout, depth, f"total <= {size}")).drop("level"), label)


def climb(nodes: DataFrame, carry: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Trees over numbered ``nodes`` (tree, idx, total, node and the columns ``carry``).

    Returns (tree, root), and a frame of each node's ``carry``, tree, node and
    ``path``, the siblings up to the root.
    """
    size = fanout**depth
    blocks = _blocks(nodes, carry, fanout, depth, "merkle-blocks")
    top = F.element_at("levels", -1).cast("string")
    inside = F.expr(f"transform(items, x -> transform(array(x.p), p -> named_struct('x', x, 'path', {_path(fanout)}))[0])")
    rows = blocks.select("tree", "block", inside.alias("inside"))
    path = F.col("y.path")
    if blocks.filter(F.col("total") > size).isEmpty():
        above = blocks.select("tree", top.alias("root"))
    else:  # some tree has several blocks: block roots are nodes in turn
        roots = blocks.select("tree", F.col("block").alias("idx"), F.ceil(F.col("total") / size).alias("total"), top.alias("node"), "block")
        above, paths = climb(roots, ["block"], fanout, depth)
        rows = rows.join(paths.select("tree", "block", F.col("path").alias("_over")), ["tree", "block"])
        path = F.concat(path, "_over")
    # blocks are never empty; the outer form spares a filter that would build all paths once more
    one = rows.select(*[c for c in rows.columns if c not in ("inside", "block")], F.explode_outer("inside").alias("y"))
    return above, one.select("tree", F.col("y.x.node").alias("node"), *[F.col(f"y.x.{c}").alias(c) for c in carry], path.alias("path"))


def manifest(docs: DataFrame, group: str = "lang", ident: str = "doc_id", columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(ident, leaf, tampered, subroot, root, path) of every row.

    ``changed`` replaces columns by other values; ``tampered`` is the leaf of
    the row as it would then be, null where that is the same.
    """
    values = {c: column(c) for c in columns}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), column(group).cast("string")), F.lit("")).alias("tree"),
        column(ident).alias("ident"),
        leaf(list(values.values())).alias("node"),
        *([leaf([(changed or {}).get(c, v) for c, v in values.items()])] if changed else [F.lit(None).cast("string")]),
    ).toDF("tree", "ident", "node", "tampered")
    leaves = leaves.withColumn("tampered", F.nullif("tampered", "node"))
    subroots, paths = climb(_numbered(leaves, "merkle-leaves"), ["ident", "tampered"], fanout, depth)
    trees = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), "merkle-subroots")
    whole, above = climb(trees, ["name"], fanout, depth)
    above = above.join(whole, "tree").select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "root", F.col("path").alias("_over"))
    out = paths.join(above, "tree")
    return out.select(F.col("ident").alias(ident), F.col("node").alias("leaf"), "tampered", "subroot", "root", F.concat("path", "_over").alias("path"))


def verify(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with proof_sha256, folded_root and verified in place of tampered and path."""
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": folded}).drop("tampered", "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)")).cast("string")
    return verify(manifest(docs, changed={"n_chars": more})).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_ENC = lambda n: "concat(" + ", ".join(f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')" for c in ("doc_id", "source", "lang", n, "text")) + ")"
#: CRC-32 of a string of digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
#: The same rows as DuckDB SQL: one tree table for all levels, siblings by the place with its last bit turned.
SQL = f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT doc_id, lang, sha256({_ENC('n_chars')}) AS leaf, sha256({_ENC(f'(n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END)')}) AS bad FROM documents),
v AS MATERIALIZED (SELECT *, coalesce('+' || lang, '') AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM a),
t(k, l, i, n, h) AS (SELECT k, 0, i, n, leaf FROM v UNION ALL SELECT k, l + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, l, i // 2),
s AS MATERIALIZED (SELECT k, l AS deep, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
g(l, i, n, h) AS (SELECT 0, i, n, h FROM s UNION ALL SELECT l + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM g WHERE n > 1 GROUP BY l, i // 2),
r AS (SELECT l AS deep, h AS root FROM g WHERE n = 1),
f(doc_id, leaf, bad, k, part, l, i, m, now, proof) AS (
  SELECT doc_id, leaf, bad, k, 0, 0, i, n, bad, '' FROM v
  UNION ALL
  SELECT f.doc_id, f.leaf, f.bad, f.k, CASE WHEN f.m = 1 THEN 1 ELSE f.part END, CASE WHEN f.m = 1 THEN 0 ELSE f.l + 1 END,
    CASE WHEN f.m = 1 THEN s.i ELSE f.i // 2 END, CASE WHEN f.m = 1 THEN s.n ELSE (f.m + 1) // 2 END,
    CASE WHEN f.m = 1 THEN f.now WHEN f.i % 2 = 0 THEN sha256(concat(f.now, x.h)) ELSE sha256(concat(x.h, f.now)) END,
    CASE WHEN f.m = 1 THEN f.proof ELSE concat(f.proof, x.h) END
  FROM f JOIN s ON s.k = f.k
  LEFT JOIN (SELECT 0 AS part, k, l, i, h FROM t UNION ALL SELECT 1, s.k, g.l, g.i, g.h FROM g, s) x ON x.part = f.part AND x.k = f.k AND x.l = f.l AND x.i = xor(f.i, 1) AND f.m > 1
  WHERE NOT (f.part = 1 AND f.m = 1))
SELECT f.doc_id, f.leaf, s.h AS subroot, r.root, sha256(f.proof) AS proof_sha256, f.now AS folded_root, f.now = r.root AS verified
FROM f JOIN s ON s.k = f.k, r WHERE f.part = 1 AND f.m = 1
"""
