"""A Merkle manifest of a table: a digest tree per group, a tree over the groups, a proof per row.

Every row is a leaf.  Per group the leaves are in order; each run of FAN nodes is hashed into a
parent until one node, the subroot, is left; the subroots, in the order of their groups, are the
leaves of a last tree.  A row's proof is the siblings on its way to the root.

A level is fixed-offset lag and lead columns.  All rows of a block carry the digest of their
ancestor; the nodes beside it are FAN^level and twice as many rows away, masked by the row's slot
and the length of the run.  Nodes to the left are always full.  A last node on the right may have
fewer rows than the offset, and is then the last of the block.  The rows of first children hash the
parents, and a running last value hands them to the rows after them.

No window holds a whole group: blocks are SPAN = FAN^DEPTH consecutive slots, which no run of
siblings crosses, and the blocks' digests are the leaves of the next round.

Nulls: a null value is hashed as `-`, a null group comes first, a null order value first within
its group.  Empty and very long texts are values like others.  Rows that tie in the order follow
their digest, so repeated rows are leaves side by side.  An empty table gives no rows.  Columns
are taken by name; others, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcgold.session import materialise, scratch

FAN = 3
DEPTH = 7
SPAN = FAN**DEPTH

EMPTY_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its size in UTF-8 bytes, a colon and itself; null as `-`."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _numbered(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """With `slot`, gapless in the order within each `tree`, and `n`, the size of the tree.

    Rows are dealt by ranges; a row's place in its task and the sizes of the runs of equal trees
    in the tasks before, few rows in all, make the number.
    """
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = Window.partitionBy("tree").orderBy("_part")
    before = F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        "tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("n"),
    )
    out = rows.join(materialise(runs, "runs"), ["tree", "_part"])
    return out.withColumn("slot", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _level(rows: str, level: int) -> str:
    """SQL: the rows with the siblings beside their ancestor of the level, and their ancestor of the next."""
    step, own = FAN**level, f"d{level}"
    place = f"slot div {step} % {FAN}"
    left = ", ".join(f"CASE WHEN {place} >= {k} THEN lag({own}, {k * step}) OVER run END" for k in range(FAN - 1, 0, -1))
    right = ", ".join(
        f"CASE WHEN {place} < {FAN - k} AND slot - slot % {step} + {k * step} < n THEN coalesce("
        f"lead({own}, {k * step}) OVER run, last({own}) OVER (PARTITION BY tree, block ORDER BY slot "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END"
        for k in range(1, FAN)
    )
    beside = f"SELECT *, concat_ws('', {left}) AS l{level}, concat_ws('', {right}) AS r{level} FROM ({rows})"
    hashed = f"""SELECT *, CASE WHEN slot % {step * FAN} != 0 THEN NULL
        WHEN n > {step} THEN sha2(concat(l{level}, {own}, r{level}), 256) ELSE {own} END AS h{level}
      FROM ({beside} WINDOW run AS (PARTITION BY tree, block ORDER BY slot))"""
    return f"""SELECT * EXCEPT ({own}, h{level}), last(h{level}, true) OVER (
        PARTITION BY tree, block ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d{level + 1}
      FROM ({hashed})"""


def _climb(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes (tree, slot, n, digest) with `block`, the block's digest `top`, and `path` up to it.

    One statement: each level twice as its own DataFrame would analyse all levels below it again.
    """
    rows = f"SELECT *, slot div {SPAN} AS block, digest AS d0 FROM {{nodes}}"
    for level in range(depth):
        rows = _level(rows, level)
    steps = [f"IF(n > {FAN**i}, named_struct('left', l{i}, 'right', r{i}), NULL)" for i in range(depth)]
    path = f"array_compact(array({', '.join(steps)}))" if depth else EMPTY_PATH
    own = ", ".join(f"`{c}`" for c in nodes.columns)
    return nodes.sparkSession.sql(f"SELECT {own}, block, d{depth} AS top, {path} AS path FROM ({rows})", nodes=nodes)


def _depth(nodes: DataFrame) -> int:
    """Levels that the largest tree needs."""
    largest, depth = nodes.agg(F.max("n")).first()[0] or 0, 0
    while FAN**depth < largest:
        depth += 1
    return depth


def proofs(nodes: DataFrame, beyond: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nodes with the digest `top` of their tree and the `path` to it, siblings by level.

    `beyond` continues the paths: from (tree, top) it gives (tree, path, more columns).
    """
    own, depth = nodes.columns, _depth(nodes)
    low = _climb(nodes, min(depth, DEPTH))
    if depth <= DEPTH:
        if beyond is None:
            return low.drop("block")
        up = beyond(low.where("slot = 0").select("tree", "top"))
        return low.join(up.withColumnRenamed("path", "_up"), "tree").select(
            *own, "top", F.concat("path", "_up").alias("path"), *(c for c in up.columns if c not in ("tree", "path"))
        )
    up = low.where(F.col("slot") % SPAN == 0).select(
        "tree", F.col("block").alias("slot"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("digest")
    )
    up = proofs(materialise(up, "blocks"), beyond).drop("n", "digest")
    up = materialise(up.withColumnsRenamed({"slot": "block", "path": "_up"}), "block-paths")
    more = [c for c in up.columns if c not in ("tree", "block", "_up")]
    return low.drop("top").join(up, ["tree", "block"]).select(*own, F.concat("path", "_up").alias("path"), *more)


def manifest(rows: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """Rows with `subroot`, `root` and the `path` of their `leaf` digest; the caller's scratch holds the tables."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # "" sorts before all others, as null does
    leaves = materialise(rows.withColumn("tree", tree).withColumn("digest", F.col(leaf)), "leaves")
    first = [F.col("tree"), F.col(order).asc_nulls_first(), F.col("digest")]

    def forest(subroots: DataFrame) -> DataFrame:
        named = materialise(subroots, "subroots").select(
            F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("top").alias("digest")
        )
        paths = proofs(materialise(_numbered(named, [F.col("own")]), "forest"))
        return materialise(
            paths.select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), F.col("top").alias("root"), "path"),
            "forest-paths",
        )

    out = proofs(materialise(_numbered(leaves, first), "slots"), forest)
    return out.select(*rows.columns, "slot", "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def without_newlines(docs: DataFrame) -> Column:
    """The text as the tamperer leaves it: without line feeds in rows whose id has an even crc32."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of documents, and whether each one's proof still holds for its `tampered` text."""
    values = {c: F.col(c) for c in FIELDS}
    original, changed = leaf_of(list(values.values())), leaf_of([*(values | {"text": tampered}).values()])
    rows = docs.select("doc_id", "source", original.alias("leaf"), changed.alias("found"))
    with scratch(docs.sparkSession) as keep:
        out = manifest(rows, "source", "doc_id", "leaf").select(
            "doc_id", "leaf", "subroot", "root",
            proof_digest(F.col("path")).alias("proof_sha256"),
            fold(F.col("found"), F.col("path")).alias("folded_root"),
        )
        return keep(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
