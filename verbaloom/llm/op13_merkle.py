"""A Merkle manifest of the dataset: a tree of degree 8 over each language's rows, one over the languages' roots,
and the authentication path of every row.

Rows are numbered in their language's order over range partitions, so no language needs one task, and dealt in
aligned blocks of 8^4. Traversal schedules the work in a block: for each level a treehash, a stack of
unfinished runs, reads the leaves ahead of the current one and takes in one more leaf a step, so the next run of
nodes is ready when the path moves on to it. Beside the block's leaves that holds at most two runs and a
stack for each level. The blocks' roots are the leaves of the tiers above, traversed the same way; paths go
down again, shared by all leaves of a block and appended to their own.

A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each `-` if null, else its UTF-8 byte count, `:`
and value. Null ids come first in their language, repeated ids in the order of their leaves; null is a language
of its own and the first. A row whose id is null isn't tampered with. Very long texts are hashed by row
and never leave it. Empty tables give no rows. Other columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.operators import ordering

from . import common

#: Degree of the tree, levels of a block.
DEGREE, BLOCK_LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<place:int,siblings:array<string>>>"
_PATH = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_of(text: Column | None = None) -> Column:
    """Hash of a row's fields; text: in place of its own."""
    values = [text if c == "text" and text is not None else F.col(c) for c in FIELDS]
    values = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // DEGREE), levels + 1
    return levels


class Treehash:
    """Nodes of a level from leaves in order: below it, a stack of unfinished runs, one for each level."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level)]

    def take(self, node: str) -> str | None:
        """The level's node that this leaf completes, if any."""
        for run in self.stack:
            run.append(node)
            if len(run) < DEGREE:
                return None
            node = digest(run)
            run.clear()
        return node

    def close(self) -> str | None:
        """The node over what is unfinished: runs at the end may be short."""
        node = None
        for run in self.stack:
            if node is not None:
                run.append(node)
            node = digest(run) if run else None
            run.clear()
        return node


def root_of(leaves: list[str], levels: int) -> str:
    tree = Treehash(levels)
    done = [node for node in map(tree.take, leaves) if node is not None]
    return done[0] if done else tree.close()


class Level:
    """One level of the traversal: the run of nodes on the path, and the next one in the making."""

    def __init__(self, level: int, leaves: list[str]):
        self.tree, self.leaves, self.read, self.span = Treehash(level), leaves, 0, DEGREE ** (level + 1)
        self.run: list[str] = []
        self.ahead: list[str] = []
        while self.read < min(self.span, len(leaves)):
            self.step()
        self.move()

    def step(self) -> None:
        """Take in one more leaf, if there is one."""
        if self.read < len(self.leaves):
            node = self.tree.take(self.leaves[self.read])
            self.read += 1
            if node is None and self.read == len(self.leaves):
                node = self.tree.close()
            if node is not None:
                self.ahead.append(node)

    def move(self) -> None:
        self.run, self.ahead = self.ahead, []


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in order its path in the block: place in the run and the run's others, level by level."""
    path = [Level(k, leaves) for k in range(levels)]
    for i in range(len(leaves)):
        yield [(p := (i // DEGREE**k) % DEGREE, x.run[:p] + x.run[p + 1 :]) for k, x in enumerate(path)]
        for x in path:
            x.step()
            if (i + 1) % x.span == 0:
                x.move()


def as_paths(paths: list[list[tuple[int, list[str]]]]) -> pa.Array:
    """An Arrow array of lists of (place, siblings)."""
    steps = [s for p in paths for s in p]
    ends = lambda sizes: pa.array([0, *_sums(sizes)], pa.int32())
    siblings = pa.ListArray.from_arrays(ends(len(s) for _, s in steps), pa.array([x for _, s in steps for x in s], pa.string()))
    return pa.ListArray.from_arrays(ends(map(len, paths)), pa.StructArray.from_arrays([pa.array([p for p, _ in steps], pa.int32()), siblings], fields=list(_PATH.value_type)))


def _sums(sizes) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The next tier of nodes (tree, n, at, node): the roots of its blocks, of `levels` or the tree's levels."""
    size = DEGREE**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n, at = table.column("n")[0].as_py(), table.column("at")[0].as_py()
        node = root_of(table.column("node").to_pylist(), min(height(n), levels))
        return pa.table({"tree": table.column("tree")[:1], "n": [-(-n // size)], "at": [at // size], "node": [node]})

    return nodes.select("tree", "n", "at", "node", _block(levels)).groupBy("tree", "block").applyInArrow(run, "tree long, n long, at long, node string")


def _block(levels: int) -> Column:
    return F.floor(F.col("at") / DEGREE**levels).cast("long").alias("block")


def paths(nodes: DataFrame, upper: DataFrame | None, levels: int) -> DataFrame:
    """nodes (tree, n, at, node, ...) with `path`: through their block, then their block's own (upper: tree, at, path)."""

    def joined(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n")[0].as_py()
        shared = [(s["place"], s["siblings"]) for s in above.column("path")[0].as_py()] if above.num_rows else []
        found = [p + shared for p in traverse(table.column("node").to_pylist(), min(height(n), levels))]
        return table.drop_columns(["block"]).append_column("path", as_paths(found))

    def alone(table: pa.Table) -> pa.Table:
        return joined(table, table.slice(0, 0))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    own = nodes.withColumn("block", _block(levels)).groupBy("tree", "block")
    if upper is None:
        return own.applyInArrow(alone, f"{fields}, path {PATH}")
    above = upper.select("tree", F.col("at").alias("block"), "path").groupBy("tree", "block")
    return own.cogroup(above).applyInArrow(joined, f"{fields}, path {PATH}")


def tiers_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """nodes and the tiers above them, up to one node a tree; some five for a million million rows."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(common.materialize(roots(tiers[-1], levels), "tree-tier"))
    return tiers


def prove(rows: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """rows (lang, doc_id, leaf, ...) with subroot, root and path: the siblings of every level from leaf to root.
    levels: of a block."""
    wrapped = rows.select("lang", F.col("doc_id").alias("id"), "leaf", F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    wrapped = common.materialize(wrapped, "leaves")
    first = [F.asc_nulls_first("lang"), F.asc_nulls_first("id"), F.asc("leaf")]
    placed = ordering.numbered(ordering.placed(wrapped, *first, tag="ordered-leaves"), ["lang"], "at")
    placed = common.materialize(placed.drop("id"), "numbered-leaves")
    langs = common.materialize(placed.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # languages are few beside rows, and nodes of a tree like any others
    trees = ordering.numbered(ordering.placed(langs, F.asc_nulls_first("lang"), tag="ordered-languages").withColumn("all", F.lit(0)), ["all"], "tree")
    trees = common.materialize(trees.select(F.col("lang").alias("tree_lang"), "tree", "n"), "trees")
    leaves = placed.join(common.small(trees), F.col("lang").eqNullSafe(F.col("tree_lang"))).select("tree", "n", "at", F.col("leaf").alias("node"), "row")
    leaves = common.materialize(leaves, "tree-leaves")
    tiers = tiers_of(leaves, levels)
    # of a tree of one leaf the tier of blocks' roots is the leaf itself
    subroots = common.materialize(tiers[-1].select("tree", F.col("node").alias("subroot")), "subroots")
    count = subroots.count()
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("at"), F.col("subroot").alias("node"))
    over = tiers_of(top, levels)
    root = over[-1].select(F.col("node").alias("root")).first()
    upper = None
    for tier in reversed(over):
        upper = common.materialize(paths(tier, upper, levels), "paths-of-roots")
    upper = upper.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "path")
    for tier in reversed(tiers[1:]):
        upper = common.materialize(paths(tier, upper, levels), "paths-of-blocks").select("tree", "at", "path")
    proved = paths(leaves, upper, levels)
    joined = proved.join(common.small(subroots.withColumnRenamed("tree", "of")), F.col("tree") == F.col("of"))
    return joined.select("row.*", "subroot", F.lit(root and root["root"]).alias("root"), "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def step(node: Column, s: Column) -> Column:
        cut = s["place"]
        return F.sha2(F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), cut), ""), node, F.array_join(F.slice(s["siblings"], cut + 1, F.size(s["siblings"])), "")), 256)

    return F.aggregate(path, leaf, step)


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Digests of every document's path, and whether the document, tampered with where 3 divides its id's CRC, folds
    to the root."""
    # rows tampered with, whose roots have to differ if their text does
    hit = F.coalesce(common.crc_mod("doc_id", 3) == 0, F.lit(False))
    tampered = F.when(hit, leaf_of(F.translate("text", UPPER, LOWER))).otherwise(F.col("leaf"))
    rows = docs.select("*", leaf_of().alias("leaf")).select("doc_id", "lang", "leaf", tampered.alias("tampered"))
    proved = prove(rows, levels)
    proved = proved.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark, sf_dir) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))
