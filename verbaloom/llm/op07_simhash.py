"""SimHash near-dedup with pivot distance tables.

1. Each text gets a fingerprint; equal fingerprints become one class, so copies never multiply.
2. Fingerprints within `radius` differing bits agree on at least blocks - radius of `blocks` bit
   blocks; each combination of that many blocks is a bucket key. There are so many blocks that a key
   has log2(n) bits or more for n distinct fingerprints, so buckets stay small at any n.
3. In a bucket, a table of Hamming distances to `pivots` reference fingerprints discards pairs
   whose distances to some pivot differ by more than radius (triangle inequality); survivors are
   verified by xor and bit count. A bucket's links leave as a spanning forest.
4. Buckets of more than `block_rows` are dealt as pairs of chunks, so no task grows with them and
   every pair is still compared.
5. Components come from alternating large-star and small-star steps, each written to the shared
   folder.

Null text counts as empty; texts without words have fingerprint zero and link like any other. Ties
cannot arise: component ids are minima. Rows with a null doc_id keep their fingerprint and share
their component. Repeated rows repeat. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Rows of a file of edges: few edges are few files, at any number of shuffle partitions.
EDGES_A_FILE = 200_000
#: Rows of a bucket beyond which it is dealt as pairs of chunks.
BLOCK_ROWS = 4096
#: Rows that leave, or come again, up to which they are broadcast instead of shuffled with the texts.
LEAVING = 1_000_000
PIVOTS = np.random.default_rng(7).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(8).integers(0, 2, 16, dtype=np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 (seed 42) of word shingles; ASCII lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    return majority(np.array([h(join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    total, ones = len(hashes), np.zeros(BITS, np.int64)
    for lo in range(0, total, 1 << 16):
        raw = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash (tells rows of one id apart) and the fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fp": np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.uint64).view(np.int64)})

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return common.beside(hashed, ["doc_id", "text_hash"], ["text"], run, "fp long")


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks whose keys have log2(n) bits."""
    blocks = radius + 2
    while BITS * (blocks - radius) // blocks < math.log2(max(2, n)):
        blocks += 1
    return blocks


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every combination of blocks on which a pair within radius must agree somewhere."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - radius)]


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs within radius among rows of equal key."""
    near = np.bitwise_count(fps ^ PIVOTS[0]).astype(np.int16)
    order = np.lexsort((near, keys))
    keys, fps = keys[order], fps[order]
    table = np.stack([np.bitwise_count(fps ^ p).astype(np.int16) for p in PIVOTS])
    parent, a, b = np.arange(len(fps)), [], []
    at, shift = np.arange(len(fps)), 0
    while True:
        shift += 1
        at = at[at + shift < len(fps)]
        at = at[keys[at] == keys[at + shift]]
        at = at[table[0, at + shift] - table[0, at] <= radius]
        if not len(at):
            break
        left = at
        for row in table[1:]:
            left = left[np.abs(row[left] - row[left + shift]) <= radius]
            if not len(left):
                break
        left = left[np.bitwise_count(fps[left] ^ fps[left + shift]) <= radius]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        for i in left[parent[left] != parent[left + shift]].tolist():
            x, y = _root(parent, i), _root(parent, i + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(i)
                b.append(i + shift)
    return fps[np.array(a, int)], fps[np.array(b, int)]


def links(classes: DataFrame, radius: int, blocks: int, block_rows: int) -> DataFrame:
    """(a, b): links of a spanning forest of every bucket, over distinct fingerprints `fp`."""
    masks = block_masks(blocks, radius)
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("m", "k"))
    keyed = keyed.select("fp", F.xxhash64("m", "k").alias("key"))
    hot = common.materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows), "hot-buckets")
    # half-size chunks, so that a pair of them holds block_rows at most on average
    hot = hot.select(F.col("key").alias("hot"), F.ceil(F.col("n") / (block_rows // 2)).cast("int").alias("chunks"))
    dealt = keyed.join(hot, F.col("key") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks").cast("long")).cast("int")
    small = dealt.filter("chunks is null").select("key", "fp")
    large = (
        dealt.filter("chunks is not null").withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    )
    spread = small.unionByName(large).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            same = np.zeros(len(k), bool)
            same[1:] = k[1:] == k[:-1]
            same[:-1] |= same[1:]
            a, b = bucket_links(k[same], f[same], radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            k = np.concatenate([rest_k, batch["key"].to_numpy(np.int64)])
            f = np.concatenate([rest_f, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            whole = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if whole:
                yield emit(k[:whole], f[:whole])
            rest_k, rest_f = k[whole:], f[whole:]
        if len(rest_k):
            yield emit(rest_k, rest_f)

    return spread.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of two nodes or more; alternating stars."""
    edges = common.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    files = max(1, -(-edges.count() // EDGES_A_FILE))  # edges never become more than twice as many
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.materialize(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("n"), F.least("u", "w").alias("w")).coalesce(files), "stars")
        larger = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v").distinct()
        larger = common.materialize(larger.coalesce(files), "large-stars")
        least = common.materialize(larger.groupBy("u").agg(F.min("v").alias("w")).withColumnRenamed("u", "n").coalesce(files), "stars")
        joined = larger.join(least, F.col("u") == F.col("n"))
        edges = common.materialize(joined.select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(joined.select("u", F.col("w").alias("v"))).filter("u <> v").distinct().coalesce(files), "edges")
        # a forest of stars: as many edges as nodes below, and no root that is itself below another
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now := (state["n"], state["h"])) == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def simhash_components(docs: DataFrame, width: int = 5, radius: int = 4, blocks: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits), component_id (least doc_id that links reach)."""
    marked = common.materialize(fingerprints(docs, width), "fingerprints")
    classes = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    blocks = blocks or blocks_for(classes.count(), radius)
    tree = components(common.materialize(links(classes, radius, blocks, block_rows), "links"))
    rooted = common.materialize(classes.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    ids = common.materialize(ids, "component-ids")
    of_class = common.materialize(common.join_hot(rooted, ids, "root", "r").select(F.col("fp").alias("f"), "component_id"), "class-components")
    return common.join_hot(marked, of_class, "fp", "f").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the row of least doc_id (null last), then of
    least text hash; equal rows are one."""
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    nowhere = F.lit(-(2**63))
    # a component is named by its least id; where all ids are null, by its fingerprint
    name = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("other")]
    rows = common.materialize(found.groupBy("doc_id", "text_hash", *name).agg(F.count("*").alias("rows")), "found-rows")
    stay = rows.groupBy("component_id", "other").agg(F.min(rank).alias("r")).select(F.coalesce("r.doc_id", nowhere).alias("stay_id"), F.col("r.text_hash").alias("stay_hash"))
    own = rows.select(F.coalesce("doc_id", nowhere).alias("id"), F.col("text_hash").alias("hash"), "rows")
    own = own.join(stay, (F.col("id") == F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")), "left")
    # few rows leave or come again, so these travel and the texts stay in their places
    odd = common.materialize(own.filter("stay_id IS NULL OR rows > 1").select("id", "hash", F.col("stay_id").isNotNull().alias("again")), "leaving-rows")
    marked = docs.withColumns({"__id": F.coalesce(docs["doc_id"], nowhere), "__hash": F.xxhash64(docs["text"])})
    on = (F.col("__id") == F.col("id")) & (F.col("__hash") == F.col("hash"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = marked.join(common.small(odd, LEAVING), on, "left_anti").select(whole.alias("row")).select("row.*")
    again = odd.filter("again")
    if again.isEmpty():
        return kept
    one = marked.join(common.small(again, LEAVING), on, "left_semi").groupBy("__id", "__hash").agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return kept.unionByName(one.select("row.*"))


def op7_simhash(spark, sf_dir) -> DataFrame:
    return simhash_components(common.table(spark, sf_dir, "documents"), width=4).drop("text_hash")
