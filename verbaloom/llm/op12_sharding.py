"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame functions only.

How many rows of each partition go to each shard is drawn first, as a uniform permutation of all rows would have
it: a matrix whose row sums are the partitions' rows and whose column sums are the shards' sizes. Every
partition then permutes its rows in place (a sort by a seeded hash) and deals them out by its row of the
matrix; rows are exchanged by shard and a second hash and sorted again, which permutes each shard. Shard and
place of a row are then uniform and independent of where it came from.

The matrix is drawn by halving a tree: a node's shard counts are split over its children, at most FAN at once,
shard by shard from hypergeometric laws by inversion around the mode. So a level is one join of small rows,
and levels grow with the logarithm of the partitions. Every random number is a hash of the seed and its
place, so a task that is run again draws the same. Rows are written with partition and rank before anything is
drawn; later steps read that table.

Null texts have no bytes: size 1 and CRC 0. Rows with null ids and repeated rows are dealt like others; equal
rows may stand for each other. Sizes and counts depend on rows alone, places on the seed and on how the input
is partitioned. Empty tables give empty results. Other columns are ignored by the query; `deal` carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.operators import ordering

from . import common

SHARDS, SEED, FAN = 8, 12, 32
#: Standard deviations around the mode beyond which the law is below the precision of a double.
REACH = 12


def uniform(*place: Column | int) -> Column:
    """A number in [0, 1) for a place: 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in place]), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` rows out of `total` are marked, by inversion of u. Values are tried from the mode
    upwards, then downwards, which is an order like any other; each weight follows from the one before."""
    number = F.struct(total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("d"), u.alias("u"))

    def law(v: Column) -> Column:
        n, k, d = v["n"], v["k"], v["d"]
        spread = F.sqrt(F.greatest(F.lit(0.0), d * k * (n - k) * (n - d) / F.greatest(n * n * (n - 1), F.lit(1.0))))
        low, high = F.greatest(F.lit(0.0), d + k - n), F.least(d, k)
        mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
        reach = F.ceil(F.lit(REACH) * spread) + 30
        return F.struct(n.alias("n"), k.alias("k"), d.alias("d"), v["u"].alias("u"), mode.cast("long").alias("mode"), F.greatest(low, mode - reach).cast("long").alias("low"), F.least(high, mode + reach).cast("long").alias("high"))

    def pick(v: Column) -> Column:
        none = F.array().cast("array<bigint>")
        above = F.when(v["high"] > v["mode"], F.sequence(v["mode"] + 1, v["high"])).otherwise(none)
        below = F.when(v["low"] < v["mode"], F.reverse(F.sequence(v["low"], v["mode"] - 1))).otherwise(none)
        other = v["n"] - v["k"] - v["d"]

        def weight(w: Column, x: Column) -> Column:
            up = (v["k"] - x + 1) * (v["d"] - x + 1) / (x * (other + x))
            down = (x + 1) * (other + x + 1) / ((v["k"] - x) * (v["d"] - x))
            return F.when(x == v["mode"] - 1, F.lit(1.0)).otherwise(w) * F.when(x > v["mode"], up).otherwise(down)

        one, nothing = F.lit(1.0), F.lit(None).cast("long")

        def draw(values: Column) -> Column:
            def add(acc: Column, x: Column) -> Column:
                return common.let(weight(acc["w"], x), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum")))

            def seek(goal: Column) -> Column:
                def step(acc: Column, x: Column) -> Column:
                    return common.let(weight(acc["w"], x), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), F.coalesce(acc["found"], F.when(goal < acc["sum"] + w, x)).alias("found")))

                first = F.struct(one.alias("w"), one.alias("sum"), F.when(goal < 1.0, v["mode"]).otherwise(nothing).alias("found"))
                return F.aggregate(values, first, step, lambda acc: F.coalesce(acc["found"], v["mode"]))

            whole = F.aggregate(values, F.struct(one.alias("w"), one.alias("sum")), add, lambda acc: acc["sum"])
            return common.let(v["u"] * whole, seek)

        return common.let(F.concat(above, below), draw)

    return common.let(number, lambda v: common.let(law(v), pick))


def split_counts(counts: Column, drawn: Column, *place: Column | int) -> Column:
    """One draw without replacement from a pool with these counts by shard: its counts by shard."""

    def step(acc: Column, j: Column) -> Column:
        own = F.get(counts, j)
        took = hypergeometric(acc["pool"], own, acc["left"], uniform(*place, j))
        return common.let(took, lambda x: F.struct((acc["left"] - x).alias("left"), (acc["pool"] - own).alias("pool"), F.concat(acc["out"], F.array(x)).alias("out")))

    pool = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.struct(drawn.cast("long").alias("left"), pool.alias("pool"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), first, step, lambda acc: acc["out"])


def _children(seed: int, level: int) -> Column:
    """A node's counts dealt to its children, one after the other."""

    def step(acc: Column, c: Column) -> Column:
        row = split_counts(acc["rest"], c["n"], seed, level, c["child"])
        return common.let(row, lambda r: F.struct(F.zip_with(acc["rest"], r, lambda a, b: a - b).alias("rest"), F.concat(acc["out"], F.array(F.struct(c["child"].alias("node"), r.alias("counts")))).alias("out")))

    first = F.struct(F.col("counts").alias("rest"), F.array().cast("array<struct<node:bigint,counts:array<bigint>>>").alias("out"))
    return F.aggregate("children", first, step, lambda acc: acc["out"])


def matrix(sizes: DataFrame, targets: list[int], seed: int = SEED, fan: int = FAN) -> DataFrame:
    """(part, counts): rows of each partition for each target. sizes: (part, n), n summing up to the targets' sum."""
    top = sizes.agg(F.max("part")).first()[0]
    levels = 0
    while fan**levels <= (top or 0):
        levels += 1
    nodes = sizes.sparkSession.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(t).cast("long") for t in targets]).alias("counts"))
    for level in reversed(range(levels)):
        child = F.floor(F.col("part") / fan**level).cast("long")
        own = sizes.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
        family = own.groupBy(F.floor(F.col("child") / fan).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children"))

        nodes = nodes.join(family, F.col("node") == F.col("parent")).select(F.explode(_children(seed, level)).alias("x")).select("x.node", "x.counts")
    return nodes.select(F.col("node").alias("part"), "counts")


def deal(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard and slot: a uniform shuffle, shards at most one row apart, slots gapless from 0."""
    wrapped = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    part, rank = ordering.position()
    local = wrapped.withColumn("key", F.xxhash64(F.lit(seed), "row")).sortWithinPartitions("key").select("row", part.alias("part"), rank.alias("rank"))
    table = common.materialize(local, "local-permutation")
    sizes = common.materialize(table.groupBy("part").agg(F.count("*").alias("n")), "partition-sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    cells = matrix(sizes, [n // shards + (j < n % shards) for j in range(shards)], seed)
    ends = F.aggregate("counts", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))
    cells = common.materialize(cells.select(F.col("part").alias("from"), ends.alias("ends")), "communication-matrix")
    # a partition's first rows go to shard 0, the next ones to shard 1
    sent = table.join(common.small(cells, 10_000), F.col("part") == F.col("from"))
    sent = sent.select("row", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"), F.xxhash64(F.lit(seed + 1), "row").alias("key"))
    placed = ordering.placed(sent, "shard", "key", tag="exchanged")
    return ordering.numbered(placed, ["shard"], "slot").select("row.*", "shard", "slot")


def write_shards(dealt: DataFrame, path: str) -> None:
    """A folder for each shard; within it, files by slot."""
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1
    digests = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    dealt = deal(digests)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


