"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the sign bits of an embedding's first 64 numbers. Codes are cut into 64 / log2(n / 4) segments,
rounded, so that an index bucket holds about four of n codes at any n (three segments at
least): a probe is a row that travels, a code that it meets is a bit count beside it, so fewer probes with more codes
each cost less. At radius r every open query probes, in each segment, the values at distance r from its own;
what it meets is verified on the whole code. After radius r in all of m segments every code within
m*(r+1)-1 bits has been met, so a query closes once its k-th verified distance is within that: the
result is exact. The join of probes and index lets through only codes within the distance that a
query's k-th holds so far, so it puts out little more than it improves. A code that the first a+1 segments at
radius r and the others at r-1 leave unmet is farther than m*r+a, so a query whose k-th distance is m*r+a probes
only these in its last round. The same rule holds to the last radius, at
which every code has been met: a lonely query costs the values of its segments, a few times the number of codes
(12 n m at the worst n, below 2^22 m at any), and no scan.

Equal codes are one entry, so a very common vector costs one row; searches carry the code, its least
id and its number of ids, and the k+1 least ids join at the end. Masks are made on the executors
from a range. Buckets of many codes are dealt over salts.
Queries are the rows whose id is divisible by `every`, against all rows; a row isn't its own
neighbour. Ties go to the smaller id. Null embeddings and ids have no entry; null numbers count as 0
(bit 0); shorter embeddings count as 0 behind their end, longer ones are cut. Fewer than k other
rows: all of them. Repeated rows with one id count once, the one of least code. Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY, BITS = 10, 100, 64
#: Codes that a bucket holds on average, and those of one before it is dealt over salts.
AVERAGE, BUCKET = 4, 4096
SHAPE = "query_id long, rank int, vec_id long, distance int"


def code(embedding: str) -> Column:
    """Bit 63 is the first number's."""
    bit = lambda x, i: F.when(F.coalesce(x, F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS - 1) - i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.slice(embedding, 1, BITS), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def segment_widths(n: int) -> list[int]:
    """Bits of each of 3 to 16 segments, as near to log2(n) as whole segments allow."""
    m = min(16, max(3, round(BITS / math.log2(max(2, n)))))
    return [BITS // m + (i < BITS % m) for i in range(m)]


def _segments(column: str, widths: list[int]) -> Column:
    cuts = [sum(widths[:i]) for i in range(len(widths))]
    return F.posexplode(F.array(*[F.shiftrightunsigned(column, c).bitwiseAND(F.lit((1 << w) - 1)) for c, w in zip(cuts, widths, strict=True)]))


def masks(spark: SparkSession, widths: list[int], r: int) -> DataFrame:
    """(mask_seg, mask): every value of r bits for each segment. At most C(22, 11) = 705,432 values a
    segment, since there are three segments or more."""
    table = spark.range(1 << max(widths)).filter(F.bit_count("id") == r).select(F.col("id").alias("mask"))
    wide = F.array(*[F.lit(w) for w in widths])
    return table.select(F.posexplode(wide).alias("mask_seg", "width"), "mask").filter(F.col("mask") < F.call_function("shiftleft", F.lit(1).cast("long"), F.col("width"))).drop("width")


def best(met: DataFrame, k: int) -> DataFrame:
    """q and its k+1 first entries of all that it met; an entry met again has the same rank."""
    rank = F.dense_rank().over(Window.partitionBy("q").orderBy("e"))
    return met.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_set("e")).alias("top"))


def entry(query: str) -> Column:
    return F.struct(F.bit_count(F.col(query).bitwiseXOR(F.col("found"))).alias("distance"), "least", "found", "ids_here").alias("e")


def probe(open_: DataFrame, index: DataFrame, hot: DataFrame | None, widths: list[int], r: int, k: int) -> DataFrame:
    """Open queries (q, top, reach) with the best that they have met up to radius r. reach: no farther code counts."""
    needed = open_.select("q", "reach", _segments("q", widths).alias("probe_seg", "own")).filter(F.col("probe_seg") <= F.col("reach") - len(widths) * r)
    probes = needed.join(F.broadcast(masks(open_.sparkSession, widths, r)), F.col("probe_seg") == F.col("mask_seg"))
    probes = probes.select("q", "reach", "probe_seg", F.col("own").bitwiseXOR(F.col("mask")).alias("probe"))
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("found"))) <= F.col("reach")
    on = (F.col("probe_seg") == F.col("seg")) & (F.col("probe") == F.col("value")) & near
    if hot is not None:
        probes = probes.join(hot, (F.col("probe_seg") == F.col("hot_seg")) & (F.col("probe") == F.col("hot_value")), "left")
        probes = probes.withColumn("probe_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        on = on & (F.col("probe_salt") == F.col("salt"))
    met = probes.join(index, on).select("q", entry("q"))
    old = open_.filter("top is not null").select("q", F.explode("top").alias("e"))
    return open_.select("q").join(best(met.unionByName(old), k), "q", "left")


def hamming_topk(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance."""
    spark = vectors.sparkSession
    coded = vectors.select("vec_id", code("embedding").alias("code")).filter("vec_id is not null and code is not null").groupBy("vec_id").agg(F.min("code").alias("code"))
    coded = common.materialize(coded, "codes")
    first = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    entries = coded.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = common.materialize(entries.select("code", F.get("ids", F.lit(0)).alias("least"), F.size("ids").alias("ids_here"), "ids"), "code-entries")
    n, rows = entries.count(), coded.count()
    if not rows:
        return spark.createDataFrame([], SHAPE)
    widths = segment_widths(n // AVERAGE)
    m = len(widths)
    index = common.materialize(entries.select(F.col("code").alias("found"), "least", "ids_here", _segments("code", widths).alias("seg", "value")), "code-index")
    crowded = index.groupBy(F.col("seg").alias("hot_seg"), F.col("value").alias("hot_value")).agg(F.count("*").alias("c")).filter(F.col("c") > BUCKET)
    crowded = common.materialize(crowded.select("hot_seg", "hot_value", F.ceil(F.col("c") / BUCKET).cast("int").alias("salts")), "crowded-buckets")
    hot = None
    if not crowded.isEmpty():
        hot = common.small(crowded)
        dealt = index.join(hot, (F.col("seg") == F.col("hot_seg")) & (F.col("value") == F.col("hot_value")), "left")
        index = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("found"), F.col("salts")), F.lit(0)).cast("int")).drop("hot_seg", "hot_value", "salts")
    asked = coded.filter(F.col("vec_id") % every == 0)
    top_type = "array<struct<distance:int,least:long,found:long,ids_here:int>>"
    asked_codes = asked.select(F.col("code").alias("q")).distinct()
    open_ = common.materialize(asked_codes.select("q", F.lit(None).cast(top_type).alias("top"), F.lit(BITS).alias("reach")), "open-queries")
    closed, enough = [], min(k + 1, rows)
    distances = F.flatten(F.transform("top", lambda e: F.array_repeat(e["distance"], e["ids_here"])))
    for r in range(max(widths) + 1):
        seen = probe(open_, index, hot, widths, r, k)
        seen = common.materialize(seen.withColumn("reach", F.coalesce(F.get(distances, F.lit(enough - 1)), F.lit(BITS + 1))), "seen")
        common.drop_materialized(open_)
        covered = F.col("reach") <= m * (r + 1) - 1
        closed.append(seen.filter(covered).select("q", "top"))
        open_ = common.materialize(seen.filter(~covered), "open-queries")
        if open_.isEmpty():
            break
    done = closed[0]
    for more in closed[1:]:
        done = done.unionByName(more)
    named = done.select("q", F.posexplode("top").alias("at", "e")).select("q", "e.distance", "e.found").join(entries.select("code", "ids"), F.col("found") == F.col("code"))
    top = named.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct("distance", i.alias("vec_id")))))).alias("top"))
    # k neighbours and perhaps the query itself
    top = common.materialize(top.withColumn("top", F.slice("top", 1, k + 1)), "top-lists")
    pairs = common.join_hot(asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("c")), top, "c", "q", limit=10_000)
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = pairs.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.distance")


def op4_hamming_topk(spark, sf_dir) -> DataFrame:
    return hamming_topk(common.table(spark, sf_dir, "embeddings"))
