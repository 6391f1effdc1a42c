"""Fertility, balance and vocabulary measures over small per-language tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fertility(counts: DataFrame, zero_is_null: bool = True) -> DataFrame:
    """counts: lang, tokens, denom. A denominator of 0 gives null, or 0.0."""
    ratio = F.col("tokens") / F.nullif("denom", F.lit(0))
    return counts.select("lang", "tokens", "denom", (ratio if zero_is_null else F.coalesce(ratio, F.lit(0.0))).alias("ratio"))


def balance(ratios: DataFrame, digits: int | None = None, score_digits: int = 2) -> DataFrame:
    """spread and score = 1000 / spread (null if 0); digits: from rounded ratios, as displayed."""
    r = F.col("ratio") if digits is None else F.round("ratio", digits)
    spread = F.max(r) - F.min(r)
    if digits is not None:
        spread = F.round(spread, digits)
    out = ratios.agg(spread.alias("spread")).withColumn("score", 1000 / F.nullif("spread", F.lit(0.0)))
    return out if digits is None else out.withColumn("score", F.round("score", score_digits))


def adjusted(ratios: DataFrame, target: str, threshold: float = 1.2) -> DataFrame:
    from verbaloom.functions.text import penalty

    row = ratios.agg((F.max("ratio") - F.min("ratio")).alias("spread"), F.max(F.when(F.col("lang") == target, F.col("ratio"))).alias("r"))
    row = row.select((1000 / F.nullif("spread", F.lit(0.0))).alias("score"), penalty(F.col("r"), threshold).alias("penalty"))
    return row.withColumn("adjusted_score", F.col("score") / F.col("penalty"))


def top_tokens(stream: DataFrame, k: int = 30) -> DataFrame:
    """stream: lang, at (orderable), token. Most frequent tokens, ties by first occurrence."""
    counts = stream.groupBy("lang", "token").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "first_at")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("lang", "rank", "token", "n")


def own_borrowed(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """counts: lang, token, n; vocab: lang, token. Tokens of the stream in and outside of it."""
    hit = counts.join(vocab.select("lang", "token", F.lit(True).alias("hit")), ["lang", "token"], "left")
    own: Column = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    return hit.groupBy("lang").agg(own.alias("own"), (F.sum("n") - own).alias("borrowed"))


def overlap(vocab: DataFrame, languages: int) -> DataFrame:
    return vocab.groupBy("token").agg(F.count_distinct("lang").alias("k")).filter(F.col("k") == languages).select("token")


def allocation(vocab: DataFrame, final: DataFrame) -> DataFrame:
    return vocab.join(final.select("token").distinct(), "token", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


def minmax(ratios: DataFrame) -> DataFrame:
    up, down = Window.orderBy("ratio", "lang"), Window.orderBy(F.desc("ratio"), F.desc("lang"))
    tag = F.when(F.row_number().over(down) == 1, "X_max").when(F.row_number().over(up) == 1, "X_min")
    return ratios.select("lang", "ratio", tag.alias("tag"))


#: Buckets of a sketch as a power of two: a relative error of some 0.8 %.
SKETCH_BITS = 14


def type_sketches(tokens: DataFrame, column: str, *by: str) -> DataFrame:
    """(*by, sketch, n): a HyperLogLog sketch of the distinct values and their number in all, at most some 16 KB a
    group, whatever its size. Sketches of disjoint or overlapping parts merge without error of their own."""
    return tokens.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(SKETCH_BITS)).alias("sketch"), F.count(column).alias("n"))


def rolled_up(sketches: DataFrame, *by: str) -> DataFrame:
    """(*by, types, tokens) of stored sketches over a part of their grouping."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("tokens"))
    return merged.select(*by, F.hll_sketch_estimate("sketch").alias("types"), "tokens")
