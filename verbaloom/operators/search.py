"""Substring search over distinct tokens and their places, by an index of n-grams.

Three tables: tokens, n-grams of 1 to 3 characters of the lower-cased tokens, and the places of tokens. The last
two are sorted by their key, so a search reads the row groups of its n-grams and of the tokens that match. Tokens that
hold all n-grams of what is sought are candidates; each is then compared."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.storage import materialize

GRAM = 3


def _of_size(text: Column, k: int) -> Column:
    places = F.sequence(F.lit(1), F.char_length(text) - k + 1)
    return F.when(F.char_length(text) >= k, F.transform(places, lambda i: F.substring(text, i, F.lit(k))))


def grams(text: Column) -> Column:
    """Distinct n-grams of 1 to GRAM characters."""
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[_of_size(text, k) for k in range(1, GRAM + 1)]))))


class Index(NamedTuple):
    vocabulary: DataFrame
    postings: DataFrame
    occurrences: DataFrame

    def tokens(self, sought: str) -> DataFrame:
        """Distinct tokens that hold what is sought (trimmed), whatever the case; all for nothing."""
        spark = self.postings.sparkSession
        q = spark.range(1).select(F.lower(F.trim(F.lit(sought))).alias("q")).first()["q"]
        wanted = sorted({q[i : i + GRAM] for i in range(max(1, len(q) - GRAM + 1))})
        if not q:
            return self.vocabulary.select("token")
        hits = self.postings.filter(F.col("gram").isin(wanted))
        if len(wanted) > 1:
            hits = hits.groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") == len(wanted))
        return hits.filter(F.contains(F.lower("token"), F.lit(q))).select("token")

    def places(self, sought: str, where: Column | None = None) -> DataFrame:
        """Rows of the stream whose token holds what is sought."""
        found = materialize(self.tokens(sought), "tokens-found")
        rows = self.occurrences if where is None else self.occurrences.filter(where)
        return rows.join(F.broadcast(found) if found.count() <= 50_000 else found, "token").select(*self.occurrences.columns)


def build(stream: DataFrame) -> Index:
    """stream: rows with a token, and whatever else its places have."""
    columns = stream.columns
    # dealt by hash: ranges would have to be sampled, which makes the stream once more
    occurrences = materialize(stream.repartition("token").sortWithinPartitions("token"), "token-places")
    vocabulary = materialize(occurrences.select("token").distinct(), "tokens")
    rows = vocabulary.select(F.explode(grams(F.lower("token"))).alias("gram"), "token")
    postings = materialize(rows.repartitionByRange("gram", "token").sortWithinPartitions("gram", "token"), "postings")
    return Index(vocabulary, postings, occurrences.select(*columns))
