"""Shared plumbing of the llm operators: table access, lineage cuts, text defaults."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from verbaloom.memo import Remembered
from verbaloom.storage import drop_materialized, materialize, scratch, shared_dir

__all__ = ["Remembered", "drop_materialized", "materialize", "scratch", "shared_dir"]

WORD_WS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A materialized table with a broadcast hint if it has few rows (a count of footers); else the
    table itself, which joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, other: str, limit: int = 1_000_000, how: str = "inner") -> DataFrame:
    """rows joined to a table that has each `other` once. Keys of more than `limit` rows (of which there are at most
    rows / limit) are dealt over salts, and their one row of the table is copied to each. `how`: inner or left."""
    hot = rows.groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("hot_n")).filter(F.col("hot_n") > limit)
    hot = materialize(hot.select("hot_key", F.ceil(F.col("hot_n") / limit).cast("long").alias("hot_salts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, F.col(key) == F.col(other), how)
    hot = small(hot)
    own = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("hot_salts")), F.lit(0))
    dealt = rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("own_salt", own).drop("hot_key", "hot_salts")
    copied = table.join(hot, F.col(other) == F.col("hot_key"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("hot_salts", F.lit(1)) - 1)))
    joined = dealt.join(copied.drop("hot_key", "hot_salts"), (F.col(key) == F.col(other)) & (F.col("own_salt") == F.col("salt")), how)
    return joined.drop("own_salt", "salt")


def beside(docs: DataFrame, keep: list[str], inputs: list[str], run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], made: str) -> DataFrame:
    """The columns `keep` of docs with those that run makes of the columns `inputs`, a row for each row in order. What
    is kept stays in Arrow: as pandas has no null whole numbers, one null there would change ids above 2^53."""
    out = StructType.fromDDL(made)
    types = [(f.name, to_arrow_type(f.dataType)) for f in out.fields]
    source = docs.select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"input_{i}") for i, c in enumerate(inputs)])
    n = len(keep)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch.select(range(n)))
                    yield pd.DataFrame(dict(zip(inputs, (c.to_pandas() for c in batch.columns[n:]), strict=True)))

        for rows in run(frames()):
            new, at = [pa.Array.from_pandas(rows[name], type=kind) for name, kind in types], 0
            while at < len(rows):
                first = waiting.popleft()
                k = min(first.num_rows, len(rows) - at)
                if k < first.num_rows:
                    waiting.appendleft(first.slice(k))
                yield pa.RecordBatch.from_arrays([*first.slice(0, k).columns, *(c.slice(at, k) for c in new)], [*names, *(name for name, _ in types)])
                at += k

    names = [f"keep_{i}" for i in range(n)]
    schema = StructType([*source.schema.fields[:n], *out.fields])
    return source.mapInArrow(mapped, schema).toDF(*keep, *out.names)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside give Python at most so many rows at once: what the JVM and a worker hold of a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, min(before, rows) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """Bind an expensive expression once per row before lambdas use it. Catalyst may otherwise
    inline it into the lambda, which evaluates it once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(doc_id, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
