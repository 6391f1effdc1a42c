"""Positions and running sums in an order, for tables of any size.

Rows are range-partitioned by the order's keys and written sorted; each partition's sums give the others' offsets.
No task holds more than a partition, whatever share of the rows a group has. What is summed over partitions has
one row for each partition and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.storage import materialize

#: monotonically_increasing_id() is the partition in the upper and the position in the lower 33 bits.
POSITION_BITS = 33


def position() -> tuple[Column, Column]:
    """Partition and position of a row, as monotonically_increasing_id() numbers it."""
    at = F.monotonically_increasing_id()
    return F.shiftright(at, POSITION_BITS), at.bitwiseAND((1 << POSITION_BITS) - 1)


def placed(rows: DataFrame, *keys: Column | str, tag: str = "placed", partitions: int | None = None) -> DataFrame:
    """rows written in the order of keys, with `part` (of the order) and `at` (position in it). Ranges are chosen
    from a sample, which reads rows once more; keys that may tie in many rows need a further one."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at = position()
    return materialize(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("*", part.alias("part"), at.alias("at")), tag)


def offsets(table: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(*by, part, first, before) of a placed table: the group's first position in the partition and the sum
    of value over its rows of all earlier partitions."""
    sums = table.groupBy(*by, "part").agg(F.min("at").alias("first"), F.sum(value).cast("long").alias("own"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "part", "first", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))


def numbered(table: DataFrame, by: list[str], name: str, broadcast_rows: int = 50_000) -> DataFrame:
    """A placed table with `name`: each row's number in its group, dense from 0, in place of `part` and `at`."""
    starts = materialize(offsets(table, by, F.lit(1)), "offsets")
    marked = [F.col(c).alias(f"start_{c}") for c in [*by, "part", "first", "before"]]
    starts = starts.select(*marked)
    on = [F.col(c).eqNullSafe(F.col(f"start_{c}")) for c in [*by, "part"]]
    joined = table.join(F.broadcast(starts) if starts.count() <= broadcast_rows else starts, on)
    number = F.col("at") - F.col("start_first") + F.col("start_before")
    return joined.select(*[c for c in table.columns if c not in ("part", "at")], number.alias(name))


def capped(table: DataFrame, by: list[str], value: str, cap: int) -> DataFrame:
    """Rows of a placed table that begin below the cap of value's running sum in their group, with `before`: that
    sum over the group's earlier rows. Partitions that lie beyond the cap aren't read further."""
    starts = materialize(offsets(table, by, F.col(value)).filter(F.col("before") < cap), "offsets")
    near = table.join(F.broadcast(starts) if starts.count() <= 50_000 else starts, [*by, "part"])
    earlier = Window.partitionBy(*by, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return near.withColumn("before", before).filter(F.col("before") < cap).drop("part", "at", "first")
