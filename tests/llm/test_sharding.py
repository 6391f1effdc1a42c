"""The communication matrix: exact sums, the hypergeometric law, whole rows, uniform places."""

import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from verbaloom.llm import op12_sharding as op


@pytest.mark.parametrize(("total", "marked", "drawn"), [(10, 4, 3), (1, 1, 1), (30, 30, 7), (30, 0, 7), (50, 20, 50), (40, 25, 30), (5, 2, 0), (2000, 700, 900)])
def test_inversion_follows_the_law(spark, total, marked, drawn):
    """Evenly spaced numbers are answered in the law's proportions."""
    n = 4000
    u = (F.col("id") + 0.5) / n
    x = op.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u).alias("x")
    got = Counter(r["x"] for r in spark.range(n).select(x).collect())
    law = {k: comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) for k in range(max(0, drawn - total + marked), min(drawn, marked) + 1)}
    assert set(got) <= set(law) and all(abs(got[k] / n - p) <= 1.01 / n for k, p in law.items())


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_matrix_sums(spark, fan):
    sizes = [5, 0, 17, 1, 100, 3, 0, 64, 40, 2]
    targets = [30, 29, 29, 29, 29, 29, 29, 28]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part long, n long")
    cells = {r["part"]: r["counts"] for r in op.matrix(frame, targets, 5, fan).collect()}
    assert {k: sum(v) for k, v in cells.items()} == {i: n for i, n in enumerate(sizes) if n}
    assert [sum(v[j] for v in cells.values()) for j in range(8)] == targets and min(min(v) for v in cells.values()) >= 0


def test_large_numbers(spark):
    frame = spark.createDataFrame([(0, 3 * 10**11), (1, 10**11 + 1)], "part long, n long")
    cells = {r["part"]: r["counts"] for r in op.matrix(frame, [2 * 10**11, 2 * 10**11 + 1], 1).collect()}
    assert sum(cells[0]) == 3 * 10**11 and abs(cells[0][0] - 1.5 * 10**11) < 2 * 10**6


def rows():
    out = [(i, f"text {i % 7}" if i % 5 else None, "x", i) for i in range(300)]
    out += [(None, "null id", "x", 1)] * 40 + [(2**62 + 1, "é" * 9000, "x", 1), (2**53 + 1, "", "x", 1)]
    return out


SCHEMA = "doc_id long, text string, row string, shard long"


def test_whole_rows_and_exact_shards(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    narrow = docs.select("doc_id", "text", "row")
    dealt = op.deal(narrow).collect()
    assert Counter((r["doc_id"], r["text"], r["row"]) for r in dealt) == Counter(r[:3] for r in rows())
    sizes = Counter(r["shard"] for r in dealt)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for j in range(8):
        assert sorted(r["slot"] for r in dealt if r["shard"] == j) == list(range(sizes[j]))


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op12_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_places_are_uniform(spark):
    """Each row lies in each shard and half about equally often, whatever its partition."""
    docs = spark.range(40, numPartitions=3).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(0, 16, 2):
        for r in op.deal(docs, 2, seed).collect():
            seen[r["doc_id"] < 14, r["shard"], r["slot"] < 10] += 1
    for first, n in ((True, 14 * 8), (False, 26 * 8)):
        for cell in ((s, h) for s in (0, 1) for h in (True, False)):
            assert abs(seen[(first, *cell)] - n / 4) < 5 * (n * 3 / 16) ** 0.5


def test_few_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA).select("doc_id", "text")
    assert op.deal(empty).collect() == [] and op.deal(empty).columns == ["doc_id", "text", "shard", "slot"]
    assert sorted(r["slot"] for r in op.deal(spark.createDataFrame([(1,), (None,), (3,)], "doc_id long")).collect()) == [0, 0, 0]


def test_written_shards(spark, tmp_path):
    dealt = op.deal(spark.range(50).withColumnRenamed("id", "doc_id"), 3)
    op.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in dealt.collect())
