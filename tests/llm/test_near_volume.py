import pytest
from pyspark.sql import functions as F

from tests.llm.test_near_copies import edited, groups
from verbaloom.llm import near_copies, op07_simhash

TEXTS = [(1, "a b c"), (2, "A b c"), (3, "d e f g h i"), (None, "a b c"), (4, None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_that_stay_are_not_shuffled(spark):
    """Only what leaves travels; rows that come again are few too and end as one."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    kept = op07_simhash.keep_one(docs, near_copies.near_components(docs))
    assert "Exchange hashpartitioning" not in plan(kept)
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c"), (3, "d e f g h i"), (4, None)]
    twice = docs.unionByName(docs)
    assert sorted(map(tuple, op07_simhash.keep_one(twice, near_copies.near_components(twice)).collect())) == sorted(map(tuple, kept.collect()))


def test_key_runs(spark):
    """Keys of two classes give their pair, larger ones their members, each once."""
    rows = [(10, 1), (10, 2), (11, 1), (11, 2), (20, 3), (20, 4), (20, 5), (21, 3), (21, 4), (21, 5), (30, 6)]
    keyed = spark.createDataFrame(rows, "key long, sid long").withColumns({"size": F.lit(9), "fp": F.lit(0).cast("long")})
    got = near_copies.key_runs(keyed, 2)
    assert plan(got).count("Exchange hashpartitioning(key") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 2, False), (3, 3, True), (3, 4, True), (3, 5, True)]


@pytest.mark.parametrize("part", [1, 2, 1 << 20])
def test_parts_change_no_result(spark, monkeypatch, part):
    """Whether large keys are known before the shuffle or found behind it."""
    monkeypatch.setattr(near_copies, "PART", part)
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_copies.near_components(docs, 2, 64)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(groups(texts)))


def test_partners_are_bounded_exactly(spark):
    """Of a crowd that shares a passage, only texts with a possible partner travel; none of a similar pair is lost."""
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_copies.signed(docs).groupBy("sid").agg(*[F.first(c).alias(c) for c in ("size", "bins")])
    rows = near_copies.partnered(signed.select(F.lit(1).cast("long").alias("key"), F.col("sid").alias("s")), signed)
    kept = {r["s"] for r in rows.collect()}
    sid = {r["doc_id"]: r["sid"] for r in near_copies.signed(docs).collect()}
    root = groups(texts)
    partnered = {sid[i] for i in sid for j in sid if root[i] == root[j] and sid[i] != sid[j]}
    assert partnered <= kept and len(kept) < len(set(sid.values())) - 10
