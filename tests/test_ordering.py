import random

from verbaloom.operators import ordering


def frame(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 6)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "lang string, id long, k long").repartition(7)


def by_lang(rows):
    return {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in {r[0] for r in rows}}


def test_numbers(spark):
    rows, df = frame(spark)
    got = ordering.numbered(ordering.placed(df, "lang", "id", partitions=9), ["lang"], "number").collect()
    assert sorted((r["lang"] or "", r["id"], r["number"]) for r in got) == sorted((k or "", r[1], i) for k, own in by_lang(rows).items() for i, r in enumerate(own))


def test_capped(spark):
    rows, df = frame(spark)
    got = ordering.capped(ordering.placed(df.filter("lang is not null"), "lang", "id", partitions=9), ["lang"], "k", 100).collect()
    want = []
    for k, own in by_lang(rows).items():
        before = 0
        for r in own if k else []:
            if before < 100:
                want.append((k, r[1], before))
            before += r[2]
    assert sorted((r["lang"], r["id"], r["before"]) for r in got) == sorted(want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "lang string, id long, k long")
    placed = ordering.placed(df, "lang", "id")
    assert ordering.numbered(placed, ["lang"], "n").collect() == [] and ordering.capped(placed, ["lang"], "k", 5).collect() == []
