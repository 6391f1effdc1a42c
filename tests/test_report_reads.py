import json

from pyspark.sql import functions as F

from verbaloom.functions import pieces as P
from verbaloom.operators import bpe
from verbaloom.operators import metrics as M
from verbaloom.plans import bpe_queries as Q

ROWS = [(5, "en", "ab ab\nab  ab cd ▁x"), (2, "en", "cd ab\n\ncd"), (3, "de", "cd cd\nab"), (4, "fr", ""), (6, "fr", "ef ef"), (7, "es", None), (8, "es", "gh\n"), (9, None, "zz ab")]


def folder(spark, path, rows=ROWS):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_merges_from_pieces_are_those_of_the_texts(spark, tmp_path):
    at = folder(spark, tmp_path)
    pieces = bpe.word_table(Q.docs(spark, at), P.metaspace)
    for size in (Q.Sizes(None, 9), Q.SMALL):
        assert sorted(map(tuple, Q._joint_merges(spark, at, size, pieces).collect())) == sorted(map(tuple, Q._joint_merges(spark, at, size).collect()))
    assert {r["ch"] for r in Q._marked_letters(pieces).collect()} == {r["ch"] for r in Q.joint_letters(spark, at).collect()}


def test_report_reads_texts_no_second_time_for_tokens(spark, tmp_path, monkeypatch):
    """Counts, top tokens and the round trip follow from distinct pieces; the stream is read for ties only."""
    at = folder(spark, tmp_path)
    lists = Q.merge_lists(Q.joint(spark, at, Q.SMALL))
    kept = Q.preserved(spark, at, lists).agg(F.bool_and("preserved"), F.count("*")).first()
    ratios = {r["lang"]: (r["tokens"], r["denom"]) for r in Q.joint_ratios(spark, at, lists).collect()}
    monkeypatch.setattr(Q, "preserved", None)
    got = json.loads(Q.report_json(spark, at, Q.SMALL).first()["report"])
    assert got["roundtrip"] == {"preserves_visible": kept[0], "documents": kept[1]} == {"preserves_visible": False, "documents": 6}
    assert {x["code"]: (x["token_count"], x["faithful_units"]) for x in got["languages"]} == {k: v for k, v in ratios.items() if k}
    assert got["languages"][0]["sample_tokenized_sentence"]["original"] == "cd ab\n\ncd"


def test_top_tokens_by_counts(spark):
    """Equal to those of the stream; without ties the stream isn't asked for."""
    docs = spark.createDataFrame([(i, "en", " ".join(f"w{j}" for j in range(40) if j % (i + 1) == 0)) for i in range(9)], "doc_id long, lang string, text string")
    stream = bpe.encode_texts(docs, P.metaspace, {"*": [("▁", "w")]})
    flat = stream.select("lang", "doc_id", "at", F.posexplode("tokens").alias("i", "token")).select("lang", F.struct("doc_id", "at", "i").alias("at"), "token")
    counts = flat.groupBy("lang", "token").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, Q._top_counts(counts, lambda: stream).collect())) == sorted(map(tuple, M.top_tokens(flat).collect()))
    apart = spark.createDataFrame([("en", f"t{i}", 100 - i) for i in range(50)], "lang string, token string, n long")
    assert [tuple(r) for r in Q._top_counts(apart, None).orderBy("rank").collect()] == [("en", i + 1, f"t{i}", 100 - i) for i in range(30)]
