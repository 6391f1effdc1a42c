import json
import os

import pytest
from pyspark.sql import functions as F

from verbaloom.functions import text as T
from verbaloom.plans.text_queries import norm
from verbaloom.sources import raw_pages as R

SF = "/root/testdata/sf0.001"


def test_pages_there_and_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    R.write_pages(pages.repartition(3), str(tmp_path / "p"))
    back = R.read_pages(spark, str(tmp_path / "p"), 7)
    assert back.rdd.getNumPartitions() == -(-pages.count() // 7)
    assert sorted(map(tuple, back.select("page_id", "url", "html").collect())) == sorted(map(tuple, pages.collect()))
    assert back.filter("error is not null").count() == 0 and not [x for x in os.listdir(tmp_path / "p") if x.startswith("_")]


def test_bad_files_are_rows(spark, tmp_path):
    for name, data in (("1.page", b"http://a\n<p>x"), ("2.page", b"\xff\xfe\n"), ("x.page", b"u\nh"), ("4.page", b"no line"), ("5.txt", b"")):
        (tmp_path / name).write_bytes(data)
    rows = {r["file"]: r for r in R.read_pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1.page", "2.page", "x.page", "4.page"} and rows["1.page"]["html"] == "<p>x" and rows["1.page"]["error"] is None
    assert all(rows[k]["error"] and rows[k]["html"] is None for k in ("2.page", "x.page", "4.page"))


def test_filters_drop_files(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.page").write_bytes(b"u\nh")
    (tmp_path / "3.page").write_bytes(b"\xff")
    read = R.read_pages(spark, str(tmp_path), 2)
    some = read.filter(F.col("page_id").isin(4, 9) & (F.col("url") == "u"))
    assert some.rdd.getNumPartitions() == 1 and sorted(r["page_id"] for r in some.collect()) == [4, 9]
    assert read.filter("page_id = 99").collect() == []


def test_language_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("lang", "doc_id", F.concat("text", F.lit("\n")).alias("value")).repartition(5)
    R.write_language_files(rows, str(tmp_path), "doc_id", kind="md")
    want = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        want[f"{r['lang']}.md"] = want.get(f"{r['lang']}.md", "") + r["text"] + "\n"
    assert {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)} == want


def test_json_tokens(spark, tmp_path):
    stream = norm(spark, SF).select("lang", "doc_id", F.posexplode(T.pieces(F.col("text"))).alias("pos", "value"))
    R.write_language_files(stream, str(tmp_path), "doc_id", "pos", kind="json")
    got = {n.removesuffix(".json"): json.loads((tmp_path / n).read_text()) for n in os.listdir(tmp_path)}
    want = {}
    for r in sorted(stream.collect(), key=lambda r: (r["doc_id"], r["pos"])):
        want.setdefault(r["lang"], []).append(r["value"])
    assert got == want


def test_failed_tasks_leave_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("en", 1, "a"), ("de", 2, "b")], "lang string, at int, value string")
    broken = rows.withColumn("value", F.when(F.col("lang") == "en", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        R.write_language_files(broken, str(tmp_path), "at")
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="one partition"):
        R.register(spark)
        spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, value string").repartition(2).write.format("languagefiles").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
