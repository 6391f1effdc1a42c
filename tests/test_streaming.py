from pyspark.sql import functions as F

from verbaloom.functions import text as T
from verbaloom.operators import metrics as M
from verbaloom.streaming import word_stream as W
from verbaloom.streaming.word_stream import word_counts

SF = "/root/testdata/sf0.001"


def test_running_counts(spark, tmp_path):
    schema = "doc_id long, lang string, text string"
    for i, text in enumerate(["a b a", "b  c"]):
        spark.createDataFrame([(i, "en", text)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = word_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert {(r["piece"], r["n"]) for r in spark.table("running").collect()} == {("a", 2), ("b", 2), ("c", 1)}
    finally:
        query.stop()


def test_top_words_over_restarts(spark, tmp_path):
    """Two runs with all files at hand, the second from the first one's state, give what one query over all gives."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, W.ROCKS)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.concat("text", F.lit(" étoile é́")))
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]
    try:
        for part in (0, 1):
            docs.filter(F.col("doc_id") % 2 == part).repartition(3).write.mode("append").parquet(paths[0])
            stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(paths[0])
            W.keep(W.top_words(stream), *paths[1:]).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    rows = T.nfc_texts(docs.select("lang", "doc_id", "text")).select("lang", "doc_id", F.posexplode(T.pieces(T.collapse(F.col("text")))).alias("pos", "token"))
    want = M.top_tokens(rows.select("lang", "token", F.struct("doc_id", "pos").alias("at")))
    assert sorted(map(tuple, W.current_top(spark, paths[1]).collect())) == sorted(map(tuple, want.collect()))
