import pytest

from verbaloom.functions.tables import register_tokenize
from verbaloom.plans import bpe_queries as Q

SF = "/root/testdata/sf0.001"


def test_rows_equal_the_token_stream(spark):
    lists = Q.merge_lists(Q.joint(spark, SF, Q.SMALL))
    register_tokenize(spark, lists)
    Q.docs(spark, SF).createOrReplaceTempView("texts")
    got = spark.sql("SELECT doc_id, lang, at, tokens FROM texts, LATERAL tokenize(text)").collect()
    want = Q.encoded_stream(spark, SF, lists).select("doc_id", "lang", "at", "tokens").collect()
    assert len(got) > 1000 and sorted(map(str, got)) == sorted(map(str, want))


def test_nulls_empties_and_wrong_types(spark):
    register_tokenize(spark, {"*": [("a", "b")]})
    assert spark.sql("SELECT t.* FROM VALUES ('ab ab'), (NULL), ('') AS x(text), LATERAL tokenize(text) t").collect() == [(0, ["ab"]), (1, ["▁", "ab"])]
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM tokenize(5)").collect()
