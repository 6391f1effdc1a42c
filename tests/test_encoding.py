import pytest
from pyspark.sql import functions as F

from verbaloom.operators import bpe
from verbaloom.plans import bpe_queries as Q

MERGES = {"en": [("a", "b"), ("ab", "c")], "*": [("b", "c")]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    rows = [(1, "en", "ab  abc\nab "), (2, "de", "bc a bc"), (3, "fr", ""), (4, "es", None), (None, "en", " x"), (2**62 + 1, "de", "\n")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decoding_shuffles_no_text(spark, folder):
    """Tokens are put together where they are made."""
    lists = {"*": [("a", "b"), ("▁", "ab")]}
    rows = Q.decoded(spark, folder, lists)
    assert {(r["doc_id"], r["decoded"]) for r in rows.collect()} == {(1, "ab  abc\nab "), (2, "bc a bc"), (None, " x"), (2**62 + 1, "\n")}
    kept = Q.preserved(spark, folder, lists)
    assert sorted(str(r["doc_id"]) for r in kept.filter("preserved").collect()) == ["1", "2", str(2**62 + 1), "None"]
    assert "Exchange" not in plan(rows) and "Exchange" not in plan(kept) and "Join" not in plan(kept)


def test_distinct_pieces_are_not_remembered(spark, monkeypatch):
    """A word table has no piece twice, so its encoder needs no memory."""
    freq = spark.createDataFrame([("en", "abc", 3), ("de", "abc", 2), (None, "bcb", 1)], "lang string, piece string, n long")
    encoder = bpe.Encoder(MERGES, None, "?")
    monkeypatch.setattr(encoder, "memo", {})
    assert [encoder.one(k, p) for k, p in (("en", "abc"), ("de", "abc"), (None, "bcb"))] == [["abc"], ["a", "bc"], ["bc", "b"]]
    got = {(r["lang"], r["n"], tuple(r["tokens"])) for r in bpe.encode_pieces(freq, MERGES).collect()}
    assert got == {("en", 3, ("abc",)), ("de", 2, ("a", "bc")), (None, 1, ("bc", "b"))}


def test_counts_of_a_word_table_are_those_of_the_texts(spark):
    docs = spark.createDataFrame([("en", "abc abc ab x"), ("de", "abc bc"), ("de", None), (None, "bcb")], "lang string, text string")
    letters = {"en": set("abc"), "*": set("bc")}
    freq = bpe.word_freq(docs, F.split("text", " "), "lang")
    rows = lambda df: {(r["lang"], r["tokens"], r["unknown"]) for r in df.collect()}
    assert rows(bpe.count_words(freq, MERGES, letters, "?")) == rows(bpe.count_tokens(docs, F.split("text", " "), MERGES, letters, "?")) == {("en", 4, 1), ("de", 3, 1), (None, 2, 0)}


def test_tokens_by_portions(spark, monkeypatch):
    """Texts longer than a portion, languages of their own and shared ones in one batch."""
    monkeypatch.setattr(bpe, "ROWS", 2)
    docs = spark.createDataFrame([(1, "en", "ab abc ab x"), (2, "de", "abc"), (3, None, "bc a bc"), (4, "en", "abc"), (5, "en", None)], "doc_id long, lang string, text string").coalesce(1)
    got = sorted((r["doc_id"], r["lang"], r["at"], *r["tokens"]) for r in bpe.encode_texts(docs, F.split("text", " "), MERGES).collect())
    assert got == [(1, "en", 0, "ab"), (1, "en", 1, "abc"), (1, "en", 2, "ab"), (1, "en", 3, "x"), (2, "de", 0, "a", "bc"), (3, None, 0, "bc"), (3, None, 1, "a"), (3, None, 2, "bc"), (4, "en", 0, "abc")]
    whole = {r["doc_id"]: r["tokens"] for r in bpe.encode_whole(docs, F.split("text", " "), MERGES).collect()}
    assert whole == {1: ["ab", "abc", "ab", "x"], 2: ["a", "bc"], 3: ["bc", "a", "bc"], 4: ["abc"]}


def test_languages_without_words(spark, folder):
    """token_count has rows of languages with words, as its SQL; unk_count of all."""
    assert {r["lang"] for r in Q.token_count(spark, folder, Q.SMALL).collect()} == {"en", "de"}
    assert {(r["lang"], r["unknown"]) for r in Q._unknown(spark, folder, Q.SMALL, Q.letters(spark, folder)).collect()} == {("en", 0), ("de", 0), ("fr", 0), ("es", 0)}


def test_table_function_takes_batches(spark, folder):
    """The stream by a table function is that of encoding, by Arrow batches and without a lateral call a text."""
    rows = Q.token_stream_function(spark, folder, Q.SMALL)
    want = Q.encoded_stream(spark, folder, Q.merge_lists(Q.joint(spark, folder, Q.SMALL))).select("doc_id", "lang", "at", "tokens")
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
    assert len(rows.collect()) == rows.count() == len(want.collect()) > 6
    assert "ArrowEvalPythonUDTF" in plan(rows) and "Exchange" not in plan(rows)
