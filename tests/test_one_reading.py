from verbaloom.functions import pieces as P
from verbaloom.operators import bpe
from verbaloom.plans import bpe_queries as Q


def folder_of(spark, tmp_path):
    rows = [(1, "en", "the cat sat\nthe Café"), (2, "en", None), (3, "de", "der\tHut"), (4, "xx", "ж der"), (5, "fr", ""), (6, None, "q z")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_and_letters_come_from_one_reading(spark, tmp_path):
    """Blanks, characters of unknown languages and NFC as in `letters`; words as in the plain word table."""
    d = folder_of(spark, tmp_path)
    docs = Q.docs(spark, d)
    words, chars = bpe.words_and_letters(bpe.word_table(docs, P.white_space, P.nfc, letters=P.nfc))
    assert sorted(map(str, words.collect())) == sorted(map(str, bpe.word_table(docs, P.white_space, P.nfc).collect()))
    assert sorted(map(str, chars.select("lang", "ch").collect())) == sorted(map(str, Q.letters(spark, d).select("lang", "ch").collect()))
    plan = Q.mono(spark, d, Q.SMALL).chars._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


def test_joint_letters_of_all_languages(spark, tmp_path, monkeypatch):
    """The number of joint merges leaves room for characters of languages that have no weight."""
    d = folder_of(spark, tmp_path)
    seen = {}
    monkeypatch.setattr(bpe, "train", lambda words, n, chars=None: seen.update(words=words, n=n, chars=chars))
    Q._joint_merges(spark, d, Q.FULL)
    expected = {r["ch"] for r in Q.joint_letters(spark, d).collect()}
    assert {r["ch"] for r in seen["chars"].collect()} == expected and {"ж", "q", "\n", "▁"} <= expected
    assert seen["n"] == Q.JOINT_VOCAB - 1 - len(expected)
    old = bpe.weighted(bpe.counted(Q.docs(spark, d), P.lines_metaspace), Q.languages(spark))
    assert {(r["piece"], r["n"]) for r in seen["words"].collect()} == {(r["piece"], r["n"]) for r in old.collect()}


def test_given_characters_train_the_same(spark):
    """Characters that no word holds change no merge, and no word table is read for its alphabet."""
    freq = spark.createDataFrame([("x", w, n) for w, n in [("abab", 5), ("bcab", 3), ("cab", 2)]], "lang string, piece string, n long")
    chars = spark.createDataFrame([("x", c) for c in " abcz"], "lang string, ch string")
    one, two = (bpe.train(freq, 5, kernel_words=k, **more) for k, more in ((100, {}), (1, {"chars": chars})))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert "FlatMapGroupsInPandas" not in two._jdf.queryExecution().toString()
