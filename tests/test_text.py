from pyspark.sql import functions as F

from verbaloom.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first()["x"]


def norm(spark, value):
    return T.nfc_texts(spark.createDataFrame([(value,)], "text string")).select(T.collapse(F.col("text")).alias("x")).first()["x"]


def test_normalize(spark):
    assert norm(spark, "é  x y z　w\x0bv\x1cu\x1ft\r\n") == "é x y z w v u t"
    assert norm(spark, "   ") == "" and norm(spark, "") == "" and norm(spark, None) is None


def test_words(spark):
    t = F.col("text")
    assert one(spark, "... !!", T.words(t)) == []
    assert one(spark, "क । ख", T.words(t)) == ["क", "।", "ख"]
    assert one(spark, "(భారతదేశం), don't", T.words(t)) == ["భారతదేశం", "don't"]


def test_units(spark):
    t = F.col("text")
    assert one(spark, "é\U00020000😀\x1ca", T.faithful_units(t)) == 4
    assert one(spark, "है।", T.faithful_units(t)) == 2
    assert one(spark, None, T.faithful_units(t)) is None


def test_units_of_text_files(spark, tmp_path):
    """Files with mixed scripts and line ends; counts by hand."""
    from verbaloom.sources.tables import text_files

    cases = {"a.md": ("## भारत\r\n\r\nयह है।", 6, 15), "b.md": ("తెలుగు, 1,234 — (x)\n", 9, 20), "c.md": ("", 0, 0)}
    for name, (text, *_) in cases.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = text_files(spark, str(tmp_path)).select("path", F.char_length("text").alias("c"), T.faithful_units(F.col("text")).alias("u")).collect()
    got = {r["path"].rpartition("/")[2]: (r["u"], r["c"]) for r in rows}
    assert {k: got.get(k, (0, 0)) for k in cases} == {k: (u, c) for k, (_, u, c) in cases.items()}


def test_json_files_and_first_available(spark, tmp_path):
    from verbaloom.sources.tables import first_available, json_files, write_json, write_texts

    (tmp_path / "a.json").write_text('{"lang": "en",\n "n": 3}', encoding="utf-8")
    assert json_files(spark, str(tmp_path / "a.json"), "lang string, n long").first()["n"] == 3
    assert first_available(spark, [str(tmp_path / "no"), str(tmp_path / "a.json")]).endswith("a.json")
    docs = spark.createDataFrame([("en", "x é"), ("de", "y")], "lang string, text string")
    write_texts(docs, str(tmp_path / "t"))
    assert {(r["lang"], r["text"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("en", "x é"), ("de", "y")}
    write_json(docs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_metaspace(spark):
    t = F.col("text")
    assert one(spark, "a  b\nc d ", T.metaspace(t)) == ["a", "▁", "▁b\nc", "▁d", "▁"]
    assert one(spark, "ab▁cd", T.decode_metaspace(T.metaspace(t))) == "ab cd"


def test_citations_markdown_and_links(spark):
    t = F.col("text")
    assert one(spark, "x[1] y[note 2] z[longer than fifteen chars]", T.strip_citations(t)) == "x y z[longer than fifteen chars]"
    assert one(spark, "a b\n\n\n\n\nc \n \n\n\nd", T.normalize_markdown(t)) == "a b\n\n\nc\n\n\n\nd\n"
    links = [one(spark, h, T.absolute_link(t, "https://h", "https://h/b/")) for h in ("//x/p", "./p", "/p", "#a", "http://x/p", None)]
    assert links == ["https://x/p", "https://h/b/p", "https://h/p", "#a", "http://x/p", None]


def test_sentences_and_lines(spark):
    t = F.col("text")
    s = "Short. This sentence has just about the right length to be shown! Next."
    assert one(spark, s, T.first_sentence(t)) == "This sentence has just about the right length to be shown!"
    assert one(spark, "x" * 300, T.first_sentence(t)) == "x" * 200
    line = "A line that is long enough to be picked as a sample, at sixty characters."
    assert one(spark, f"# {line}\n  {line}  ", T.sample_line(t)) == line
    assert one(spark, "a b/c~*é", T.url_quote(t)) == "a%20b/c~%2A%C3%A9"
    assert one(spark, '<a & "b">▁', T.display_token(t)) == "&lt;a·&amp;·&quot;b&quot;&gt;·"
