import random

LETTERS = "abcdefghij"


def write_tables(spark, path, rows=200):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 8)))
    docs = [(i, " ".join(word() for _ in range(150)) + (" idiot moron" if i % 5 == 4 else ""), "en", "a", 1) for i in range(rows)]
    if rows:
        docs += [(500, docs[0][1], "en", "a", 1), (501, "too short", "en", "a", 1), (600, docs[1][1] + " moron idiot", "en", "a", 1), (601, "##| " * 200 + docs[2][1], "en", "a", 1), (602, None, "en", "a", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 4)) for i in range(rows)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
