import random

from verbaloom.llm import op02_quality


def test_texts_with_symbols_between_words_are_rejected(spark):
    """Symbol shares from 5 to 15 %; texts with a few symbols or some repeated words stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    rows, bad = [], set()
    for i in range(400):
        w = [word() for _ in range(120)]
        if i % 10 == 1:
            w[5] += " & " + w[6]
        if i % 10 == 2:
            w[20:26] = w[60:66]
        if i % 20 == 3:  # a | behind nearly all words
            share = rng.uniform(0.055, 0.15)
            for k in rng.sample(range(120), min(120, round(share / (1 - share) * sum(map(len, w))))):
                w[k] += " |"
            bad.add(i)
        rows.append((i, " ".join(w), "en", "a"))
    got = op02_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["n_symbols"] >= 0.05 * r["word_chars"] for r in got if r["doc_id"] in bad)
    assert {r["doc_id"] for r in got if not r["kept"]} == bad
