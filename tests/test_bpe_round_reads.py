import random
from collections import Counter

from verbaloom.operators import bpe_rounds
from verbaloom.operators.bpe_kernel import train_kernel


def table_of(seed, n):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    return {"".join(parts[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(n)}


def test_words_carry_the_sums_of_their_pairs(spark):
    """A round's pairs aren't counted by a reading of its words of their own."""
    words = table_of(1, 400)
    letters = sorted(set("".join(words)))
    freq = spark.createDataFrame([("x", w, n) for w, n in words.items()], "lang string, piece string, n long")
    state = bpe_rounds._numbered(freq, {"x": letters})
    expected, symbols = Counter(), 0
    for w, n in words.items():
        symbols += len(w)
        for a, b in zip(w, w[1:], strict=False):
            expected[letters.index(a) << 32 | letters.index(b)] += n
    got = {r["key"]: r["n"] for r in bpe_rounds._totals(state).collect()}
    assert got.pop(bpe_rounds.SYMBOLS) == symbols and got == expected


def test_foreseen_from_a_quarter_of_the_words(spark, monkeypatch):
    """Rounds planned from a part of the words give the same merges, each language in a task of its own."""
    monkeypatch.setattr(bpe_rounds, "SEGMENT_SYMBOLS", 4_000)
    monkeypatch.setattr(bpe_rounds, "PART", 1)
    monkeypatch.setattr(bpe_rounds, "WHOLE_SYMBOLS", 1_000)
    tables = {k: table_of(i, 3_000) for i, k in enumerate("vwx")}
    freq = spark.createDataFrame([(k, w, n) for k, own in tables.items() for w, n in own.items()], "lang string, piece string, n long")
    letters, report = {k: sorted(set("".join(own))) for k, own in tables.items()}, []
    got = bpe_rounds.train_rounds(freq, letters, dict.fromkeys(tables, 200), report)
    for k, own in tables.items():
        assert got[k] == train_kernel(list(own), list(own.values()), letters[k], 200)
    assert any(r["pairs"] < 64 or r["foreseen"] <= 4_000 for r in report) and len(report) < 60
