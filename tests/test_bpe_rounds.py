import random

import pytest
from test_bpe import slow_train

from verbaloom.operators import bpe, bpe_rounds
from verbaloom.operators.bpe_kernel import train_kernel


def words_of(seed, letters, n, most):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters if i % 3 else letters[:2]) for _ in range(rng.randint(1, most))): rng.randint(1, 9) for i in range(n)}


@pytest.mark.parametrize(("seed", "room"), [(1, 1), (2, 60), (3, 200)])
def test_rounds_are_the_kernel(spark, seed, room, monkeypatch):
    """Two languages at once, runs and tokens made twice among them, down to the last pair."""
    monkeypatch.setattr(bpe_rounds, "SEGMENT_SYMBOLS", room)
    monkeypatch.setattr(bpe_rounds, "PART", 1)
    monkeypatch.setattr(bpe_rounds, "PAIRS", 16)
    table = {"x": words_of(seed, "aab", 12, 6), "y": words_of(seed + 9, "abcdé", 40, 9)}
    freq = spark.createDataFrame([(k, w, n) for k, own in table.items() for w, n in own.items()], "lang string, piece string, n long")
    letters = {k: sorted(set("".join(own))) for k, own in table.items()}
    wanted, report = {"x": 20, "y": 14}, []
    got = bpe_rounds.train_rounds(freq, letters, wanted, report)
    for k, own in table.items():
        assert got[k] == slow_train(list(own), list(own.values()), letters[k], wanted[k])
    assert any(r["pairs"] < 16 for r in report) and sum(r["merges"] for r in report) == sum(map(len, got.values()))


def test_a_round_takes_many_merges(spark, monkeypatch):
    """A table beyond the kernel's size trains in a few rounds of a bounded size, not in a batch of jobs for a merge or two."""
    monkeypatch.setattr(bpe_rounds, "SEGMENT_SYMBOLS", 4_000)
    monkeypatch.setattr(bpe_rounds, "PART", 2)
    rng = random.Random(5)
    parts = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    table = {}
    for _ in range(3_000):
        word = "".join(parts[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randint(1, 4)))
        table[word] = table.get(word, 0) + rng.randint(1, 50)
    freq = spark.createDataFrame([("x", w, n) for w, n in table.items()], "lang string, piece string, n long")
    rounds = []
    monkeypatch.setattr(bpe, "train_rounds", lambda *a: bpe_rounds.train_rounds(*a, rounds))
    got = [(r["left"], r["right"]) for r in bpe.train(freq, 300, kernel_words=100).orderBy("rank").collect()]
    assert got == train_kernel(list(table), list(table.values()), sorted(set("".join(table))), 300)
    assert len(got) == 300 and 1 < len(rounds) < 30
