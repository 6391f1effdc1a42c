import heapq
import random
import tracemalloc

import numpy as np
import pytest
from test_bpe import slow_train

from verbaloom.operators import bpe_kernel, bpe_rounds


def test_symbols_take_few_bytes():
    """Symbols, links and counts in 32 bits, and a sort in place: a task's room is millions of symbols."""
    rng = np.random.default_rng(1)
    sizes = np.full(50_000, 8)
    flat = rng.integers(0, 60, sizes.sum()).astype(np.int32)
    tracemalloc.start()
    state = bpe_kernel.Symbols(flat, sizes, np.full(len(sizes), 3))
    held = tracemalloc.get_traced_memory()[0]
    at = state.linked()
    order, keys, begin = bpe_kernel.groups(state.pairs(at))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 18 * len(flat) and peak < 60 * len(flat)
    assert bpe_kernel.sums(state.weight[at[order]], begin).sum() == 3 * len(at) and (np.diff(keys) > 0).all()


def test_counts_beyond_32_bits():
    big = 3 << 30
    assert bpe_kernel.train_kernel(["ab", "bc", "abc"], [big, big, 1], list("abc"), 2) == [("a", "b"), ("b", "c")]
    state = bpe_kernel.Symbols(np.tile(np.array([0, 1], np.int32), 3), np.full(3, 2), np.full(3, 2**31 - 1))
    assert bpe_kernel.sums(state.weight[state.linked()], np.array([0])).tolist() == [3 * (2**31 - 1)]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_that_cannot_be_next_are_not_noted(seed, monkeypatch):
    """A round ends at `last`; pairs made rarer than that are never put on the heap, and the merges stay the same."""
    rng = random.Random(seed)
    table = {"".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))): rng.randint(1, 9) for _ in range(200)}
    words, letters = sorted(table), list("abcdeé")
    pushed, push = [], heapq.heappush
    monkeypatch.setattr(bpe_kernel.heapq, "heappush", lambda heap, x: (pushed.append(x), push(heap, x)))
    state = bpe_kernel.Symbols(*bpe_kernel.numbered(words, letters), [table[w] for w in words])
    got = bpe_kernel.train_symbols(state, list(letters), 500, (-40, 0))
    assert got == slow_train(words, [table[w] for w in words], letters, len(got)) and len(got) > 3
    assert len(pushed) < 6 * len(got)


def test_few_merges_look_at_few_pairs(spark):
    """Twelve merges don't list and cut by as many pairs as ten thousand."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3_000)}
    freq = spark.createDataFrame([("x", w, 1) for w in sorted(words)], "lang string, piece string, n long")
    letters, report = sorted(set("".join(words))), []
    got = bpe_rounds.train_rounds(freq, {"x": letters}, {"x": 12}, report)
    assert got["x"] == bpe_kernel.train_kernel(sorted(words), [1] * len(words), letters, 12)
    assert max(r["pairs"] for r in report) <= 128
