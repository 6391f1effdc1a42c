import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbaloom.operators import bpe
from verbaloom.operators import metrics as M


def slow_train(words, counts, alphabet, merges):
    """Pair counts from scratch at each step."""
    ids = {c: i for i, c in enumerate(alphabet)}
    split, out = [list(w) for w in words], []
    for _ in range(merges):
        total = {}
        for s, n in zip(split, counts, strict=True):
            for p in zip(s, s[1:], strict=False):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        a, b = min(total, key=lambda p: (-total[p], ids[p[0]], ids[p[1]]))
        ids.setdefault(a + b, len(ids))
        out.append((a, b))
        for k, s in enumerate(split):
            t, i = [], 0
            while i < len(s):
                hit = s[i : i + 2] == [a, b]
                t.append(a + b if hit else s[i])
                i += 2 if hit else 1
            split[k] = t
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcd", min_size=1, max_size=9), st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 12))
def test_kernel_is_exact(table, merges):
    words = sorted(table)
    letters = sorted(set("".join(words)))
    assert bpe.train_kernel(words, [table[w] for w in words], letters, merges) == slow_train(words, [table[w] for w in words], letters, merges)


def test_kernel_at_length():
    """Hundreds of merges on random words, runs of one letter among them."""
    rng = random.Random(8)
    table = {"".join(rng.choice("aaab" if i % 3 else "abcdefgh") for _ in range(rng.randint(1, 14))): rng.randint(1, 30) for i in range(150)}
    words = sorted(table)
    letters = sorted({"z", *"".join(words)})
    counts = [table[w] for w in words]
    assert bpe.train_kernel(words, counts, letters, 400) == slow_train(words, counts, letters, 400)
    assert bpe.train_kernel([], [], [], 5) == [] and bpe.train_kernel(["a", ""], [1, 1], ["a"], 5) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=9), st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 25), st.sampled_from([2, 3, 5, 1000]))
def test_batches_are_the_next_merges(table, merges, top):
    """Batches from the most frequent pairs, as the distributed trainer takes them, give the same merges."""
    words = sorted(table)
    counts, letters = [table[w] for w in words], sorted(set("".join(words)))
    ids, split, out = {c: i for i, c in enumerate(letters)}, [list(w) for w in words], []
    while len(out) < merges:
        total = {}
        for s, n in zip(split, counts, strict=True):
            for p in zip(s, s[1:], strict=False):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        rows = [(*p, n) for p, n in sorted(total.items(), key=lambda r: (-r[1], ids[r[0][0]], ids[r[0][1]]))[:top]]
        pairs = bpe.batch_of(rows, rows[-1][2] if len(rows) == top else 0, merges - len(out))
        for a, b in pairs:
            ids.setdefault(a + b, len(ids))
        out += pairs
        for k, s in enumerate(split):
            t = []
            for x in s:
                if t and (t[-1], x) in pairs:
                    t[-1] += x
                else:
                    t.append(x)
            split[k] = t
    assert out == slow_train(words, counts, letters, merges)


def test_distributed_training_is_the_same(spark):
    rng = random.Random(3)
    rows = [("x", "".join(rng.choice("abca\x01\x02") for _ in range(rng.randint(1, 7))), rng.randint(1, 5)) for _ in range(40)]
    freq = spark.createDataFrame(rows, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    one, two = bpe.train(freq, {"x": 6}), bpe.train(freq, 6, kernel_words=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    table = {r["piece"]: r["n"] for r in freq.collect()}
    letters = sorted(set("".join(table)))
    assert [(r["left"], r["right"]) for r in one.orderBy("rank").collect()] == slow_train(list(table), list(table.values()), letters, 6)
    assert bpe.train_distributed(freq, letters, 6, top=2) == slow_train(list(table), list(table.values()), letters, 6)


@pytest.mark.parametrize("top", [3, 40, 1000])
def test_pair_index_trains_at_length(spark, top, monkeypatch):
    """Merges until no pair is left, runs and tokens made twice among them, and few words touched by a batch."""
    monkeypatch.setattr(bpe, "COMPACT", 5)
    rng = random.Random(top)
    table = {"".join(rng.choice("aab" if i % 4 else "abcd") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for i in range(14)}
    freq = spark.createDataFrame(list(table.items()), "piece string, n long")
    letters, report = sorted(set("".join(table))), []
    got = bpe.train_distributed(freq, letters, 30 if top > 3 else 12, top, report)
    assert got == slow_train(list(table), list(table.values()), letters, 30 if top > 3 else 12)
    assert sum(r["merges"] for r in report) == len(got) and all(r["bytes"] > 0 for r in report)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.lists(st.tuples(st.sampled_from(["a", "b", "c", "ab", "aa", "bc", "abc"]), st.sampled_from(["a", "b", "c", "aa", "bc", "ca"])), max_size=14))
def test_agenda_equals_passes(word, merges):
    """Merging by agenda equals scanning for the lowest rank, and replay equals one pass a merge, repeats included."""
    ranks, again = {p: i for i, p in reversed(list(enumerate(merges)))}, {}
    for i, p in enumerate(merges):
        again.setdefault(p, []).append(i)

    def once(s, a, b):
        t = []
        for x in s:
            if t and t[-1] == [a] and x == b:
                t[-1] = [a + b, None]
            else:
                t.append([x])
        return [x[0] for x in t]

    s = list(word)
    while (best := min(zip(s, s[1:]), key=lambda p: ranks.get(p, 99), default=None)) in ranks:
        s = once(s, *best)
    assert bpe.encode_piece(word, ranks, None, "?") == s
    s = list(word)
    for a, b in merges:
        s = once(s, a, b)
    assert bpe.replay(word, again) == s


def test_ids_beside_a_null(spark):
    rows = [(2**53 + 1, "en", "ab"), (None, "en", "ab c"), (2**62 + 1, "de", "c"), (5, None, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    got = {(r["doc_id"], r["lang"], r["at"], tuple(r["tokens"])) for r in bpe.encode_texts(docs, F.split("text", " "), {"*": [("a", "b")]}).collect()}
    assert got == {(2**53 + 1, "en", 0, ("ab",)), (None, "en", 0, ("ab",)), (None, "en", 1, ("c",)), (2**62 + 1, "de", 0, ("c",)), (5, None, 0, ("ab",))}


def test_long_piece():
    """A piece of a million symbols is encoded in seconds."""
    rng = random.Random(2)
    word = "".join(rng.choice("abcd") for _ in range(1_000_000))
    began = time.perf_counter()
    out = bpe.encode_piece(word, {("a", "b"): 0, ("ab", "c"): 1, ("d", "abc"): 2}, None, "?")
    assert "".join(out) == word and max(map(len, out)) == 4 and time.perf_counter() - began < 60


def test_in_place_encoding(spark, monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 2)  # forgets all the time
    merges = {"en": [("a", "b"), ("ab", "c")], "*": [("b", "c")]}
    docs = spark.createDataFrame([(1, "en", "abc▁ab▁abc▁x▁abc"), (2, "de", "abc"), (3, "en", ""), (4, "en", None)], "doc_id long, lang string, text string")
    pieces = F.split("text", "▁")
    rows = sorted((r["doc_id"], r["at"], r["tokens"]) for r in bpe.encode_texts(docs, pieces, merges).collect())
    assert rows == [(1, 0, ["abc"]), (1, 1, ["ab"]), (1, 2, ["abc"]), (1, 3, ["x"]), (1, 4, ["abc"]), (2, 0, ["a", "bc"]), (3, 0, [])]
    counted = {r["lang"]: (r["tokens"], r["unknown"]) for r in bpe.count_tokens(docs, pieces, merges, {"en": set("abc")}).collect()}
    assert counted == {"en": (5, 1), "de": (3, 3)}


def test_recoder_counts_like_encoding():
    rng = random.Random(4)
    for _ in range(40):
        words = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), rng.randint(1, 5)) for _ in range(6)]
        merges = list({p for p in [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc"), ("c", "a"), ("a", "a"), ("aa", "b")]})
        recoder = bpe.Recoder(words, set(merges))
        for _ in range(6):
            order = rng.sample(merges, rng.randint(0, len(merges)))
            ranks = {p: i for i, p in enumerate(order)}
            assert recoder.count(ranks) == sum(n * len(bpe.encode_piece(w, ranks, None, "?")) for w, n in words)


def test_weight_search(spark):
    """The grid's gaps are those of interleaving and encoding by hand; the earliest of equals wins."""
    table = {"x": [("abab", 3), ("abc", 1)], "y": [("cbc", 2), ("ccb", 2)]}
    lists = {"x": [("a", "b"), ("ab", "ab"), ("ab", "c")], "y": [("c", "b"), ("cb", "c"), ("c", "cb")]}
    freq = spark.createDataFrame([(k, w, n) for k, ws in table.items() for w, n in ws], "lang string, piece string, n long")
    got = {r["combo"]: r for r in bpe.weight_search(freq, lists, ["x", "y"], ["a", "b", "c"], {"x": 4, "y": 4}, 8, range(1, 4), ("x", 1.0)).collect()}
    for combo in range(9):
        w = {"x": combo // 3 + 1, "y": combo % 3 + 1}
        ids, merges = bpe.interleave(lists, ["x", "y"], ["a", "b", "c"], w, ["<unk>"], 8)
        ranks = {p: i for i, p in enumerate(merges)}
        fert = {k: sum(n * len(bpe.encode_piece(p, ranks, None, "?")) for p, n in ws) / 4 for k, ws in table.items()}
        assert len(ids) == 8 and got[combo]["fertility"] == fert and got[combo]["weights"] == w and got[combo]["within"] == (fert["x"] <= 1.0)


def random_search(spark, seed):
    """A search over words of two languages whose merges share letters."""
    rng = random.Random(seed)
    table = {k: {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))): rng.randint(1, 9) for _ in range(40)} for k in "xyz"}
    lists = {k: bpe.train_kernel(list(own), list(own.values()), list("abcd"), 40) for k, own in table.items()}
    freq = spark.createDataFrame([(k, w, n) for k, own in table.items() for w, n in own.items()], "lang string, piece string, n long")
    return bpe.Search(freq, lists, list("xyz"), list("abcd"), {k: sum(own.values()) for k, own in table.items()}, 40, range(1, 5), ("y", 2.0 + seed % 2))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounded_search_has_the_same_winner(spark, seed):
    search = random_search(spark, seed)
    every, some = search.candidates().collect(), search.contenders().collect()
    assert len(every) == 64 and {r["combo"]: r for r in some}.items() <= {r["combo"]: r for r in every}.items() and len(some) < 64
    assert bpe.best_weights(search.candidates()).collect() == bpe.best_weights(search.contenders()).collect()
    assert search._replace(size=1000).candidates().collect() == [] and bpe.best_weights(search._replace(size=1000).contenders()).first()["gap"] is None


def test_numbered_interleaving_is_the_same():
    rng = random.Random(9)
    tokens = ["a", "b", "c", "ab", "bc", "abc", "ca"]
    for _ in range(300):
        lists = {k: [(rng.choice(tokens), rng.choice(tokens)) for _ in range(rng.randint(0, 12))] for k in "xy"}
        weights, size = {k: rng.randint(1, 3) for k in "xy"}, rng.randint(1, 14)
        ids, merges = bpe.interleave(lists, ["x", "y"], ["a", "b", "c"], weights, ["<unk>"], size)
        turns = bpe.Interleaver(lists, ["x", "y"], ["a", "b", "c"], ["<unk>"])
        assert [turns.pairs[i] for i in turns.run(weights, size)] == merges and len(ids) == max(turns.first, 4) + len(merges) and turns.most() >= len(ids)


@settings(max_examples=60, deadline=None)
@given(st.text("ab▁", max_size=12))
def test_encode_keeps_text_and_is_greedy(piece):
    ranks = {("a", "b"): 0, ("ab", "a"): 1, ("a", "a"): 2}
    tokens = bpe.encode_piece(piece, ranks, None, "?")
    assert "".join(tokens) == piece
    assert not any(p in ranks for p in zip(tokens, tokens[1:], strict=False))


def test_encode_cases():
    assert bpe.encode_piece("aaaaa", {("a", "a"): 0}, None, "?") == ["aa", "aa", "a"]
    assert bpe.encode_piece("axa", {}, {"a"}, "?") == ["a", "?", "a"]
    assert bpe.encode_piece("", {}, None, "?") == []


def test_interleave_turns_and_stops():
    lists = {"x": [("a", "b"), ("ab", "c"), ("q", "q")], "y": [("a", "b"), ("b", "c"), ("c", "c")]}
    ids, merges = bpe.interleave(lists, ["x", "y"], ["a", "b", "c"], {"x": 1, "y": 2}, ["<unk>"], 50)
    assert merges == [("a", "b"), ("b", "c"), ("c", "c"), ("ab", "c")]
    assert ids == {"<unk>": 0, "a": 1, "b": 2, "c": 3, "ab": 4, "bc": 5, "cc": 6, "abc": 7}
    assert len(bpe.interleave(lists, ["x", "y"], ["a", "b", "c"], {"x": 1, "y": 2}, ["<unk>"], 5)[0]) == 5


@pytest.mark.parametrize(
    ("tokens", "units", "score"),
    [({"en": 114772, "hi": 51270, "te": 24751, "mr": 23913}, {"en": 186367, "hi": 88359, "te": 36292, "mr": 29766}, 4481.89792466692)],
)
def test_published_score(spark, tokens, units, score):
    rows = spark.createDataFrame([(k, tokens[k], units[k]) for k in tokens], "lang string, tokens long, denom long")
    ratios = M.fertility(rows)
    assert M.balance(ratios).first()["score"] == pytest.approx(score, abs=1e-8)
    adjusted = M.adjusted(ratios, "hi").first()
    assert adjusted["penalty"] == 1.0 and adjusted["adjusted_score"] == pytest.approx(score, abs=1e-8)


def test_published_rounded_score(spark):
    rows = spark.createDataFrame([("en", 3578, 2880), ("mr", 3936, 2904), ("hi", 4031, 2930), ("te", 3676, 2646)], "lang string, tokens long, denom long")
    got = M.balance(M.fertility(rows), 4).first()
    assert (got["spread"], got["score"]) == (0.1469, 6807.35)


def test_no_denominator(spark):
    rows = spark.createDataFrame([("en", 5, 0)], "lang string, tokens long, denom long")
    assert M.fertility(rows).first()["ratio"] is None
    assert M.fertility(rows, zero_is_null=False).first()["ratio"] == 0.0
