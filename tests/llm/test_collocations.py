"""Collocations against brute force: nulls, empties, repeats, long texts, clashing columns."""

import random
import re
from collections import Counter

import pytest

from verbaloom.llm import op11_collocations as op

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, salt string"
WORDS = "a b c dd éé Ünd the\x07 of   x".split(" ")


def rows(seed=3, n=150):
    rng = random.Random(seed)
    out = [(i, "".join(rng.choice(WORDS) + rng.choice([" ", " ", "\t", "  ", " ", ", ", ". ", "\n", "\r\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for i in range(n)]
    out += [(None, "A a A a a a", "en"), (900, None, "en"), (901, "", None), (902, " ;; \t", "de"), out[5], out[5], (2**62 + 1, "one two three four five six " * 40, "fr"), (903, "the of " * 3000, "en")]
    return [(*r, "p", 7, "s") for r in out]


def brute(data, max_n, min_count, top, cover):
    total, f = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {g: n for g, n in f.items() if len(g[1]) > 1 and n >= min_count}
    inside = lambda s, t: any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))
    out = []
    for lang in {g[0] for g in cand}:
        own = []
        for (k, w), a in cand.items():
            if k != lang or any(o == lang and len(x) > len(w) and 100 * n >= cover * a and inside(w, x) for (o, x), n in cand.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[lang, w[:i]] * f[lang, w[i:]]), i, f[lang, w[:i]], f[lang, w[i:]]) for i in range(1, len(w)))
            own.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("max_n", "min_count", "top", "cover"), [(5, 20, 2000, 100), (5, 2, 40, 100), (4, 5, 2000, 60), (2, 10, 5, 100), (3, 1, 25, 100)])
def test_brute_force(spark, max_n, min_count, top, cover):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert got(op.collocations(docs, max_n, min_count, top, cover)) == brute(data, max_n, min_count, top, cover)


def test_small_blocks_and_full_filter(spark, monkeypatch):
    """Blocks that cut texts, tasks that hold little, and filters that let nearly everything through."""
    data = rows(seed=4, n=60)
    for name, value in (("BLOCK", 50), ("HELD", 100)):
        monkeypatch.setattr(op, name, value)
    text = b"a b\nc d e f g h i j k\nlong piece without any end " * 3
    assert b"\n".join(op.portions(text, 8)) == text
    monkeypatch.setattr(op.Sieve.of.__func__, "__defaults__", (64,))
    assert got(op.collocations(spark.createDataFrame(data, SCHEMA), 5, 8, 100)) == brute(data, 5, 8, 100, 100)


def test_exact_products(spark):
    a, n, left, right = 10**13 + 7, 10**15 + 3, 10**14 + 1, 10**13 + 9
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(a, n, left, right)], "a long, total long, l long, r long").select(op.exact(1000, "a", "total").alias("over"), op.exact("l", "r").alias("under")).select(F.expr("over div under").alias("x")).first()
    assert row["x"] == 1000 * a * n // (left * right)


def test_empty(spark):
    assert op.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.collocations(spark.createDataFrame([(1, None, None, "p", 1, "s")], SCHEMA)).collect() == []
