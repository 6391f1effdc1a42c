import random
import re
import unicodedata

import numpy as np
import pyarrow as pa

from verbaloom.functions import pieces as P
from verbaloom.functions.text import MARK
from verbaloom.operators import bpe
from verbaloom.operators.bpe_kernel import distinct, groups


def metaspace(text):
    return re.findall(f"{MARK}[^{MARK}]*|[^{MARK}]+", (text or "").replace(" ", MARK))


def test_pieces_are_the_patterns():
    rng = random.Random(1)
    for _ in range(500):
        texts = [rng.choice([None, "", "".join(rng.choice(f" \n{MARK}aé𝒳") for _ in range(rng.randint(0, 9)))]) for _ in range(rng.randint(0, 6))]
        rows = pa.array([None, "zz x", *texts, "q r"], pa.string()).slice(2, len(texts))
        assert P.metaspace(rows).to_pylist() == [metaspace(t) for t in texts]
        assert P.lines_metaspace(rows).to_pylist() == [[p for line in re.findall(r"[^\n]*\n|[^\n]+", t or "") for p in metaspace(line)] for t in texts]


def test_white_space_of_all_characters():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    got = P.white_space(pa.array([f"a{c}b" for c in points])).to_pylist()
    assert got == [f"a{c}b".split() for c in points]


def test_counts_come_once_a_portion(spark):
    """What is shuffled is a row a distinct piece of a portion, not one an occurrence."""
    texts = [("en", "a b a é é" * 50), (None, " a  a "), ("de", None), ("en", "b\x1fb")] * 3
    docs = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    rows = [(r["lang"], r["piece"], r["n"]) for r in bpe.counted(docs, P.white_space, P.nfc).collect()]
    expected = {}
    for lang, text in texts:
        for p in unicodedata.normalize("NFC", text or "").split():
            expected[lang, p] = expected.get((lang, p), 0) + 1
    assert len(rows) <= len(expected) + 1  # é is made of two forms
    assert {(r["lang"], r["piece"]): r["n"] for r in bpe.word_table(docs, P.white_space, P.nfc).collect()} == expected


def test_groups_keep_the_order_of_equal_keys():
    rng = random.Random(2)
    for high in (3, 1 << 29):
        keys = [rng.randrange(high) << 32 | rng.randrange(high) for _ in range(300)]
        keys = np.array(keys + keys)
        order, found, begin = groups(keys)
        assert order.tolist() == sorted(range(len(keys)), key=lambda i: (keys[i], i))
        assert found.tolist() == sorted(set(keys.tolist())) and keys[order][begin].tolist() == found.tolist()
    assert distinct(keys).tolist() == found.tolist()


def test_places_are_cut_in_arrow(spark):
    docs = spark.createDataFrame([(2**53 + 1, "en", " a  é\x1fb "), (None, "de", "a"), (3, None, None), (4, "en", "")], "doc_id long, lang string, text string")
    got = {(r["lang"], r["doc_id"], r["pos"], r["token"]) for r in bpe.places(docs, P.white_space, P.nfc).collect()}
    assert got == {("en", 2**53 + 1, 0, "a"), ("en", 2**53 + 1, 1, "é"), ("en", 2**53 + 1, 2, "b"), ("de", None, 0, "a")}
