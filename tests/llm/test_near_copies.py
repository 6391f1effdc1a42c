import importlib
import random

import pytest
from pyspark.sql import functions as F

from verbaloom.llm import near_copies, op07_simhash


def edited():
    """Groups of near copies from Jaccard 0.6 to 1, and texts that share a passage only."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, out = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 5, 6):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    out += [" ".join([word() for _ in range(40)] + passage) for _ in range(20)] + ["", "  ", "a b", None]
    return out


def groups(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                new, old = sorted((root[i], root[j]))
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("few, block_rows", [(32, 2048), (2, 2048), (1, 4)])
def test_near_components(spark, few, block_rows):
    texts = edited()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_copies.near_components(docs, few, block_rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(groups(texts)))
    assert near_copies.near_components(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_near_copies(spark):
    pipeline, texts = importlib.import_module("corpus_pipeline"), edited()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(groups(texts)))
    by_simhash = op07_simhash.keep_one(docs, op07_simhash.simhash_components(docs)).filter(F.col("doc_id").isNotNull())
    assert by_simhash.count() > len(kept)


def test_short_texts_pass_whatever_their_fingerprints(spark):
    """5 against 4 shingles: a few such pairs differ in more bits than the filter allows, and all are links."""
    import random

    rng = random.Random(6)
    rows = []
    for i in range(0, 4000, 2):
        words = [f"{rng.getrandbits(32):x}" for _ in range(9)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in near_copies.near_components(docs).collect())
