import random

from verbaloom.llm import near_copies, op07_simhash


def test_near_copies_come_by_block_keys_and_pivots(spark, monkeypatch):
    """Without the prefix filter's pairs, classes within four bits are still met, through op7's own steps, and verified."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(8):
        base = [word() for _ in range(900)]
        texts += [" ".join(base), " ".join([*base[:-1], word()]), " ".join(word() for _ in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [int(op07_simhash.majority(near_copies.shingles(t))) for t in texts]
    near = [i for i in range(0, len(texts), 3) if (fps[i] ^ fps[i + 1]).bit_count() <= near_copies.LINK]
    assert len(near) > 4
    nothing = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "few_pairs", lambda keyed: nothing)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_components(docs).collect()}
    assert [got[i + 1] for i in near] == near
    assert all(got[i] == i for i in range(len(texts)) if i % 3 != 1)


def test_fingerprint_links_are_verified(spark):
    """Equal or near fingerprints alone make no near copies."""
    classes = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, -1)], "sid long, fp long")
    assert sorted(map(tuple, near_copies.simhash_pairs(classes).collect())) == [(1, 2), (1, 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f", "g h i j k l", "", None])], "doc_id long, text string")
    got = near_copies.near_components(docs)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {0: 0, 1: 1, 2: 2, 3: 2}
