import random

from verbaloom.llm import op04_topk


def test_buckets_hold_about_four_codes(spark, monkeypatch):
    """A radius then costs a query a fraction of the probes that buckets of one code need; results stay exact."""
    rng = random.Random(4)
    codes = {i: rng.getrandbits(64) for i in range(1, 2001)}
    rows = [(i, [1.0 if c >> (63 - b) & 1 else -1.0 for b in range(64)]) for i, c in codes.items()]
    seen, masks = set(), op04_topk.masks
    monkeypatch.setattr(op04_topk, "masks", lambda s, widths, r: seen.add(tuple(widths)) or masks(s, widths, r))
    got = op04_topk.hamming_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 500).collect()
    (widths,) = seen
    assert 2 <= 2000 / 2 ** (64 / len(widths)) <= 8
    for q in (500, 1000, 1500, 2000):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:3]
        assert [(r["distance"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == near
