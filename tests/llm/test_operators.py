"""Small tables with nulls, empties, ties, repeats and clashing columns against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from verbaloom.llm import common, op01_license, op02_quality, op03_sentencepiece, op04_topk, op05_lm, op06_packing, op07_simhash, op08_toxicity, op09_url_filter, op10_pii
from verbaloom.llm.sql import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, word string, g string, row long, fp string"
WORDS = "the of and lorem ipsum licence apache license mit general public idiot größe niño été rock blue river stone".split()


def make(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 120)))
        if i % 7 == 0:
            t += "\nMail a.b@c.de, ip 10.0.0.7, card 4111 1111 1111 1111, tel +49 (30) 123-4567.\nDE89 3704 0044 0532 0130 00\nssn 123-45-6789"
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t)))
    rows += [(100, None, "en", "a", None), (101, "", None, None, 0), (None, "null id text " * 5, "en", "a", 1), rows[3], rows[3]]
    rows += [(200, rows[8][1] + " tail", "en", "a", 1), (201, "  \n\t ", "en", "b", 5), (202, "x" * 5000 + " y▁z  é́ 😀 <|endoftext|>", "de", "a", 1), (203, "mit\n\nLICENSE " * 300, "en", "a", 1)]
    return [(*r, "s", "w", "g", 1, "f") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_license(docs, empty):
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in op01_license.license_scan(docs).collect())
    want = []
    for i, t in pairs(docs):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(k, label) for p, label in op01_license.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((repr(i), len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want)
    assert op01_license.license_scan(empty).count() == 0


def test_license_suppression():
    kept = op01_license.Scanner().detect("licensed under the apache license, version 2.0 and see the mozilla public license version 2.0; spdx-license-identifier: mit")
    assert [k[2] for k in kept] == ["apache-2.0", "mpl-2.0", "mit"] and len(op01_license.build_rules()) > 200
    assert op01_license.Scanner().detect("") == []


def test_quality_counts(docs, empty):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in op02_quality.quality(docs).collect())
    want = Counter()
    for i, t in pairs(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, cover = Counter(zip(w, w[1:], w[2:])), set()
        for k, x in enumerate(zip(w, w[1:], w[2:])):
            if c[x] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert got == want
    assert op02_quality.quality(empty).count() == 0


def test_quality_outliers(spark):
    """An outlying cluster doesn't move the robust estimate; its members are rejected."""
    rng = random.Random(4)
    clean = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(120))) for i in range(300)]
    junk = [(1000 + i, " ".join("##|" + "".join(rng.choice("abcdef") for _ in range(3)) for _ in range(120))) for i in range(30)]
    rows = spark.createDataFrame([(i, t, "en", "a") for i, t in clean + junk], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in op02_quality.quality(rows).collect() if r["kept"]}
    assert kept == {i for i, _ in clean}


def test_sentencepiece(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = op03_sentencepiece.model(path).lib
    for r, t in zip(*[sorted(x, key=repr) for x in ([(r["doc_id"], r["ids_sha256"], r["n_tokens"], r["decoded_sha256"]) for r in op03_sentencepiece.sentencepiece_encode(docs, path).collect()], [(i, hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest(), len(lib.encode(t)), hashlib.sha256(lib.decode(lib.encode(t)).encode()).hexdigest()) for i, t in pairs(docs)])]):
        assert r == t
    assert op03_sentencepiece.sentencepiece_encode(empty, path).count() == 0


def test_sentencepiece_agendas_agree():
    m, rng = op03_sentencepiece.model(public_tokenizers.path("piece_bpe_32k.model")), random.Random(5)
    for _ in range(300):
        s = "▁" * rng.randint(1, 4) + "".join(rng.choice("abetnior<0x41>é日\n") for _ in range(rng.randint(0, 30)))
        assert m.merged(list(s)) == m.merged_long(list(s))
    assert m.decode_ids([m.byte_ids[0xE6], m.byte_ids[0x97]]) == m.lib.decode([m.byte_ids[0xE6], m.byte_ids[0x97]])


def topk_by_hand(rows, k=10, every=100):
    code = {}
    for i, v in rows:
        if i is not None and v is not None:
            bits = sum(1 << (63 - j) for j, x in enumerate(v[:64]) if x is not None and x > 0)
            signed = bits - (1 << 64) if bits >> 63 else bits
            code[i] = min(signed, code.get(i, signed))
    near = {q: sorted((bin((code[q] ^ code[v]) & (1 << 64) - 1).count("1"), v) for v in code if v != q)[:k] for q in code if q % every == 0}
    return sorted((q, r + 1, v, d) for q, found in near.items() for r, (d, v) in enumerate(found))


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(64)]) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(None, rows[1][1]), (400, None), (500, rows[0][1]), (600, rows[5][1][:20]), (700, [None, *rows[5][1][1:], 9.0]), (3, rows[4][1]), (800, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, op04_topk.hamming_topk(table).collect())) == topk_by_hand(rows)
    assert op04_topk.hamming_topk(table.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], table.schema)
    assert op04_topk.hamming_topk(few).count() == 3


def test_topk_crowded_buckets_and_lonely_query(spark, monkeypatch):
    """Codes of low entropy share segments; a query far from all is open to the last radii."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    rows = [(i + 1, [float(x) for x in np.where(rng.random(64) < 0.06, -base, base)]) for i in range(400)] + [(1000, [float(-x) for x in base])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = topk_by_hand(rows)
    for bucket in (8, 4096):
        monkeypatch.setattr(op04_topk, "BUCKET", bucket)
        assert sorted(map(tuple, op04_topk.hamming_topk(table).collect())) == want


def test_topk_masks(spark):
    for widths, r in (([16] * 4, 3), ([22, 21, 21], 2)):
        got = [(x["mask_seg"], x["mask"]) for x in op04_topk.masks(spark, widths, r).collect()]
        assert len(got) == len(set(got)) == sum(math.comb(w, r) for w in widths)
        assert all(m.bit_count() == r and m < 1 << widths[s] for s, m in got)
    widths = {n: op04_topk.segment_widths(n) for n in (2, 99, 5_000, 70_000, 5_000_000, 10**10)}
    assert all(sum(w) == 64 and max(w) <= 22 for w in widths.values()) and [len(w) for w in widths.values()] == [16, 10, 5, 4, 3, 3]


def test_topk_beyond_65536_codes(spark, tmp_path):
    """70,000 codes, a cluster, and a lonely query: against brute force in numpy."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((70_000, 64)).astype(np.float32)
    v[100:160] = v[100] * np.where(rng.random((60, 64)) < 0.05, -1, 1)
    v[40_000] = -1  # far from most
    pd.DataFrame({"vec_id": np.arange(len(v)) + 1, "embedding": list(v)}).to_parquet(tmp_path / "v.parquet")
    table = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = {}
    for r in op04_topk.hamming_topk(table, every=10_000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    words = np.packbits(v > 0, axis=1).view(np.uint64)[:, 0]
    assert sorted(got) == list(range(10_000, 70_001, 10_000))
    for q, found in got.items():
        d = np.bitwise_count(words ^ words[q - 1]).astype(int)
        d[q - 1] = 99
        order = np.lexsort((np.arange(len(d)), d))[:10]
        assert [(x, y) for _, x, y in sorted(found)] == [(int(d[i]), int(i) + 1) for i in order]


def test_lm(docs, empty):
    rows = pairs(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in op05_lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), held(i), len(op05_lm.tokens(t)), sum(w in counts for w in op05_lm.tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in op05_lm.tokens(t)), 6)) for i, t in rows)
    for head in (op05_lm.HEAD, 5):  # with and without a shuffled tail
        got = op05_lm.lm_score(docs, head_words=head).collect()
        assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] <= 0 for r in got)
    assert op05_lm.lm_score(empty).count() == 0


def test_lm_does_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(op05_lm, "SHARD_TOKENS", 700)  # several shards
    score = lambda n: {(r["doc_id"], r["n_tokens"]): round(r["score"], 6) for r in op05_lm.lm_score(docs.repartition(n)).collect()}
    assert score(1) == score(5)


def test_lm_is_normalised():
    p = op05_lm.Params.start(np.log(np.full(op05_lm.CELLS, 1 / op05_lm.CELLS)))
    s1, s2, z = p.tables()
    assert np.allclose(np.exp(s1[5] + s2[9] - z[5, 9]).sum(), 1, atol=1e-4)


@pytest.mark.parametrize("keep", [False, True])
def test_packing(docs, empty, keep):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, rows = Tokenizer.from_file(path), op06_packing.pack(docs, path, capacity=256, grain=16, keep_ids=keep).collect()
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in pairs(docs)}
    copies = Counter(i for i, _ in pairs(docs))
    assert Counter(r["doc_id"] for r in rows for _ in range(r["length"])) == Counter({i: len(x) * copies[i] for i, x in ids.items()})
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
        assert r["ids_crc32"] == zlib.crc32(own) and r["doc_tokens"] == len(ids[r["doc_id"]]) and (not keep or bytes(r["ids"]) == own)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 256 and len(sequences) <= 1.15 * sum(sequences.values()) / 256 + 2
    assert all(r["length"] == r["doc_tokens"] for r in rows if r["doc_tokens"] <= 256)  # what fits stays whole
    assert Counter(r["doc_id"] for r in rows) == Counter({i: -(-len(x) // 256) * copies[i] for i, x in ids.items()})
    assert op06_packing.pack(empty, path).count() == 0


def test_packing_program():
    """The linear program's value lies between its bound and any packing; whole numbers come close."""
    rng = np.random.default_rng(1)
    for trial in range(6):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 25)))
        demand = rng.integers(1, 400, len(lengths))
        basis, x, bound = op06_packing.column_generation(lengths, demand.astype(float), 64)
        assert np.allclose(basis @ x, demand) and (lengths @ basis <= 64).all()
        assert max(bound, lengths @ demand / 64) <= x.sum() + 1e-6 <= bound * (1 + op06_packing.TOLERANCE) + 2e-6
        patterns = op06_packing.plan(dict(zip(lengths.tolist(), demand.tolist())), 64)
        used = Counter()
        for times, copies in patterns:
            assert sum(k * n for k, n in copies.items()) <= 64
            used.update({k: times * n for k, n in copies.items()})
        assert used == dict(zip(lengths.tolist(), demand.tolist())) and sum(t for t, _ in patterns) <= bound + len(lengths) + 1
    # three thirds: 2 of 21 and one of 22 fill 64
    assert sum(t for t, _ in op06_packing.plan({21: 20, 22: 10}, 64)) == 10
    assert op06_packing.plan({}, 64) == []


def test_packing_chunks_hold_bytes(monkeypatch):
    monkeypatch.setattr(op06_packing, "CHUNK_BYTES", 10)
    texts = pa.array(["abc", None, "x" * 25, "", "abcdef", "abcdef"])
    assert list(op06_packing.chunks(texts)) == [(0, 2), (2, 1), (3, 2), (5, 1)] and list(op06_packing.chunks(pa.array([], pa.string()))) == []




def simhash(t, width):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_simhash(docs, empty, block_rows):
    rows = [(i, simhash(t, 4)) for i, t in pairs(docs)]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    got = op07_simhash.simhash_components(docs, 4, block_rows=block_rows)
    assert sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got.collect()) == sorted((repr(i), f"{f:016x}", least.get(find(f))) for i, f in rows)
    kept = op07_simhash.keep_one(docs, got)
    assert kept.count() == len({find(f) for _, f in rows}) and kept.columns == docs.columns
    assert op07_simhash.simhash_components(empty).count() == 0


def test_block_keys_grow_with_n():
    assert [op07_simhash.blocks_for(n, 4) for n in (1, 2_000_000, 3_000_000, 10**8, 10**9)] == [6, 6, 7, 7, 8]


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_block_masks_cover(blocks):
    """A pair within the radius agrees on some mask."""
    rng = random.Random(blocks)
    masks = op07_simhash.block_masks(blocks, 4)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_keep_one_of_rows_equal_in_id_and_text(spark):
    rows = [(1, "a b c", x) for x in "zxy"] + [(2, "q", "m")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, other string")
        kept = sorted((r["doc_id"], r["other"]) for r in op07_simhash.keep_one(docs, op07_simhash.simhash_components(docs)).collect())
        assert len(kept) == 2 and kept[1] == (2, "m") and (order is rows or kept == before)
        before = kept


def test_bucket_links_are_complete():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    fps = np.unique([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, 3, replace=False))) for b in base for _ in range(30)])
    a, b = op07_simhash.bucket_links(np.zeros(len(fps), np.int64), fps, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    near = lambda links: sorted(map(sorted, _groups(fps.tolist(), links)))
    assert near(list(zip(a.tolist(), b.tolist()))) == near([(int(x), int(y)) for x in fps for y in fps if bin(int(x) ^ int(y)).count("1") <= 4])


def _groups(nodes, links):
    group = {n: {n} for n in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return {id(g): g for g in group.values()}.values()


def tfidf(texts, terms, n, df):
    """Dense unit vectors by plain loops."""
    out = np.zeros((len(texts), len(terms)))
    for r, t in enumerate(texts):
        seen = Counter(x for w in re.findall(r"[^\W_]+", (t or "").lower()) for x in op08_toxicity.word_terms(w))
        out[r] = [(1 + math.log(seen[x])) * math.log((1 + n) / (1 + d)) if seen[x] else 0 for x, d in zip(terms, df, strict=True)]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0, int("idiot" in (t or ""))) for i, t in pairs(docs) if i is not None] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    index = op08_toxicity.fit_on(docs, labels, min_g2=3.0)
    rows = op08_toxicity.toxicity(docs, index).collect()
    assert len(rows) == docs.count() and all(0 <= r["tox_score"] <= 1 and r["score"] == "s" for r in rows)
    texts = [t for _, t in pairs(docs)]
    n, df = op08_toxicity.frequencies(docs, index.terms)
    has = [{x for w in re.findall(r"[^\W_]+", t.lower()) for x in op08_toxicity.word_terms(w)} for t in texts]
    assert n == len(texts) and df.tolist() == [sum(x in h for h in has) for x in index.terms]
    # the sample: training rows, the least text of an id, equal texts once
    sample = {}
    for i, t in pairs(docs):
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sample[i] = min(t, sample.get(i, t))
    examples = tfidf(sorted(set(sample.values())), index.terms, n, df)
    q = index.vectors(texts)
    assert np.allclose(q, tfidf(texts, index.terms, n, df))
    cosines, who = index.nearest(q, 5)
    exact = np.round(q @ examples.T, 6)
    assert np.allclose(cosines, -np.sort(-exact, axis=1)[:, :5], atol=2e-6)
    # ids by brute force over the index's own order, ties to the lower number
    stored = np.concatenate([index.stored(b) for b in range(len(index.blocks))])
    brute = np.stack([np.concatenate([np.round(index.cosines(q, b), 6) for b in range(len(index.blocks))], axis=1)])[0]
    assert np.allclose(brute, q @ stored.T, atol=2e-6)
    assert (who == np.argsort(-brute, axis=1, kind="stable")[:, :5]).all()
    assert op08_toxicity.toxicity(empty, index).count() == 0
    none = op08_toxicity.fit_on(docs, labels.limit(0))
    assert {r["tox_score"] for r in op08_toxicity.toxicity(docs, none).collect()} == {0.0}


def test_toxicity_without_significant_terms(spark, docs):
    labels = spark.createDataFrame([(i, i % 4 // 3) for i in range(60)], "doc_id long, toxic int")
    index = op08_toxicity.fit_on(docs, labels, min_g2=1e9)
    assert {r["tox_score"] for r in op08_toxicity.toxicity(docs, index).collect()} == {index.prior} and 0 < index.prior < 1


def test_toxicity_repeated_label_rows(spark):
    docs = spark.createDataFrame([(i, "idiot a b" if i % 2 else "rock a b") for i in range(40)] + [(1, "zzz")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    index = op08_toxicity.fit_on(docs, labels, min_g2=3.0)
    assert len(index.labels) == 2  # of equal texts one, of a repeated id the least


def test_block_max_is_exact():
    """Random sparse vectors over many blocks, with ties."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random((700, 40)) < 0.1, rng.integers(1, 4, (700, 40)), 0).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    index = op08_toxicity.Index([f"t{i}" for i in range(40)], np.ones(40), [(np.flatnonzero(x), x[x > 0]) for x in v], rng.integers(0, 2, 700).astype(float), 0.5, np.ones(700))
    q = v[rng.permutation(700)[:90]]
    brute = np.concatenate([np.round(index.cosines(q, b), 6) for b in range(len(index.blocks))], axis=1)
    cosines, who = index.nearest(q, 15)
    assert (who == np.argsort(-brute, axis=1, kind="stable")[:, :15]).all() and len(index.blocks) == 11


def test_toxicity_separates(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[:4] + WORDS[-4:]) for _ in range(40)) + (" idiot moron" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["tox_predicted"] for r in op08_toxicity.toxicity(docs, op08_toxicity.fit_on(docs, labels)).collect()}
    assert got == {i: int(i % 5 == 0) for i, _ in rows}


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/de", "HTTP://EXAMPLE.NET/EN/", "https://x.example.com/de/?q", "https://example.com/d", "ftp://org/fr/x#y", "http://notorg/fr/", "http://net", "http://net/", "no url", None, "", "://", "http:///en/", "http://a.net?/x", "http://ü.net/é", "http://net//"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])] * 3 + [(None, urls[1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(list(op09_url_filter.RULES), "host string, path string, verdict string")
    con = duckdb.connect()
    frame = pages.toPandas()
    frame["page_id"] = frame["page_id"].astype("Int64")
    con.register("pages", frame)
    want = Counter(con.execute(ORACLE_SQL["op9_url_filter"]).fetchall())
    for rows in (1, 100_000):
        assert Counter(map(tuple, op09_url_filter.url_filter(pages, rules, rows_per_salt=rows).collect())) == want
    assert op09_url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_urls_nested_rules(spark):
    rules = spark.createDataFrame([("x", "/", "block"), ("x", "/a", "allow"), ("x", "/ab", "block"), ("x", "/b", "allow"), ("x", "/ab", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, "http://x" + p) for i, p in enumerate(["/", "/a", "/aa", "/ab", "/abz", "/ac", "/b", "/c"])], "page_id long, url string")
    got = [r["rule"] for r in op09_url_filter.url_filter(pages, rules).orderBy("page_id").collect()]
    assert got == ["x/", "x/a", "x/a", "x/ab", "x/ab", "x/a", "x/b", "x/"]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(c if k % 2 == 0 else 2 * c - 9 * (c > 4) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, rx in PATTERNS.items() for m in re.finditer(rx, t) if ok(k, m[0])]


def test_pii(spark, docs, empty):
    rng = random.Random(7)
    odd = ["a@b.c+d@e.f x@y.z@w.v", "1.2.3.4.5.6.7.8 001.0255.3.4 999.1.1.1", "+1 234.567-8901) +12", "4111-1111-1111-1111 5 41111111111111111111", "😀é a@b.c", "xDE89370400440532013000 DE89370400440532013000", "123-45-6789"]
    odd += ["".join(rng.choice("a1@.+- ()4é") for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["1" * 20000 + "@" + "a." * 3000, None]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in op10_pii.with_spans(table).select("text", "pii").collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] in op10_pii.BASE]
        assert got == base_spans(r["text"] or ""), (r["text"] or "")[:80]
    assert op10_pii.with_spans(empty).count() == 0


def test_pii_extra_kinds_and_redaction(spark):
    t = "iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789, no 123-45-6789" + " " * 60 + "321-45-6789 é a@b.de."
    row = op10_pii.with_spans(spark.createDataFrame([(t,)], "text string")).select("pii", op10_pii.redact(F.col("text"), F.col("pii")).alias("x")).first()
    assert [s["kind"] for s in row["pii"]] == ["email", "iban", "ssn", "ssn"]
    assert row["x"] == "iban [IBAN], ssn [SSN], no [SSN]" + " " * 60 + "321-45-6789 é [EMAIL]."


def test_pii_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"]).toPandas())
    rel = con.execute(ORACLE_SQL["op10_pii"])
    names = [c[0] for c in rel.description]
    want = {r[0]: dict(zip(names, r)) for r in rel.fetchall()}
    for r in op10_pii.with_spans(docs.filter("doc_id is not null")).select("doc_id", op10_pii.joined(F.col("pii")).alias("s"), F.array_max(F.transform("pii", lambda x: x["score"])).alias("top")).collect():
        assert want[r["doc_id"]]["spans"] == r["s"] and want[r["doc_id"]]["score"] == (r["top"] or 0)


def test_pii_long_text(spark):
    """2 MB with 100,000 matches in seconds, and redacted."""
    import time

    t = "é a@b.de, 10.0.0.7 " * 50_000 + "x" * 1_000_000
    table = spark.createDataFrame([(t,), ("a@b.de",)], "text string").coalesce(1)
    op10_pii.with_spans(table.limit(0)).collect()
    began = time.perf_counter()
    rows = op10_pii.with_spans(table).select(F.size("pii").alias("n"), F.get("pii", 49_999).alias("last"), F.md5(op10_pii.redact(F.col("text"), F.col("pii"))).alias("x")).collect()
    assert time.perf_counter() - began < 60
    assert [r["n"] for r in rows] == [100_000, 1] and rows[0]["last"]["start"] == 49_999 * 19 + 2
    assert rows[0]["x"] == hashlib.md5(("é [EMAIL], [IP] " * 50_000 + "x" * 1_000_000).encode()).hexdigest()


def test_pii_overlapping_spans_are_one(spark):
    t = "pay 4111 1111 1111 1111@x.de now"
    row = op10_pii.with_spans(spark.createDataFrame([(t,)], "text string")).select("pii", op10_pii.redact(F.col("text"), F.col("pii")).alias("x")).first()
    assert [s["kind"] for s in row["pii"]] == ["email", "card"] and row["x"] == "pay [CARD] now"


def test_running(spark):
    for n in (0, 1, 2, 5, 17, 100):
        values = [random.Random(n).randint(-5, 9) for _ in range(n)]
        table = spark.createDataFrame([(values,)], "v array<int>")
        got = table.select(op10_pii.running(F.col("v"), lambda a, b: a + b).alias("s"), op10_pii.running(F.col("v"), lambda a, b: F.greatest(a, b), -9).alias("m")).first()
        assert got["s"] == [sum(values[: i + 1]) for i in range(n)] and got["m"] == [max(values[: i + 1]) for i in range(n)]


def test_materialize_and_drop(spark, docs):
    kept = common.materialize(docs, "t")
    assert kept.count() == docs.count()
    common.drop_materialized(kept)
