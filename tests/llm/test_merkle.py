"""The Merkle manifest against a tree built plainly: one leaf, short runs, blocks, tiers, null and large ids."""

import hashlib
import re
import zlib

import pytest

from verbaloom.llm import op13_merkle as op

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, tree long, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    text = r[1] if r[1] is None or not lower else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        at = i - i % 8
        yield level[at:i], level[i + 1 : at + 8]
        i //= 8


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: levels([leaf(r) for r in own[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(own[k]):
            steps = [*path(trees[k], i), *path(top, j)]
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in steps:
                node = sha(*a, node, *b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha(*[x for a, b in steps for x in a + b]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows(n, langs):
    out = [(i * 7 % 1000003, f"Text {i}" if i % 3 else f"lower {i}", langs[i % len(langs)], None if i % 11 == 0 else "s", i if i % 13 else None) for i in range(n)]
    return out


def check(spark, tmp_path, data, levels=op.BLOCK_LEVELS):
    spark.createDataFrame([(*r, "n", 1, "p") for r in data], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    df = op.manifest(spark.read.parquet(str(tmp_path / "documents.parquet")), levels)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute(data)


def test_odd_rows(spark, tmp_path):
    data = rows(70, ["en", "de", "en", "é"]) + [(None, "x", "en", "s", 1), (None, None, None, None, None), (2**53 + 1, "AbC" * 40000, "en", "s", 3), (2**62 + 1, "", "en", "s", 0)]
    data += [data[4], data[4], (7, "tie", "en", "s", 1), (7, "another tie", "en", "s", 1), (1, "alone", "xx", "s", 5)]
    check(spark, tmp_path, data)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_sizes(spark, tmp_path, n):
    check(spark, tmp_path, rows(n, ["en"]))


def test_more_languages_than_a_run(spark, tmp_path):
    check(spark, tmp_path, rows(90, [f"l{i}" for i in range(11)] + [None]))


def test_blocks_and_tiers(spark, tmp_path):
    """Blocks of 8 leaves, so that one language has four tiers of blocks."""
    check(spark, tmp_path, rows(530, ["en", "en", "en", "de"]), 1)


def test_traversal_holds_two_runs_a_level():
    leaves = [sha(str(i)) for i in range(700)]
    tree = levels(leaves)
    for i, found in enumerate(op.traverse(leaves, 4)):
        assert [(p, s) for p, s in found] == [(len(a), a + b) for a, b in path(tree, i)]
    level = op.Level(1, leaves)
    for i in range(len(leaves)):
        level.step()
        assert len(level.run) <= 8 and len(level.ahead) <= 8 and all(len(r) < 8 for r in level.tree.stack)
        if (i + 1) % 64 == 0:
            level.move()


def test_empty(spark, tmp_path):
    check(spark, tmp_path, [])


def test_long_languages_keep_height(spark):
    """A last block of one leaf below a full one is hashed up to the blocks' level."""
    leaves = [sha(str(i)) for i in range(4097)]
    tree = levels(leaves)
    assert op.root_of(leaves[4096:], 4) == tree[4][1] and op.root_of(leaves[:4096], 4) == tree[4][0]
