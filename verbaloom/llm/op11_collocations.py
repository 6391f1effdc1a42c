"""Phrase collocations: counted n-grams of every language, scored by their weakest cut.

All 1..max_n-grams are exploded into rows and hash-aggregated by language in three rounds: words, pairs, longer
ones. A phrase is never more frequent than what it holds, so a round leaves out grams that hold a word or
pair below min_count. That test is a Bloom filter of bounded size: it lets some rare grams through (their
counts drop them), more of them when it is full, and never loses a frequent one. A task joins texts to blocks,
splits them with array operations and combines equal grams of a block before they leave it; blocks end at
piece ends, so only a piece without any of `.,;:!?` and line ends may be longer than a block. The counts of all
first and last parts of a candidate are in the table of frequent grams, joined by hash with hot parts dealt over salts.
Products are Decimal; a candidate goes if a one-word extension covers it (any longer one that covers it
contains one that does); ranks come from salted windows, then one over what those kept.

Null texts are empty; a null language is `und`, together with that language itself. Repeated rows count
as often as they occur; ties rank by phrase. Empty tables, or none with a candidate, give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_N, MIN_COUNT, TOP, COVER = 5, 100, 2000, 100
#: Bytes of a block of texts, and of all blocks that a task holds; bits of a filter: for each entry, and at most.
BLOCK, HELD, BITS_EACH, BITS = 4 << 20, 64 << 20, 16, 1 << 27
#: Windows that rank a language before the last one.
SALTS = 256
#: Upper case to lower, piece ends to newlines, tabs to spaces.
_FOLD = bytes(0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
GRAM = "lang string, phrase string, words int, n long"


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of 64 depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


class Sieve:
    """A Bloom filter of hashes, two bits each."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @staticmethod
    def bits(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(64 * slots - 1)
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.bits(h, len(self.slots)):
            found &= (self.slots[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    @classmethod
    def of(cls, phrases: DataFrame, most: int = BITS) -> Sieve:
        """Of a table's words or pairs. At most `most` bits (16 MB) come to the driver and go to the workers."""
        n = phrases.count()
        slots = min(most, max(1 << 12, 1 << (BITS_EACH * n - 1).bit_length() if n else 0)) // 64

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own: dict[str, list[list[bytes]]] = {}
                for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    own.setdefault(lang, []).append(phrase.split(b" "))
                for lang, parts in own.items():
                    h = word_hashes(lang, [p[0] for p in parts])
                    if len(parts[0]) == 2:
                        h = pair_hashes(h, word_hashes(lang, [p[1] for p in parts]))
                    at = np.concatenate(cls.bits(h, slots))
                    yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

        rows = phrases.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        filled = np.zeros(slots, np.uint64)
        filled[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(filled)


class Block(NamedTuple):
    """Words of a block of texts: code of each, the distinct words, and whether the next one continues the piece."""

    codes: np.ndarray
    names: pa.Array
    linked: np.ndarray


def read_block(text: bytes) -> Block:
    """text: folded, texts separated by newlines."""
    raw = np.frombuffer(text, np.uint8)
    word = (raw != 0x20) & (raw != 0x0A)
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    at = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(raw[word])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(raw == 0x0A), begin)
    return Block(coded.indices.to_numpy().astype(np.int64), coded.dictionary, piece[1:] == piece[:-1])


def grams_of(lang: str, text: bytes, sizes: range, words: Sieve | None, pairs: Sieve | None) -> Iterator[pa.RecordBatch]:
    """Grams of these sizes in a block, with counts; a gram holds no word or pair that a filter lacks."""
    codes, names, linked = read_block(text)
    if words is not None and len(codes):
        h = word_hashes(lang, names.to_pylist())
        known = words.has(h)[codes]
        linked = linked & known[1:] & known[:-1]
        if pairs is not None:
            at = np.flatnonzero(linked)
            linked[at] = pairs.has(pair_hashes(h[codes[at]], h[codes[at + 1]]))
    ids, start = codes, np.arange(len(codes))  # ids: of the grams that begin at `start`
    for k in range(1, sizes.stop):
        if k > 1:
            go = start + k - 1 < len(codes)
            go[go] = linked[start[go] + k - 2]
            start, key = start[go], ids[go] * len(names) + codes[start[go] + k - 1]
            _, first, ids, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        else:
            _, first, n = np.unique(codes, return_index=True, return_counts=True)
        if k in sizes and len(n):
            parts = [names.take(pa.array(codes[start[first] + j])) for j in range(k)]
            phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, b" ")
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), phrase.cast(pa.string()), pa.array(np.full(len(n), k, np.int32)), pa.array(n)], ["lang", "phrase", "words", "n"])


def portions(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A folded text in portions of about that size that end where pieces do."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b"\n", at, at + size)
        cut = cut if cut >= 0 else text.find(b"\n", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def counted(texts: DataFrame, sizes: range, words: Sieve | None = None, pairs: Sieve | None = None) -> DataFrame:
    """(lang, phrase, words, n) of a table (lang, text), neither null."""
    sent = texts.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def block(lang: str) -> Iterator[pa.RecordBatch]:
            del size[lang]
            return grams_of(lang, b"\n".join(held.pop(lang)), sizes, *sent.value)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part in portions(text.translate(_FOLD)):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= BLOCK:
                        yield from block(lang)
            while sum(size.values()) > HELD:
                yield from block(max(size, key=size.get))
        for lang in list(held):
            yield from block(lang)

    rows = texts.mapInArrow(run, GRAM)
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def cuts(candidates: DataFrame) -> DataFrame:
    """A row for each place between words: lang, phrase, words, a, k, first and rest as keys (lang, part)."""
    parts = F.split("phrase", " ")
    rows = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), parts.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    joined = lambda x: F.struct("lang", F.array_join(x, " ").alias("phrase"))
    return rows.select("lang", "phrase", "words", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("first"), joined(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest"))


def exact(*factors: str | int) -> Column:
    """A product of whole numbers as Decimal."""
    out = F.lit(1).cast("decimal(1,0)")
    for f in factors:
        out = out * (F.lit(f).cast("decimal(4,0)") if isinstance(f, int) else F.col(f).cast("decimal(19,0)"))
    return out.cast("decimal(38,0)")


def scored(candidates: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """candidates with l, r, score of their weakest cut, and n of the language."""
    parts = known.select(F.struct("lang", "phrase").alias("part"), F.col("n").alias("f"))
    rows = common.join_hot(cuts(candidates), parts.select(F.col("part").alias("left_part"), F.col("f").alias("l")), "first", "left_part").drop("first", "left_part")
    rows = common.join_hot(rows, parts.select(F.col("part").alias("right_part"), F.col("f").alias("r")), "rest", "right_part").drop("rest", "right_part")
    rows = rows.join(common.small(totals), "lang").withColumn("over", exact(1000, "a", "total")).withColumn("under", exact("l", "r"))
    weakest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut")
    return rows.groupBy("lang", "phrase", "words", "a", "total").agg(weakest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def uncovered(rows: DataFrame, candidates: DataFrame, cover: int) -> DataFrame:
    """rows without those that a candidate of one more word covers."""
    w = F.split("phrase", " ")
    longer = candidates.filter("words > 2").select("lang", "words", "n", w.alias("w"))
    shorter = F.explode(F.array(F.slice("w", F.lit(1), F.col("words") - 1), F.slice("w", F.lit(2), F.col("words") - 1)))
    held = longer.select("lang", "n", shorter.alias("s")).groupBy("lang", F.array_join("s", " ").alias("phrase")).agg(F.max("n").alias("extended"))
    covered = rows.select("lang", "phrase", "a").join(held, ["lang", "phrase"]).filter(F.lit(100) * F.col("extended") >= F.lit(cover) * F.col("a"))
    return rows.join(covered.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def first_of(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows a language with their rank from 1."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to max_n words that occur
    min_count times or more. `cover`: percent of a phrase's occurrences that an extension has to have to cover it."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), common.text_of().alias("text"))
    frequent = F.col("n") >= min_count
    words = common.materialize(counted(texts, range(1, 2)), "words")
    totals = common.materialize(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    known = common.materialize(words.filter(frequent), "frequent-words")
    common.drop_materialized(words)
    sieve = Sieve.of(known)
    candidates = common.materialize(counted(texts, range(2, min(max_n, 2) + 1), sieve).filter(frequent), "pairs")
    if max_n > 2:
        longer = common.materialize(counted(texts, range(3, max_n + 1), sieve, Sieve.of(candidates)).filter(frequent), "longer")
        candidates = candidates.unionByName(longer)
    rows = scored(candidates, known.unionByName(candidates), totals)
    return first_of(uncovered(rows, candidates, cover), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))
