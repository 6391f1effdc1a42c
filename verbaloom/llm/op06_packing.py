"""Packing by cutting-stock column generation.

1. One pass tokenizes each document. A document that fits a sequence stays whole; a longer one is cut
   into whole sequences and a rest. The pieces go to the shared folder with their class (length in
   units of `grain` tokens, rounded up) and a rank within (class, partition).
2. The histogram of classes, at most capacity/grain numbers, is the demand of a linear program over
   patterns, which a revised simplex solves on the driver; a knapsack dynamic program prices new
   columns until the bound that they prove is within TOLERANCE.
3. Patterns are rounded down, the rest is packed largest first. The piece of rank r in its class
   finds its sequence and its place there in closed form. Offsets are sums of true lengths
   within a sequence, so what rounding up costs (half a unit a piece) is padding at the end.

Null text counts as empty: such a document holds its end id alone. Repeated rows are packed each.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
import struct
import threading
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, GRAIN, END_ID = 2048, 16, 1
#: Words whose ids a worker remembers in each of two generations, and the longest such word.
GENERATION, TABLE_CHARS = 500_000, 40
#: Documents encoded at once, and their bytes (one longer text is encoded alone).
CHUNK, CHUNK_BYTES = 2048, 8 << 20
#: Share by which a linear program's value may exceed its proven bound; simplex steps before the best
#: basis so far is taken with a warning (rounding makes any basis valid).
TOLERANCE, MAX_STEPS = 1e-4, 5000


class WordIds:
    """Ids of texts, word by word. The tokenizer lower-cases, drops white space and
    its merges stay within words, so words between spaces and newlines encode independently, and
    so does a full stop or comma that ends a word behind a letter."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib, self.memo = Tokenizer.from_file(path), common.Remembered(GENERATION)
        # for lower-case ASCII letters between spaces: the same model without steps that change nothing there
        self.letters = Tokenizer(self.lib.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.lib.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {c: struct.pack("<I", vocab[c + "</w>"]) for c in ".,"}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Words of letters alone are one pre-token each: they go to the library in one text, whose
        ids split behind the pieces that end words."""
        table, stems, plain, other, rest, out = self.memo.new, {}, [], [], [], {}
        for w in words:
            stem = w[:-1] if w[-1:] in (".", ",") and "a" <= w[-2:-1] <= "z" else w
            if stem is not w:
                stems[w] = stem
                if stem in table or stem in words:
                    continue
            (rest if not stem.isalpha() else plain if stem.isascii() and stem.islower() else other).append(stem)
        for lib, some in [(lib, ws[lo : lo + 2048]) for lib, ws in ((self.letters, plain), (self.lib, other)) for lo in range(0, len(ws), 2048)]:
            ids = np.array(lib.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):  # lower case of a letter isn't always one
                rest += some
                continue
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, (4 * cuts).tolist(), strict=True):
                out[w] = raw[begin:end]
                begin = end
        found = self.lib.encode_batch_fast(rest, add_special_tokens=False)
        out.update((w, struct.pack(f"<{len(e.ids)}I", *e.ids)) for w, e in zip(rest, found, strict=True))
        for w, stem in stems.items():
            out[w] = (out[stem] if stem in out else table[stem]) + self.marks[w[-1]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids begin (and the last end). Splitting, looking
        for distinct words and laying out ids is done on whole Arrow arrays."""
        raw = pc.fill_null(texts, "")
        low, special = pc.ascii_lower(raw), pc.match_substring(raw, "<|")
        if pc.any(special).as_py():  # special tokens are matched before lower-casing
            low = pc.if_else(special, raw, low)
        split = pc.split_pattern(pc.replace_substring(low, pattern="\n", replacement=" "), pattern=" ")
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new, table = self._learn(self.memo.missing(words)), self.memo.new
        table.update(new)
        found = [table[w] for w in words]
        for w in new:
            if len(w) > TABLE_CHARS:
                del table[w]
        ids, sizes = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        del found, words, new
        begin, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.r_[0, np.cumsum(size)]
        starts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        begin -= ends[:-1]
        wide = np.int32 if max(len(ids), int(ends[-1])) < 1 << 31 else np.int64
        place = np.repeat(begin.astype(wide), size)
        del begin, size, ends, coded, split, at
        place += np.arange(len(place), dtype=wide)
        return ids[place], starts


#: A worker's encoders; one that no task has used for so many seconds is dropped with its words, so later stages don't
#: carry them.
_ENCODERS: dict[str, WordIds] = {}
_WAITING: dict[str, threading.Timer] = {}
IDLE_SECONDS = 3.0


@contextmanager
def encoder(path: str) -> Iterator[WordIds]:
    if waiting := _WAITING.pop(path, None):
        waiting.cancel()
    found = _ENCODERS.get(path) or WordIds(path)
    _ENCODERS[path] = found
    try:
        yield found
    finally:
        timer = _WAITING[path] = threading.Timer(IDLE_SECONDS, _ENCODERS.pop, (path, None))
        timer.daemon = True
        timer.start()


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    return [(s, min(capacity, total - s)) for s in range(0, total, capacity)]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of texts that are encoded at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        held = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, held + CHUNK_BYTES, side="right"))
        hi = max(lo + 1, min(hi, lo + CHUNK))
        yield lo, hi - lo
        lo = hi


def pieces(docs: DataFrame, path: str, capacity: int, grain: int, end_id: int, keep_ids: bool) -> DataFrame:
    tail = struct.pack("<I", end_id)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank", *["ids"] * keep_ids]
    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, here = {}, TaskContext.get().partitionId()
        with encoder(path) as words:
            for batch in batches:
                for lo, n in chunks(batch.column("text")):
                    part, rows = batch.slice(lo, n), []
                    ids, at = words.encode(part.column("text"))
                    for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                        raw = memoryview(ids[at[k] : at[k + 1]].tobytes() + tail)
                        total = len(raw) // 4
                        for start, length in cut(total, capacity):
                            kind = -(-length // grain)
                            rank = ranks.get(kind, 0)
                            ranks[kind] = rank + 1
                            own = raw[4 * start : 4 * (start + length)]
                            rows.append((doc_id, start, length, zlib.crc32(own), total, kind, here, rank, *[bytes(own)] * keep_ids))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long" + ", ids binary" * keep_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of most value within capacity. lengths ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if n := fits[w]:
            gain = values[:n] + best[w - lengths[:n]]
            if gain[i := int(gain.argmax())] > best[w] + 1e-12:
                best[w], choice[w] = gain[i], i
    pattern, w = np.zeros(len(lengths)), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= lengths[choice[w]]
    return float(best[capacity]), pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (columns), fractional uses of least total with A x = demand, and a lower bound of the
    total (the dual value over the best price). The basis's inverse is kept by row operations."""
    m = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1 / np.diag(basis)) if m else np.zeros((0, 0))
    x, bound = inverse @ demand, 0.0
    for n in range(MAX_STEPS if m else 0):
        dual = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = price(dual, lengths, capacity)
        bound = max(bound, float(dual @ demand) / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + TOLERANCE):
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        if n % 200 == 199:
            inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ demand, 0)
    else:
        if m:
            logging.getLogger(__name__).warning("column generation stopped after %d steps at %.1f, bound %.1f", MAX_STEPS, x.sum(), bound)
    return basis, x, bound


def plan(counts: dict[int, int], units: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {class: copies}) whose copies hold each class's count exactly; a class is its length."""
    classes = [k for k in sorted(counts) if k != units and counts[k]]
    lengths = np.array(classes, dtype=int)
    left = np.array([counts[k] for k in classes], dtype=np.int64)
    basis, x, _ = column_generation(lengths, left.astype(float), units)
    out = [(counts[units], {units: 1})] if counts.get(units) else []
    for j in np.argsort(-x, kind="stable"):
        copies = basis[:, j].astype(np.int64)
        times = int(min([int(x[j] + 1e-6), *(left[copies > 0] // copies[copies > 0])]))
        if times > 0:
            left -= times * copies
            out.append((times, {classes[i]: int(copies[i]) for i in np.flatnonzero(copies)}))
    while left.any():  # the rounded rest, largest first
        room, copies = units, {}
        for i in np.argsort(-lengths):
            if n := min(int(left[i]), room // int(lengths[i])):
                copies[i] = n
                room -= n * int(lengths[i])
        idx, n = np.array(list(copies)), np.array(list(copies.values()))
        times = int((left[idx] // n).min())
        left[idx] -= times * n
        out.append((times, {classes[i]: k for i, k in copies.items()}))
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By class: pieces placed by earlier patterns, first sequence, copies a sequence, place of the
    first copy."""
    out: dict[int, list] = {}
    first = 0
    for times, copies in patterns:
        place = 0
        for k in sorted(copies, reverse=True):
            out.setdefault(k, []).append((times * copies[k], first, copies[k], place))
            place += copies[k]
        first += times
    return {k: (np.cumsum([0, *(r[0] for r in rows)])[:-1], *(np.array([r[i] for r in rows]) for i in (1, 2, 3))) for k, rows in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece with its sequence and offset; keep_ids adds the piece's ids as bytes."""
    with common.rows_a_batch(docs.sparkSession, CHUNK):
        cuts = common.materialize(pieces(docs, path, capacity, grain, end_id, keep_ids), "pieces")
    sizes = common.materialize(cuts.groupBy("class", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    place = slots(plan(counts, capacity // grain))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("class").alias("k"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cuts.join(starts, (F.col("class") == F.col("k")) & (F.col("part") == F.col("p"))).drop("k", "p")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = (batch["rank"] + batch["base"]).to_numpy()
            sequence, slot = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            kinds = batch["class"].to_numpy()
            for k in np.unique(kinds):
                at = np.flatnonzero(kinds == k)
                done, first, copies, begin = place[int(k)]
                j = np.searchsorted(done, rank[at], side="right") - 1
                r = rank[at] - done[j]
                sequence[at] = first[j] + r // copies[j]
                slot[at] = begin[j] + r % copies[j]
            yield pd.DataFrame({"sequence_id": sequence, "slot": slot})

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a sequence: capacity / grain pieces at most
    placed = common.beside(ranked, kept, ["class", "rank", "base"], run, "sequence_id long, slot int")
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")


def op6_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
