"""Training of byte-pair encoding over word tables of any size, in rounds.

A round takes the first pairs in training's order, as many as a task can hold the places of. Words are cut wherever
another pair stands: no merge spans such a place before the last of these pairs has its turn, since a pair of longer
symbols occurs at most as often as the two symbols that meet in it. Equal segments of all words become one row with
their summed count, and these few rows train in one task a language until a pair behind the last one would be next.
Then the words take the round's merges, all at once and in place. A merge whose token is known already ends its round,
so within one every token is made in one way only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.operators.bpe_kernel import Symbols, apply_symbols, groups, numbered, sums, train_symbols
from verbaloom.storage import drop_materialized, materialize

#: Pairs that a round looks at, symbols of segments that a task trains on, symbols of words that a task takes at once.
PAIRS, SEGMENT_SYMBOLS, CHUNK = 1 << 16, 16_000_000, 2_000_000
#: Listed pairs for a merge that is wanted, and besides: a round takes about half a merge a pair.
SPARE, FEWEST = 8, 32
#: Of segments, one of so many is looked at (by hash) to foresee their number; with more symbols, in a quarter of the words.
PART, WHOLE_SYMBOLS = 64, 4_000_000
WORDS = "lang string, syms binary, n long"
#: Words, and in rows without syms how often a pair (key) stands among them; SYMBOLS: how many symbols there are.
STATE, SYMBOLS = f"{WORDS}, key long", -1


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of int32 ids as binary."""
    offsets = np.r_[0, np.cumsum(4 * sizes)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(np.int32))])


def _ids(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and how many each has."""
    held = rows.combine_chunks()
    if not len(held):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    flat = np.frombuffer(held.buffers()[2] or b"", np.int32)
    return flat[ends[0] // 4 : ends[-1] // 4], np.diff(ends).astype(np.int64) // 4


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Symbols]]:
    """Words of one language, some CHUNK symbols at once."""

    def of(held: list[pa.RecordBatch]) -> Iterator[tuple[str, Symbols]]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            yield lang, Symbols(*_ids(own.column("syms")), own.column("n").to_numpy())

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes // 4
        if size > CHUNK:
            yield from of(held)
            held, size = [], 0
    if size:
        yield from of(held)


def _langs(lang: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(lang, pa.string()), n)


def _with_totals(lang: str, words: Symbols) -> Iterator[pa.RecordBatch]:
    """Rows of STATE, so that a round's words are read once for both."""
    counts = words.weight[np.cumsum(words.sizes) - 1].astype(np.int64)
    yield pa.RecordBatch.from_arrays([_langs(lang, len(counts)), _binary(words.sym, words.sizes), pa.array(counts), pa.nulls(len(counts), pa.int64())], ["lang", "syms", "n", "key"])
    at = words.linked()
    order, keys, begin = groups(words.pairs(at))
    keys, n = np.r_[keys, SYMBOLS], np.r_[sums(words.weight[at[order]], begin), len(words.sym)]
    yield pa.RecordBatch.from_arrays([_langs(lang, len(keys)), pa.nulls(len(keys), pa.binary()), pa.array(n), pa.array(keys)], ["lang", "syms", "n", "key"])


def _numbered(freq: DataFrame, letters: dict[str, list[str]]) -> DataFrame:
    """Words of more than one character as ids, with their pairs."""
    sent = freq.sparkSession.sparkContext.broadcast(letters)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                flat, sizes = numbered(own.column("piece").to_pylist(), sent.value[lang])
                yield pa.RecordBatch.from_arrays([own.column("lang"), _binary(flat, sizes), own.column("n")], ["lang", "syms", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _chunks(ids(batches)):
            yield from _with_totals(lang, words)

    return freq.filter(F.char_length("piece") > 1).select("lang", "piece", "n").mapInArrow(run, STATE)


def _words(state: DataFrame, langs: set[str]) -> DataFrame:
    return state.filter(F.col("syms").isNotNull() & F.col("lang").isin(sorted(langs))).select("lang", "syms", "n")


def _totals(state: DataFrame) -> DataFrame:
    """lang, key, n: how often pairs of symbols stand side by side, and SYMBOLS."""
    return state.filter(F.col("key").isNotNull()).groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _ranks(words: Symbols, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each symbol, the rank of the pair that starts there; that of no pair at a word's end or for other pairs.
    known: keys of listed pairs, ascending; rank: theirs."""
    out = np.full(len(words.sym), len(known), np.int32)
    at = words.linked()
    if len(known) and len(at):
        order, keys, begin = groups(words.pairs(at))  # few distinct ones are looked up
        near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        of = np.where(known[near] == keys, rank[near], len(known)).astype(np.int32)
        out[at[order]] = np.repeat(of, np.diff(np.r_[begin, len(at)]))
    return out


def _cuts(ranks: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of segments of two or more symbols that only the `first` listed pairs hold together."""
    ends = np.flatnonzero(ranks >= first) + 1
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    more = ends - begins > 1
    return begins[more], ends[more]


def _steps(pairs: int) -> list[int]:
    """How many pairs a round may take, the last one all: powers of two, and from 64 on also what lies between."""
    return [*sorted({x for k in range(_levels(pairs)) for x in (1 << k, 3 << k if k > 4 else 1) if x < pairs}), pairs]


def _foreseen(words: DataFrame, sent, many: set[str]) -> DataFrame:
    """lang, level, size: about how many symbols distinct segments have where that step's pairs are taken, from a part of
    the segments; of languages with many symbols, those of a quarter of the words, carried on by what the second eighth
    adds to the first (which is the more, the fewer words there are, so it says too much rather than too little)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _chunks(batches):
            known, rank = sent.value[lang]
            ranks = _ranks(words, known, rank)
            with np.errstate(over="ignore"):
                # sums of mixed symbols times powers of an odd number: a segment's difference over its first power
                base, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
                power = np.cumprod(np.full(len(ranks), base, np.uint64))
                inverse = np.cumprod(np.full(len(ranks), back, np.uint64))
                sums = np.r_[np.uint64(0), np.cumsum((words.sym.astype(np.uint64) + np.uint64(1)) * power)]
                for level, first in enumerate(_steps(len(known))):
                    begins, ends = _cuts(ranks, first)
                    marks = (sums[ends] - sums[begins]) * inverse[begins] if len(begins) else np.zeros(0, np.uint64)
                    marks = (marks ^ (marks >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    taken = (marks >> np.uint64(40)) % np.uint64(PART) == 0
                    marks, sizes, eighth = marks[taken], (ends - begins)[taken], words.weight[begins[taken]]
                    order = np.lexsort((eighth, marks))
                    order = order[np.r_[True, marks[order[1:]] != marks[order[:-1]]]] if len(order) else order
                    if len(order):
                        yield pa.RecordBatch.from_arrays([_langs(lang, len(order)), pa.array(np.full(len(order), level, np.int32)), pa.array(marks[order].view(np.int64)), pa.array(sizes[order].astype(np.int64)), pa.array(eighth[order].astype(np.int64))], ["lang", "level", "mark", "size", "eighth"])

    eighth = F.when(F.col("lang").isin(sorted(many)), F.pmod(F.xxhash64("syms"), F.lit(8))).otherwise(F.lit(0)).cast("long")
    marks = words.select("lang", "syms", eighth.alias("n")).filter("n < 2").mapInArrow(run, "lang string, level int, mark long, size long, eighth long")
    once = marks.groupBy("lang", "level", "mark").agg(F.max("size").alias("size"), F.min("eighth").alias("eighth"))
    found = once.groupBy("lang", "level").agg(F.sum("size").alias("both"), F.sum(F.when(F.col("eighth") == 0, F.col("size"))).alias("one"))
    growth = F.least(F.coalesce(F.col("both") / F.col("one"), F.lit(2.0)), F.lit(2.0))
    return found.select("lang", "level", (PART * F.col("both") * growth * growth).cast("long").alias("size"))


def _levels(pairs: int) -> int:
    return max(pairs - 1, 0).bit_length()


def _segments(words: DataFrame, sent, first: dict[str, int]) -> DataFrame:
    """lang, syms, n: distinct segments with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _chunks(batches):
            known, rank = sent.value[lang]
            begins, ends = _cuts(_ranks(words, known, rank), first[lang])
            sizes, counts = ends - begins, words.weight[begins].astype(np.int64)
            flat = words.sym[np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())] if len(begins) else begins
            yield pa.RecordBatch.from_arrays([_langs(lang, len(begins)), _binary(flat, sizes), pa.array(counts)], ["lang", "syms", "n"])

    return words.mapInArrow(run, WORDS).groupBy("lang", "syms").agg(F.sum("n").alias("n"))


def _trained(segments: DataFrame, names: dict[str, list[str]], wanted: dict[str, int], last: dict[str, tuple[int, int] | None]) -> dict[str, list[tuple[str, str]]]:
    sent = segments.sparkSession.sparkContext.broadcast((names, wanted, last))

    langs = sorted(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows, (names, wanted, last) = pa.Table.from_batches(held), sent.value
        lang = rows.column("lang")[0].as_py()
        state = Symbols(*_ids(rows.column("syms")), rows.column("n").to_numpy())
        del rows, held
        found = train_symbols(state, list(names[lang]), wanted[lang], last[lang])
        left, right = ([p[i] for p in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([_langs(lang, len(found)), pa.array(range(len(found)), pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["lang", "rank", "left", "right"])

    # a task a language: by hash two could meet in one
    own = segments.repartitionById(len(langs), (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int"))
    merges = own.mapInArrow(run, "lang string, rank int, left string, right string")
    out: dict[str, list[tuple[str, str]]] = {k: [] for k in names}
    for r in sorted(merges.collect(), key=lambda r: r["rank"]):
        out[r["lang"]].append((r["left"], r["right"]))
    return out


def _merged(words: DataFrame, merges: dict[str, list[tuple[int, int, int]]]) -> DataFrame:
    """Words after a round's merges, with their pairs; words that are one symbol by now leave."""
    sent = words.sparkSession.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _chunks(batches):
            counts = words.weight[np.cumsum(words.sizes) - 1].astype(np.int64)
            flat, sizes = apply_symbols(words, sent.value[lang])
            keep = sizes > 1
            yield from _with_totals(lang, Symbols(flat[np.repeat(keep, sizes)], sizes[keep], counts[keep]))

    return words.mapInArrow(run, STATE)


def train_rounds(freq: DataFrame, letters: dict[str, list[str]], wanted: dict[str, int], report: list[dict] | None = None) -> dict[str, list[tuple[str, str]]]:
    """Merges of each language of freq (lang, piece, n); letters: its sorted alphabet; wanted: their number at most.
    report: gets a row a language and round."""
    spark = freq.sparkSession
    names, out = {k: list(v) for k, v in letters.items()}, {k: [] for k in letters}
    ids = {k: {c: i for i, c in enumerate(v)} for k, v in names.items()}
    open_ = {k for k in letters if wanted[k] > 0}
    state = materialize(_numbered(freq.filter(F.col("lang").isin(sorted(open_))), letters), "bpe-words")
    order = Window.partitionBy("lang").orderBy(F.col("key") != SYMBOLS, F.desc("n"), "key")
    while open_:
        most = {k: min(PAIRS, 1 << _levels(SPARE * (wanted[k] - len(out[k])) + FEWEST)) for k in open_}
        found = _totals(state).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max(most.values()) + 2).toArrow().sort_by([("lang", "ascending"), ("at", "ascending")])
        listed: dict[str, list[tuple[int, int]]] = {}
        symbols: dict[str, int] = {}
        for k in open_:
            own = found.filter(pc.equal(found.column("lang"), k))
            symbols[k] = own.column("n")[0].as_py() if len(own) else 0
            own = own.slice(1, most[k] + 1)
            listed[k] = list(zip((-own.column("n").to_numpy()).tolist(), own.column("key").to_pylist(), strict=True))
        open_ = {k for k in open_ if listed[k]}
        if not open_:
            break
        tables = {}
        for k in open_:
            keys = np.array([key for _, key in listed[k][: most[k]]], np.int64)
            by_key = np.argsort(keys)
            tables[k] = (keys[by_key], by_key)
        sent = spark.sparkContext.broadcast(tables)
        words, over = _words(state, open_), {k for k in open_ if symbols[k] > SEGMENT_SYMBOLS}
        sizes = {(r["lang"], r["level"]): r["size"] for r in _foreseen(_words(state, over), sent, {k for k in over if symbols[k] > WHOLE_SYMBOLS}).collect()} if over else {}
        first, last, level = {}, {}, {}
        for k in open_:
            steps = _steps(len(tables[k][0]))
            level[k] = max(x for x in range(len(steps)) if x == 0 or sizes.get((k, x), 0) <= SEGMENT_SYMBOLS)
            first[k] = steps[level[k]]
            last[k] = None if first[k] == len(listed[k]) else listed[k][first[k] - 1]
        found = _trained(_segments(words, sent, first), {k: names[k] for k in open_}, {k: wanted[k] - len(out[k]) for k in open_}, last)
        fresh: dict[str, list[tuple[int, int, int]]] = {}
        for k in sorted(open_):
            steps = []
            for a, b in found[k]:
                new = ids[k].setdefault(a + b, len(names[k]))
                if new == len(names[k]):
                    names[k].append(a + b)
                steps.append((ids[k][a], ids[k][b], new))
            out[k] += found[k]
            if report is not None:
                report.append({"lang": k, "merges": len(steps), "pairs": first[k], "foreseen": sizes.get((k, level[k]), symbols[k])})
            if last[k] is not None and len(out[k]) < wanted[k]:
                fresh[k] = steps
        open_ = set(fresh)
        if open_:
            old, state = state, materialize(_merged(_words(state, open_), fresh), "bpe-words")
            drop_materialized(old)
    drop_materialized(state)
    return out
