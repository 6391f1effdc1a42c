"""Byte-pair encoding over characters: word tables, training, interleaving, encoding.

The only shuffle of a corpus is the word table. A language whose table has at most `kernel_words`
rows trains in one task by an incremental kernel on arrays; larger ones train in rounds (`bpe_rounds`), or one by one
over an index from pairs to words: a batch of merges that can't influence each other touches the words that hold its
pairs. All give the same merges: the best pair has the largest count, then the smaller left id, then the
smaller right id; ids number the specials, the sorted alphabet, then merges in order.
Texts are encoded in place: a worker remembers the pieces that it has met, within a bound.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.functions import pieces as P
from verbaloom.functions.text import MARK
from verbaloom.memo import Remembered
from verbaloom.operators.bpe_kernel import train_kernel
from verbaloom.operators.bpe_rounds import train_rounds
from verbaloom.storage import drop_materialized, folders, materialize, stored_bytes

KERNEL_WORDS = 400_000
#: Pairs that a distributed step brings to the driver, the pieces a worker remembers (a generation), and
#: pieces that it encodes at once.
TOP_PAIRS, GENERATION, ROWS = 1000, 200_000, 200_000
#: Tables of an index of pairs that are merged into one.
COMPACT = 24
#: Pieces of a text: a column of lists, or what cuts `text` in Arrow.
Cut = Callable[[pa.Array], pa.Array]
Pieces = Column | Cut
MERGES_SCHEMA = "lang string, rank int, left string, right string, token string"


def word_freq(docs: DataFrame, pieces: Column, *by: str) -> DataFrame:
    return docs.select(*by, F.explode(pieces).alias("piece")).groupBy(*by, "piece").agg(F.count("*").alias("n"))


def counted(docs: DataFrame, cut: Cut, clean: Cut = lambda values: values, letters: Cut | None = None) -> DataFrame:
    """(lang, piece, n) of docs (lang, text): counts of a portion of texts, so a piece comes once a portion and language.
    cut: a list of pieces for each text; clean: works on the distinct ones. Empty pieces don't count.
    letters: what a text's characters are taken from; each of them comes too, with n = 0 (see `words_and_letters`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in P.portions(batch):
                for lang, texts in P.of_each(part.column(0), part.column(1)):
                    found = cut(texts).flatten().value_counts()
                    found = found.filter(pc.not_equal(found.field("values"), ""))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), clean(found.field("values")), found.field("counts")], ["lang", "piece", "n"])
                    if letters:
                        chars = P.characters(letters(texts))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(chars), pa.string()), pa.array(chars, pa.string()), pa.array(np.zeros(len(chars), np.int64))], ["lang", "piece", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, piece string, n long")


def places(docs: DataFrame, cut: Cut, clean: Cut = lambda values: values) -> DataFrame:
    """(lang, doc_id, pos, token): every piece in its place, cut in Arrow. Empty pieces have no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in P.portions(batch):
                lists = cut(part.column(2))
                row, tokens = pc.list_parent_indices(lists), lists.flatten().dictionary_encode()
                full = pc.not_equal(tokens.dictionary, "").take(tokens.indices)
                row, tokens = row.filter(full), clean(tokens.dictionary).take(tokens.indices.filter(full))
                # ids and languages ride along: a null among ids leaves the others as they are
                at = row.to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
                pos = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(pos.astype(np.int32)), tokens], ["lang", "doc_id", "pos", "token"])

    return docs.select("lang", "doc_id", "text").mapInArrow(run, "lang string, doc_id long, pos int, token string")


def word_table(docs: DataFrame, cut: Cut, clean: Cut = lambda values: values, letters: Cut | None = None) -> DataFrame:
    """word_freq by lang, counted in Arrow before the shuffle; pieces of a portion are distinct, so only behind it there
    is something to add."""
    return counted(docs, cut, clean, letters).repartition("lang", "piece").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def words_and_letters(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A word table with letters as (lang, piece, n) and (lang, ch)."""
    return table.filter("n > 0"), table.filter(F.char_length("piece") == 1).select("lang", F.col("piece").alias("ch"))


def weighted(freq: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts times the language's weight: the same as repeating its texts."""
    return freq.join(F.broadcast(weights.select("lang", "weight")), "lang").groupBy("piece").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))


def symbols(piece: str = "piece") -> Column:
    return F.filter(F.split(piece, ""), lambda c: c != "")


def pair_counts(freq: DataFrame, syms: Column, *by: str) -> DataFrame:
    pairs = F.when(F.size("s") > 1, F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("left"), F.get("s", i + 1).alias("right"))))
    rows = freq.select(*by, "n", syms.alias("s")).select(*by, "n", F.explode(pairs).alias("p"))
    return rows.groupBy(*by, "p.left", "p.right").agg(F.sum("n").alias("n"))


def batch_of(rows: list[tuple[str, str, int]], floor: int, room: int) -> list[tuple[str, str]]:
    """The first merges of rows (left, right, n; best first) that are next whatever the others of the batch
    do: they share no symbol, and no pair that a merge creates can reach their count. Pairs that aren't listed
    come after all of rows and have at most `floor`."""
    taken, used, bound = [], set(), 0
    for k, (a, b, n) in enumerate(rows[: max(room, 0)]):
        if k and (n <= bound or {a, b, a + b} & used):
            break
        taken.append((a, b))
        used |= {a, b, a + b}
        # (x, ab) occurs no more often than (x, a), and no more often than (a, b)
        beside = max([m for x, y, m in rows if y == a or x == b], default=0)
        bound = max(bound, min(n, max(beside, floor)))
    return taken


PAIR = "left string, right string"


class PairIndex:
    """Where pairs stand, for word tables of any size: rows (left, right, piece, n, change), written once sorted by
    pair, then a small table a batch with the pairs that its merges made and lost. What a piece has become follows
    from its merges (`replay`), so no word table is rewritten, and a row whose pair is gone changes nothing."""

    SCHEMA = f"{PAIR}, piece string, n long, change long"

    def __init__(self, freq: DataFrame):
        self.spark = freq.sparkSession
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("left"), F.get("s", i + 1).alias("right"))))
        words = freq.select("piece", "n", symbols().alias("s")).filter(F.size("s") > 1)
        rows = words.select(F.explode(pairs).alias("p"), "piece", "n").select("p.left", "p.right", "piece", "n", F.col("n").alias("change"))
        self.tables = [materialize(rows.repartitionByRange("left", "right").sortWithinPartitions("left", "right"), "bpe-pairs")]
        self.totals, self.open = materialize(pair_counts(freq, symbols()), "bpe-totals"), []
        self.compacted: list[DataFrame] = []
        self.at: dict[int, list[str]] = {}  # folders of tables that are held

    def rows(self, tables: list[DataFrame]) -> DataFrame:
        """One scan of these tables."""
        for t in tables:
            if id(t) not in self.at:
                self.at[id(t)] = folders(t)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f for t in tables for f in self.at[id(t)]])

    def fold(self) -> None:
        """Bring totals up to date."""
        if self.open:
            change = self.rows(self.open).select("left", "right", F.col("change").alias("n"))
            new = self.totals.unionByName(change).groupBy("left", "right").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
            old, self.totals, self.open = self.totals, materialize(new, "bpe-totals"), []
            drop_materialized(old)

    def best(self, ids: dict[str, int], top: int) -> list[tuple[str, str, int]]:
        """The first `top` pairs in training's order: count, then ids."""
        self.fold()
        known = F.broadcast(self.spark.createDataFrame(list(ids.items()), "symbol string, id long"))  # at most the vocabulary
        ranked = self.totals
        for side in ("left", "right"):
            ranked = ranked.join(known.select(F.col("symbol").alias(side), F.col("id").alias(f"{side}_id")), side)
        return [(r["left"], r["right"], r["n"]) for r in ranked.orderBy(F.desc("n"), "left_id", "right_id").limit(top).collect()]

    def merge(self, merges: list[tuple[str, str]], new: int) -> DataFrame:
        """Apply the last `new` of all merges to the pieces that hold their pairs; the table of what changes."""
        earlier, ranks = {}, {}
        for rank, p in enumerate(merges):
            ranks.setdefault(p, []).append(rank)
            if rank < len(merges) - new:
                earlier.setdefault(p, []).append(rank)
        sent = self.spark.sparkContext.broadcast((earlier, ranks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            earlier, ranks = sent.value
            for batch in batches:
                out = []
                for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    before, behind = replay(piece, earlier), replay(piece, ranks)
                    if len(before) != len(behind):
                        change = Counter(zip(behind, behind[1:], strict=False))
                        change.subtract(zip(before, before[1:], strict=False))
                        out += [(a, b, piece, n, c * n) for (a, b), c in change.items() if c]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHANGE, strict=True)], ["left", "right", "piece", "n", "change"])

        batch = merges[-new:]
        near = F.col("left").isin([a for a, _ in batch]) & F.col("right").isin([b for _, b in batch])  # for the scan
        hits = self.rows(self.tables).filter(near & (F.col("change") > 0)).join(F.broadcast(self.spark.createDataFrame(batch, PAIR)), ["left", "right"], "left_semi")
        change = materialize(hits.select("piece", "n").distinct().mapInArrow(run, self.SCHEMA), "bpe-change")
        self.open.append(change)
        self.tables.append(change)
        if len(self.tables) > COMPACT:
            self.compact()
        return change

    def compact(self) -> None:
        """The batches' rows as one table; a pair that a piece gains again stays one row."""
        self.fold()
        first, *rest = self.tables
        gained = self.rows(rest).filter("change > 0").groupBy("left", "right", "piece").agg(F.max("n").alias("n")).withColumn("change", F.col("n"))
        self.tables = [first, materialize(gained.repartitionByRange("left", "right").sortWithinPartitions("left", "right"), "bpe-pairs")]
        self.compacted = rest

    def drop_compacted(self) -> None:
        """Delete the batches' tables that are part of a larger one (once the last change has been read)."""
        for t in self.compacted:
            self.at.pop(id(t), None)
            drop_materialized(t)
        self.compacted = []

    def close(self) -> None:
        for t in (*self.tables, self.totals):
            drop_materialized(t)


_CHANGE = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())


def train_distributed(freq: DataFrame, alphabet: list[str], merges: int, top: int = TOP_PAIRS, report: list[dict] | None = None) -> list[tuple[str, str]]:
    """The same merges for word tables of any size. The driver holds the best `top` pairs with exact counts;
    a batch touches the words that hold its pairs and brings back what it changes in that list. Once the
    list is used up, the next best ones are taken from all pairs. report: gets a row a batch."""
    index, ids, out = PairIndex(freq), {c: i for i, c in enumerate(alphabet)}, []
    listed: dict[tuple[str, str], int] = {}
    last, full = None, False  # the last listed pair's place in the order; whether that list holds every pair

    def place(pair: tuple[str, str], n: int) -> tuple[int, int, int]:
        return -n, ids[pair[0]], ids[pair[1]]

    while len(out) < merges:
        # pairs that have fallen behind the last listed one may come after some that aren't listed
        listed = {p: n for p, n in listed.items() if n > 0 and (full or place(p, n) <= last)}
        if not listed:
            if full:
                break
            rows = index.best(ids, top)
            if not rows:
                break
            listed, full = {(a, b): n for a, b, n in rows}, len(rows) < top
            last = place(rows[-1][:2], rows[-1][2])
        order = sorted(((a, b, n) for (a, b), n in listed.items()), key=lambda r: place(r[:2], r[2]))
        pairs = batch_of(order, 0 if full else -last[0], merges - len(out))
        twice = [a + b for a, b in pairs if a + b in ids]
        for a, b in pairs:
            ids.setdefault(a + b, len(ids))
        out += pairs
        change = index.merge(out, len(pairs))
        held = F.broadcast(freq.sparkSession.createDataFrame([(*p, True) for p in listed], f"{PAIR}, listed boolean"))
        sums = change.groupBy("left", "right").agg(F.sum("change").alias("n")).join(held, ["left", "right"], "left")
        known = sums.filter(F.col("listed") | (F.col("n") >= (0 if full else -last[0])))
        rows = known.orderBy(F.desc("n")).limit(2 * top + 1).collect()
        if report is not None:
            report.append({"merges": len(pairs), "bytes": stored_bytes(change)})
        if twice or len(rows) > 2 * top:
            listed, full = {}, False  # counts of pairs with a symbol made before aren't known from the change alone
        else:
            for a, b, n, _ in rows:
                if (a, b) in listed or n > 0:
                    listed[a, b] = listed.get((a, b), 0) + n
        index.drop_compacted()
    index.close()
    return out


def train(freq: DataFrame, merges: int | dict[str, int], kernel_words: int = KERNEL_WORDS, chars: DataFrame | None = None) -> DataFrame:
    """(lang, rank, left, right, token) for each lang of a word table (lang, piece, n); merges: their number, or
    one for each lang. chars (lang, ch): where known, characters of each lang, its words' among them."""
    spark = freq.sparkSession
    sizes = {r["lang"]: r["n"] for r in freq.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    large = [k for k, n in sizes.items() if n > kernel_words and k is not None]
    limit = lambda lang: max(0, merges.get(lang, 0) if isinstance(merges, dict) else merges)

    def run(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        words = rows["piece"].tolist()
        found = train_kernel(words, rows["n"].tolist(), sorted(set("".join(words))), limit(key[0]))
        return pd.DataFrame([(key[0], i, a, b, a + b) for i, (a, b) in enumerate(found)], columns=["lang", "rank", "left", "right", "token"])

    out = freq.filter(~F.coalesce(F.col("lang").isin(large), F.lit(False))).groupBy("lang").applyInPandas(run, MERGES_SCHEMA)
    if large:
        own = freq.filter(F.col("lang").isin(large))
        letters: dict[str, list[str]] = {k: [] for k in large}
        known = alphabet(own.select("lang", F.col("piece").alias("text")), "lang") if chars is None else chars.filter(F.col("lang").isin(large))
        for r in known.collect():
            letters[r["lang"]].append(r["ch"])
        found = train_rounds(own, {k: sorted(v) for k, v in letters.items()}, {k: limit(k) for k in large})
        rows = [(k, i, a, b, a + b) for k in large for i, (a, b) in enumerate(found[k])]
        made = spark.createDataFrame(rows, MERGES_SCHEMA)
        out = made if len(large) == len(sizes) else out.unionByName(made)
    return out


def alphabet(docs: DataFrame, *by: str, clean: Cut = lambda texts: texts) -> DataFrame:
    """Distinct characters, spaces too; distinct within a portion of texts before the shuffle. by: one column or none;
    clean: works on the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in P.portions(batch):
                texts = clean(part.column(part.num_columns - 1))
                for key, own in P.of_each(part.column(0), texts) if by else [(None, texts)]:
                    chars = P.characters(own)
                    yield pa.RecordBatch.from_arrays([*([pa.array([key] * len(chars), pa.string())] if by else []), pa.array(chars, pa.string())], [*by, "ch"])

    return docs.select(*by, "text").mapInArrow(run, "".join(f"{b} string, " for b in by) + "ch string").distinct()


def vocab(letters: DataFrame, merges: DataFrame, special: str) -> DataFrame:
    """(lang, id, token): the special, the sorted alphabet, merges by rank (a token once)."""
    rows = letters.select("lang", F.lit(1).alias("kind"), F.lit(0).alias("rank"), F.col("ch").alias("token"))
    rows = rows.unionByName(merges.select("lang", F.lit(2).alias("kind"), "rank", "token"))
    rows = rows.unionByName(letters.select("lang").distinct().select("lang", F.lit(0).alias("kind"), F.lit(0).alias("rank"), F.lit(special).alias("token")))
    once = rows.groupBy("lang", "token").agg(F.min(F.struct("kind", "rank")).alias("o"))
    order = Window.partitionBy("lang").orderBy("o.kind", "o.rank", "token")
    return once.select("lang", (F.row_number().over(order) - 1).alias("id"), "token")


def apply_merges(s: list[str], rank_of: Callable[[tuple[str, str], int], int | None]) -> list[str]:
    """Symbols after merges: always the pair of lowest rank, all of its places from the left. Places wait in an agenda
    and symbols are linked to their neighbours, so a merge costs the logarithm of the length.
    rank_of(pair, now): the rank of a pair that stands there once merges up to `now` are through; None: never."""
    after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
    agenda = [(r, i) for i in range(len(s) - 1) if (r := rank_of((s[i], s[i + 1]), -1)) is not None]
    heapq.heapify(agenda)
    while agenda:
        now, first = agenda[0]
        pair, made = None, []
        while agenda and agenda[0][0] == now:
            i = heapq.heappop(agenda)[1]
            j = after[i]
            # what waits may have been merged into others meanwhile
            if j >= len(s) or s[i] == "" or rank_of((s[i], s[j]), now - 1) != now or (pair and pair != (s[i], s[j])):
                continue
            pair = (s[i], s[j])
            s[i], s[j] = s[i] + s[j], ""
            after[i] = after[j]
            if after[i] < len(s):
                before[after[i]] = i
            made.append(i)
        for i in made:
            for k in {before[i], i} if before[i] >= 0 else {i}:
                if s[k] and after[k] < len(s) and (r := rank_of((s[k], s[after[k]]), now)) is not None:
                    heapq.heappush(agenda, (r, k))
    return [x for x in s if x]


def encode_piece(piece: str, ranks: dict[tuple[str, str], int], letters: set[str] | None, unknown: str) -> list[str]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    return apply_merges([c if letters is None or c in letters else unknown for c in piece], lambda pair, now: ranks.get(pair))


def replay(piece: str, ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """Symbols of a piece after training's merges, each applied once in its turn: a pair that arises again later
    waits for its next rank. ranks: ascending, by pair."""

    def rank_of(pair: tuple[str, str], now: int) -> int | None:
        own = ranks.get(pair)
        if own is None:
            return None
        k = bisect_right(own, now)
        return own[k] if k < len(own) else None

    return apply_merges(list(piece), rank_of)


class Encoder:
    """What pieces become by language, remembered; lang "*" serves all. of: makes what is remembered of a piece's tokens."""

    def __init__(self, merges: dict[str, list[tuple[str, str]]], letters: dict[str, set[str]] | None, unknown: str, of: Callable[[list[str]], object] = lambda tokens: tokens):
        self.ranks = {k: {tuple(p): i for i, p in reversed(list(enumerate(m)))} for k, m in merges.items()}
        self.letters, self.unknown, self.of = letters, unknown, of
        keys = {*self.ranks, "*"}
        self.memo = {k: Remembered(max(1, GENERATION // len(keys))) for k in keys}  # one bound for all languages

    def key(self, lang: str) -> str:
        return lang if lang in self.ranks else "*"

    def one(self, lang: str, piece: str) -> object:
        """Of a piece that doesn't come again."""
        key = self.key(lang)
        letters = None if self.letters is None else self.letters.get(key, set())
        return self.of(encode_piece(piece, self.ranks.get(key, {}), letters, self.unknown))

    def __call__(self, lang: str, pieces: list[str]) -> list:
        memo = self.memo[self.key(lang)]
        new = memo.missing(pieces)
        found = memo.new
        found.update((p, self.one(lang, p)) for p in new)
        out = [found[p] for p in pieces]
        for p in new:
            if len(p) > 64:
                del found[p]
        return out


def _sent(spark, merges, letters, unknown):
    """The encoder's tables, at most a vocabulary a language, once to each worker."""
    return spark.sparkContext.broadcast((merges, letters, unknown))


def _source(pieces: Pieces) -> tuple[Column, Cut | None]:
    """What a task reads, and how it cuts that."""
    return (F.col("text"), pieces) if callable(pieces) else (pieces, None)


def _listed(batches: Iterator[pa.RecordBatch], cut: Cut | None) -> Iterator[pa.RecordBatch]:
    """Rows whose last column has become lists of pieces."""
    for batch in batches:
        last = batch.num_columns - 1
        for part in P.portions(batch) if cut else [batch]:
            yield part.set_column(last, "pieces", cut(part.column(last))) if cut else part


def _portions(batches: Iterator[pa.RecordBatch], key: Callable[[str], str], cut: Cut | None = None) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, pa.Array]]:
    """Rows (..., lang, pieces) of one language's encoder, about ROWS pieces at once: a language of them, the rows, their
    numbers of pieces, all pieces."""
    for batch in _listed(batches, cut):
        langs = batch.column(batch.num_columns - 2)
        every = pc.unique(langs).to_pylist()
        for k in dict.fromkeys(map(key, every)):
            own = [x for x in every if key(x) == k]
            rows = batch if len(own) == len(every) else batch.filter(pc.is_in(langs, pa.array(own, pa.string())))
            numbers = pc.fill_null(pc.list_value_length(rows.column(rows.num_columns - 1)), 0).to_numpy().astype(np.int64)
            portion = (np.cumsum(numbers) - numbers) // ROWS
            cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = rows.slice(lo, hi - lo)
                yield own[0], part, numbers[lo:hi], part.column(part.num_columns - 1).flatten()


def tokens_of(encode: Encoder, lang: str, pieces: pa.Array) -> pa.ListArray:
    """Tokens of each piece; distinct pieces are encoded, the rest is taken from these in Arrow."""
    coded = pieces.dictionary_encode()
    return pa.array(encode(lang, coded.dictionary.to_pylist()), pa.list_(pa.string())).take(coded.indices)


def encoded_rows(encode: Encoder, batches: Iterator[pa.RecordBatch], cut: Cut | None = None) -> Iterator[pa.RecordBatch]:
    """doc_id, lang, at, tokens of rows (doc_id, lang, pieces)."""
    for lang, part, numbers, flat in _portions(batches, encode.key, cut):
        # ids and languages ride along: a null among ids leaves the others as they are
        row = pa.array(np.repeat(np.arange(len(numbers)), numbers))
        at = np.arange(len(flat)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(at.astype(np.int32)), tokens_of(encode, lang, flat)], ["doc_id", "lang", "at", "tokens"])


def encode_texts(docs: DataFrame, pieces: Pieces, merges: dict[str, list[tuple[str, str]]], letters: dict[str, set[str]] | None = None, unknown: str = "<unk>") -> DataFrame:
    """doc_id, lang, at, tokens: every piece of every text in its place, without a join or shuffle."""
    sent, (source, cut) = _sent(docs.sparkSession, merges, letters, unknown), _source(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_rows(Encoder(*sent.value), batches, cut)

    return docs.select("doc_id", "lang", source.alias("pieces")).mapInArrow(run, "doc_id long, lang string, at int, tokens array<string>")


def _whole(encode: Encoder, batches: Iterator[pa.RecordBatch], cut: Cut | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.ListArray]]:
    """Rows (..., lang, pieces), their numbers of pieces and all tokens of each."""
    for lang, part, numbers, flat in _portions(batches, encode.key, cut):
        tokens = tokens_of(encode, lang, flat)
        ends = np.r_[0, np.cumsum(pc.list_value_length(tokens).to_numpy())][np.r_[0, np.cumsum(numbers)]]
        yield part, numbers, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens.flatten())


def encode_whole(docs: DataFrame, pieces: Pieces, merges: dict[str, list[tuple[str, str]]], letters: dict[str, set[str]] | None = None, unknown: str = "<unk>") -> DataFrame:
    """doc_id, text, tokens: all tokens of each text that has pieces, in order, beside it; without a join or shuffle."""
    sent, (source, cut) = _sent(docs.sparkSession, merges, letters, unknown), _source(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers, whole in _whole(Encoder(*sent.value), batches, cut):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), whole], ["doc_id", "text", "tokens"]).filter(pa.array(numbers > 0))

    return docs.select("doc_id", "text", "lang", source.alias("pieces")).mapInArrow(run, "doc_id long, text string, tokens array<string>")


def decode_whole(docs: DataFrame, pieces: Pieces, merges: dict[str, list[tuple[str, str]]], every: bool = False) -> DataFrame:
    """doc_id, text, decoded: the tokens of each text put together where they are made, space marks as spaces. every: texts
    without pieces have a row too (empty ones the empty text, null ones null)."""
    sent, (source, cut) = _sent(docs.sparkSession, merges, None, ""), _source(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers, whole in _whole(Encoder(*sent.value), batches, cut):
            text = pc.replace_substring(pc.binary_join(whole, ""), MARK, " ")
            text = pc.if_else(part.column(1).is_valid(), text, pa.scalar(None, pa.string()))
            rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["doc_id", "text", "decoded"])
            yield rows if every else rows.filter(pa.array(numbers > 0))

    return docs.select("doc_id", "text", "lang", source.alias("pieces")).mapInArrow(run, "doc_id long, text string, decoded string")


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.sum("unknown").alias("unknown"))


def _counter(sent) -> Encoder:
    """Remembers the numbers of tokens and unknown ones only."""
    merges, letters, unknown = sent.value
    return Encoder(merges, letters, unknown, lambda tokens: (len(tokens), tokens.count(unknown) if letters is not None else 0))


def _sums(total: dict[str, list[int]]) -> pa.RecordBatch:
    columns = [pa.array(list(total), pa.string()), *(pa.array([x[i] for x in total.values()], pa.int64()) for i in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "tokens", "unknown"])


def count_tokens(docs: DataFrame, pieces: Pieces, merges: dict[str, list[tuple[str, str]]], letters: dict[str, set[str]] | None = None, unknown: str = "<unk>") -> DataFrame:
    """lang, tokens, unknown: numbers of tokens, in one pass; one row a language and task is shuffled."""
    sent, (source, cut) = _sent(docs.sparkSession, merges, letters, unknown), _source(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = _counter(sent), {}
        for lang, _, _, flat in _portions(batches, lambda lang: lang, cut):
            sums, times = total.setdefault(lang, [0, 0]), flat.value_counts()
            n = times.field("counts").to_pylist()
            for i, own in enumerate(zip(*encode(lang, times.field("values").to_pylist()), strict=True)):
                sums[i] += sum(x * y for x, y in zip(own, n, strict=True))
        yield _sums(total)

    return _summed(docs.select("lang", source.alias("pieces")).mapInArrow(run, "lang string, tokens long, unknown long"))


def count_words(freq: DataFrame, merges: dict[str, list[tuple[str, str]]], letters: dict[str, set[str]] | None = None, unknown: str = "<unk>") -> DataFrame:
    """The same from a word table (lang, piece, n), whose pieces are encoded once."""
    sent = _sent(freq.sparkSession, merges, letters, unknown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = _counter(sent), {}
        for batch in batches:
            for lang, piece, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = total.setdefault(lang, [0, 0])
                for i, x in enumerate(encode.one(lang, piece)):
                    sums[i] += n * x
        yield _sums(total)

    return _summed(freq.select("lang", "piece", "n").mapInArrow(run, "lang string, tokens long, unknown long"))


def encode_pieces(freq: DataFrame, merges: dict[str, list[tuple[str, str]]], letters: dict[str, set[str]] | None = None, unknown: str = "<unk>") -> DataFrame:
    """A table of distinct pieces (lang, piece, ...) with `tokens`; none comes twice, so none is remembered."""
    sent = _sent(freq.sparkSession, merges, letters, unknown)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in freq.schema.fields)
    names = freq.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*sent.value)
        for batch in batches:
            column = dict(zip(names, batch.columns, strict=True))
            langs = column["lang"].to_pylist() if "lang" in column else ["*"] * batch.num_rows
            tokens = [encode.one(k, p) for k, p in zip(langs, column["piece"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], [*names, "tokens"])

    return freq.mapInArrow(run, f"{fields}, tokens array<string>")


def interleave(lists: dict[str, list[tuple[str, str]]], order: list[str], letters: list[str], weights: dict[str, int], specials: list[str], size: int) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Joint vocabulary by weighted turns: a turn takes a language's next merge whose parts are
    known and whose token is new; merges passed over are gone. Ends at `size` entries or after a
    round that adds nothing."""
    ids: dict[str, int] = {}
    for t in [*specials, *letters]:
        ids.setdefault(t, len(ids))
    queues, taken = {k: iter(lists[k]) for k in order}, []

    def turn(k: str) -> bool:
        pair = next((p for p in queues[k] if p[0] in ids and p[1] in ids and p[0] + p[1] not in ids), None)
        if pair:
            ids[pair[0] + pair[1]] = len(ids)
            taken.append(tuple(pair))
        return pair is not None

    while len(ids) < size and any([turn(k) for k in order for _ in range(weights[k]) if len(ids) < size]):
        pass
    return ids, taken


class Interleaver:
    """`interleave` over numbers, for many weights: merges as (left, right, token) in one numbering of tokens."""

    def __init__(self, lists: dict[str, list[tuple[str, str]]], order: list[str], letters: list[str], specials: list[str]):
        self.order, ids = order, {}
        for t in [*specials, *letters]:
            ids.setdefault(t, len(ids))
        self.first = len(ids)
        pairs = {p: i for i, p in enumerate(dict.fromkeys(tuple(p) for k in order for p in lists[k]))}
        self.pairs = list(pairs)
        number = lambda t: ids.setdefault(t, len(ids))
        self.merges = {k: [(number(a), number(b), number(a + b), pairs[a, b]) for a, b in lists[k]] for k in order}
        self.tokens = len(ids)

    def most(self) -> int:
        """Entries that no weights can exceed."""
        return self.first + len({m[2] for own in self.merges.values() for m in own})

    def run(self, weights: dict[str, int], size: int) -> list[int]:
        """Merges taken, by their number."""
        known, taken, room = bytearray(self.tokens), [], size - self.first
        known[: self.first] = b"\x01" * self.first
        queues = [(iter(self.merges[k]), range(weights[k])) for k in self.order]
        before = -1
        while len(taken) < room and before < len(taken):
            before = len(taken)
            for queue, turns in queues:
                for _ in turns:
                    if len(taken) >= room:
                        break
                    for a, b, t, p in queue:
                        if known[a] and known[b] and not known[t]:
                            known[t] = 1
                            taken.append(p)
                            break
        return taken


class Recoder:
    """Token counts of words under joint merge lists that differ in order only: what a word becomes
    depends on the order of the merges whose token it holds, and few orders of those occur."""

    def __init__(self, words: list[tuple[str, int]], merges: Iterable[tuple[str, str]]):
        known: dict[str, list[int]] = {}
        pairs = list(merges)
        for i, (a, b) in enumerate(pairs):
            known.setdefault(a + b, []).append(i)
        self.words, self.pairs, self.absent, own = words, pairs, len(pairs), []
        for word, _ in words:
            parts = {word[i:j] for i in range(len(word)) for j in range(i + 2, min(len(word), i + 64) + 1)}
            own.append(sorted(p for t in parts for p in known.get(t, ())) if len(word) <= 64 else sorted(i for i, (a, b) in enumerate(pairs) if a + b in word))
        self.width = max(map(len, own), default=0)
        # merges of each word, filled up with one that is never taken
        self.own = np.full((len(words), self.width), self.absent, np.int64)
        for row, found in zip(self.own, own, strict=True):
            row[: len(found)] = found
        self.memo: list[dict[bytes, int]] = [{} for _ in words]
        self.held = 0

    def count(self, ranks: dict[tuple[str, str], int]) -> int:
        return self.count_at(np.array([ranks.get(p, self.absent) for p in self.pairs] + [self.absent], np.int64))

    def count_at(self, ranks: np.ndarray) -> int:
        """ranks: of each merge, the number of merges if it isn't taken; one more at the end for none."""
        rank = ranks[self.own]
        order = np.argsort(rank, axis=1, kind="stable")
        order = np.where(np.take_along_axis(rank, order, 1) < self.absent, order, -1).astype(np.int16)
        keys, step, total = order.tobytes(), 2 * self.width, 0
        for k, (memo, (word, n)) in enumerate(zip(self.memo, self.words, strict=True)):
            key = keys[k * step : (k + 1) * step]
            size = memo.get(key)
            if size is None:
                merges = [self.pairs[self.own[k, i]] for i in order[k] if i >= 0]
                size = memo[key] = len(encode_piece(word, {p: r for r, p in enumerate(merges)}, None, ""))
                self.held += 1
            total += n * size
        if self.held > 1_000_000:
            self.memo, self.held = [{} for _ in self.words], 0
        return total


#: Of the combinations of a search, each this many is encoded in full before the others; lists that a task remembers.
COARSE, KNOWN_LISTS = 16, 10_000
CANDIDATES = "combo long, weights map<string,int>, fertility map<string,double>, gap double, within boolean"


class Search(NamedTuple):
    """What weights are tried on. freq (lang, piece, n) is the capped corpus's word table: at most its cap of words
    a language. limit: a language and the fertility that it shall hold. filled: combinations that can't fill
    the vocabulary are out."""

    freq: DataFrame
    lists: dict[str, list[tuple[str, str]]]
    order: list[str]
    letters: list[str]
    denominators: dict[str, int]
    size: int
    choices: range
    limit: tuple[str, float] | None = None
    special: str = "<unk>"
    filled: bool = True

    def candidates(self, combos: DataFrame | None = None, least: tuple[float, bool] | None = None) -> DataFrame:
        """One row a weight combination in lexicographic order: combo, weights, fertility, gap, within (the limited
        language's fertility holds the limit). least (gap, within): of a combination that is known; those that must be worse have
        no row. Languages are encoded one by one, the limited one first, and their spread so far bounds the gap from below."""
        spark, order, choices = self.freq.sparkSession, self.order, self.choices
        table: dict[str, list[tuple[str, int]]] = {k: [] for k in order}
        for r in self.freq.filter(F.col("lang").isin(order)).collect():
            table[r["lang"]].append((r["piece"], r["n"]))
        turns = Interleaver(self.lists, order, self.letters, [self.special])
        combos = spark.range(len(choices) ** len(order)) if combos is None else combos
        if self.filled and turns.most() < self.size:
            combos = combos.limit(0)  # none can fill the vocabulary
        sent = spark.sparkContext.broadcast((table, turns))
        _, lists, *_, denominators, size, _, limit, _, filled = self._replace(freq=None)
        first = ([limit[0]] if limit else []) + [k for k in order if not limit or k != limit[0]]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, turns = sent.value
            recoders, known = {}, {}
            for batch in batches:
                rows = []
                for combo in batch["id"].tolist():
                    w, rest = {}, combo
                    for k in reversed(order):
                        rest, w[k] = rest // len(choices), choices[rest % len(choices)]
                    taken = turns.run(w, size)
                    if filled and turns.first + len(taken) < size:
                        continue
                    key = hashlib.sha256(np.array(taken, np.int32).tobytes()).digest()  # equal lists are encoded once
                    fert = dict(known.get(key, {}))
                    ranks = np.full(len(turns.pairs) + 1, len(turns.pairs), np.int64)
                    ranks[taken] = np.arange(len(taken))
                    for k in first:
                        if k not in fert:
                            if k not in recoders:
                                recoders[k] = Recoder(words[k], turns.pairs)
                            fert[k] = recoders[k].count_at(ranks) / denominators[k] if denominators.get(k) else 0.0
                        within = limit is None or fert[limit[0]] <= limit[1]
                        # out of the limit where another holds it, or a wider spread already
                        if least and (within < least[1] or within == least[1] and max(fert.values()) - min(fert.values()) > least[0]):
                            break
                    else:
                        if len(known) < KNOWN_LISTS:
                            known[key] = fert
                        fert = {k: fert[k] for k in order}
                        rows.append((combo, {k: w[k] for k in order}, fert, max(fert.values()) - min(fert.values()), within))
                yield pd.DataFrame(rows, columns=["combo", "weights", "fertility", "gap", "within"])

        n = len(choices) ** len(order)
        tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, n // 8))
        return combos.repartition(tasks).mapInPandas(run, CANDIDATES)

    def contenders(self) -> DataFrame:
        """Rows of `candidates` among which the best one is: each sixteenth combination in full, then those of the
        others that may be as good as the best of these."""
        grid = self.freq.sparkSession.range(len(self.choices) ** len(self.order))
        coarse = materialize(self.candidates(grid.filter(F.col("id") % COARSE == 0)), "coarse-search")
        best = best_weights(coarse).first()
        least = None if best is None or best["gap"] is None else (best["gap"], best["within"])
        return coarse.unionByName(materialize(self.candidates(grid.filter(F.col("id") % COARSE != 0), least), "fine-search"))


def weight_search(freq: DataFrame, lists: dict[str, list[tuple[str, str]]], order: list[str], letters: list[str], denominators: dict[str, int], size: int, choices: range, limit: tuple[str, float] | None = None, special: str = "<unk>", filled: bool = True) -> DataFrame:
    """All combinations (see Search)."""
    return Search(freq, lists, order, letters, denominators, size, choices, limit, special, filled).candidates()


def best_weights(candidates: DataFrame) -> DataFrame:
    """Least gap within the limit, else least gap; the earliest combination wins ties."""
    row = F.struct("gap", "combo", "weights", "fertility", "within")
    least = lambda c: F.min_by(row, F.when(c, F.struct("gap", "combo")))
    return candidates.agg(F.coalesce(least(F.col("within")), least(F.lit(True))).alias("b")).select("b.*")
