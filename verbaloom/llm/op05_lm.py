"""LM scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Words share `cells` output cells: the most frequent training words have one each, all others share
hashed cells by CRC-32. The model gives P(cell | two previous cells) with log-bilinear scores;
within a cell, P(word | cell) = (c + 1) / (cell's tokens + cell's words + 1), where the last 1 is
the share of all unseen words. Both factors are normalised, so the product is a token probability.

* Counts of all training words come from one pass with map-side counting and one shuffle; their
  table stays distributed. Only the `head` most frequent words go to the workers (bounded).
* Training: documents are dealt to shards by a hash of id and text, some SHARD_TOKENS tokens each. Every
  shard runs one epoch of NCE from the same start in the order of that hash; the replicas, weighted by
  tokens, are averaged (a fixed number of bytes a shard). Scores so don't depend on files or partitions.
* Scoring: with two context cells the score matrix splits as S1[w1, w] + S2[w2, w], so a single
  matrix product exp(S1) exp(S2)^T normalises every context at once; tokens are then lookups.
* Words beyond the head leave the scoring pass as (row, word) and meet their counts in a shuffle
  join on the word; the sums go back to their row.

Null text counts as empty (the end token alone). A null doc_id counts as training. Repeated rows
are scored each (rows carry their own key). An empty training set gives base scores of
1/(0+1*(0+1)) = probability 1 and the untrained model. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words sent to the workers with their counts: at most this many, some 6 MB.
HEAD = 200_000
#: Output cells: the end token, OWN frequent words, the rest hashed.
CELLS, OWN = 1024, 767
DIM, NOISE, BATCH, RATE, SEED = 16, 96, 2048, 0.05, 11
#: Training tokens of a shard, and the most shards (beyond, they hold more tokens).
SHARD_TOKENS, MAX_SHARDS = 1_000_000, 65_536
#: Words counted before a task hands over what it has.
FLUSH = 400_000
#: The end token; white space can't be part of a word.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "c": list(seen.values())}, columns=["word", "c"])

    return docs.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def hashed_cell(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word) % (CELLS - 1 - OWN)


class Params:
    """Context vectors of both positions, output vectors, output biases. Row CELLS: text start."""

    def __init__(self, near, far, out, bias):
        self.near, self.far, self.out, self.bias = near, far, out, bias

    @classmethod
    def start(cls, bias: np.ndarray) -> Params:
        rng = np.random.default_rng(SEED)
        draw = lambda n: (rng.standard_normal((n, DIM)) * 0.1).astype(np.float32)
        return cls(draw(CELLS + 1), draw(CELLS + 1), draw(CELLS), bias.astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.near, self.far, self.out, self.bias)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Params:
        flat, n = flat.astype(np.float32), (CELLS + 1) * DIM
        return cls(flat[:n].reshape(-1, DIM).copy(), flat[n : 2 * n].reshape(-1, DIM).copy(), flat[2 * n : 2 * n + CELLS * DIM].reshape(-1, DIM).copy(), flat[2 * n + CELLS * DIM :].copy())

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """S1[w1, w], S2[w2, w] (biases within) and log-normalisers Z[w1, w2]; the two S are shifted
        by row maxima, so the exponentials can't overflow."""
        s1, s2 = self.near @ self.out.T, self.far @ self.out.T + self.bias
        s1 -= s1.max(axis=1, keepdims=True)
        s2 -= s2.max(axis=1, keepdims=True)
        z = np.exp(s1.astype(np.float64)) @ np.exp(s2.astype(np.float64)).T
        return s1, s2, np.log(np.maximum(z, 1e-300)).astype(np.float32)


def contexts(cells: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cells before each token; ends: positions of the texts' last tokens."""
    w1, w2 = np.full(len(cells), CELLS), np.full(len(cells), CELLS)
    w1[1:], w2[2:] = cells[:-1], cells[:-2]
    first = ends[:-1] + 1
    w1[first] = CELLS
    w2[first] = CELLS
    w2[first[first + 1 < len(cells)] + 1] = CELLS
    return w1, w2


def _scatter(rows: np.ndarray, grads: np.ndarray, size: int) -> np.ndarray:
    order = np.argsort(rows, kind="stable")
    rows, grads = rows[order], grads[order]
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    out = np.zeros((size, grads.shape[1]), np.float32)
    out[rows[at]] = np.add.reduceat(grads, at, axis=0)
    return out


class Trainer:
    """NCE with NOISE shared samples a batch and Adagrad steps on summed gradients."""

    def __init__(self, params: Params, noise: np.ndarray, seed: int):
        self.p, self.noise, self.log_noise = params, noise, np.log(noise).astype(np.float32)
        self.rng = np.random.default_rng([SEED, seed])
        self.sums = [np.full(x.shape, 1e-2, np.float32) for x in (params.near, params.far, params.out, params.bias)]
        self.seen = 0

    def step(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        p, n = self.p, len(w)
        k = 10.0  # noise samples a token; the shared ones stand for them
        fake = self.rng.choice(CELLS, NOISE, p=self.noise)
        q = p.near[w1] + p.far[w2]
        s_true = (q * p.out[w]).sum(axis=1) + p.bias[w] - self.log_noise[w] - np.float32(np.log(k))
        s_fake = q @ p.out[fake].T + (p.bias[fake] - self.log_noise[fake] - np.float32(np.log(k)))
        with np.errstate(over="ignore"):  # exp to infinity gives the right 0
            g_true = 1 / (1 + np.exp(s_true))
            g_fake = -np.float32(k / NOISE) / (1 + np.exp(-s_fake))
        g_q = g_true[:, None] * p.out[w] + g_fake @ p.out[fake]
        g_out, g_bias = _scatter(w, g_true[:, None] * q, CELLS), np.bincount(w, g_true, CELLS).astype(np.float32)
        np.add.at(g_out, fake, g_fake.T @ q)
        np.add.at(g_bias, fake, g_fake.sum(axis=0))
        for x, g, s in zip((p.near, p.far, p.out, p.bias), (_scatter(w1, g_q, CELLS + 1), _scatter(w2, g_q, CELLS + 1), g_out, g_bias), self.sums, strict=True):
            g /= np.float32(n) ** 0.5
            s += g * g
            x += np.float32(RATE) * g / np.sqrt(s)
        self.seen += n


def train(docs: DataFrame, head: dict[bytes, int], bias: np.ndarray, noise: np.ndarray, shards: int) -> np.ndarray:
    """Average of the shards' replicas after one epoch over all training documents."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(head)
    size = len(Params.start(bias).flat())

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {w: 0 if w == END else 1 + r for w, r in sent.value.items() if r < OWN}
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                cells = [np.array([own[w] if w in own else hashed_cell(w) for w in tokens(t)], dtype="<u2").tobytes() for t in part["text"]]
                yield pd.DataFrame({"shard": part["shard"], "order": part["order"], "cells": cells})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, trainer, held, waiting = None, None, [], 0

        def learn() -> None:
            cells = np.concatenate(held).astype(np.int64)
            w1, w2 = contexts(cells, np.flatnonzero(cells == 0))
            order = trainer.rng.permutation(len(cells))
            for lo in range(0, len(cells), BATCH):
                at = order[lo : lo + BATCH]
                trainer.step(cells[at], w1[at], w2[at])

        def replica() -> pd.DataFrame:
            flat = trainer.p.flat().astype(np.float64) * trainer.seen
            return pd.DataFrame({"at": np.arange(0, size, 1024), "n": trainer.seen, "part": [flat[i : i + 1024].tolist() for i in range(0, size, 1024)]})

        for batch in batches:
            for own, raw in zip(batch["shard"], batch["cells"], strict=True):
                if own != shard:
                    if held:
                        learn()
                    if trainer is not None:
                        yield replica()
                    shard, trainer, held, waiting = own, Trainer(Params.start(bias), noise, own), [], 0
                held.append(np.frombuffer(raw, "<u2"))
                waiting += len(held[-1])
                if waiting > 1 << 18:
                    learn()
                    held, waiting = [], 0
        if held:
            learn()
        if trainer is not None:
            yield replica()

    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("order")).withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    coded = dealt.mapInPandas(code, "shard int, order long, cells binary").repartition(shards, "shard").sortWithinPartitions("shard", "order")
    parts = coded.mapInPandas(run, "at int, n long, part array<double>")
    values = parts.select("at", "n", F.posexplode("part").alias("i", "x")).groupBy("at", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = values.select((F.col("at") + F.col("i")).alias("at"), (F.col("x") / F.col("n")).alias("x")).toPandas()
    sent.unpersist()
    if not len(rows):
        return Params.start(bias).flat()
    out = np.zeros(size)
    out[rows["at"].to_numpy()] = rows["x"].to_numpy()
    return out


def lm_score(docs: DataFrame, held_modulus: int = 7, held_remainder: int = 2, head_words: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(common.crc_mod("doc_id", held_modulus) == held_remainder, F.lit(False)).alias("held_out"))
    training = docs.filter("not held_out")
    counts = common.materialize(word_counts(training), "word-counts")
    cell = F.lit(1 + OWN) + F.crc32("word") % (CELLS - 1 - OWN)
    sums = {r["cell"]: (r["n"], r["v"]) for r in counts.groupBy(cell.alias("cell")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    # the head: words from the least count on of which no more than head_words are left; each
    # distinct count is one row here, and their number grows as the square root of the corpus at most
    steps = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head_words).collect()
    running = np.cumsum([r["n"] for r in steps]) if steps else np.zeros(0)
    fit = int(np.searchsorted(running, head_words, side="right"))
    head_c = {}
    if fit:
        for r in counts.filter(F.col("c") >= steps[fit - 1]["c"]).toLocalIterator():
            head_c[bytes(r["word"])] = r["c"]
    ranks = {w: r for r, w in enumerate(sorted((w for w in head_c if w != END), key=lambda w: (-head_c[w], w))[:OWN])}
    if END in head_c:
        ranks[END] = 0
    # tokens and words of each cell; those with a cell of their own leave the hashed ones
    n_cell, v_cell = np.zeros(CELLS), np.zeros(CELLS)
    for k, (n, v) in sums.items():
        n_cell[k], v_cell[k] = n, v
    for w, r in ranks.items():
        own = 0 if w == END else 1 + r
        n_cell[own], v_cell[own] = head_c[w], 1
        n_cell[hashed_cell(w)] -= head_c[w]
        v_cell[hashed_cell(w)] -= 1
    share = (n_cell + v_cell + 1) / (n_cell + v_cell + 1).sum()
    flat = train(training, ranks, np.log(share), share, max(1, min(MAX_SHARDS, -(-total // SHARD_TOKENS))))
    floor = float(np.log10(total + 1.0 * (distinct + 1)))
    log_cell = np.log10(n_cell + v_cell + 1)
    sent = spark.sparkContext.broadcast((head_c, ranks, flat.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ranked, weights = sent.value
        s1, s2, z = Params.of(weights).tables()
        names = list(known)
        index = {w: i for i, w in enumerate(names)}
        cell_of = np.array([(0 if w == END else 1 + ranked[w]) if w in ranked else hashed_cell(w) for w in names], dtype=np.int64)
        log_c = np.log10(np.array([known[w] for w in names], dtype=float) + 1)
        del names
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.iloc[lo : lo + 128]
                texts = [tokens(t) for t in part["text"]]
                flat_words = [w for ws in texts for w in ws]
                at = np.array([index.get(w, -1) for w in flat_words], dtype=np.int64)
                sizes = np.array([len(ws) for ws in texts])
                owner, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - 1
                cells, logs, hit = np.zeros(len(at), np.int64), np.zeros(len(at)), at >= 0
                cells[hit], logs[hit] = cell_of[at[hit]], log_c[at[hit]]
                rare: list[list[bytes]] = [[] for _ in texts]
                for i in np.flatnonzero(~hit).tolist():
                    w = flat_words[i]
                    cells[i] = 0 if w == END else hashed_cell(w)
                    rare[owner[i]].append(w)
                w1, w2 = contexts(cells, ends)
                lp = (s1[w1, cells] + s2[w2, cells] - z[w1, w2]).astype(float) / np.log(10) - log_cell[cells] + logs
                add = lambda x: np.bincount(owner, x, len(texts))  # noqa: E731, B023
                yield pd.DataFrame({
                    "row": row + np.arange(len(texts)), "n_tokens": sizes,
                    "known": add(hit).astype(np.int64), "base": add(logs - floor), "model": add(lp),
                    "rare": rare,
                })
                row += len(texts)

    scored = common.beside(docs, ["doc_id", "held_out"], ["text"], run, "row long, n_tokens long, known long, base double, model double, rare array<binary>")
    scored = common.materialize(scored, "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("rare_word"))
    met = rare.join(counts, F.col("rare_word") == F.col("word")).groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("log_c"))
    met = met.withColumnRenamed("row", "met_row")
    return scored.drop("rare").join(met, F.col("row") == F.col("met_row"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_c", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("log_c", F.lit(0.0))).alias("score"),
    )


def op5_lm_score(spark, sf_dir) -> DataFrame:
    return lm_score(common.table(spark, sf_dir, "documents"))
