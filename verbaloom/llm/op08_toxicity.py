"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings of four to six characters (lower case). The vocabulary are the
terms whose link with the label is significant on a bounded sample of labelled training rows
(`examples` a class, chosen by hash, a documented limit), in either direction and without any cap on
their number; over all terms, chance overlap of common syllables decides the neighbours (README).
Weights are plain TF-IDF, (1 + log tf) * log((1 + documents) / (1 + df)) with frequencies counted
over all documents, and know no label.

The index holds postings (term, example, weight) by block of examples, and for each term and block
its largest weight: a query's product with these bounds any cosine in the block. A query visits
blocks in order of their bounds and stops when no bound reaches its k-th cosine, so its k nearest
examples are exact (cosines to six digits; ties: lower example number). Votes weigh each neighbour
by cosine. Votes are calibrated on the sample, each example scored without itself, by pooled
adjacent violators.

Inputs of a score are the text alone. Null text counts as empty; empty texts and texts without any
kept term get the calibrated share of such examples. Without usable labels every score is 0; with
labels but without any significant term, it is the share of label 1.
A doc_id labelled repeatedly counts as toxic if any label says so; of rows that share a labelled
doc_id the least text is the example; null labels are ignored.
Repeated rows repeat their result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The bound of the fitted sample, by class.
EXAMPLES, BLOCK, NEIGHBOURS = 3000, 64, 15
#: Least G-squared of a kept term against independence of the label: about one of 100,000 terms
#: without a link passes, whatever share of the sample label 1 has.
MIN_G2 = 20.0
#: Words whose terms a worker remembers between texts; texts scored at once.
REMEMBERED, CHUNK = 100_000, 256
#: Files of the sample, read by as many tasks.
SAMPLE_FILES = 16
_WORD = re.compile(r"[^\W_]+")


def word_terms(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


class Terms:
    """A fixed vocabulary; counts() gives a text's term numbers and frequencies."""

    def __init__(self, terms: list[str]):
        self.terms, self.ids = terms, {t: i for i, t in enumerate(terms)}
        # what a word must begin with to have any term
        self.heads, self.memo = {t.removeprefix("^")[:4] for t in terms}, {}

    def counts(self, text: str | None) -> dict[int, int]:
        heads, memo, out = self.heads, self.memo, {}
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            if word[:4] not in heads:
                continue
            own = memo.get(word)
            if own is None:
                own = tuple(self.ids[t] for t in word_terms(word) if t in self.ids)
                if len(word) <= 40:
                    memo[word] = own
            for i in own:
                out[i] = out.get(i, 0) + n
        if len(memo) > REMEMBERED:
            memo.clear()
        return out


Sparse = tuple[np.ndarray, np.ndarray]  # term numbers and weights


def unit(counts: dict[int, int], idf: np.ndarray) -> Sparse:
    """The unit TF-IDF vector of a text's counts; empty without terms of weight."""
    t = np.fromiter(counts, np.int64, len(counts))
    w = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * idf[t]
    norm = float(np.sqrt((w * w).sum()))
    return (t[w > 0], w[w > 0] / norm) if norm > 0 else (t[:0], w[:0])


def dense(rows: list[Sparse], size: int) -> np.ndarray:
    out = np.zeros((len(rows), size))
    for r, (t, w) in enumerate(rows):
        out[r, t] = w
    return out


class Index(Terms):
    """Postings by block of examples in order of example, and block maxima by term. examples: unit vectors."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[Sparse], labels: np.ndarray, prior: float, weights: np.ndarray):
        super().__init__(terms)
        # like examples share blocks: by label, then by heaviest term
        heaviest = np.array([t[w.argmax()] if len(t) else -1 for t, w in examples], dtype=np.int64)
        order = np.lexsort((np.arange(len(labels)), heaviest, -labels))
        self.idf, self.labels, self.weights, self.prior, self.zero = idf, labels[order], weights[order], prior, prior
        self.blocks, self.maxima = [], np.zeros((len(terms), -(-len(labels) // BLOCK)))
        for b in range(self.maxima.shape[1]):
            own = [examples[i] for i in order[b * BLOCK : (b + 1) * BLOCK]]
            term, weight = (np.concatenate([x[k] for x in own]) for k in (0, 1))
            np.maximum.at(self.maxima[:, b], term, weight)
            # postings of the terms that the block has: a row a term, a column an example
            held, at = np.unique(term, return_inverse=True)
            postings = np.zeros((len(held), len(own)))
            postings[at, np.repeat(np.arange(len(own)), [len(t) for t, _ in own])] = weight
            self.blocks.append((held, postings))
        self.steps = (np.zeros(1), np.full(1, prior))

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return dense([unit(self.counts(t), self.idf) for t in texts], len(self.terms))

    def stored(self, block: int) -> np.ndarray:
        """The block's examples as dense rows."""
        held, postings = self.blocks[block]
        out = np.zeros((postings.shape[1], len(self.terms)))
        out[:, held] = postings.T
        return out

    def cosines(self, queries: np.ndarray, block: int) -> np.ndarray:
        """Of all queries with the block's examples, from its postings."""
        held, postings = self.blocks[block]
        return queries[:, held] @ postings

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and example numbers of each query's k nearest, largest cosine first.

        A key joins a cosine in millionths with the example's number, lower numbers first. Rounds take one, two, four
        blocks a query and so on in the order of its bounds, so that a block meets many queries at once."""
        bounds, span = queries @ self.maxima, len(self.blocks) * BLOCK
        best, live = np.full((len(queries), k), -1), np.arange(len(queries))
        order, at, width = np.argsort(-bounds, axis=1, kind="stable"), 0, 1
        reached = np.full(len(queries), -1.0)  # the k-th cosine
        while at < len(self.blocks) and len(live):
            near = order[live, at : at + width]
            row, column = np.nonzero(np.take_along_axis(bounds[live], near, 1) >= reached[live, None] - 1e-6)
            block, row = near[row, column], live[row]
            by = np.argsort(block, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1) if len(by) else ():
                b = block[part[0]]
                rows = row[part]
                rows = rows[bounds[rows, b] >= reached[rows] - 1e-6]
                got = np.rint(self.cosines(queries[rows], b) * 1e6).astype(np.int64)
                keys = np.concatenate([best[rows], got * span + (span - 1 - b * BLOCK - np.arange(got.shape[1]))], axis=1)
                best[rows] = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]
                reached[rows] = best[rows].min(axis=1) // span / 1e6
            at, width, live = at + width, 2 * width, np.unique(row)
        best = -np.sort(-best, axis=1)
        return np.where(best < 0, -1.0, best // max(span, 1) / 1e6), np.where(best < 0, -1, span - 1 - best % max(span, 1))

    def votes(self, cosines: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, by cosine and the sample's class weights, with
        the prior as one faint neighbour."""
        w = np.where((who >= 0) & (cosines > 1e-6), np.maximum(cosines, 0) ** 2, 0) * self.weights[np.maximum(who, 0)]
        return ((w * self.labels[np.maximum(who, 0)]).sum(axis=1) + 0.05 * self.prior) / (w.sum(axis=1) + 0.05)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, and as evidence the neighbours and their cosines."""
        q = self.vectors(texts)
        score, some = np.full(len(texts), self.zero), np.flatnonzero(q.any(axis=1)) if self.blocks else np.zeros(0, int)
        who, cosines = np.full((len(texts), NEIGHBOURS), -1), np.zeros((len(texts), NEIGHBOURS))
        if len(some):
            cosines[some], who[some] = self.nearest(q[some], NEIGHBOURS)
            score[some] = np.interp(self.votes(cosines[some], who[some]), *self.steps)
        return np.clip(score, 0, 1), who, cosines

    def calibrate(self) -> None:
        """Isotonic fit of leave-one-out votes on the examples, a block at a time; zero vectors apart."""
        labels, weights, zero, votes = self.labels, self.weights, [], []
        for b in range(len(self.blocks)):
            q = self.stored(b)
            cosines, who = self.nearest(q, NEIGHBOURS + 1)
            cosines[who == (b * BLOCK + np.arange(len(q)))[:, None]] = 0
            zero.append(~q.any(axis=1))
            votes.append(self.votes(cosines, who))
        zero, vote = np.concatenate(zero), np.concatenate(votes)
        self.zero = float((weights * labels)[zero].sum() + self.prior) / float(weights[zero].sum() + 1)
        vote = vote[~zero]
        pools: list[list[float]] = []
        for v, y, w in sorted(zip(vote, labels[~zero], weights[~zero], strict=True)):
            pools.append([w, w * y, v, v])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
        if pools:
            # flat over the votes of a pool; a faint example keeps scores off 0 and 1
            self.steps = (np.array([v for p in pools for v in p[2:]]), np.array([(p[1] + self.prior) / (p[0] + 1) for p in pools for _ in p[2:]]))


def g_squared(a: Column, n1: int, b: Column, n0: int) -> Column:
    """Of the table label by presence: a of n1 and b of n0 have the term."""
    share = (a + b) / (n1 + n0)
    cells = ((a, n1, share), (b, n0, share), (n1 - a, n1, 1 - share), (n0 - b, n0, 1 - share))
    parts = [F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0) for x, n, p in cells]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def significant(sample: DataFrame, n1: int, n0: int, min_g2: float = MIN_G2) -> list[str]:
    """Terms of the sample (text, toxic) whose link with the label is beyond chance, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                part, seen = batch.iloc[lo : lo + CHUNK], (Counter(), Counter())
                for text, y in zip(part["text"], part["toxic"], strict=True):
                    seen[int(y)].update({t for w in set(_WORD.findall(text.lower())) for t in word_terms(w)})
                terms = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"term": pd.Series(terms, dtype=object), "a": [seen[1][t] for t in terms], "b": [seen[0][t] for t in terms]})

    counted = sample.select("text", "toxic").mapInPandas(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sorted(r["term"] for r in counted.filter(g_squared(F.col("a"), n1, F.col("b"), n0) >= min_g2).select("term").collect())


def frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = Terms(sent.value), np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            total[-1] += len(batch)
            for text in batch["text"]:
                if found := own.counts(text):
                    total[list(found)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    found = docs.select("text").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms) + 1, np.int64)
    out[found["term"].to_numpy(int)] = found["n"].to_numpy(int)
    return int(out[-1]), out[:-1]


def fit(counts: list[dict[int, int]], labels: np.ndarray, shares: dict[int, int], terms: list[str], documents: int, df: np.ndarray) -> Index:
    """counts, labels: of the sample; shares: training rows by label, for class weights."""
    sampled = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    weights = np.array([shares[int(y)] / sampled[int(y)] for y in labels])
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    idf = np.log((1 + documents) / (1 + df)) if len(terms) else np.zeros(0)
    index = Index(terms, idf, [unit(c, idf) for c in counts], labels, prior, weights)
    if len(labels) and terms:
        index.calibrate()
    return index


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    own = labels.filter("toxic is not null").filter(common.crc_mod("doc_id", modulus) != remainder)
    own = own.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    return own


def fit_on(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, examples: int = EXAMPLES, min_g2: float = MIN_G2) -> Index:
    own = training_rows(docs, labels, modulus, remainder)
    shares = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [own.filter(F.col("toxic") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(examples) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    # `examples` ids a class at most: bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id").agg(F.min(common.text_of()).alias("text"), F.max("toxic").alias("toxic"))
    # equal texts are one example, that of least id; texts stay on the executors
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("example_id"), F.min_by("toxic", "doc_id").alias("toxic"))
    sample = common.materialize(rows.repartition(SAMPLE_FILES), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    terms = significant(sample, sizes.get(1, 0), sizes.get(0, 0), min_g2) if sizes else []
    documents, df = frequencies(docs, terms) if terms else (0, np.zeros(0))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Terms(terms)
        for batch in batches:
            found = [own.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"example_id": batch["example_id"], "toxic": batch["toxic"], "term": [list(c) for c in found], "n": [list(c.values()) for c in found]})

    coded = sample.mapInPandas(code, "example_id long, toxic int, term array<int>, n array<int>").toPandas().sort_values("example_id")
    counts = [dict(zip(map(int, t), map(int, n))) for t, n in zip(coded["term"], coded["n"], strict=True)]
    return fit(counts, coded["toxic"].to_numpy(dtype=float), {0: shares.get(0, 0), 1: shares.get(1, 0)}, terms, documents, df)


def toxicity(docs: DataFrame, index: Index, threshold: float = 0.3) -> DataFrame:
    """docs with tox_score, tox_predicted and tox_evidence (example numbers, cosines); columns of
    docs with these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    added = ("tox_score", "tox_predicted", "tox_evidence")
    kept = docs.drop(*added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                part = batch.iloc[lo : lo + CHUNK]
                score, who, cosines = own.score(part["text"].tolist())
                evidence = [[{"example": int(a), "cosine": float(c)} for a, c in zip(x[:3], y[:3], strict=True) if c > 1e-6] for x, y in zip(who, cosines, strict=True)]
                yield pd.DataFrame({"tox_score": score, "tox_predicted": (score >= threshold).astype(int), "tox_evidence": evidence})

    return common.beside(kept, kept.columns, ["text"], run, "tox_score double, tox_predicted int, tox_evidence array<struct<example:int,cosine:double>>")


def op8_toxicity(spark, sf_dir) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit_on(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity(docs, index)
    held = F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
