"""Near copies: SimHash fingerprints filter pairs, exact Jaccard similarity of word shingles verifies them.

1. A text is the set of its hashed shingles (ASCII lower case, XXH64) with its SimHash of 64 bits; equal sets
   are one class.
2. op7's method gives the first candidates: block keys of the fingerprints, pivot tables and the distance leave
   classes that differ in at most LINK bits.
   Under any one order of shingles, two sets of Jaccard 0.8 or more share a shingle among the first
   n - ceil(0.8 n) + 1 of each (prefix filter), so these are bucket keys too: SimHash's own can't reach
   the ten bits by which most such texts differ. The order only decides about cost: shingles that a sample of
   texts has often come last, then by hash.
3. Pairs of buckets of at most `few` rows are dropped if their sizes rule 0.8 out or fingerprints differ in
   more than RADIUS bits (at 0.8 the mean is 9.7, deviation 2.9; about one pair of a million is lost); sets of at
   most FREE shingles, whose fingerprints vary more, pass whatever theirs are. The rest is verified on the sets, by connected groups of pairs, so that a text travels once to its group.
   Keys are shuffled once: a bucket's rows are counted where they meet. Keys that more than `few` of a PART-th of the
   classes have are known to be large before, so that no task gets a very long run.
4. Larger buckets are grouped by their least member, so that the keys of one crowd of copies are one group;
   groups get the texts of members that may have a partner there (sizes and numbers of shingles by bin bound what two
   sets share, exactly) and are verified in one step by counting common shingles.
   Both kinds of group leave a spanning forest of links, and beyond `block_rows` are dealt as pairs of chunks.

Null text counts as empty; texts without words are one class. Rows with a null doc_id share their
component. Repeated rows repeat. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, op07_simhash

WIDTH, FEW, BLOCK_ROWS, SLOTS, SAMPLE, RADIUS, FREE, SMALL, LINK, TEXTS, PART = 5, 32, 2048, 1 << 22, 8_000, 24, 16, 1_000_000, 4, 2048, 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashed shingles in order; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([h(join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))], dtype=np.uint64))


def binned(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles by bin; the sums of the lesser ones bound how many two sets have in common."""
    return np.stack([np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256) for x in sets]).astype(np.int32)


def packed(bins: np.ndarray) -> bytes:
    """Numbers by bin in as few bytes each as hold them all."""
    most = int(bins.max(initial=0))
    return bins.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def similar(common_: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard of 0.8 or more, in whole numbers, of sets of m and n with so many in common."""
    return 9 * common_ >= 4 * (m + n)


def frequent(docs: DataFrame) -> np.ndarray:
    """Slots (hash modulo SLOTS) that stand out in about SAMPLE texts; at any size a small part."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            slot, n = np.unique(np.concatenate(sets) % np.uint64(SLOTS) if sets else np.zeros(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"slot": slot.astype(np.int64), "n": n})

    found = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(every)) == 0).select("text").mapInPandas(run, "slot long, n long")
    counts = common.materialize(found.groupBy("slot").agg(F.sum("n").alias("n")), "shingle-slots")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / SLOTS
    top = counts.filter(F.col("n") > mean + 3 * mean**0.5 + 1).toPandas()
    out = np.zeros(SLOTS, np.int32)
    out[top["slot"].to_numpy(np.int64)] = top["n"].to_numpy(np.int64)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, sid (hash of the set), its size, SimHash, prefix and numbers of shingles by bin."""
    order = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def row(text: str | None) -> tuple:
        import xxhash

        s = shingles(text)
        n = len(s)
        first = s[np.argsort(order.value[(s % np.uint64(SLOTS)).astype(np.int64)], kind="stable")[: n - (4 * n + 4) // 5 + 1]]
        return np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64), n, np.uint64(op07_simhash.majority(s)).astype(np.int64), first.view(np.int64), packed(binned([s])[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                yield pd.DataFrame([row(t) for t in part["text"]], columns=["sid", "size", "fp", "prefix", "bins"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return common.beside(hashed, ["doc_id", "text_hash"], ["text"], run, "sid long, size int, fp long, prefix array<long>, bins binary")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal `key` of rows that are sorted by it."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        k = rows["key"].to_numpy()
        whole = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if whole:
            yield rows.iloc[:whole]
        rest = rows.iloc[whole:]
    if rest is not None and len(rest):
        yield rest


def key_runs(keyed: DataFrame, few: int) -> DataFrame:
    """(a, b, hot), distinct, from one shuffle of the keys: of keys that at most `few` classes have, the pairs whose sizes
    and fingerprints allow the similarity; of the others (hot) the least member with each member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches):
            k, sid, size, fp = rows["key"].to_numpy(), rows["sid"].to_numpy(), rows["size"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64)
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            n = np.diff(np.r_[first, len(k)])
            hot = np.repeat(n > few, n)
            if hot.any():
                yield pd.DataFrame({"a": np.repeat(np.minimum.reduceat(sid, first), n)[hot], "b": sid[hot], "hot": True})
                k, sid, size, fp = (x[~hot] for x in (k, sid, size, fp))
            at, shift = np.arange(len(k)), 0
            while True:
                shift += 1
                at = at[at + shift < len(k)]
                at = at[k[at] == k[at + shift]]
                if not len(at):
                    break
                left = at[similar(np.minimum(size[at], size[at + shift]), size[at], size[at + shift])]
                left = left[(np.bitwise_count(fp[left] ^ fp[left + shift]) <= RADIUS) | (np.maximum(size[left], size[left + shift]) <= FREE)]
                a, b = sid[left], sid[left + shift]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "hot": False})

    return keyed.select("key", "sid", "size", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, hot boolean").distinct()


def few_pairs(found: DataFrame) -> DataFrame:
    """(a, b): the pairs among the rows of `key_runs`."""
    return found.filter("NOT hot").select("a", "b")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that op7's steps link: by block keys and pivot tables within LINK bits, and by equal fingerprints."""
    marked = classes.select("fp", "sid")
    leads = common.materialize(marked.groupBy("fp").agg(F.min("sid").alias("lead")), "fingerprint-leads")
    found = op07_simhash.links(leads, LINK, op07_simhash.blocks_for(leads.count(), LINK), op07_simhash.BLOCK_ROWS)
    found = common.materialize(found.distinct(), "fingerprint-links").select(F.col("a").alias("x"), F.col("b").alias("y"))
    for side, name in (("x", "a"), ("y", "b")):
        found = found.join(leads.select(F.col("fp").alias(f"fp_{name}"), F.col("lead").alias(name)), F.col(side) == F.col(f"fp_{name}"))
    equal = common.join_hot(marked, leads.select(F.col("fp").alias("f"), "lead"), "fp", "f").filter("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    both = found.select("a", "b").unionByName(equal)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Spanning forest of the similar pairs: common shingles are counted exactly, by blocks."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    shingle, col = np.unique(np.concatenate(sets), return_inverse=True)
    own, n = np.repeat(np.arange(len(sets)), size), np.bincount(col, minlength=len(shingle))
    shared = n[col] > 1
    own, (used, col) = own[shared], np.unique(col[shared], return_inverse=True)
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2^24 are exact
    for lo in range(0, len(used), 2048):
        x = np.zeros((len(sets), min(2048, len(used) - lo)), np.float32)
        i, j = np.searchsorted(col, [lo, lo + 2048])
        x[own[i:j], col[i:j] - lo] = 1
        both += x @ x.T
    left, a, b = np.ones(len(sets), bool), [], []
    for start in range(len(sets)):
        stack = [start] if left[start] else []
        left[start] = False
        while stack:
            i = stack.pop()
            new = np.flatnonzero(left & similar(both[i].astype(np.int64), size[i], size)).tolist()
            left[new] = False
            a += [i] * len(new)
            b += new
            stack += new
    return a, b


def crowds(crowd: DataFrame) -> DataFrame:
    """(lead, sid): the members of hot buckets (crowd: key, sid) with the least one."""
    lead = crowd.groupBy("key").agg(F.min("sid").alias("lead")).withColumnRenamed("key", "lk")
    return common.join_hot(crowd, lead, "key", "lk").select("lead", "sid")


def crowd_groups(grouped: DataFrame, block_rows: int) -> DataFrame:
    """(key, s): groups of hot buckets (grouped: lead, sid), all of whose pairs are compared."""
    sizes = grouped.groupBy(F.col("lead").alias("l")).agg(F.count("*").alias("n")).filter("n > 1")
    # half-size chunks, so that a pair of them holds block_rows at most on average
    chunks = F.when(F.col("n") <= block_rows, 1).otherwise(F.ceil(F.col("n") / (block_rows // 2))).cast("int")
    dealt = common.join_hot(grouped, common.materialize(sizes.select("l", chunks.alias("chunks")), "hot-sizes"), "lead", "l")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "sid"), F.col("chunks").cast("long")).cast("int")
    spread = dealt.withColumn("own", own).select("lead", "sid", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return spread.select(F.xxhash64(F.lit("crowd"), "lead", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("sid").alias("s"))


def partnered(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of groups (key, s) that some other row of their key may be similar to: sizes and numbers of shingles by
    bin bound what two sets share, so no similar pair is lost and the texts of the others needn't travel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches):
            for _, group in rows.groupby("key", sort=False):
                size, bins = group["size"].to_numpy(np.int64), np.stack([np.frombuffer(x, f"<u{len(x) // 256}") for x in group["bins"]])
                order = np.argsort(size, kind="stable")
                size, bins, found = size[order], bins[order], np.zeros(len(order), bool)
                for i in range(len(order)):
                    # those of at least its size that are at most 5/4 of it
                    last = int(np.searchsorted(4 * size, 5 * size[i], side="right"))
                    if last > i + 1:
                        bound = np.minimum(bins[i], bins[i + 1 : last]).sum(axis=1, dtype=np.int64)
                        near = similar(bound, size[i], size[i + 1 : last])
                        found[i + 1 : last] |= near
                        found[i] |= near.any()
                kept = group.iloc[np.sort(order[found])]
                yield pd.DataFrame({"key": kept["key"], "s": kept["s"]})

    known = groups.join(classes.select("sid", "size", "bins"), F.col("s") == F.col("sid")).select("key", "s", "size", "bins")
    return known.repartition("key").sortWithinPartitions("key").mapInPandas(run, "key long, s long")


def joined(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of similar pairs (a[i], b[i]) that form a spanning forest of all similar ones. Counts of
    shingles by bin bound the overlap; the rest is counted exactly unless joined already."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    bins = binned(sets)
    parent, out = list(range(len(sets))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for lo in range(0, len(a), 4096):
        x, y = a[lo : lo + 4096], b[lo : lo + 4096]
        bound = np.minimum(bins[x], bins[y]).sum(axis=1, dtype=np.int64)
        for k in np.flatnonzero(similar(bound, size[x], size[y])).tolist():
            i, j = root(int(x[k])), root(int(y[k]))
            if i != j and similar(len(np.intersect1d(sets[x[k]], sets[y[k]], assume_unique=True)), size[x[k]], size[y[k]]):
                parent[i] = j
                out.append(lo + k)
    return out


def pair_groups(pairs: DataFrame, block_rows: int) -> DataFrame:
    """(key, a, b): pairs by connected group, large groups by pairs of chunks."""
    tree = op07_simhash.components(pairs)
    nodes = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    many = tree.groupBy(F.col("root").alias("r")).agg((F.count("*") + 1).alias("n"))
    chunks = F.when(F.col("n") <= block_rows, 1).otherwise(F.ceil(F.col("n") / (block_rows // 2))).cast("long")
    nodes = common.materialize(common.join_hot(nodes, many.select("r", chunks.alias("chunks")), "root", "r").select("node", "root", "chunks"), "pair-groups")
    at = lambda c: F.pmod(F.xxhash64(F.lit("chunk"), c), F.col("chunks"))
    dealt = pairs.join(nodes, F.col("a") == F.col("node"))
    return common.materialize(dealt.select(F.xxhash64(F.lit("pairs"), "root", F.least(at("a"), at("b")), F.greatest(at("a"), at("b"))).alias("key"), "a", "b"), "dealt-pairs")


def verified(docs: DataFrame, classes: DataFrame, dealt: DataFrame, crowds: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the similar pairs of every group: of those listed in dealt (key, a, b), or of
    all among a crowd (key, s)."""
    wanted = dealt.select("key", F.explode(F.array("a", "b")).alias("s")).distinct().unionByName(crowds)
    wanted = wanted.join(classes.select("sid", "rep"), F.col("s") == F.col("sid")).select("key", "sid", F.col("rep.text_hash").alias("rep_hash"), F.col("rep.doc_id").alias("rep_id"))
    wanted = common.materialize(wanted, "wanted-texts")
    own = (F.col("h") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    texts = docs.select("doc_id", common.text_of().alias("text"), F.xxhash64("text").alias("h")).join(common.small(wanted, SMALL), own)
    # texts and pairs in one table, no nulls: pandas has no null whole numbers
    texts = texts.select("key", F.lit(True).alias("is_text"), F.col("sid").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    rows = texts.unionByName(dealt.select("key", F.lit(False).alias("is_text"), "a", "b", F.lit("").alias("text"))).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches):
            for _, group in part.groupby("key", sort=False):
                listed = group[~group["is_text"]]
                members = group[group["is_text"]].drop_duplicates("a")  # rows equal in id and text come again
                sid, sets = members["a"].to_numpy(), [shingles(t) for t in members["text"]]
                if len(listed):
                    order = np.argsort(sid)
                    a, b = (order[np.searchsorted(sid[order], listed[c].to_numpy())] for c in ("a", "b"))
                    kept = joined(sets, a, b)
                    a, b = a[kept], b[kept]
                else:
                    a, b = forest(sets) if len(sets) > 1 else ([], [])
                yield pd.DataFrame({"a": sid[a], "b": sid[b]}, dtype=np.int64)

    return rows.mapInPandas(run, "a long, b long")


def near_components(docs: DataFrame, few: int = FEW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text_hash, fingerprint (of the component) and component_id (least doc_id in it)."""
    with common.scratch(docs.sparkSession) as keep:
        with common.rows_a_batch(docs.sparkSession, TEXTS):
            marked = common.materialize(signed(docs), "shingles")
        rows = keep(common.materialize(marked.select("sid", "doc_id", "text_hash"), "shingle-sets"))
        # equal sets have equal columns: whichever row of a class stays
        classes = marked.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct("text_hash", "doc_id")).alias("rep"), *[F.first(c).alias(c) for c in ("size", "fp", "prefix", "bins")])
        classes = common.materialize(classes, "classes")
        common.drop_materialized(marked)  # the prefixes, of which classes has each once
        tree = op07_simhash.components(near_links(docs, classes, few, block_rows))
        rooted = common.materialize(classes.join(tree, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "rooted")
        ids = common.materialize(rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "component-ids")
        of_class = keep(common.materialize(rooted.join(ids, F.col("root") == F.col("r")).select(F.col("sid").alias("s"), "root", "component_id"), "class-components"))
    return common.join_hot(rows, of_class, "sid", "s").select("doc_id", "text_hash", F.col("root").cast("string").alias("fingerprint"), "component_id")


def near_links(docs: DataFrame, classes: DataFrame, few: int, block_rows: int) -> DataFrame:
    """(a, b): links that join the similar classes, all verified exactly; what leads to them is deleted."""
    with common.scratch(docs.sparkSession) as keep:
        keyed = classes.select("sid", "size", "fp", F.explode("prefix").alias("key"))
        # keys that are hot in a part of the classes are hot in all; the shuffle meets no longer runs than those of the others
        part = keyed.filter(F.pmod(F.xxhash64(F.lit("part"), "sid"), F.lit(PART)) == 0)
        known = common.materialize(part.groupBy(F.col("key").alias("known")).agg(F.count("*").alias("n")).filter(F.col("n") > few).select("known"), "hot-buckets")
        known = common.small(known, SMALL)
        found = common.materialize(key_runs(keyed.join(known, F.col("key") == F.col("known"), "left_anti"), few), "key-runs")
        pairs = common.materialize(simhash_pairs(classes).unionByName(few_pairs(found)).distinct(), "near-candidates")
        crowd = common.materialize(keyed.join(known, F.col("key") == F.col("known"), "left_semi").select("key", "sid"), "hot-rows")
        members = found.filter("hot").select(F.col("a").alias("lead"), F.col("b").alias("sid"))
        grouped = common.materialize(crowds(crowd).unionByName(members).distinct(), "hot-groups")
        edges = verified(docs, classes, pair_groups(pairs, block_rows), partnered(crowd_groups(grouped, block_rows), classes))
        with common.rows_a_batch(docs.sparkSession, TEXTS):
            return keep(common.materialize(edges, "near-links"))
