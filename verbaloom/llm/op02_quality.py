"""Quality rules: base counts and robust multivariate outliers, in DataFrame functions only.

Each text's counts become a vector of transformed ratios. For each (lang, source) the minimum
covariance determinant (MCD) is sought by concentration steps: keep the `h` share of least
Mahalanobis distance, re-estimate mean and covariance on it, repeat until the determinant stays.
Two starts (mean and covariance of all; medians and quartile ranges) are run, and the end of least
determinant is taken. Scales have a floor, so ratios that are zero almost everywhere don't make
every other text an outlier. Every group's estimate is pooled with `prior` pseudo-rows of the
estimate over all texts, so small groups lean on it without a threshold. A text is rejected if its
squared distance exceeds `cutoff`.

Only one pass reads texts; its counts go to the shared folder. Vectors are then counted by cell (a
lattice of 1/UNIT), and every step aggregates cells, not rows: a source with a third of all rows has
no more cells than values. Distances are counted in logarithmic bins, so a step is one partial
aggregation to at most BINS rows a group; the subset of a step ends with the bin that reaches `h`.
Sums are whole numbers, so estimates don't depend on partitions or order.

Null lang or source form groups of their own. Null text has no words; a text without words fails
the base rule and has no vector. Repeated rows count and repeat. An empty table gives an empty
result; extra columns are ignored unless named in `keep`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import let

WORDS = r"[^\x20\x09-\x0D]+"
H, MAX_STEPS, PRIOR = 0.75, 20, 50
#: Lattice points a unit; distance bins an e-fold of 1 + 4 * d2, and their number.
UNIT, FINE, BINS = 64, 32, 1024
#: Floors of the scales in the transformed units below (a variance below the floor's square is raised
#: to it), and the median of chi-squared with as many degrees.
FLOORS, CHI2_MEDIAN = (0.08, 0.2, 0.5, 0.5), 3.357
#: Rows of cells a file, and groups whose estimates are broadcast (some 200 bytes each).
CELLS_A_FILE, BROADCAST_GROUPS, SALTS = 500_000, 100_000, 32
#: Squared distance beyond which a text is rejected: chi-squared(4) has about 1e-9 beyond it.
CUTOFF = 48.0
DIMS = range(4)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def count(hashes: Column) -> Column:
        def flagged(sorted_: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(sorted_, i)["h"] == F.get(sorted_, j)["h"], F.lit(False))
            return F.transform(sorted_, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))

        marked = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), flagged)
        positions = F.filter(marked, lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, 0).otherwise(
        let(let(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(count(h)))
    )


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    t = common.text_of()
    words = F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORDS))
    return docs.select(*keep, words.alias("w"), t.alias("t"), lines.alias("l")).select(
        *keep, F.size("w").cast("long").alias("n_words"), F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )


def vector() -> list[Column]:
    """Transformed ratios; null for a text without words."""
    n, c = F.nullif("n_words", F.lit(0)), F.nullif("word_chars", F.lit(0))
    return [F.log(c / n), F.log1p(100 * F.col("n_symbols") / c), F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n)]


def _x(i: int) -> Column:
    return F.col(f"x{i}")


PAIRS = [(i, j) for i in DIMS for j in range(i + 1)]
PARAMS = ["n", *[f"m{i}" for i in DIMS], *[f"s{i}{j}" for i, j in PAIRS], "det"]


def _sums(weight: str) -> list[Column]:
    """Whole-number sums of cells: n, first and second moments."""
    q = [F.col(f"q{i}") for i in DIMS]
    n = F.col(weight)
    return [F.sum(n).alias("n"), *[F.sum(n * q[i]).alias(f"a{i}") for i in DIMS], *[F.sum(n * q[i] * q[j]).alias(f"b{i}{j}") for i, j in PAIRS]]


def _added() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", *[f"a{i}" for i in DIMS], *[f"b{i}{j}" for i, j in PAIRS])]


def _estimate(sums: DataFrame, *keys: str) -> DataFrame:
    """Mean m, covariance s and the determinant of its floored form."""
    m = [F.col(f"a{i}") / F.col("n") / UNIT for i in DIMS]
    s = [(F.col(f"b{i}{j}") / F.col("n") / UNIT**2 - m[i] * m[j]).alias(f"s{i}{j}") for i, j in PAIRS]
    return _determined(sums.select(*keys, "n", *[x.alias(f"m{i}") for i, x in enumerate(m)], *s))


def _determined(params: DataFrame) -> DataFrame:
    kept = params.columns
    return _factor(params).withColumn("det", reduce(lambda a, i: a * F.col(f"l{i}{i}") * F.col(f"l{i}{i}"), DIMS, F.lit(1.0))).select(*kept, "det")


def _factor(groups: DataFrame) -> DataFrame:
    """Cholesky factor l of the floored covariance s, column by column."""
    for i in DIMS:
        for j in range(i + 1):
            own = F.greatest(F.col(f"s{i}{i}"), F.lit(FLOORS[i] ** 2)) if i == j else F.col(f"s{i}{j}")
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), own)  # noqa: B023
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return groups


def _distance(rows: DataFrame) -> DataFrame:
    """d2: squared Mahalanobis distance by forward substitution."""
    for i in DIMS:
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), _x(i) - F.col(f"m{i}"))  # noqa: B023
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in DIMS), F.lit(0.0))).drop(*[f"z{i}" for i in DIMS])


def _files(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // CELLS_A_FILE)))


def cells(vectors: DataFrame) -> DataFrame:
    """g, q0.. (lattice points) and n rows; the key of all texts together is empty."""
    rows = vectors.count()  # of footers
    q = [F.round(_x(i) * UNIT).cast("long").alias(f"q{i}") for i in DIMS]
    names = [f"q{i}" for i in DIMS]
    own = vectors.filter(_x(0).isNotNull()).select("g", *q).groupBy("g", *names).agg(F.count("*").alias("n"))
    own = common.materialize(_files(own, rows), "quality-cells")
    every = own.groupBy(*names).agg(F.sum("n").alias("n")).select(F.lit("").alias("g"), *names, "n")
    return own.unionByName(common.materialize(_files(every, own.count()), "quality-cells"))


def starts(table: DataFrame) -> DataFrame:
    """Two starts a group: 0 from the moments of all its rows, 1 from medians and quartile ranges."""
    moments = _estimate(table.groupBy("g").agg(*_sums("n")), "g")
    values = table.select("g", "n", F.posexplode(F.array(*[F.col(f"q{i}") for i in DIMS])).alias("d", "q")).groupBy("g", "d", "q").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("g", "d").orderBy("q")
    ranked = values.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("g", "d"))})
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("q"))) / UNIT
    spread = ranked.groupBy("g", "d").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"), F.max("all").alias("n"))
    one = lambda c, i: F.max(F.when(F.col("d") == i, F.col(c)))
    medians = spread.groupBy("g").agg(F.max("n").alias("n"), *[one("m", i).alias(f"m{i}") for i in DIMS], *[F.pow(one("s", i), 2).alias(f"s{i}{i}") for i in DIMS])
    medians = medians.withColumns({f"s{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j})
    robust = _determined(medians.select("g", *PARAMS[:-1]))
    return moments.withColumn("start", F.lit(0)).unionByName(robust.withColumn("start", F.lit(1)))


def _with(rows: DataFrame, params: DataFrame, broadcast: bool) -> DataFrame:
    """Rows beside their group's parameters (null without); beyond a broadcast, groups are dealt over
    salts."""
    own = params.withColumnRenamed("g", "pg")
    if broadcast:
        return rows.join(F.broadcast(own), F.col("g") == F.col("pg"), "left").drop("pg")
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("own_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(own, (F.col("g") == F.col("pg")) & (F.col("own_salt") == F.col("salt")), "left").drop("pg", "salt", "own_salt")


def _binned(table: DataFrame, params: DataFrame, broadcast: bool) -> DataFrame:
    """Cells beside their parameters with the bin of their distance."""
    points = table.withColumnRenamed("n", "w").withColumns({f"x{i}": F.col(f"q{i}") / UNIT for i in DIMS})
    found = _distance(_with(points, _factor(params), broadcast))
    return found.withColumn("bin", F.least(F.floor(F.log1p(4 * F.col("d2")) * FINE), F.lit(BINS - 1)).cast("int"))


def step(table: DataFrame, params: DataFrame, h: float, broadcast: bool) -> DataFrame:
    """A concentration step for every (g, start); `moved` tells whether the determinant fell."""
    known = params.select("g", "start", *PARAMS[1:])
    sums = _binned(table, known, broadcast).groupBy("g", "start", "bin").agg(*_sums("w"), F.first("det").alias("old"))
    key = Window.partitionBy("g", "start")
    inside = sums.withColumns({"upto": F.sum("n").over(key.orderBy("bin")), "all": F.sum("n").over(key)}).filter(F.col("upto") - F.col("n") < h * F.col("all"))
    added = inside.groupBy("g", "start").agg(*_added(), F.first("old").alias("old"))
    return _estimate(added, "g", "start", "old").withColumn("moved", F.col("det") < F.col("old") * (1 - 1e-6)).drop("old")


def pooled(best: DataFrame, sizes: DataFrame, prior: int) -> DataFrame:
    """Each group's estimate pooled with `prior` pseudo-rows of the estimate over all texts."""
    every = best.filter("g = ''").select(*[F.col(c).alias(f"e_{c}") for c in PARAMS if c not in ("n", "det")])
    both = best.join(sizes.withColumnRenamed("g", "sg"), F.col("g") == F.col("sg")).crossJoin(F.broadcast(every))  # every: one row
    w = F.col("size") / (F.col("size") + prior)
    gap = [F.col(f"m{i}") - F.col(f"e_m{i}") for i in DIMS]
    m = [(F.col(f"e_m{i}") + w * gap[i]).alias(f"m{i}") for i in DIMS]
    s = [(w * F.col(f"s{i}{j}") + (1 - w) * F.col(f"e_s{i}{j}") + w * (1 - w) * gap[i] * gap[j]).alias(f"s{i}{j}") for i, j in PAIRS]
    return both.select("g", *m, *s)


def estimates(vectors: DataFrame, h: float = H, max_steps: int = MAX_STEPS, prior: int = PRIOR) -> tuple[DataFrame, bool]:
    """Per group key g: mean m, Cholesky factor l of the pooled MCD covariance, consistency factor
    c; and whether there are few enough groups to broadcast. vectors: g, x0.. (g never null or empty);
    without any vector there is no row."""
    table = cells(vectors)
    params = common.materialize(starts(table).coalesce(1), "mcd-start")
    groups = params.count() // 2
    few = groups <= BROADCAST_GROUPS
    sizes = params.filter("start = 0").select("g", F.col("n").alias("size"))
    done = max_steps if groups else 0
    while done:
        params = common.materialize(_files(step(table, params, h, few), 2 * groups), "mcd-step")
        done = done - 1 if not params.filter("moved").isEmpty() else 0
    best = params.groupBy("g").agg(F.min_by(F.struct(*PARAMS), F.struct("det", "start")).alias("b")).select("g", "b.*")
    final = common.materialize(_files(pooled(best, sizes, prior), groups), "mcd-pooled")
    bins = _binned(table, final, few).groupBy("g", "bin").agg(F.sum("w").alias("n"))
    key = Window.partitionBy("g")
    half = bins.withColumns({"upto": F.sum("n").over(key.orderBy("bin")), "all": F.sum("n").over(key)}).filter(2 * F.col("upto") >= F.col("all"))
    mid = half.groupBy(F.col("g").alias("mg")).agg((F.expm1((F.min("bin") + 0.5) / FINE) / 4).alias("d2"))
    # never below 1: floored scales must not be shrunk again
    c = F.greatest(F.col("d2") / CHI2_MEDIAN, F.lit(1.0)).alias("c")
    factors = _factor(final).join(mid, F.col("g") == F.col("mg")).select("g", *[f"m{i}" for i in DIMS], *[f"l{i}{j}" for i, j in PAIRS], c)
    return common.materialize(_files(factors, groups), "mcd"), few


def quality(docs: DataFrame, cutoff: float = CUTOFF, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, d2 (null without a vector) and kept; keep names columns
    of docs to carry along."""
    carried = [F.col(c).alias(f"keep_{c}") for c in keep]
    key = F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))
    prepared = docs.select(F.col("doc_id").alias("id"), "text", key.alias("g"), *carried)
    stats = base_counts(prepared, "id", "g", *[f"keep_{c}" for c in keep])
    stats = common.materialize(stats.withColumns({f"x{i}": v for i, v in enumerate(vector())}), "quality-counts")
    params, few = estimates(stats.select("g", *[f"x{i}" for i in DIMS]))
    scored = _distance(_with(stats, params, few)).withColumn("d2", F.col("d2") / F.col("c"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"), "d2", *[F.col(f"keep_{c}").alias(c) for c in keep if c != "doc_id"],
    )


def op2_quality(spark, sf_dir) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"))
