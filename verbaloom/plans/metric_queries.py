"""Queries on tokens per language: frequencies, fertility, balance, vocabularies, search.

Tokens here are white space pieces, so that each query has a SQL form; the BPE forms of the same
operators are in bpe_queries. A language's own vocabulary is its 300 most frequent pieces, the final
vocabulary the union of the first 150 of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.functions import pieces as P
from verbaloom.functions import text as T
from verbaloom.operators import bpe, ordering, search
from verbaloom.operators import metrics as M
from verbaloom.sources.tables import languages
from verbaloom.storage import materialize

from .text_queries import _PIECE_ROWS, LANGS, PIECES, QUERIES, SQL, UNITS, WORDS, docs, norm, query

__all__ = ["QUERIES", "SQL"]

TARGET, OWN, FINAL = "de", 300, 150
FREQ = f"freq AS MATERIALIZED (SELECT lang, piece, count(*) AS n FROM {_PIECE_ROWS} GROUP BY ALL)"
COUNTS = f"counts AS (SELECT lang, CAST(sum(len({PIECES})) AS BIGINT) AS tokens, CAST(sum({UNITS}) AS BIGINT) AS denom FROM documents GROUP BY lang)"
RATIOS = f"{COUNTS}, ratios AS (SELECT *, tokens / denom AS ratio FROM counts)"
VOCAB = f"{FREQ}, ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, piece) AS r FROM freq), vocab AS (SELECT lang, piece AS token FROM ranked WHERE r <= {OWN}), final AS (SELECT DISTINCT piece AS token FROM ranked WHERE r <= {FINAL})"
CHARS = "(SELECT lang, n, list_filter(string_split(piece, ''), lambda c: c <> '') AS s FROM freq)"


def freq(s, d) -> DataFrame:
    return bpe.word_table(docs(s, d), P.white_space, P.nfc)  # NFC changes no boundary of pieces


def counts(s, d) -> DataFrame:
    """lang, tokens, denom. Additive over documents, so one pass and one row a language and task."""
    raw = docs(s, d)
    t = F.col("text")
    pieces = F.size(F.filter(F.split(t, T.WS + "+"), lambda x: x != ""))  # NFC doesn't change the number
    return raw.groupBy("lang").agg(F.sum(pieces).alias("tokens"), F.sum(T.faithful_units(t)).alias("denom"))


def ratios(s, d) -> DataFrame:
    return M.fertility(counts(s, d))


def ranked(s, d) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "piece"))
    return freq(s, d).withColumn("r", r).filter(F.col("r") <= OWN)


def vocab(s, d) -> DataFrame:
    return ranked(s, d).select("lang", F.col("piece").alias("token"))


def final(s, d) -> DataFrame:
    return ranked(s, d).filter(F.col("r") <= FINAL).select(F.col("piece").alias("token")).distinct()


def stream(s, d) -> DataFrame:
    return norm(s, d).select("lang", "doc_id", F.posexplode(T.pieces(F.col("text"))).alias("pos", "token"))


STREAM = f"stream AS (SELECT lang, doc_id, CAST(i - 1 AS INTEGER) AS pos, x[i] AS token FROM (SELECT lang, doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT lang, doc_id, {PIECES} AS x FROM documents)))"

query("word_freq", f"WITH {FREQ} SELECT * FROM freq")(freq)
query("weighted_word_freq", f"WITH {FREQ} SELECT piece, CAST(sum(n * weight) AS BIGINT) AS n FROM freq JOIN {LANGS} USING (lang) GROUP BY piece")(lambda s, d: bpe.weighted(freq(s, d), languages(s)))
query("pair_counts", f"WITH {FREQ} SELECT lang, s[i] AS left, s[i + 1] AS right, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, n, s, unnest(range(1, len(s))) AS i FROM {CHARS}) GROUP BY ALL")(lambda s, d: bpe.pair_counts(freq(s, d), bpe.symbols(), "lang"))


@query("pair_counts_lead", f"WITH {FREQ} SELECT lang, s[i] AS left, s[i + 1] AS right, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, n, s, unnest(range(1, len(s))) AS i FROM {CHARS}) GROUP BY ALL")
def pair_counts_lead(s, d):
    """The window form of pair_counts: the next symbol of the same word."""
    rows = freq(s, d).select("lang", "piece", "n", F.posexplode(bpe.symbols()).alias("pos", "left"))
    right = F.lead("left").over(Window.partitionBy("lang", "piece").orderBy("pos"))
    return rows.withColumn("right", right).filter("right is not null").groupBy("lang", "left", "right").agg(F.sum("n").alias("n"))


@query("best_pair", f"WITH {FREQ}, pairs AS (SELECT lang, s[i] AS left, s[i + 1] AS right, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, n, s, unnest(range(1, len(s))) AS i FROM {CHARS}) GROUP BY ALL) SELECT lang, \"left\", \"right\", n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, \"left\", \"right\") AS r FROM pairs) WHERE r = 1")
def best_pair(s, d):
    pairs = bpe.pair_counts(freq(s, d), bpe.symbols(), "lang")
    top = F.min(F.struct((-F.col("n")).alias("m"), "left", "right")).alias("b")
    return pairs.groupBy("lang").agg(top).select("lang", "b.left", "b.right", (-F.col("b.m")).alias("n"))


query("units_by_lang", f"SELECT lang, CAST(sum({UNITS}) AS BIGINT) AS n_units FROM documents GROUP BY lang")(lambda s, d: docs(s, d).groupBy("lang").agg(F.sum(T.faithful_units(F.col("text"))).alias("n_units")))
query("words_by_lang", f"SELECT lang, CAST(sum(len({WORDS})) AS BIGINT) AS n_words FROM documents GROUP BY lang")(lambda s, d: norm(s, d).groupBy("lang").agg(F.sum(F.size(T.words(F.col("text")))).alias("n_words")))
query("fertility", f"WITH {RATIOS} SELECT * FROM ratios")(ratios)
query("spread", f"WITH {RATIOS} SELECT max(ratio) - min(ratio) AS spread FROM ratios")(lambda s, d: ratios(s, d).agg((F.max("ratio") - F.min("ratio")).alias("spread")))
query("balance_score", f"WITH {RATIOS} SELECT max(ratio) - min(ratio) AS spread, 1000 / nullif(max(ratio) - min(ratio), 0) AS score FROM ratios")(lambda s, d: M.balance(ratios(s, d)))
query("balance_score_rounded", f"WITH {RATIOS}, x AS (SELECT round(max(round(ratio, 4)) - min(round(ratio, 4)), 4) AS spread FROM ratios) SELECT spread, round(1000 / nullif(spread, 0), 2) AS score FROM x")(lambda s, d: M.balance(ratios(s, d), 4))
query("adjusted_score", f"WITH {RATIOS}, x AS (SELECT 1000 / nullif(max(ratio) - min(ratio), 0) AS score, exp(greatest(0, max(ratio) FILTER (lang = '{TARGET}') / 1.2 - 1)) AS penalty FROM ratios) SELECT *, score / penalty AS adjusted_score FROM x")(lambda s, d: M.adjusted(ratios(s, d), TARGET))
query("penalty", f"WITH {RATIOS} SELECT lang, exp(greatest(0, 2 * ratio / 1.2 - 1)) AS penalty FROM ratios")(lambda s, d: ratios(s, d).select("lang", T.penalty(2 * F.col("ratio")).alias("penalty")))
query("threshold_check", f"WITH {RATIOS} SELECT bool_and(ratio < 1.2) AS below FROM ratios")(lambda s, d: ratios(s, d).agg(F.bool_and(F.col("ratio") < 1.2).alias("below")))
query("sorted_ratios", f"WITH {RATIOS} SELECT lang, ratio, row_number() OVER (ORDER BY ratio, lang) AS rank FROM ratios")(lambda s, d: ratios(s, d).select("lang", "ratio", F.row_number().over(Window.orderBy("ratio", "lang")).alias("rank")))
query("minmax_tags", f"WITH {RATIOS} SELECT lang, ratio, CASE WHEN row_number() OVER (ORDER BY ratio DESC, lang DESC) = 1 THEN 'X_max' WHEN row_number() OVER (ORDER BY ratio, lang) = 1 THEN 'X_min' END AS tag FROM ratios")(lambda s, d: M.minmax(ratios(s, d)))
query("fertility_bars", f"WITH {RATIOS} SELECT lang, ratio / (max(ratio) OVER () * 1.08) * 100 AS pct FROM ratios")(lambda s, d: ratios(s, d).select("lang", (F.col("ratio") / (F.max("ratio").over(Window.partitionBy()) * 1.08) * 100).alias("pct")))


@query("top_tokens", f"WITH {STREAM}, c AS (SELECT lang, token, count(*) AS n, min((doc_id, pos)) AS first_at FROM stream GROUP BY ALL) SELECT lang, CAST(r AS INTEGER) AS rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_at) AS r FROM c) WHERE r <= 30")
def top_tokens(s, d):
    return M.top_tokens(stream(s, d).select("lang", "token", F.struct("doc_id", "pos").alias("at")))


@query("type_token", f"WITH {FREQ} SELECT lang, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(*) / sum(n) AS ratio FROM freq GROUP BY lang")
def type_token(s, d):
    return freq(s, d).groupBy("lang").agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).withColumn("ratio", F.col("types") / F.col("tokens"))


@query("type_token_sketched")
def type_token_sketched(s, d):
    """Distinct types by mergeable sketches: one a language and source, written, then rolled up by language."""
    texts = T.nfc_texts(docs(s, d).select("lang", "source", "text"))
    pieces = texts.select("lang", "source", F.explode(T.pieces(T.collapse(F.col("text")))).alias("piece"))
    stored = materialize(M.type_sketches(pieces, "piece", "lang", "source"), "type-sketches")
    return M.rolled_up(stored, "lang")


_OWN = f"WITH {VOCAB}, hits AS (SELECT f.lang, f.piece AS token, n, v.token IS NOT NULL AS hit FROM freq f LEFT JOIN vocab v ON f.lang = v.lang AND f.piece = v.token)"
# measured against the English vocabulary, so that own and borrowed both occur
query("own_borrowed", f"WITH {VOCAB} SELECT f.lang, CAST(sum(CASE WHEN v.token IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS own, CAST(sum(CASE WHEN v.token IS NULL THEN n ELSE 0 END) AS BIGINT) AS borrowed FROM freq f LEFT JOIN vocab v ON f.lang = v.lang AND f.piece = v.token GROUP BY f.lang")(
    lambda s, d: M.own_borrowed(freq(s, d).withColumnRenamed("piece", "token"), vocab(s, d))
)
query("own_tokens_semi", f"{_OWN} SELECT lang, token, n FROM hits WHERE hit")(lambda s, d: freq(s, d).withColumnRenamed("piece", "token").join(vocab(s, d), ["lang", "token"], "left_semi"))
query("borrowed_tokens_anti", f"{_OWN} SELECT lang, token, n FROM hits WHERE NOT hit")(lambda s, d: freq(s, d).withColumnRenamed("piece", "token").join(vocab(s, d), ["lang", "token"], "left_anti"))
query("vocab_overlap", f"WITH {VOCAB} SELECT token FROM vocab GROUP BY token HAVING count(DISTINCT lang) = 4")(lambda s, d: M.overlap(vocab(s, d), 4))
query("vocab_allocation", f"WITH {VOCAB} SELECT lang, count(*) AS n FROM vocab WHERE token IN (SELECT token FROM final) GROUP BY lang")(lambda s, d: M.allocation(vocab(s, d), final(s, d)))
query("overlap_examples", f"WITH {VOCAB} SELECT token FROM vocab GROUP BY token HAVING count(DISTINCT lang) >= 2 ORDER BY token LIMIT 30")(lambda s, d: vocab(s, d).groupBy("token").agg(F.count_distinct("lang").alias("k")).filter("k >= 2").select("token").orderBy("token").limit(30))
query("exclusive_tokens", f"WITH {VOCAB} SELECT token FROM vocab WHERE lang = 'en' EXCEPT SELECT token FROM vocab WHERE lang <> 'en'")(lambda s, d: vocab(s, d).filter("lang = 'en'").select("token").subtract(vocab(s, d).filter("lang <> 'en'").select("token")))
query("combined_alphabet", "SELECT DISTINCT unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS ch FROM documents")(lambda s, d: bpe.alphabet(docs(s, d)))


@query("alphabet_ids", "WITH a AS (SELECT DISTINCT lang, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS ch FROM documents) SELECT lang, ch, row_number() OVER (PARTITION BY lang ORDER BY ch) AS id FROM a")
def alphabet_ids(s, d):
    """Ids behind one special: dense from 1 in code point order."""
    return bpe.alphabet(docs(s, d), "lang").select("lang", "ch", F.row_number().over(Window.partitionBy("lang").orderBy("ch")).cast("long").alias("id"))


@query("lang_summary", f"WITH {RATIOS} SELECT lang, name, weight, tokens, denom, ratio FROM ratios JOIN {LANGS} USING (lang)")
def lang_summary(s, d):
    return ratios(s, d).join(F.broadcast(languages(s)), "lang").select("lang", "name", "weight", "tokens", "denom", "ratio")


@query("weight_grid", "SELECT row_number() OVER (ORDER BY en, de, fr, es) - 1 AS combo, en, de, fr, es FROM (SELECT unnest(range(1, 9)) AS en), (SELECT unnest(range(1, 9)) AS de), (SELECT unnest(range(1, 9)) AS fr), (SELECT unnest(range(1, 9)) AS es)")
def weight_grid(s, d):
    """All weights 1..8 of four languages, numbered in lexicographic order."""
    one = lambda k: s.range(1, 9).withColumnRenamed("id", k)
    grid = one("en").crossJoin(one("de")).crossJoin(one("fr")).crossJoin(one("es"))
    return grid.select((((F.col("en") - 1) * 8 + F.col("de") - 1) * 64 + (F.col("fr") - 1) * 8 + F.col("es") - 1).alias("combo"), "en", "de", "fr", "es")


def capped_words(s, d) -> DataFrame:
    """(lang, token) of the first 3,000 words of a language. Word counts a document, in order over range
    partitions, give each document's start, so only documents that reach into the cap are split into words."""
    texts = norm(s, d).select("lang", "doc_id", "text")
    sized = materialize(texts.select("lang", "doc_id", F.size(T.pieces(F.col("text"))).cast("long").alias("k")).filter("k > 0"), "word-counts")
    need = ordering.capped(ordering.placed(sized, "lang", "doc_id", tag="ordered-counts"), ["lang"], "k", T.WORD_CAP)
    need = F.broadcast(need.select("lang", "doc_id", "before"))  # at most the cap of documents a language
    left = (F.lit(T.WORD_CAP) - F.col("before")).cast("int")
    return texts.join(need, ["lang", "doc_id"]).select("lang", F.explode(F.slice(T.pieces(F.col("text")), F.lit(1), left)).alias("token"))


@query("capped_corpus", f"WITH {STREAM} SELECT lang, count(*) AS n, count(DISTINCT token) AS types, CAST(sum(length(token)) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS r FROM stream) WHERE r <= {T.WORD_CAP} GROUP BY lang")
def capped_corpus(s, d):
    return capped_words(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("token").alias("types"), F.sum(F.char_length("token")).alias("chars"))


@query("weighted_round_robin", f"WITH {VOCAB}, r2 AS (SELECT l.ord, ranked.lang, piece, r, (r - 1) // weight AS round FROM ranked JOIN {LANGS} USING (lang) WHERE r <= {OWN}) SELECT lang, piece, row_number() OVER (ORDER BY round, ord, r) AS turn FROM r2")
def weighted_round_robin(s, d):
    """The order of turns when none is skipped: a language takes `weight` words a round."""
    rows = ranked(s, d).join(F.broadcast(languages(s)), "lang").withColumn("round", F.floor((F.col("r") - 1) / F.col("weight")))
    return rows.select("lang", "piece", F.row_number().over(Window.orderBy("round", "ord", "r")).cast("long").alias("turn"))


@query("corpus_replication", f"SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents JOIN {LANGS} USING (lang), (SELECT unnest(range(1, 9)) AS k) WHERE k <= weight GROUP BY lang")
def corpus_replication(s, d):
    """Texts repeated by weight, as counts: see weighted_word_freq for why no row is repeated."""
    sums = docs(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("c"))
    return sums.join(F.broadcast(languages(s)), "lang").select("lang", (F.col("n") * F.col("weight")).alias("n_docs"), (F.col("c") * F.col("weight")).alias("chars"))


@query("vocab_search", f"WITH {FREQ} SELECT DISTINCT piece FROM freq WHERE contains(lower(piece), lower(trim(' The ')))")
def vocab_search(s, d):
    return freq(s, d).filter(F.contains(F.lower("piece"), F.lower(F.trim(F.lit(" The "))))).select("piece").distinct()


@query("stream_search", f"WITH {STREAM} SELECT lang, doc_id, pos, token FROM stream WHERE lang = 'en' AND contains(lower(token), 'th') ORDER BY doc_id, pos LIMIT 4000")
def stream_search(s, d):
    hits = stream(s, d).filter("lang = 'en'").filter(F.contains(F.lower("token"), F.lit("th")))
    return hits.orderBy("doc_id", "pos").limit(4000)


def _indexed(s, d) -> search.Index:
    return search.build(bpe.places(docs(s, d), P.white_space, P.nfc))


query("vocab_search_indexed", SQL["vocab_search"])(lambda s, d: _indexed(s, d).tokens(" The ").select(F.col("token").alias("piece")))


@query("stream_search_indexed", SQL["stream_search"])
def stream_search_indexed(s, d):
    """stream_search by an index of n-grams: only the places of tokens that match are read."""
    return _indexed(s, d).places("th", F.col("lang") == "en").orderBy("doc_id", "pos").limit(4000)


@query("script_membership", "SELECT lang, ch, CASE WHEN regexp_matches(ch, '\\p{Latin}') THEN 'Latin' WHEN regexp_matches(ch, '\\p{Devanagari}') THEN 'Devanagari' WHEN regexp_matches(ch, '\\p{Telugu}') THEN 'Telugu' END AS script FROM (SELECT DISTINCT lang, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS ch FROM documents)")
def script_membership(s, d):
    """The script of each character of a language's alphabet; null: another one, or none."""
    return bpe.alphabet(docs(s, d), "lang").select("lang", "ch", T.script(F.col("ch")).alias("script"))
