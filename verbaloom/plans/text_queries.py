"""Queries on texts, pages and events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions import text as T
from verbaloom.operators import html as H
from verbaloom.sources.tables import DEFAULT_TRAIN_SIZE, LANGUAGES, languages, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# the same classes in the SQL dialect's escapes
WS, WS_UNI = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]", r"[\s\x{0b}\x{85}\p{Z}]"
UNIT = r"[\p{L}\p{M}\p{N}]+|[^\s\x{0b}\x{85}\p{Z}\p{L}\p{M}\p{N}]"
NORM = f"trim(regexp_replace(nfc_normalize(text), '{WS}+', ' ', 'g'))"
PIECES = f"list_filter(string_split({NORM}, ' '), lambda x: x <> '')"
def edge_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[^{T.WORD_CHAR}]+|[^{T.WORD_CHAR}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"



WORDS = f"list_filter(list_transform({PIECES}, lambda x: {edge_sql('x')}), lambda x: x <> '')"
UNITS = f"len(regexp_extract_all(text, '{UNIT}'))"
LANGS = "(VALUES " + ", ".join(f"({i}, '{k}', '{n}', {w}, CAST({s or 'NULL'} AS INTEGER))" for i, (k, n, w, s) in enumerate(LANGUAGES)) + ") AS l(ord, lang, name, weight, train_size)"
HOST, BASE = "https://site.example.org", "https://site.example.org/page/"
POLICY = "letter, mark and number runs and single visible symbols"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text: normalized."""
    return T.nfc_texts(docs(spark, sf_dir).select("doc_id", "lang", "text")).withColumn("text", T.collapse(F.col("text")))


def per_doc(name: str, alias: str, sql: str, column, source=docs) -> None:
    """A query of one derived value a document."""
    query(name, f"SELECT doc_id, {sql} AS {alias} FROM documents")(lambda s, d: source(s, d).select("doc_id", column(F.col("text")).alias(alias)))


def per_item(name: str, alias: str, sql: str, column, source=docs) -> None:
    """A query of an array's items with their positions."""
    query(name, f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, x[i] AS {alias} FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, {sql} AS x FROM documents))")(
        lambda s, d: source(s, d).select("doc_id", F.posexplode(column(F.col("text"))).alias("pos", alias))
    )


per_doc("scan_documents", "text", "replace(text, chr(13) || chr(10), chr(10))", lambda t: F.replace(t, F.lit("\r\n"), F.lit("\n")))
per_doc("normalize_text", "text", NORM, lambda t: t, norm)
per_doc("word_count", "n_words", f"len({WORDS})", lambda t: F.size(T.words(t)), norm)
per_doc("capped_words", "text", f"array_to_string(({PIECES})[1:{T.WORD_CAP}], ' ')", lambda t: F.array_join(F.slice(T.pieces(t), 1, T.WORD_CAP), " "), norm)
per_doc("faithful_units", "n_units", UNITS, T.faithful_units)
per_doc("first_sentence", "sentence", f"coalesce(list_filter(string_split(regexp_replace({NORM}, '([।.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) BETWEEN 40 AND 200)[1], substr({NORM}, 1, 200))", T.first_sentence, norm)
per_doc("sample_line", "line", f"coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip_sql('s')}), lambda s: length(s) BETWEEN 60 AND 160 AND regexp_matches(s, '\\p{{L}}') AND NOT regexp_matches(s, '^[#\\-|!]'))[1], substr({strip_sql('text')}, 1, 160))", T.sample_line)
per_doc("char_length", "n_chars", "length(text)", F.char_length)
per_doc("visible_text", "text", f"regexp_replace(text, '{WS_UNI}', '', 'g')", T.visible)
# the tables hold no citation marks, NBSP or newline runs: the queries put some in
per_doc("strip_citations", "text", r"regexp_replace(replace(text, '. ', '[1]. '), '\[[^\]\n]{1,15}\]', '', 'g')", lambda t: T.strip_citations(F.replace(t, F.lit(". "), F.lit("[1]. "))))
_MARKED = "replace(replace(text, '. ', '.' || chr(160) || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || chr(10)), ', ', ',  ' || chr(10))"
per_doc(
    "normalize_markdown", "text",
    strip_sql(rf"regexp_replace(regexp_replace(replace({_MARKED}, chr(160), ' '), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g')") + " || chr(10)",
    lambda t: T.normalize_markdown(F.replace(F.replace(t, F.lit(". "), F.lit(".\u00a0\n\n \n\n\n\n")), F.lit(", "), F.lit(",  \n"))),
)
per_doc("decode_tokens", "text", f"replace(array_to_string(regexp_extract_all(replace(text, ' ', '{T.MARK}'), '{T.MARK}[^{T.MARK}]*|[^{T.MARK}]+'), ''), '{T.MARK}', ' ')", lambda t: T.decode_metaspace(T.metaspace(t)))
per_item("split_words", "piece", PIECES, T.pieces, norm)
per_item("words", "word", WORDS, T.words, norm)
per_item("pretokenize_ws", "piece", f"list_filter(regexp_split_to_array(text, '{WS_UNI}+'), lambda x: x <> '')", lambda t: F.filter(F.split(t, T.WS_UNI + "+"), lambda x: x != ""))
per_item("pretokenize_metaspace", "piece", f"regexp_extract_all(replace(text, ' ', '{T.MARK}'), '{T.MARK}[^{T.MARK}]*|[^{T.MARK}]+')", T.metaspace)

_PIECE_ROWS = f"(SELECT doc_id, lang, unnest({PIECES}) AS piece FROM documents)"


@query("strip_edge_punct", f"SELECT DISTINCT piece, {edge_sql('piece')} AS word FROM {_PIECE_ROWS}")
def strip_edge_punct(s, d):
    rows = norm(s, d).select(F.explode(F.array_distinct(T.pieces(F.col("text")))).alias("piece")).distinct()
    return rows.select("piece", T.strip_edges(F.col("piece")).alias("word"))


@query("unit_classes", f"SELECT lang, CASE WHEN regexp_matches(u, '^[\\p{{L}}\\p{{M}}\\p{{N}}]') THEN 'run' ELSE 'symbol' END AS kind, count(*) AS n, count(DISTINCT u) AS types FROM (SELECT lang, unnest(regexp_extract_all(text, '{UNIT}')) AS u FROM documents) GROUP BY ALL")
def unit_classes(s, d):
    # counting by unit first makes the distinct count a second pass over types
    by_unit = docs(s, d).select("lang", F.explode(T.units(F.col("text"))).alias("u")).groupBy("lang", "u").agg(F.count("*").alias("n"))
    kind = F.when(F.col("u").rlike(r"^[\p{L}\p{M}\p{N}]"), "run").otherwise("symbol")
    return by_unit.groupBy("lang", kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))


@query("alphabet", "SELECT DISTINCT lang, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS ch FROM documents")
def alphabet(s, d):
    from verbaloom.operators.bpe import alphabet as letters

    return letters(docs(s, d), "lang")


@query("display_token", f"SELECT DISTINCT piece, replace(replace(replace(replace(replace(replace(piece, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), ' ', '·'), '{T.MARK}', '·') AS shown FROM (SELECT unnest(regexp_extract_all(replace(text, ' ', '{T.MARK}'), '{T.MARK}[^{T.MARK}]*|[^{T.MARK}]+')) AS piece FROM documents)")
def display_token(s, d):
    rows = docs(s, d).select(F.explode(F.array_distinct(T.metaspace(F.col("text")))).alias("piece")).distinct()
    return rows.select("piece", T.display_token(F.col("piece")).alias("shown"))


@query("display_counts", "SELECT lang, format('{:,}', CAST(sum(length(text)) AS BIGINT)) AS chars FROM documents GROUP BY lang")
def display_counts(s, d):
    return docs(s, d).groupBy("lang").agg(F.format_number(F.sum(F.char_length("text")), 0).alias("chars"))


@query("parse_merges", f"SELECT DISTINCT piece, substr(piece, 1, 1) AS left, substr(piece, 2) AS right FROM {_PIECE_ROWS} WHERE length(piece) > 1")
def parse_merges(s, d):
    """Merge strings "a b" (here: first character and the rest of each piece) to pairs."""
    rows = norm(s, d).select(F.explode(F.array_distinct(T.pieces(F.col("text")))).alias("piece")).distinct().filter(F.char_length("piece") > 1)
    text = F.concat(F.substring("piece", 1, 1), F.lit(" "), F.substring("piece", 2, F.lit(2**31 - 1)))
    return rows.select("piece", F.split_part(text, F.lit(" "), F.lit(1)).alias("left"), F.split_part(text, F.lit(" "), F.lit(2)).alias("right"))


@query("scan_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def scan_pages(s, d):
    return table(s, d, "pages").select("page_id", "url", F.char_length("html").alias("n_chars"))


@query("scan_props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scan_props_json(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_timestamp(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("wiki_url", f"SELECT p_partkey, '{BASE}' || replace(url_encode(p_name), '%2F', '/') AS url, '{BASE}' || p_name AS readable FROM part")
def page_url(s, d):
    return table(s, d, "part").select("p_partkey", F.concat(F.lit(BASE), T.url_quote(F.col("p_name"))).alias("url"), F.concat(F.lit(BASE), F.col("p_name")).alias("readable"))


@query("language_dim", f"SELECT * FROM {LANGS}")
def language_dim(s, d):
    return languages(s)


@query("train_size_lookup", f"SELECT lang, coalesce(train_size, {DEFAULT_TRAIN_SIZE}) AS train_size, n_docs FROM {LANGS} JOIN (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang) USING (lang)")
def train_size_lookup(s, d):
    counts = docs(s, d).groupBy("lang").agg(F.count("*").alias("n_docs"))
    return counts.join(F.broadcast(languages(s)), "lang").select("lang", F.coalesce("train_size", F.lit(DEFAULT_TRAIN_SIZE)).alias("train_size"), "n_docs")


@query("corpus_metadata", f"SELECT lang, name AS title, '{BASE}' || lang AS source_url, 'documents' AS variant, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({UNITS}) AS BIGINT) AS faithful_units, '{POLICY}' AS unit_policy FROM documents JOIN {LANGS} USING (lang) GROUP BY ALL")
def corpus_metadata(s, d):
    t = F.col("text")
    sums = docs(s, d).groupBy("lang").agg(F.sum(F.char_length(t)).alias("chars"), F.sum(T.faithful_units(t)).alias("faithful_units"))
    return sums.join(F.broadcast(languages(s)), "lang").select("lang", F.col("name").alias("title"), F.concat(F.lit(BASE), "lang").alias("source_url"), F.lit("documents").alias("variant"), "chars", "faithful_units", F.lit(POLICY).alias("unit_policy"))


# pages -------------------------------------------------------------------------------------------

_N_P = r"len(regexp_extract_all({}, '<p[ >]'))"


@query("html_main_block", f"""
WITH c AS (SELECT page_id, 0 AS o, 'article' AS tag, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS part FROM pages UNION ALL SELECT page_id, 1, 'body', regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1) FROM pages),
n AS (SELECT *, {_N_P.format('part')} AS n_p FROM c)
SELECT page_id, tag, n_p, length(part) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n_p DESC, o) AS r FROM n) WHERE r = 1""")
def html_main_block(s, d):
    """Of article and body, the one with most paragraphs; the article wins ties."""
    one = lambda tag, rx, o: F.struct(F.size(F.regexp_extract_all(F.regexp_extract("html", rx, 1), F.lit("<p[ >]"), F.lit(0))).alias("n_p"), F.lit(-o).alias("o"), F.lit(tag).alias("tag"), F.char_length(F.regexp_extract("html", rx, 1)).alias("n_chars"))
    best = F.greatest(one("article", "(?s)<article[^>]*>(.*?)</article>", 0), one("body", "(?s)<body[^>]*>(.*)</body>", 1))
    return table(s, d, "pages").select("page_id", best.alias("b")).select("page_id", "b.tag", "b.n_p", "b.n_chars")


def _paired(x: str) -> str:
    for tag in ("script", "style", "table", "figure"):
        x = f"regexp_replace({x}, '(?s)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    return x


@query("html_strip_noise", f"SELECT page_id, {_paired('html')} AS html FROM pages")
def html_strip_noise(s, d):
    h = F.col("html")
    for tag in ("script", "style", "table", "figure"):
        h = F.regexp_replace(h, rf"(?s)<{tag}\b[^>]*>.*?</{tag}>", "")
    return table(s, d, "pages").select("page_id", h.alias("html"))


@query("links_absolutized", f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, './') THEN '{BASE}' || substr(h, 3) WHEN starts_with(h, '/') THEN '{HOST}' || h ELSE h END AS link
FROM (SELECT page_id, i, hrefs[i] AS h FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM pages)))""")
def links_absolutized(s, d):
    hrefs = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(s, d, "pages").select("page_id", F.posexplode(hrefs).alias("pos", "h")).select("page_id", "pos", T.absolute_link(F.col("h"), HOST, BASE).alias("link"))


query("html_blocks")(lambda s, d: H.html_blocks(table(s, d, "pages")))


# the tables hold no category links: the query puts one at the end of each article
@query("html_category_lines", "SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, 'Category: ./C' || page_id AS line FROM (SELECT page_id, unnest(range(1, len(regexp_extract_all(html, '</article>')) + 1)) AS i FROM pages)")
def html_category_lines(s, d):
    link = F.concat(F.lit('<link rel="mw:PageProp/Category" href="./C'), F.col("page_id").cast("string"), F.lit('"></article>'))
    return H.category_lines(table(s, d, "pages").withColumn("html", F.replace("html", F.lit("</article>"), link)))


query("html_to_markdown")(lambda s, d: H.to_markdown(table(s, d, "pages"), HOST, BASE))


@query("clean_html")
def clean_html(s, d):
    text = H.block_text(table(s, d, "pages")).withColumn("text", T.strip_citations(F.col("text")))
    return T.nfc_texts(text).select("page_id", T.collapse(F.col("text")).alias("text"))


@query("build_corpus")
def build_corpus(s, d):
    """Markdown of every page with its metadata (the time of the run is left to the sink)."""
    rows = H.to_markdown(table(s, d, "pages"), HOST, BASE).select("page_id", T.normalize_markdown(F.col("text")).alias("text"))
    return rows.select("page_id", "text", F.char_length("text").alias("chars"), T.faithful_units(F.col("text")).alias("faithful_units"), F.lit(POLICY).alias("unit_policy"))
