"""DuckDB SQL of the operators that SQL can express."""

OP4 = """
WITH coded AS (
  SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.bits[i] <> v.bits[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM coded q JOIN coded v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

OP9 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def _pii() -> str:
    """Places from the gaps that the split leaves between matches, as the operator does."""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INTEGER) WHEN CAST(d[length(d) - i] AS INTEGER) > 4 THEN 2 * CAST(d[length(d) - i] AS INTEGER) - 9 ELSE 2 * CAST(d[length(d) - i] AS INTEGER) END)) % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "length(p) BETWEEN 15 AND 34 AND NOT touched AND list_reduce(list_concat([0], list_transform(string_split(substr(p, 5) || substr(p, 1, 4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT touched AND regexp_matches(around, 'ssn|social security')"),
    )
    # context words, score with and without them
    scores = (
        ("mail|contact|kontakt|correo|courriel|write", 1.0, 0.9), ("ip|host|server|address|login|addr", 0.9, 0.7), ("card|karte|carte|tarjeta|visa|pay|credit", 0.95, 0.7),
        ("tel|phone|call|fon|fax|llama|appel", 0.9, 0.7), ("iban|account|konto|compte|cuenta|bank", 1.0, 0.9), ("ssn|social security", 0.9, 0.2),
    )
    parts = [
        f"""SELECT doc_id, {n} AS k, '{name}' AS kind, s, e, CASE WHEN regexp_matches(around, '{scores[n][0]}') THEN CAST({scores[n][1]} AS DOUBLE) ELSE CAST({scores[n][2]} AS DOUBLE) END AS score FROM (
  SELECT doc_id, s, s + length(m) AS e, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS p, lower(substr(t, greatest(s - 40, 0) + 1, length(m) + 80)) AS around,
    regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, s + length(m) + 1, 1), '[A-Za-z0-9]') AS touched
  FROM (SELECT doc_id, t, hits[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{rx}') AS hits, string_split_regex(t, '{rx}') AS gaps FROM texts)))
) WHERE {valid}"""
        for n, (name, rx, valid) in enumerate(kinds)
    ]
    spans = " UNION ALL ".join(parts)
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s){}, '')"
    counts = ", ".join(f"count(*) FILTER (k = {n}) AS n_{name}" for n, (name, _, _) in enumerate(kinds[:4]))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans}),
digests AS (SELECT doc_id, {counts}, sha256({listed.format(" FILTER (k < 4)")}) AS base_sha256, {listed.format("")} AS spans, max(score) AS score FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score, 0.0) AS score
FROM texts t LEFT JOIN digests USING (doc_id)
"""


OP11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS words FROM worded
), freq AS (
  SELECT lang, words, phrase, count(*) AS f FROM (SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM sized)) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM freq WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE words > 1 AND f >= 100
), cuts AS (
  SELECT *, unnest(range(1, words)) AS k FROM candidates
), scores AS (
  SELECT c.lang, c.phrase, c.words, c.a, k, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals USING (lang) JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
), weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scores) WHERE o = 1
), open AS (
  SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.lang = s.lang AND c.words > s.words AND 100 * c.a >= 100 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open) WHERE rank <= 2000
"""

_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda s, b: list_reduce(list_concat([xor(s, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _field(name: str, value: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _merkle() -> str:
    """Levels of every tree by recursion, then the fold of each leaf with its siblings, level by level."""
    leaf = lambda text: f"sha256({' || '.join(_field(c, c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_field('text', text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # (node at a level, siblings before and behind it)
    around = lambda where, k: f"coalesce((SELECT string_agg(m.node, '' ORDER BY m.pos) FROM nodes m WHERE m.tree = f.tree AND m.level = f.level AND m.pos // 8 = f.pos // 8 AND m.pos {where} f.pos), '') AS s{k}"
    return f"""
WITH RECURSIVE hashed AS MATERIALIZED (
  SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {leaf(lower)} END AS changed FROM documents
), trees AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM hashed GROUP BY lang
), leaves AS MATERIALIZED (
  SELECT doc_id, leaf, coalesce(changed, leaf) AS tampered, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed JOIN trees ON hashed.lang IS NOT DISTINCT FROM trees.lang
), lower_nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1 GROUP BY tree, level, n, pos // 8
), subroots AS MATERIALIZED (SELECT tree, level AS top, node AS subroot FROM lower_nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM trees) AS n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, n, pos // 8
), nodes AS MATERIALIZED (SELECT tree, level, pos, n, node FROM lower_nodes UNION ALL SELECT -1, level, pos, n, node FROM upper_nodes
), places AS (
  SELECT tree AS own, doc_id, tampered, leaf, l.pos AS id, tree, level, l.pos // CAST(8 ** level AS BIGINT) AS pos, 0 AS part FROM leaves l JOIN subroots USING (tree), (SELECT unnest(range(0, 30)) AS level) WHERE level < top
  UNION ALL
  SELECT tree, doc_id, tampered, leaf, pos, -1, level, tree // CAST(8 ** level AS BIGINT), 1 FROM leaves, (SELECT unnest(range(0, 30)) AS level) WHERE level < (SELECT max(level) FROM upper_nodes)
), steps AS MATERIALIZED (
  SELECT own, id, row_number() OVER (PARTITION BY own, id ORDER BY part, level) AS step, s0, s1 FROM (SELECT own, id, part, level, {around('<', 0)}, {around('>', 1)} FROM places f)
), folds AS (
  SELECT tree AS own, pos AS id, CAST(1 AS BIGINT) AS step, tampered AS node FROM leaves
  UNION ALL
  SELECT f.own, f.id, f.step + 1, sha256(s0 || node || s1) FROM folds f JOIN steps s ON s.own = f.own AND s.id = f.id AND s.step = f.step
), folded AS (SELECT own, id, arg_max(node, step) AS folded_root FROM folds GROUP BY ALL
), proofs AS (SELECT own, id, sha256(string_agg(s0 || s1, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY ALL
), root AS (SELECT node AS root FROM upper_nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots USING (tree) JOIN folded f ON f.own = l.tree AND f.id = l.pos LEFT JOIN proofs p ON p.own = l.tree AND p.id = l.pos, root
"""


ORACLE_SQL = {"op4_hamming_topk": OP4, "op9_url_filter": OP9, "op10_pii": _pii(), "op11_collocations": OP11, "op13_merkle": _merkle()}
