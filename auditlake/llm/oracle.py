"""SQL for the registered queries that SQL can express."""

OP5 = """
WITH ok AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.id AS query_id, b.id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ok a JOIN ok b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# {docs} is a table with doc_id and text.
LINE_DEDUP = """
WITH src AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {docs}),
l AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS i, unnest(lines) AS s FROM src WHERE doc_id IS NOT NULL),
h AS (
  SELECT *, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) AS h
  FROM l),
k AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * 1000003 + h) % 2 = 0 AS cut, count(*) OVER (PARTITION BY doc_id) AS n
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (
  SELECT *, i = n - 1 OR (i > 0 AND i <> n - 2 AND cut AND NOT lag(cut) OVER (PARTITION BY doc_id ORDER BY i)) AS ends FROM k),
c AS (
  SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM e),
g AS (
  SELECT doc_id, min(i) AS first, max(i) AS last
  FROM c GROUP BY doc_id, chunk HAVING count(*) FILTER (WHERE trim(s, ' ') <> '') >= 2),
w AS (
  SELECT doc_id, i, words, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT doc_id, i, CASE WHEN trim(s, ' ') = '' THEN 0 ELSE len(string_split_regex(trim(s, ' '), ' +')) END AS words FROM c)),
filled AS (SELECT doc_id, i, upto FROM w WHERE words > 0),
runs AS (
  SELECT st.doc_id, st.i AS first, f.i AS last
  FROM (SELECT doc_id, i, upto - words + 50 AS need FROM filled JOIN w USING (doc_id, i, upto)) st
  ASOF JOIN filled f ON st.doc_id = f.doc_id AND st.need <= f.upto),
pool AS (
  SELECT p.doc_id, p.first, p.last, array_to_string(src.lines[p.first + 1 : p.last + 1], chr(10)) AS body
  FROM (SELECT * FROM g UNION ALL SELECT * FROM runs) p JOIN src ON p.doc_id = src.doc_id),
keepers AS (SELECT body, min(CAST(doc_id AS HUGEINT) * 2147483648 + first) AS keeper FROM pool GROUP BY body),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS i
  FROM pool JOIN keepers USING (body) WHERE CAST(doc_id AS HUGEINT) * 2147483648 + first <> keeper),
x AS (
  SELECT c.*, gone.i IS NOT NULL AS again FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.i = gone.i),
m AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_removed,
    string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT again) AS left_text
  FROM x GROUP BY doc_id),
deduped AS (
  SELECT src.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE coalesce(left_text, '') END AS text,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
  FROM src LEFT JOIN m ON src.doc_id = m.doc_id)
"""


def mixing_ctes(docs: str, share: str, epochs: int, seed: int) -> str:
    """CTEs that end in ``mixed``: doc_id, n_tokens, levels, copies, budget."""

    def level(name: str, path: str, parent: str, above: str, weight: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN {above} a USING ({parent})" if parent else f"CROSS JOIN {above} a"
        return f"""
{name}_n AS (
  SELECT {path}, CAST(sum(usable) AS BIGINT) AS usable, {weight} AS weight FROM leaves GROUP BY {path}),
{name}_f AS (
  SELECT n.*, a.budget AS given_above, usable * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= weight * greatest(a.budget - coalesce(sum(usable) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS is_full
  FROM {name}_n n {join} WINDOW w AS ({part} ORDER BY usable / weight, {path.split(", ")[-1]})),
{name} AS (
  SELECT {path}, CAST(CASE WHEN is_full THEN usable ELSE
    (weight * (given_above - coalesce(sum(usable) FILTER (WHERE is_full) OVER ({part}), 0)))
      // (sum(weight) FILTER (WHERE NOT is_full) OVER ({part})) END AS BIGINT) AS budget
  FROM {name}_f)"""

    lang = "CASE WHEN domain IN ('d0', 'd1', 'd2') THEN CASE language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END ELSE 1 END"
    return f"""
sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens,
    coalesce('d' || CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 AS VARCHAR), 'none') AS domain,
    coalesce(lang, 'none') AS language, coalesce(source, 'none') AS site
  FROM {docs}),
leaves AS (
  SELECT domain, language, site, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {epochs} AS usable
  FROM sized GROUP BY ALL),
root AS (SELECT (sum(tokens) * {share.split("/")[0]}) // {share.split("/")[1]} AS budget FROM leaves),
{level("l1", "domain", "", "root", "CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")},
{level("l2", "domain, language", "domain", "l1", lang)},
{level("l3", "domain, language, site", "domain, language", "l2", "1")},
planned AS (
  SELECT domain, language, site, tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole
  FROM leaves JOIN l3 USING (domain, language, site)),
placed AS (
  SELECT sized.*, budget, whole, budget - whole * tokens AS rest,
    CAST('0x' || substr(md5('{seed}|' || whole || '|' || doc_id), 1, 15) AS BIGINT) AS place
  FROM sized JOIN planned USING (domain, language, site)),
mixed AS (
  SELECT doc_id, n_tokens, domain, language, site, whole + CASE WHEN whole < {epochs} AND
    sum(n_tokens) OVER (PARTITION BY domain, language, site ORDER BY place, doc_id) <= rest THEN 1 ELSE 0 END AS copies, budget
  FROM placed)
"""


def _matches(kind: str, pattern: str, valid: str) -> str:
    return f"""
{kind}_m AS (
  SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(p[1:len(m)]) AS p
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM src)),
{kind}_s AS (
  SELECT doc_id, '{kind}' AS kind, m, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e
  FROM {kind}_m),
{kind} AS (SELECT doc_id, kind, m, e - length(m) AS s, e FROM {kind}_s WHERE {valid})"""


_IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
_LUHN = (
    "list_sum(list_transform(generate_series(1, length({d})), lambda i: CASE WHEN i % 2 = 1 "
    "THEN CAST(substr({d}, length({d}) - i + 1, 1) AS INT) "
    "ELSE 2 * CAST(substr({d}, length({d}) - i + 1, 1) AS INT) - CASE WHEN CAST(substr({d}, length({d}) - i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
).format(d="regexp_replace(m, '[ -]', '', 'g')")
_TERM = r"[\x20\x09-\x0D.,;:!?()\x22]"

PII = f"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_matches("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")},
{_matches("ip", _IP, "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0")},
{_matches("card", "[0-9](?:[ -]?[0-9])+", "length(regexp_replace(m, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND " + _LUHN)},
{_matches("phone", "[+][0-9][ ().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15")},
base AS (
  SELECT *, 1 AS k FROM email UNION ALL SELECT *, 2 FROM ip UNION ALL SELECT *, 3 FROM card UNION ALL SELECT *, 4 FROM phone),
mentions AS (
  SELECT base.doc_id, kind || ':' || lower(m) AS entity,
    lower(substr(text, greatest(s - 79, 1), least(s, 80)) || ' ' || substr(text, e + 1, 80)) AS around
  FROM base JOIN src ON base.doc_id = src.doc_id),
near AS (
  SELECT DISTINCT doc_id, entity, around, term FROM (
    SELECT doc_id, entity, around, unnest(string_split_regex(around, '{_TERM}')) AS term FROM mentions) WHERE length(term) > 2),
counted AS (
  SELECT term, entity, count(DISTINCT around) AS n_c, count(DISTINCT doc_id) AS n_te FROM near GROUP BY ALL),
contexts AS (SELECT entity, count(DISTINCT around) AS c FROM mentions GROUP BY entity),
varied AS (
  SELECT entity FROM counted JOIN contexts USING (entity) GROUP BY entity, c HAVING 2 * sum(n_c * n_c) <= c * sum(n_c)),
pairs AS (SELECT term, entity, n_te FROM counted WHERE n_c >= 3 AND entity IN (SELECT entity FROM varied)),
ents AS (SELECT entity, count(DISTINCT doc_id) AS n_e FROM mentions GROUP BY entity),
vocabulary AS (
  SELECT term, count(DISTINCT doc_id) AS n_t FROM (
    SELECT doc_id, unnest(string_split_regex(lower(text), '{_TERM}')) AS term FROM src)
  WHERE term IN (SELECT term FROM pairs) GROUP BY term),
telling AS (
  SELECT DISTINCT term FROM pairs JOIN ents USING (entity) JOIN vocabulary USING (term), (SELECT count(doc_id) AS n FROM src)
  WHERE log2(n_te * CAST(n AS DOUBLE) / (n_t * n_e)) >= 0.9 * log2(CAST(n AS DOUBLE) / n_e)),
pieces AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece
  FROM (SELECT doc_id, string_split_regex(text, '{_TERM}') AS p FROM src)),
placed AS (
  SELECT doc_id, piece, CAST(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - 1 AS e FROM pieces),
terms AS (
  SELECT doc_id, 'term' AS kind, piece AS m, e - length(piece) AS s, e, 5 AS k
  FROM placed WHERE lower(piece) IN (SELECT term FROM telling)),
digests AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone", "term"))},
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k < 5), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM terms) GROUP BY doc_id)
SELECT src.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone", "term"))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM src LEFT JOIN digests USING (doc_id)
"""

# {docs} is a table with doc_id and text; ends in n_shingles and component_id by doc_id.
JACCARD = """
jw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {docs}),
js AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM jw),
ju AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM js),
jl AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM ju a JOIN ju b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
jb AS (SELECT x, y FROM jl UNION ALL SELECT y, x FROM jl),
jr(x, y) AS (SELECT x, y FROM jb UNION SELECT jr.x, jb.y FROM jr JOIN jb ON jr.y = jb.x),
jc AS (SELECT x, min(y) AS c FROM jr GROUP BY x),
grouped AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
  FROM js LEFT JOIN jc ON doc_id = x)
"""

ORACLE = {
    "op8_ngram_jaccard": "WITH RECURSIVE" + JACCARD.format(docs="documents") + "SELECT doc_id, n_shingles, component_id FROM grouped",
    "op10_pii": PII,
    "op1_line_dedup": LINE_DEDUP.format(docs="documents") + "SELECT doc_id, text, n_lines, n_removed FROM deduped",
    "op7_mixing": "WITH " + mixing_ctes("documents", "3/5", 2, 7) + "SELECT * FROM mixed",
    "op5_exact_top_k": OP5,
}


def _vq_sql(rounds: int = 6, entries: int = 16, parts: int = 8, scale: int = 4096) -> str:
    """op11: the rounds unrolled, one CTE of assignments and one of entries per round."""
    ctes = [
        f"""ok AS (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {parts} = 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)
      AND abs({scale} * CAST(x AS DOUBLE)) < 4503599627370496)) = len(embedding))""",
        f"""seeds AS MATERIALIZED (
  SELECT rid, q, CAST(row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS BIGINT) AS e FROM ok
  QUALIFY e < {entries})""",
        "kept AS (SELECT * FROM ok WHERE len(q) = (SELECT len(q) FROM seeds WHERE e = 0))",
        f"""px AS MATERIALIZED (
  SELECT rid, i // (len(q) // {parts}) AS p, i % (len(q) // {parts}) AS j, c
  FROM (SELECT rid, q, unnest(q) AS c, unnest(range(len(q))) AS i FROM kept))""",
        "cb0 AS MATERIALIZED (SELECT s.e, px.p, px.j, px.c FROM seeds s JOIN px USING (rid))",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, p, e, d FROM (
    SELECT px.rid, px.p, cb.e, sum((px.c - cb.c) * (px.c - cb.c)) AS d
    FROM px JOIN cb{r} cb ON px.p = cb.p AND px.j = cb.j GROUP BY px.rid, px.p, cb.e)
  QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS (
  SELECT a.p, a.e, px.j, sum(px.c) AS s, count(*) AS n FROM a{r} a JOIN px ON a.rid = px.rid AND a.p = px.p
  GROUP BY a.p, a.e, px.j)"""
            )
            ctes.append(
                f"""cb{r + 1} AS MATERIALIZED (
  SELECT o.e, o.p, o.j, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), o.c) AS c
  FROM cb{r} o LEFT JOIN m{r} m USING (p, e, j))"""
            )
    ctes.append(
        f"""coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rid)"""
    )
    ctes.append(f"books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM cb{rounds})")
    return (
        "WITH "
        + ",\n".join(ctes)
        + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT h FROM books) AS codebooks_sha256, label
FROM kept JOIN coded USING (rid)
"""
    )


FIM = """
WITH s AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
    CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS h2,
    CAST(('0x' || substr(h, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS BIGINT) AS h4
  FROM s),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form,
  CASE WHEN form = 'plain' THEN NULL ELSE lo END AS prefix_chars,
  CASE WHEN form = 'plain' THEN NULL ELSE hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLE["op11_vector_codes"] = _vq_sql()
ORACLE["op13_fill_in_middle"] = FIM
