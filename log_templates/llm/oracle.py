"""DuckDB SQL of the queries that SQL can express."""

SPACE = r"[\x20\x09-\x0D]"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{SPACE}+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
           WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS node, doc_id AS low FROM documents
  UNION
  SELECT b, low FROM reach JOIN both_ways ON node = a AND low < b
), c AS (
  SELECT node, min(low) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

# repeat limit 2: the smallest exponent whose largest number of epochs is at most twice the smallest
OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')) AS n_tokens
  FROM documents
), t AS (
  SELECT source, sum(n_tokens) AS tokens, sum(n_tokens) / sum(sum(n_tokens)) OVER () AS share FROM d GROUP BY source
), r AS (
  SELECT max(share) AS hi, min(share) AS lo FROM t WHERE share > 0
), bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1,
         CASE WHEN fits THEN lo ELSE (lo + hi) / 2 END, CASE WHEN fits THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT b.*, pow(r.lo, (b.lo + b.hi) / 2 - 1) / pow(r.hi, (b.lo + b.hi) / 2 - 1) <= 2.0 AS fits FROM bisect b, r)
  WHERE step < 32
), a AS (
  SELECT CASE WHEN pow(r.lo, -1.0) / pow(r.hi, -1.0) <= 2.0 THEN 0.0 ELSE b.hi END AS alpha
  FROM bisect b, r WHERE step = 32
), p AS (
  SELECT source, tokens, CASE WHEN share > 0 THEN pow(share, alpha) ELSE 0 END AS powered FROM t, a
), z AS (
  SELECT sum(powered) AS z, max(CASE WHEN powered > 0 THEN tokens / powered END) * sum(powered) AS budget FROM p
), k AS (
  SELECT source, tokens, powered / z AS weight,
         CASE WHEN tokens > 0 THEN round(budget * (powered / z) / tokens, 6) ELSE 1.0 END AS epochs
  FROM p, z
), b AS (
  SELECT d.*, k.weight, k.epochs, floor(k.epochs)::INT AS whole, (k.epochs - floor(k.epochs)) * k.tokens AS rest,
         unnest(range(0, floor(k.epochs)::INT + 1)) AS copy
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
), h AS (
  SELECT *, ('0x' || substr(md5('mix:' || copy || ':' || doc_id), 1, 8))::BIGINT AS place FROM b
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY place, doc_id) - n_tokens AS before FROM h
)
SELECT doc_id, source, n_tokens, copy, round(weight, 9) AS weight,
       least(round((copy + place / 4294967296.0::DOUBLE) / epochs, 9), 1.0) AS order_key
FROM c WHERE copy < whole OR before < rest
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base32
_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)
OP10 = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM g
"""

OP12 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '{SPACE}*[^\x20\x09-\x0D]+|{SPACE}+') AS units
  FROM documents
), k AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:lo], '') AS a,
         array_to_string(units[lo + 1:hi], '') AS b, array_to_string(units[hi + 1:], '') AS c
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), v AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), vs AS (
  SELECT lang, count(*) AS v FROM v GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * vs.v) AS p
  FROM f JOIN vs USING (lang)
), l AS (
  SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * vs.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM f GROUP BY lang, term) JOIN vs USING (lang)
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE = {
    "op3_exact_dedup": OP3, "op6_minhash": OP6, "op9_temperature_mix": OP9, "op10_warc": OP10, "op12_fill_middle": OP12,
    "op13_source_divergence": OP13,
}
