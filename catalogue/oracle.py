"""The DuckDB counterpart of each registered query that SQL can express."""

from __future__ import annotations

from catalogue import oracle_inputs as o

ORACLE: dict[str, str] = {}


def add(name: str, sql: str, *ctes: str, recursive: bool = False) -> None:
    start = "WITH RECURSIVE " if recursive else "WITH "
    ORACLE[name] = (start + ", ".join(c.strip() for c in ctes) + "\n" if ctes else "") + sql.strip()


RAW = o.EVENT_LINES + """,
raw_lines AS (SELECT line_id, event_type, stamp, content, CASE WHEN line_id % 50 = 0 THEN content
  ELSE '[' || stamp || '] [' || event_type || '] ' || content END AS value FROM event_lines)"""

# --- sources and text -------------------------------------------------------

HEADER = r"'^\[(.*?)\]\s+\[(.*?)\]\s+(.*?)$'"
add(
    "extract_headers",
    f"""SELECT line_id, regexp_extract(value, {HEADER}, 1) AS "time", regexp_extract(value, {HEADER}, 2) AS level,
    regexp_extract(value, {HEADER}, 3) AS content FROM raw_lines WHERE regexp_matches(value, {HEADER})""",
    RAW,
)
add(
    "extract_headers_multi",
    "SELECT line_id, CASE WHEN line_id % 2 = 0 THEN 'Apache' ELSE 'Proxifier' END AS system, event_type AS label, content "
    "FROM raw_lines WHERE line_id % 50 <> 0",
    RAW,
)
add("drop_unparsable", f"SELECT line_id, value FROM raw_lines WHERE regexp_matches(value, {HEADER})", RAW)

SPREAD = "replace(content, 'e ', ' e ' || chr(9))"
add(
    "collapse_ws",
    f"SELECT line_id, {o.flat(SPREAD)} AS flat, len({o.word_list(SPREAD)}) AS words FROM all_lines",
    o.ALL_LINES,
)
for name, column, expression in (
    ("tokenize_logs", "tokens", f"array_to_string({o.tokens('content')}, '|')"),
    ("mask_numbers", "masked", o.mask("content")),
    ("clean_line", "cleaned", f"array_to_string({o.clean('content')}, ' ')"),
    ("format_signature", "signature", o.signature("content")),
    ("word_tokens", "tokens", f"array_to_string({o.words('content')}, '|')"),
    ("stop_word_filter", "tokens", f"array_to_string({o.no_stop(o.word_list('content'))}, '|')"),
):
    add(name, f"SELECT line_id, {expression} AS {column} FROM all_lines", o.ALL_LINES)
add(
    "valid_templates",
    f"SELECT * FROM (SELECT line_id, regexp_replace(content, '[0-9A-Za-z]+', '<*>', 'g') AS event_template FROM all_lines) "
    f"WHERE {o.valid('event_template')}",
    o.ALL_LINES,
)
add(
    "digit_heavy_tokens",
    rf"""SELECT token, count(*) AS lines FROM (SELECT unnest({o.word_list('content')}) AS token FROM all_lines)
    WHERE length(regexp_replace(token, '\P{{Nd}}', '', 'g')) >= 4 OR (regexp_matches(token, '\p{{Nd}}')
      AND NOT regexp_matches(token, '\p{{Lu}}') AND length(regexp_replace(token, '\P{{Nd}}', '', 'g')) / length(token) > 0.3)
    GROUP BY token""",
    o.ALL_LINES,
)
for ruleset in ("base", "large", "oracle", "light", "general"):
    add(
        f"normalize_{ruleset}",
        f"SELECT line_id, {o.normal('content', ruleset)} AS from_text, {o.normal('holes', ruleset)} AS from_holes "
        "FROM (SELECT *, regexp_replace(content, '[0-9]+', '<*>', 'g') AS holes FROM all_lines)",
        o.ALL_LINES,
    )

# --- matching ---------------------------------------------------------------


def group(n: int, content: str = "content", pattern: str = "pat") -> str:
    return f"regexp_extract({content}, {pattern}, {n})"


def filled(parts: str, most: int) -> str:
    """A template without its empty placeholders, for up to ``most`` of them."""
    text = f"{parts}[1]"
    for n in range(1, most + 1):
        text += (
            f" || CASE WHEN len({parts}) > {n} THEN (CASE WHEN {group(n)} = '' THEN '' ELSE '<*>' END) "
            f"|| {parts}[{n + 1}] ELSE '' END"
        )
    return text


def hits(lines: str, templates: str) -> str:
    return f"""
tried AS (
  SELECT l.*, t.template_id, t.hits, {o.pattern('t.event_template')} AS pat, string_split(t.event_template, '<*>') AS parts
  FROM {lines} l JOIN {templates} t
    ON abs(len(string_split(l.content, ' ')) - len(string_split(t.reference_log, ' '))) <= 1
    AND regexp_matches(l.content, {o.pattern('t.event_template')})
),
fitted AS (SELECT *, {filled('parts', 6)} AS event_template FROM tried),
first_hit AS (
  SELECT * FROM fitted WHERE event_template IN (SELECT event_template FROM {templates})
  QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY hits DESC, template_id) = 1
)"""


SOME = o.KNOWN_TEMPLATES + ", some_known AS (SELECT * FROM known WHERE template_id % 10 NOT IN (2, 4))"
add(
    "match_templates",
    "SELECT l.line_id, l.content, h.event_template FROM event_lines l LEFT JOIN first_hit h USING (line_id)",
    o.KNOWN_TEMPLATES,
    hits("event_lines", "known"),
)
ORACLE["stream_match"] = ORACLE["match_templates"]
ORACLE["match_templates_shuffle"] = ORACLE["match_templates"]
add(
    "match_many_templates",
    """SELECT line_id, content, CASE event_type
    WHEN 'click' THEN regexp_replace(content, ' in [^ ]+ ms$', ' in <*> ms')
    WHEN 'view' THEN regexp_replace(content, ' size [^ ]+ from', ' size <*> from')
    WHEN 'purchase' THEN regexp_replace(content, 'amount .*$', 'amount <*>, user <*>')
    WHEN 'error' THEN regexp_replace(content, 'code .*$', 'code <*>') ELSE content END AS event_template FROM event_lines""",
    o.EVENT_LINES,
)
add(
    "unmatched_lines",
    "SELECT line_id, content FROM event_lines WHERE line_id NOT IN (SELECT line_id FROM first_hit)",
    SOME,
    hits("event_lines", "some_known"),
)
add(
    "extract_variables",
    f"""SELECT line_id, array_to_string(list_filter([
      {group(1)}, {group(2)}, CASE WHEN len(string_split(truth_template, '<*>')) > 3 THEN {group(3)} ELSE '' END],
      lambda v: v <> ''), '|') AS variables
    FROM (SELECT *, {o.pattern('truth_template')} AS pat FROM event_lines)""",
    o.EVENT_LINES,
)
add("collapse_empty_variables", "SELECT line_id, truth_template AS event_template FROM event_lines", o.EVENT_LINES)
add(
    "align_empty_values",
    """SELECT line_id, CASE WHEN line_id % 5 = 0 THEN replace(truth_template, ' <*>', ' <*><*>') || ' x'
      ELSE truth_template END AS event_template FROM event_lines""",
    o.EVENT_LINES,
)
add(
    "prune_clusters",
    f"""SELECT line_id, k::BIGINT AS cluster_id, regexp_matches(content, {o.pattern('first_template')}) AS matched
    FROM event_lines JOIN (SELECT k, arg_min(truth_template, line_id) AS first_template FROM event_lines GROUP BY k) USING (k)""",
    o.EVENT_LINES,
)
add(
    "reuse_templates",
    """SELECT k::BIGINT AS cluster_id, arg_min(event_template, (-hits, template_id)) AS event_template FROM (
      SELECT DISTINCT f.k, f.event_template, t.hits, t.template_id FROM first_hit f JOIN some_known t
      ON f.event_template = t.event_template) GROUP BY k""",
    SOME,
    hits("event_lines", "some_known"),
)
add(
    "filter_templates",
    "SELECT truth_template AS event_template, line_id FROM event_lines WHERE truth_template IN (SELECT event_template FROM some_known)",
    SOME,
)
add(
    "subsumption_pairs",
    r"""SELECT x.t AS general, y.t AS special FROM texts x JOIN texts y ON x.t <> y.t AND regexp_matches(y.t,
      '^' || array_to_string(list_transform(string_split(x.t, '<*>'), lambda p: regexp_escape(p)), '\S+?') || '$')""",
    o.STRUCTURED,
    "texts AS (SELECT event_template AS t FROM structured UNION SELECT truth_template FROM event_lines)",
)

# --- distinct lines, counts, vectors ----------------------------------------

add(
    "dedupe_lines",
    "SELECT content, min(line_id) AS line_id, count(*) AS copies FROM document_lines GROUP BY content",
    o.DOCUMENT_LINES,
)
add(
    "broadcast_back",
    f"SELECT line_id, {o.mask('content')} AS event_template, count(*) OVER (PARTITION BY content) AS copies FROM document_lines",
    o.DOCUMENT_LINES,
)
VOCABULARY = f"vocabulary AS (SELECT unnest({o.no_stop(o.word_list('content'))}) AS token FROM document_lines)"
add(
    "token_counts",
    "SELECT token, count(*) AS occurrence FROM vocabulary GROUP BY token",
    o.DOCUMENT_LINES,
    VOCABULARY,
)
add("vocabulary_size", "SELECT count(DISTINCT token) AS words FROM vocabulary", o.DOCUMENT_LINES, VOCABULARY)


def token_keys(lines: str) -> str:
    """Lines with ``top``, their three most frequent words, null for lines too short."""
    return f"""
cleaned AS (SELECT *, {o.clean('content')} AS cw FROM {lines}),
kept_words AS (SELECT line_id, unnest({o.no_stop('cw')}) AS token FROM cleaned WHERE len(cw) > 1),
word_counts AS (SELECT token, count(*) AS n FROM kept_words GROUP BY token),
line_words AS (
  SELECT line_id, token FROM (SELECT DISTINCT line_id, token FROM kept_words) JOIN word_counts USING (token)
  QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY n DESC, token) <= 3
),
line_tops AS (SELECT line_id, list(token ORDER BY token) AS top FROM line_words GROUP BY line_id),
keyed AS (
  SELECT c.*, CASE WHEN len(cw) > 1 THEN coalesce(top, []) END AS top
  FROM cleaned c LEFT JOIN line_tops USING (line_id)
)"""


add("top3_tokens", "SELECT line_id, array_to_string(top, '|') AS top_tokens FROM keyed", o.ALL_LINES, token_keys("all_lines"))
add(
    "distinct_template_count",
    "SELECT count(DISTINCT event_template) AS templates FROM structured",
    o.STRUCTURED,
)


def weights(docs: str) -> str:
    """``vec(grp, id, term, w)`` from ``docs(grp, id, copies, toks)``."""
    return f"""
tf AS (SELECT grp, id, term, any_value(copies) AS copies, count(*) AS tf
  FROM (SELECT grp, id, copies, unnest(toks) AS term FROM {docs}) GROUP BY grp, id, term),
idf AS (SELECT grp, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM
  (SELECT grp, term, sum(copies) AS df FROM tf GROUP BY grp, term)
  JOIN (SELECT grp, sum(copies) AS n FROM {docs} GROUP BY grp) USING (grp)),
raw_weights AS (SELECT grp, id, term, tf * idf AS r FROM tf JOIN idf USING (grp, term)),
vec AS (SELECT grp, id, term, r / sqrt(sum(r * r) OVER (PARTITION BY grp, id)) AS w FROM raw_weights)"""


add(
    "tfidf",
    "SELECT id AS line_id, count(*) AS terms, round(sum(w), 6) AS weight_sum, round(max(w), 6) AS weight_max FROM vec GROUP BY id",
    o.DOCUMENT_LINES,
    f"docs AS (SELECT 0 AS grp, line_id AS id, 1 AS copies, {o.words('content')} AS toks FROM document_lines)",
    weights("docs"),
)

BAGS = f"""
tokenized AS (SELECT line_id, content, {o.tokens('content')} AS toks FROM all_lines),
bagged AS (SELECT line_id, content, toks, list_sort(toks) AS bag FROM tokenized),
bags AS (SELECT bag, min(line_id) AS id, count(*) AS copies FROM bagged GROUP BY bag)"""


def near(eps: float) -> str:
    """``pairs(a, b, cos)``: candidates share one of the heaviest terms of a vector."""
    cos = 1 - eps * eps / 2
    return f"""
heads AS (SELECT id, term, 1 - coalesce(sum(w * w) OVER (PARTITION BY id ORDER BY w DESC, term
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM vec),
candidates AS (SELECT DISTINCT least(h.id, v.id) AS a, greatest(h.id, v.id) AS b
  FROM heads h JOIN vec v ON h.term = v.term AND h.id <> v.id WHERE h.rest >= {cos * cos * 0.9999}),
pairs AS (SELECT a, b, sum(x.w * y.w) AS cos FROM candidates c JOIN vec x ON x.id = c.a
  JOIN vec y ON y.id = c.b AND y.term = x.term GROUP BY a, b HAVING sum(x.w * y.w) >= {cos} - 1e-9)"""


add(
    "similar_pairs",
    "SELECT a, b, round(cos, 6) AS cos FROM pairs",
    o.ALL_LINES,
    BAGS,
    "docs AS (SELECT 0 AS grp, id, 1 AS copies, bag AS toks FROM bags)",
    weights("docs"),
    near(0.3),
)

TYPE_NUMBER = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
TYPED = f"{o.EVENT_LINES}, typed AS (SELECT *, ({TYPE_NUMBER})::BIGINT AS cluster_id FROM event_lines)"

LABELLED_PAIRS = """
thirds AS (SELECT line_id, content, truth_template, cluster_id * 10 + k % 3 AS cluster_id FROM typed),
third_sizes AS (SELECT cluster_id, count(*) AS size, arg_min(truth_template, line_id) AS template FROM thirds GROUP BY cluster_id),
largest AS (
  SELECT template, cluster_id, size FROM third_sizes
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY size DESC, cluster_id) = 1
  ORDER BY size DESC, cluster_id LIMIT 8
),
drawn AS (
  SELECT l.template, l.size, l.cluster_id, t.content AS log,
    row_number() OVER (PARTITION BY t.cluster_id ORDER BY md5(t.content || ':' || t.line_id), t.line_id) AS turn
  FROM thirds t JOIN largest l USING (cluster_id)
),
labelled_pairs AS (
  SELECT row_number() OVER (ORDER BY turn, size DESC, cluster_id)::INTEGER AS pair_id, log, template
  FROM drawn ORDER BY turn, size DESC, cluster_id LIMIT 8
)"""
add("labelled_pairs", "SELECT pair_id, log, template FROM labelled_pairs", TYPED, LABELLED_PAIRS)


def nearest(lines: str, k: int) -> str:
    """``nearest(content, pair_id, rank, cos)`` for the distinct texts of ``lines``."""
    return f"""
sides AS (SELECT DISTINCT 0 AS side, content AS key, content AS body FROM {lines}
  UNION ALL SELECT 1, CAST(pair_id AS VARCHAR), log FROM labelled_pairs),
docs AS (SELECT 0 AS grp, {{'side': side, 'key': key}} AS id, 1 AS copies, {o.words('body')} AS toks FROM sides),
{weights('docs').strip()},
shared AS (SELECT x.id.key AS content, CAST(y.id.key AS INTEGER) AS pair_id, round(sum(x.w * y.w), 9) AS cos
  FROM vec x JOIN vec y ON x.term = y.term WHERE x.id.side = 0 AND y.id.side = 1 GROUP BY 1, 2),
nearest AS (
  SELECT t.content, p.pair_id, coalesce(s.cos, 0) AS cos,
    row_number() OVER (PARTITION BY t.content ORDER BY coalesce(s.cos, 0) DESC, p.pair_id)::INTEGER AS rank
  FROM (SELECT DISTINCT content FROM {lines}) t CROSS JOIN labelled_pairs p
  LEFT JOIN shared s ON s.content = t.content AND s.pair_id = p.pair_id
  QUALIFY row_number() OVER (PARTITION BY t.content ORDER BY coalesce(s.cos, 0) DESC, p.pair_id) <= {k}
)"""


add(
    "nearest_pairs",
    "SELECT line_id, rank, pair_id, round(cos, 6) AS cos FROM event_lines JOIN nearest USING (content)",
    TYPED,
    LABELLED_PAIRS,
    nearest("event_lines", 3),
)

# --- clusters and samples ----------------------------------------------------

add(
    "token_key_coarse",
    """SELECT line_id, coalesce(cluster_id, -1) AS cluster_id FROM keyed LEFT JOIN (
      SELECT top, row_number() OVER (ORDER BY min(line_id)) - 1 AS cluster_id FROM keyed WHERE top IS NOT NULL GROUP BY top
    ) USING (top)""",
    o.ALL_LINES,
    token_keys("all_lines"),
)
add(
    "token_key_fine",
    """SELECT line_id, coalesce(cluster_id, -1) AS cluster_id FROM signed LEFT JOIN (
      SELECT top, sig, row_number() OVER (ORDER BY key_first, first) - 1 AS cluster_id FROM (
        SELECT top, sig, min(line_id) AS first, min(min(line_id)) OVER (PARTITION BY top) AS key_first
        FROM signed WHERE top IS NOT NULL GROUP BY top, sig)
    ) USING (top, sig)""",
    o.ALL_LINES,
    token_keys("all_lines"),
    f"signed AS (SELECT line_id, top, {o.signature('content')} AS sig FROM keyed)",
)
add(
    "token_key_cluster_counts",
    f"""SELECT count(DISTINCT array_to_string(top, '|')) AS coarse_clusters,
      count(DISTINCT array_to_string(top, '|') || chr(0) || {o.signature('content')}) AS fine_clusters FROM keyed WHERE top IS NOT NULL""",
    o.ALL_LINES,
    token_keys("all_lines"),
)

DENSITY = f"""
{o.ALL_LINES.strip()}, {BAGS.strip()},
docs AS (SELECT 0 AS grp, id, copies, bag AS toks FROM bags),
{weights('docs').strip()}, {near(0.1).strip()},
sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
cores AS (SELECT id FROM bags LEFT JOIN (SELECT s.a AS id, sum(copies) AS near_copies FROM sides s JOIN bags n ON n.id = s.b GROUP BY 1)
  USING (id) WHERE copies + coalesce(near_copies, 0) >= 5),
core_sides AS (SELECT a, b FROM sides WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)),
reached(id, root) AS (
  SELECT id, id FROM cores
  UNION SELECT s.b, r.root FROM reached r JOIN core_sides s ON s.a = r.id WHERE r.root < s.b
),
core_root AS (SELECT id, min(root) AS root FROM reached GROUP BY id),
border AS (SELECT s.a AS id, min(c.root) AS root FROM sides s JOIN core_root c ON c.id = s.b
  WHERE s.a NOT IN (SELECT id FROM cores) GROUP BY s.a),
rooted AS (SELECT * FROM core_root UNION ALL SELECT * FROM border),
numbered AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM rooted)),
density AS (
  SELECT l.line_id, l.toks, coalesce(n.cluster_id, -1) AS cluster_id FROM bagged l JOIN bags g USING (bag)
  LEFT JOIN rooted r ON r.id = g.id LEFT JOIN numbered n USING (root)
)"""
add("density_clusters", "SELECT line_id, cluster_id FROM density", DENSITY, recursive=True)
add(
    "regroup_noise",
    """SELECT line_id, CASE WHEN cluster_id = -1 THEN regrouped ELSE cluster_id END AS cluster_id
    FROM density LEFT JOIN (
      SELECT array_to_string(toks, ' ') AS key, -1 AS cluster_id,
        row_number() OVER (ORDER BY min(line_id)) + (SELECT max(cluster_id) FROM density) AS regrouped
      FROM density WHERE cluster_id = -1 GROUP BY 1
    ) g ON g.cluster_id = density.cluster_id AND g.key = array_to_string(toks, ' ')""".replace(
        "SELECT line_id, CASE WHEN cluster_id = -1 THEN regrouped ELSE cluster_id END",
        "SELECT line_id, CASE WHEN density.cluster_id = -1 THEN regrouped ELSE density.cluster_id END",
    ),
    DENSITY,
    recursive=True,
)
add(
    "constant_clusters",
    """SELECT event_type AS dataset, k::BIGINT AS cluster_id, count(DISTINCT regexp_replace(content, '[0-9]+', '', 'g')) = 1 AS is_constant,
      count(*) AS size FROM event_lines GROUP BY ALL""",
    o.EVENT_LINES,
)
add("cluster_sizes", "SELECT k::BIGINT AS cluster_id, count(*) AS size FROM event_lines GROUP BY k", o.EVENT_LINES)
add(
    "ranked_clusters",
    """SELECT k::BIGINT AS cluster_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, k) AS rank
    FROM event_lines GROUP BY k""",
    o.EVENT_LINES,
)

RANDOM_BATCH = """
drawn_lines AS (
  SELECT cluster_id, min(line_id) AS line_id, content FROM {lines} GROUP BY cluster_id, content
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY md5('0:' || content), content) <= 10
),
batch AS (SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY line_id) - 1)::INTEGER AS pos FROM drawn_lines)"""
TYPED_BATCH = RANDOM_BATCH.format(lines="typed")
add("sample_random", "SELECT cluster_id, pos, line_id, content FROM batch", TYPED, TYPED_BATCH)
add(
    "sample_diverse_k2",
    """SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY line_id) - 1)::INTEGER AS pos, line_id, content
    FROM (SELECT grp AS cluster_id, id AS line_id FROM firsts UNION ALL SELECT grp, id FROM seconds)
    JOIN distinct_lines USING (cluster_id, line_id)""",
    TYPED,
    f"""distinct_lines AS (SELECT cluster_id, content, min(line_id) AS line_id FROM typed GROUP BY cluster_id, content),
    docs AS (SELECT cluster_id AS grp, line_id AS id, 1 AS copies, {o.words('content')} AS toks FROM distinct_lines)""",
    weights("docs"),
    """firsts AS (SELECT grp, min(id) AS id FROM vec GROUP BY grp),
    first_vec AS (SELECT v.* FROM vec v JOIN firsts f ON v.grp = f.grp AND v.id = f.id),
    shared AS (SELECT v.grp, v.id, sum(v.w * coalesce(f.w, 0)) AS cos FROM vec v
      LEFT JOIN first_vec f ON f.grp = v.grp AND f.term = v.term GROUP BY v.grp, v.id),
    seconds AS (SELECT s.grp, s.id FROM shared s JOIN firsts f ON f.grp = s.grp AND f.id <> s.id
      QUALIFY row_number() OVER (PARTITION BY s.grp ORDER BY round(1 - cos * cos, 9) DESC, s.id) = 1)""",
)

# --- inference, prompts, parsing ---------------------------------------------

CONSENSUS = f"""
cuts AS (SELECT cluster_id, pos, line_id, content, {o.cut(o.flat('content'))} AS t FROM batch),
spots AS (SELECT cluster_id, pos, len(t) AS width, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM cuts),
agreed AS (SELECT cluster_id, i, CASE WHEN count(DISTINCT token) = 1 THEN min(token) ELSE '<*>' END AS token,
  min(width) = max(width) AS even FROM spots GROUP BY cluster_id, i),
voted AS (SELECT cluster_id, CASE WHEN bool_and(even) THEN string_agg(token, '' ORDER BY i) END AS text FROM agreed GROUP BY cluster_id),
firsts AS (SELECT cluster_id, min(line_id) AS first_line, arg_min(content, line_id) AS content FROM batch GROUP BY cluster_id),
cleaned_votes AS (SELECT cluster_id, first_line, {o.normal('content', 'base')} AS own,
  {o.normal('text', 'base')} AS vote FROM voted JOIN firsts USING (cluster_id)),
inferred AS (SELECT cluster_id, first_line, CASE WHEN vote IS NOT NULL AND {o.valid('vote')} THEN vote ELSE own END AS event_template
  FROM cleaned_votes)"""
add("consensus_templates", "SELECT cluster_id, event_template, first_line FROM inferred", TYPED, TYPED_BATCH, CONSENSUS)
add(
    "build_prompts",
    """SELECT cluster_id, string_agg(content, chr(10) ORDER BY pos) AS chat,
      'Log message:' || chr(10) || string_agg('`' || content || '`', chr(10) ORDER BY pos) || chr(10) || 'Log template: ' AS completion
    FROM batch GROUP BY cluster_id""",
    TYPED,
    TYPED_BATCH,
)
add(
    "build_prompts_with_pairs",
    """SELECT cluster_id, demos || 'Log message:' || chr(10) || quoted || chr(10) || 'Log template: ' AS query FROM (
      SELECT cluster_id, string_agg('`' || content || '`', chr(10) ORDER BY pos) AS quoted FROM batch GROUP BY cluster_id)
    JOIN (SELECT f.cluster_id, string_agg('Log message: `' || log || '`' || chr(10) || 'Log template: `'
        || replace(template, '<*>', '{{variable}}') || '`' || chr(10), '' ORDER BY rank DESC) AS demos
      FROM first_lines f JOIN nearest USING (content) JOIN labelled_pairs USING (pair_id) GROUP BY f.cluster_id)
    USING (cluster_id)""",
    TYPED,
    TYPED_BATCH,
    LABELLED_PAIRS,
    "first_lines AS (SELECT cluster_id, content FROM batch WHERE pos = 0)",
    nearest("first_lines", 2),
)
ANSWERS = o.EVENT_LINES + """,
asked AS (SELECT line_id, replace(truth_template, '<*>', '{{value}}') AS q FROM event_lines),
answers AS (SELECT line_id, CASE WHEN line_id % 10 = 0 THEN q
  WHEN line_id % 10 = 1 THEN 'Use `{{value}}` or' || chr(10) || '`' || q || '` here'
  ELSE 'Template: `' || q || '`' END AS response FROM asked)"""
add(
    "response_to_template",
    rf"""SELECT line_id, CASE WHEN replace(replace(cleaned, '<*>', ''), ' ', '') = '' THEN '' ELSE cleaned END AS event_template FROM (
      SELECT line_id, {o.normal("regexp_replace(piece, '[{][{].*?[}][}]', '<*>', 'g')", 'base')} AS cleaned FROM (
        SELECT line_id, coalesce(list_reduce([''] || list_filter(string_split(regexp_extract(replace(response, chr(10), ''), '`(.*)`', 1), '`'),
          lambda p: replace(replace(p, '<*>', ''), ' ', '') <> ''),
          lambda best, p: CASE WHEN length(p) > length(best) THEN p ELSE best END), '') AS piece FROM answers))""",
    ANSWERS,
)
add(
    "responses_to_templates",
    rf"""SELECT batch_id, min(pos)::INTEGER AS pos, event_template FROM (
      SELECT batch_id, pos, CASE WHEN trim(replace(cleaned, '<*>', '')) = '' THEN '' ELSE cleaned END AS event_template FROM (
        SELECT batch_id, pos, {o.normal("regexp_replace(line, '[{][{].*?[}][}]', '<*>', 'g')", 'base')} AS cleaned FROM (
          SELECT batch_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos
          FROM (SELECT line_id % 100 AS batch_id, string_agg(replace(response, '`', ''), chr(10) ORDER BY line_id) AS body
            FROM answers GROUP BY 1))))
    GROUP BY batch_id, event_template""",
    ANSWERS,
)
TOKEN_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
add(
    "prompt_cost",
    f"""SELECT *, round(tokens / calls, 2) AS tokens_per_call FROM (
      SELECT coalesce(role, 'all') AS dataset, sum({TOKEN_COUNT.format('role')} + {TOKEN_COUNT.format('text')} + 4)::BIGINT AS tokens,
        count(*) AS calls FROM conversations GROUP BY GROUPING SETS ((role), ()))""",
)


def parsed_by_key(lines: str, by: str = "") -> str:
    """One round of token-key clusters, hashed batches and consensus, where that is enough."""
    return ", ".join(
        part.strip()
        for part in (
            token_keys(lines),
            "clustered AS (SELECT line_id, content, top AS cluster_id FROM keyed)",
            RANDOM_BATCH.format(lines="clustered"),
            CONSENSUS,
            f"""parsed AS (SELECT c.line_id, i.event_template FROM clustered c JOIN inferred i ON c.cluster_id = i.cluster_id
              WHERE regexp_matches(c.content, {o.pattern('i.event_template')}))""",
        )
    )


add("parse_logs", "SELECT line_id, event_template FROM parsed", o.EVENT_LINES, parsed_by_key("event_lines"))
for name in ("parse_logs_default", "parse_logs_chunks", "parse_with_templates", "stream_parse"):
    add(name, "SELECT line_id, truth_template AS event_template FROM event_lines", o.EVENT_LINES)
add(
    "template_hits",
    "SELECT truth_template AS event_template, count(*) AS hits FROM event_lines GROUP BY truth_template",
    o.EVENT_LINES,
)
add(
    "stream_hits",
    "SELECT event_type, truth_template AS event_template, count(*) AS hits FROM event_lines GROUP BY ALL",
    o.EVENT_LINES,
)
add(
    "template_summary",
    """SELECT 'E' || row_number() OVER (ORDER BY count(*) DESC, min(line_id)) AS event_id, event_template, count(*) AS occurrence
    FROM parsed GROUP BY event_template""",
    o.EVENT_LINES,
    parsed_by_key("event_lines"),
)
add(
    "parse_suite",
    "SELECT dataset, truth_template AS event_template, count(*) AS occurrence FROM event_lines GROUP BY ALL",
    o.EVENT_LINES,
)
add(
    "skip_parsed",
    """SELECT dataset, count(*) AS parsed_lines FROM event_lines
    WHERE dataset <> (SELECT min(dataset) FROM event_lines) GROUP BY dataset""",
    o.EVENT_LINES,
)

# --- scores -------------------------------------------------------------------


def scores(by: str, wanted: str = "") -> str:
    """``scores`` per group from ``labelled``; ``wanted`` names a table of truth templates."""
    listed = f"truth IN (SELECT t FROM {wanted})" if wanted else "TRUE"
    size = f"(SELECT count(*) FROM {wanted})" if wanted else "count(*)"
    known = f"FROM labelled WHERE truth IS NOT NULL GROUP BY {by}"
    harmonic = lambda p, r: f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
    return f"""
cells AS (SELECT {by}, truth, parsed, count(*) AS n, {listed} AS listed {known}, truth, parsed),
truth_groups AS (SELECT {by}, truth, sum(n) AS n, count(*) AS parts, min(parsed) AS parsed, bool_or(listed) AS listed FROM cells GROUP BY {by}, truth),
parsed_groups AS (SELECT {by}, parsed, sum(n) AS n, count(*) AS parts, min(truth) AS truth, bool_or(listed) AS touched,
  array_to_string(list_transform(string_split(parsed, ' '), lambda t: CASE WHEN contains(t, '<*>') THEN '<*>' ELSE t END), ' ') AS abstract
  FROM cells GROUP BY {by}, parsed),
found AS (SELECT {by}, count(*) AS truths, {size} AS wanted_templates, sum(CASE WHEN t.listed THEN t.n ELSE 0 END) AS lines,
  sum(CASE WHEN t.listed AND t.parts = 1 AND t.n = p.n THEN t.n ELSE 0 END) AS right_lines,
  count(*) FILTER (WHERE t.listed AND t.parts = 1 AND t.n = p.n) AS right_groups
  FROM truth_groups t JOIN parsed_groups p USING ({by}, parsed) GROUP BY {by}),
identified AS (SELECT {by}, count(*) FILTER (WHERE touched) AS identified,
  count(*) FILTER (WHERE touched AND parts = 1 AND truth = parsed) AS right_templates,
  count(*) FILTER (WHERE touched AND parts = 1 AND truth = abstract) AS right_by_tokens FROM parsed_groups GROUP BY {by}),
line_scores AS (SELECT {by}, avg(CASE WHEN truth = parsed THEN 1.0 ELSE 0 END) FILTER (WHERE {listed if wanted else 'TRUE'}) AS pa,
  avg(CASE WHEN array_to_string(list_transform(string_split(truth, ' '), lambda t: CASE WHEN contains(t, '<*>') THEN '<*>' ELSE t END), ' ') = parsed
    THEN 1.0 ELSE 0 END) AS token_pa FROM labelled GROUP BY {by}),
distances AS (SELECT {by}, sum(n * levenshtein(truth, parsed)) / sum(n) AS ed,
  sum(n * (1 - levenshtein(truth, parsed) / greatest(length(truth), length(parsed)))) / sum(n) AS ned FROM cells GROUP BY {by}),
rates AS (SELECT *, right_lines / lines AS ga, right_groups / identified AS pga, right_groups / wanted_templates AS rga,
  right_templates / identified AS pta, right_templates / wanted_templates AS rta,
  right_by_tokens / identified AS ptt, right_by_tokens / wanted_templates AS rtt
  FROM found JOIN identified USING ({by}) JOIN line_scores USING ({by}) JOIN distances USING ({by})),
scores AS (SELECT *, {harmonic('pga', 'rga')} AS fga, {harmonic('pta', 'rta')} AS fta, {harmonic('ptt', 'rtt')} AS ftt FROM rates)"""


LABELLED_ALL = o.LABELLED.replace("SELECT line_id, dataset, CASE WHEN line_id % 97", "SELECT line_id, 0 AS everything, dataset, CASE WHEN line_id % 97")
six = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
add(
    "contingency",
    """SELECT truth, CASE WHEN line_id % 3 <> 0 THEN parsed ELSE '' END AS parsed, count(*) AS lines FROM labelled GROUP BY ALL""",
    o.LABELLED,
)
add("grouping_accuracy", f"SELECT {six('ga', 'pga', 'rga', 'fga')} FROM scores", LABELLED_ALL, scores("everything"))
add("parsing_accuracy", f"SELECT {six('pa')} FROM scores", LABELLED_ALL, scores("everything"))
add("token_accuracy", f"SELECT {six('token_pa')} FROM scores", LABELLED_ALL, scores("everything"))
add("edit_distance", f"SELECT {six('ed', 'ned')} FROM scores", LABELLED_ALL, scores("everything"))
add(
    "template_accuracy",
    f"SELECT identified, truths AS ground_truth, {six('pta', 'rta', 'fta')} FROM scores",
    LABELLED_ALL,
    scores("everything"),
)
add(
    "template_accuracy_by_tokens",
    "SELECT identified, truths AS ground_truth, round(ptt, 6) AS pta, round(rtt, 6) AS rta, round(ftt, 6) AS fta FROM scores",
    LABELLED_ALL,
    scores("everything"),
)
add(
    "metrics_filtered",
    f"SELECT identified, wanted_templates AS ground_truth, {six('ga', 'pga', 'rga', 'fga', 'pa', 'pta', 'rta', 'fta')} FROM scores",
    LABELLED_ALL,
    "wanted AS (SELECT DISTINCT truth_template AS t FROM event_lines WHERE event_type IN ('click', 'view', 'signup'))",
    scores("everything", "wanted"),
)
three = ", ".join(f"round({n}, 3) AS {m}" for n, m in (("ga", "ga"), ("pa", "pa"), ("fga", "fga"), ("fta", "fta"), ("ned", "ed")))
mean = ", ".join(f"round(avg({n}), 3)" for n in ("identified_templates", "ground_templates", "ga", "pa", "fga", "fta", "ed"))
add(
    "metrics_suite",
    f"SELECT * FROM per_dataset UNION ALL SELECT 'Average', {mean} FROM per_dataset",
    o.LABELLED,
    scores("dataset"),
    f"""per_dataset AS (SELECT dataset, identified::DOUBLE AS identified_templates, truths::DOUBLE AS ground_templates, {three} FROM scores
      UNION ALL SELECT max(dataset) || ' later', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM labelled)""",
)

SEPARATORS = r"""\s\x{1c}-\x{1f}!"#$%&''()+,\-/:;=?@.\[\\\]^_`{|}~"""
DROPPED = r"""[!"#$%&''+,\-/:;?@.\[\\\]^_`{}~ ]"""


def similarity(c: str) -> str:
    marked = (
        f"list_transform(regexp_extract_all({c}, '[^{SEPARATORS}]+|[{SEPARATORS}]+'), lambda t: "
        f"CASE WHEN contains(t, '<*>') THEN '<*>' ELSE regexp_replace(t, '{DROPPED}', '', 'g') END)"
    )
    return f"list_transform(list_filter({marked}, lambda t: t <> ''), lambda t: trim(t))"


def unrepeated(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t, i: NOT (t = '<*>' AND i > 1 AND {tokens}[i - 1] = '<*>'))"


add(
    "similarity_tokens",
    f"SELECT line_id, array_to_string({unrepeated('toks')}, '|') AS tokens FROM "
    f"(SELECT line_id, {similarity('''regexp_replace(content, '[0-9]+', '<*>', 'g')''')} AS toks FROM all_lines)",
    o.ALL_LINES,
)
add(
    "similarity_accuracy",
    """SELECT round(sum(n * shared / (len(x) + len(y) - shared)) / sum(n), 6) AS sa FROM (
      SELECT n, x, y, len(list_intersect(x, y)) AS shared FROM unrepeated_cells)""",
    o.LABELLED,
    f"""cells AS (SELECT truth, parsed, count(*) AS n, {similarity('truth')} AS tx, {similarity('parsed')} AS ty
      FROM labelled WHERE truth IS NOT NULL GROUP BY truth, parsed),
    unrepeated_cells AS (SELECT n, {unrepeated('tx')} AS x, {unrepeated('ty')} AS y FROM cells)""",
)
add(
    "run_metrics",
    """SELECT event_type AS dataset, round(value, 3) AS invocation_time, user_id::DOUBLE AS parsing_time FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""",
)

# --- ground truth ---------------------------------------------------------------

CORRECTED = f"""
seen AS (SELECT event_template, min(line_id) AS first, arg_min(event_id, line_id) AS event_id FROM structured GROUP BY event_template),
per_id AS (SELECT event_id, arg_max(event_template, first) AS event_template FROM seen GROUP BY event_id),
rewritten AS (SELECT event_id, event_template, {o.normal('event_template', 'oracle')} AS new_template FROM per_id),
corrected AS (SELECT *, min(event_id) OVER (PARTITION BY new_template) AS new_event_id FROM rewritten)"""
add(
    "correct_ground_truth",
    """SELECT s.line_id, coalesce(c.new_event_id, s.event_id) AS event_id, coalesce(c.new_template, s.event_template) AS event_template,
      c.event_id IS NOT NULL AS corrected FROM structured s LEFT JOIN corrected c USING (event_id)""",
    o.STRUCTURED,
    CORRECTED,
)
add(
    "corrected_templates",
    "SELECT DISTINCT new_event_id AS event_id, new_template AS event_template FROM corrected",
    o.STRUCTURED,
    CORRECTED,
)
add(
    "correction_report",
    """SELECT count(DISTINCT event_id) AS templates_before, count(DISTINCT new_template) AS templates_after,
      count(*) FILTER (WHERE event_template <> new_template) AS templates_changed FROM corrected""",
    o.STRUCTURED,
    CORRECTED,
)
add(
    "templates_by_length",
    "SELECT DISTINCT event_template, length(event_template)::INTEGER AS length FROM structured",
    o.STRUCTURED,
)
add("natural_order", "SELECT DISTINCT event_id, event_template FROM structured", o.STRUCTURED)
