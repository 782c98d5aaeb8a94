"""The SQL counterparts of `inputs`, as common table expressions for DuckDB."""

BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

EVENT_LINES = """
event_lines AS (
  SELECT event_id AS line_id, event_type, strftime(ts, '%Y-%m-%d') AS dataset,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CAST(k AS INTEGER) AS k,
    CASE event_type
      WHEN 'click' THEN 'click handler: user ' || u || ' opened item ' || k || ' in ' || c || ' ms'
      WHEN 'view' THEN 'Received view of page /item/' || k || ' size ' || c || ' from user=' || u
      WHEN 'purchase' THEN 'purchase order ' || event_id || ' completed: amount ' || c || ', user ' || u
      WHEN 'signup' THEN 'session opened for user ' || u || ' by (uid=' || k || ')'
      WHEN 'error' THEN '[client 10.0.' || (u % 250) || '.' || k || '] request failed: code ' || c
    END AS content,
    CASE event_type
      WHEN 'click' THEN 'click handler: user <*> opened item <*> in <*> ms'
      WHEN 'view' THEN 'Received view of page <*> size <*> from user=<*>'
      WHEN 'purchase' THEN 'purchase order <*> completed: amount <*>, user <*>'
      WHEN 'signup' THEN 'session opened for user <*> by (uid=<*>)'
      WHEN 'error' THEN '[client <*>] request failed: code <*>'
    END AS truth_template
  FROM (SELECT event_id, ts, event_type, user_id AS u, json_extract_string(props, '$.k') AS k,
          CAST(round(value * 100) AS BIGINT) AS c FROM events)
)"""

DOCUMENT_LINES = """
document_lines AS (
  SELECT doc_id * 1000000 + pos AS line_id, lang, content FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS content,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  WHERE trim(content) <> ''
)"""

ALL_LINES = f"""{DOCUMENT_LINES},{EVENT_LINES},
all_lines AS (
  SELECT line_id, content FROM document_lines
  UNION ALL SELECT -1 - line_id, content FROM event_lines
)"""

LABELLED = f"""{EVENT_LINES},
labelled AS (
  SELECT line_id, dataset, CASE WHEN line_id % 97 <> 0 THEN truth_template END AS truth,
    CASE WHEN event_type = 'view' AND line_id % 2 = 0 THEN replace(truth_template, 'page <*>', 'page /item/<*>')
      WHEN event_type = 'signup' THEN replace(truth_template, '(uid=<*>)', '<*>')
      WHEN event_type = 'error' AND line_id % 10 = 0 THEN 'click handler: user <*> opened item <*> in <*> ms'
      ELSE truth_template END AS parsed
  FROM event_lines
)"""

KNOWN_TEMPLATES = f"""{EVENT_LINES},
plain AS (
  SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS template_id,
    min(truth_template) AS event_template, arg_min(content, line_id) AS reference_log, count(*) AS hits
  FROM event_lines GROUP BY event_type
),
known AS (
  SELECT * FROM plain
  UNION ALL SELECT template_id + 10, replace(event_template, ' <*>', ' <*><*>'), reference_log, hits + 1 FROM plain
)"""

STRUCTURED = f"""{EVENT_LINES},
structured AS (
  SELECT line_id, content,
    'E' || (CASE event_type WHEN 'click' THEN k WHEN 'view' THEN 100 + k WHEN 'purchase' THEN 200
      WHEN 'signup' THEN 300 + k ELSE 400 + k END) AS event_id,
    CASE event_type
      WHEN 'click' THEN 'click handler: user <*> opened item ' || k || ' in <*> ms'
      WHEN 'view' THEN 'Received view of page /item/' || k || ' size <*> from user=<*>'
      WHEN 'purchase' THEN 'purchase order <*> completed: amount <*>, user <*>'
      WHEN 'signup' THEN 'session opened for user <*> by (uid=' || k || ')'
      ELSE '[client <*>.' || k || '] request failed: code <*>' END AS event_template
  FROM event_lines
)"""


def tokens(c: str) -> str:
    kept = (
        f"list_filter(list_transform(string_split_regex({c}, '[ ,|]'), lambda w: CASE "
        "WHEN contains(w, '=') THEN (CASE WHEN length(w) - length(replace(w, '=', '')) = 1 "
        "THEN split_part(w, '=', 1) ELSE '' END) "
        r"WHEN regexp_matches(w, '\p{Nd}') THEN '' WHEN contains(w, '/') THEN '' ELSE w END), lambda w: w <> '')"
    )
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE [{mask(c)}] END"


def mask(c: str) -> str:
    return rf"regexp_replace({c}, '\p{{Nd}}+(\.\p{{Nd}}+)?', '0', 'g')"


def flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANK}+', ' ', 'g'))"


def word_list(c: str) -> str:
    return f"list_filter(string_split({flat(c)}, ' '), lambda w: w <> '')"


def clean(c: str) -> str:
    """The list of clean words."""
    blanked = rf"""regexp_replace({c}, ':|\(|\)|=|,|"|\{{|\}}|@|\[|\]|\||;|\.?!', ' ', 'g')"""
    return rf"list_filter({word_list(blanked)}, lambda w: NOT regexp_matches(w, '\p{{Nd}}'))"


def signature(c: str) -> str:
    return (
        f"array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace({c}, "
        "'[0-9A-Za-z, ]+', '', 'g'), ''), lambda x: x <> ''))), '')"
    )


def words(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]+')"


STOP = (
    "['a','an','and','i','ie','so','to','the','Monday','Tuesday','Wednesday','Thursday','Friday',"
    "'Saturday','Sunday','Mon','Tue','Wed','Thu','Fri','Sat','Sun','January','February','March',"
    "'April','May','June','July','August','September','October','November','December','Jan','Feb',"
    "'Mar','Apr','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
)


def no_stop(words_list: str) -> str:
    return f"list_filter({words_list}, lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))"


PATH = r"""\s,!;:=|"''\[\](){}"""
TOKEN = PATH + r".\-+@#$%&"


def cut(c: str, ends: str = TOKEN) -> str:
    return f"regexp_extract_all({c}, '[^{ends}]+|[{ends}]')"


def valid(c: str) -> str:
    return rf"regexp_matches(replace(replace({c}, '<*>', ''), ' ', ''), '[^!-/:-@\[-`{{-~]')"


def repeat(expression: str, start: str, times: int) -> str:
    """Apply an expression in ``s`` several times, without nesting the text."""
    return f"list_reduce([{start}] || list_transform(range({times}), lambda i: ''), lambda s, x: {expression})"


def merge(c: str, separator: str) -> str:
    return rf"regexp_replace({c}, '<\*>({separator}<\*>)+', '<*>', 'g')"


def normal(c: str, ruleset: str) -> str:
    if ruleset == "general":
        step = merge_once = "s"
        for pattern, value in (
            (r"<\*><\*>", "<*>"), (r"<\*>:<\*>", "<*>"), (r"<\*> <\*>", "<*>"), ("''<\\*>''", "<*>"),
            (r"<\*> [KGTM]?B", "<*>"), (r"node-<\*>", "<*>"), (r"node-\[<\*>\]", "<*>"),
            (r"<\*>##<\*>", "<*>"), (r"<\*>,<\*>", "<*>"), (r"GET <\*>", "<*>"), (r"POST <\*>", "<*>"),
            (r"DELETE <\*>", "<*>"), ("tty=ssh", "tty=<*>"), ("tty=NODEVssh", "tty=<*>"),
        ):
            step = f"regexp_replace({step}, '{pattern}', '{value}', 'g')"
        return merge(repeat(step, merge(c, r"\."), 12), ":")
    text = flat(c)
    if ruleset != "light":
        ends = PATH + "+" if ruleset == "large" else PATH
        if ruleset == "oracle":
            rule = "regexp_matches(t, '^(/[^/]+)+$')"
        else:
            rule = (
                r"regexp_matches(t, '^(/[^/]+)+/?$') OR regexp_matches(t, '^([a-z0-9-]+\.){2,}[a-z]+$') "
                "OR (contains(t, '<*>') AND contains(t, '.') AND contains(t, '/'))"
            )
        text = (
            f"array_to_string(list_transform({cut(text, ends)}, lambda t: CASE WHEN {rule} "
            "THEN '<*>' ELSE t END), '')"
        )
    names = "('true','false','null','root','admin')"
    rule = r"regexp_matches(t, '^[^\s/]*<\*>[^\s/]*$')"
    if ruleset in ("base", "large"):
        digits = r"length(regexp_replace(t, '\P{Nd}', '', 'g'))"
        rule += (
            rf" OR {digits} >= 4 OR ({digits} > 0 AND NOT regexp_matches(t, '\p{{Lu}}') "
            f"AND {digits} / length(t) > 0.3)"
        )
    else:
        rule += r" OR regexp_matches(t, '^\p{Nd}+$')"
    if ruleset in ("base", "oracle"):
        rule += f" OR lower(t) IN {names}"
    elif ruleset == "large":
        rule += f" OR t IN {names}"
    text = (
        f"array_to_string(list_transform({cut(text)}, lambda t: CASE WHEN {rule} "
        "THEN '<*>' ELSE t END), '')"
    )
    text = merge(merge(text, r"\."), "")
    quotes = lambda x: f"""replace(replace(replace(replace({x}, ' "<*>" ', ' <*> '), ' "<*>" ', ' <*> '), ' ''<*>'' ', ' <*> '), ' ''<*>'' ', ' <*> ')"""
    hashes = lambda x: f"replace(replace({x}, ' #<*> ', ' <*> '), ' #<*> ', ' <*> ')"
    units = lambda x: rf"regexp_replace({x}, '<\*> [KGTM]?B\b', '<*>', 'g')"
    if ruleset == "base":
        text = merge(merge(text, ":"), "/")
        text = units(f"replace({text}, ' -<*>', ' <*>')")
    elif ruleset == "large":
        text = repeat("replace(s, '#<*>#', '<*>')", text, 8)
        text = merge(hashes(merge(merge(text, ":"), "/")), ":")
        for separator in ("#", "/", "@", r"\."):
            text = merge(text, separator)
        text = units(merge(quotes(text), ""))
    elif ruleset == "light":
        text = f"replace(replace({text}, ' #<*># ', ' <*> '), ' #<*># ', ' <*> ')"
        text = hashes(text)
        for separator in (":", "#", "/", "@", r"\."):
            text = merge(text, separator)
        text = merge(quotes(text), "")
    return text


def pattern(t: str) -> str:
    """The anchored lazy expression of a template."""
    parts = f"list_transform(string_split({t}, '<*>'), lambda p: regexp_escape(p))"
    return f"'^' || array_to_string({parts}, '(.*?)') || '$'"
