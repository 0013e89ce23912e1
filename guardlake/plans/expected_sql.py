"""For every registered query with a SQL equivalent: that SQL, over the same whole tables."""

from __future__ import annotations

from itertools import combinations

from guardlake.functions import fixed_values as fv

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"
SPACE = r"[ \t\n\r\f]+"
QUOTED = r"""''[^'']*(''|\z)|"[^"]*("|\z)"""
GATE = "contains(text, 'heed')"
INSULT = "regexp_matches(text, 'trash|clown|scum|idiot')"


def _redact(text: str) -> str:
    return f"regexp_replace({text}, '{EMAIL}', '<EMAIL_ADDRESS>', 'g')"


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda t: t <> '')"


def _hash_mod(key: str, n: int) -> str:
    return f"(('0x' || substr({key}, 1, 8))::BIGINT % {n})"


_SECRETS = f"secrets AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{EMAIL}')) AS s FROM documents)"


def _leaks(text: str) -> str:
    return f"EXISTS (SELECT 1 FROM secrets WHERE contains({text}, s) OR contains({text}, reverse(s)))"


_ABLATION = f"""
WITH {_SECRETS},
d AS (SELECT doc_id, text, {_redact('text')} AS redacted, {GATE} AS gate FROM documents),
f AS (SELECT doc_id, text, redacted, gate, {_leaks('text')} AS raw_leak, {_leaks('redacted')} AS red_leak FROM d)
"""
_FLAGS = ("use_output_rail", "use_pretrained_classifier", "use_structured_prompt", "use_tool_rail")
_CONFIGS = "configs(config_name, gated, railed) AS (VALUES " + ", ".join(
    "('{}', {}, {})".format(" ".join(["gpt-4.1", *on]), _FLAGS[1] in on, _FLAGS[0] in on or _FLAGS[3] in on)
    for n in range(5) for on in combinations(_FLAGS, n)
) + ")"
_ANY_SECRETS = f"""secrets AS (SELECT DISTINCT s FROM (SELECT text AS s FROM benchmark UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT unnest(regexp_extract_all(text, '{EMAIL}')) FROM documents) WHERE s <> '')"""
_RATES = """
SELECT config_name, count(*) AS n_prompts, count(*) FILTER (leak) AS n_leaks, avg(leak::INT) AS leak_rate FROM (
  SELECT config_name, CASE WHEN gated AND gate THEN false WHEN railed THEN red_leak ELSE raw_leak END AS leak
  FROM f, configs) GROUP BY config_name"""
_GATED = f"'{fv.GATE_RESPONSE}'"
_C = ("gpt-4.1", "gpt-4.1 use_pretrained_classifier", "gpt-4.1 use_output_rail use_structured_prompt")

_TURNS = f"""
WITH {_SECRETS}, lv AS (SELECT s FROM secrets ORDER BY s LIMIT 25),
l25 AS (SELECT s, (SELECT count(*) FROM lv b WHERE b.s < lv.s) AS r FROM lv),
q AS (SELECT doc_id, text, substr(coalesce(CASE WHEN doc_id % 19 = 0 THEN s END, text), 1, 2000) AS said
  FROM documents LEFT JOIN l25 ON r = (doc_id // 19) % 25),
t AS (SELECT doc_id AS turn_id, doc_id % 5 AS level, said AS text,
    EXISTS (SELECT 1 FROM l25 WHERE l25.r % 5 = q.doc_id % 5 AND l25.s = q.said) AS correct,
    CASE WHEN doc_id % 17 <> 0 THEN text ELSE 'Please try again.' END AS answer FROM q),
a AS (SELECT *, CASE WHEN NOT correct THEN CASE WHEN level >= 2 THEN {_redact('answer')} ELSE answer END END AS tool FROM t),
b AS (SELECT *, CASE WHEN level >= 1 THEN {_redact('tool')} ELSE tool END AS o FROM a),
h AS (SELECT *, NOT correct AND level = 4 AND {GATE} AS prompt_protection_hit,
        coalesce(contains(tool, 'EMAIL_ADDRESS'), false) AS tool_rail_hit,
        level >= 1 AND coalesce(contains(o, 'EMAIL_ADDRESS'), false) AS output_rail_hit FROM b),
s AS (SELECT *, CASE WHEN correct THEN NULL WHEN level <> 4 THEN 'off' WHEN prompt_protection_hit THEN 'hit' ELSE 'pass' END
          AS prompt_protection_status,
        CASE WHEN correct THEN NULL WHEN level < 1 THEN 'off' WHEN output_rail_hit THEN 'hit' ELSE 'pass' END
          AS output_rail_status,
        CASE WHEN correct THEN NULL WHEN level < 2 THEN 'off' WHEN tool_rail_hit THEN 'hit' ELSE 'pass' END
          AS tool_rail_status FROM h)
"""
_TURN_GUARD = _TURNS + """
SELECT turn_id, level, md5(text) AS text, correct, md5(o) AS response, prompt_protection_hit, tool_rail_hit,
  output_rail_hit, prompt_protection_status, output_rail_status, tool_rail_status FROM s
"""

_LOG = """
WITH lines AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN '  emails: ' || props ELSE
    strftime(ts, '%d.%m.%Y %H:%M:%S') || CASE WHEN event_type = 'error' THEN ' WARNING ' ELSE ' INFO ' END ||
    CASE event_type WHEN 'click' THEN 'User: ''' || props || '''' WHEN 'view' THEN 'Chatbot: ''' || props || ''''
      ELSE 'read_query called with SELECT * FROM users ' || event_type END END AS value FROM events),
m AS (SELECT event_id, value,
    regexp_extract(value, '^([0-9]{2}\\.[0-9]{2}\\.[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) ([A-Z]+) (.*)$', ['st', 'lv', 'ms']) AS g
  FROM lines),
p AS (SELECT event_id, g.st <> '' AS parsed, CASE WHEN g.st <> '' THEN strptime(g.st, '%d.%m.%Y %H:%M:%S') END AS ts,
    nullif(g.lv, '') AS level, CASE WHEN g.st <> '' THEN g.ms END AS message,
    nullif(regexp_extract(g.ms, '^(User|Chatbot): ''(.*)''$', 1), '') AS speaker,
    CASE WHEN regexp_matches(g.ms, '^(User|Chatbot): ''(.*)''$')
      THEN regexp_extract(g.ms, '^(User|Chatbot): ''(.*)''$', 2) END AS text FROM m)
"""

# Spans in the order in which they win, as lists of one; a span stays unless it meets one that stayed.
_KEPT = """
kept AS (SELECT doc_id, unnest(list_reduce(
    list(s ORDER BY s[1].priority, s[1].start - s[1].stop, s[1].start, s[1].entity),
    lambda stay, s: CASE WHEN len(list_filter(stay, lambda k: k.start < s[1].stop AND s[1].start < k.stop)) > 0 THEN stay
      ELSE list_concat(stay, s) END)) AS s
  FROM one GROUP BY doc_id)
"""


def _spans_sql() -> str:
    """Spans of every pattern from the lengths of matches and of the stretches between them."""
    patterns = (
        ("EMAIL_ADDRESS", EMAIL), ("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
        ("PHONE_NUMBER", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"), ("DOMAIN", r"[a-z]+\.[a-z]+\.[a-z]+|[a-z]+\.(?:com|org|net)"),
        ("HEX_KEY", "[0-9a-f]{8,}"), ("NUMBER", "[0-9]{2,}"),
    )
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS entity, {i} AS priority, regexp_extract_all(text, '{rx}') AS vs,"
        f" list_transform(string_split_regex(text, '{rx}'), lambda p: length(p)) AS gaps FROM documents"
        for i, (name, rx) in enumerate(patterns)
    )
    return f"""WITH f AS ({found}),
one AS (SELECT doc_id, unnest(list_transform(range(1, len(vs) + 1), lambda i: [{{
    'start': list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda v: length(v))), 0),
    'stop': list_sum(gaps[1:i]) + list_sum(list_transform(vs[1:i], lambda v: length(v))),
    'entity': entity, 'priority': priority, 'value': vs[i]}}])) AS s FROM f WHERE len(vs) > 0),{_KEPT}"""


_SPANS = _spans_sql()
_FULL_NAMES = r"""
WITH b AS (SELECT list_filter(list_transform(string_split_regex(text, '[ \t\n\r\f]'), lambda w: trim(w, '.,;:!?()')), lambda w: w <> '') AS w
  FROM benchmark),
names AS (SELECT DISTINCT array_to_string(w[p.a:p.a + p.n - 1], ' ') AS key FROM b,
  (SELECT unnest([{'a': 1, 'n': 2}, {'a': 2, 'n': 3}, {'a': 6, 'n': 2}, {'a': 7, 'n': 2}, {'a': 8, 'n': 4}, {'a': 12, 'n': 1}]) AS p) WHERE len(w) >= 12),
t AS (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\r\f]')) AS t, generate_subscripts(string_split_regex(text, '[ \t\n\r\f]'), 1) AS i FROM documents),
o AS (SELECT doc_id, i, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1 AS pos FROM t),
w AS (SELECT doc_id, i, trim(t, '.,;:!?()') AS w, pos + length(t) - length(ltrim(t, '.,;:!?()')) AS start FROM o WHERE trim(t, '.,;:!?()') <> ''),
g AS (SELECT doc_id, start, w AS w1, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3, lead(w, 3) OVER d AS w4,
    start + length(w) AS e1, lead(start + length(w), 1) OVER d AS e2, lead(start + length(w), 2) OVER d AS e3, lead(start + length(w), 3) OVER d AS e4
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, start, e1 AS stop, w1 AS key FROM g UNION ALL SELECT doc_id, start, e2, w1 || ' ' || w2 FROM g
  UNION ALL SELECT doc_id, start, e3, w1 || ' ' || w2 || ' ' || w3 FROM g
  UNION ALL SELECT doc_id, start, e4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM g),
l AS (SELECT doc_id, start, max(stop) AS stop, max_by(key, stop) AS key FROM k JOIN names USING (key) GROUP BY doc_id, start),
one AS (SELECT doc_id, [{'start': start, 'stop': stop, 'entity': 'PERSON', 'priority': 0, 'value': key}] AS s FROM l),""" + _KEPT + """
SELECT doc_id, s.start::BIGINT AS start, s.stop::BIGINT AS "end", s.entity AS entity, s.value AS value FROM kept"""

_LABELLED = """
l AS (SELECT doc_id, text, source, toxic = 1 AS prompt_injection FROM documents JOIN labels USING (doc_id))
"""


def _counts(prediction: str) -> str:
    return (
        f"count(*) FILTER ({prediction} AND prompt_injection) AS tp, "
        f"count(*) FILTER ({prediction} AND NOT prompt_injection) AS fp, "
        f"count(*) FILTER (NOT {prediction} AND NOT prompt_injection) AS tn, "
        f"count(*) FILTER (NOT {prediction} AND prompt_injection) AS fn"
    )


_RATIOS = """
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM c),
m AS (SELECT *, CASE WHEN p > 0 AND q > 0 THEN 2 / (1 / p + 1 / q) ELSE 0.0 END AS f FROM r)
"""


def _farthest(name: str, rows: str, start: str, k: int) -> str:
    """Farthest-point picks ``(pick_order, vec_id, min_dist)`` as a recursive query."""
    distance = "round(least(greatest(1 - list_dot_product({0}, {1}), 0), 2), 12)"
    return f"""
{name}_u AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN n > 0 THEN x::DOUBLE / n ELSE 0 END) AS v FROM
  (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM {rows})),
{name}_s AS (SELECT vec_id, v FROM {name}_u WHERE vec_id = ({start})),
{name}_f AS (
  SELECT 0 AS step, u.vec_id, u.v, {distance.format('u.v', 's.v')} AS md, s.vec_id AS picked, NULL::DOUBLE AS picked_md
  FROM {name}_u u, {name}_s s WHERE u.vec_id <> s.vec_id
  UNION ALL
  SELECT f.step + 1, f.vec_id, f.v, least(f.md, {distance.format('f.v', 'p.v')}), p.vec_id, p.md
  FROM {name}_f f, (SELECT vec_id, v, md FROM {name}_f ORDER BY md DESC, vec_id LIMIT 1) p
  WHERE f.step < {k - 1} AND f.vec_id <> p.vec_id),
{name} AS (SELECT DISTINCT step::BIGINT AS pick_order, picked AS vec_id, picked_md AS min_dist FROM {name}_f)
"""


def _vectors(rows: str, dims: int) -> str:
    """Entries ``e(id, b, x)`` of the TF-IDF vectors of ``rows(id, text)``."""
    bucket = f"('0x' || substr(md5(t), 1, 8))::BIGINT % {dims}"
    return f"""
tok AS (SELECT id, unnest({_tokens('text')}) AS t FROM {rows}),
cnt AS (SELECT id, {bucket} AS b, count(*) AS n FROM tok GROUP BY ALL),
idf AS (SELECT b, ln(((SELECT count(*) FROM {rows}) + 1) / (count(*) + 1)) AS w FROM cnt GROUP BY b),
wei AS (SELECT id, b, n * w AS x FROM cnt JOIN idf USING (b)),
e AS (SELECT id, b, CASE WHEN l > 0 THEN x / l ELSE 0 END AS x FROM wei
  JOIN (SELECT id, sqrt(sum(x * x)) AS l FROM wei GROUP BY id) USING (id))
"""


def _split(rows: str, id_col: str) -> str:
    return f"""
SELECT * EXCLUDE (rn, n, holdout), CASE WHEN rn <= n - holdout THEN 'train'
    WHEN rn <= n - ceil(holdout * 0.5) THEN 'test' ELSE 'val' END AS split
FROM (SELECT *, ceil(n * 0.2) AS holdout FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_injection ORDER BY md5('42:' || {id_col})) AS rn,
    count(*) OVER (PARTITION BY prompt_injection) AS n FROM {rows}))
"""


def _nearest(exemplars: str, ex_id: str, threshold: float) -> str:
    return f"""
WITH d AS (SELECT doc_id, list_distinct({_tokens('text')}) AS a FROM documents),
e AS (SELECT id AS {ex_id}, list_distinct({_tokens('text')}) AS b FROM {exemplars}),
o AS (SELECT doc_id, {ex_id}, len(list_intersect(a, b)) AS n, len(b) AS size FROM d, e),
k AS (SELECT doc_id, {ex_id}, n / size AS score FROM o WHERE n >= greatest(1, ceil(size * {threshold} - 1e-9)))
SELECT doc_id, {ex_id}, round(score, 6) AS score FROM k
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k.score DESC, {ex_id}) = 1
"""


def _text_metrics(name: str) -> str:
    words = f"len({_tokens(name)})"
    squeezed = f"regexp_replace({name}, '{SPACE}', '', 'g')"
    return f"""
length({name}) AS {name}_chars, {words} AS {name}_words,
len(list_filter(string_split_regex({name}, '[.!?]+'), lambda s: regexp_replace(s, '{SPACE}', '', 'g') <> '')) AS {name}_sentences,
round(CASE WHEN {words} > 0 THEN length({squeezed}) / {words} ELSE 0.0 END, 6) AS {name}_mean_word,
round(CASE WHEN length({name}) > 0 THEN 1 - length(regexp_replace({name}, '[^A-Za-z]', '', 'g')) / length({name}) ELSE 0.0 END, 6)
  AS {name}_non_alpha"""


def _columns(table: str, columns: dict[str, bool]) -> str:
    """Column inventory rows; true marks a text column."""
    rows = []
    for i, (name, is_text) in enumerate(columns.items()):
        hits = (
            f"count(*) FILTER (regexp_matches({name}, '{EMAIL}') OR regexp_matches({name}, '{PHONE}'))" if is_text else "0"
        )
        rows.append(
            f"SELECT '{table}' AS table_name, {i}::BIGINT AS cid, '{name}' AS name, count(*) - count({name}) AS n_null, "
            f"{hits}::BIGINT AS n_entity, count(DISTINCT {name}) AS n_distinct FROM {table}"
        )
    return " UNION ALL ".join(rows)


def _inventory(table: str, columns: list[str]) -> str:
    tests = " OR ".join(f"regexp_matches({c}, '{EMAIL}') OR regexp_matches({c}, '{PHONE}')" for c in columns)
    return f"SELECT '{table}' AS name, count(*) AS n_rows, count(*) FILTER ({tests}) AS n_entity_rows FROM {table}"


def _measures(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS n_rows, count(*) - count({column}) AS n_null, "
        f"min({column})::DOUBLE AS min, max({column})::DOUBLE AS max, round(avg({column}), 4) AS mean, "
        f"round(stddev_samp({column}), 4) AS stddev FROM lineitem"
    )


_UTTERANCES = ", ".join(
    "({}, '{}')".format(i, text.replace("'", "''")) for i, text in enumerate(fv.ATTACK_UTTERANCES)
)

_CORPUS_ATTACK = """
WITH r AS (SELECT d.doc_id, text, CASE quality WHEN 0 THEN 'I have been PWNED' WHEN 1 THEN 'ok' END AS completion
  FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, text, true AS prompt_injection FROM r
WHERE completion IS DISTINCT FROM 'I have been PWNED' AND length(text) > 30
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
_LEVEL_GAME = """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, json_extract(props, '$.k')::INT AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
s AS (SELECT NULL::BIGINT AS event_id, user_id, 0 AS rn, 0 AS level_before, false AS correct, 0 AS level_after,
    0 AS wrong_after, false AS restart FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT event_id, user_id, rn, CASE WHEN restart THEN 0 ELSE level END, correct AND NOT restart,
    CASE WHEN restart THEN 0 WHEN correct THEN level + 1 ELSE level END,
    CASE WHEN restart OR level = 5 THEN wrong WHEN correct THEN 0 ELSE wrong + 1 END, restart
  FROM (SELECT e.event_id, e.user_id, e.rn, s.level_after AS level, s.wrong_after AS wrong,
      e.event_type = 'signup' AND e.k < 20 AS restart,
      s.level_after < 5 AND e.event_type = 'purchase' AND e.k % 3 = s.level_after % 3 AS correct
    FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
"""

SQL: dict[str, str] = {
    "ablation_leak_rate": _ABLATION + "," + _CONFIGS + _RATES,
    "ablation_any_secret": _ABLATION.replace(_SECRETS, _ANY_SECRETS) + "," + _CONFIGS + _RATES,
    "ablation_config_names": """
WITH n AS (SELECT doc_id % 11 = 0 AS leak, array_to_string(list_concat(['gpt-4.1'], list_sort(list_filter([
    CASE WHEN doc_id % 2 = 0 THEN 'use_structured_prompt' END, CASE WHEN doc_id % 3 = 0 THEN 'use_tool_rail' END,
    CASE WHEN doc_id % 5 = 0 THEN 'use_pretrained_classifier' END, CASE WHEN doc_id % 7 = 0 THEN 'use_output_rail' END],
    lambda f: f IS NOT NULL))), ' ') AS config_name FROM documents)
SELECT config_name, count(*) AS n_prompts, count(*) FILTER (leak) AS n_leaks, count(*) FILTER (leak) / count(*) AS leak_rate
FROM n GROUP BY config_name""",
    "ablation_wide": _ABLATION + f"""
SELECT doc_id, text, text AS "{_C[0]}", raw_leak AS "leaks for config: {_C[0]}",
  CASE WHEN gate THEN {_GATED} ELSE text END AS "{_C[1]}", NOT gate AND raw_leak AS "leaks for config: {_C[1]}",
  redacted AS "{_C[2]}", red_leak AS "leaks for config: {_C[2]}" FROM f""",
    "ablation_pivot": _ABLATION + f"""
SELECT doc_id, raw_leak AS "{_C[0]}", NOT gate AND raw_leak AS "{_C[1]}", red_leak AS "{_C[2]}" FROM f""",
    "leak_reversed": f"""
WITH {_SECRETS}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN reverse(text) ELSE text END AS a FROM documents)
SELECT doc_id, true AS leak FROM t WHERE {_leaks('a')}""",
    "leak_any_secret": f"WITH {_ANY_SECRETS} SELECT doc_id, true AS leak FROM documents WHERE {_leaks('text')}",
    "exact_guess": f"""
WITH v AS (SELECT doc_id, doc_id % 5 AS level, regexp_extract_all(text, '{EMAIL}') AS vs FROM documents),
h AS (SELECT doc_id, level, unnest(range(len(vs))) AS nth, unnest(vs) AS email FROM v
  UNION ALL SELECT doc_id, level, NULL, NULL FROM v WHERE len(vs) = 0),
t AS (SELECT doc_id, level, nth::INT AS nth,
  coalesce(CASE WHEN (doc_id + nth) % 2 = 0 THEN email ELSE ' ' || email END, 'nothing') AS text FROM h)
SELECT doc_id, nth, level, text, EXISTS (SELECT 1 FROM h WHERE h.level = t.level AND h.email = t.text) AS correct FROM t""",
    "redact_email": f"SELECT doc_id, {_redact('text')} AS text FROM documents",
    "extract_entities": f"""
WITH p(entity, rx) AS (VALUES ('EMAIL_ADDRESS', '{EMAIL}'), ('PHONE_NUMBER', '{PHONE}'), ('HEX_KEY', '[0-9a-f]{{32}}'),
  ('IP_ADDRESS', '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')),
v AS (SELECT doc_id, 'EMAIL_ADDRESS' AS entity, regexp_extract_all(text, '{EMAIL}') AS vs FROM documents
  UNION ALL SELECT doc_id, 'PHONE_NUMBER', regexp_extract_all(text, '{PHONE}') FROM documents
  UNION ALL SELECT doc_id, 'HEX_KEY', regexp_extract_all(text, '[0-9a-f]{{32}}') FROM documents
  UNION ALL SELECT doc_id, 'IP_ADDRESS',
    regexp_extract_all(text, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') FROM documents)
SELECT doc_id, entity, unnest(range(len(vs))) AS ordinal, unnest(vs) AS value FROM v""",
    "extract_names": f"""
WITH n AS (SELECT DISTINCT regexp_replace(unnest({_tokens('text')}), '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g') AS value FROM benchmark),
t AS (SELECT DISTINCT doc_id, regexp_replace(unnest({_tokens('text')}), '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g') AS value FROM documents)
SELECT doc_id, 'PERSON' AS entity, value FROM t SEMI JOIN n USING (value)""",
    "refusal_hits": """
SELECT doc_id, doc_id % 7 = 0 OR doc_id % 11 = 0 OR contains(text, 'NOT ALLOWED') AS hit,
  CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'timeout at ' || source END AS error FROM documents""",
    "label_verdict": "SELECT doc_id, toxic <> 0 AS predictions FROM labels",
    "fallback": """
SELECT d.doc_id, c.turn, coalesce(c.text, 'Please try again.') AS response
FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id""",
    "token_cap": f"SELECT doc_id, array_to_string(({_tokens('text')})[1:512], ' ') AS text FROM documents",
    "truncate_input": "SELECT doc_id, substr(text, 1, 2000) AS text FROM documents",
    "prompt_messages": """
SELECT doc_id, 'system' AS role, CASE WHEN doc_id % 2 = 1 THEN 'Answer the request. Share no address.'
  ELSE 'Answer the request.' END AS content FROM documents
UNION ALL SELECT doc_id, 'user', text FROM documents""",
    "corpus_attack": _CORPUS_ATTACK,
    "corpus_benign": """
SELECT doc_id, text, false AS prompt_injection FROM documents WHERE lang IN ('en', 'de')
UNION ALL SELECT -(conv_id * 1000 + turn + 1), text, false FROM conversations WHERE role = 'user'""",
    "keep_first_row": """
SELECT doc_id, lang, source, md5(text) AS h FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "corpus_split": _split(
        "(SELECT doc_id, toxic = 1 AS prompt_injection FROM documents JOIN labels USING (doc_id))", "doc_id"
    ),
    "corpus_hash_split": f"""
SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'test' ELSE 'val' END AS split
FROM (SELECT doc_id, {_hash_mod("md5('42:' || doc_id)", 10)} AS b FROM documents)""",
    "corpus_shuffle": "SELECT doc_id, lang, md5('42:' || doc_id) AS shuffle_key FROM documents ORDER BY shuffle_key",
    "corpus_build": "WITH RECURSIVE ca AS (" + _CORPUS_ATTACK + """),
cb AS (SELECT -(conv_id * 1000 + turn + 1) AS doc_id, text, false AS prompt_injection FROM conversations WHERE role = 'user'),
c AS (SELECT * FROM ca UNION ALL SELECT * FROM cb), ct AS (SELECT doc_id AS id, text FROM c), """ + _vectors("ct", 16)
    + """, g AS (SELECT c.doc_id AS vec_id, c.prompt_injection, list_transform(range(16),
    lambda i: coalesce(list_extract(v, i + 1), 0.0::DOUBLE)) AS embedding FROM c LEFT JOIN (
    SELECT id, list(coalesce(x, 0.0) ORDER BY b) AS v FROM (SELECT k.id, k.b, e.x FROM (SELECT id, unnest(range(16)) AS b FROM ct) k
      LEFT JOIN e ON e.id = k.id AND e.b = k.b) GROUP BY id) f ON f.id = c.doc_id),
a AS (SELECT * FROM g WHERE prompt_injection), b AS (SELECT * FROM g WHERE NOT prompt_injection), """
    + _farthest("pa", "a", "SELECT min(vec_id) FROM a", 20) + "," + _farthest("pb", "b", "SELECT min(vec_id) FROM b", 21)
    + """, rows_ AS (SELECT p.vec_id AS doc_id, md5(c.text) AS text, c.prompt_injection, md5('42:' || p.vec_id) AS shuffle_key,
  p.pick_order FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) p JOIN c ON c.doc_id = p.vec_id)"""
    + _split("rows_", "doc_id"),
    "systematic_sample": """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
WHERE i % 30 = 0 ORDER BY doc_id LIMIT 1000""",
    "systematic_sample_all": """
SELECT line_id FROM (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS i FROM
  (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS line_id FROM lineitem)) WHERE i % 30 = 0""",
    "ordinal_column": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS my_config FROM documents",
    "diverse_exact": "WITH RECURSIVE " + _farthest("p", "embeddings", "0", 40)
    + " SELECT pick_order, vec_id, round(min_dist, 6) AS min_dist FROM p",
    "diverse_coreset": "WITH RECURSIVE ce AS (SELECT * FROM embeddings WHERE vec_id <> 0), "
    + _farthest("pc", "ce", "SELECT min(vec_id) FROM ce", 80)
    + ", cs AS (SELECT * FROM embeddings WHERE vec_id = 0 OR vec_id IN (SELECT vec_id FROM pc)), " + _farthest("p", "cs", "0", 40)
    + " SELECT pick_order, vec_id, round(min_dist, 6) AS min_dist FROM p",
    "coreset_quality": "WITH RECURSIVE ce AS (SELECT * FROM embeddings WHERE vec_id <> 0), "
    + _farthest("pc", "ce", "SELECT min(vec_id) FROM ce", 80)
    + ", cs AS (SELECT * FROM embeddings WHERE vec_id = 0 OR vec_id IN (SELECT vec_id FROM pc)), " + _farthest("p", "cs", "0", 40) + ", "
    + _farthest("x", "embeddings", "0", 40) + """,
v AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda c: c / sqrt(list_sum(list_transform(e, lambda d: d * d)))) AS e FROM v),
near AS (SELECT a.vec_id, min(1 - list_dot_product(a.e, b.e)) FILTER (b.vec_id IN (SELECT vec_id FROM x)) AS one,
  min(1 - list_dot_product(a.e, b.e)) FILTER (b.vec_id IN (SELECT vec_id FROM p)) AS two
  FROM u a, u b WHERE b.vec_id IN (SELECT vec_id FROM x UNION SELECT vec_id FROM p) GROUP BY a.vec_id)
SELECT (SELECT count(*) FROM x) AS n_picks, round(max(one), 6) AS exact_radius, round(max(two), 6) AS coreset_radius, true AS within_bound FROM near""",
    "text_vectors": "WITH r AS (SELECT doc_id AS id, text FROM documents), " + _vectors("r", 64) + """
SELECT id AS doc_id, b AS i, round(x, 6) AS x FROM e WHERE x <> 0""",
    "confusion": f"""
WITH {_LABELLED} SELECT source, 'insult' AS model, {_counts(INSULT)} FROM l GROUP BY source
UNION ALL SELECT source, 'gate' AS model, {_counts(GATE)} FROM l GROUP BY source""",
    "prf1": f"""
WITH {_LABELLED}, c AS (SELECT 'insult' AS model, {_counts(INSULT)} FROM l UNION ALL SELECT 'gate', {_counts(GATE)} FROM l
  UNION ALL SELECT 'never', {_counts('false')} FROM l UNION ALL SELECT 'always', {_counts('true')} FROM l), {_RATIOS}
SELECT 'labelled' AS dataset, model, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, tp, fp, tn, fn FROM m""",
    "model_detector": f"WITH {_LABELLED} SELECT doc_id, {INSULT} AS python, {INSULT} AS native FROM l",
    "accuracy_prior": f"""
WITH {_LABELLED} SELECT round(avg(({INSULT} = prompt_injection)::INT), 6) AS accuracy,
  round(avg(prompt_injection::INT), 6) AS prior FROM l""",
    "metrics_text": f"""
WITH {_LABELLED}, c AS (SELECT {_counts(INSULT)} FROM l), {_RATIOS}
SELECT 'predictions' AS model, printf('%.2f', p + 1e-9) AS precision, printf('%.2f', q + 1e-9) AS recall,
  printf('%.2f', f + 1e-9) AS f1, tp, fp FROM m""",
    "metrics_append": f"""
WITH {_LABELLED}, c AS (SELECT source AS dataset, 'insult' AS model, {_counts(INSULT)} FROM l GROUP BY source
  UNION ALL SELECT source, 'gate', {_counts(GATE)} FROM l GROUP BY source), {_RATIOS}
SELECT dataset, model, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, tp, fp, tn, fn FROM m""",
    "policy_hits": """
WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)
SELECT kind, id, 'insult' AS rule_id, 'Rule 1: Do not insult' AS rule_text FROM t WHERE contains(text, 'trash')
UNION ALL SELECT kind, id, 'licence', 'Rule 2: Do not quote licences' FROM t WHERE contains(text, 'License')
UNION ALL SELECT kind, id, 'phone', 'Rule 3: Do not share phone numbers' FROM t
  WHERE regexp_matches(text, '\\([0-9]{3}\\) ')""",
    "exemplar_similarity": _nearest("(SELECT item_id AS id, text FROM benchmark)", "item_id", 0.8),
    "utterance_similarity": _nearest(f"(SELECT * FROM (VALUES {_UTTERANCES}) x(id, text))", "ex_id", 0.15).replace(
        "SELECT id AS ex_id", "SELECT id::BIGINT AS ex_id"
    ),
    "vector_similarity": """
WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
a AS (SELECT label::BIGINT AS centre, i, avg(x) AS x FROM x GROUP BY label, i),
na AS (SELECT centre, sqrt(sum(x * x)) AS n FROM a GROUP BY centre),
nx AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY vec_id),
d AS (SELECT x.vec_id, a.centre, sum(x.x * a.x) AS dot FROM x JOIN a USING (i) GROUP BY x.vec_id, a.centre),
s AS (SELECT vec_id, centre, round(dot / (nx.n * na.n), 12) AS score FROM d JOIN nx USING (vec_id) JOIN na USING (centre))
SELECT vec_id, centre, round(score, 6) AS score FROM
  (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s.score DESC, centre) = 1) b WHERE b.score >= 0.2""",
    "score_argmax": """
WITH s AS (SELECT vec_id, embedding AS v FROM embeddings),
l AS (SELECT vec_id, 'LABEL_' || (list_position(v, list_max(v)) - 1) AS label FROM s)
SELECT vec_id, label, label = 'LABEL_1' AS predictions FROM l""",
    "softmax": """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 8) AS v FROM embeddings),
e AS (SELECT vec_id, list_position(v, list_max(v)) - 1 AS class,
  1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS confidence FROM s)
SELECT vec_id, round(confidence, 6) AS confidence, class::BIGINT AS class, class > 0.7 AS compat,
  class = 1 AND confidence >= 0.7 AS confident FROM e""",
    "verdict_json": """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS answer,
  CASE WHEN event_id % 10 <> 0 THEN json_extract(props, '$.k')::BIGINT % 2 = 0 END AS credential,
  CASE WHEN event_id % 10 <> 0 THEN props END AS reasoning, event_id % 10 = 0 AS corrupt FROM events""",
    "ml_classifier": f"""
SELECT split, count(*) AS n_rows, count(*) FILTER (quality = 1) AS n_good, true AS separates FROM (
  SELECT quality, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'test' ELSE 'val' END AS split FROM (
    SELECT quality, {_hash_mod("md5('42:' || doc_id)", 10)} AS b FROM documents JOIN labels USING (doc_id))) GROUP BY split""",
    "null_check": """
SELECT count(*) AS n_rows, count(*) - count(toxic) AS n_null FROM documents LEFT JOIN labels USING (doc_id)""",
    "role_check": "SELECT conv_id, turn, upper(role) AS role FROM conversations WHERE turn = 3",
    "turn_guard": _TURN_GUARD,
    "guard_status": _TURNS + """,
g AS (SELECT level, 'prompt_protection' AS guard, prompt_protection_status AS status FROM s
  UNION ALL SELECT level, 'output_rail', output_rail_status FROM s
  UNION ALL SELECT level, 'tool_rail', tool_rail_status FROM s)
SELECT guard, level, status, count(*) AS n_turns FROM g WHERE status IS NOT NULL GROUP BY ROLLUP (guard, level, status)""",
    "history_last10": """
WITH h AS (SELECT conv_id, turn, list(role || ':' || text) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM conversations)
SELECT conv_id, turn, len(m) AS n, md5(array_to_string(m, '|')) AS h FROM h""",
    "progression": """
WITH e AS (SELECT event_id, user_id, event_type = 'purchase' AS hit,
    coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
s AS (SELECT *, least(before_, 5)::BIGINT AS level_before, hit AND before_ < 5 AS correct FROM e),
a AS (SELECT *, (level_before + correct::INT)::BIGINT AS level_after, coalesce(max(CASE WHEN correct THEN rn END) OVER (
    PARTITION BY user_id ORDER BY event_id), 0) AS last_ FROM s)
SELECT event_id, user_id, level_before, correct, level_after,
  CASE WHEN level_after = 5 THEN 0 ELSE rn - last_ END AS wrong_after, level_after = 5 AS finished FROM a""",
    "progression_levels": _LEVEL_GAME + """
SELECT event_id, user_id, level_before::BIGINT AS level_before, correct, level_after::BIGINT AS level_after,
  wrong_after::BIGINT AS wrong_after, level_after = 5 AND NOT restart AS finished FROM s WHERE rn > 0""",
    "sql_guarded": """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n_orders FROM orders
  WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey)
SELECT c_custkey, n_name, round(total, 2) AS total, n_orders
FROM spend JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
ORDER BY spend.total DESC, c_custkey LIMIT 100""",
    "stored_profile": """
WITH v AS (
  SELECT 'event_id' AS "column", event_id AS i, event_id::DOUBLE AS x FROM events
  UNION ALL SELECT 'user_id', user_id, user_id::DOUBLE FROM events
  UNION ALL SELECT 'value', NULL, value FROM events)
SELECT "column", count(*) AS n_rows, count(*) FILTER (x IS NULL) AS n_null, min(i) AS min_int, max(i) AS max_int, min(x) AS min, max(x) AS max,
  round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS stddev, true AS distinct_near, true AS median_near, true AS p90_near
FROM v GROUP BY ALL""",
    "log_messages": """
WITH m AS (SELECT date_trunc('second', ts)::TIMESTAMP AS ts, CASE event_type WHEN 'view' THEN 'Chatbot' ELSE 'User' END AS speaker,
  CASE event_type WHEN 'view' THEN props ELSE event_id::VARCHAR END ||
  CASE event_id % 3 WHEN 0 THEN chr(10) || props || chr(10) || '  and more' WHEN 1 THEN chr(10) ELSE '' END AS text FROM events)
SELECT ts, 'INFO' AS level, speaker, md5(text) AS h, count(*) AS n FROM m GROUP BY ALL""",
    "extract_full_names": _FULL_NAMES,
    "resolved_spans": _SPANS + """
SELECT doc_id, s.start::BIGINT AS start, s.stop::BIGINT AS "end", s.entity AS entity, s.value AS value FROM kept""",
    "redacted_spans": _SPANS + """,
listed AS (SELECT doc_id, list(s ORDER BY s.start) AS l FROM kept GROUP BY doc_id),
cut AS (SELECT doc_id, text, list_concat([0], list_transform(l, lambda s: s.stop)) AS a,
  list_concat(list_transform(l, lambda s: s.start), [length(text)]) AS b, list_concat(list_transform(l, lambda s: '<' || s.entity || '>'), ['']) AS m
  FROM documents JOIN listed USING (doc_id)),
made AS (SELECT doc_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: substr(text, CAST(a[i] + 1 AS BIGINT), CAST(b[i] - a[i] AS BIGINT)) || m[i]), '') AS text FROM cut)
SELECT d.doc_id, md5(coalesce(made.text, d.text)) AS h FROM documents d LEFT JOIN made USING (doc_id)""",
    "sql_redacted": f"""
SELECT doc_id, lang, {_redact('text')} AS text FROM documents WHERE contains(text, '@') ORDER BY doc_id""",
    "sql_redacted_nested": f"""
WITH v AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS vs, length(text)::INT AS n FROM documents)
SELECT doc_id, array_to_string(list_transform(vs, lambda x: '<EMAIL_ADDRESS>'), ',') AS emails, '<EMAIL_ADDRESS>' AS first, n,
  'to <EMAIL_ADDRESS>' AS k FROM v WHERE len(vs) > 0""",
    "inventory_nested": f"""
SELECT unnest([0, 1, 2]::BIGINT[]) AS cid, unnest(['doc_id', 'emails', 'n']) AS name, 0::BIGINT AS n_null,
  unnest([0, count(*) FILTER (regexp_matches(text, '{EMAIL}')), 0]::BIGINT[]) AS n_entity FROM documents""",
    "sql_audit": f"""
WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'SELECT ' || text WHEN 1 THEN ' with x as (''' || text || '; limit'') select 1 ; '
    WHEN 2 THEN 'Select "a;b" from ' || text || '; drop table t'
    WHEN 3 THEN 'select ''it''''s; LIMIT'' || ' || text || ' || ''open;' ELSE text END AS query FROM documents),
s AS (SELECT doc_id, regexp_replace(query, '^{SPACE}|{SPACE}\\z', '', 'g') AS query FROM q),
b AS (SELECT doc_id, CASE WHEN ends_with(query, ';') THEN regexp_replace(query, '[ \\t\\n\\r\\f]*;\\z', '') ELSE query END AS body FROM s)
SELECT doc_id, CASE WHEN contains(regexp_replace(body, '{QUOTED}', '', 'g'), ';') THEN 'multi'
    WHEN NOT (lower(body) LIKE 'select%' OR lower(body) LIKE 'with%') THEN 'not_select' ELSE 'ok' END AS verdict,
  contains(lower(body), 'limit') AS has_limit FROM b""",
    "inventory_tables": " UNION ALL ".join(
        [
            _inventory("documents", ["text", "lang", "source"]), _inventory("conversations", ["role", "text"]),
            _inventory("customer", ["c_name", "c_mktsegment"]), _inventory("orders", ["o_orderstatus", "o_orderpriority"]),
        ]
    ) + " ORDER BY name",
    "inventory_columns": " UNION ALL ".join(
        [
            _columns("documents", {"doc_id": False, "text": True, "lang": True, "source": True, "n_chars": False}),
            _columns("conversations", {"conv_id": False, "turn": False, "role": True, "text": True}),
            _columns("labels", {"doc_id": False, "quality": False, "toxic": False}),
        ]
    ),
    "first_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000",
    "text_metrics": f"""
WITH p AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT *, list_distinct({_tokens('prompt')}) AS pw, {_tokens('response')} AS rw FROM p)
SELECT conv_id, turn, {_text_metrics('prompt')}, {_text_metrics('response')},
  round(CASE WHEN len(pw) > 0 THEN len(list_intersect(pw, rw)) / len(pw) ELSE 0.0 END, 6) AS overlap FROM t""",
    "text_profile": """
SELECT lang, count(*) AS n_rows, count(*) - count(text) AS n_null, min(length(text)) AS min_len, max(length(text)) AS max_len,
  round(avg(length(text)), 4) AS mean_len, round(stddev_samp(length(text)), 4) AS stddev_len,
  round(quantile_cont(length(text), 0.5), 4) AS median_len, round(quantile_cont(length(text), 0.9), 4) AS p90_len,
  count(DISTINCT text) AS n_distinct FROM documents GROUP BY lang""",
    "numeric_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS middle, true AS distinct_near, true AS median_near FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")
    ),
    "numeric_profile_exact": " UNION ALL ".join(
        _measures(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")
    ),
    "log_parse": _LOG + "SELECT event_id, ts, level, message, speaker, text, parsed FROM p",
    "log_counts": _LOG + """
SELECT speaker, level, count(*) AS n_lines FROM p WHERE parsed GROUP BY speaker, level
UNION ALL SELECT 'unparsed', NULL, count(*) FROM p WHERE NOT parsed""",
    "log_filter": _LOG + """
SELECT value, count(*) AS n_lines FROM lines WHERE contains(value, 'user') OR contains(value, 'User') GROUP BY value""",
    "csv_roundtrip": """
SELECT md5(text) AS h, toxic AS "Label", count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
    "prompt_table": "SELECT doc_id AS id, md5(text) AS h FROM documents",
    "corpus_cached": "SELECT doc_id, lang, md5(text) AS h FROM documents",
    "seed_users": f"""
WITH v AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS vs FROM documents),
l AS (SELECT doc_id, unnest(range(len(vs))) AS nth, unnest(vs) AS email FROM v),
n AS (SELECT row_number() OVER (ORDER BY doc_id, nth) - 1 AS user_id, email FROM l)
SELECT user_id, email, {_hash_mod("md5('42:' || user_id || ':' || email)", 201)} AS order_quantity FROM n""",
    "stream_hits": """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end,
  event_type, count(*) AS n_hits FROM events GROUP BY ALL""",
    "stream_late": """
WITH m AS (SELECT event_id % 4 AS b, max(ts) AS newest FROM events GROUP BY ALL),
k AS (SELECT b, max(newest) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM m)
SELECT event_type, count(*) FILTER (NOT coalesce(ts < mark - INTERVAL 7 DAY, false)) AS n_counted,
  count(*) FILTER (coalesce(ts < mark - INTERVAL 7 DAY, false)) AS n_late
FROM events JOIN k ON k.b = event_id % 4 GROUP BY event_type""",
    "stream_late_rows": """
WITH m AS (SELECT max(event_id) + 1 AS c FROM events),
p AS (SELECT event_id, event_type, ts, 3 - (event_id * 4 // c) AS b FROM events, m),
n AS (SELECT b, max(ts) AS newest FROM p GROUP BY b),
k AS (SELECT b, max(newest) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 7 DAY AS mark FROM n),
l AS (SELECT event_type, event_id, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= date_trunc('millisecond', mark), false) AS late FROM p JOIN k USING (b))
SELECT event_type, (count(*) FILTER (NOT late))::BIGINT AS n_counted, nullif(count(*) FILTER (late), 0)::BIGINT AS n_late,
  (sum(event_id) FILTER (late))::BIGINT AS late_ids FROM l GROUP BY event_type""",
    "stream_windows": """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, event_type,
  count(*) AS n_hits FROM events GROUP BY ALL""",
    "stream_guard": _TURN_GUARD,
    "stream_progress": _LEVEL_GAME + """
SELECT user_id, level_after::BIGINT AS level, wrong_after::BIGINT AS wrong, rn::BIGINT AS n_turns, 0::BIGINT AS n_late,
  level_after = 5 AS finished FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""",
    "stream_progress_ordered": _LEVEL_GAME + """
SELECT user_id, level_after::BIGINT AS level, wrong_after::BIGINT AS wrong, rn::BIGINT AS n_turns, 0::BIGINT AS n_late,
  level_after = 5 AS finished FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""",
    "stream_log": _LOG + "SELECT speaker, level, count(*) AS n_lines FROM p WHERE parsed GROUP BY speaker, level",
}
