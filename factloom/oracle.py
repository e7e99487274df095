"""SQL in the dialect of DuckDB, for the queries of the same names. Written apart from the Spark code."""

from __future__ import annotations

from factloom.plans.questions import QUESTIONS

_WS = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
_NWS = r"[^\t\n\x0b\f\r \x{85}\p{Z}]"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{_NWS}+'))"


def tokens(x: str, stop: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({stop}))"


_INDEX_STOP = "'the','and','for','with','this','that'"
_QUERY_STOP = "'what','which','show','give','about','from','with','this','that','the','and','for','how','much'"
_NULLS = "'','none','null','n/a','na','unknown','-','--'"


def clean(x: str) -> str:
    return f"CASE WHEN lower({ws(x)}) IN ({_NULLS}) THEN '' ELSE trim({ws(x)}, ' ,;:') END"


def key(x: str) -> str:
    return ws(f"regexp_replace(lower({x}), '[^a-z0-9%$€£\\-\\.\\s]', '', 'g')")


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def cites(x: str) -> str:
    raw = f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '(?i)\\[\\s*chunk\\s*([^\\]]+?)\\s*\\]', 1), lambda c: {ws('c')}), lambda c: c <> '')"
    return f"list_filter({raw}, lambda c, i: list_position(list_transform({raw}, lambda z: lower(z)), lower(c)) = i)"


def number(x: str) -> str:
    return f"try_cast(nullif(regexp_extract(replace(coalesce({x}, ''), ',', ''), '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)"


def temporal(x: str) -> str:
    rx = (r"\b\d+\s+years?\s+(?:before|after)\b", r"\btakes place\b.{0,80}\b\d+\s+years?\b", r"\bset\b.{0,80}\b\d+\s+years?\b")
    return "least(1.0, 0.34 * (" + " + ".join(f"regexp_matches(coalesce({x}, ''), '(?i){r}')::INT" for r in rx) + "))"


def heading(x: str) -> str:
    r, n = strip(x), words(x)
    return rf"""({r} <> '' AND length({r}) <= 110 AND (regexp_matches({r}, '(?i)^(\d+(?:\.\d+)*|Q[1-4]|FY\d{{2}})\b') OR ({r} LIKE '%:' AND {n} <= 12)
        OR (upper({r}) = {r} AND lower({r}) <> {r} AND {n} BETWEEN 2 AND 12) OR (regexp_matches({r}, '^[A-Z][A-Za-z0-9 &/\-]{{2,60}}$') AND {n} <= 10)))"""


_CHUNKS = "(SELECT chunk_id, min(track) AS track, min(source_id) AS source_id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id)"
_RETRIEVAL = f"(SELECT v.pos, c.chunk_id, c.source_id, c.text FROM {_CHUNKS} c JOIN index_vectors v USING (chunk_id))"
_EXTRACTION = f"(SELECT * FROM {_CHUNKS} WHERE track = 'extraction')"
_EDGES = f"(SELECT * FROM (SELECT seq, {clean('subject')} AS src, {clean('object')} AS dst, {ws('predicate')} AS label, source_ref FROM facts) WHERE src <> '' AND dst <> '' AND label <> '')"
_SAMPLE = ", ".join(f"({i + 1}, '{q}')" for i, q in enumerate(QUESTIONS))
_ASKABLE = "source_id IS NOT NULL AND trim(coalesce(subject, ''), ' ') <> '' AND trim(coalesce(object, ''), ' ') <> ''"
_Q = rf"""(SELECT * FROM (VALUES {_SAMPLE}) v(qid, question) UNION ALL SELECT {len(QUESTIONS)} + 2 * n - k, CASE WHEN k = 1 THEN 'What was the ' || replace(regexp_replace(mp, '^reported_', ''), '_', ' ') || ' of ' || ms || ' in ' || mt || '?' ELSE 'How many years are between ' || ys || ' and ' || yo || '?' END
  FROM (SELECT *, row_number() OVER (ORDER BY source_id) AS n FROM (SELECT source_id,
     arg_min(subject, seq) FILTER (m) AS ms, arg_min(predicate, seq) FILTER (m) AS mp, arg_min(timeframe, seq) FILTER (m) AS mt, arg_min(subject, seq) FILTER (y) AS ys, arg_min(object, seq) FILTER (y) AS yo
     FROM (SELECT *, coalesce(regexp_matches(predicate, '^(?:reported_|annual_|energy_|route_|tank_|cargo_|contract_)[a-z_]+$') AND regexp_matches(coalesce(timeframe, ''), '\d'), false) AS m, coalesce(predicate IN ('occurs_years_before', 'occurs_years_after'), false) AS y FROM facts WHERE {_ASKABLE}) GROUP BY source_id)), (VALUES (0), (1)) k(k)
  WHERE CASE WHEN k = 1 THEN ms ELSE ys END IS NOT NULL) q"""
_QTOKS = tokens("question", _QUERY_STOP)
_TOKS = f"list_distinct({tokens('question', _QUERY_STOP)})"
_DEGREES = f"(SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) GROUP BY id)"
_SEEDS = f"""(SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT qid, id, len(list_filter(toks, lambda t: contains(lower(id), t))) + CASE WHEN contains(ql, lower(id)) OR contains(lower(id), ql) THEN 5 ELSE 0 END AS score
    FROM (SELECT qid, lower({ws('question')}) AS ql, {_QTOKS} AS toks FROM {_Q}) q, (SELECT id FROM {_DEGREES}) n) WHERE score > 1) WHERE rank <= 8)"""
_BM25 = f"""WITH c AS (SELECT pos, {tokens('text', _INDEX_STOP)} AS toks FROM {_RETRIEVAL}),
 post AS (SELECT term, pos, count(*) AS tf, any_value(dl) AS dl FROM (SELECT pos, len(toks) AS dl, unnest(toks) AS term FROM c) GROUP BY term, pos),
 size AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM c),
 raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, size GROUP BY term),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
 qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({tokens('question', _INDEX_STOP)}) AS term FROM {_Q}) GROUP BY qid, term),
 bm AS (SELECT qid, pos, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN qt USING (term) JOIN idf USING (term), size GROUP BY qid, pos)"""
_LEX_STOP = "'what','which','show','give','about','from','with','this','that','the','and'"
_LEX = rf"""lex AS (SELECT * FROM (SELECT qid, pos, round((len(list_intersect(ct, qt)) + CASE WHEN length(ql) > 10 AND contains(t, ql) THEN 2.0 ELSE 0 END
   + CASE WHEN len(list_filter(regexp_extract_all(ql, '(?:19|20)\d{{2}}'), lambda y: contains(t, y))) > 0 THEN 1.0 ELSE 0 END
   + CASE WHEN len(list_filter(regexp_extract_all(ql, 'q[1-4]'), lambda y: contains(t, y))) > 0 THEN 0.7 ELSE 0 END)::DOUBLE, 6) AS score
   FROM (SELECT qid, lower({ws('question')}) AS ql, list_distinct({tokens('question', _LEX_STOP)}) AS qt FROM {_Q}) a, (SELECT pos, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS ct FROM {_RETRIEVAL}) b) WHERE score > 0)"""


def top(rel: str, n: int, cols: str = "qid, pos, score, rank") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM {rel}) WHERE rank <= {n}"


def anchor(n: int) -> str:
    raw = rf"regexp_extract(nq, '(?i)\bbetween\s+(.+?)\s*,?\s+and\s+(.+?)(?:\?|$)', {n})"
    a = rf"regexp_replace(trim({raw}, ' ,.;:'), '(?i)^(?:the\s+)?(?:adventures?\s+of\s+|timeline\s+of\s+|events?\s+of\s+|story\s+of\s+)', '')"
    return f"trim({ws(f'''regexp_replace({a}, '(?i)^(?:the|a){chr(92)}s+', '')''')}, ' ,.;:')"


_NQ = f"(SELECT qid, {ws('question')} AS nq, lower({ws('question')}) AS ql FROM {_Q})"
_YEARS = r"list_sort(list_distinct(regexp_extract_all(nq, '\b(?:19|20)\d{2}\b')))"
_QUARTERS = r"regexp_extract_all(upper(nq), '\bQ[1-4]\b')"
_INTENT_TIME = f"CASE WHEN len({_YEARS}) > 1 THEN {_YEARS}[1] || '-' || {_YEARS}[-1] WHEN len({_YEARS}) = 1 THEN {_YEARS}[1] WHEN len({_QUARTERS}) > 0 THEN {_QUARTERS}[1] ELSE 'unspecified' END"
_HALVES = r"regexp_extract_all(upper(nq), '\bH[12]\b')"
_ENRICH_TIME = f"CASE WHEN len({_YEARS}) > 1 THEN {_YEARS}[1] || '-' || {_YEARS}[-1] WHEN len({_YEARS}) = 1 AND len({_QUARTERS}) > 0 THEN {_QUARTERS}[1] || ' ' || {_YEARS}[1] WHEN len({_YEARS}) = 1 THEN {_YEARS}[1] WHEN len({_QUARTERS}) > 0 THEN {_QUARTERS}[1] WHEN len({_HALVES}) > 0 THEN {_HALVES}[1] ELSE 'unspecified' END"
_ANCHOR2 = f"[{anchor(1)}, {anchor(2)}]"
_ANCHORS = f"list_filter({_ANCHOR2}, lambda a, i: a <> '' AND list_position(list_transform({_ANCHOR2}, lambda z: lower(z)), lower(a)) = i)"


def has(ws_: str) -> str:
    return "(" + " OR ".join(f"contains(ql, '{w}')" for w in ws_.split("|")) + ")"


_TEMPORAL_Q = r"(regexp_matches(ql, '\b(?:time\s+difference|difference|timeline|years?\s+apart|far\s+apart|before|after|apart)\b') OR contains(ql, 'year'))"
_INTENTS = f"""(SELECT *, CASE WHEN len(ls) > 0 THEN ls[1:3] ELSE ['direct_lookup'] END AS labels FROM (SELECT *, list_filter([
    CASE WHEN {has('summary|summarize|overview|about this|high level')} THEN 'summarize_document' END,
    CASE WHEN {has('ebit|ebitda|revenue|profit|margin|volume|container|how much')} THEN 'extract_key_metrics' END,
    CASE WHEN derive OR {has('compare|vs|versus|difference|higher|lower|increase|decrease')} THEN 'compare_values' END,
    CASE WHEN {_TEMPORAL_Q} OR {has('trend|over time|from|to|quarter|q1|q2|q3|q4')} THEN 'trend_check' END,
    CASE WHEN {has('why|driver|reason|cause')} THEN 'driver_analysis' END], lambda x: x IS NOT NULL) AS ls
  FROM (SELECT *, {_TEMPORAL_Q} AND contains(ql, 'between') AND contains(ql, ' and ') AND len(anchors) >= 2 AS derive FROM (SELECT *, {_ANCHORS} AS anchors FROM {_NQ}))))"""

_LINES = "(SELECT doc_id, n - 1 AS n, line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(ls) WITH ORDINALITY AS u(line, n))"
_SECTIONS = f"""(WITH l AS (SELECT doc_id, n, line, {heading('line')} AS head, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM {_LINES}),
  g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS g, sum(length(line) + 1) OVER (PARTITION BY doc_id)::BIGINT - 1 AS size FROM l),
  s0 AS (SELECT doc_id, g, any_value(size) AS size, coalesce(max(CASE WHEN head THEN {ws('line')} END), 'Section') AS title, min(off) AS start, {strip("coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY n), '')")} AS body FROM g GROUP BY doc_id, g),
  s AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY g), size) AS fin FROM s0),
  f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS section, title, body, start, fin FROM s WHERE body <> '')
  SELECT doc_id, section, title, body, start, fin FROM f UNION ALL SELECT doc_id, 0, 'Section', text, 0, length(text) FROM documents WHERE {strip('text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM f))"""


def windows(rel: str, keys: str, text: str, target: int, overlap: int) -> str:
    s = target - overlap
    return f"""(SELECT {keys}, idx, {strip(f"array_to_string(w[idx * {s} + 1 : idx * {s} + {target}], '')")} AS part, length(array_to_string(w[1 : idx * {s}], '')) + length(w[idx * {s} + 1]) - length(regexp_replace(w[idx * {s} + 1], '^{_WS}+', '')) AS a, length(array_to_string(w[1 : idx * {s} + {target}], '')) AS b
        FROM (SELECT {keys}, w, unnest(range(0, greatest(0, ceil((len(w) - {target}) / {s}.0))::BIGINT + 1)) AS idx
        FROM (SELECT {keys}, regexp_extract_all({text}, '{_WS}*{_NWS}+') AS w FROM {rel}) WHERE len(w) > 0))"""


_PAGES = f"(SELECT * FROM (SELECT doc_id, coalesce(source, '') AS source_id, {strip('text')} AS text FROM documents) WHERE length(text) >= 40)"


def built(track: str, target: int, overlap: int) -> str:
    rel = _SECTIONS.replace("FROM documents", "FROM pgs")
    w = windows(rel, "doc_id, section, title, start", "body", target, overlap)
    return f"""SELECT '{track}' AS track, source_id, page, concat_ws('-', '{track}', page + 1, n + 1, left(md5(concat_ws('|', source_id, n, page, '{track}', left(part, 140))), 10)) AS chunk_id, title AS section_title, start + a AS char_start, start + b AS char_end, false AS is_vision, '2024-01-01T00:00:00+00:00' AS created_at, n AS idx, part AS text
      FROM (SELECT source_id, doc_id AS page, title, part, start, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY section, idx) - 1 AS n FROM {w} JOIN (SELECT doc_id, source_id FROM pgs) USING (doc_id))"""


_SENT = r"[^.!?\n]{0,240}\d[^.!?\n]{0,240}"
_METRIC = r"(?i)(revenue|ebitda|ebit|margin|cash flow|fcf|capex|volume|cost|profit|guidance|growth)"
_VALUE = r"(?i)(-?\d[\d,]*(?:\.\d+)?)\s*(%|percent|bn|billion|million|m|k|usd|eur|dkk|gbp|teu|tons?)?"
_PERIOD = r"(?i)\b((?:19|20)\d{2}|Q[1-4]|FY\s?\d{2})\b"
_REL = r"(?i)(?:(?:takes place|set)\s+(?:about|around|approximately|nearly)?\s*)?(\d{1,4})\s+years?\s+(before|after)\s+([A-Z][^.;:\n]{2,120})"


def numeric(rel: str) -> str:
    return f"""(SELECT chunk_id, source_id, n, predicate, CASE WHEN unit = '' THEN value ELSE value || ' ' || unit END AS object, value, unit, timeframe FROM (
      SELECT chunk_id, source_id, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS n, 'reported_' || replace(lower(regexp_extract(s, '{_METRIC}', 1)), ' ', '_') AS predicate, regexp_extract(s, '{_VALUE}', 1) AS value,
        regexp_extract(s, '{_VALUE}', 2) AS unit, regexp_extract(s, '{_PERIOD}', 1) AS timeframe
      FROM (SELECT chunk_id, source_id, i, {ws('s')} AS s FROM (SELECT chunk_id, source_id, regexp_extract_all(text, '{_SENT}') AS ss FROM {rel} WHERE length(text) >= 40), unnest(ss) WITH ORDINALITY AS u(s, i))
      WHERE length(s) >= 16 AND regexp_matches(s, '{_METRIC}')) WHERE n <= 6)"""


def timeline(rel: str) -> str:
    obj = rf"trim(string_split_regex({ws(f'''regexp_extract(s, '{_REL}', 3)''')}, '(?i)\s+(?:in|from|for|where|which)\s+')[1], ' ,.;:')"
    return f"""(SELECT * FROM (SELECT chunk_id, source_id, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS n, 'occurs_years_' || lower(regexp_extract(s, '{_REL}', 2)) AS predicate, object, regexp_extract(s, '{_REL}', 1) AS value
      FROM (SELECT *, {obj} AS object FROM (SELECT chunk_id, source_id, regexp_extract_all(text, '{_REL}') AS ss FROM {rel} WHERE length(text) >= 20), unnest(ss) WITH ORDINALITY AS u(s, i)) WHERE object <> '') WHERE n <= 8)"""


_SIX = ("subject", "predicate", "object", "value", "unit", "timeframe")
_CONF = "CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END"
_NAMED = f"(SELECT {clean('subject')} AS name, seq, 0 AS place FROM facts UNION ALL SELECT {clean('object')}, seq, 1 FROM facts)"
_ALIAS = f"(SELECT {key('name')} AS key, arg_min(name, seq * 2 + place) AS rep FROM {_NAMED} WHERE {key('name')} <> '' GROUP BY 1)"
_CANON = f"""WITH f AS (SELECT seq, {clean('subject')} AS s0, {ws('predicate')} AS predicate, {clean('object')} AS o0, {ws('value')} AS value, {ws('unit')} AS unit, {ws('timeframe')} AS timeframe, {ws('source_ref')} AS source_ref, {_CONF} AS confidence FROM facts),
 g AS (SELECT f.*, coalesce(a.rep, s0) AS subject, coalesce(b.rep, o0) AS object FROM f LEFT JOIN {_ALIAS} a ON {key('s0')} = a.key LEFT JOIN {_ALIAS} b ON {key('o0')} = b.key WHERE s0 <> '' AND predicate <> '' AND o0 <> '' AND lower(s0) NOT IN ({_NULLS}) AND lower(o0) NOT IN ({_NULLS})),
 k AS (SELECT * REPLACE (trim(predicate, ' ,;:') AS predicate), trim(lower(predicate), ' ,;:') AS kp, {key('subject')} AS ks, {key('object')} AS ko, lower(timeframe) AS kt, lower(value) AS kv, lower(unit) AS ku, lower(source_ref) AS r FROM g),
 refs AS (SELECT ks, kp, ko, kt, kv, ku, string_agg(ref, ', ' ORDER BY nth) AS source_ref FROM (SELECT *, row_number() OVER (PARTITION BY ks, kp, ko, kt, kv, ku ORDER BY seq) AS nth FROM (SELECT ks, kp, ko, kt, kv, ku, r, min(seq) AS seq, arg_min(source_ref, seq) AS ref FROM k WHERE r <> '' GROUP BY ALL)) WHERE nth <= 8 GROUP BY ALL)
 SELECT m.seq, m.subject, m.predicate, m.object, m.value, m.unit, m.timeframe, coalesce(refs.source_ref, '') AS source_ref, round(m.confidence, 6) AS confidence FROM (
  SELECT ks, kp, ko, kt, kv, ku, min(seq) AS seq, {', '.join(f'arg_min({c}, seq) AS {c}' for c in _SIX)}, avg(confidence) AS confidence FROM k GROUP BY ks, kp, ko, kt, kv, ku) m LEFT JOIN refs USING (ks, kp, ko, kt, kv, ku)"""

_ANSWERS = """(SELECT seq, coalesce(object, '') || ' ' || CASE WHEN seq % 7 = 0 THEN '[Chunk zz-1]' WHEN seq % 11 = 0 THEN '' WHEN seq % 13 = 0 THEN '[Graph]' ELSE coalesce(source_ref, '') END AS answer, chunk_id FROM facts)"""
_CITED = f"list_transform({cites('answer')}, lambda c: lower(c))"
_INVALID = f"list_distinct(list_filter({_CITED}, lambda c: c IS DISTINCT FROM lower(chunk_id)))"
_ORDERS = """(SELECT o_orderkey::VARCHAR AS chunk_id, 'orders' AS source_id, 'Order revenue was ' || floor(o_totalprice)::BIGINT || ' USD in ' || year(o_orderdate) || '. It is set ' || (o_orderkey % 90 + 1) || ' years before Customer ' || o_custkey || ' in the plan.' AS text FROM orders)"""
_HTML = "(SELECT doc_id::VARCHAR AS url, '<html><head><title>' || coalesce(title, '') || '</title><style>p {margin: 0}</style></head><body><nav>menu</nav><h1>' || coalesce(title, '') || '</h1><p>' || replace(replace(coalesce(text, ''), '<', ' '), chr(10), '</p><p>') || '</p><img src=''/chart.png'' alt=''chart'' width=''640'' height=''480''><img src=''logo.svg''></body></html>' AS html FROM documents)"
_URL = "CASE WHEN kind = 'web' THEN 'https://www.' ELSE 'https://' END || kind || '.example.com/' || replace(lower(coalesce(title, '')), ' ', '-')"
_ARRAY = "CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v, '$.facts') = 'ARRAY' THEN json_extract(v, '$.facts[*]') ELSE [v] END"


def _image(src: str, alt: str, w: str) -> str:
    """The height is 200 in the query."""
    t = f"lower({src} || ' ' || coalesce({alt}, ''))"
    return f"""(CASE WHEN regexp_matches({t}, 'chart|graph|table|figure|trend|ebit|ebitda|revenue|profit|margin|volume|financial') THEN 4.0 ELSE 0 END - CASE WHEN regexp_matches({t}, 'logo|icon|avatar|sprite|favicon|social|emoji') THEN 5.0 ELSE 0 END
      + CASE WHEN {w} >= 380 THEN 1.4 ELSE 0 END - CASE WHEN {src} LIKE '%.svg' THEN 1.5 ELSE 0 END)::DOUBLE"""


_STRIP_V = strip("coalesce(value, '')")
_LAST = strip(r"regexp_extract(t, '([^\n]*)$', 1)")
_MAIN = strip(rf"string_split_regex({_STRIP_V}, '(?i)\n\s*(?:key insights?|insights?)\s*:\s*')[1]")
_BULLET_LINES = f"list_filter(list_transform(string_split(coalesce(value, ''), chr(10)), lambda s: {strip('s')}), lambda s: starts_with(s, '- ') OR starts_with(s, '* ') OR starts_with(s, '•'))[1:8]"
_BULLETS = f"list_transform({_BULLET_LINES}, lambda s: " + strip("ltrim(s, '-*• ')") + ")"
_JUDGED = """CASE entry_id % 8 WHEN 0 THEN '{"verdict": "retry", "issues": "no source"}' WHEN 1 THEN 'verdict not_found here' WHEN 2 THEN 'So: {"verdict": "Maybe"} indeed' WHEN 3 THEN 'It was not found.' WHEN 4 THEN '[ERROR] timeout' WHEN 5 THEN 'I would retry' WHEN 6 THEN 'all fine' ELSE replace(coalesce(value, ''), '{', '(') END"""
_SPOKEN = rf"(SELECT *, regexp_extract_all(text, '\b[A-Z][a-z]{{3,}}\b') AS ws FROM {_EXTRACTION} WHERE trim(text, ' ') <> '')"
_SEEDED = f"(SELECT * REPLACE (CASE WHEN len(ws) >= 2 THEN ws[1] ELSE 'source:' || source_id END AS source_id) FROM {_SPOKEN})"


def dedup(x: str) -> str:
    return f"list_filter({x}, lambda v, i: {ws('v')} <> '' AND list_position(list_transform({x}, lambda z: lower({ws('z')})), lower({ws('v')})) = i)"


def _enriched(hint: bool) -> str:
    inferred = f"""list_filter([CASE WHEN {has('summary|summarize|overview|about this|high level')} THEN 'summarize_document' END, CASE WHEN {has('ebit|ebitda|revenue|profit|margin|volume|carry|container|number|how much')} THEN 'extract_key_metrics' END,
        CASE WHEN {has('compare|vs|versus|difference|higher|lower|increase|decrease')} THEN 'compare_values' END, CASE WHEN {has('trend|over time|from|to|year|quarter|q1|q2|q3|q4')} THEN 'trend_check' END, CASE WHEN {has('why|driver|reason|cause')} THEN 'driver_analysis' END], lambda x: x IS NOT NULL)"""
    base = f"(SELECT i.qid, i.nq, lower(q.question) AS ql, q.question AS raw, i.labels AS hl, i.anchors, coalesce(h.hits, []) AS hits FROM {_INTENTS} i JOIN (SELECT * FROM {_Q}) q USING (qid) LEFT JOIN (SELECT qid, list(id ORDER BY rank) AS hits FROM {_SEEDS} GROUP BY qid) h USING (qid))"
    labels = "hl" if hint else f"CASE WHEN len({inferred}) > 0 THEN ({inferred})[1:3] ELSE ['direct_lookup'] END"
    caps = r"list_filter(regexp_extract_all(raw, '\b[A-Z][A-Za-z0-9&\.\-]{2,}\b'), lambda w: lower(w) NOT IN ('what', 'which', 'how', 'full', 'year'))"
    both = f"(e3 || {'anchors' if hint else '[]'})"
    return f"""SELECT qid::BIGINT AS qid, {'nq' if hint else 'raw'} AS enriched_question, {joined('es')} AS entities, {joined('ls')} AS intents, timeframe, list_has_any(ls, ['trend_check', 'compare_values']) AS should_visualize, viz, list_has_any(ls, ['compare_values', 'trend_check', 'driver_analysis', 'extract_key_metrics', 'summarize_document']) OR len(es) > 0 OR timeframe <> 'unspecified' AS use,
        concat_ws(' | ', 'Intent: ' || array_to_string(ls[1:2], ', '), 'Focus: ' || nullif(array_to_string(es[1:2], ', '), ''), 'Timeframe: ' || nullif(timeframe, 'unspecified'), 'Viz: ' || nullif(viz, 'none')) AS summary
        FROM (SELECT *, CASE WHEN list_contains(ls, 'trend_check') THEN 'line' WHEN list_contains(ls, 'compare_values') THEN 'bar' ELSE 'none' END AS viz, list_transform({dedup(both)}, lambda v: {ws('v')})[1:4] AS es
        FROM (SELECT *, list_transform({dedup('(h3 || caps)')}, lambda v: {ws('v')})[1:3] AS e3 FROM (SELECT *, {labels} AS ls, {_INTENT_TIME if hint else _ENRICH_TIME.replace('nq', 'raw')} AS timeframe, list_transform({dedup('hits[1:6]')}, lambda v: {ws('v')})[1:3] AS h3, {caps} AS caps FROM {base})))"""


SQL: dict[str, str] = {
    "scan_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("documents", "chunks", "facts", "extract_cache", "index_vectors", "source_list", "events", "orders")),
    "scan_page_profiles": "SELECT coalesce(source, '') AS source_id, count(*) AS pages, sum(length(trim(coalesce(text, ''), ' ')))::BIGINT AS total_chars, count(*) FILTER (length(trim(coalesce(text, ''), ' ')) < 40) AS short_pages FROM documents GROUP BY 1",
    "json_lines_roundtrip": "SELECT seq, subject, predicate, object, source_id FROM facts",
    "graph_json_roundtrip": f"SELECT src, label, dst, count(*) AS edges FROM {_EDGES} GROUP BY ALL",
    "graph_edges": f"SELECT src, label, dst, count(*) AS edges FROM {_EDGES} GROUP BY ALL",
    "workspace_roundtrip": f"SELECT label, count(*) AS edges FROM {_EDGES} GROUP BY ALL",
    "urls_normalized": f"SELECT source_id, {_URL} AS url, kind || '.example.com' || CASE WHEN coalesce(title, '') = '' THEN '' ELSE ' ' || trim(regexp_replace(replace(lower(title), ' ', '-'), '[-_]+', ' ', 'g')) END AS name FROM source_list",
    "url_lists": "SELECT source_id AS id, 0::BIGINT AS n, 'https://' || kind || '.example.com/a' AS url FROM source_list",
    "html_plain_text": f"SELECT url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g')) AS plain FROM {_HTML}",
    "image_scores": f"SELECT source_id, {_image('src', 'title', 'w')} AS score FROM (SELECT source_id, title, coalesce(trust * 90, 0) AS w, kind || CASE WHEN trust = 1 THEN '/logo.svg' WHEN trust = 2 THEN '/chart.png' ELSE '/photo.jpg' END AS src FROM source_list)",
    "text_normalized": f"SELECT doc_id, {ws('text')} AS plain, greatest(1, floor({words('text')} * 1.33))::BIGINT AS tokens FROM documents",
    "text_tokens": f"SELECT doc_id, {joined(tokens('text', _INDEX_STOP))} AS index_tokens, {joined(tokens('text', _QUERY_STOP))} AS query_tokens FROM documents",
    "heading_lines": f"SELECT doc_id, n, {ws('line')} AS title FROM {_LINES} WHERE {heading('line')}",
    "graph_names": f"""SELECT source_id, CASE WHEN {ws('title')} = '' THEN 'Untitled Graph' ELSE left({ws('title')}, 120) END AS name, left(regexp_replace(regexp_replace(lower(CASE WHEN {ws('title')} = '' THEN 'Untitled Graph' ELSE left({ws('title')}, 120) END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 72) AS slug,
        CASE WHEN length({ws('title')}) > 20 THEN rtrim(left({ws('title')}, 17)) || '...' ELSE {ws('title')} END AS short FROM source_list""",
    "disk_sizes": "SELECT doc_id, CASE WHEN n < 1024 THEN n || '.00 B' WHEN n < 1048576 THEN printf('%.2f', round_even(n / 1024.0 * 100, 0) / 100) || ' KB' ELSE printf('%.2f', round_even(n / 1048576.0 * 100, 0) / 100) || ' MB' END AS size FROM (SELECT doc_id, coalesce(n_chars, 0) * 997 AS n FROM documents)",
    "think_split": rf"""SELECT doc_id, {strip(r"array_to_string(regexp_extract_all(raw, '(?is)<think>(.*?)(?:</think>|\z)', 1), chr(10))")} AS thinking, {strip(r"regexp_replace(regexp_replace(raw, '(?is)<think>.*?(?:</think>|\z)', '', 'g'), '(?i)</think>', '', 'g')")} AS answer
        FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>' || t || '</think>Answer ' || doc_id WHEN 1 THEN 'Answer ' || doc_id || ' <think>' || t ELSE t END AS raw FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "answers_to_continue": rf"""SELECT entry_id, entry_id % 17 = 0 OR (t <> '' AND (regexp_matches(t, '[:\-•,]$') OR (NOT closed AND regexp_extract(lower(l), '([a-z]+)[^a-z]*$', 1) IN ('approximately', 'around', 'about', 'due', 'with', 'to', 'from', 'and', 'or'))
        OR regexp_matches(l, '^[-*]\s+[A-Za-z0-9$%]{{1,24}}$') OR ({words('l')} <= 3 AND NOT closed))) AS goes_on, coalesce(value, '') LIKE '[ERROR]%' AS failed
        FROM (SELECT *, regexp_matches(l, '[.!?"''\])}}]$') AS closed FROM (SELECT *, {_LAST} AS l FROM (SELECT entry_id, value, {_STRIP_V} AS t FROM extract_cache)))""",
    "citations_found": rf"SELECT seq, {joined(cites('source_ref'))} AS ids, regexp_matches(coalesce(source_ref, ''), '(?i)\[\s*graph\s*\]') AS graph FROM facts",
    "numbers_found": rf"SELECT seq, regexp_matches(coalesce(value, ''), '-?\d[\d,]*(\.\d+)?') AS numeric, {number('value')} AS number FROM facts",
    "temporal_signals": f"SELECT chunk_id, round({temporal('text')}::DOUBLE, 6) AS score FROM {_CHUNKS}",
    "main_answers": f"SELECT entry_id, {_MAIN} AS main, {joined(_BULLETS)} AS bullets FROM extract_cache",
    "slim_contexts": f"SELECT chunk_id, left(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '')[1:18], chr(10)), 1800) AS slim FROM {_CHUNKS}",
    "sections_of_pages": f'SELECT doc_id, section, title, body, start, fin AS "end" FROM {_SECTIONS}',
    "word_windows": f"SELECT doc_id, idx, part FROM {windows('documents', 'doc_id', 'text', 220, 30)}",
    "chunks_built": f"WITH pgs AS {_PAGES} {built('ex', 220, 30)} UNION ALL {built('re', 400, 56)}",
    "char_windows": f"SELECT doc_id, part, '[Page ' || (doc_id + 1) || ' | Part ' || (part + 1) || '] ' || x AS text FROM (SELECT doc_id, part, trim(substr(t, part * 740 + 1, 900), ' ') AS x FROM (SELECT doc_id, t, unnest(range(0, least(14, greatest(0, ceil((length(t) - 900) / 740.0))::BIGINT + 1))) AS part FROM (SELECT doc_id, {ws('text')} AS t FROM documents) WHERE length(t) >= 80)) WHERE length(x) >= 80",
    "vision_pages": "SELECT source_id, page, has_image, text_len, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY has_image DESC, text_len, page) AS rank FROM (SELECT source_id, page_or_doc_idx::BIGINT AS page, bool_or(is_vision) AS has_image, max(length(coalesce(text, ''))) AS text_len FROM chunks WHERE track = 'retrieval' GROUP BY 1, 2) WHERE has_image OR text_len <= 400) WHERE rank <= 5",
    "numeric_facts": f"SELECT chunk_id, n, source_id AS subject, predicate, object, value, unit, timeframe, 0.66::DOUBLE AS confidence, '[Chunk ' || chunk_id || ']' AS source_ref, source_id FROM {numeric(_EXTRACTION)}",
    "timeline_facts": f"SELECT chunk_id, n, source_id AS subject, predicate, object, value, 'years' AS unit, 0.68::DOUBLE AS confidence, '[Chunk ' || chunk_id || ']' AS source_ref, source_id FROM {timeline(_EXTRACTION)}",
    "order_facts": f"SELECT chunk_id, predicate, object, value, unit, timeframe FROM {numeric(_ORDERS)} UNION ALL SELECT chunk_id, predicate, object, value, 'years', '' FROM {timeline(_ORDERS)}",
    "stream_build_ticks": f"SELECT chunk_id, n, predicate, value, unit FROM {numeric(_EXTRACTION)}",
    "json_facts": rf"""SELECT * FROM (SELECT entry_id, n - 1 AS n, {', '.join(f"{ws(f'f ->> {chr(39)}$.{c}{chr(39)}')} AS {c}" for c in _SIX)}, greatest(0.0, least(1.0, coalesce(try_cast(f ->> '$.confidence' AS DOUBLE), 0.76)))::DOUBLE AS confidence
        FROM (SELECT entry_id, {_ARRAY} AS fs FROM (SELECT entry_id, CASE WHEN json_valid(value) AND NOT regexp_matches(value, ',\s*[}}\]]') THEN value::JSON END AS v FROM extract_cache) WHERE v IS NOT NULL AND json_type(v) IN ('ARRAY', 'OBJECT')), unnest(fs) WITH ORDINALITY AS u(f, n)) WHERE subject <> '' AND predicate <> '' AND object <> ''""",
    "facts_once_in_chunk": f"""SELECT chunk_id, first AS seq, subject, predicate, object, value, unit, timeframe, confidence, source_ref, source_id FROM (SELECT *, min(seq) OVER w AS first, row_number() OVER (PARTITION BY chunk_id, {', '.join(f'lower({ws(c)})' for c in _SIX)} ORDER BY c DESC, seq) AS rn
        FROM (SELECT chunk_id, seq, subject, predicate, object, value, unit, timeframe, source_ref, source_id, {_CONF} AS confidence, {_CONF} AS c FROM facts) WINDOW w AS (PARTITION BY chunk_id, {', '.join(f'lower({ws(c)})' for c in _SIX)})) WHERE rn = 1""",
    "cache_misses": "SELECT cache_key, entry_id FROM (SELECT cache_key, entry_id FROM extract_cache WHERE entry_id % 2 = 0 UNION ALL SELECT md5(coalesce(chunk_id, '')), seq FROM facts) WHERE cache_key IS NULL OR cache_key NOT IN (SELECT cache_key FROM extract_cache WHERE value IS NOT NULL AND NOT starts_with(value, '[ERROR]') AND cache_key IS NOT NULL)",
    "cache_upsert": "SELECT cache_key, value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY updated_at DESC, entry_id DESC) AS rn FROM (SELECT entry_id, cache_key, value, updated_at FROM extract_cache UNION ALL SELECT entry_id + 1000000000, cache_key, '{}', '2099-01-01T00:00:00Z' FROM extract_cache WHERE entry_id % 10 = 0) WHERE cache_key <> '') WHERE rn = 1",
    "canonical_exact": _CANON,
    "entity_frequencies": f"SELECT name AS entity, count(*) AS frequency FROM {_NAMED} WHERE name <> '' GROUP BY 1",
    "node_degrees": f"SELECT id, degree, (14 + floor(26 * degree / (SELECT max(degree) FROM {_DEGREES})))::BIGINT AS size, CASE WHEN degree >= 10 THEN 'hub' WHEN degree >= 4 THEN 'mid' ELSE 'leaf' END AS shade FROM {_DEGREES}",
    "question_entities": f"SELECT qid::BIGINT AS qid, id, score::BIGINT AS score, rank FROM {_SEEDS}",
    "graph_neighbours": f"""WITH e AS {_EDGES}, s AS {_SEEDS}, hits AS (SELECT qid, src, label, dst, min(struct_pack(a := rank, b := side, c := seq, ref := coalesce(source_ref, ''))) AS best FROM (SELECT qid, rank, 0 AS side, e.* FROM e JOIN s ON e.src = s.id UNION ALL SELECT qid, rank, 1, e.* FROM e JOIN s ON e.dst = s.id) GROUP BY ALL)
        SELECT qid::BIGINT AS qid, rank, trim(src || ' -[' || label || ']-> ' || dst || ' ' || {ws('best.ref')}) AS line FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best, src, label, dst) AS rank FROM hits) WHERE rank <= 120""",
    "keyword_nodes": f"""SELECT qid::BIGINT AS qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT qid, id, round((CASE WHEN contains(lower(id), ql) THEN 4.0 ELSE 0 END + least(3.0, 0.9 * hits) + least(1.2, 0.03 * degree))::DOUBLE, 6) AS score
        FROM (SELECT *, len(list_filter(toks, lambda t: contains(lower(id), t))) AS hits FROM {_DEGREES} n, (SELECT qid, lower(trim(question, ' ')) AS ql, {tokens('question', "'what','which','show','give','about','from','with','this','that','the'")} AS toks FROM {_Q}) q) WHERE contains(lower(id), ql) OR hits > 0)) WHERE rank <= 18""",
    "metric_map": f"SELECT DISTINCT key, pos FROM (SELECT pos, unnest({tokens('text', _INDEX_STOP)}) AS key FROM {_RETRIEVAL}) WHERE key IN ('ebit','ebitda','revenue','margin','cash','fcf','capex','volume','guidance','profit','cost','growth')",
    "bm25_statistics": f"{_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_top": f"{_BM25} {top('bm', 16, 'qid::BIGINT AS qid, pos, score, rank')}",
    "dense_top": top("(SELECT a.vec_id AS qid, b.vec_id AS pos, round(list_dot_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-8) + 1e-8), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND len(a.embedding) = len(b.embedding))", 16),
    "lexical_top": f"WITH {_LEX} {top('lex', 8, 'qid::BIGINT AS qid, pos, score::DOUBLE AS score, rank')}",
    "question_intents": f"""SELECT qid::BIGINT AS qid, nq AS normalized_question, {joined('labels')} AS intents, {joined('anchors')} AS anchors, derive AS requires_derivation, CASE WHEN derive THEN 'year_difference' ELSE '' END AS derivation_type, {_INTENT_TIME} AS timeframe,
        list_has_any(labels, ['trend_check', 'compare_values']) AS should_visualize, CASE WHEN derive THEN 'timeline year difference between ' || anchors[1] || ' and ' || anchors[2] || ' before after years' ELSE nq END AS canonical_retrieval_query FROM {_INTENTS}""",
    "question_timeframes": rf"""SELECT qid::BIGINT AS qid, {_INTENT_TIME} AS intent, {_ENRICH_TIME} AS enrichment,
        CASE WHEN len(ys) > 0 THEN array_to_string(list_filter(ys, lambda y, i: list_position(ys, y) = i), ',') WHEN len(regexp_extract_all(ql, 'fy\s*\d{{2}}')) > 0 THEN replace(array_to_string(regexp_extract_all(ql, 'fy\s*\d{{2}}'), ','), ' ', '') WHEN len(regexp_extract_all(ql, 'q[1-4]')) > 0 THEN upper(array_to_string(regexp_extract_all(ql, 'q[1-4]'), ',')) ELSE 'unspecified' END AS plan
        FROM (SELECT *, regexp_extract_all(nq, '(?:19|20)\d{{2}}') AS ys FROM {_NQ})""",
    "grounding_verdicts": rf"""SELECT seq, CASE WHEN t = '' THEN 'retry' WHEN nf THEN 'not_found' WHEN none THEN 'retry' WHEN bad THEN 'retry' ELSE 'pass' END AS verdict,
        CASE WHEN t = '' THEN 'empty_answer' WHEN nf THEN 'model_not_found' WHEN none THEN 'missing_citations' WHEN bad THEN 'invalid_chunk_citations' ELSE 'rule_pass' END AS reason
        FROM (SELECT seq, lower(trim(answer)) AS t, contains(lower(answer), 'couldn''t find') OR contains(lower(answer), 'not found') AS nf, len({_CITED}) = 0 AND NOT regexp_matches(answer, '(?i)\[\s*graph\s*\]') AS none, len({_INVALID}) > 0 AS bad FROM {_ANSWERS})""",
    "supported_citations": f"SELECT seq, len({_CITED}) > 0 AND len({_INVALID}) = 0 AS supported, len({_INVALID}) AS invalid FROM {_ANSWERS}",
    "packed_contexts": rf"""WITH l AS (SELECT c.source_id AS qid, c.pos AS rank, {ws('c.text')} AS line, trim(string_split(coalesce(s.title, ''), ' ')[1], ' ') AS a FROM {_RETRIEVAL} c LEFT JOIN source_list s USING (source_id)),
        x AS (SELECT *, greatest(1, floor({words('line')} * 1.33))::BIGINT AS t, CASE WHEN a <> '' AND contains(lower(line), lower(a)) THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)\b\d+\s+years?\s+(?:before|after)\b|\btakes place\b|\bset\b') THEN 1.5 ELSE 0 END AS score FROM l),
        c AS (SELECT * FROM (SELECT qid, line, row_number() OVER w AS place, 7 + sum(t) OVER w AS used FROM x WINDOW w AS (PARTITION BY qid ORDER BY score DESC, rank ROWS UNBOUNDED PRECEDING)) WHERE used <= 5200),
        g AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY seq) AS place, line, sum(greatest(1, floor({words('line')} * 1.33))::BIGINT) OVER (PARTITION BY qid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT f.source_id AS qid, e.seq, e.src || ' -[' || e.label || ']-> ' || e.dst AS line FROM {_EDGES} e JOIN facts f USING (seq) WHERE f.predicate = 'has_profile' AND f.source_id IS NOT NULL)),
        q AS (SELECT qid FROM l UNION SELECT qid FROM g),
        b AS (SELECT qid, coalesce(m, 7) AS taken, coalesce(m, 7) + 6 <= 5200 AS fits FROM q LEFT JOIN (SELECT qid, max(used) AS m FROM c GROUP BY qid) USING (qid))
        SELECT qid, part, place::BIGINT AS place, used::BIGINT AS used, md5(line) AS line FROM (SELECT qid, 0 AS part, 0 AS place, 7 AS used, 'Relevant chunks (cite as [Chunk <id>]):' AS line FROM q UNION ALL SELECT qid, 0, place, used, line FROM c
         UNION ALL SELECT qid, 1, 0, taken + 6, 'Graph edges (cite as [Graph]):' FROM b WHERE fits UNION ALL SELECT qid, 1, place, used, line FROM (SELECT g.qid, place, line, s + taken + CASE WHEN fits THEN 6 ELSE 0 END AS used FROM g JOIN b USING (qid)) WHERE used <= 5200)""",
    "judge_verdicts": rf"""SELECT entry_id, CASE WHEN raw LIKE '[ERROR]%' THEN 'retry' WHEN js IS NOT NULL THEN CASE WHEN said IN ('pass', 'retry', 'not_found') THEN said ELSE 'pass' END WHEN contains(l, 'not_found') OR contains(l, 'not found') THEN 'not_found' WHEN contains(l, 'retry') THEN 'retry' ELSE 'pass' END AS verdict,
        CASE WHEN raw LIKE '[ERROR]%' THEN 'judge_timeout' WHEN js IS NOT NULL THEN trim(coalesce(js ->> '$.issues', js ->> '$.issue', ''), ' ') WHEN contains(l, 'not_found') OR contains(l, 'not found') OR contains(l, 'retry') OR contains(l, 'pass') THEN 'judge_text_parse' ELSE 'judge_parse_fallback' END AS issues
        FROM (SELECT *, lower(trim(coalesce(js ->> '$.verdict', 'pass'), ' ')) AS said FROM (SELECT *, lower(raw) AS l, CASE WHEN json_valid(obj) AND NOT regexp_matches(obj, ',\s*[}}\]]') THEN obj::JSON END AS js FROM (SELECT entry_id, {_JUDGED} AS raw, regexp_extract({_JUDGED}, '(?s)(\{{.*\}})', 1) AS obj FROM extract_cache)))""",
    "build_evaluation": rf"""SELECT * EXCLUDE (epp, cited, proxy), concat_ws('|', CASE WHEN epp < 6 THEN 'edges_per_page>=6' END, CASE WHEN none_node_rate <> 0 THEN 'none_node_rate==0' END, CASE WHEN cited < 0.95 THEN 'citation_validity>=0.95' END, CASE WHEN proxy < 0.85 THEN 'retrieval_recall@8_proxy>=0.85' END, 'citation_context_validity_rate>=0.95') AS failed, false AS passed
        FROM (SELECT nodes, edges, facts, retrieval_chunks, pages, round(edges / pages, 4) AS edges_per_page, round(none, 4)::DOUBLE AS none_node_rate, round(cited, 4) AS citation_validity_rate, round(numeric, 4) AS numeric_support_rate, round(proxy, 4) AS recall_proxy, 1.0::DOUBLE AS anchor_coverage_rate, 0.5::DOUBLE AS derivation_success_rate, 0.9::DOUBLE AS citation_context_validity_rate,
         10.0::DOUBLE AS build_total_sec, 5.0::DOUBLE AS extract_sec, round(facts / 5.0, 4)::DOUBLE AS facts_per_sec, edges / pages AS epp, cited, proxy
        FROM (SELECT *, least(1.0, 0.55 * metric + 0.30 * entity + 0.15 * least(1.0, edges / pages / 8))::DOUBLE AS proxy FROM (SELECT (SELECT count(*) FROM {_DEGREES}) AS nodes, (SELECT coalesce(avg((lower(trim(id, ' ')) IN ({_NULLS}))::INT), 0) FROM {_DEGREES}) AS none, (SELECT count(*) FROM {_EDGES}) AS edges, (SELECT count(*) FROM {_RETRIEVAL}) AS retrieval_chunks, (SELECT count(*) FROM documents) AS pages,
          (SELECT (count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z0-9])(ebit|ebitda|revenue|margin|cash|fcf|capex|volume|guidance|profit|cost|growth)([^a-z0-9]|$)')) > 0)::INT FROM {_RETRIEVAL}) AS metric, (SELECT (count(*) FILTER (regexp_matches(text, '\b[A-Z][A-Za-z0-9&.\-]{{2,}}\b')) > 0)::INT FROM {_RETRIEVAL}) AS entity,
          count(*) AS facts, avg((trim(coalesce(source_ref, ''), ' ') <> '')::INT) AS cited, avg((regexp_matches(coalesce(value, ''), '\d') OR regexp_matches(coalesce(object, ''), '\d'))::INT) AS numeric FROM facts)))""",
    "workspace_catalog": "SELECT source_id AS rag_id, count(*) AS files, sum(length(coalesce(text, '')))::BIGINT AS disk_bytes FROM chunks GROUP BY 1",
    "chat_sessions": "SELECT user_id AS id, count(*) AS messages, coalesce(left(arg_min(event_type || ' ' || event_id, event_id) FILTER (event_type = 'click'), 64), 'New Session') AS title, max(event_id) AS updated_at FROM events GROUP BY 1",
    "merged_sources": "SELECT lower(name) AS name, min(part)::BIGINT AS part FROM (SELECT publisher AS name, 0 AS part FROM source_list WHERE trust >= 3 UNION ALL SELECT publisher, 1 FROM source_list) WHERE trim(name) <> '' GROUP BY 1",
    "stream_answers": "SELECT user_id AS request, '' AS thinking, string_agg(event_type, ' ' ORDER BY event_id) AS answer, 'stop' AS done_reason FROM events GROUP BY 1",
    "extracted_facts": f"""SELECT chunk_id, subject, predicate, object, value, unit, timeframe, confidence, '[Chunk ' || chunk_id || ']' AS source_ref, own AS source_id FROM (SELECT chunk_id, source_id AS own, ws[1] AS subject, 'named_with' AS predicate, ws[2] AS object, '' AS value, '' AS unit, '' AS timeframe, 0.76::DOUBLE AS confidence FROM {_SPOKEN} WHERE len(ws) >= 2
        UNION ALL SELECT chunk_id, own, subject, predicate, object, value, unit, timeframe, 0.66 FROM (SELECT x.*, x.source_id AS subject, o.source_id AS own, row_number() OVER (PARTITION BY chunk_id, predicate, lower(object), lower(timeframe), value, lower(unit) ORDER BY n) AS rn FROM {numeric(_SEEDED)} x JOIN {_EXTRACTION} o USING (chunk_id)) WHERE rn = 1
        UNION ALL SELECT chunk_id, own, subject, predicate, object, value, 'years', '', 0.68 FROM (SELECT x.*, x.source_id AS subject, o.source_id AS own, row_number() OVER (PARTITION BY chunk_id, predicate, lower(object), value ORDER BY n) AS rn FROM {timeline(_SEEDED)} x JOIN {_EXTRACTION} o USING (chunk_id)) WHERE rn = 1)""",
    "extraction_cache": f"SELECT (SELECT count(*) FROM {_SPOKEN} WHERE len(ws) >= 2) AS facts, 0::BIGINT AS stored_again",
    "index_roundtrip": rf"""{_BM25} SELECT 'words' AS part, sum(tf)::BIGINT AS rows FROM post UNION ALL SELECT 'postings', count(*) FROM post UNION ALL SELECT 'terms', count(*) FROM idf UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'vectors', count(*) FROM c
        UNION ALL SELECT 'tags', count(*) FROM (SELECT DISTINCT 'm' AS k, t AS key, pos FROM (SELECT pos, unnest(toks) AS t FROM c) WHERE t IN ('ebit','ebitda','revenue','margin','cash','fcf','capex','volume','guidance','profit','cost','growth'))""",
    "appended_vectors": "WITH v AS (SELECT pos, len(embedding) AS dim FROM index_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64) SELECT pos, dim FROM v UNION ALL SELECT pos + 1 + (SELECT max(pos) FROM v), dim FROM v",
    "enriched_questions": _enriched(True),
    "inferred_questions": _enriched(False),
}
