"""The registered queries as DuckDB SQL over the same tables.

DuckDB's patterns have no look-ahead and only ASCII short forms, so classes are spelled out here as well.
"""

from __future__ import annotations

from clauseloom.functions.words import ABBREVIATIONS, STOP_WORDS
from clauseloom.operators.lines import VETOES

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'^[{WS}]+|[{WS}]+\z')}, '', 'g')"


def clean(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '\\r\\n|\\r', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({out}, '[ \\t]+', ' ', 'g')")


FIRST = "array_to_string(list_slice(string_split(l, ' '), 1, 3), ' ')"
POLICIES = f"""policies AS (
  SELECT doc_id, 'policy-' || doc_id || '.txt' AS file_name,
    array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: CASE (doc_id + i - 1) % 10
      WHEN 0 THEN i || ' ' || {FIRST} || chr(10) || l
      WHEN 1 THEN (i - 1) || '.' || (doc_id % 7 + 1) || ' ' || {FIRST} || chr(10) || l
      WHEN 2 THEN (i - 1) || '.1.' || (doc_id % 5 + 1) || ': ' || {FIRST} || chr(10) || l
      WHEN 3 THEN '- ' || l
      WHEN 4 THEN 'Section ' || i || '. ' || {FIRST} || chr(10) || l
      WHEN 5 THEN 'A-' || i || ' ' || {FIRST}
      WHEN 6 THEN i || '. ' || lower({FIRST}) || chr(10) || l
      WHEN 7 THEN '2024 ' || {FIRST} || chr(10) || (i + 30) || chr(10) || l
      WHEN 8 THEN chr(9) || chr(9) || l || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)
      ELSE CASE ((doc_id + i - 1) // 10) % 5
        WHEN 0 THEN i || '.' || chr(160) || ' ' || lower({FIRST}) || chr(10) || l
        WHEN 1 THEN i || ' *' || {FIRST} || chr(10) || l
        WHEN 2 THEN i || ' T ' || {FIRST} || ' ' || {FIRST} || ' ' || {FIRST} || chr(10) || l
        WHEN 3 THEN i || ' Terms:' || chr(10) || l
        ELSE l END END), chr(10)) AS text
  FROM documents)"""

HEADING = rf"^(Section[{WS}]+\p{{Nd}}[\p{{Nd}}.]*|[A-Z]-\p{{Nd}}[\p{{Nd}}.]*|\p{{Nd}}+(?:\.\p{{Nd}}+)+|\p{{Nd}}+)(?:[{WS}]*[.:]?[{WS}]+|[{WS}]*\z)((?:[^\p{{Nd}}a-z].*)?)\z"
BULLET = rf"^[{WS}]*(?:[\x{{2022}}\x{{2013}}\x{{2014}}*\-]|[a-z]\)|[ivxlc]+\)|\([0-9]+\))[{WS}]+"
SINGLE = r"regexp_matches(id, '^\p{Nd}+\z')"
TESTS = {
    "fake": f"regexp_matches(stripped, {q(rf'^\p{{Nd}}+\.[{WS}]+[a-z]')})",
    "lowercase_title": rf"{SINGLE} AND regexp_matches(left(rest, 1), '\p{{Ll}}')",
    "year": r"regexp_matches(id, '^(?:19|20)\p{Nd}{2}\z')",
    "bad_first_char": f"{SINGLE} AND rest <> '' AND NOT regexp_matches(rest, {q(r'^[\p{Lu}\p{Nd}"' + chr(39) + r'(]')})",
    "long_title": f"{SINGLE} AND rest <> '' AND len(regexp_split_to_array(rest, {q(rf'[{WS}]+')})) > 7",
    "colon_end": f"{SINGLE} AND suffix(rest, ':')",
    "bare_integer": f"{SINGLE} AND rest = ''",
    "noise": f"regexp_matches(left(rest, 20), {q(rf'[^\p{{L}}\p{{N}}_.:\-{WS}]')})",
}


def lines(source: str) -> str:
    """CTEs up to ``lines`` from a table with doc_id and text."""
    veto = " ".join(f"WHEN {TESTS[name]} THEN '{name}'" for name in VETOES)
    return f"""cleaned AS (SELECT doc_id, string_split({clean('text')}, chr(10)) AS ls FROM {source}),
exploded AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM cleaned),
stripped AS (SELECT *, {strip('line')} AS stripped FROM exploded),
matched AS (SELECT *, regexp_extract(stripped, {q(HEADING)}, 1, 's') AS id, {strip(f"regexp_extract(stripped, {q(HEADING)}, 2, 's')")} AS rest,
  regexp_matches(line, {q(BULLET)}) AS bullet FROM stripped WHERE stripped <> ''),
vetoed AS (SELECT *, CASE WHEN id <> '' AND NOT bullet THEN CASE {veto} END END AS veto FROM matched),
lines AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, stripped, veto, CASE WHEN bullet THEN 'bullet' WHEN id <> '' AND veto IS NULL THEN 'heading' ELSE 'body' END AS kind,
  CASE WHEN NOT bullet AND id <> '' AND veto IS NULL THEN id END AS heading_id, CASE WHEN NOT bullet AND id <> '' AND veto IS NULL THEN rest END AS title FROM vetoed)"""


SEGMENTS = rf"""numbered AS (SELECT *, sum(CAST(kind = 'heading' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM lines),
grouped AS (SELECT doc_id, grp, max(heading_id) AS heading_id, max(title) AS title, count(*) FILTER (kind <> 'heading') AS n_lines,
  min(line_no) FILTER (kind = 'body') AS body_no, arg_min(stripped, line_no) FILTER (kind = 'body') AS body,
  string_agg(stripped, chr(10) ORDER BY line_no) FILTER (kind <> 'heading') AS text FROM numbered GROUP BY ALL),
named AS (SELECT doc_id, grp, CASE WHEN grp = 0 THEN 'PREAMBLE-' || body_no ELSE heading_id END AS clause_id,
  CASE WHEN grp = 0 THEN {strip('left(body, 80)')} ELSE title END AS title, text FROM grouped WHERE CASE WHEN grp = 0 THEN body_no IS NOT NULL ELSE n_lines > 0 END),
deep AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS INTEGER) AS seg_no,
  CAST(CASE WHEN clause_id LIKE 'Section%' OR regexp_matches(clause_id, '^[A-Z]-') THEN 1 ELSE len(string_split(clause_id, '.')) END AS INTEGER) AS depth FROM named),
segments AS (SELECT *, CASE depth WHEN 1 THEN 'clause' WHEN 2 THEN 'sub-clause' ELSE 'sub-sub-clause' END AS level FROM deep)"""

CORE = f"WITH {POLICIES}, {lines('policies')}, {SEGMENTS}"


def keywords() -> str:
    """CTEs from ``segments`` to ``top``."""
    always = q(r"[;?!@#$%&*" + "\"“”«»" + r"()\[\]{}<>`]|--")
    text = f"regexp_replace(text, {always}, ' ', 'g')"
    text = f"regexp_replace({text}, {q(r'[,:]+([^\p{Nd},:]|\z)')}, {q(r' \1')}, 'g')"
    contraction = q(r"(?i)(\p{L})(n['’]t|['’](?:s|ll|re|ve|m|d))\b")
    text = f"regexp_replace({text}, {contraction}, {q(r'\1 \2')}, 'g')"
    # rewrites name nine groups at most, so each pair has its own
    for a, b in (("can", "not"), ("gon", "na"), ("gim", "me"), ("lem", "me"), ("got", "ta"), ("wan", "na")):
        text = f"regexp_replace({text}, {q(rf'(?i)\b({a})({b})\b')}, {q(r'\1 \2')}, 'g')"
    listed = ", ".join(q(f"{a}.") for a in ABBREVIATIONS)
    bare = "regexp_replace(regexp_replace(t, " + q("[.]+['’]*\\z|['’]+\\z") + ", '', 'g'), " + q("^['‘’]+") + ", '', 'g')"
    return f"""tokens AS (SELECT doc_id, seg_no, list_filter(regexp_split_to_array({text}, {q(rf'[{WS}]+')}), lambda t: t <> '') AS ts FROM segments),
bare AS (SELECT doc_id, seg_no, list_transform(ts, lambda t, i: CASE WHEN lower(t) IN ({listed}) AND i < len(ts) THEN t ELSE {bare} END) AS ts FROM tokens),
words AS (SELECT doc_id, seg_no, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM bare),
counts AS (SELECT doc_id, seg_no, lower(t) AS word, count(*) AS n, min(pos) AS pos FROM words
  WHERE regexp_matches(t, {q(r'^\p{L}{3,}\z')}) AND lower(t) NOT IN ({', '.join(map(q, STOP_WORDS))}) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY n DESC, pos) AS rn FROM counts),
top AS (SELECT doc_id, seg_no, list(word ORDER BY rn) AS keywords FROM ranked WHERE rn <= 5 GROUP BY ALL)"""


def contexts() -> str:
    """CTEs from ``segments`` to ``contexts``."""
    boundary = q(r"([.?!]+[" + "\"'”’" + rf")\]}}]*)([{WS}]+)")
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    goes_on = f"""(regexp_matches(before, {q(rf'(?i)(?:^|[^\p{{L}}\p{{N}}.])(?:{names})\.\z')}) OR regexp_matches(before, {q(r'(?:^|[^\p{L}\p{N}])\p{Lu}\.\z')})
    OR regexp_matches(before, {q(r'(?:^|[^\p{L}\p{N}])\p{Nd}+\.\z')}) AND regexp_matches(piece, {q(rf'^[{WS}]*\p{{Ll}}')}))"""
    return f"""cut AS (SELECT doc_id, seg_no, string_split(regexp_replace(text, {boundary}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM segments),
pieces AS (SELECT doc_id, seg_no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM cut),
lagged AS (SELECT *, lag(piece) OVER (PARTITION BY doc_id, seg_no ORDER BY i) AS before FROM pieces),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR {goes_on} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, seg_no ORDER BY i) AS s FROM lagged),
sentences AS (SELECT doc_id, seg_no, s, {strip("string_agg(piece, '' ORDER BY i)")} AS sentence FROM marked GROUP BY doc_id, seg_no, s),
contexts AS (SELECT doc_id, seg_no, string_agg(sentence, ' ' ORDER BY s) AS context FROM sentences WHERE s < 2 GROUP BY doc_id, seg_no)"""


def types(source: str) -> str:
    """CTEs from a table with doc_id and text to ``types``: counts of word types, and which are abbreviations."""
    around = q("^[\"'“”‘’(\\[{]+|[\"'“”‘’)\\]},;:!?]+\\z")
    ends = q("[.?!:;][\"'”’)\\]}]*\\z")
    return rf"""listed AS (SELECT list_filter(regexp_split_to_array(coalesce(text, ''), {q(rf'[{WS}]+')}), lambda t: t <> '') AS ts FROM {source}),
tokens AS (SELECT unnest(ts) AS token, unnest(list_prepend(NULL, ts[:-2])) AS before FROM listed WHERE len(ts) > 0),
cores AS (SELECT regexp_replace(token, {around}, '', 'g') AS core, before FROM tokens),
ended AS (SELECT *, suffix(core, '.') AND NOT suffix(core, '..') AS ends FROM cores),
typed AS (SELECT lower(CASE WHEN ends THEN left(core, length(core) - 1) ELSE core END) AS word, ends, left(core, 1) AS letter, coalesce(NOT regexp_matches(before, {ends}), false) AS inside FROM ended),
counted AS (SELECT CASE WHEN regexp_matches(word, '^\p{{L}}+(?:\.\p{{L}}+)*\z') THEN word END AS type, count(*) FILTER (ends) AS with_period, count(*) FILTER (NOT ends) AS without_period,
  count(*) FILTER (regexp_matches(letter, '\p{{Ll}}')) AS small, count(*) FILTER (regexp_matches(letter, '\p{{Lu}}') AND inside) AS capital_inside FROM typed GROUP BY 1),
rates AS (SELECT *, sum(with_period) OVER () / sum(with_period + without_period) OVER () AS p, length(type) - length(replace(type, '.', '')) AS inner_periods FROM counted),
scored AS (SELECT *, 2 * (with_period * ln(0.99) + without_period * ln(1 - 0.99) - with_period * ln(p) - without_period * ln(1 - p)) * exp(inner_periods - length(type)) * (inner_periods + 1) * pow(length(type) - inner_periods, -without_period) AS score FROM rates),
types AS (SELECT type, with_period, without_period, small, capital_inside, with_period > 0 AND score >= 0.3 AS abbreviation FROM scored WHERE type IS NOT NULL)"""


def learned_contexts() -> str:
    """CTEs from ``segments`` and ``types`` to ``contexts``."""
    boundary = q(r"([.?!]+[" + "\"'”’" + rf")\]}}]*)([{WS}]+)")
    around = q("^[\"'“”‘’(\\[{]+|[\"'“”‘’)\\]},;:!?]+\\z")
    last = f"regexp_replace(list_filter(regexp_split_to_array(piece, {q(rf'[{WS}]+')}), lambda t: t <> '')[-1], {around}, '', 'g')"
    first = f"regexp_replace(regexp_replace(list_filter(regexp_split_to_array(piece, {q(rf'[{WS}]+')}), lambda t: t <> '')[1], {around}, '', 'g'), '\\.\\z', '')"
    return rf"""cut AS (SELECT doc_id, seg_no, string_split(regexp_replace(text, {boundary}, '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM segments),
pieces AS (SELECT doc_id, seg_no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM cut),
told AS (SELECT *, lead({first}) OVER w AS next, lead(piece) OVER w AS next_piece, {last} AS last FROM pieces WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY i)),
short AS (SELECT told.*, a.type IS NOT NULL AS short FROM told LEFT JOIN types a ON a.abbreviation AND suffix(last, '.') AND a.type = lower(left(last, length(last) - 1))),
spelt AS (SELECT s.*, n.type IS NOT NULL AS new FROM short s LEFT JOIN types n ON n.small > 0 AND n.capital_inside = 0 AND s.short AND regexp_matches(left(next, 1), '\p{{Lu}}') AND n.type = lower(next)),
flagged AS (SELECT *, short AND NOT new OR regexp_matches(piece, '(?:^|[^\p{{L}}\p{{N}}])\p{{Lu}}\.\z')
  OR regexp_matches(piece, '(?:^|[^\p{{L}}\p{{N}}])\p{{Nd}}+\.\z') AND coalesce(regexp_matches(next_piece, {q(rf'^[{WS}]*\p{{Ll}}')}), false) AS goes_on FROM spelt),
numbered_pieces AS (SELECT *, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, seg_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM flagged),
sentences AS (SELECT doc_id, seg_no, s, {strip("string_agg(piece, '' ORDER BY i)")} AS sentence FROM numbered_pieces WHERE s < 2 GROUP BY doc_id, seg_no, s),
contexts AS (SELECT doc_id, seg_no, string_agg(sentence, ' ' ORDER BY s) AS context FROM sentences WHERE sentence <> '' GROUP BY doc_id, seg_no)"""


PARENTS = """parents AS (SELECT a.doc_id, a.seg_no, arg_max(b.clause_id, b.seg_no) AS parent_clause
  FROM segments a LEFT JOIN segments b ON a.doc_id = b.doc_id AND b.seg_no < a.seg_no AND b.depth < a.depth GROUP BY a.doc_id, a.seg_no)"""


def json_sql() -> str:
    """Each document's segments as one JSON array, absent parents left out."""
    field = lambda name, value: f"'\"{name}\":' || to_json({value})"
    fields = " || ',' || ".join(field(c, f"s.{c}") for c in ("file_name", "clause_id", "level", "title", "text"))
    parent = f"CASE WHEN parent_clause IS NULL THEN '' ELSE ',' || {field('parent_clause', 'parent_clause')} END"
    rest = f"{field('keywords', 'coalesce(keywords, [])')} || ',' || {field('context', 'context')}"
    return f"""{CORE}, {keywords()}, {contexts()}, {PARENTS},
objects AS (SELECT s.doc_id, s.seg_no, '{{' || {fields} || {parent} || ',' || {rest} || '}}' AS object
  FROM (SELECT segments.*, file_name FROM segments JOIN policies USING (doc_id)) s LEFT JOIN top USING (doc_id, seg_no) LEFT JOIN contexts USING (doc_id, seg_no) LEFT JOIN parents USING (doc_id, seg_no))
SELECT p.doc_id, regexp_replace(p.file_name, '[.][^./]*$', '') || '_output.json' AS output_name, '[' || coalesce(string_agg(object, ',' ORDER BY seg_no), '') || ']' AS json
  FROM policies p LEFT JOIN objects o ON p.doc_id = o.doc_id GROUP BY p.doc_id, p.file_name"""


#: A text of each source's thousands of documents, under its file's name.
BINDERS = f"""{POLICIES}, binders AS (SELECT coalesce(source, 'none') || '-' || doc_id // 1000 || '.txt' AS doc_id, string_agg(p.text, chr(10) ORDER BY p.doc_id) AS text
  FROM policies p JOIN (SELECT doc_id, source FROM documents) d USING (doc_id) GROUP BY 1)"""

PREAMBLE = "SELECT doc_id, clause_id, title FROM segments WHERE clause_id LIKE 'PREAMBLE-%'"
BLANK = rf"regexp_matches(t, '^[{WS}]*\z')"

ORACLES: dict[str, str] = {
    "level_counts": f"{CORE} SELECT doc_id, level, count(*) AS n_segments FROM segments GROUP BY ALL",
    "clean_documents": f"WITH {POLICIES} SELECT doc_id, {clean('text')} AS clean FROM policies",
    "line_kinds": f"WITH {POLICIES}, {lines('policies')} SELECT doc_id, line_no, kind, heading_id, title, veto FROM lines",
    "heading_vetoes": f"WITH {POLICIES}, {lines('policies')} SELECT veto, count(*) AS n_lines FROM lines WHERE veto IS NOT NULL GROUP BY ALL",
    "segments_core": f"{CORE} SELECT doc_id, seg_no, clause_id, level, title, text, depth FROM segments",
    "segment_parents": f"{CORE}, {PARENTS} SELECT doc_id, seg_no, clause_id, parent_clause FROM segments JOIN parents USING (doc_id, seg_no)",
    "preambles": f"""SELECT 'raw' AS corpus, * FROM (WITH {lines('documents')}, {SEGMENTS} {PREAMBLE})
      UNION ALL SELECT 'rendered', * FROM ({CORE} {PREAMBLE})""",
    "segment_keywords": f"""{CORE}, {keywords()}
      SELECT s.doc_id, s.seg_no, coalesce(array_to_string(keywords, ' '), '') AS keywords FROM segments s LEFT JOIN top USING (doc_id, seg_no)""",
    "envelope_parts": f"""{CORE}, sized AS (SELECT doc_id, seg_no, clause_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM segments),
      parts AS (SELECT doc_id, min(seg_no) AS from_segment, string_agg(clause_id, ' ' ORDER BY seg_no) AS clause_ids FROM sized GROUP BY doc_id, begun // 2000, (begun + n - 1) // 2000),
      totals AS (SELECT doc_id, count(*) AS n FROM segments GROUP BY doc_id)
      SELECT p.doc_id, p.file_name, CAST(coalesce(n, 0) AS INTEGER) AS total_segments, coalesce(from_segment, 0) AS from_segment, coalesce(clause_ids, '') AS clause_ids FROM policies p LEFT JOIN parts USING (doc_id) LEFT JOIN totals USING (doc_id)""",
    "segment_context": f"{CORE}, {contexts()} SELECT doc_id, seg_no, context FROM contexts",
    "abbreviation_types": f"WITH {POLICIES}, {types('policies')} SELECT * FROM types",
    "learned_context": f"{CORE}, {types('policies')}, {learned_contexts()} SELECT s.doc_id, s.seg_no, coalesce(context, '') AS context FROM segments s LEFT JOIN contexts USING (doc_id, seg_no)",
    "segments_json": json_sql(),
    "text_requests": f"""WITH asked AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'd' || doc_id || '.txt' END AS file_name, CASE WHEN doc_id % 7 > 0 THEN text END AS t FROM documents)
      SELECT coalesce(file_name, 'inline.txt') AS file_name, CAST(CASE WHEN {BLANK} THEN 400 ELSE 200 END AS INTEGER) AS status, md5(coalesce(t, '')) AS text_md5 FROM (SELECT file_name, coalesce(t, '') AS t FROM asked)""",
    "document_envelope": f"""{CORE} SELECT p.doc_id, p.file_name, CAST(count(s.seg_no) AS INTEGER) AS total_segments, coalesce(string_agg(s.clause_id, ' ' ORDER BY s.seg_no), '') AS clause_ids
      FROM policies p LEFT JOIN segments s ON p.doc_id = s.doc_id GROUP BY p.doc_id, p.file_name""",
    "rejects": f"""WITH asked AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'inline.txt' ELSE 'f' || doc_id || CASE WHEN doc_id % 10 IN (0, 4) THEN '.PDF' WHEN doc_id % 10 IN (2, 6) THEN '.docx' ELSE '.pdf' END END AS file_name,
        coalesce(CASE WHEN doc_id % 10 IN (4, 5, 6) THEN ' ' || chr(10) || chr(9) || '  ' ELSE text END, '') AS t FROM documents),
      checked AS (SELECT doc_id, file_name, CASE WHEN doc_id % 2 = 1 THEN CASE WHEN {BLANK} THEN 400 END
        WHEN NOT suffix(lower(file_name), '.pdf') THEN 400 WHEN {BLANK} THEN 422 END AS status FROM asked)
      SELECT doc_id, file_name, CAST(status AS INTEGER) AS status FROM checked WHERE status IS NOT NULL""",
    "json_files": f"""SELECT 'policy ' || doc_id % 250 || CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY doc_id % 250) THEN '' ELSE '-' || left(sha256(CAST(doc_id AS VARCHAR)), 12) END || '.json' AS file_name, json
      FROM ({json_sql()})""",
    "file_checks": f"""WITH asked AS (SELECT doc_id, 'né+ ' || doc_id || CASE WHEN doc_id % 5 = 1 THEN '.docx' ELSE '.TXT' END AS file_name, CASE WHEN doc_id % 6 = 2 THEN ' ' || chr(10) || chr(9) || ' ' ELSE coalesce(text, '') END AS t FROM documents),
      checked AS (SELECT *, CASE WHEN doc_id % 5 = 1 THEN 400 WHEN doc_id % 7 IN (3, 5, 6) THEN 500 WHEN {BLANK} THEN 422 ELSE 200 END AS status FROM asked WHERE t <> '' OR doc_id % 7 IN (3, 5, 6))
      SELECT file_name, CAST(status AS INTEGER) AS status, CASE WHEN status = 200 THEN md5(t) END AS text_md5 FROM checked""",
    "split_lines": f"WITH {BINDERS}, {lines('binders')} SELECT doc_id AS file_name, line_no, kind, heading_id, md5(stripped) AS line_md5 FROM lines",
    "split_segments": f"""WITH {BINDERS}, {lines('binders')}, {SEGMENTS}, {PARENTS}
      SELECT doc_id AS file_name, seg_no, clause_id, level, title, parent_clause, md5(text) AS text_md5 FROM segments JOIN parents USING (doc_id, seg_no)""",
    "stream_requests": f"""{CORE}, {PARENTS}, asked AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 4 AND doc_id % 3 > 0 THEN file_name ELSE 'inline.txt' END AS file_name,
        CASE WHEN doc_id % 11 = 4 THEN 500 WHEN doc_id % 7 = 0 OR {BLANK.replace("(t,", "(text,")} THEN 400 ELSE 200 END AS status FROM policies)
      SELECT file_name, CAST(status AS INTEGER) AS status, seg_no, clause_id, parent_clause, md5(text) AS text_md5 FROM asked JOIN segments USING (doc_id) JOIN parents USING (doc_id, seg_no) WHERE status = 200
      UNION ALL SELECT file_name, CAST(status AS INTEGER), 0, NULL, NULL, NULL FROM asked WHERE status <> 200""",
    "segment_preview": f"{CORE} SELECT doc_id, seg_no, level, clause_id, left(title, 45) AS title FROM segments WHERE seg_no <= 5",
    "stream_segments": f"{CORE} SELECT doc_id, seg_no, clause_id, level, title, text FROM segments",
}
ORACLES["split_keywords"] = ORACLES["segment_keywords"]
