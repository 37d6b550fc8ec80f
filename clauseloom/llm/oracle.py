"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .chat import END, ESCAPE, START

#: Sizes, sources and targets; then each source's shuffled documents end to end, up to three times, as far as its target.
#: Every block up to the target has a slot, so what is taken doesn't depend on which slot that is.
MIX = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sources),
capped AS (SELECT *, CAST(src % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
open_level AS (SELECT arg_min(level, {'a': cap / weight, 'b': src}) AS level FROM levels WHERE cap > level * weight),
targets AS (SELECT source, source_size, CASE WHEN o.level IS NULL THEN cap ELSE least(cap, o.level * weight) END AS target FROM levels, open_level o),
placed AS (SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS line,
  CAST(sum(size) OVER (PARTITION BY docs.source ORDER BY md5('17:' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS place
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(place + size, line) - least(place, line))
  + greatest(0, least(source_size + place + size, line) - least(source_size + place, line))
  + greatest(0, least(2 * source_size + place + size, line) - least(2 * source_size + place, line)) AS BIGINT) AS taken FROM placed"""


def chats() -> str:
    said = "</s>[INST] ok [/INST]"
    escape = ESCAPE.replace("'", "''")
    around = len(START) + len(END) + 2
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}')),
sized AS (SELECT *, {around} + length(role) + length(regexp_replace(role, '[^\\\\\\n]', '', 'g')) + length(regexp_replace(text, '{escape}', '\\1\\\\\\2\\3', 'g')) AS n FROM turns),
joined AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt, CAST(sum(n) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM joined"""


#: All strings of 100 bytes, as digests of their hexadecimal digits; those that aren't the first of their kind are joined to runs.
REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
edges AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM again),
numbered AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
runs AS (SELECT doc_id, run, min(i) AS start, max(i) + 100 AS stop FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM runs),
kept AS (SELECT g.doc_id, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS last, string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) AS head
  FROM gaps g JOIN docs USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""



def crc32(byte_list: str) -> str:
    """Unsigned CRC-32 of a list of bytes, by the table of the reflected polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    step = f"xor(CAST({table} AS BIGINT[])[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({byte_list} AS BIGINT[])), lambda a, b: {step}), 4294967295)"


#: Prefixes by their turns' digests end to end; each node adds to the prefixes of its least member.
TRIE = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT *, left(sha256(length(role) || ':' || role || text), 32) AS tid, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, tid) AS k FROM said),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x))")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
path AS (SELECT c.conv_id, 0 AS own, k, tid, words FROM convs c JOIN numbered n ON n.conv_id = c.base AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, tid, words FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND k > h),
prefixes AS (SELECT conv_id, row_number() OVER w AS d, words, string_agg(tid, '') OVER w AS node FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM prefixes),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM ended GROUP BY node, d),
kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes n LEFT JOIN kids k ON n.node = k.node),
trees AS (SELECT p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM valued v JOIN prefixes p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY p.node)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
  FROM valued v JOIN trees t ON v.node = t.node LEFT JOIN nodes p ON v.d > 0 AND p.node = left(v.node, length(v.node) - 32)"""

#: The first bytes of a run are those of ``<doc_id>:``, in ASCII; letters from U+00C0 to U+00FF have two bytes.
UTF8 = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"
#: Words meet by what is left of them without one letter: at one place for a replaced letter, anywhere for an inserted one.
SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
by_doc AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT *, {crc32(UTF8)} AS h FROM by_doc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
near AS (SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
steps AS (SELECT word, word AS at FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.at WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.at AS root FROM steps s JOIN formed f ON f.word = s.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

ORACLES: dict[str, str] = {"op3_mix_sources": MIX, "op8_format_chats": chats(), "op9_suffix_dedup": REPEATS, "op11_prefix_trie": TRIE, "op12_spelling_groups": SPELLING}
