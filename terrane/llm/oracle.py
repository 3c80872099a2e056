"""SQL that gives the same rows as some of the queries."""

from __future__ import annotations

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT k, count(DISTINCT i + o) AS n FROM r, range(0, 3) AS t(o) GROUP BY k),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(c.n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_plain FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 50 AS b0, 100 * n_repeat_words > 50 * n_words AS b1, 10 * n_symbols > 2 * n_words AS b2, 100 * n_dup_lines > 35 * n_lines AS b3,
      word_chars < 2 * n_words AS b4, word_chars > 15 * n_words AS b5, 2 * n_plain > n_words AS b6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed, NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5 OR b6) AS kept,
       CAST(b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT + 32 * b5::INT + 64 * b6::INT AS BIGINT) AS failed_bits, 'standard-1' AS policy
FROM b
"""


# an escaped text is longer by one for each backslash and each control string
OP3 = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT '<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]' AS control),
e AS (SELECT t.*, 2 * length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, control)) AS role_chars,
      2 * length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, control)) AS text_chars FROM t, c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[INST] ') + role_chars + length(' [/INST]') + text_chars + length('</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# pairs of documents with a shingle in common, their links, and everything that can be reached over links
OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, ways.y FROM r JOIN ways ON r.y = ways.x),
found AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN found ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, coalesce('s' || CAST(source AS VARCHAR), 'n') AS site FROM documents),
i AS (SELECT k, site, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT *, trim(translate(own, chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS bare FROM i),
m AS (SELECT bare FROM b WHERE bare <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 5),
g AS (SELECT b.*, m.bare IS NOT NULL AS gone FROM b LEFT JOIN m USING (bare)),
c AS (SELECT k, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
      9 * coalesce(sum(length(bare)) FILTER (WHERE gone), 0) <= 8 * coalesce(sum(length(bare)), 0) AND count(*) FILTER (WHERE gone) > 0 AS cut,
      string_agg(own, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS rest FROM g GROUP BY 1),
f AS (SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN cut THEN n_gone ELSE 0 END AS n_removed_lines, CASE WHEN cut THEN rest ELSE text END AS t FROM d LEFT JOIN c USING (k))
SELECT doc_id, n_lines, n_removed_lines, CAST(strlen(t) AS BIGINT) AS n_bytes_left, sha256(t) AS text_sha256 FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_chat_formatting": OP3, "op8_minhash_neardup": OP8, "op10_line_dedup": OP10}
