"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP6 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), spans AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS seq FROM spans
), firsts AS (
  SELECT seq, min(doc_id) AS first_doc FROM windows GROUP BY seq
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (seq) WHERE first_doc < doc_id
), positions AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept, count(*) AS n_kept
  FROM positions ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""


# crc32 has no DuckDB function: a table of 256 remainders by its rule, then one step a byte. Letters of the pattern are
# below U+0100, so a code point is one byte, or 0xC3 and the code point less 64.
OP11 = r"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT x, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(d || ':' || x, ''),
           lambda c : CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)),
           lambda s, b : xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
  FROM runs, remainders WHERE length(x) >= 7
), counted AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(x, 1, (h % length(x))::INT) || substr(x, (h % length(x))::INT + 2) ELSE x END AS word, count(*) AS n
  FROM hashed GROUP BY 1
), words AS (
  SELECT word, n FROM counted WHERE length(word) >= 7 AND n >= 2
), cuts AS (
  SELECT word, n, p, substr(word, 1, p::INT) || substr(word, p::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT forms.word, roots.root FROM roots JOIN forms ON forms.form = roots.word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

OP13 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex
  FROM documents
), hashes AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
         ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
  FROM units
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashes
), pieces AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM pieces
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_sketch": OP6, "op11_spelling_groups": OP11, "op13_seekable_fim": OP13}
