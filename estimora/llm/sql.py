"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

#: Checksums of lists of bytes: a table made by its rule, and one step for each byte.
CRC_TABLE = """crc(tab) AS (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_of(octets: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])))"


EXACT_GROUPS = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
  w AS (SELECT *, row_number() OVER o AS k, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM d WINDOW o AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST))
  SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha AS text_sha256 FROM w"""

VARIANTS = f"""WITH RECURSIVE {CRC_TABLE},
  runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  each AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
  summed AS (SELECT run, k, {crc_of("flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))")} AS h FROM each, crc),
  made AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word, k FROM summed),
  words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
  cut AS (SELECT word, n, i, concat(left(word, CAST(i AS INT)), substr(word, CAST(i AS INT) + 2)) AS less FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
  pairs AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
  best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word),
  forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
  chain AS (SELECT word, word AS last FROM forms UNION SELECT chain.word, form FROM chain JOIN forms f ON chain.last = f.word WHERE form IS NOT NULL),
  roots AS (SELECT word, last AS root FROM chain WHERE last IN (SELECT word FROM forms WHERE form IS NULL))
  SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

TURN_TRIE = f"""WITH {CRC_TABLE},
  t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS turns FROM t GROUP BY conv_id),
  h AS (SELECT conv_id, turns, CAST({crc_of("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x))")} % 9 AS INT) AS h FROM own, crc),
  built AS (SELECT h.conv_id, list_concat(coalesce(list_slice(base.turns, 1, h), []), list_slice(h.turns, h + 1, len(h.turns))) AS turns FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % 5),
  member AS (SELECT conv_id, d, list_slice(turns, 1, CAST(d AS INT)) AS prefix, len(turns) = d AS ends, CASE WHEN d > 0 THEN strlen(turns[CAST(d AS INT)].text) ELSE 0 END AS size FROM built, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
  keyed AS (SELECT *, min(conv_id) OVER (PARTITION BY d, prefix) AS node FROM member),
  node AS (SELECT node, d, count(*) AS n, any_value(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM keyed GROUP BY node, d),
  up AS (SELECT c.node, c.d, p.node AS parent FROM (SELECT DISTINCT node, d FROM node) c LEFT JOIN keyed p ON p.conv_id = c.node AND p.d = c.d - 1),
  child AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
  below AS (SELECT a.node, a.d, sum((x.n - 1) * x.size) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
    FROM node x JOIN keyed a ON a.conv_id = x.node AND a.d <= x.d LEFT JOIN child c ON c.node = x.node AND c.d = x.d GROUP BY ALL)
  SELECT node.node AS conv_id, node.d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ended) AS ends_sha256
  FROM node JOIN up USING (node, d) LEFT JOIN child USING (node, d) JOIN below USING (node, d)"""
