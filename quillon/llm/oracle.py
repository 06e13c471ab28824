"""DuckDB SQL that gives the rows of queries of this package."""

#: CRC-32 of a decimal number, bit by bit.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
    lambda c, b: list_reduce(
        list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS giver, {_CRC32} % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns)),
rebuilt AS (
  SELECT t.* FROM turns t JOIN ids USING (conv_id) WHERE n > h
  UNION ALL
  SELECT ids.conv_id, t.said, t.n FROM ids JOIN turns t ON t.conv_id = giver AND n <= h),
whole AS (
  SELECT ids.conv_id, coalesce(list(said ORDER BY n) FILTER (said IS NOT NULL), []) AS said
  FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ids.conv_id),
prefixes AS (
  SELECT conv_id, d, said[1:d] AS path, said[d].text AS last, len(said) = d AS ends
  FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(any_value(last)), 0) AS n_chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, path),
children AS (SELECT d - 1 AS d, path[1:d-1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (d, path)),
sums AS (
  SELECT a AS d, path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n_chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (d, path) LEFT JOIN nodes p ON p.d = c.d - 1 AND p.path = c.path[1:c.d-1]
"""
