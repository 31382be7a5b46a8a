"""DuckDB SQL of operators that work on words and sentences, by plain all-pairs rules."""

from __future__ import annotations

from .substring_dedup import LONG, SENTENCES, WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({text}, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(len(ws) - 2), lambda i: array_to_string(ws[i + 1 : i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: The pattern of sentences as DuckDB's engine writes it.
_SENTENCE = r"""[^\n]*?[.!?…。！？]["'')\]»”]*(?:[^\S\n]+|\n+|\z)|[^\n]+(?:\n+|\z)|\n+"""

SUBSTRINGS = f"""
WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '{_SENTENCE}') AS parts FROM documents),
t AS (SELECT doc_id, i AS place, {_words("parts[i + 1]")} AS ws FROM a, unnest(range(len(parts))) AS u(i)),
o AS (
  SELECT *, row_number() OVER w - 1 AS k, sum(len(ws)) OVER w AS upto, count(*) OVER (PARTITION BY doc_id) AS m FROM t WHERE len(ws) > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
f AS (
  SELECT x.doc_id, x.k AS a, greatest(min(y.k), x.k + {SENTENCES - 1}) AS b FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.upto - x.upto + len(x.ws) >= {WORDS} GROUP BY x.doc_id, x.k, x.m
  HAVING greatest(min(y.k), x.k + {SENTENCES - 1}) < x.m
  UNION
  SELECT x.doc_id, least(max(y.k), x.k - {SENTENCES - 1}) AS a, x.k AS b FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.k <= x.k AND x.upto - y.upto + len(y.ws) >= {WORDS} GROUP BY x.doc_id, x.k
  HAVING least(max(y.k), x.k - {SENTENCES - 1}) >= 0
  UNION
  SELECT doc_id, k, k FROM o WHERE len(ws) >= {LONG}),
g AS (
  SELECT f.doc_id, f.a, f.b, min(o.place) AS first, max(o.place) AS last, string_agg(array_to_string(o.ws, ' '), ' ' ORDER BY o.k) AS run
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.k BETWEEN f.a AND f.b GROUP BY 1, 2, 3),
v AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS seen FROM g),
gone AS (SELECT DISTINCT doc_id, i AS place FROM v, unnest(range(first, last + 1)) AS u(i) WHERE seen > 1),
c AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY 1)
SELECT a.doc_id, CASE WHEN places IS NULL THEN text ELSE
    rtrim(coalesce(array_to_string(list_transform(list_filter(range(len(parts)), lambda i: NOT list_contains(places, i)), lambda i: parts[i + 1]), ''), ''), ' ' || chr(9) || chr(10) || chr(13)) END AS text,
  coalesce(len(places), 0)::INT AS n_removed FROM a LEFT JOIN c USING (doc_id)
"""

#: The crc32 of a text's UTF-8 bytes, with the table of its bytes' checksums as column crc of table crcs.
_CRCS = "crcs AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"


def _crc32(text: str) -> str:
    digit = "(strpos('0123456789ABCDEF', hex({0})[2 * i + {1}]) - 1)"
    octets = f"list_transform(range(strlen({text})), lambda i: {digit.format(text, 1)} * 16 + {digit.format(text, 2)})"
    return f"xor(list_reduce({octets}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


def _features(table: str, key: str) -> str:
    return f"""SELECT {key}, unnest(list_concat(ws, list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2]))) AS f
    FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {table})"""


RESAMPLE = f"""
WITH {_CRCS},
f AS MATERIALIZED ({_features("documents", "doc_id")}),
g AS MATERIALIZED ({_features("benchmark", "item_id")}),
h AS MATERIALIZED (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM f UNION SELECT f FROM g), crcs),
s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM g JOIN h USING (f) GROUP BY 1),
n AS (SELECT (SELECT sum(s) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS gain
  FROM s FULL JOIN t USING (bucket), n),
d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM f JOIN h USING (f) JOIN gains USING (bucket) GROUP BY 1),
e AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1 : 8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score,
    coalesce(n_features, 0) >= 39 AS rich
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY rich ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY rich) AS many FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN rich AND place <= 25 * many // 100 THEN place END AS rank FROM r
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

SPELLING = f"""
WITH RECURSIVE {_CRCS},
o AS (
  SELECT r, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM (
    SELECT r, list_transform(range(strlen(x)), lambda i: (strpos('0123456789ABCDEF', hex(x)[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(x)[2 * i + 2]) - 1) AS bytes
    FROM (SELECT r, coalesce(doc_id::VARCHAR, '') || ':' || r AS x
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents))), crcs),
w AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word FROM o)
  WHERE length(word) >= 5 GROUP BY 1 HAVING count(*) >= 3),
d AS MATERIALIZED (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM w, unnest(range(length(word))) AS u(i)),
p AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
b AS (SELECT word, count(*) AS n_near, max(n) AS best FROM p GROUP BY 1),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * w.n THEN best END AS form_n,
    (SELECT min(near) FROM p WHERE p.word = w.word AND p.n = best AND best >= 2 * w.n) AS form
  FROM w LEFT JOIN b USING (word)),
r(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e ON e.word = f.word
"""
