"""SQL (DuckDB) for the queries that SQL can express."""

from candlewick.llm.secrets import BASE, MORE

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN low USING (h) WHERE least < doc_id),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w, [w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(coalesce(js, []), j)] AS k FROM d LEFT JOIN lists USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


def _hits() -> str:
    """A branch per rule: the engine wants constant patterns."""
    out = []
    for k, r in enumerate(BASE + MORE):
        p = "'" + r.pattern.replace("'", "''") + "'"
        out.append(f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, i, m[i] AS x, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a
    FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS m FROM d WHERE regexp_matches(t, {p})))
    WHERE length(regexp_extract(m[i], {p}, {r.group})) >= {r.least}""")
    return "\n  UNION ALL ".join(out)


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, k, kind, a, a + length(x) AS b FROM ({_hits()})),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {len(BASE)}), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""

def _jaccard(k: int, more: str = "") -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= {k} THEN range(1, len(w) - {k - 2}) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS overlap FROM g p JOIN g q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * overlap >= 80 * (na.n + nb.n - overlap)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id{more} FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


JACCARD = _jaccard(5)
FOREST = _jaccard(2, ", doc_id = c.component_id AS kept")

_NORMAL = r"array_to_string(regexp_extract_all(" + _LOWER.format("l") + r", '[^\x20\x09-\x0D]+'), ' ')"
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS w, coalesce(text, '') AS body FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
line AS (SELECT doc_id, host, body, l, {_NORMAL} AS nl FROM (SELECT doc_id, host, body, unnest(string_split(t, chr(10))) AS l FROM d)),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n_dup FROM line WHERE nl <> '' GROUP BY doc_id),
common AS (SELECT host, nl FROM (SELECT host, nl, count(DISTINCT body) AS n FROM line WHERE nl <> '' GROUP BY host, nl) JOIN (SELECT host, count(DISTINCT body) AS texts FROM d GROUP BY host) USING (host) WHERE n > 20 AND n > texts * 0.02::DOUBLE),
gone AS (SELECT doc_id, sum(len(string_split(nl, ' ')))::BIGINT AS n_gone FROM line JOIN common USING (host, nl) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_gone, 0)::BIGINT AS n_boilerplate_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_boilerplate_words >= 20 AND n_words - n_boilerplate_words >= n_words * 0.3::DOUBLE AS kept FROM f"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""
RUNS = f"""
WITH h AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS repeat, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS q FROM g),
t AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN repeat AND i >= a THEN a + (i - a) % q ELSE i END] AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM q)),
same AS (SELECT s.doc_id, s.i, t.i - s.i AS p FROM t AS s JOIN t ON t.doc_id = s.doc_id AND t.x = s.x AND t.i > s.i AND 4 * (t.i - s.i) <= s.n),
isle AS (SELECT doc_id, p, min(i) AS s, max(i) - min(i) + 1 + p AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS e FROM same) GROUP BY doc_id, p, e),
run AS MATERIALIZED (SELECT doc_id, s, len, min(p) AS p FROM isle WHERE len >= greatest(6, 4 * p) GROUP BY doc_id, s, len),
per AS (SELECT doc_id, count(*) AS n_runs, list(struct_pack(s, len, p) ORDER BY len DESC, s, p)[1] AS best, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM run),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT h.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.len // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256 FROM h LEFT JOIN per USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

COLLOCATIONS = f"""
WITH piece AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS MATERIALIZED (SELECT lang, k, s, count(*) AS f FROM gram GROUP BY lang, k, s HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
long_ AS (SELECT lang, unnest([split_part(s, ' ', 1) || ' ' || split_part(s, ' ', 2), split_part(s, ' ', 2) || ' ' || split_part(s, ' ', 3)]) AS s, f FROM f WHERE k = 3),
most AS (SELECT lang, s, max(f) AS m FROM long_ GROUP BY lang, s),
c AS (SELECT lang, k, s, f AS a FROM f LEFT JOIN most USING (lang, s) WHERE k = 3 OR k = 2 AND 100 * coalesce(m, 0) < 50 * f),
cut AS (SELECT lang, s, a, c, array_to_string(string_split(s, ' ')[:c], ' ') AS x, array_to_string(string_split(s, ' ')[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM c)),
scored AS (SELECT cut.lang, cut.s, a, c, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.s = cut.x JOIN f y ON y.lang = cut.lang AND y.s = cut.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s)::BIGINT AS rank, s AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000"""
