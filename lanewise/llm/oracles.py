"""SQL of the operators whose whole result SQL can express; for DuckDB, on tables of a size that it can hold."""

#: Documents are linked by 80 % of their 2-word shingles; components by the reach of links.
NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS k FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (an + bn - k)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, t.b FROM reach r JOIN sides t ON r.b = t.a),
lowest AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(l.m, s.doc_id)) AS kept
FROM sets s LEFT JOIN lowest l ON s.doc_id = l.doc_id
"""

#: Bytes covered by a string of 400 bytes that also starts elsewhere; texts are worked on as hexadecimal digits.
REPEATS = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(length(h) // 2 - 399)) AS i FROM texts WHERE length(h) >= 800)),
often AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
starts AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM windows JOIN often USING (m)),
runs AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM starts),
spans AS (SELECT r, run, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY r, run),
gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM spans),
gone AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS front FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM texts LEFT JOIN gone USING (r)
"""

#: Words after the edit that one document in ten gets; bit by bit, as there is no function for this checksum.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: 6-grams that stand again q words later, in neighbouring places, make a stretch of period q.
RUNS = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_CRC32} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM texts),
edited AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) END AS w FROM cut),
grams AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + 6], ' ')) AS m FROM (SELECT r, w, unnest(range(len(w) - 5)) AS i FROM edited WHERE len(w) >= 12)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.m = b.m AND a.i < b.i),
marked AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, count(*) + 5 + q AS n FROM marked GROUP BY r, q, island),
runs AS (SELECT r, s, n, min(q) AS q FROM stretches WHERE n >= 12 AND n >= 2 * q GROUP BY r, s, n),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM edited) ANTI JOIN gone USING (r, i) GROUP BY r),
found AS (SELECT r, count(*) AS n_runs, max([n, -s, -q]) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, -best[2] AS start, best[1] AS length, -best[3] AS period, 1000 * best[1] // -best[3] AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM edited LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""

#: Windows of 13 words whose least doc_id is smaller than their own.
PASSAGES = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1 : i + 13], ' ')) AS m FROM (SELECT r, doc_id, w, unnest(range(len(w) - 12)) AS i FROM texts WHERE len(w) >= 13)),
firsts AS (SELECT m, min(doc_id) AS lo FROM windows GROUP BY m),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (m) WHERE doc_id > lo),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM texts LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""


def _codes(rounds: int) -> str:
    """Distances by their definition; the least of distance * 256 + entry is the first of the nearest entries."""
    nearest = lambda k: f"SELECT r, p, v, min((SELECT list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT * 256 + e) AS m FROM parts JOIN books{k} USING (p) GROUP BY r, p, v"
    steps = ""
    for k in range(rounds):
        steps += f"""near{k} AS ({nearest(k)}),
sums{k} AS (SELECT p, m % 256 AS e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, m, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{k}) GROUP BY ALL),
means{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
books{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN means{k} m USING (p, e)),
"""
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] AS v FROM kept, (SELECT unnest(range(4)) AS p)),
books0 AS (SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 256),
{steps}last AS ({nearest(rounds)}),
coded AS (SELECT r, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM last GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), digest
"""


CODES = _codes(4)
