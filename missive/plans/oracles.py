"""DuckDB statements that check the Spark queries, built from shared CTE text.

Written independently of the operators: windows, lateral joins, recursive CTEs and full pair
comparison where the operators use cells, prefixes and iterations.
"""

from __future__ import annotations

BRIDGE = """
base AS (
  SELECT o_orderkey AS k, o_custkey AS cust, CAST(FLOOR(o_custkey / 60) AS BIGINT) AS package_id,
         CAST(o_orderdate AS DATE) AS od, o_orderpriority AS prio, c_mktsegment AS seg
  FROM orders JOIN customer ON c_custkey = o_custkey),
letters AS (
  SELECT k AS letter_id, cust, package_id, od,
    ROW_NUMBER() OVER (PARTITION BY package_id ORDER BY k) AS serial,
    CASE WHEN k % 3 = 0 THEN 'CTR' WHEN k % 3 = 1 THEN 'AE' ELSE 'PD' END AS from_code,
    CASE WHEN k % 3 <> 0 THEN 'CTR' WHEN k % 2 = 0 THEN 'AE' ELSE 'PD' END AS to_code,
    CASE WHEN k % 3 = 0 THEN 'outward' ELSE 'inward' END AS direction,
    CASE WHEN k % 97 = 0 THEN NULL ELSE od END AS dated,
    CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(od + INTERVAL 3 DAY AS DATE) END AS received,
    CONCAT(CASE WHEN k % 3 = 0 THEN 'CTR' WHEN k % 3 = 1 THEN 'AE' ELSE 'PD' END, '/PKG',
           CAST(package_id AS VARCHAR(9)), '/', CAST(YEAR(od) AS VARCHAR(9)), '/',
           LPAD(CAST(k AS VARCHAR(20)), 7, '0')) AS letter_ref,
    CONCAT(prio, ' ', LOWER(seg), ': shifting of box culvert') AS subject,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'km 12.4'
         ELSE CONCAT('Km ', CAST(k % 90 AS VARCHAR(9)), '+', LPAD(CAST((k * 37) % 1000 AS VARCHAR(9)), 3, '0')) END AS chainage,
    CASE WHEN k % 4 = 0 THEN 'Cl. 10.3.2' WHEN k % 4 = 1 THEN 'Cl. 17.3' ELSE NULL END AS clause,
    CASE WHEN k % 11 = 3 THEN 'needs_review' WHEN k % 11 = 4 THEN 'verified' ELSE 'unverified' END AS review_status,
    CONCAT('DOC', CAST(k - k % 3 AS VARCHAR(20))) AS document_id, k % 3 + 1 AS page_from, k % 3 + 1 + k % 2 AS page_to,
    k % 53 <> 0 AS is_current, k % 59 = 0 AS is_voided
  FROM base),
cited AS (
  SELECT letter_id, package_id, 0 AS field_index,
    CASE WHEN letter_id % 10 <= 4 THEN t
         WHEN letter_id % 10 = 5 THEN REPLACE(t, '/', '-')
         WHEN letter_id % 10 = 6 THEN CONCAT('No. ', LOWER(t))
         WHEN letter_id % 10 = 7 THEN REPLACE(t, 'PKG', 'PK6')
         WHEN letter_id % 10 = 8 THEN CONCAT('ZZ/NOTHELD/', LPAD(CAST(letter_id AS VARCHAR(20)), 7, '9'))
         ELSE CONCAT(SUBSTR(t, 1, LENGTH(t) - 2), '99') END AS cited_text
  FROM (SELECT letter_id, package_id, LAG(letter_ref) OVER (PARTITION BY cust ORDER BY od, letter_id) AS t FROM letters) x
  WHERE t IS NOT NULL AND letter_id % 11 <> 0)"""


def _bare(x: str) -> str:
    return f"regexp_replace(regexp_replace(upper({x}), '^NO[.\\s]+', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _serial(x: str) -> str:
    """Last digit run of two or more digits, '' when there is none."""
    return f"regexp_extract({x}, '(?:^|\\D)(\\d{{2,}})\\D*$', 1)"


def _body(x: str) -> str:
    return _bare(f"regexp_replace({x}, '\\d{{2,}}(\\D*)$', '\\1')")


def _grams(x: str) -> str:
    words = f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return (
        f"list_distinct(flatten(list_transform({words}, lambda w: "
        "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


# aliases are filled by the query that needs them
NO_ALIASES = """
aliases AS (SELECT CAST(NULL AS BIGINT) AS package_id, '' AS ref, CAST(NULL AS BIGINT) AS letter_id WHERE false)"""

LINKS = f"""
pool AS (
  SELECT package_id, letter_id, serial, upper(letter_ref) AS ref, {_bare('letter_ref')} AS bare
  FROM letters WHERE is_current AND NOT is_voided),
mention AS (
  SELECT c.package_id, c.letter_id AS citing, c.field_index, c.cited_text,
         upper(trim(regexp_replace(c.cited_text, '\\s+', ' ', 'g'))) AS ref
  FROM cited c JOIN letters l USING (letter_id)
  WHERE EXISTS (SELECT 1 FROM letters v WHERE v.document_id = l.document_id
                AND v.package_id = l.package_id AND v.is_current AND NOT v.is_voided)),
cites AS (
  SELECT package_id, citing, ref, arg_min(cited_text, field_index) AS cited_text
  FROM mention GROUP BY package_id, citing, ref),
e1 AS (
  SELECT c.citing, c.ref, count(*) AS n, min(p.letter_id) AS target FROM cites c
  JOIN pool p ON p.package_id = c.package_id AND p.ref = c.ref AND p.letter_id <> c.citing GROUP BY ALL),
e2 AS (
  SELECT c.citing, c.ref, min(p.letter_id) AS target FROM cites c
  JOIN pool p ON p.package_id = c.package_id AND p.bare = {_bare('c.ref')} AND p.bare <> '' AND p.letter_id <> c.citing
  WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.citing = c.citing AND e1.ref = c.ref)
  GROUP BY c.citing, c.ref HAVING count(*) = 1),
e3 AS (
  SELECT c.citing, c.ref, a.letter_id AS target FROM cites c
  JOIN aliases a ON a.package_id = c.package_id AND a.ref = c.ref AND a.letter_id <> c.citing
  JOIN pool p ON p.letter_id = a.letter_id
  WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.citing = c.citing AND e1.ref = c.ref)
    AND NOT EXISTS (SELECT 1 FROM e2 WHERE e2.citing = c.citing AND e2.ref = c.ref)),
rest AS (
  SELECT c.* FROM cites c LEFT JOIN e1 USING (citing, ref) LEFT JOIN e2 USING (citing, ref) LEFT JOIN e3 USING (citing, ref)
  WHERE e1.n IS NULL AND e2.target IS NULL AND e3.target IS NULL),
query_gram AS (
  SELECT package_id, ref, len(g) AS n, unnest(g) AS gram
  FROM (SELECT package_id, ref, {_grams('ref')} AS g FROM (SELECT DISTINCT package_id, ref FROM rest))),
pool_gram AS (
  SELECT package_id, letter_id, serial, ref, len(g) AS n, unnest(g) AS gram
  FROM (SELECT *, {_grams('ref')} AS g FROM pool)),
scored AS (
  SELECT q.package_id, q.ref, p.letter_id, p.serial, p.ref AS held_ref,
         count(*) / (any_value(q.n) + any_value(p.n) - count(*))::DOUBLE AS score
  FROM query_gram q JOIN pool_gram p ON p.package_id = q.package_id AND p.gram = q.gram
  GROUP BY q.package_id, q.ref, p.letter_id, p.serial, p.ref
  HAVING count(*) * 2 >= any_value(q.n) + any_value(p.n) - count(*)),
fuzzy AS (
  SELECT package_id, citing, ref, letter_id, held_ref, score, same_serial, place FROM (
    SELECT r.package_id, r.citing, r.ref, s.letter_id, s.held_ref, s.score,
           {_serial('r.ref')} <> '' AND {_serial('r.ref')} = {_serial('s.held_ref')} AS same_serial,
           row_number() OVER (PARTITION BY r.citing, r.ref ORDER BY round(s.score, 6) DESC,
             CASE WHEN {_serial('r.ref')} <> '' AND {_serial('r.ref')} = {_serial('s.held_ref')} THEN 0 ELSE 1 END,
             s.serial) AS place
    FROM rest r JOIN scored s ON s.package_id = r.package_id AND s.ref = r.ref AND s.letter_id <> r.citing)
  WHERE place <= 3),
body_pair AS (
  SELECT citing, ref, letter_id, {_body('ref')} AS a, {_body('held_ref')} AS b FROM fuzzy
  WHERE same_serial AND {_body('ref')} <> '' AND {_body('held_ref')} <> ''),
segment AS (
  SELECT citing, ref, letter_id, a, b, 0 AS depth,
    list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2),
      lambda n: CASE WHEN contains(b, substr(a, i, n)) THEN n * 1000 - i ELSE 0 END)))) AS best
  FROM body_pair
  UNION ALL
  SELECT citing, ref, letter_id, side.a, side.b, depth + 1,
    list_max(flatten(list_transform(range(1, length(side.a) + 1), lambda i: list_transform(range(1, length(side.a) - i + 2),
      lambda n: CASE WHEN contains(side.b, substr(side.a, i, n)) THEN n * 1000 - i ELSE 0 END))))
  FROM (
    SELECT citing, ref, letter_id, depth, unnest([
        {{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}},
        {{'a': substr(a, i + n), 'b': substr(b, j + n)}}]) AS side
    FROM (SELECT *, strpos(b, substr(a, i, n)) AS j
          FROM (SELECT *, CAST(ceil(best / 1000.0) AS INT) AS n,
                       CAST(ceil(best / 1000.0) * 1000 - best AS INT) AS i FROM segment WHERE best > 0)))
  WHERE side.a <> '' AND side.b <> ''),
ratio AS (
  SELECT p.citing, p.ref, p.letter_id,
         2.0 * sum(CAST(ceil(greatest(best, 0) / 1000.0) AS INT)) / (length(any_value(p.a)) + length(any_value(p.b))) AS body_ratio
  FROM body_pair p JOIN segment s ON s.citing = p.citing AND s.ref = p.ref AND s.letter_id = p.letter_id
  GROUP BY p.citing, p.ref, p.letter_id),
e5 AS (
  SELECT citing, ref, min(letter_id) AS target FROM ratio WHERE body_ratio >= 0.6
  GROUP BY citing, ref HAVING count(*) = 1),
links AS (
  SELECT c.package_id, c.citing AS citing_letter_id, c.ref AS cited_ref_normalized, c.cited_text AS cited_ref_text,
    CASE WHEN e1.n = 1 THEN e1.target WHEN e1.n > 1 THEN NULL ELSE coalesce(e2.target, e3.target, e5.target) END AS cited_letter_id,
    CASE WHEN e1.n = 1 THEN 'resolved' WHEN e1.n > 1 THEN 'unresolved_ambiguous'
         WHEN coalesce(e2.target, e3.target, e5.target) IS NOT NULL THEN 'resolved'
         WHEN f.citing IS NOT NULL THEN 'unresolved_ambiguous' ELSE 'unresolved_missing' END AS resolution,
    CASE WHEN e3.target IS NOT NULL THEN 'alias' ELSE 'pipeline' END AS resolution_source,
    CASE WHEN e1.n = 1 THEN 'exact' WHEN e1.n > 1 THEN 'exact_many' WHEN e2.target IS NOT NULL THEN 'punctuation'
         WHEN e3.target IS NOT NULL THEN 'alias' WHEN e5.target IS NOT NULL THEN 'serial_anchored' END AS rule
  FROM cites c LEFT JOIN e1 USING (citing, ref) LEFT JOIN e2 USING (citing, ref) LEFT JOIN e3 USING (citing, ref)
  LEFT JOIN e5 USING (citing, ref) LEFT JOIN (SELECT DISTINCT citing, ref FROM fuzzy) f USING (citing, ref)),
candidates AS (
  SELECT c.package_id, c.citing AS citing_letter_id, c.ref AS cited_ref_normalized, p.letter_id AS candidate_letter_id,
         'exact_ref' AS match_method, CAST(NULL AS DOUBLE) AS match_score
  FROM cites c JOIN e1 ON e1.citing = c.citing AND e1.ref = c.ref AND e1.n > 1
  JOIN pool p ON p.package_id = c.package_id AND p.ref = c.ref AND p.letter_id <> c.citing
  UNION ALL
  SELECT package_id, citing, ref, letter_id, 'trgm_fuzzy', score FROM fuzzy)"""

GREAT_PACKAGE = """
great_letters AS (
  SELECT * REPLACE (CASE WHEN cust % 3 = 0 THEN 0 ELSE package_id END AS package_id, letter_id AS serial) FROM letters),
great_cited AS (
  SELECT c.* REPLACE (l.package_id AS package_id) FROM cited c JOIN great_letters l USING (letter_id))"""

GREAT_LINKS = (
    LINKS.replace("FROM letters", "FROM great_letters").replace("JOIN letters", "JOIN great_letters").replace("FROM cited", "FROM great_cited")
)

THREADS = """
live AS (SELECT * FROM letters WHERE is_current AND NOT is_voided),
edge AS (
  SELECT citing_letter_id AS a, cited_letter_id AS b FROM links
  WHERE resolution = 'resolved' AND citing_letter_id IN (SELECT letter_id FROM live)
    AND cited_letter_id IN (SELECT letter_id FROM live)),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (
  SELECT letter_id AS x, letter_id AS y FROM live
  UNION
  SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.y),
component AS (SELECT x AS letter_id, min(y) AS component FROM reach GROUP BY x),
placed AS (
  SELECT l.*, c.component,
         row_number() OVER (PARTITION BY c.component ORDER BY l.dated NULLS LAST, l.serial) AS place
  FROM live l JOIN component c USING (letter_id)),
thread AS (
  SELECT package_id, component, max(CASE WHEN place = 1 THEN upper(letter_ref) END) AS thread_key,
         max(CASE WHEN place = 1 THEN subject END) AS subject,
         min(dated) AS first_dated, max(dated) AS last_dated, count(*) AS letter_count
  FROM placed GROUP BY package_id, component),
pointed AS (SELECT p.*, t.thread_key FROM placed p JOIN thread t USING (package_id, component))"""

ONLY_BRIDGE = f"WITH {BRIDGE}"
WITH_LINKS = f"WITH RECURSIVE {BRIDGE}, {NO_ALIASES}, {LINKS}"
WITH_THREADS = f"{WITH_LINKS}, {THREADS}"


def _party_text(code: str) -> str:
    return f"CASE {code} WHEN 'CTR' THEN 'M/s Contractor' WHEN 'AE' THEN 'Authority Engineer' ELSE 'Project Director' END"


FIELDS = f"""
field_list AS (
  SELECT l.package_id, l.letter_id, l.document_id, l.page_from, unnest([
    {{'pos': 0, 'k': 'letter_ref', 'v': l.letter_ref}}, {{'pos': 1, 'k': 'dated', 'v': CAST(l.dated AS VARCHAR)}},
    {{'pos': 2, 'k': 'received', 'v': CAST(l.received AS VARCHAR)}},
    {{'pos': 3, 'k': 'from_party', 'v': {_party_text('l.from_code')}}},
    {{'pos': 4, 'k': 'to_party', 'v': {_party_text('l.to_code')}}}, {{'pos': 5, 'k': 'subject', 'v': l.subject}},
    {{'pos': 6, 'k': 'chainage', 'v': l.chainage}}, {{'pos': 7, 'k': 'clause', 'v': l.clause}},
    {{'pos': 8, 'k': 'cited_ref', 'v': c.cited_text}}]) AS f
  FROM letters l LEFT JOIN cited c USING (letter_id)),
fields AS (
  SELECT letter_id * 100 + f.pos AS field_id, package_id, letter_id, document_id, f.k AS field_key, 0 AS field_index,
    f.v AS value, f.v AS verbatim,
    CASE WHEN (letter_id * 7 + f.pos) % 23 = 0 THEN NULL ELSE page_from END AS page_no,
    CASE WHEN (letter_id * 7 + f.pos) % 23 = 0 THEN 'unresolved' WHEN (letter_id + f.pos) % 5 = 0 THEN 'normalized_exact'
         ELSE 'exact' END AS validation,
    CASE WHEN (letter_id + f.pos * 3) % 19 = 0 THEN 'verified' ELSE 'unreviewed' END AS review_status,
    (letter_id + f.pos) % 31 <> 0 AS is_current
  FROM field_list WHERE f.v IS NOT NULL)"""

FILES = """
requests AS (
  SELECT l_orderkey * 10 + l_linenumber AS run_id, l_orderkey AS letter_id, l_linenumber AS attempt,
         CAST(l_shipdate AS DATE) AS started_at, CAST(l_quantity AS BIGINT) AS input_tokens, l_suppkey AS output_tokens
  FROM lineitem),
runs AS (
  SELECT run_id, any_value(l.package_id) AS package_id, any_value(l.document_id) AS document_id,
    'v' || (attempt % 3 + 1) AS pipeline_version,
    CASE WHEN (r.letter_id + attempt) % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN (r.letter_id + attempt) % 4 = 0 THEN 'no answer' END AS error,
    min(started_at) AS started_at,
    CASE WHEN run_id % 41 <> 0 THEN min(started_at) + 1 END AS finished_at,
    CAST(sum(input_tokens) AS BIGINT) + CASE WHEN r.letter_id % 13 = 0 THEN 1 ELSE 0 END AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens
  FROM requests r JOIN letters l ON l.letter_id = r.letter_id GROUP BY run_id, r.letter_id, attempt),
published AS (
  SELECT * EXCLUDE (status, newest), status = 'succeeded' AND run_id = newest AS is_current,
    CASE WHEN status = 'succeeded' AND run_id <> newest THEN newest END AS superseded_by,
    CASE WHEN status = 'succeeded' AND run_id <> newest THEN 'superseded' ELSE status END AS status
  FROM (SELECT *, first_value(CASE WHEN status = 'succeeded' THEN run_id END) OVER (
          PARTITION BY package_id, document_id ORDER BY status = 'succeeded' DESC, started_at DESC, run_id DESC) AS newest
        FROM runs)),
filings AS (SELECT DISTINCT package_id, document_id FROM letters),
documents_held AS (
  SELECT document_id, document_id || '.pdf' AS original_filename, n * 7 + 100 AS byte_size,
         DATE '2024-01-01' + CAST(n % 365 AS INT) AS ingested_at
  FROM (SELECT DISTINCT document_id, CAST(substr(document_id, 4) AS BIGINT) AS n FROM letters)),
document_pages AS (
  SELECT document_id, page_no, pipeline_version,
    'derived/' || pipeline_version || '/' || sha256(document_id) || '/page-' || lpad(CAST(page_no AS VARCHAR), 3, '0') || '.png' AS raster_uri
  FROM (SELECT document_id, unnest(range(1, max(page_to) + 1)) AS page_no FROM letters GROUP BY document_id)
  JOIN (VALUES ('v1'), ('v2')) v(pipeline_version)
    ON pipeline_version = 'v1' OR CAST(substr(document_id, 4) AS BIGINT) % 2 = 0),
packages AS (
  SELECT DISTINCT package_id, 'Highway PKG-' || package_id AS name, 'C/PKG' || package_id || '/1995' AS contract_no,
    package_id % 10 AS owner_user_id,
    CASE WHEN package_id % 2 = 0 THEN '^(CTR|AE|PD)/PKG[0-9]+/[0-9]{4}/[0-9]+$' END AS ref_pattern,
    DATE '1995-06-01' AS starts_on, DATE '2001-01-31' AS ends_on
  FROM letters)"""

WORDS = """
line AS (
  SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line_text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
word AS (
  SELECT document_id, line_no, line_no // 20 + 1 AS page_no, unnest(string_split(line_text, ' ')) AS w,
         generate_subscripts(string_split(line_text, ' '), 1) - 1 AS word_no FROM line),
token AS (
  SELECT *, line_no * 100000 + word_no AS i,
    lag(line_no) OVER (PARTITION BY document_id, page_no ORDER BY line_no, word_no) AS line_before
  FROM word WHERE trim(w, chr(9) || chr(13) || ' ') <> ''),
spaced AS (
  SELECT *, CASE WHEN line_before IS NULL THEN '' WHEN line_before = line_no THEN ' ' ELSE chr(10) END AS sep FROM token),
placed_token AS (
  SELECT *, sum(length(sep) + length(w)) OVER (PARTITION BY document_id, page_no ORDER BY i) AS char_end FROM spaced),
page AS (
  SELECT document_id, page_no, string_agg(sep || w, '' ORDER BY i) AS text, count(*) AS n_tokens FROM spaced
  GROUP BY document_id, page_no)"""

WITH_FIELDS = f"WITH {BRIDGE}, {FIELDS}"
WITH_FILES = f"WITH {BRIDGE}, {FILES}"
WITH_WORDS = f"WITH {WORDS}"
THREADS_AND_FIELDS = f"{WITH_THREADS}, {FIELDS}"
THREADS_AND_FILES = f"{WITH_THREADS}, {FILES}"
LINKS_AND_FIELDS = f"{WITH_LINKS}, {FIELDS}"

ARRIVALS = """
arrivals AS (SELECT doc_id % 7 AS package_id, sha256(text) AS sha256, doc_id AS arrival FROM documents),
stored AS (SELECT * FROM arrivals WHERE arrival % 10 = 0),
done AS (SELECT DISTINCT package_id, sha256 FROM arrivals WHERE arrival % 20 = 0),
classified AS (
  SELECT a.*, CASE
    WHEN EXISTS (SELECT 1 FROM done x WHERE x.package_id = a.package_id AND x.sha256 = a.sha256)
      OR row_number() OVER (PARTITION BY package_id, sha256 ORDER BY arrival) > 1 THEN 'duplicate'
    WHEN EXISTS (SELECT 1 FROM stored s WHERE s.package_id = a.package_id AND s.sha256 = a.sha256) THEN 'reprocess'
    WHEN EXISTS (SELECT 1 FROM stored s WHERE s.sha256 = a.sha256)
      OR row_number() OVER (PARTITION BY sha256 ORDER BY arrival) > 1 THEN 'linked'
    ELSE 'new' END AS outcome
  FROM arrivals a)"""

CANDIDATES = f"""
raw_candidate AS (
  SELECT package_id, document_id, letter_id AS candidate, page_from, page_to,
    CASE WHEN letter_id % 41 = 0 THEN NULL WHEN letter_id % 37 = 0 THEN 'REPEAT/' || (letter_id // 370) ELSE letter_ref END AS letter_ref,
    CASE WHEN letter_id % 41 <> 0 THEN dated END AS dated,
    CASE WHEN letter_id % 41 <> 0 THEN from_code END AS from_code,
    CASE WHEN letter_id % 41 <> 0 THEN to_code END AS to_code
  FROM letters),
candidate AS (
  SELECT *, upper(letter_ref) AS ref,
    row_number() OVER (PARTITION BY package_id ORDER BY dated NULLS FIRST, upper(letter_ref) COLLATE C NULLS FIRST,
                       document_id COLLATE C, page_from, candidate) AS place
  FROM raw_candidate WHERE letter_ref IS NOT NULL),
held AS (
  SELECT package_id, upper(letter_ref) AS ref, min(letter_id) AS existing FROM letters
  WHERE letter_id % 13 = 0 AND is_current GROUP BY ALL),
judged AS (
  SELECT c.*, h.existing,
    row_number() OVER (PARTITION BY c.package_id, c.ref ORDER BY c.place) AS copy,
    first_value(c.document_id) OVER (PARTITION BY c.package_id, c.ref ORDER BY c.place) AS first_document
  FROM candidate c LEFT JOIN held h ON h.package_id = c.package_id AND h.ref = c.ref)""".replace(" COLLATE C", "")

RERUN = """
old AS (
  SELECT letter_id // 300 AS package_id, document_id, letter_id, serial,
    CASE WHEN letter_id % 6 = 0 THEN 'SHARED/' || document_id ELSE letter_ref END AS ref, page_from, page_to
  FROM letters WHERE is_current),
fresh AS (
  SELECT o.package_id, o.document_id, o.letter_id AS candidate,
    CASE WHEN o.letter_id % 4 = 1 THEN l.letter_ref2 || 'X' WHEN o.letter_id % 8 = 2 THEN NULL
         WHEN o.letter_id % 8 = 7 THEN 'SHARED/' || o.document_id ELSE o.ref END AS ref,
    o.page_from + CASE WHEN o.letter_id % 5 = 0 THEN 20 ELSE 0 END AS page_from,
    o.page_to + CASE WHEN o.letter_id % 5 = 0 THEN 20 ELSE 0 END AS page_to
  FROM old o JOIN (SELECT letter_id, letter_ref AS letter_ref2 FROM letters) l USING (letter_id)),
by_ref AS (
  SELECT f.candidate, count(*) AS n, min(o.letter_id) AS id, list_sort(list(o.serial)) AS serials
  FROM fresh f JOIN old o ON o.package_id = f.package_id AND o.document_id = f.document_id AND o.ref = f.ref GROUP BY 1),
by_page AS (
  SELECT f.candidate, count(*) AS n, min(o.letter_id) AS id, list_sort(list(o.serial)) AS serials
  FROM fresh f JOIN old o ON o.package_id = f.package_id AND o.document_id = f.document_id
    AND greatest(f.page_from, o.page_from) <= least(f.page_to, o.page_to) GROUP BY 1),
first_pass AS (
  SELECT f.*, CASE WHEN r.n = 1 THEN r.id WHEN r.n IS NULL AND p.n = 1 THEN p.id END AS id,
    CASE WHEN r.n = 1 THEN 'supersede' WHEN r.n > 1 THEN 'flag_ambiguous' WHEN p.n = 1 THEN 'supersede'
         WHEN p.n > 1 THEN 'flag_ambiguous' ELSE 'new' END AS act,
    CASE WHEN r.n = 1 THEN 'same reference in the same document'
         WHEN r.n > 1 THEN 'the reference is carried by ' || r.n || ' current letters, serials [' || array_to_string(r.serials, ', ') || ']'
         WHEN p.n = 1 THEN 'no reference match; page-range overlap with serial ' || p.serials[1]
         WHEN p.n > 1 THEN 'no reference match; page-range overlap with ' || p.n || ' current letters, serials [' || array_to_string(p.serials, ', ') || ']'
         ELSE 'no reference or page match' END AS why
  FROM fresh f LEFT JOIN by_ref r USING (candidate) LEFT JOIN by_page p USING (candidate)),
claimed AS (SELECT *, CASE WHEN id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY package_id, id) END AS claims FROM first_pass),
matches AS (
  SELECT c.package_id, c.document_id, c.candidate, c.ref, c.page_from,
    CASE WHEN claims > 1 THEN 'flag_conflict' ELSE act END AS action,
    CASE WHEN claims > 1 THEN NULL ELSE id END AS matched_id, CASE WHEN claims > 1 THEN NULL ELSE o.serial END AS matched_serial,
    CASE WHEN claims > 1 THEN claims || ' candidates of this run match serial ' || o.serial ELSE why END AS reason
  FROM claimed c LEFT JOIN old o ON o.letter_id = c.id)"""

VERSIONED = """
versioned AS (
  SELECT l_orderkey % 50 AS package_id, l_orderkey AS serial, l_orderkey * 10 + l_linenumber AS letter_id,
         min(CAST(l_shipdate AS DATE)) AS created_at FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

ACTIONS = """
chosen AS (
  SELECT field_id, CASE field_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' ELSE 'corrected' END AS action,
         field_id AS acted_at FROM fields WHERE field_id % 13 = 0
  UNION ALL SELECT field_id, 'verified', field_id + 1 FROM fields WHERE field_id % 13 = 0 AND field_id % 2 = 0),
judged_action AS (
  SELECT c.*, f.letter_id, f.value, f.is_current, f.is_current
    AND (c.action = 'corrected' OR NOT EXISTS (SELECT 1 FROM chosen x WHERE x.field_id = c.field_id
         AND x.action = 'corrected' AND x.acted_at < c.acted_at)) AS ok
  FROM chosen c JOIN fields f USING (field_id))"""

STORED_LINKS = """
stored_link AS (
  SELECT package_id, citing_letter_id, cited_ref_normalized, 'first: ' || cited_ref_text AS cited_ref_text,
    CASE WHEN citing_letter_id % 7 = 0 THEN 1 END AS cited_letter_id,
    CASE WHEN citing_letter_id % 7 = 0 THEN 'resolved' ELSE 'unresolved_missing' END AS resolution,
    CASE WHEN citing_letter_id % 7 = 0 THEN 'human' ELSE 'pipeline' END AS resolution_source
  FROM links WHERE citing_letter_id % 5 <> 0)"""

CONFIRMATIONS = """
offered AS (
  SELECT package_id, citing_letter_id, cited_ref_normalized, min(candidate_letter_id) AS candidate_letter_id
  FROM candidates GROUP BY ALL),
confirmation AS (
  SELECT *, citing_letter_id * 2 AS confirmed_at FROM offered WHERE citing_letter_id % 3 = 0
  UNION ALL
  SELECT package_id, citing_letter_id, cited_ref_normalized, -1, citing_letter_id * 2 + 1 FROM offered WHERE citing_letter_id % 9 = 0),
weighed AS (
  SELECT c.*, l.resolution = 'unresolved_ambiguous' AS is_open, c.candidate_letter_id <> -1 AS is_candidate
  FROM confirmation c JOIN links l USING (package_id, citing_letter_id, cited_ref_normalized)),
method AS (
  SELECT package_id, citing_letter_id, cited_ref_normalized, bool_or(match_method = 'trgm_fuzzy') AS scored FROM candidates GROUP BY 1, 2, 3),
valid AS (
  SELECT w.*, m.scored FROM weighed w JOIN method m USING (package_id, citing_letter_id, cited_ref_normalized)
  WHERE is_open AND is_candidate),
winner AS (
  SELECT package_id, cited_ref_normalized, citing_letter_id AS first_citing, candidate_letter_id AS alias_id FROM valid WHERE scored
  QUALIFY row_number() OVER (PARTITION BY package_id, cited_ref_normalized ORDER BY confirmed_at, citing_letter_id) = 1),
decided AS (
  SELECT v.*, coalesce(v.scored AND v.citing_letter_id <> w.first_citing AND w.alias_id <> v.citing_letter_id, false) AS late
  FROM valid v LEFT JOIN winner w USING (package_id, cited_ref_normalized)),
accepted AS (SELECT * FROM decided WHERE NOT late)"""

RELINKED = """
taught AS (SELECT package_id, cited_ref_normalized, arg_max(candidate_letter_id, confirmed_at) AS letter_id FROM accepted GROUP BY 1, 2),
judged AS (
  SELECT l.*, d.candidate_letter_id AS chosen, CASE WHEN (l.rule IS NULL OR l.rule = 'serial_anchored')
    AND t.letter_id <> l.citing_letter_id THEN t.letter_id END AS known_as
  FROM links l LEFT JOIN accepted d USING (package_id, citing_letter_id, cited_ref_normalized)
  LEFT JOIN taught t ON t.package_id = l.package_id AND t.cited_ref_normalized = l.cited_ref_normalized),
relinked AS (
  SELECT package_id, citing_letter_id, cited_ref_normalized, coalesce(chosen, known_as, cited_letter_id) AS cited_letter_id,
    CASE WHEN coalesce(chosen, known_as) IS NOT NULL THEN 'resolved' ELSE resolution END AS resolution,
    CASE WHEN chosen IS NOT NULL THEN 'human' WHEN known_as IS NOT NULL THEN 'alias' ELSE resolution_source END AS resolution_source
  FROM judged)"""

STORED_THREADS = """
known_thread AS (
  SELECT package_id, thread_key, 'old subject' AS subject, first_dated, last_dated, 99 AS letter_count, 4 AS thread_version
  FROM thread WHERE component % 3 <> 0),
stored_thread AS (
  SELECT * FROM known_thread
  UNION ALL SELECT package_id, 'GONE/' || thread_key, subject, first_dated, last_dated, letter_count, thread_version
  FROM known_thread WHERE thread_key LIKE '%1'),
thread_now AS (
  SELECT coalesce(s.package_id, t.package_id) AS package_id, coalesce(s.thread_key, t.thread_key) AS thread_key,
    coalesce(s.subject, t.subject) AS subject,
    CASE WHEN t.thread_key IS NULL THEN s.first_dated ELSE t.first_dated END AS first_dated,
    CASE WHEN t.thread_key IS NULL THEN s.last_dated ELSE t.last_dated END AS last_dated,
    coalesce(t.letter_count, 0) AS letter_count,
    CASE WHEN t.thread_key IS NULL THEN s.thread_version ELSE coalesce(s.thread_version, 0) + 1 END AS thread_version
  FROM stored_thread s FULL JOIN thread t ON s.package_id = t.package_id AND s.thread_key = t.thread_key),
log AS (
  SELECT p.package_id, p.thread_key, n.thread_version, p.letter_id
  FROM pointed p JOIN thread_now n ON n.package_id = p.package_id AND n.thread_key = p.thread_key)"""

REGISTER = """
previous AS (
  SELECT a.letter_id, arg_max({'ref': b.letter_ref, 'dated': b.dated}, {'d': b.dated, 's': b.serial}) AS prev
  FROM pointed a JOIN pointed b ON b.component = a.component AND b.dated < a.dated GROUP BY a.letter_id)"""


def _chainage(x: str) -> str:
    return (
        f"CAST(nullif(regexp_extract({x}, 'Km\\s*(\\d+)\\+(\\d{{3}})', 1), '') AS BIGINT) * 1000 + "
        f"CAST(nullif(regexp_extract({x}, 'Km\\s*(\\d+)\\+(\\d{{3}})', 2), '') AS BIGINT)"
    )


def _shown(x: str) -> str:
    return f"coalesce(strftime({x}, '%d %b %Y'), '—')"


SPANS = f"""
span AS (
  SELECT package_id, letter_id, field_id, {_chainage('value')} AS lo, {_chainage('value')} AS hi FROM fields
  WHERE is_current AND field_key = 'chainage')"""

SEARCH = f"""
searchable AS (
  SELECT package_id, letter_id, serial, [
    {{'n': 'letter ref', 'v': lower(letter_ref)}}, {{'n': 'subject', 'v': lower(subject)}},
    {{'n': 'chainage', 'v': lower(coalesce(chainage, ''))}}, {{'n': 'clause', 'v': lower(coalesce(clause, ''))}},
    {{'n': 'parties', 'v': lower(from_code || ' ' || to_code)}}, {{'n': 'dated', 'v': lower({_shown('dated')})}},
    {{'n': 'thread', 'v': lower(thread_key)}}, {{'n': 'source file', 'v': lower(document_id || '.pdf')}}] AS texts
  FROM pointed)"""


def _search(phrase: str) -> str:
    words = phrase.split()
    every = " AND ".join(f"len(list_filter(texts, lambda t: contains(t.v, '{w}'))) > 0" for w in words)
    some = " OR ".join(f"contains(t.v, '{w}')" for w in words)
    return (
        "SELECT package_id, letter_id, serial, "
        f"array_to_string(list_transform(list_filter(texts, lambda t: {some}), lambda t: t.n), ', ') AS matched_on, "
        f"len(list_filter(texts, lambda t: {some})) AS matched_n, "
        f"len(list_filter(texts, lambda t: contains(t.v, '{phrase}'))) > 0 AS phrase_hit "
        f"FROM searchable WHERE {every}"
    )


STOP = (
    "'the','of','and','for','to','in','on','at','a','an','is','are','as','with','from','by','or','be','it','its',"
    "'this','that','under','into','reg','sub','ref','dated','sir','madam','please','shall','may','no'"
)


def _title(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '[0-9/()]') THEN {x} ELSE array_to_string(list_transform("
        f"regexp_extract_all({x}, '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '') END"
    )


VOCABULARY = f"""
subject_words AS (
  SELECT package_id, serial, list_filter(list_transform(string_split_regex(lower(subject), '[^a-z0-9+/().-]+'),
         lambda w: regexp_replace(regexp_replace(w, '^[-.]+', ''), '[-.]+$', '')), lambda w: length(w) > 1) AS w FROM pointed),
subject_at AS (
  SELECT package_id, serial, unnest(w) AS word, unnest(list_concat(w[2:], [NULL])) AS following FROM subject_words),
entry AS (
  SELECT package_id, serial, 0 AS place, 'ref' AS kind, letter_ref AS text FROM pointed
  UNION ALL SELECT package_id, serial, 1, 'chainage', chainage FROM pointed
  UNION ALL SELECT package_id, serial, 2, 'clause', clause FROM pointed
  UNION ALL SELECT package_id, serial, 3, 'file', document_id || '.pdf' FROM pointed
  UNION ALL SELECT package_id, serial, 4, 'thread', thread_key FROM pointed
  UNION ALL SELECT package_id, serial, 5, 'party', from_code FROM pointed
  UNION ALL SELECT package_id, serial, 6, 'party', to_code FROM pointed
  UNION ALL SELECT package_id, serial, 7, 'subject', {_title('word')} FROM subject_at WHERE word NOT IN ({STOP})
  UNION ALL SELECT package_id, serial, 7, 'subject', {_title("(word || ' ' || following)")} FROM subject_at
    WHERE word NOT IN ({STOP}) AND following NOT IN ({STOP})),
vocabulary AS (
  SELECT package_id, kind, arg_min(trim(text), {{'s': serial, 'p': place, 't': text}}) AS text, count(*) AS count
  FROM entry WHERE length(trim(text)) >= 2 GROUP BY package_id, kind, lower(trim(text)))"""

DIFF_SIDES = """
a AS (SELECT package_id, serial, letter_ref, dated, thread_key FROM pointed),
b AS (
  SELECT package_id, serial, letter_ref, CASE WHEN letter_id % 77 = 0 THEN dated + 1 ELSE dated END AS dated,
    CASE WHEN letter_id % 91 = 0 THEN 'OTHER' ELSE thread_key END AS thread_key FROM pointed WHERE letter_id % 333 <> 0)"""

LOCATED = """
placed_claim AS (
  SELECT p.document_id, p.page_no, p.text, c.claim_no,
    (p.document_id * 7919 + p.page_no * 104729 + c.claim_no * 15485863) % 1000003 AS h
  FROM page p CROSS JOIN (SELECT unnest([0, 1, 2]) AS claim_no) c),
claim AS (
  SELECT *, CASE h // 7 % 5
      WHEN 0 THEN substr(text, begins, 20) WHEN 1 THEN replace(substr(text, begins, 20), ' ', '  ') WHEN 2 THEN 'ZZZ not there'
      WHEN 3 THEN replace(substr(text, begins, 30), ' ', chr(10)) ELSE '' END AS verbatim
  FROM (SELECT *, CAST(1 + h % greatest(length(text) - 20, 1) AS BIGINT) AS begins FROM placed_claim)),
found AS (
  SELECT *, strpos(text, verbatim) AS found_at,
    CASE WHEN trim(regexp_replace(verbatim, '\\s+', ' ', 'g')) <> '' THEN regexp_extract(text,
      replace(regexp_escape(trim(regexp_replace(verbatim, '\\s+', ' ', 'g'))), '\\ ', '\\s+')) ELSE '' END AS loose
  FROM claim),
located AS (
  SELECT document_id, page_no, claim_no,
    CASE WHEN verbatim = '' THEN 'unresolved' WHEN found_at > 0 THEN 'exact'
         WHEN loose <> '' THEN 'normalized_exact' ELSE 'unresolved' END AS validation,
    CASE WHEN verbatim = '' THEN NULL WHEN found_at > 0 THEN found_at - 1 WHEN loose <> '' THEN strpos(text, loose) - 1 END AS char_start,
    CASE WHEN verbatim = '' THEN NULL WHEN found_at > 0 THEN found_at - 1 + length(verbatim)
         WHEN loose <> '' THEN strpos(text, loose) - 1 + length(loose) END AS char_end
  FROM found),
touched AS (
  SELECT l.document_id, l.page_no, l.claim_no, l.validation, l.char_start, l.char_end, count(t.i) AS n_rects,
    min(t.word_no * 60 / 1000.0) AS x0, min(t.line_no % 20 * 40 / 2000.0) AS y0,
    max(t.word_no * 60 / 1000.0 + length(t.w) * 8 / 1000.0) AS x1, max(t.line_no % 20 * 40 / 2000.0 + 30 / 2000.0) AS y1,
    arg_min(t.word_no * 60 / 1000.0, t.i) AS first_x
  FROM located l LEFT JOIN placed_token t ON t.document_id = l.document_id AND t.page_no = l.page_no
    AND t.char_end - length(t.w) < l.char_end AND t.char_end > l.char_start
  GROUP BY ALL)"""

LETTER_STATUS = """
status AS (
  SELECT l.package_id, l.letter_id, CASE
    WHEN EXISTS (SELECT 1 FROM fields f WHERE f.letter_id = l.letter_id AND f.is_current AND f.validation = 'unresolved')
      OR EXISTS (SELECT 1 FROM links c WHERE c.citing_letter_id = l.letter_id AND c.resolution = 'unresolved_ambiguous')
    THEN 'needs_review'
    WHEN EXISTS (SELECT 1 FROM fields f WHERE f.letter_id = l.letter_id AND f.is_current AND f.review_status = 'verified')
    THEN 'verified' ELSE 'unverified' END AS review_status
  FROM letters l)"""


def _violations(parts: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{table}' AS table_name, {body}" for rule, table, body in parts
    )


_LINK_KEY = "citing_letter_id || '/' || cited_ref_normalized AS key"

SQL: dict[str, str] = {
    "a1_content_hash_intake": """
        SELECT 'upload/' || doc_id || '.pdf' AS path, sha256(text) AS sha256, strlen(text) AS byte_size,
               'application/pdf' AS mime_type, doc_id || '.pdf' AS original_filename,
               'documents/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS storage_uri FROM documents""",
    "a2_duplicate_classes": f"WITH {ARRIVALS} SELECT * FROM classified",
    "a2_rows_to_insert": f"""WITH {ARRIVALS}
        SELECT DISTINCT sha256, NULL::BIGINT AS package_id FROM arrivals WHERE sha256 NOT IN (SELECT sha256 FROM stored)
        UNION ALL SELECT DISTINCT a.sha256, a.package_id FROM arrivals a
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.sha256 = a.sha256 AND s.package_id = a.package_id)""",
    "a3_storage_keys": """
        SELECT doc_id, 'documents/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS original,
               'derived/v3/' || sha256(text) || '/page-' || CASE WHEN doc_id % 2000 < 1000
               THEN lpad(CAST(doc_id % 2000 AS VARCHAR), 3, '0') ELSE CAST(doc_id % 2000 AS VARCHAR) END || '.png' AS raster
        FROM documents""",
    "a4_integrity_audit": """
        WITH r AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 83 <> 0),
        f AS (SELECT sha256(text) AS s, min(doc_id) % 97 = 0 AS altered FROM documents WHERE doc_id % 89 <> 0 GROUP BY text)
        SELECT 'documents/' || substr(coalesce(r.s, f.s), 1, 2) || '/' || coalesce(r.s, f.s) AS key, r.s AS sha256,
          CASE WHEN r.s IS NULL THEN 'unregistered' WHEN f.s IS NULL THEN 'missing' WHEN f.altered THEN 'altered' ELSE 'intact' END AS state
        FROM r FULL JOIN f ON r.s = f.s""",
    "a5_candidate_letters": f"""WITH {BRIDGE},
        readable AS (SELECT *, row_number() OVER (PARTITION BY package_id, document_id ORDER BY letter_id) - 1 AS candidate
          FROM letters WHERE CAST(substr(document_id, 4) AS BIGINT) % 100 <> 0)
        SELECT package_id, document_id, candidate, letter_ref, upper(letter_ref) AS letter_ref_normalized, dated, received,
          subject, {_party_text('from_code')} AS from_text, {_party_text('to_code')} AS to_text, page_from, page_to FROM readable""",
    "a5_candidate_fields": f"""{WITH_FIELDS},
        readable AS (SELECT letter_id, row_number() OVER (PARTITION BY package_id, document_id ORDER BY letter_id) - 1 AS candidate,
          page_from FROM letters WHERE CAST(substr(document_id, 4) AS BIGINT) % 100 <> 0),
        every AS (SELECT package_id, document_id, letter_id, field_key, value FROM fields
          UNION ALL SELECT package_id, document_id, letter_id, 'dated', 'null' FROM letters WHERE dated IS NULL)
        SELECT package_id, document_id, candidate, field_key, 0 AS field_index, value, value AS verbatim, page_from AS page
        FROM every JOIN readable USING (letter_id)""",
    "a5_unreadable": f"""WITH {BRIDGE} SELECT DISTINCT package_id, document_id, 'unreadable extraction' AS error FROM letters
        WHERE CAST(substr(document_id, 4) AS BIGINT) % 100 = 0""",
    "a6_document_bundle": f"""{WITH_WORDS},
        b AS (SELECT document_id, string_agg('--- PAGE ' || page_no || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS t
          FROM page GROUP BY 1)
        SELECT document_id, sha256(t) AS bundle_hash, length(t) AS n FROM b""",
    "a7_page_assembly": f"""{WITH_WORDS},
        last_token AS (SELECT document_id, page_no, arg_max({{'e': char_end, 'w': w, 'n': word_no, 'l': line_no}}, i) AS t,
          sum(char_end - length(w)) AS start_sum,
          sum(greatest((line_no * 31 + word_no * 7) % 102 - 1, 0) / 100.0) AS confidence_sum
          FROM placed_token GROUP BY 1, 2)
        SELECT document_id, page_no, sha256(text) AS text_hash, n_tokens, t.e - length(t.w) AS last_start, t.e AS last_end,
          round(t.n * 60 / 1000.0, 6) AS last_x, round(t.l % 20 * 40 / 2000.0, 6) AS last_y,
          round(confidence_sum, 4) AS confidence_sum, start_sum
        FROM page JOIN last_token USING (document_id, page_no)""",
    "a9_upload_outcome": f"""WITH {ARRIVALS}
        SELECT package_id, sha256, count(*) AS arrivals, arg_min(outcome, arrival) = 'duplicate' AS is_duplicate,
          count(*) FILTER (arrival % 3 = 0) AS letters_found, count(*) FILTER (arrival % 5 = 0) AS merged,
          min(CASE WHEN arrival % 5 = 0 THEN 'REF/' || arrival END) AS first_merged_ref,
          max(CASE WHEN arrival % 11 = 0 THEN 'no answer' END) AS error
        FROM classified GROUP BY package_id, sha256""",
    "a9_merged_references": f"""WITH {ARRIVALS}
        SELECT package_id, sha256, 'REF/' || (arrival % 7) AS letter_ref, count(*) AS merged FROM classified
        WHERE arrival % 5 = 0 GROUP BY ALL""",
    "a10_snapshot_sink": f"{ONLY_BRIDGE} SELECT package_id, letter_id, serial, letter_ref FROM letters",
    "c1_verbatim_location": f"""{WITH_WORDS}, {LOCATED}
        SELECT document_id, page_no AS page, claim_no, validation, char_start, char_end FROM located""",
    "c2_span_rectangles": f"""{WITH_WORDS}, {LOCATED}
        SELECT document_id, page_no AS page, claim_no, n_rects, round(x0, 6) AS box_x, round(y0, 6) AS box_y,
          round(x1 - x0, 6) AS box_w, round(y1 - y0, 6) AS box_h, round(first_x, 6) AS first_x FROM touched WHERE n_rects > 0""",
    "c3_stored_fields": f"""{WITH_WORDS}, {LOCATED}
        SELECT document_id, page_no AS claimed, claim_no, CASE WHEN ok THEN validation ELSE 'unresolved' END AS validation,
          CASE WHEN ok THEN char_start END AS char_start, CASE WHEN ok THEN char_end END AS char_end,
          CASE WHEN ok THEN page_no END AS page_no, CASE WHEN ok THEN n_rects ELSE 0 END AS n_rects
        FROM (SELECT *, n_rects > 0 AND document_id % 9 <> 0 AS ok FROM touched)""",
    "c4_token_audit": f"""{WITH_WORDS},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_no ORDER BY i) - 1 AS token_no,
          char_end - length(w) AS char_start FROM placed_token WHERE document_id % 10 = 0)
        SELECT document_id, count(*) AS broken, min(token_no) AS first_token FROM numbered JOIN page USING (document_id, page_no)
        WHERE substr(text, CAST(char_start AS BIGINT) + 2, length(w)) <> w GROUP BY document_id""",
    "c5_type_checks": f"""{WITH_FIELDS}, {FILES},
        finding AS (SELECT package_id, letter_id, field_id, field_key, value, CASE
          WHEN field_key IN ('dated', 'received') AND TRY_CAST(value AS DATE) IS NULL THEN 'not a calendar date'
          WHEN field_key = 'chainage' AND NOT regexp_matches(value, 'Km\\s*\\d+\\+\\d{{3}}') THEN 'not a chainage'
          WHEN field_key = 'clause' AND value <> 'Cl. 17.3' THEN 'clause not in the package''s list'
          WHEN field_key IN ('letter_ref', 'cited_ref') AND package_id % 2 = 0
            AND NOT regexp_matches(value, '^(CTR|AE|PD)/PKG[0-9]+/[0-9]{{4}}/[0-9]+$')
            THEN 'reference does not match the package''s pattern' END AS finding
          FROM fields WHERE is_current)
        SELECT * FROM finding WHERE finding IS NOT NULL""",
    "c6_anomalies": f"""{WITH_LINKS},
        live AS (SELECT * FROM letters WHERE is_current AND NOT is_voided)
        SELECT package_id, letter_id, 'received before dated' AS anomaly FROM live
          WHERE letter_id % 43 = 0 AND dated IS NOT NULL
        UNION ALL SELECT package_id, letter_id, 'dated outside the contract period' FROM live
          WHERE dated NOT BETWEEN DATE '1995-06-01' AND DATE '2001-01-31'
        UNION ALL SELECT k.package_id, k.citing_letter_id, 'cites a later letter' FROM links k
          JOIN live a ON a.letter_id = k.citing_letter_id JOIN live b ON b.letter_id = k.cited_letter_id
          WHERE k.resolution = 'resolved' AND b.dated > a.dated""",
    "c7_review_status": f"{LINKS_AND_FIELDS}, {LETTER_STATUS} SELECT * FROM status",
    "c8_triage": f"""{WITH_FIELDS} SELECT package_id, field_key, count(*) FILTER (validation = 'exact') AS exact,
        count(*) FILTER (validation = 'normalized_exact') AS normalized_exact, count(*) FILTER (validation = 'unresolved') AS unresolved,
        count(*) FILTER (validation = 'human_corrected') AS human_corrected FROM fields WHERE is_current GROUP BY 1, 2""",
    "c8_unresolved_fields": f"""{WITH_FIELDS} SELECT package_id, document_id, letter_id, field_key, field_index, value, verbatim
        FROM fields WHERE is_current AND validation = 'unresolved'""",
    "d1_blank_candidates": f"""{ONLY_BRIDGE} SELECT package_id, document_id, letter_id AS candidate FROM letters WHERE letter_id % 41 = 0""",
    "d2_merged_repeats": f"""{ONLY_BRIDGE}, {CANDIDATES}
        SELECT package_id, document_id, candidate, letter_ref, ref AS letter_ref_normalized, existing AS existing_letter_id,
          CASE WHEN existing IS NULL THEN first_document END AS first_document_id
        FROM judged WHERE existing IS NOT NULL OR copy > 1""",
    "d2_fresh_candidates": f"""{ONLY_BRIDGE}, {CANDIDATES}
        SELECT package_id, document_id, candidate, ref AS letter_ref_normalized,
          CASE WHEN from_code IN ('CTR', 'AE') THEN from_code END AS from_code, CASE WHEN to_code IN ('CTR', 'AE') THEN to_code END AS to_code,
          CASE WHEN from_code = 'CTR' THEN 'outward' WHEN to_code = 'CTR' THEN 'inward' END AS direction
        FROM judged WHERE existing IS NULL AND copy = 1""",
    "d3_serial_numbers": f"""{ONLY_BRIDGE}, {CANDIDATES}
        SELECT package_id, candidate, package_id * 10 + place AS serial FROM candidate""",
    "d4_reference_collisions": f"""{ONLY_BRIDGE},
        named AS (SELECT *, CASE WHEN letter_id % 37 = 0 THEN 'REPEAT/' || (letter_id // 370) ELSE upper(letter_ref) END AS ref
          FROM letters WHERE is_current)
        SELECT package_id, ref AS letter_ref_normalized, letter_id, serial, sharing
        FROM (SELECT *, count(*) OVER (PARTITION BY package_id, ref) AS sharing FROM named) WHERE sharing > 1""",
    "d5_reprocessing_match": f"""{ONLY_BRIDGE}, {RERUN}
        SELECT package_id, document_id, candidate, action, matched_id, matched_serial, reason FROM matches""",
    "d6_supersession": f"""{ONLY_BRIDGE}, {RERUN.replace("letter_id, serial,", "letter_id, letter_id AS serial,", 1)},
        top AS (SELECT package_id, max(letter_id) + 1 AS next_serial FROM old GROUP BY 1),
        minted AS (SELECT m.*, t.next_serial - 1 + row_number() OVER (PARTITION BY m.package_id ORDER BY m.document_id, m.candidate) AS serial
          FROM matches m JOIN top t USING (package_id) WHERE action <> 'supersede')
        SELECT o.package_id, o.document_id, o.serial, o.ref AS letter_ref_normalized, o.page_from, m.candidate IS NULL AS is_current,
          m.candidate IS NOT NULL AS replaced, l.review_status
        FROM old o JOIN letters l USING (letter_id) LEFT JOIN matches m ON m.matched_id = o.letter_id
        UNION ALL SELECT package_id, document_id, matched_serial, ref, page_from, true, false, 'unverified' FROM matches WHERE action = 'supersede'
        UNION ALL SELECT package_id, document_id, serial, ref, page_from, true, false,
          CASE WHEN action = 'new' THEN 'unverified' ELSE 'needs_review' END FROM minted""",
    "d6_flag_events": f"""{ONLY_BRIDGE}, {RERUN.replace("letter_id, serial,", "letter_id, letter_id AS serial,", 1)}
        SELECT 'reprocessing' AS actor, 'flagged' AS action, reason AS note, count(*) AS n FROM matches
        WHERE action LIKE 'flag%' GROUP BY reason""",
    "d7_version_history": f"""WITH {VERSIONED}
        SELECT *, row_number() OVER w AS version, lag(letter_id) OVER w AS previous_id, lead(letter_id) OVER w AS next_id
        FROM versioned WINDOW w AS (PARTITION BY package_id, serial ORDER BY created_at, letter_id)""",
    "d7_as_of": f"""WITH {VERSIONED}
        SELECT package_id, serial, letter_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY package_id, serial
          ORDER BY created_at DESC, letter_id DESC) AS n FROM versioned WHERE created_at <= DATE '1998-06-30') WHERE n = 1""",
    "d7_as_of_each": f"""WITH {VERSIONED},
        asked AS (SELECT DISTINCT package_id, serial, created_at + CAST(letter_id % 61 - 30 AS INTEGER) AS moment FROM versioned)
        SELECT a.package_id, a.serial, a.moment, v.letter_id, v.created_at FROM asked a
        LEFT JOIN versioned v ON v.package_id = a.package_id AND v.serial = a.serial AND v.created_at <= a.moment
        QUALIFY row_number() OVER (PARTITION BY a.package_id, a.serial, a.moment ORDER BY v.created_at DESC, v.letter_id DESC) = 1""",
    "d8_reviewed_fields": f"""{WITH_FIELDS}, {ACTIONS},
        fix AS (SELECT * FROM judged_action WHERE ok AND action = 'corrected'),
        mark AS (SELECT field_id, arg_max(action, acted_at) AS action FROM judged_action WHERE ok AND action <> 'corrected' GROUP BY 1)
        SELECT CAST(f.field_id AS VARCHAR) AS field_id, package_id, f.letter_id, field_key, field_index, f.value, validation,
          coalesce(mark.action, review_status) AS review_status, f.is_current AND fix.field_id IS NULL AS is_current,
          CASE WHEN fix.field_id IS NOT NULL THEN f.field_id || '/corrected' END AS superseded_by
        FROM fields f LEFT JOIN fix USING (field_id) LEFT JOIN mark USING (field_id)
        UNION ALL SELECT f.field_id || '/corrected', package_id, f.letter_id, field_key, field_index, 'NEW ' || f.field_id,
          'human_corrected', 'corrected', f.is_current, NULL FROM fields f JOIN fix USING (field_id)""",
    "d8_review_events": f"""{WITH_FIELDS}, {ACTIONS}
        SELECT CASE WHEN is_current THEN letter_id END AS letter_id,
          field_id || CASE WHEN ok AND action = 'corrected' THEN '/corrected' ELSE '' END AS field_id, 'reviewer' AS actor,
          CASE WHEN ok THEN action ELSE 'refused' END AS action, CASE WHEN ok AND action = 'corrected' THEN value END AS old_value,
          CASE WHEN ok AND action = 'corrected' THEN 'NEW ' || field_id END AS new_value, 'checked' AS note, acted_at
        FROM judged_action""",
    "d9_void_and_serial_audit": f"""{ONLY_BRIDGE},
        moved AS (SELECT package_id, serial + CASE WHEN letter_id % 101 = 0 THEN 1 ELSE 0 END AS serial, is_current,
          is_voided OR letter_id % 71 = 0 AS is_voided FROM letters),
        kept AS (SELECT DISTINCT package_id, serial FROM moved WHERE NOT is_voided),
        stepped AS (SELECT *, coalesce(lag(serial) OVER (PARTITION BY package_id ORDER BY serial), 0) AS before FROM kept)
        SELECT package_id, 'gap' AS finding, before + 1 AS first_serial, serial - 1 AS last_serial FROM stepped WHERE serial - before > 1
        UNION ALL SELECT package_id, 'duplicate', serial, serial FROM moved WHERE is_current GROUP BY package_id, serial HAVING count(*) > 1""",
    "d10_letter_projection": f"""{WITH_FIELDS}
        SELECT package_id, letter_id, max(value) FILTER (field_key = 'letter_ref') AS letter_ref,
          CAST(max(value) FILTER (field_key = 'dated') AS DATE) AS dated, CAST(max(value) FILTER (field_key = 'received') AS DATE) AS received,
          max(value) FILTER (field_key = 'from_party') AS from_party, max(value) FILTER (field_key = 'to_party') AS to_party,
          max(value) FILTER (field_key = 'subject') AS subject
        FROM fields WHERE is_current AND field_key IN ('letter_ref', 'dated', 'received', 'from_party', 'to_party', 'subject')
        GROUP BY package_id, letter_id""",
    "d11_run_publication": f"{WITH_FILES} SELECT run_id, status, is_current, superseded_by, error FROM published",
    "d12_chainage_ranges": f"""{WITH_FIELDS}
        SELECT package_id, letter_id, field_id, least(m, CASE WHEN letter_id % 3 = 0 THEN 91250 ELSE m END) AS lo,
          greatest(m, CASE WHEN letter_id % 3 = 0 THEN 91250 ELSE m END) AS hi
        FROM (SELECT *, coalesce({_chainage('value')}, CASE WHEN letter_id % 3 = 0 THEN 91250 END) AS m FROM fields
              WHERE is_current AND field_key = 'chainage') WHERE m IS NOT NULL""",
    "d12_clauses": f"""{WITH_FIELDS} SELECT package_id, letter_id, field_id, value AS clause FROM fields
        WHERE is_current AND field_key = 'clause'""",
    "d13_source_backfill": f"""{WITH_LINKS} SELECT citing_letter_id, cited_ref_normalized, resolution,
        CASE WHEN citing_letter_id % 2 = 0 THEN resolution_source WHEN resolution = 'resolved' THEN 'human' ELSE 'pipeline' END
        AS resolution_source FROM links""",
    "e1_exact_links": f"""{WITH_LINKS} SELECT package_id, citing AS citing_letter_id, ref AS cited_ref_normalized, target AS cited_letter_id
        FROM cites JOIN e1 USING (citing, ref) WHERE n = 1""",
    "e1_exact_ambiguous": f"""{WITH_LINKS},
        short_pool AS (SELECT package_id, letter_id, substr(ref, 1, length(ref) - 3) AS ref FROM pool),
        short_cite AS (SELECT DISTINCT package_id, citing, substr(ref, 1, length(ref) - 3) AS ref FROM mention)
        SELECT c.citing AS citing_letter_id, c.ref AS cited_ref_normalized, CASE WHEN count(*) = 1 THEN 'exact' ELSE 'exact_many' END AS rule,
          CASE WHEN count(*) = 1 THEN min(p.letter_id) END AS direct_id
        FROM short_cite c JOIN short_pool p ON p.package_id = c.package_id AND p.ref = c.ref AND p.letter_id <> c.citing
        GROUP BY c.citing, c.ref""",
    "e2_punctuation_blind_links": f"""{WITH_LINKS} SELECT package_id, citing AS citing_letter_id, ref AS cited_ref_normalized,
        target AS cited_letter_id FROM cites JOIN e2 USING (citing, ref)""",
    "e3_alias_links": f"""{WITH_LINKS},
        alias AS (SELECT DISTINCT k.package_id, k.cited_ref_normalized AS ref, (SELECT min(letter_id) FROM pool p WHERE p.package_id = k.package_id) AS letter_id
          FROM links k WHERE rule IS NULL AND citing_letter_id % 3 = 0)
        SELECT c.citing AS citing_letter_id, c.ref AS cited_ref_normalized, a.letter_id AS cited_letter_id
        FROM cites c JOIN alias a ON a.package_id = c.package_id AND a.ref = c.ref AND a.letter_id <> c.citing
        WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.citing = c.citing AND e1.ref = c.ref)
          AND NOT EXISTS (SELECT 1 FROM e2 WHERE e2.citing = c.citing AND e2.ref = c.ref)""",
    "e4_trigram_candidates": f"""{WITH_LINKS} SELECT citing AS citing_letter_id, ref AS cited_ref_normalized,
        letter_id AS candidate_letter_id, round(score, 6) AS match_score, place FROM fuzzy""",
    "e4_great_package": f"""WITH RECURSIVE {BRIDGE}, {GREAT_PACKAGE}, {NO_ALIASES}, {GREAT_LINKS}
        SELECT package_id, citing AS citing_letter_id, ref AS cited_ref_normalized, letter_id AS candidate_letter_id,
          round(score, 6) AS match_score, place FROM fuzzy""",
    "e5_serial_anchored": f"""{WITH_LINKS} SELECT citing AS citing_letter_id, ref AS cited_ref_normalized,
        letter_id AS candidate_letter_id, round(body_ratio, 6) AS body_ratio FROM ratio WHERE body_ratio >= 0.6""",
    "e6_resolution_states": f"{WITH_LINKS} SELECT package_id, resolution, rule, count(*) AS n FROM links GROUP BY ALL",
    "e7_upsert_links": f"""{WITH_LINKS}, {STORED_LINKS}
        SELECT k.package_id, k.citing_letter_id, k.cited_ref_normalized, coalesce(s.cited_ref_text, k.cited_ref_text) AS cited_ref_text,
          CASE WHEN s.resolution_source = 'human' THEN s.cited_letter_id ELSE k.cited_letter_id END AS cited_letter_id,
          CASE WHEN s.resolution_source = 'human' THEN s.resolution ELSE k.resolution END AS resolution,
          CASE WHEN s.resolution_source = 'human' THEN 'human' ELSE k.resolution_source END AS resolution_source
        FROM links k LEFT JOIN stored_link s USING (package_id, citing_letter_id, cited_ref_normalized)""",
    "e8_occurrences": f"""{WITH_LINKS}, {STORED_LINKS}
        SELECT DISTINCT package_id, citing AS citing_letter_id, ref AS cited_ref_normalized, field_index FROM mention m
        WHERE NOT EXISTS (SELECT 1 FROM stored_link s WHERE s.citing_letter_id = m.citing AND s.cited_ref_normalized = m.ref
                          AND s.resolution_source = 'human')""",
    "e9_candidate_rows": f"""{WITH_LINKS} SELECT * REPLACE (round(match_score, 6) AS match_score) FROM candidates""",
    "e10_confirmed_links": f"""{WITH_LINKS}, {CONFIRMATIONS} SELECT citing_letter_id, cited_ref_normalized,
        candidate_letter_id AS cited_letter_id, 'resolved' AS resolution FROM accepted""",
    "e10_learned_aliases": f"""{WITH_LINKS}, {CONFIRMATIONS} SELECT package_id, cited_ref_normalized,
        arg_max(candidate_letter_id, confirmed_at) AS letter_id FROM accepted GROUP BY 1, 2""",
    "e10_reresolved_links": f"""{WITH_LINKS}, {CONFIRMATIONS}, {RELINKED}
        SELECT package_id, citing_letter_id, cited_ref_normalized, cited_letter_id, resolution, resolution_source FROM relinked""",
    "e10_rethreaded": f"""{WITH_LINKS}, {CONFIRMATIONS}, {RELINKED}, {THREADS.replace("FROM links", "FROM relinked")}
        SELECT package_id, letter_id, thread_key FROM pointed""",
    "e10_rejected_confirmations": f"""{WITH_LINKS}, {CONFIRMATIONS} SELECT package_id, citing_letter_id, cited_ref_normalized,
        candidate_letter_id, confirmed_at, CASE WHEN NOT is_open THEN 'not_ambiguous' ELSE 'not_a_candidate' END AS reason
        FROM weighed WHERE NOT (is_open AND is_candidate)
        UNION ALL SELECT package_id, citing_letter_id, cited_ref_normalized, candidate_letter_id, confirmed_at,
          'already_resolved_by_alias' FROM decided WHERE late""",
    "e11_package_resolution": f"{WITH_LINKS} SELECT * FROM links",
    "f1_connected_components": f"{WITH_THREADS} SELECT package_id, letter_id, component FROM placed",
    "f1_updated_components": f"{WITH_THREADS} SELECT package_id, letter_id, component FROM placed",
    "f2_thread_summary": f"{WITH_THREADS} SELECT * FROM thread",
    "f3_f5_thread_versions": f"{WITH_THREADS}, {STORED_THREADS} SELECT * FROM thread_now",
    "f4_membership_log": f"{WITH_THREADS}, {STORED_THREADS} SELECT * FROM log",
    "f6_threads_as_of": f"""{WITH_THREADS}, {STORED_THREADS},
        longer AS (SELECT * FROM log UNION ALL SELECT package_id, thread_key, thread_version - 1, letter_id FROM log WHERE letter_id % 2 = 0)
        SELECT package_id, thread_key, thread_version, letter_id FROM (SELECT *, max(thread_version) OVER (PARTITION BY package_id, thread_key) AS top
          FROM longer WHERE thread_version <= 4) WHERE thread_version = top""",
    "f7_thread_of_letter": f"""{WITH_THREADS} SELECT package_id, thread_key, letter_id, dated, serial FROM pointed
        WHERE component IN (SELECT component FROM pointed WHERE letter_ref LIKE '%77')""",
    "g1_register": f"""{WITH_THREADS}, {REGISTER}
        SELECT letter_id, package_id, serial, review_status, dated, received, letter_ref, subject, direction, from_code, to_code,
          thread_key, prev.ref AS replies_to_ref, prev.dated AS replies_to_dated, dated - prev.dated AS reply_in_days
        FROM pointed LEFT JOIN previous USING (letter_id)""",
    "g2_missing_references": f"""{WITH_LINKS}
        SELECT l.package_id, cited_ref_normalized, min(cited_ref_text) AS first_cited_text, count(*) AS cited_by_count, min(dated) AS first_cited_on
        FROM links k JOIN letters l ON l.letter_id = k.citing_letter_id AND l.is_current
        WHERE resolution = 'unresolved_missing' GROUP BY 1, 2""",
    "g3_package_manifest": f"""{WITH_FILES}
        SELECT f.package_id, f.document_id, original_filename, byte_size, ingested_at, run_id, p.status AS run_status, pipeline_version,
          CASE WHEN run_id IS NOT NULL THEN 'boxes' END AS ocr_provider, 'model-' || pipeline_version AS model
        FROM filings f JOIN documents_held d USING (document_id) LEFT JOIN published p ON p.package_id = f.package_id
          AND p.document_id = f.document_id AND p.is_current""",
    "g4_letter_listing": f"""{THREADS_AND_FIELDS}, {REGISTER}, missing AS (SELECT citing_letter_id AS letter_id, min(cited_ref_text) AS missing_citation
          FROM links WHERE resolution = 'unresolved_missing' GROUP BY 1)
        SELECT package_id, letter_id, serial, letter_ref, dated, received, from_code, to_code, direction, NULL::VARCHAR AS unresolved_field, subject,
          (SELECT value FROM fields f WHERE f.letter_id = p.letter_id AND is_current AND field_key = 'chainage') AS chainage,
          (SELECT value FROM fields f WHERE f.letter_id = p.letter_id AND is_current AND field_key = 'clause') AS clause,
          thread_key, review_status, missing_citation, document_id, page_from, page_to, document_id || '.pdf' AS original_filename,
          prev.ref AS replies_to_ref, prev.dated AS replies_to_dated, dated - prev.dated AS reply_in_days
        FROM pointed p LEFT JOIN missing USING (letter_id) LEFT JOIN previous USING (letter_id)""",
    "g5_document_listing": f"""{WITH_FILES}
        SELECT f.package_id, f.document_id, original_filename, byte_size, ingested_at,
          (SELECT count(*) FROM document_pages g WHERE g.document_id = f.document_id) AS pages,
          (SELECT count(*) FROM letters l WHERE l.document_id = f.document_id AND l.package_id = f.package_id
            AND is_current AND NOT is_voided) AS letters, coalesce(p.status, 'unknown') AS status, p.error
        FROM filings f JOIN documents_held USING (document_id) LEFT JOIN published p ON p.package_id = f.package_id
          AND p.document_id = f.document_id AND p.is_current""",
    "g6_package_header": f"""{WITH_FILES} SELECT package_id, name, contract_no, count(DISTINCT document_id) AS documents_ingested
        FROM packages JOIN filings USING (package_id) GROUP BY 1, 2, 3""",
    "g7_field_provenance": f"""{WITH_FIELDS}
        SELECT f.package_id, f.letter_id, field_key, field_index, value AS display, value, verbatim, page_no, validation
        FROM fields f JOIN letters l ON l.letter_id = f.letter_id AND l.is_current WHERE f.is_current""",
    "g7_page_highlights": f"""{WITH_FIELDS} SELECT field_id, field_key, value FROM fields
        WHERE is_current AND validation <> 'unresolved' AND page_no = 2""",
    "g8_ambiguity_queue": f"""{WITH_LINKS}
        SELECT k.package_id, k.citing_letter_id, a.letter_ref AS citing_ref, a.serial AS citing_serial, k.cited_ref_text,
          c.candidate_letter_id, b.letter_ref AS candidate_ref, b.serial AS candidate_serial, match_method, round(match_score, 6) AS match_score
        FROM links k JOIN letters a ON a.letter_id = k.citing_letter_id AND a.is_current AND NOT a.is_voided
        LEFT JOIN candidates c ON c.citing_letter_id = k.citing_letter_id AND c.cited_ref_normalized = k.cited_ref_normalized
        LEFT JOIN letters b ON b.letter_id = c.candidate_letter_id WHERE k.resolution = 'unresolved_ambiguous'""",
    "g8_queue_page": f"""{WITH_LINKS},
        paged AS (SELECT k.*, row_number() OVER (PARTITION BY k.package_id ORDER BY a.serial, k.cited_ref_text) AS place
          FROM links k JOIN letters a ON a.letter_id = k.citing_letter_id AND a.is_current AND NOT a.is_voided
          WHERE k.resolution = 'unresolved_ambiguous' AND (k.package_id % 2 = 1 OR a.serial > 40) QUALIFY place <= 5),
        listed AS (SELECT p.package_id, place, p.citing_letter_id, p.cited_ref_text, c.candidate_letter_id, b.letter_ref AS candidate_ref,
            match_method, round(match_score, 6) AS match_score, count(c.candidate_letter_id) OVER (PARTITION BY p.package_id, place) AS n_candidates,
            row_number() OVER (PARTITION BY p.package_id, place ORDER BY match_score DESC NULLS LAST, b.serial, b.letter_id) AS n
          FROM paged p LEFT JOIN candidates c ON c.citing_letter_id = p.citing_letter_id AND c.cited_ref_normalized = p.cited_ref_normalized
          LEFT JOIN letters b ON b.letter_id = c.candidate_letter_id)
        SELECT package_id, place, citing_letter_id, cited_ref_text, n_candidates, CASE WHEN candidate_letter_id IS NOT NULL THEN n END AS rank,
          candidate_letter_id, candidate_ref, match_method, match_score FROM listed WHERE n <= 3""",
    "g9_first_missing_citation": f"""{WITH_LINKS} SELECT package_id, citing_letter_id AS letter_id, min(cited_ref_text) AS missing_citation
        FROM links WHERE resolution = 'unresolved_missing' GROUP BY 1, 2""",
    "g10_latest_rasters": f"""{WITH_FILES} SELECT document_id, page_no, pipeline_version, raster_uri FROM (
        SELECT *, row_number() OVER (PARTITION BY document_id, page_no ORDER BY pipeline_version DESC) AS n FROM document_pages) WHERE n = 1""",
    "g11_owned_letters": f"{ONLY_BRIDGE} SELECT package_id, letter_id FROM letters WHERE package_id % 10 = 1",
    "g11_owned_citations": f"""{WITH_LINKS} SELECT package_id, citing_letter_id, cited_ref_normalized FROM links WHERE package_id % 10 = 1""",
    "g11_owned_documents": f"{ONLY_BRIDGE} SELECT DISTINCT document_id FROM letters WHERE package_id % 10 = 1",
    "h1_register_filter": f"""{ONLY_BRIDGE} SELECT package_id, letter_id, dated, chainage FROM letters
        WHERE is_current AND NOT is_voided AND dated BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
          AND {_chainage('chainage')} BETWEEN 10000 AND 60000 AND direction = 'inward' AND 'CTR' IN (from_code, to_code)""",
    "h2_chainage_overlap": f"""{WITH_FIELDS}, {SPANS},
        section AS (SELECT CAST(s_nationkey AS BIGINT) AS package_id, s_suppkey AS section_id, (s_suppkey * 137) % 88000 AS section_lo,
          (s_suppkey * 137) % 88000 + 1500 AS section_hi FROM supplier)
        SELECT package_id, letter_id, section_id, lo, hi, section_lo, section_hi FROM span JOIN section USING (package_id)
        WHERE lo <= section_hi AND section_lo <= hi""",
    "h2_on_chainage": f"{WITH_FIELDS}, {SPANS} SELECT * FROM span WHERE lo <= 31000 AND hi >= 20000",
    "h3_clause_filter": f"""{WITH_FIELDS} SELECT package_id, letter_id FROM fields
        WHERE is_current AND field_key = 'clause' AND value = 'Cl. 17.3'""",
    "h4_chronological": f"{ONLY_BRIDGE} SELECT package_id, letter_id, dated, serial FROM letters WHERE is_current AND NOT is_voided",
    "h5_thread_gaps": f"""{WITH_THREADS}
        SELECT package_id, thread_key, letter_id, serial, lag(letter_ref) OVER w AS gap_from_ref, lag(dated) OVER w AS gap_from_dated,
          letter_ref AS gap_to_ref, dated AS gap_to_dated, dated - lag(dated) OVER w AS gap_days
        FROM pointed WINDOW w AS (PARTITION BY component ORDER BY dated NULLS LAST, serial)""",
    "h6_thread_spans": f"""{WITH_THREADS}
        SELECT package_id, thread_key, arg_min(letter_ref, {{'d': dated, 's': serial}}) FILTER (dated IS NOT NULL) AS first_ref,
          min(dated) AS first_dated, arg_max(letter_ref, {{'d': dated, 's': serial}}) FILTER (dated IS NOT NULL) AS last_ref,
          max(dated) AS last_dated, max(dated) - min(dated) AS span_days, count(*) AS letter_count
        FROM pointed GROUP BY package_id, thread_key""",
    "h7_package_summary": f"""{WITH_THREADS}
        SELECT package_id, 'Highway PKG-' || package_id AS name, count(*) AS letter_count,
          count(*) FILTER (review_status = 'needs_review') AS needs_review_count, count(DISTINCT thread_key) AS thread_count,
          max(dated) - min(dated) AS span_days
        FROM pointed WHERE 'highway pkg-' || package_id LIKE '%pkg-1%' GROUP BY package_id""",
    "h8_keyword_search": f"{WITH_THREADS}, {SEARCH} {_search('box culvert 1998')}",
    "h8_top_hits": f"""{WITH_THREADS}, {SEARCH} {_search('shifting of box')}
        ORDER BY phrase_hit DESC, matched_n DESC, serial, package_id LIMIT 25""",
    "h9_suggestion_index": f"{WITH_THREADS}, {VOCABULARY} SELECT package_id, kind, text, count FROM vocabulary",
    "h10_suggestion_match": f"""{WITH_THREADS}, {VOCABULARY},
        ranked AS (SELECT *, CASE WHEN starts_with(lower(text), 'cul') THEN 0
          WHEN len(list_filter(string_split_regex(lower(text), '[\\s/_-]+'), lambda w: starts_with(w, 'cul'))) > 0 THEN 1 END AS rank FROM vocabulary)
        SELECT package_id, kind, text, count, rank FROM ranked WHERE rank IS NOT NULL AND lower(text) <> 'cul'
        QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY rank, count DESC, length(text), text, kind) <= 8""",
    "h10_completions": f"""{WITH_THREADS}, {VOCABULARY},
        word AS (SELECT package_id, kind, text, count, unnest(string_split_regex(lower(text), '[\\s/_-]+')) AS w FROM vocabulary),
        size AS (SELECT unnest([2, 3, 4]) AS n),
        typed AS (
          SELECT package_id, kind, text, count, left(lower(text), n) AS prefix, 0 AS rank FROM vocabulary, size WHERE length(text) >= n
          UNION ALL SELECT package_id, kind, text, count, left(w, n), 1 FROM word, size WHERE length(w) >= n),
        best AS (SELECT package_id, kind, text, count, prefix, min(rank) AS rank FROM typed
          WHERE trim(prefix) = prefix AND prefix <> lower(text) GROUP BY package_id, kind, text, count, prefix)
        SELECT package_id, prefix, place, kind, text, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY package_id, prefix
          ORDER BY rank, count DESC, length(text), text, kind) AS place FROM best) WHERE place <= 8""",
    "h11_semantic_nearest": """
        WITH pair AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])
            / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity
          FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0)
        SELECT query_id, vec_id, similarity, rank, false AS authoritative FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY similarity DESC, vec_id) AS rank FROM pair) WHERE rank <= 10""",
    "h12_needs_review_register": f"""{LINKS_AND_FIELDS}, {LETTER_STATUS}
        SELECT package_id, letter_id FROM status s JOIN letters l USING (package_id, letter_id)
        WHERE s.review_status = 'needs_review' AND dated >= DATE '1997-01-01' AND is_current AND NOT is_voided""",
    "i1_usage_drift": f"""{WITH_FILES},
        summed AS (SELECT run_id, sum(input_tokens) AS i, sum(output_tokens) AS o FROM requests GROUP BY 1)
        SELECT run_id, input_tokens, output_tokens, i AS summed_input_tokens, o AS summed_output_tokens
        FROM runs JOIN summed USING (run_id) WHERE i <> input_tokens OR o <> output_tokens""",
    "i1_usage_totals": f"""{WITH_FILES}
        SELECT r.package_id, r.pipeline_version, count(*) AS requests, sum(q.input_tokens) AS input_tokens, sum(q.output_tokens) AS output_tokens,
          grouping(r.package_id, r.pipeline_version) AS level
        FROM requests q JOIN runs r USING (run_id) GROUP BY ROLLUP (r.package_id, r.pipeline_version)""",
    "i2_completeness": f"""{WITH_LINKS}, {FILES},
        missing AS (SELECT DISTINCT k.package_id, cited_ref_normalized FROM links k JOIN letters l ON l.letter_id = k.citing_letter_id
          AND l.is_current WHERE resolution = 'unresolved_missing'),
        tried AS (SELECT package_id, document_id, bool_or(is_current) AS ok, bool_or(status = 'failed') AS failed FROM published GROUP BY 1, 2)
        SELECT package_id, (SELECT count(*) FROM filings f WHERE f.package_id = p.package_id) AS documents_filed,
          (SELECT count(*) FROM tried t WHERE t.package_id = p.package_id AND ok) AS documents_read,
          (SELECT count(*) FROM tried t WHERE t.package_id = p.package_id AND failed AND NOT ok) AS documents_failed,
          (SELECT count(*) FROM letters l WHERE l.package_id = p.package_id AND is_current AND NOT is_voided) AS letters,
          (SELECT count(*) FROM letters l WHERE l.package_id = p.package_id AND is_current AND NOT is_voided AND review_status = 'needs_review') AS needs_review,
          (SELECT count(*) FROM missing m WHERE m.package_id = p.package_id) AS missing_references
        FROM packages p""",
    "j1_letter_rules": f"""{ONLY_BRIDGE} """ + _violations([
        ("page_from <= page_to", "letters", "CAST(letter_id AS VARCHAR) AS key FROM letters WHERE letter_id % 211 = 0"),
        ("review_status known", "letters", "CAST(letter_id AS VARCHAR) FROM letters WHERE letter_id % 307 = 0"),
        ("direction known", "letters", "CAST(letter_id AS VARCHAR) FROM letters WHERE letter_id % 401 = 0"),
        ("one current letter per serial", "letters", "package_id || '/' || s FROM (SELECT package_id, is_current, "
         "serial + CASE WHEN letter_id % 503 = 0 THEN 1 ELSE 0 END AS s FROM letters) WHERE is_current GROUP BY package_id, s HAVING count(*) > 1"),
    ]),
    "j1_field_rules": f"""{WITH_FIELDS},
        faulty AS (SELECT *, CASE WHEN field_id % 997 = 0 THEN NULL WHEN field_id % 991 = 0 THEN 3 ELSE page_no END AS p,
          CASE WHEN field_id % 983 = 0 THEN 'guessed' ELSE validation END AS v,
          CASE WHEN field_id % 977 = 0 THEN -1 ELSE letter_id END AS l FROM fields) """ + _violations([
        ("validation known", "fields", "CAST(field_id AS VARCHAR) AS key FROM faulty WHERE v = 'guessed'"),
        ("unresolved fields have no geometry", "fields", "CAST(field_id AS VARCHAR) FROM faulty WHERE v = 'unresolved' AND p IS NOT NULL"),
        ("located fields have geometry", "fields", "CAST(field_id AS VARCHAR) FROM faulty WHERE v LIKE '%exact' AND p IS NULL"),
        ("one current field per place", "fields", "l || '/' || field_key || '/' || field_index FROM faulty WHERE is_current "
         "GROUP BY l, field_key, field_index HAVING count(*) > 1"),
        ("field belongs to a letter of its package", "fields", "CAST(field_id AS VARCHAR) FROM faulty WHERE l = -1"),
    ]),
    "j1_geometry_rules": f"""{WITH_WORDS}, {LOCATED},
        place AS (SELECT document_id AS d, document_id || '/' || page_no || '/' || claim_no AS k, n_rects > 0 AS ok FROM touched) """
    + _violations([
        ("unresolved fields have no box or offset", "fields", "k AS key FROM place WHERE NOT ok AND d % 19 = 0"),
        ("located fields have box, offsets and page", "fields", "k FROM place WHERE ok AND d % 17 = 0"),
        ("end behind start", "fields", "k FROM place WHERE ok AND d % 13 = 0"),
    ]),
    "j1_source_rules": f"""{WITH_FIELDS} """ + _violations([
        ("field and letter from one run", "fields", "CAST(field_id AS VARCHAR) AS key FROM fields WHERE field_id % 977 = 0"),
        ("field on a page of its run", "fields",
         "CAST(field_id AS VARCHAR) FROM fields WHERE page_no IS NOT NULL AND (field_id % 977 = 0 OR field_id % 967 = 0)"),
    ]),
    "j1_party_rules": f"""{WITH_THREADS} """ + _violations([
        ("one party per short code", "parties", "package_id || '/CTR' AS key FROM (SELECT DISTINCT package_id FROM letters) WHERE package_id % 5 = 0"),
        ("from party of the package", "letters", "CAST(letter_id AS VARCHAR) FROM letters WHERE letter_id % 211 = 0"),
        ("to party of the package", "letters", "CAST(letter_id AS VARCHAR) FROM letters WHERE letter_id % 307 = 0"),
        ("thread of the package", "letters", "CAST(letter_id AS VARCHAR) FROM placed WHERE letter_id % 401 = 0"),
    ]),
    "j1_citation_rules": f"""{WITH_LINKS},
        faulty AS (SELECT *, CASE WHEN citing_letter_id % 211 = 0 THEN NULL WHEN citing_letter_id % 307 = 0 THEN -5 ELSE cited_letter_id END AS c FROM links) """
    + _violations([
        ("resolved means linked", "citations", f"{_LINK_KEY} FROM faulty WHERE (resolution = 'resolved') <> (c IS NOT NULL)"),
        ("source known", "citations", f"{_LINK_KEY} FROM faulty WHERE citing_letter_id % 401 = 0"),
        ("cited letter in the same package", "citations", f"{_LINK_KEY} FROM faulty WHERE c = -5"),
    ]),
    "j1_run_rules": f"""{WITH_FILES} """ + _violations([
        ("ended runs have an end", "runs", "CAST(run_id AS VARCHAR) AS key FROM published WHERE finished_at IS NULL"),
    ]),
    "j1_page_rules": f"""{WITH_WORDS},
        faulty AS (SELECT document_id, CASE WHEN d % 97 = 0 AND page_no = 1 THEN 0 ELSE page_no END AS page_no, d FROM (
          SELECT *, document_id AS d FROM page UNION ALL SELECT *, document_id FROM page WHERE document_id % 101 = 0)) """
    + _violations([
        ("page_no from 1", "pages", "document_id || '/' || page_no AS key FROM faulty WHERE page_no < 1"),
        ("page has a text", "pages", "document_id || '/' || page_no FROM faulty WHERE d % 89 = 0"),
        ("one row per document page", "pages", "document_id || '/' || page_no FROM faulty GROUP BY document_id, page_no HAVING count(*) > 1"),
    ]),
    "j1_void_rules": f"""{ONLY_BRIDGE} """ + _violations([
        ("void date and reason together", "letters", "CAST(letter_id AS VARCHAR) AS key FROM letters "
         "WHERE (letter_id % 7 = 0) <> ((letter_id % 7 = 0) <> (letter_id % 11 = 0))"),
    ]),
    "j1_thread_rules": f"""{WITH_THREADS},
        members AS (SELECT p.letter_id, CASE WHEN p.letter_id % 53 = 0 THEN -1 ELSE p.package_id END AS package_id,
          CASE WHEN p.letter_id % 61 = 0 THEN -2 ELSE p.component END AS component FROM placed p) """ + _violations([
        ("one thread per key", "threads", "package_id || '/' || k AS key FROM (SELECT package_id, CASE WHEN component % 7 = 0 "
         "THEN 'SAME' ELSE thread_key END AS k FROM thread) GROUP BY package_id, k HAVING count(*) > 1"),
        ("one thread per letter", "memberships", "CAST(letter_id AS VARCHAR) FROM members WHERE letter_id % 59 = 0"),
        ("member of a thread of its package", "memberships", "component || '/' || letter_id FROM members, "
         "range(CASE WHEN letter_id % 59 = 0 THEN 2 ELSE 1 END) WHERE component = -2 OR package_id = -1"),
        ("member is a letter of its package", "memberships", "component || '/' || letter_id FROM members, "
         "range(CASE WHEN letter_id % 59 = 0 THEN 2 ELSE 1 END) WHERE package_id = -1"),
    ]),
    "j1_link_table_rules": f"""{WITH_LINKS}, {CONFIRMATIONS},
        offer AS (SELECT *, citing_letter_id || '/' || cited_ref_normalized || '/' || candidate_letter_id AS k FROM candidates),
        taught AS (SELECT package_id, cited_ref_normalized, arg_max(candidate_letter_id, confirmed_at) AS letter_id FROM accepted GROUP BY 1, 2),
        moved AS (SELECT CASE WHEN letter_id % 3 = 0 THEN -1 ELSE package_id END AS package_id, cited_ref_normalized, letter_id FROM taught) """
    + _violations([
        ("one row per candidate", "candidates", "k AS key FROM offer WHERE citing_letter_id % 67 = 0"),
        ("candidate in the same package", "candidates", "k FROM offer, range(CASE WHEN citing_letter_id % 67 = 0 THEN 2 ELSE 1 END) "
         "WHERE citing_letter_id % 61 = 0"),
        ("one row per occurrence", "occurrences", "citing_letter_id || '/' || cited_ref_normalized || '/0' FROM links WHERE citing_letter_id % 71 = 0"),
        ("one alias per reference", "aliases", "package_id || '/' || cited_ref_normalized FROM moved GROUP BY package_id, cited_ref_normalized HAVING count(*) > 1"),
        ("alias in the same package", "aliases", "package_id || '/' || cited_ref_normalized FROM moved WHERE package_id = -1"),
    ]),
    "j1_embedding_rules": """
        SELECT 'one current embedding' AS rule, 'embeddings' AS table_name, CAST(vec_id // 2 AS VARCHAR) AS key
        FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY vec_id // 2 HAVING count(*) > 1""",
    "j2_register_diff": f"""{WITH_THREADS}, {DIFF_SIDES},
        j AS (SELECT a.*, b.package_id AS other, b.dated AS dated2, b.thread_key AS key2 FROM a LEFT JOIN b USING (package_id, serial))
        SELECT package_id, serial, '*' AS column_name, 'present' AS left_value, NULL AS right_value FROM j WHERE other IS NULL
        UNION ALL SELECT package_id, serial, 'dated', CAST(dated AS VARCHAR), CAST(dated2 AS VARCHAR) FROM j
          WHERE other IS NOT NULL AND dated IS DISTINCT FROM dated2
        UNION ALL SELECT package_id, serial, 'thread_key', thread_key, key2 FROM j WHERE other IS NOT NULL AND thread_key <> key2""",
    "j2_field_diff": f"""{WITH_FIELDS},
        a AS (SELECT * FROM fields WHERE is_current AND letter_id IS NOT NULL),
        j AS (SELECT *, field_id % 443 = 0 AS gone FROM a)
        SELECT package_id, letter_id, field_key, field_index, '*' AS column_name, 'present' AS left_value, NULL AS right_value FROM j WHERE gone
        UNION ALL SELECT package_id, letter_id, field_key, field_index, 'value', value, value || '!' FROM j WHERE NOT gone AND field_id % 101 = 0
        UNION ALL SELECT package_id, letter_id, field_key, field_index, 'validation', validation, 'unresolved' FROM j
          WHERE NOT gone AND field_id % 131 = 0 AND validation <> 'unresolved'
        UNION ALL SELECT package_id, letter_id, field_key, field_index, 'page_no', CAST(page_no AS VARCHAR), NULL FROM j
          WHERE NOT gone AND field_id % 131 = 0 AND page_no IS NOT NULL""",
    "j2_nested_diff": f"""{WITH_WORDS}, {LOCATED},
        place AS (SELECT document_id, page_no AS page, claim_no, char_end, n_rects > 0 AS ok, concat_ws(',',
            CAST(round(x0 * 1000000) AS BIGINT), CAST(round(y0 * 1000000) AS BIGINT), CAST(round((x1 - x0) * 1000000) AS BIGINT),
            CAST(round((y1 - y0) * 1000000) AS BIGINT)) AS box
          FROM touched WHERE document_id % 23 = 0)
        SELECT document_id, page, claim_no, '*' AS column_name, 'present' AS left_value, NULL AS right_value FROM place
          WHERE claim_no = 2 AND page % 2 = 1
        UNION ALL SELECT document_id, page, claim_no, 'char_end', CAST(char_end AS VARCHAR), CAST(char_end + 1 AS VARCHAR) FROM place
          WHERE ok AND claim_no = 0
        UNION ALL SELECT document_id, page, claim_no, 'box', box, NULL FROM place WHERE ok AND claim_no = 1""",
    "j3_version_comparison": f"""{WITH_FIELDS},
        j AS (SELECT field_key, validation AS was, CASE WHEN letter_id % 9 = 0 THEN NULL WHEN letter_id % 4 = 0 THEN 'exact' ELSE validation END AS now FROM fields)
        SELECT field_key, was, count(*) FILTER (now = 'exact') AS now_exact, count(*) FILTER (now = 'normalized_exact') AS now_normalized_exact,
          count(*) FILTER (now = 'unresolved') AS now_unresolved, count(*) FILTER (now IS NULL) AS now_absent FROM j GROUP BY 1, 2""",
    "b_reference_forms": f"""{ONLY_BRIDGE}
        SELECT letter_id, upper(trim(replace(cited_text, '/', ' / '))) || ' DATED 12' AS normalized, {_bare('cited_text')} AS bare,
          cited_text AS chosen, nullif({_serial('cited_text')}, '') AS serial, {_body('cited_text')} AS body FROM cited""",
    "b_field_values": f"""{ONLY_BRIDGE}
        SELECT letter_id, CASE WHEN letter_id % 6 > 2 THEN od END AS as_date, {_shown('dated')} AS shown,
          date_diff('day', dated, received) AS days, {_chainage('chainage')} AS metres,
          CASE WHEN chainage IS NOT NULL THEN least(coalesce({_chainage('chainage')}, 7005), 7005) END AS lo,
          CASE WHEN chainage IS NOT NULL THEN greatest(coalesce({_chainage('chainage')}, 7005), 7005) END AS hi,
          CASE WHEN from_code = 'CTR' THEN 'CTR' END AS from_found,
          CASE WHEN from_code = 'CTR' THEN 'outward' WHEN to_code = 'CTR' THEN 'inward' END AS direction_found,
          page_from <= 3 AND page_to >= 2 AS on_two_or_three FROM letters""",
}
