"""The SQL that DuckDB runs beside the queries of this subpackage."""

SQL: dict[str, str] = {}

SQL["op3_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= 75 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = sh.doc_id) AS component_id FROM sh
"""

SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN f USING (h) WHERE doc_id > first_doc),
g AS (SELECT doc_id, list(i) AS gs, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN gs IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gs, i)), ' ') END, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

SQL["op9_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + 9), ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS x
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw USING (m, x)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, spelled out."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda s, b: list_reduce([xor(s, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"


CRC32 = crc32("CAST(doc_id AS VARCHAR)")

SQL["op10_lm_scoring"] = rf"""
WITH d AS (SELECT doc_id, {CRC32} % 10 = 0 AS held_out, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') || [chr(10)] AS w FROM documents),
tok AS (SELECT doc_id, held_out, w[i] AS t, CASE WHEN i = 1 THEN chr(9) ELSE w[i - 1] END AS p, CASE WHEN i = 1 THEN '' WHEN i = 2 THEN chr(9) ELSE w[i - 2] END AS q
        FROM (SELECT doc_id, held_out, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t), c2 AS (SELECT p, t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY p, t),
c3 AS (SELECT q, p, t, count(*) AS c FROM tok WHERE NOT held_out AND q <> '' GROUP BY q, p, t),
st AS (SELECT t AS p, c FROM c1 UNION ALL SELECT chr(9), count(*) FROM d WHERE NOT held_out),
n AS (SELECT sum(c)::DOUBLE AS n, count(*) AS v FROM c1),
x AS (SELECT doc_id, held_out, coalesce(c1.c, 0) AS c, tok.q AS q, (coalesce(c1.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)) AS pr,
             (coalesce(c2.c, 0) + 10.0::DOUBLE * pr) / (coalesce(st.c, 0) + 10.0::DOUBLE) AS p2,
             CASE WHEN tok.q = '' THEN p2 ELSE (coalesce(c3.c, 0) + 10.0::DOUBLE * p2) / (coalesce(cq.c, 0) + 10.0::DOUBLE) END AS p3
      FROM tok LEFT JOIN c1 ON tok.t = c1.t LEFT JOIN c2 ON tok.p = c2.p AND tok.t = c2.t LEFT JOIN st ON tok.p = st.p
      LEFT JOIN c3 ON tok.q = c3.q AND tok.p = c3.p AND tok.t = c3.t LEFT JOIN c2 cq ON tok.q = cq.p AND tok.p = cq.t, n)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE c > 0)::BIGINT AS n_known, (SELECT CAST(n AS BIGINT) FROM n) AS train_tokens,
       fsum(log10(pr)) AS base_score, fsum(log10(p3)) AS score FROM x GROUP BY doc_id, held_out
"""

_ADD = lambda cost, letter, v: f"lpad(CAST(CAST(substr({v}, 1, 12) AS BIGINT) + ({cost}) AS VARCHAR), 12, '0') || '{letter}' || substr({v}, 13)"
_ROW = lambda q, keep, new: f"least({_ADD(2, 'D', f'v{q}')}, CASE WHEN gone THEN '9' ELSE {keep} END, CASE WHEN gone THEN '9' ELSE {_ADD('1 + more', 'R', f'v{new}')} END) AS w{q}"
_KEEP = lambda letter, to: f"CASE WHEN r = '{letter}' THEN {_ADD('more', 'K', f'v{to}')} ELSE '9' END"

# Cheapest edits from the end of each conversation: of each state (nothing yet, after system, user, assistant) the cost
# in twelve digits and the letters, so that the least text is the cheapest edit and the first in ASCII order.
SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM b),
y AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS r, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS nth FROM x),
rows AS (SELECT conv_id, turn, role, text, r, i, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate,
                bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
                i > 1 AND lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS illegal FROM y),
cols AS (SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS more FROM rows),
n AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank,
             count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM rows GROUP BY conv_id),
e AS (SELECT conv_id, n + 1 AS i, '000000000000' AS v0, '000000000010II' AS v1, '000000000005I' AS v2, '000000000000' AS v3 FROM n
  UNION ALL
  SELECT conv_id, i, least(w0, {_ADD(5, 'I', 'w2')}), least(w1, {_ADD(5, 'I', 'w2')}), least(w2, {_ADD(5, 'I', 'w3')}), least(w3, {_ADD(5, 'I', 'w2')})
  FROM (SELECT c.conv_id, c.i, {_ROW(0, f"least({_KEEP('s', 1)}, {_KEEP('u', 2)})", 2)}, {_ROW(1, _KEEP('u', 2), 2)}, {_ROW(2, _KEEP('a', 3), 3)}, {_ROW(3, _KEEP('u', 2), 2)}
        FROM e JOIN cols c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.i = e.i - 1)),
found AS (SELECT conv_id, CAST(substr(v0, 1, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM e WHERE i = 1),
l AS (SELECT conv_id, j, substr(audit, CAST(j AS INT), 1) AS letter, length(replace(substr(audit, 1, CAST(j AS INT)), 'I', '')) AS i, length(replace(substr(audit, 1, CAST(j AS INT)), 'D', '')) AS o,
             length(replace(audit, 'D', '')) AS whole FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM found)),
t AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o + whole) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS s
      FROM l LEFT JOIN rows ON rows.conv_id IS NOT DISTINCT FROM l.conv_id AND rows.i = l.i WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(s, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
"""

_CENTS = lambda x: f"coalesce(CAST(floor(100 * {x} + 0.5) AS BIGINT), 0)"

SQL["op12_point_in_time"] = rf"""
WITH s AS (SELECT row_number() OVER () AS q, sale_id, client_id, epoch_us(sold_at) AS sold, epoch_us(sold_at) + {crc32("coalesce(CAST(sale_id AS VARCHAR), '')")} % 259200 * 1000000 AS t,
                  epoch_us(arrived_at) + 14400000000 AS known, {_CENTS("total")} AS cents FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
c AS (SELECT client_id, click_id, epoch_us(ts) AS ts, epoch_us(arrived_at) + 14400000000 AS known, kind, {_CENTS("value")} AS cents FROM (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks)),
l AS (SELECT client_id, sold, known, item_id, epoch_us(shipped_at) AS shipped, {_CENTS("amount")} AS cents FROM sale_lines JOIN s USING (sale_id)),
w AS (SELECT s.*, d, t - d * 86400000000 AS low FROM s, (SELECT unnest([2, 14]) AS d)),
fc AS (SELECT w.q, d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, sum(c.cents) AS click_cents, max(row(ts, click_id)) AS last
       FROM w JOIN c ON c.client_id = w.client_id WHERE ts > low AND ts <= t AND c.known <= t GROUP BY w.q, d),
fs AS (SELECT w.q, d, count(*) AS n_sales, sum(o.cents) AS sale_cents FROM w JOIN s o ON o.client_id = w.client_id WHERE o.sold > low AND o.sold <= w.t AND o.known <= w.t GROUP BY w.q, d),
fl AS (SELECT w.q, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(l.cents) AS line_cents
       FROM w JOIN l ON l.client_id = w.client_id WHERE l.sold > low AND l.sold <= t AND l.known <= t AND shipped <= t GROUP BY w.q, d)
SELECT w.sale_id, CAST(w.d AS INT) AS d, CAST(w.t AS BIGINT) AS t_us, EXISTS (SELECT 1 FROM s o WHERE o.client_id = w.client_id AND o.sold > w.t AND o.sold <= w.t + 604800000000) AS label,
       coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, struct_extract(last, 2) AS last_click_id,
       coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN fc ON fc.q = w.q AND fc.d = w.d LEFT JOIN fs ON fs.q = w.q AND fs.d = w.d LEFT JOIN fl ON fl.q = w.q AND fl.d = w.d
"""
