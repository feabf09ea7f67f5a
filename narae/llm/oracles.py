"""DuckDB SQL for the dealt operators that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM totals),
placed AS (
  SELECT *, row_number() OVER o AS place, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
         CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_weight
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (
  SELECT place AS first_free, below AS used, left_weight AS shared FROM placed
  WHERE (total - below) * weight <= cap * left_weight ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN place < first_free THEN CAST(cap AS DOUBLE)
              ELSE CAST((total - used) * weight AS DOUBLE) / shared END AS target
  FROM placed, level),
run AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((CAST(floor(target) AS BIGINT) // greatest(source_size, 1)) * size
         + greatest(0, least(size, CAST(floor(target) AS BIGINT) % greatest(source_size, 1) - before)) AS BIGINT) AS taken,
       run.source AS source
FROM run JOIN targets ON run.source IS NOT DISTINCT FROM targets.source
"""

SQL["op4_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM d, sizes, unnest(generate_series(1, len(w) - size + 1)) AS t(i) WHERE len(w) >= size),
hits AS (SELECT doc_id, starts.size, i, item_id FROM starts JOIN windows USING (size, win)),
words AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM hits),
counted AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
items AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(array_to_string(list_sort(coalesce(ids, [])), ',')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# DuckDB has no base32, so the digits are taken from the hex form of its sha1.
SQL["op5_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (
  SELECT h, list_transform(generate_series(0, 7), lambda k: CAST('0x' || substr(h, 1 + 5 * k, 5) AS INTEGER)) AS n
  FROM (SELECT DISTINCT h FROM p)),
named AS (
  SELECT h, array_to_string(list_transform(n, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS digest
  FROM digits),
firsts AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN named USING (h) JOIN firsts USING (h)
"""

SQL["op9_substring"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM d, unnest(generate_series(1, len(w) - 12)) AS t(i)),
firsts AS (SELECT win, min(doc_id) AS first FROM starts GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS pos
  FROM starts JOIN firsts USING (win) WHERE first < doc_id),
lists AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(generate_series(1, len(w)), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

SQL["op6_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM overlap JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 90 * (p.n + q.n - common)),
ways AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (
  SELECT DISTINCT a, a FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII expression."""
    step = "lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    byte = f"lambda c, b: list_reduce(generate_series(1, 8)::UBIGINT[], {step}, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ord(ch)::UBIGINT), {byte}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def _conversations() -> str:
    """The cheapest edits turn by turn: of each state the best of all audits so far, compared as they are."""
    named = "replace(replace({0}, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10))"
    return f"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM filled WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM hurt),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former FROM placed),
said(state, role, then_state) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
runs(state, then_state, k, roles) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'u'), (1, 2, 1, 'u'), (2, 3, 1, 'a'), (3, 2, 1, 'u'),
  (0, 3, 2, 'ua'), (1, 3, 2, 'ua'), (2, 2, 2, 'au'), (3, 3, 2, 'ua')),
kinds AS (SELECT initial, fault FROM judged GROUP BY ALL),
moves AS (
  SELECT initial, fault, r.state, r.then_state, 5 * k + 2 AS cost, repeat('I', k) || 'D' AS code, roles AS inserted, '' AS role FROM kinds, runs r
  UNION ALL
  SELECT initial, fault, r.state, t.then_state, 5 * k + CASE WHEN fault = 3 THEN 5 ELSE 0 END, repeat('I', k) || 'K', roles, 'k' FROM kinds JOIN said t ON t.role = initial JOIN runs r ON r.then_state = t.state WHERE fault NOT IN (1, 2)
  UNION ALL
  SELECT initial, fault, r.state, t.then_state, 5 * k + 1 + CASE WHEN fault = 3 THEN 5 ELSE 0 END, repeat('I', k) || 'R', roles, t.role FROM kinds, runs r JOIN said t ON r.then_state = t.state WHERE t.role <> 's' AND fault NOT IN (1, 2)),
steps AS (
  SELECT conv_id, i, state, then_state, cost, code,
         {named.format("inserted")} || CASE m.role WHEN '' THEN '' WHEN 'k' THEN j.role || ':' || text || chr(10) WHEN 'u' THEN 'user:' || text || chr(10) ELSE 'assistant:' || text || chr(10) END AS lines
  FROM judged j JOIN moves m ON m.initial = j.initial AND m.fault = j.fault),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, then_state, cost, audit, lines FROM (
    SELECT w.conv_id, s.i, s.then_state, w.cost + s.cost AS cost, w.audit || s.code AS audit, w.lines || s.lines AS lines,
           row_number() OVER (PARTITION BY w.conv_id, s.then_state ORDER BY w.cost + s.cost, w.audit || s.code) AS n
    FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.state = w.state) WHERE n = 1),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, w.cost + 5 * k AS cost, audit || repeat('I', k) AS audit, lines || {named.format("roles")} AS lines FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN runs r ON r.state = w.state
  WHERE w.i = coalesce(c.n, 0) AND r.then_state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * k, audit || repeat('I', k)) = 1)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(cost AS BIGINT) AS cost, audit, sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL["op12_repair_conversations"] = _conversations()


def _tree(name: str, leaves: str, levels: int) -> str:
    """Tables name_0.. of a forest's levels (tree, i, h, n) over leaves (tree, i, h), and name_runs_0.. of their runs."""
    out = [f"{name}_0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}_runs_{k} AS (SELECT tree, i // 8 AS p, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}_{k} GROUP BY tree, i // 8)")
        out.append(f"{name}_{k + 1} AS (SELECT tree, p AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, count(*) OVER (PARTITION BY tree) AS n FROM {name}_runs_{k})")
    return ", ".join(out)


def _walk(name: str, start: str, runs: str, levels: int) -> str:
    """Tables name_1.. that carry (row, tree, i, proof, now) of a start table up a forest's levels."""
    out = []
    for k in range(levels):
        before = start if not k else f"{name}_{k}"
        left, right = "array_to_string(hs[1:CAST(i % 8 AS BIGINT)], '')", "array_to_string(hs[CAST(i % 8 AS BIGINT) + 2:], '')"
        out.append(f"{name}_{k + 1} AS (SELECT row, w.tree, i // 8 AS i, proof || {left} || {right} AS proof, CASE WHEN n = 1 THEN now ELSE sha256({left} || now || {right}) END AS now FROM {before} w JOIN {runs}_runs_{k} r ON r.tree = w.tree AND r.p = i // 8)")
    return ", ".join(out)


def _merkle(levels: int = 8, more: int = 3) -> str:
    """For trees of up to 8^8 leaves, and 8^3 trees."""
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    changed = f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    return f"""
WITH made AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS tree, sha256({head} || {part('text')}) AS leaf, sha256({head} || {part('other')}) AS shown
  FROM (SELECT *, {changed} AS other FROM documents)),
rows AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM made),
leaves AS (SELECT tree, i, leaf AS h FROM rows), {_tree('d', 'leaves', levels)},
subroots AS (SELECT tree AS own, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM d_{levels}),
tops AS (SELECT '' AS tree, i, h FROM subroots), {_tree('t', 'tops', more)},
begun AS (SELECT row, tree, i, '' AS proof, shown AS now FROM rows), {_walk('w', 'begun', 'd', levels)},
again AS (SELECT row, '' AS tree, s.i, proof, now FROM w_{levels} w JOIN subroots s ON s.own = w.tree), {_walk('v', 'again', 't', more)}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.h AS verified
FROM rows r JOIN v_{more} v ON v.row = r.row JOIN subroots s ON s.own = r.tree, t_{more} t
"""


SQL["op13_merkle"] = _merkle()
