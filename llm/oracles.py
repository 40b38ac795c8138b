"""SQL for the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"

OP1 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w)
),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM dup),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
kept AS (
  SELECT doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (g.j IS NULL) AS t
  FROM each LEFT JOIN gone g USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_text,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id
  FROM documents
),
e AS (
  SELECT doc_id, next_id, text,
    substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited
  FROM n
),
t AS (SELECT doc_id, false AS is_edited, text FROM e UNION ALL SELECT doc_id, true, edited FROM e),
sections AS (
  SELECT doc_id, is_edited, list_filter(string_split(regexp_replace(text, '(\n\n+)', '\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '') AS parts
  FROM t
),
paragraphs AS (
  SELECT doc_id, is_edited, list_transform(parts, lambda s: list_transform(
    list_filter(string_split(replace(s, chr(10), chr(10) || chr(57344)), chr(57344)), lambda x: x <> ''),
    lambda p: list_transform(regexp_extract_all(p, '(?s).{1,64}'), lambda q: sha256(q)))) AS parts
  FROM sections
),
hashed AS (
  SELECT doc_id, is_edited, list_transform(parts, lambda s: list_transform(s, lambda p: {
    'h': sha256('p' || array_to_string(p, '')), 'l': array_to_string(list_transform(p, lambda q: '.' || q[:8]), '')})) AS parts
  FROM paragraphs
),
joined AS (
  SELECT doc_id, is_edited, list_transform(parts, lambda s: {
    'h': sha256('s' || array_to_string(list_transform(s, lambda p: p.h), '')),
    'b': array_to_string(list_transform(s, lambda p: ',' || p.h[:12] || p.l), '')}) AS parts
  FROM hashed
),
marks AS (
  SELECT doc_id, is_edited,
    sha256('r' || array_to_string(list_transform(parts, lambda s: s.h), ''))
      || array_to_string(list_transform(parts, lambda s: ';' || s.h[:16] || s.b), '') AS mark
  FROM joined
),
pieces AS (SELECT doc_id, is_edited, mark, list_distinct(regexp_extract_all(mark, '\.([0-9a-f]{8})', 1)) AS p FROM marks)
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256,
  a.mark AS fingerprint, b.mark AS edited_fingerprint,
  CASE WHEN len(a.p) + len(b.p) = 0 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p)) END AS near_edited,
  CASE WHEN len(a.p) + len(c.p) = 0 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(a.p, c.p)) / (len(a.p) + len(c.p)) END AS near_next
FROM e JOIN pieces a ON a.doc_id = e.doc_id AND NOT a.is_edited
JOIN pieces b ON b.doc_id = e.doc_id AND b.is_edited
JOIN pieces c ON c.doc_id = e.next_id AND NOT c.is_edited
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace('text', _LOWER, 1)} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT id, b FROM reach JOIN links ON other = a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id) LEFT JOIN n USING (doc_id)
"""

OP7 = f"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


def _crc_table() -> list[int]:
    """CRC-32 of each byte, reflected polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


_CRC = (
    f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: ascii(c))), "
    f"lambda s, b: xor(s >> 8, {_crc_table()}[xor(s, b) % 256 + 1])), 4294967295)"
)
_BLANKS = r"[\x20\x09-\x0D]"
# Costs to go before position p, by state of the grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_X = "(sign = 'x')"
_EXTRA = "CASE WHEN sign BETWEEN 'A' AND 'Z' THEN 5 ELSE 0 END"


def _kept(state: int) -> str:
    ways = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    cases = " ".join(f"WHEN lower(sign) = '{initial}' THEN c{to} + {_EXTRA}" for initial, to in ways.items())
    return f"CASE {cases} ELSE 1000000 END"


def _rerole(state: int) -> str:
    return f"CASE WHEN {_X} THEN 1000000 ELSE 1 + c{3 if state == 2 else 2} + {_EXTRA} END"


def _taken(state: int) -> str:
    return f"least(2 + c{state}, {_kept(state)}, {_rerole(state)})"


_HERE = "c.c0, c.c1, c.c2, c.c3"
OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM kinds WHERE kind <> 0)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS p, left(role, 1) AS initial,
    regexp_replace(text, '{_BLANKS}+$', '') AS t
  FROM damaged
),
signed AS (
  SELECT conv_id, turn, role, text, p, initial,
    CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN t = '' OR again THEN 'x' WHEN right(t, 1) IN ('.', '!', '?') THEN r ELSE upper(r) END AS sign,
    p > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM (
    SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS r,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again
    FROM ranked
  )
),
counts AS (
  SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM signed GROUP BY conv_id
),
costs(conv_id, p, c0, c1, c2, c3) AS (
  SELECT conv_id, n + 1, 0, 10, 5, 0 FROM counts
  UNION ALL
  SELECT conv_id, p, least(t0, 5 + t2, 10 + t3), least(t1, 5 + t2, 10 + t3), least(t2, 5 + t3), least(t3, 5 + t2)
  FROM (
    SELECT c.conv_id, s.p, {', '.join(f'{_taken(i)} AS t{i}' for i in range(4))}
    FROM costs c JOIN signed s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.p = c.p - 1
  )
),
walk(conv_id, p, state, audit, lines) AS (
  SELECT conv_id, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]) FROM counts
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN p ELSE p + 1 END,
    CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN CASE lower(sign) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
      WHEN state = 2 THEN 3 ELSE 2 END,
    audit || edit,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, s.sign, s.role, s.text,
      CASE WHEN s.p IS NOT NULL AND 2 + [c0, c1, c2, c3][state + 1] = [b0, b1, b2, b3][state + 1] THEN 'D'
        WHEN 5 + [b2, b2, b3, b2][state + 1] = [b0, b1, b2, b3][state + 1] THEN 'I'
        WHEN CASE state {' '.join(f'WHEN {i} THEN {_kept(i)}' for i in range(4))} END = [b0, b1, b2, b3][state + 1] THEN 'K' ELSE 'R' END AS edit
    FROM walk w
    JOIN (SELECT conv_id, p, c0 AS b0, c1 AS b1, c2 AS b2, c3 AS b3 FROM costs) b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.p = w.p
    LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.p = w.p + 1
    LEFT JOIN signed s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.p = w.p
    WHERE s.p IS NOT NULL OR w.state IN (1, 2)
  )
),
last_ AS (
  SELECT w.conv_id, w.audit, w.lines FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.p = n.n + 1 AND w.state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY length(w.audit) DESC) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(c.c0, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.p = 1
LEFT JOIN last_ l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _round(number: int) -> str:
    """Assign every vector to a centroid of the round before, and move the centroids."""
    before = f"centroids{number - 1}"
    return f"""
assigned{number} AS (
  SELECT id, vec_id, x, min_by(c, (list_sum(list_transform(list_zip(x, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c)) AS c,
    CAST(min(list_sum(list_transform(list_zip(x, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS BIGINT) AS distance
  FROM vectors, {before} GROUP BY id, vec_id, x
),
moved{number} AS (
  SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY place) AS centre FROM (
    SELECT c, place, CAST(sum(value) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT c, unnest(x) AS value, unnest(range(1, 65)) AS place FROM assigned{number}) GROUP BY c, place
  ) GROUP BY c
),
centroids{number} AS (SELECT c, coalesce(m.centre, b.centre) AS centre FROM {before} b LEFT JOIN moved{number} m USING (c))"""


OP12 = f"""
WITH vectors AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
),
centroids0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x AS centre
  FROM vectors ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x LIMIT 16
),{','.join(_round(i) for i in (1, 2, 3, 4))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
FROM assigned4 JOIN centroids3 USING (c)
"""

ORACLES = {
    "op1_substring_dedup": OP1, "op2_fingerprints": OP2, "op6_near_dedup": OP6, "op7_exact_dedup": OP7,
    "op11_conversation_repair": OP11, "op12_clusters": OP12,
}
