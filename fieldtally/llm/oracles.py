"""SQL twins (DuckDB) of the queries that SQL can express, written from the contracts and docstrings."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
          ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reached(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION
                           SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN counted ON a = vec_id
"""


def _located(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return rf"""
SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, pos + 1 AS no, value,
       (list_sum(list_transform(pieces[1:pos + 1], lambda x: length(x))) +
        coalesce(list_sum(list_transform(matches[1:pos], lambda x: length(x))), 0))::BIGINT AS start, length(matches[pos + 1]) AS chars
FROM (SELECT doc_id, source, pieces, matches, unnest(range(len(matches))) AS pos, unnest(vals) AS value FROM (
        SELECT doc_id, source, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS matches,
               regexp_extract_all(t, '{p}', {group}) AS vals FROM d WHERE regexp_matches(t, '{p}')))
WHERE {keep}"""


_ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
           r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
OP2 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_located("assign", 0, _ASSIGN, 2, "length(value) >= 6")}
UNION ALL {_located("access", 1, "AKIA[A-Z0-9]+", 0, "length(value) >= 20")}
UNION ALL {_located("hex", 2, "[0-9a-f]+", 0, "length(value) >= 24")}),
loose AS ({_located("owned", 3, "[A-Za-z0-9+/_=-]+", 0,
                    "length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')")}),
apart AS (SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id
          AND b.start < l.start + l.chars AND l.start < b.start + b.chars)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM apart),
owners AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) >= 3 AS copied FROM every GROUP BY value),
judged AS (SELECT e.*, copied, kind || ':' || start || ':' || (start + chars) AS span FROM every e JOIN owners USING (value)),
per_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'owned' AND NOT copied) AS n_owned,
  count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied,
  string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'owned') AS base,
  string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'owned' OR NOT copied) AS spans FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per_doc USING (doc_id)
"""

OP3 = r"""
WITH own AS (SELECT '\### Assistant: </turn> ok' AS text),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', text FROM own UNION ALL SELECT -7, 1, 'assistant', text FROM own)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || role || ': ' || text || '</turn>') + 1 + len(regexp_extract_all(text, '\\|</turn>')) +
           coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0))::BIGINT
         AS formatted_chars
FROM c GROUP BY conv_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS shared FROM s),
o AS (SELECT *, row_number() OVER ranked AS place,
             shared - coalesce(sum(cap) OVER (ranked ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ranked ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM w WINDOW ranked AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT min(place) AS place, arg_min(rest, place) AS rest, arg_min(open, place) AS open FROM o
      WHERE weight * rest / open <= cap),
t AS (SELECT source, source_size, CASE WHEN o.place >= f.place THEN weight * f.rest / f.open ELSE cap END AS target,
             floor(least(shared, sum(cap) OVER ())) AS budget FROM o, f),
q AS (SELECT d.*, source_size, target, budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (epoch * source_size + upto) / target AS finish FROM q, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0),
g AS (SELECT doc_id, budget, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, epoch
                                             ROWS UNBOUNDED PRECEDING) AS words FROM e),
n AS (SELECT doc_id, count(*) AS copies FROM g WHERE words <= budget GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(copies, 0) * size AS taken, source, coalesce(copies, 0) AS copies
FROM q LEFT JOIN n USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
                     FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
             list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION
                           SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN lowest USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, no, regexp_extract_all(lines[no + 1], '{_WORD}') AS w
      FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS no FROM d)),
k AS (SELECT doc_id, no, w, array_to_string(w, ' ') AS line, {{'doc': doc_id, 'no': no}} AS place FROM l WHERE len(w) > 0),
f AS (SELECT line, min(place) AS place, any_value(w) AS w FROM k GROUP BY line),
v AS (SELECT line, place, pos, array_to_string(w[1:pos] || w[pos + 2:], ' ') AS key
      FROM (SELECT *, unnest(range(len(w))) AS pos FROM f WHERE len(w) >= 8)),
near AS (SELECT line FROM v JOIN (SELECT key, pos, min(place) AS low FROM v GROUP BY key, pos) USING (key, pos) WHERE place > low
         UNION SELECT CASE WHEN v.place > f.place THEN v.line ELSE f.line END FROM v JOIN f ON f.line = v.key AND len(f.w) >= 8),
j AS (SELECT k.doc_id, k.no, k.place <> f.place AS exact, near.line IS NOT NULL AS near
      FROM k JOIN f USING (line) LEFT JOIN near USING (line)),
r AS (SELECT doc_id, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_near,
             string_agg(no::VARCHAR, ',' ORDER BY no) AS dropped FROM j WHERE exact OR near GROUP BY doc_id)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       coalesce(dropped, '') AS dropped FROM d LEFT JOIN r USING (doc_id)
"""

# Among thirteen words of which two differ, four in a row are equal: candidates by four-word runs, then every alignment is counted.
OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM benchmark),
dg AS (SELECT doc_id, pos, w[pos + 1:pos + 4] AS g FROM (SELECT *, unnest(range(len(w) - 3)) AS pos FROM d WHERE len(w) >= 13)),
bg AS (SELECT item_id, pos, w[pos + 1:pos + 4] AS g FROM (SELECT *, unnest(range(len(w) - 3)) AS pos FROM b WHERE len(w) >= 13)),
c AS (SELECT DISTINCT doc_id, item_id, (dg.pos - bg.pos)::INT AS shift FROM dg JOIN bg USING (g)),
o AS (SELECT doc_id, item_id, shift, greatest(shift, 0) AS first_word,
             least(len(b.w) + shift, len(d.w)) - greatest(shift, 0) AS n_words, d.w AS dw, b.w AS bw
      FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
q AS (SELECT doc_id, item_id, first_word, n_words, list_transform(range(1, n_words + 1),
             lambda i: (dw[first_word + i] = bw[first_word - shift + i])::INT) AS same FROM o WHERE n_words >= 13),
m AS (SELECT *, list_sum(same) AS n_equal, list_max(list_transform(range(1, n_words - 11), lambda i: list_sum(same[i:i + 12]))) AS most FROM q)
SELECT doc_id, item_id, first_word::INT AS first_word, n_words::INT AS n_words, n_equal::INT AS n_equal FROM m WHERE most >= 11
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_words DESC, first_word) = 1
"""

OP11 = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x FROM embeddings
              WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS positive, list_dot_product(a.x, r.x)::BIGINT AS score
           FROM rows a JOIN rows r ON len(a.x) = len(r.x) AND a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE positive
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
           FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.positive
           AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

ORACLE = {"op1_pigeonhole_vectors": OP1, "op2_secret_ownership": OP2, "op3_chat_round_trip": OP3,
          "op4_weighted_fair_queue": OP4, "op6_adaptive_prefix_join": OP6, "op8_deletion_neighbours": OP8,
          "op10_spaced_seeds": OP10, "op11_angular_negatives": OP11}
