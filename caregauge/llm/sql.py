"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .secrets import BASE, MORE, Rule

MIX_SOURCES = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * CAST(1.5 AS DOUBLE)
             - coalesce(sum(source_size) OVER before, 0)::BIGINT * CAST(2.0 AS DOUBLE))
            / (sum(weight) OVER onward)::BIGINT AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), settled AS (
  SELECT max(level) FILTER (WHERE source_size * CAST(2.0 AS DOUBLE) > level * weight) AS settled FROM levels
), targets AS (
  SELECT source, source_size,
         CASE WHEN source_size * CAST(2.0 AS DOUBLE) > level * weight THEN settled * weight
              ELSE source_size * CAST(2.0 AS DOUBLE) END AS target,
         ('0x' || substr(md5('mix-1:' || coalesce(source, chr(0))), 1, 5))::INTEGER
           / CAST(1048576.0 AS DOUBLE) AS shift
  FROM levels, settled
), placed AS (
  SELECT doc_id, size, source_size, target, shift,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) - 1 AS place
  FROM sized JOIN targets USING (source)
)
SELECT doc_id, size, source_size, target,
       (least(floor((place + 1) * rate + shift) - floor(place * rate + shift), ceil(rate)) * size)::BIGINT AS taken
FROM placed
"""

EXACT_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""



def _secret_scan() -> str:
    """Positions add up from the pieces between matches and the matches, as regular expressions give no offsets."""

    def spans(rule: Rule) -> str:
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        return f"""(
      SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
               'at': (coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0)
                      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER,
               'n': length(m[i])::INTEGER, 'counted': length(g[i])::INTEGER}}), lambda s: s.counted >= {rule.least})
      FROM (SELECT regexp_split_to_array(body, {pattern}) AS b, regexp_extract_all(body, {pattern}) AS m,
                   regexp_extract_all(body, {pattern}, {rule.group}) AS g))"""

    rules = BASE + MORE
    columns = ",\n    ".join(f"{spans(r)} AS s{i}" for i, r in enumerate(rules))

    def labels(upto: int) -> str:
        parts = ", ".join(
            f"list_transform(s{i}, lambda s: {{'at': s.at, 'rank': {i}, 'label': '{r.kind}:' || s.at || ':' || (s.at + s.n)}})"
            for i, r in enumerate(rules[:upto])
        )
        return f"array_to_string(list_transform(list_sort(flatten([{parts}])), lambda s: s.label), ',')"

    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS (SELECT doc_id, {columns} FROM texts)
SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex,
       sha256({labels(len(BASE))}) AS base_sha256, {labels(len(rules))} AS spans
FROM found
"""


CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|</?SYS>>)', '\1\\\2', 'g'),
                                  '(\[)(/?INST\]|/?ROLE\]|TEXT\])', '\1\\\2', 'g'))
            + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
              ELSE length(role) + 19 END AS chars,
         lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) || '>' || role AS step
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
         AND arg_max(role, turn) IN ('user', 'assistant') AS valid
FROM written GROUP BY conv_id
"""


def _centroid_clusters(k: int = 8, rounds: int = 10) -> str:
    """Each round is a pair of tables: the nearest centroid of every vector, and the floored means."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x,
         row_number() OVER () AS row
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: isfinite(c))) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INTEGER AS cluster, x AS c
  FROM kept ORDER BY sha256('3:' || vec_id), x LIMIT {k}
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT row, vec_id, x, min({{'d': d, 'k': cluster}}) AS best
  FROM (SELECT row, vec_id, x, cluster,
               list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM kept, c{r})
  GROUP BY ALL
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c
  FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c
    FROM (SELECT best.k AS cluster, place, sum(x[place])::BIGINT AS s, count(*) AS n
          FROM a{r}, range(1, 65) AS places(place) GROUP BY 1, 2)
    GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.k = c{rounds}.cluster
"""


NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, row,
         CASE WHEN len(w) = 0 THEN []
              ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
                                                lambda i: array_to_string(w[i:i+3], ' '))) END AS shingles
  FROM worded
), kinds AS MATERIALIZED (
  SELECT row_number() OVER () AS kind, min(doc_id) AS first, list_sort(shingles) AS shingles, list(row) AS members
  FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), places AS (SELECT kind, len(shingles) AS n, unnest(shingles) AS s FROM kinds),
links AS MATERIALIZED (
  SELECT a.kind AS a, b.kind AS b
  FROM places a JOIN places b ON a.s = b.s AND a.kind <> b.kind
  GROUP BY a.kind, b.kind, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(kind, other) AS (
  SELECT kind, kind FROM kinds UNION SELECT reach.kind, links.b FROM reach JOIN links ON reach.other = links.a
), classes AS (
  SELECT reach.kind, min(kinds.first) AS component_id FROM reach JOIN kinds ON reach.other = kinds.kind GROUP BY reach.kind
), placed AS (SELECT unnest(kinds.members) AS row, component_id FROM kinds JOIN classes USING (kind))
SELECT sets.doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN placed USING (row)
"""


def llm_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": MIX_SOURCES,
        "op2_secret_scan": _secret_scan(),
        "op5_exact_dedup": EXACT_DEDUP,
        "op7_chat_format": CHAT_FORMAT,
        "op11_centroid_clusters": _centroid_clusters(),
        "op12_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    }
