"""DuckDB statement of the product codes of embeddings: the rounds written out, all distances in exact doubles."""

from __future__ import annotations

from turnstone.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_KEPT = f"""kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS n, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT n, p, list_slice(x, (p * len(x) / {PARTS} + 1)::BIGINT, ((p + 1) * len(x) / {PARTS})::BIGINT) AS v FROM kept, range({PARTS}) AS r(p)),
c0 AS MATERIALIZED (SELECT p, n AS e, v FROM parts WHERE n < {ENTRIES})"""


def _assigned(k: int) -> str:
    return f"""a{k} AS MATERIALIZED (
  SELECT n, p, min_by(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (
    SELECT n, p, e, list_inner_product(w, w) AS d FROM (
      SELECT parts.n, parts.p, c{k}.e, [z[1] - z[2] FOR z IN list_zip(parts.v, c{k}.v)] AS w
      FROM parts JOIN c{k} ON parts.p = c{k}.p)) GROUP BY n, p)"""


def _next(k: int) -> str:
    return f"""c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} AS c LEFT JOIN (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS v FROM (
      SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM (
        SELECT a.p, a.e, parts.v, unnest(range(1, len(parts.v) + 1)) AS i FROM a{k} AS a JOIN parts USING (n, p)) GROUP BY p, e, i)
    GROUP BY p, e) AS m USING (p, e))"""


_STEPS = ",\n".join([_KEPT, *[f"{_assigned(k)},\n{_next(k)}" for k in range(ROUNDS)], _assigned(ROUNDS)])

SQL = f"""WITH {_STEPS},
coded AS (
  SELECT n, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY n),
books AS (
  SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN v], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), books"""
