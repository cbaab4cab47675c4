"""DuckDB SQL for the operators on integer vectors: their rounds written out one after the other."""

from __future__ import annotations

DOWN = "(({s} - (({s} % {n}) + {n}) % {n}) // {n})"  # exact division, rounded down


def _kept(more: str = "") -> str:
    return f"""e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more})"""


def codes_sql(scale: int = 256, positions: int = 16, entries: int = 64, rounds: int = 2) -> str:
    width = f"(len(embedding) // {positions})"
    parts = [
        _kept(),
        f"""x AS MATERIALIZED (SELECT i, j // w AS p, j % w AS k, floor({scale} * embedding[j + 1]::DOUBLE)::BIGINT AS v
  FROM (SELECT i, embedding, {width} AS w, unnest(range(len(embedding))) AS j FROM e))""",
        f"c0 AS MATERIALIZED (SELECT p, i - 1 AS en, k, v FROM x WHERE i <= {entries})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT i, p, en, d FROM (
  SELECT x.i, x.p, c.en, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c ON x.p = c.p AND x.k = c.k GROUP BY x.i, x.p, c.en)
  QUALIFY row_number() OVER (PARTITION BY i, p ORDER BY d, en) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT p, en, k, coalesce({DOWN.format(s="s", n="n")}, v) AS v FROM c{r} LEFT JOIN (
  SELECT p, en, k, sum(v)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (i, p) GROUP BY p, en, k) USING (p, en, k))"""
            )
    last = rounds
    parts += [
        f"f AS (SELECT i, string_agg(printf('%02x', en), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY i)",
        f"h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, en, k)) AS codebooks_sha256 FROM c{last})",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN e USING (i), h"


def clusters_sql(width: int = 64, clusters: int = 8, rounds: int = 10, salt: str = "3:", scale: int = 1024) -> str:
    parts = [
        _kept(f" AND len(embedding) = {width}"),
        f"x AS MATERIALIZED (SELECT i, j, floor({scale} * embedding[j + 1]::DOUBLE)::BIGINT AS v FROM (SELECT i, embedding, unnest(range({width})) AS j FROM e))",
        f"s AS (SELECT i, row_number() OVER (ORDER BY sha256('{salt}' || vec_id), i) - 1 AS c FROM e WHERE vec_id IS NOT NULL)",
        f"m0 AS MATERIALIZED (SELECT c, j, v FROM s JOIN x USING (i) WHERE c < {clusters})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT i, c, d FROM (
  SELECT x.i, m.c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS d FROM x JOIN m{r} m USING (j) GROUP BY x.i, m.c)
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r + 1} AS MATERIALIZED (SELECT c, j, coalesce({DOWN.format(s="t", n="n")}, v) AS v FROM m{r} LEFT JOIN (
  SELECT c, j, sum(v)::BIGINT AS t, count(*) AS n FROM a{r} JOIN x USING (i) GROUP BY c, j) USING (c, j))"""
            )
    parts.append(f"h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM m{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c) JOIN e USING (i)"""
