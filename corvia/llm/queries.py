"""The registered queries of this subpackage, each over its whole table, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvia.llm import (
    anchor_dedup, ann, delta_lloyd, html_tree, jaccard, line_dedup, mixing, mjpeg, packing, quality, suffix_dedup, token_count, vector_codes,
    vector_sql,
)
from corvia.llm.store import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.stored_text_features(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_dedup.passage_digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mjpeg": op1_mjpeg,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_ann": op4_ann,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_html_text": op9_html_text,
    "op10_token_counts": op10_token_counts,
    "op11_passages": op11_passages,
    "op12_vector_codes": op12_vector_codes,
    "op13_delta_lloyd": op13_delta_lloyd,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line FROM documents),
common AS (
  SELECT line, min(doc_id) AS keeper FROM l
  WHERE length(line) - length(regexp_replace(line, '[^\x20\x09-\x0D]+', '', 'g')) > 0
    AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3
  GROUP BY line HAVING count(DISTINCT site) >= 3),
hit AS (SELECT DISTINCT l.doc_id, l.line FROM l JOIN common USING (line) WHERE l.doc_id <> common.keeper),
hits AS (SELECT doc_id, list(line) AS lines FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines,
  CASE WHEN h.lines IS NULL THEN 0
       ELSE len(list_filter(string_split(d.text, chr(10)), lambda x: list_contains(h.lines, x))) END AS n_removed,
  CASE WHEN h.lines IS NULL THEN d.text
       ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(h.lines, x)), chr(10)) END AS text
FROM documents d LEFT JOIN hits h USING (doc_id)
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5(doc_id::VARCHAR || ':' || coalesce(md5(text), '') || ':mix') AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::BIGINT / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE max(level) OVER () * weight END AS target FROM v),
p AS (
  SELECT row_number() OVER () AS i, doc_id, d.source, size, source_size, target,
    (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
a AS (SELECT p.*, unnest([0, 1, 2]) AS again FROM p WHERE size > 0 AND target > 0),
b AS (SELECT a.*, unnest(range(0, size, 32)) AS first FROM a),
q AS (
  SELECT i, source, target, least(32, size - first) AS words, upto - size + first + least(32, size - first) + again * source_size AS place
  FROM b),
z AS (
  SELECT i, words, sum(words) OVER (ORDER BY place / target, source NULLS LAST, place ROWS UNBOUNDED PRECEDING) AS total FROM q),
k AS (
  SELECT i, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - (total - words)))) AS taken FROM z GROUP BY i)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken,
  CASE WHEN target > 0 THEN (upto - size) / target END AS start, CASE WHEN target > 0 THEN upto / target END AS finish
FROM p LEFT JOIN k USING (i)
""",
    "op11_passages": r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT i, doc_id, unnest(words) AS word, unnest(range(len(words))) AS p, len(words) AS n FROM d),
s AS (
  SELECT i, doc_id, word, p, n, string_agg(word, ' ') OVER (PARTITION BY i ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM w),
f AS (
  SELECT i, p, min(doc_id) OVER (PARTITION BY win) AS first, doc_id, min(p) OVER (PARTITION BY win, i) AS own FROM s WHERE p + 20 <= n),
g AS (SELECT i, p FROM f WHERE first < doc_id OR (first IS NOT NULL AND doc_id IS NULL) OR own < p),
c AS (
  SELECT w.i, w.p, word, coalesce(max((g.i IS NOT NULL)::INT) OVER (PARTITION BY w.i ORDER BY w.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN g USING (i, p)),
k AS (SELECT i, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY i)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (i)
""",
    "op12_vector_codes": vector_sql.codes_sql(),
    "op13_delta_lloyd": vector_sql.clusters_sql(),
}
