"""Queries of label sheets, registries and reports, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvia.operators import registry, review, statute
from corvia.plans.cases import BASE, CASES, PENALTY, cases, constrained_cases, table
from corvia.plans.registered import query

_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
SHEET = f"""{CASES}, sheet AS (
  SELECT case_id, order_id, court, jdate, n_counts, joint, art17_1, art17_2, art59, recidivism, months, predicted, weight_g, level AS one_level, behavior AS one,
    CASE WHEN order_id % 9 = 0 THEN [] WHEN n_counts % 2 = 0 THEN [behavior, '施用'] ELSE [behavior] END AS behaviors,
    CASE WHEN order_id % 10 = 3 THEN [] ELSE [level, 4] END AS levels, CASE WHEN order_id % 11 = 0 THEN 0 ELSE months END AS sentence_months
  FROM cases)"""


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with lists of behaviors and levels, some empty, and terms, some 0."""
    none = F.array().cast("array<string>")
    return cases(spark, sf_dir).select(
        "case_id", "order_id", "court", "jdate", "n_counts", "joint", "art17_1", "art17_2", "art59", "recidivism", "months", "predicted", "weight_g",
        F.col("level").alias("one_level"), F.col("behavior").alias("one"),
        F.when(F.col("order_id") % 9 == 0, none).when(F.col("n_counts") % 2 == 0, F.array("behavior", F.lit("施用"))).otherwise(F.array("behavior")).alias("behaviors"),
        F.when(F.col("order_id") % 10 == 3, F.array().cast("array<int>")).otherwise(F.array(F.col("level"), F.lit(4))).alias("levels"),
        F.when(F.col("order_id") % 11 == 0, 0.0).otherwise(F.col("months").cast("double")).alias("sentence_months"),
    )


@query(f"WITH {CASES} SELECT case_id FROM cases WHERE n_counts = 1")
def single_defendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.single_defendant(cases(spark, sf_dir), "n_counts").select("case_id")


_ORDER = "[" + ", ".join(f"'{b}'" for b in statute.REPORT_ORDER) + "]"


@query(f"""WITH {SHEET} SELECT case_id, list_filter({_ORDER}, lambda b: list_contains(behaviors, b))[1] AS "primary", list_min(levels) AS level FROM sheet
WHERE sentence_months <> 0 AND n_counts <= 1 AND NOT joint AND len(levels) > 0 AND len(behaviors) > 0 AND court IN ('KL', 'TP', 'SL', 'PC', 'TY')""")
def bucket_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = sheet(spark, sf_dir).withColumns({"n_defendants": F.lit(1), "is_aggregate_sentence": F.col("joint"), "n_sentence_counts": F.col("n_counts")})
    return review.bucket_cases(named, "behaviors", "levels").select("case_id", "primary", "level")


@query(f"""WITH {SHEET}, f AS (SELECT *, CASE levels[1] WHEN 1 THEN 180 WHEN 2 THEN 120 WHEN 3 THEN 84 WHEN 4 THEN 60 END AS floor FROM sheet)
SELECT case_id, floor FROM f WHERE art17_2 AND list_has_any(behaviors, ['販賣', '運輸', '製造']) AND floor IS NOT NULL AND months::DOUBLE > floor::DOUBLE * 0.7::DOUBLE""")
def suspicious_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet(spark, sf_dir).withColumns({
        "b": F.array_join("behaviors", ","), "l": F.array_join(F.col("levels").cast("array<string>"), ","), "m": F.col("months").cast("string"),
    })
    return review.suspicious_reductions(rows, "art17_2", "m", "b", "l").select("case_id", "floor")


_CATEGORY = """CASE WHEN joint OR n_counts > 1 THEN 'aggregate_51' WHEN one IN ('販賣', '運輸', '製造', '意圖販賣而持有', '轉讓') AND predicted - months > 6 THEN 'missing_reduction'
  WHEN one IN ('販賣', '運輸', '製造', '意圖販賣而持有', '轉讓') AND predicted - months < -6 THEN 'missing_feature' WHEN one = '持有' AND weight_g > 0 THEN 'rule_table_gap' ELSE 'label_or_variance' END"""
_REASON = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in registry.REASONS.items()) + " END"


@query(f"""WITH {SHEET}, r AS (SELECT *, court || 'M,' || jdate || ',重訴 /' || case_id || '~*' AS jid, {_CATEGORY} AS c FROM sheet)
SELECT jid, jdate, court, weight_g, concat_ws(',', CASE WHEN art17_1 THEN 'art17_1' END, CASE WHEN art59 THEN 'art59' END) AS flags, c AS suspected_category,
  '' AS verdict_category, '' AS action, '' AS reviewer, '' AS reviewed_date, '' AS notes, {_REASON} AS suspected_reason,
  '{registry.JUDGMENT}' || replace(url_encode(jid), '%2F', '/') AS jurl, case_id FROM r""")
def registry_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet(spark, sf_dir)
    jid = F.concat("court", F.lit("M,"), "jdate", F.lit(",重訴 /"), F.col("case_id").cast("string"), F.lit("~*"))
    category = registry.triage(F.col("joint"), F.col("n_counts"), F.col("one"), F.col("predicted") - F.col("months"), F.col("weight_g"))
    rows = rows.withColumn("jid", jid).withColumn("category", category).select("case_id", "jid", "jdate", "court", "weight_g", "category", "art17_1", "art59")
    out = registry.registered(rows, F.col("category"), {"art17_1": F.col("art17_1"), "art59": F.col("art59")})
    return out.drop("category", "art17_1", "art59")


@query(f"""WITH {SHEET} SELECT case_id, array_to_string(behaviors, ',') AS gt_behaviors, CASE WHEN sentence_months = 0 THEN '' ELSE sentence_months::INT::VARCHAR END AS gt_sentence_months, art59::INT::VARCHAR AS gt_art59 FROM sheet""")
def label_prefill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet(spark, sf_dir).withColumns({
        "auto_behaviors": F.array_join("behaviors", ","), "auto_drug_levels": F.array_join(F.col("levels").cast("array<string>"), ","),
        "auto_sentence_months": F.col("sentence_months").cast("int"), "auto_detention_days": F.lit(None).cast("int"), "auto_probation_months": F.lit(0),
        **{f"auto_{c}": F.col("art59").cast("int") for c in ("art17_1", "art17_2", "art59", "recidivism", "can_convert_to_fine")},
    })
    return review.prefilled(rows).select("case_id", "gt_behaviors", "gt_sentence_months", "gt_art59")


@query("""SELECT doc_id FROM documents WHERE trim(coalesce(source, '')) <> '' AND doc_id % 3 = 0 OR doc_id % 5 = 0 AND regexp_matches(coalesce(text, ''), '[^\\s]')""")
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("gt_a"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise("　 \n").alias("gt_b"))
    return review.labelled(rows, ("a", "b")).select("doc_id")


@query("SELECT lang, count(*) FILTER (length(source) > 0) AS n_filled FROM documents GROUP BY lang")
def filled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(review.filled("source").alias("n_filled"))


@query("""SELECT page_id, coalesce(nullif(replace(replace(CASE WHEN instr(html, '<h9') > 0 THEN substr(html, instr(html, '<h9'), 600) ELSE '' END, chr(10), ' '), chr(13), ' '), ''),
  replace(replace(CASE WHEN instr(html, '<p>') > 0 THEN substr(html, instr(html, '<p>'), 600) ELSE '' END, chr(10), ' '), chr(13), ' ')) AS facts FROM pages""")
def anchor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", review.anchored(F.col("html"), ("<h9", "<p>")).alias("facts"))


@query("""WITH every AS (SELECT doc_id, text, 0 AS s FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'later ' || doc_id, 1 FROM documents WHERE doc_id % 3 = 0),
last AS (SELECT doc_id, arg_max(text, (s, text)) AS body FROM every GROUP BY doc_id)
SELECT l.doc_id, body FROM labels l LEFT JOIN last USING (doc_id)""")
def outlier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = docs.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("body"))
    second = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("later "), F.col("doc_id").cast("string")).alias("body"))
    return review.with_text(table(spark, sf_dir, "labels"), [first, second], "doc_id", "body").select("doc_id", "body")


@query(f"""WITH {CASES} SELECT court, (count(*) FILTER (months > 100) + count(*) FILTER (weight_g > 25)) / count(*) AS coverage FROM cases GROUP BY court""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("court").agg(review.coverage_ratio(F.col("months") - 100, F.col("weight_g") - 25).alias("coverage"))


@query(f"WITH {SHEET} SELECT coalesce(behaviors[1], '') AS behavior, count(*) AS n FROM sheet GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.value_counts(sheet(spark, sf_dir), review.first_item(F.array_join("behaviors", ",")), "behavior")


@query("""WITH w AS (SELECT substr(text, greatest(instr(text, 'with') - 80, 1), instr(text, 'with') + 4 + 80 - greatest(instr(text, 'with') - 80, 1)) AS w FROM documents WHERE instr(text, 'with') > 0),
t AS (SELECT unnest(['the', 'and', 'er', '!!', ' of ']) AS phrase) SELECT phrase, count(*) AS n FROM w, t WHERE contains(w, phrase) GROUP BY phrase""")
def phrases_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.phrases_near(table(spark, sf_dir, "documents"), F.col("text"), "with", ("the", "and", "er", "!!", " of "))


@query("""WITH d AS (SELECT role, CASE turn % 4 WHEN 0 THEN 'mitigating' WHEN 1 THEN 'neutral' WHEN 2 THEN 'absent' ELSE 'other' END AS d FROM conversations)
SELECT role, count(*) FILTER (d = 'mitigating') AS mitigating, count(*) FILTER (d = 'aggravating') AS aggravating, count(*) FILTER (d = 'neutral') AS neutral, count(*) FILTER (d = 'absent') AS absent FROM d GROUP BY role""")
def direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") % 4
    d = F.when(t == 0, "mitigating").when(t == 1, "neutral").when(t == 2, "absent").otherwise("other")
    return review.direction_counts(table(spark, sf_dir, "conversations"), ["role"], d)


@query(f"WITH {BASE} SELECT court, count(*) FILTER (lo IS NOT NULL AND abs(greatest(lo, least(predicted, hi)) - predicted) > 0.01) AS n_clipped FROM reduced GROUP BY court")
def clip_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constrained_cases(spark, sf_dir).groupBy("court").agg(review.clip_count(F.col("predicted"), F.col("c")).alias("n_clipped"))


@query(f"""WITH {SHEET}, {PENALTY},
s AS (SELECT case_id, art17_1, recidivism, CASE WHEN len(behaviors) > 0 THEN behaviors ELSE [one] END AS b, CASE WHEN len(levels) > 0 THEN levels ELSE [one_level] END AS l, joint, n_counts FROM sheet),
k AS (SELECT *, list_max(list_transform(b, lambda x: CASE x WHEN '販賣' THEN 5 WHEN '運輸' THEN 5 WHEN '製造' THEN 5 WHEN '意圖販賣而持有' THEN 4 WHEN '轉讓' THEN 3 WHEN '施用' THEN 2 ELSE 1 END)) AS r FROM s)
SELECT case_id, CASE WHEN joint OR n_counts > 1 THEN 0 ELSE lo * CASE WHEN art17_1 THEN 0.5 ELSE 1 END END AS min_months,
  CASE WHEN joint OR n_counts > 1 THEN 360 WHEN hi IS NULL THEN NULL WHEN recidivism THEN least(hi * CASE WHEN art17_1 THEN 0.5 ELSE 1 END * 1.5, 360) ELSE hi * CASE WHEN art17_1 THEN 0.5 ELSE 1 END END AS max_months
FROM k LEFT JOIN penalty p ON p.level = list_min(k.l) AND p.behavior = CASE k.r WHEN 5 THEN '販賣' WHEN 4 THEN '意圖販賣而持有' WHEN 3 THEN '轉讓' WHEN 2 THEN '施用' ELSE '持有' END""")
def serving_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet(spark, sf_dir).withColumns({
        "b": review.serving_lists(F.col("behaviors"), F.array("one")), "l": review.serving_lists(F.col("levels"), F.array("one_level")), "none": F.lit(False),
    })
    rows = statute.with_binding(rows, "single", "b", "l", ["art17_1"], "recidivism", "none")
    c = statute.constraint_for(F.col("joint"), F.col("n_counts"), F.col("single"))
    return rows.withColumn("c", c).select("case_id", "c.min_months", "c.max_months")


_SEVERITY = "(CASE {b} WHEN '販賣' THEN 5 WHEN '運輸' THEN 5 WHEN '製造' THEN 5 WHEN '意圖販賣而持有' THEN 4 WHEN '轉讓' THEN 3 WHEN '施用' THEN 2 ELSE 1 END)"


@query(f"""WITH {SHEET}, p AS (SELECT *, CASE WHEN joint THEN list_concat(behaviors, ['運輸']) ELSE behaviors END AS named FROM sheet)
SELECT case_id, list_filter({_ORDER}, lambda b: list_contains(named, b))[1] AS by_order, coalesce(named[1], '') AS by_place,
  list_sort(list_transform(named, lambda x: {_SEVERITY.format(b="x")}), 'DESC')[1] AS severity,
  list_filter(named, lambda b: {_SEVERITY.format(b="b")} = list_max(list_transform(named, lambda x: {_SEVERITY.format(b="x")})))[1] AS as_ticked FROM p""")
def primary_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main behavior of a case by each of the four definitions; by severity, its rank (equal ones have equal ranges)."""
    rows = sheet(spark, sf_dir).withColumn("named", F.when(F.col("joint"), F.concat("behaviors", F.array(F.lit("運輸")))).otherwise(F.col("behaviors")))
    b = F.col("named")
    rank = F.create_map(*(F.lit(x) for kv in statute.SEVERITY.items() for x in kv))
    return rows.select(
        "case_id", statute.primary_by_order(b).alias("by_order"), review.first_item(F.array_join(b, ",")).alias("by_place"),
        F.try_element_at(rank, statute.primary_by_severity(b)).alias("severity"), statute.primary_as_ticked(b).alias("as_ticked"),
    )


@query(f"""WITH {SHEET}, {PENALTY},
s AS (SELECT *, list_max(list_transform(behaviors, lambda x: {_SEVERITY.format(b="x")})) AS r FROM sheet WHERE len(behaviors) > 0 AND len(levels) > 0),
k AS (SELECT *, pow(0.5, (art17_1 AND r >= 3)::INT + (art17_2 AND r >= 3)::INT + art59::INT) AS f FROM s)
SELECT case_id, lo * f AS min_months, CASE WHEN hi IS NULL THEN NULL WHEN recidivism THEN least(hi * f * 1.5, 360) ELSE hi * f END AS max_months
FROM k LEFT JOIN penalty p ON p.level = list_min(k.levels) AND p.behavior = CASE k.r WHEN 5 THEN '販賣' WHEN 4 THEN '意圖販賣而持有' WHEN 3 THEN '轉讓' WHEN 2 THEN '施用' ELSE '持有' END""")
def calculator_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calculator's variant: article 17 reduces nothing where the main behavior is use or possession."""
    rows = sheet(spark, sf_dir).where((F.size("behaviors") > 0) & (F.size("levels") > 0)).withColumn("none", F.lit(False))
    rows = statute.with_calculator_binding(rows, "c", "behaviors", "levels", ["art17_1", "art17_2"], ["art59"], "recidivism", "none")
    return rows.select("case_id", "c.min_months", "c.max_months")


@query(f"""WITH {CASES}, i AS (SELECT *, row_number() OVER () AS i FROM cases), c AS (SELECT i, case_id, unnest([{{'feature': 'a', 'x': months - 60}}, {{'feature': 'b', 'x': predicted - 40}}, {{'feature': 'c', 'x': -weight_g}}, {{'feature': 'd', 'x': n_counts * 9.0}}], recursive := true) FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(x) DESC, feature) AS place FROM c) SELECT case_id, place::INT AS place, feature, x::DOUBLE AS contribution FROM r WHERE place <= 2""")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"a": F.col("months") - 60, "b": F.col("predicted") - 40, "c": -F.col("weight_g"), "d": F.col("n_counts") * 9.0}
    rows = review.top_contributions(cases(spark, sf_dir), {k: c.cast("double") for k, c in of.items()}, 2)
    return rows.select("case_id", F.posexplode("top")).select("case_id", (F.col("pos") + 1).alias("place"), "col.feature", "col.contribution")


@query(f"""WITH {CASES} SELECT case_id, ('0x' || substr(md5(case_id || ':7'), 1, 8))::BIGINT < 858993459 AS held FROM cases""")
def random_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.holdout(cases(spark, sf_dir), "case_id").select("case_id", "held")


@query(f"""WITH {CASES}, t(court, threshold) AS (VALUES ('KL', 30), ('TP', 40), ('SL', 50), ('PC', 60)), p AS (SELECT predicted >= threshold AS p, joint FROM cases JOIN t USING (court))
SELECT count(*) FILTER (p AND joint) AS tp, count(*) FILTER (p AND NOT joint) AS fp, count(*) FILTER (NOT p AND joint) AS fn, count(*) FILTER (NOT p AND NOT joint) AS tn FROM p""")
def pooled_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("KL", 30.0), ("TP", 40.0), ("SL", 50.0), ("PC", 60.0)], "court string, threshold double")
    rows = review.pooled_with_own_thresholds(cases(spark, sf_dir), "court", "predicted", "joint", own)
    p, a = F.col("predicted"), F.col("joint")
    return rows.groupBy().agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))


@query(f"""WITH {CASES}, r AS (SELECT case_id, row_number() OVER (ORDER BY jdate, case_id) - 1 AS position FROM cases)
SELECT case_id, position, CASE WHEN position >= 3000 THEN 2 WHEN position >= 1000 THEN 1 ELSE 0 END AS shard FROM r""")
def positional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.shards(cases(spark, sf_dir).select("case_id", "jdate"), "jdate", ["case_id"], [0, 1000, 3000]).select("case_id", "position", "shard")


@query("""WITH t AS (SELECT role, length(text) AS input_tokens, turn * 7 AS cache_read_tokens, (turn % 2) * 1.5 AS latency FROM conversations)
SELECT role, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, avg(nullif(latency, 0)) AS mean_latency,
  (sum(input_tokens) * 1.0 + sum(cache_read_tokens) * 0.1) / 1e6 AS cost_usd, 100 * sum(cache_read_tokens) / greatest(1, sum(input_tokens) + sum(cache_read_tokens)) AS cache_percent FROM t GROUP BY role""")
def cache_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "conversations").select(
        "role", F.length("text").alias("input_tokens"), (F.col("turn") * 7).alias("cache_read_tokens"), ((F.col("turn") % 2) * 1.5).alias("latency")
    )
    return registry.token_costs(calls, ["role"], {"input_tokens": 1.0, "cache_read_tokens": 0.1}, "latency")
