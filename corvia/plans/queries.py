"""Registered queries of the analytics operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvia.functions import numerals, text
from corvia.operators import buckets, corpus_filter, extract, folds, labels, metrics, registry, selection, statute, training
from corvia.plans.cases import BASE, CASES, cases, constrained_cases, table
from corvia.plans.registered import QUERIES, SQL, query  # noqa: F401

# --- ranges


@query(f"WITH {BASE} SELECT behavior, level, count(lo) AS n_checked, count(*) FILTER (lo IS NOT NULL AND NOT (months BETWEEN lo - 1e-6 AND hi + 1e-6)) AS n_violations, coalesce(count(*) FILTER (lo IS NOT NULL AND NOT (months BETWEEN lo - 1e-6 AND hi + 1e-6)) / nullif(count(lo), 0), 0.0) AS rate FROM reduced GROUP BY behavior, level")
def violation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statute.violations(constrained_cases(spark, sf_dir), F.col("months"), F.col("c"), "behavior", "level")


@query(f"WITH {BASE} SELECT case_id, lo AS min_months, hi AS max_months, life AS includes_life, capital AS includes_capital FROM reduced")
def reductions_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constrained_cases(spark, sf_dir).select("case_id", "c.*")


@query(f"WITH {BASE} SELECT behavior, level, lo AS min_months, hi AS max_months, life AS includes_life, count(*) AS n FROM based GROUP BY behavior, level, lo, hi, life")
def holding_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = statute.base_range(F.col("behavior"), F.col("level"), weight_g=F.col("weight_g"))
    rows = cases(spark, sf_dir).withColumn("c", c).select("behavior", "level", "c.min_months", "c.max_months", "c.includes_life")
    return rows.groupBy(rows.columns).agg(F.count("*").alias("n"))


@query(f"""WITH {BASE}, p AS (SELECT case_id, lo, hi, predicted - 5 AS a, predicted AS b, predicted + 3 AS d FROM reduced),
k AS (SELECT *, greatest(lo, least(a, hi)) AS a2, greatest(lo, least(b, hi)) AS b2, greatest(lo, least(d, hi)) AS d2 FROM p)
SELECT case_id, CASE WHEN lo IS NULL THEN a ELSE a2 END AS p25, CASE WHEN lo IS NULL THEN b ELSE greatest(b2, a2) END AS p50,
  CASE WHEN lo IS NULL THEN d ELSE greatest(d2, b2, a2) END AS p75,
  coalesce(lo IS NOT NULL AND (abs(a2 - a) > 1e-6 OR abs(b2 - b) > 1e-6 OR abs(d2 - d) > 1e-6), false) AS clipped, lo IS NOT NULL AS rule_applied FROM k""")
def clip_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("predicted")
    rows = constrained_cases(spark, sf_dir)
    return rows.select("case_id", statute.constrained(p - 5, p, p + 3, F.col("c")).alias("o")).select("case_id", "o.*")


@query(f"""WITH {CASES} SELECT order_id, max(months)::DOUBLE AS low, least(sum(months), 360)::DOUBLE AS high FROM cases GROUP BY order_id""")
def aggregate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = cases(spark, sf_dir).groupBy("order_id").agg(F.collect_list("months").alias("terms"))  # of one order
    return terms.withColumn("b", statute.aggregate_bounds(F.col("terms"))).select("order_id", "b.*")


@query(f"""WITH {BASE}, g AS (SELECT order_id, min(level) AS level, bool_or(art17_1) AS r1, bool_or(recidivism) AS rec, bool_or(summary) AS summary,
  max(CASE behavior WHEN '販賣' THEN 5 WHEN '運輸' THEN 5 WHEN '製造' THEN 5 WHEN '意圖販賣而持有' THEN 4 WHEN '轉讓' THEN 3 WHEN '施用' THEN 2 ELSE 1 END) AS s FROM cases GROUP BY order_id),
b AS (SELECT g.*, p.lo, p.hi FROM g LEFT JOIN penalty p ON p.level = g.level AND p.behavior = CASE g.s WHEN 5 THEN '販賣' WHEN 4 THEN '意圖販賣而持有' WHEN 3 THEN '轉讓' WHEN 2 THEN '施用' ELSE '持有' END)
SELECT order_id, level, lo * CASE WHEN r1 THEN 0.5 ELSE 1 END * CASE WHEN summary THEN 0.5 ELSE 1 END AS min_months,
  CASE WHEN hi IS NULL THEN NULL WHEN rec THEN least(hi * CASE WHEN r1 THEN 0.5 ELSE 1 END * 1.5, 360) ELSE hi * CASE WHEN r1 THEN 0.5 ELSE 1 END END AS max_months FROM b""")
def binding_primary_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = cases(spark, sf_dir).groupBy("order_id").agg(
        F.collect_set("behavior").alias("behaviors"), F.collect_set("level").alias("levels"),
        F.bool_or("art17_1").alias("r1"), F.bool_or("recidivism").alias("rec"), F.bool_or("summary").alias("summary"),
    )
    return statute.with_binding(orders, "c", "behaviors", "levels", ["r1"], "rec", "summary").select("order_id", F.array_min("levels").alias("level"), "c.min_months", "c.max_months")


@query(f"""WITH {BASE} SELECT case_id, CASE WHEN joint OR n_counts > 1 THEN 0.0 ELSE lo END AS min_months, CASE WHEN joint OR n_counts > 1 THEN 360.0 ELSE hi END AS max_months FROM reduced""")
def constraint_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = statute.constraint_for(F.col("joint"), F.col("n_counts"), F.col("c"))
    return constrained_cases(spark, sf_dir).withColumn("c", c).select("case_id", "c.min_months", "c.max_months")


@query(f"""WITH {CASES} SELECT case_id, pow(2.0, -coalesce(((20000101 // 10000) * 365 + 1 * 30 + 1 - (substr(jdate, 1, 4)::INT * 365 + substr(jdate, 5, 2)::INT * 30 + substr(jdate, 7, 2)::INT)) / 365.0, 0) / 5.0) AS weight FROM cases""")
def time_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", statute.decay_weight(F.col("jdate"), F.lit("20000101"), 5.0).alias("weight"))


# --- metrics


_ERR = f"""WITH {CASES}, e AS (SELECT *, months - predicted AS d, predicted * 1.1 AS raw FROM cases)"""


@query(f"""{_ERR}, m AS (SELECT court, avg(months) AS mean FROM e GROUP BY court)
SELECT court, count(*) AS n, avg(abs(d)) AS mae, avg(abs(months - raw)) AS raw_mae, sqrt(avg(d * d)) AS rmse,
  1 - sum(d * d) / sum((months - mean) * (months - mean)) AS r2, avg((abs(d) <= 3)::INT) AS hit3, avg((abs(d) <= 6)::INT) AS hit6
FROM e JOIN m USING (court) GROUP BY court""")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression(cases(spark, sf_dir).withColumn("raw", F.col("predicted") * 1.1), ["court"], "months", "predicted", "raw")


@query(f"""{_ERR} SELECT behavior, avg(greatest(0.25 * (months - predicted + 5), -0.75 * (months - predicted + 5))) AS p25,
  avg(greatest(0.5 * d, -0.5 * d)) AS p50, avg(greatest(0.75 * (d - 3), -0.25 * (d - 3))) AS p75,
  avg((months BETWEEN predicted - 5 AND predicted + 3)::INT) AS coverage, count(*) FILTER (predicted - 5 > raw - 10 + 1e-6 OR raw - 10 > predicted + 3 + 1e-6) AS crossed FROM e GROUP BY behavior""")
def pinball_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = F.col("months"), F.col("predicted")
    return cases(spark, sf_dir).groupBy("behavior").agg(
        metrics.pinball(y, p - 5, 0.25).alias("p25"), metrics.pinball(y, p, 0.5).alias("p50"), metrics.pinball(y, p + 3, 0.75).alias("p75"),
        metrics.coverage(y, p - 5, p + 3).alias("coverage"), metrics.crossings(p - 5, p * 1.1 - 10, p + 3).alias("crossed"),
    )


@query(f"""{_ERR} SELECT court, behavior, count(*) AS n, avg(abs(d)) AS mae, quantile_cont(abs(d), 0.5) AS median_abs_error FROM e GROUP BY court, behavior""")
def group_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_errors(cases(spark, sf_dir), ["court", "behavior"], "months", "predicted")


@query(f"""WITH {CASES}, o AS (SELECT court, months, row_number() OVER (PARTITION BY court ORDER BY months) - 1 AS i, count(*) OVER (PARTITION BY court) AS n FROM cases)
SELECT court, max(n) AS n, max(months) FILTER (i = n // 4) AS q1, max(months) FILTER (i = n // 2) AS q2, max(months) FILTER (i = 3 * n // 4) AS q3, avg(months) AS mean, max(months) AS max FROM o GROUP BY court""")
def nearest_rank_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank_quartiles(cases(spark, sf_dir), ["court"], "months")


@query("""SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM events GROUP BY event_type""")
def interp_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.25, 0.5, 0.75])
    return found.select("event_type", "n", *(F.col("percentiles")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))))


_SCORED = """s AS (SELECT lang, n_chars::DOUBLE / 1000 AS score, quality = 1 AS good FROM labels JOIN documents USING (doc_id))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars").cast("double") / 1000).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", "score", (F.col("quality") == 1).alias("good"))


@query(f"""WITH {_SCORED}, g AS (SELECT lang, score, count(*) FILTER (good) AS p, count(*) AS n FROM s GROUP BY lang, score),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, sum(p * tp / k) / sum(p) AS average_precision, sum(p) / sum(n) AS base_rate,
  sum(p * tp / k) / sum(p) / (sum(p) / sum(n)) AS lift FROM c GROUP BY lang""")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, sf_dir), ["lang"], "score", "good")


@query(f"""WITH {_SCORED}, g AS (SELECT lang, round(0.05 * i, 2) AS t, coalesce(2.0 * count(*) FILTER (good AND score >= round(0.05 * i, 2)) / nullif(count(*) FILTER (score >= round(0.05 * i, 2)) + count(*) FILTER (good), 0), 0) AS f1,
  count(*) FILTER (good) AS positives FROM s CROSS JOIN range(1, 20) r(i) GROUP BY lang, i)
SELECT lang, positives, CASE WHEN positives >= 2 AND max(f1) > 0 THEN arg_min(t, (-f1, t)) ELSE 0.5 END AS threshold, CASE WHEN positives >= 2 THEN max(f1) END AS f1 FROM g GROUP BY lang, positives""")
def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_scored(spark, sf_dir), ["lang"], "score", "good")


@query(f"""WITH {_SCORED} SELECT lang, sqrt(greatest(1.0, count(*) FILTER (NOT good) / greatest(1, count(*) FILTER (good)))) AS weight FROM s GROUP BY lang""")
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("lang").agg(metrics.class_weight("good").alias("weight"))


@query(f"""WITH {_SCORED}, c AS (SELECT lang, count(*) FILTER (score >= 1 AND good) AS tp, count(*) FILTER (score >= 1 AND NOT good) AS fp, count(*) FILTER (score < 1 AND good) AS fn, count(*) FILTER (score < 1 AND NOT good) AS tn FROM s GROUP BY lang)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy FROM c""")
def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir), ["lang"], F.col("score") >= 1, F.col("good"))


@query("""WITH p AS (SELECT role, list_distinct(string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ')) AS a, list_distinct(string_split(text, ' ')) AS t FROM conversations),
w AS (SELECT role, coalesce(a, []) AS a, t FROM p WHERE t IS NOT NULL)
SELECT role, count(*) AS n, avg(len(list_intersect(a, t)) / len(list_distinct(list_concat(a, t)))) AS jaccard, coalesce(sum(len(list_intersect(a, t))) / nullif(sum(len(a)), 0), 0) AS precision, coalesce(sum(len(list_intersect(a, t))) / nullif(sum(len(t)), 0), 0) AS recall FROM w GROUP BY role""")
def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_distinct(F.split("text", " "))
    turns = table(spark, sf_dir, "conversations").withColumn("t", said)
    before = F.lag("t").over(W.partitionBy("conv_id").orderBy("turn"))
    return metrics.set_agreement(turns.withColumn("a", before), ["role"], "a", "t")


@query(f"""WITH {CASES} SELECT court, count(*) AS n, avg((weight_g = level)::INT) AS exact, avg(abs(weight_g - level)) AS mae FROM cases GROUP BY court""")
def numeric_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.numeric_agreement(cases(spark, sf_dir), ["court"], "weight_g", "level")


# --- time


_RANK = f"""WITH {CASES}, r AS (SELECT *, row_number() OVER (ORDER BY jdate, case_id) - 1 AS rank, count(*) OVER () AS n FROM cases)"""


@query(f"""{_RANK}, f AS (SELECT r.*, k AS fold, (k + 1) * n // 6 AS lo, (k + 2) * n // 6 AS hi FROM r CROSS JOIN range(0, 5) t(k)),
x AS (SELECT fold, CASE WHEN rank < lo THEN 'train' ELSE 'test' END AS role, jdate, rank, months FROM f WHERE rank < hi AND hi > lo AND lo >= 30)
SELECT fold, role, count(*) AS n, min(rank) AS first_rank, max(rank) AS last_rank, min(jdate) AS first_date, max(jdate) AS last_date, avg(months) AS mean FROM x GROUP BY fold, role""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.walk_forward(cases(spark, sf_dir), "jdate", ["case_id"])
    return rows.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        F.min("jdate").alias("first_date"), F.max("jdate").alias("last_date"), F.avg("months").alias("mean"),
    )


@query(f"""{_RANK}, f AS (SELECT r.*, k AS fold, (k + 1) * n // 6 AS lo, (k + 2) * n // 6 AS hi FROM r CROSS JOIN range(0, 5) t(k)),
m AS (SELECT fold, quantile_cont(months, 0.5) AS guess FROM f WHERE rank < lo GROUP BY fold)
SELECT fold, count(*) AS n, avg(abs(months - guess)) AS mae FROM f JOIN m USING (fold) WHERE rank >= lo AND rank < hi GROUP BY fold""")
def median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.walk_forward(cases(spark, sf_dir), "jdate", ["case_id"])
    guess = selection.percentiles(rows.where("role = 'train'"), ["fold"], "months", [0.5]).select("fold", F.col("percentiles")[0].alias("guess"))
    tested = rows.where("role = 'test'").join(F.broadcast(guess), "fold")  # a row for each fold
    return tested.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("months") - F.col("guess"))).alias("mae"))


@query(f"""{_RANK} SELECT count(*) FILTER (rank >= greatest(1, floor(n * 0.85))) AS n_tail, quantile_cont(months - predicted, 0.75) FILTER (rank >= greatest(1, floor(n * 0.85))) AS shift FROM r""")
def holdout_tail_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.tail_shift(cases(spark, sf_dir), "jdate", ["case_id"], "months", "predicted", 0.75)


@query(f"""WITH {CASES} SELECT substr(jdate, 1, 4) AS year, behavior, count(*) AS n, count(*) FILTER (months > 0 AND level = 1) AS n_first, count(*) FILTER (level = 1) / count(*) AS share FROM cases GROUP BY 1, 2""")
def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy(F.substring("jdate", 1, 4).alias("year"), "behavior").agg(
        F.count("*").alias("n"), F.count_if((F.col("months") > 0) & (F.col("level") == 1)).alias("n_first"),
        F.try_divide(F.count_if(F.col("level") == 1), F.count("*")).alias("share"),
    )


@query("""WITH w AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents) SELECT source, word, count(*) AS n FROM w GROUP BY source, word""")
def explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("source", F.explode(words).alias("word"))
    return rows.groupBy("source", "word").agg(F.count("*").alias("n"))


@query(f"""WITH {CASES} SELECT count(*) AS n, quantile_cont(months, 0.5) AS median, avg(months) AS mean, max(months) AS max, min(jdate) AS first_date, max(jdate) AS last_date FROM cases""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    median = selection.percentiles(rows, [], "months", [0.5]).select(F.col("percentiles")[0].alias("median"))
    sums = rows.groupBy().agg(
        F.count("*").alias("n"), F.avg("months").alias("mean"), F.max("months").alias("max"), F.min("jdate").alias("first_date"), F.max("jdate").alias("last_date"),
    )
    return sums.join(median, F.lit(True), "left").select("n", "median", "mean", "max", "first_date", "last_date")  # a row each


# --- buckets


_BUCKETS = f"""{CASES}, b AS (SELECT court, behavior, level, summary, recidivism, count(months) AS n, round(quantile_cont(months, 0.25), 1) AS p25, round(quantile_cont(months, 0.5), 1) AS p50,
  round(quantile_cont(months, 0.75), 1) AS p75, round(avg(months), 1) AS mean FROM cases WHERE art17_1 AND NOT joint GROUP BY court, behavior, level, summary, recidivism HAVING count(months) >= 3)"""
_KEYS = ["court", "behavior", "level", "summary", "recidivism"]


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = cases(spark, sf_dir).where(F.col("art17_1") & ~F.col("joint"))
    return buckets.bucket_stats(eligible, _KEYS, "months")


@query(f"WITH {_BUCKETS} SELECT * FROM b")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir)


@query(f"WITH {_BUCKETS} SELECT concat_ws('|', court, behavior, level, (summary::INT)::VARCHAR || (recidivism::INT)::VARCHAR) AS key, n, p50 FROM b")
def bucket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = statute.bucket_key(F.col("court"), F.col("behavior"), F.col("level"), [F.col("summary"), F.col("recidivism")])
    return _buckets(spark, sf_dir).select(key.alias("key"), "n", "p50")


@query(f"""WITH {_BUCKETS}, q AS (SELECT case_id, court, behavior, level, summary, recidivism FROM cases),
r AS (SELECT *, row_number() OVER (PARTITION BY court, behavior, level, summary ORDER BY n DESC, recidivism) AS i FROM b),
l AS (SELECT *, row_number() OVER (PARTITION BY court, behavior, level ORDER BY n DESC, summary, recidivism) AS i FROM b)
SELECT q.case_id, coalesce(b.p50, r.p50, l.p50) AS p50, CASE WHEN b.p50 IS NOT NULL THEN 1 WHEN r.p50 IS NOT NULL THEN 2 WHEN l.p50 IS NOT NULL THEN 3 END AS step
FROM q LEFT JOIN b ON b.court = q.court AND b.behavior = q.behavior AND b.level = q.level AND b.summary = q.summary AND b.recidivism = q.recidivism
LEFT JOIN r ON r.i = 1 AND r.court = q.court AND r.behavior = q.behavior AND r.level = q.level AND r.summary = q.summary
LEFT JOIN l ON l.i = 1 AND l.court = q.court AND l.behavior = q.behavior AND l.level = q.level""")
def bucket_lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = cases(spark, sf_dir).select("case_id", *_KEYS)
    return buckets.lookup_cascade(asked, _buckets(spark, sf_dir), _KEYS, _KEYS[:4], _KEYS[:3], "p50").select("case_id", "p50", "step")


@query(f"""WITH {_BUCKETS} SELECT behavior, sum(p50 * n) FILTER (level = 1) / sum(n) FILTER (level = 1) AS first_level, sum(p50 * n) / sum(n) AS any_level FROM b GROUP BY behavior""")
def conditional_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).groupBy("behavior").agg(
        buckets.conditional_mean(F.col("level") == 1).alias("first_level"), buckets.conditional_mean(F.lit(True)).alias("any_level")
    )


@query(f"""WITH {_BUCKETS}, s AS (
  SELECT behavior, 0 AS position, 'all' AS step, sum(p50 * n) / sum(n) AS level FROM b GROUP BY behavior
  UNION ALL SELECT behavior, 1, 'court', sum(p50 * n) FILTER (court = 'KL') / sum(n) FILTER (court = 'KL') FROM b GROUP BY behavior
  UNION ALL SELECT behavior, 2, 'level', sum(p50 * n) FILTER (court = 'KL' AND level = 2) / sum(n) FILTER (court = 'KL' AND level = 2) FROM b GROUP BY behavior
  UNION ALL SELECT behavior, 3, 'summary', sum(p50 * n) FILTER (court = 'KL' AND level = 2 AND summary) / sum(n) FILTER (court = 'KL' AND level = 2 AND summary) FROM b GROUP BY behavior)
SELECT behavior, position, step, level, level - last_value(level IGNORE NULLS) OVER (PARTITION BY behavior ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS change FROM s""")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("all", F.lit(True)), ("court", F.col("court") == "KL"), ("level", F.col("level") == 2), ("summary", F.col("summary"))]
    return buckets.waterfall(_buckets(spark, sf_dir), ["behavior"], steps)


# --- registry


_OUT = f"""{CASES}, o AS (SELECT *, predicted - months AS signed_residual, abs(predicted - months) AS abs_residual, months BETWEEN predicted - 5 - 1e-6 AND predicted + 3 + 1e-6 AS in_band FROM cases),
top AS (SELECT * FROM o ORDER BY abs_residual DESC, case_id LIMIT 50)"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumns({"p25": F.col("predicted") - 5, "p75": F.col("predicted") + 3})
    return registry.top_outliers(registry.residuals(rows, "months", "p25", "predicted", "p75"), 50, "case_id")


@query(f"WITH {_OUT} SELECT case_id, signed_residual, abs_residual, in_band FROM top")
def topk_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("case_id", "signed_residual", "abs_residual", "in_band")


@query(f"""WITH {_OUT} SELECT CASE WHEN joint OR n_counts > 4 THEN 'aggregate_51' WHEN behavior IN ('販賣', '運輸', '製造', '意圖販賣而持有', '轉讓') AND signed_residual > 6 THEN 'missing_reduction'
  WHEN behavior IN ('販賣', '運輸', '製造', '意圖販賣而持有', '轉讓') AND signed_residual < -6 THEN 'missing_feature' WHEN behavior = '持有' AND weight_g > 0 THEN 'rule_table_gap' ELSE 'label_or_variance' END AS category,
  concat_ws(',', CASE WHEN art59 THEN 'art59' END, CASE WHEN recidivism THEN 'recidivism' END) AS flags, count(*) AS n FROM o GROUP BY 1, 2""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    category = registry.triage(F.col("joint"), F.col("n_counts") - 3, F.col("behavior"), F.col("predicted") - F.col("months"), F.col("weight_g"))
    flags = registry.flags_text({"art59": F.col("art59"), "recidivism": F.col("recidivism")})
    return rows.groupBy(category.alias("category"), flags.alias("flags")).agg(F.count("*").alias("n"))


@query(f"""WITH {_OUT}, old AS (SELECT case_id, 'seen ' || case_id AS note FROM cases WHERE jdate < '19950101'),
a AS (SELECT t.case_id, t.abs_residual, coalesce(old.note, '') AS note, false AS dropped FROM top t LEFT JOIN old USING (case_id))
SELECT * FROM a UNION ALL SELECT case_id, NULL, note, true FROM old WHERE case_id NOT IN (SELECT case_id FROM top)""")
def registry_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = cases(spark, sf_dir).where("jdate < '19950101'").select("case_id", F.concat(F.lit("seen "), F.col("case_id").cast("string")).alias("note"))
    return registry.refresh(_top(spark, sf_dir).select("case_id", "abs_residual"), old, "case_id", ["note"]).select("case_id", "abs_residual", "note", "dropped")


@query(f"""WITH {_OUT} SELECT count(*) FILTER (signed_residual > 0) AS n_over, avg(signed_residual) FILTER (signed_residual > 0) AS mean_over, count(*) FILTER (signed_residual < 0) AS n_under, avg(signed_residual) FILTER (signed_residual < 0) AS mean_under, sum(recidivism::INT) / 50 AS recidivism_share FROM top""")
def direction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("signed_residual")
    return _top(spark, sf_dir).groupBy().agg(
        F.count_if(s > 0).alias("n_over"), F.avg(F.when(s > 0, s)).alias("mean_over"), F.count_if(s < 0).alias("n_under"),
        F.avg(F.when(s < 0, s)).alias("mean_under"), (F.sum(F.col("recidivism").cast("int")) / 50).alias("recidivism_share"),
    )


@query("""SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')""")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return registry.pending(events, events.where("event_type = 'click'"), "event_id").select("event_id", "user_id")


@query("""SELECT o.o_orderkey, coalesce(c.status, o.o_orderstatus) AS o_orderstatus, CASE WHEN c.o_orderkey IS NULL THEN o.o_orderpriority ELSE c.note END AS o_orderpriority
FROM orders o LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS status, 'changed' AS note FROM orders WHERE o_orderkey % 7 = 0) c USING (o_orderkey)""")
def override_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"), F.lit("changed").alias("o_orderpriority"))
    return registry.override(orders, changes, "o_orderkey", ["o_orderstatus"], "o_orderpriority")


@query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events) SELECT CASE WHEN position >= 960 THEN 3 WHEN position >= 640 THEN 2 WHEN position >= 320 THEN 1 ELSE 0 END AS shard, count(*) AS n, min(position) AS first, max(position) AS last FROM p GROUP BY 1""")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = folds.with_rank(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", ["ts", "event_id"], "position")
    p = F.col("position")
    shard = F.when(p >= 960, 3).when(p >= 640, 2).when(p >= 320, 1).otherwise(0)
    return ranked.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.last_by_key(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("""WITH t AS (SELECT role, length(text) AS input_tokens, length(text) // 3 AS output_tokens, (turn % 2) * 1.5 AS latency FROM conversations)
SELECT role, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, avg(nullif(latency, 0)) AS mean_latency, (sum(input_tokens) * 1.0 + sum(output_tokens) * 5.0) / 1e6 AS cost_usd FROM t GROUP BY role""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    calls = table(spark, sf_dir, "conversations").select("role", n.alias("input_tokens"), F.expr("length(text) div 3").alias("output_tokens"), ((F.col("turn") % 2) * 1.5).alias("latency"))
    return registry.token_costs(calls, ["role"], {"input_tokens": 1.0, "output_tokens": 5.0}, "latency")


# --- text


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://blog.') AND contains(substr(html, 1, 150), 'lang="en"') THEN 'blog' END AS court FROM pages""")
def prefix_head_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("url").startswith("https://blog.") & text.contains_any(F.substring("html", 1, 150), ('lang="en"',))
    return table(spark, sf_dir, "pages").select("page_id", F.when(hit, F.lit("blog")).alias("court"))


@query("""SELECT doc_id FROM documents WHERE (contains(text, 'License') OR contains(text, '!!')) AND NOT contains(substr(text, 1, 2000), '***')""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = text.contains_any(F.col("text"), ("License", "!!")) & ~text.contains_any(F.substring("text", 1, 2000), ("***",))
    return table(spark, sf_dir, "documents").where(keep).select("doc_id")


@query("""SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS heading FROM pages""")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.section(F.col("html"), "<h1>", ("<",)).alias("heading"))


@query("""WITH p AS (SELECT doc_id, instr(text, 'with') - 1 AS s, text FROM documents)
SELECT doc_id, CASE WHEN s >= 0 THEN substr(replace(replace(substr(text, (greatest(s - 30, 0) + 1)::BIGINT, (s + 4 + 90 - greatest(s - 30, 0))::BIGINT), chr(13), ' '), chr(10), ' '), 1, 400) ELSE '' END AS snippet FROM p""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), "with").alias("snippet"))


@query("""WITH t AS (SELECT unnest(['the', 'and', 'License', '@', '!!']) AS phrase) SELECT phrase, count(*) AS n FROM documents, t WHERE contains(text, phrase) GROUP BY phrase""")
def phrase_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.phrase_counts(table(spark, sf_dir, "documents"), F.col("text"), ("the", "and", "License", "@", "!!"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[!]{2,}') THEN 'aggravating' WHEN regexp_matches(text, 'with [a-z]+') THEN 'mitigating' WHEN regexp_matches(text, '[0-9]+') THEN 'neutral' ELSE 'absent' END AS direction,
  CASE WHEN regexp_matches(text, '[!]{2,}') THEN regexp_extract(text, '[!]{2,}') WHEN regexp_matches(text, 'with [a-z]+') THEN regexp_extract(text, 'with [a-z]+') WHEN regexp_matches(text, '[0-9]+') THEN regexp_extract(text, '[0-9]+') ELSE '' END AS evidence FROM conversations""")
def first_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("aggravating", "[!]{2,}"), ("mitigating", "with [a-z]+"), ("neutral", "[0-9]+")]
    return table(spark, sf_dir, "conversations").withColumn("o", labels.first_match(F.col("text"), rules)).select("conv_id", "turn", "o.*")


@query("""WITH s AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, i, contains(parts[i + 1], 'the')::INT + contains(parts[i + 1], 'with')::INT + contains(parts[i + 1], 'de')::INT AS score FROM s)
SELECT doc_id, max(score) AS score, arg_max(i, (score, -i)) AS i FROM x GROUP BY doc_id""")
def best_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = labels.best_block(F.col("text"), "\n", ("the", "with", "de"))
    return table(spark, sf_dir, "documents").withColumn("b", b).select("doc_id", "b.score", (-F.col("b.minus")).cast("long").alias("i"))


@query("""WITH e AS (SELECT l_orderkey, unnest([l_linenumber]) AS ln, (l_linenumber * 7 + l_partkey % 11)::INT AS lo FROM lineitem),
s AS (SELECT DISTINCT l_orderkey, lo, lo + 6 AS hi FROM e), g AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM g)
SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY l_orderkey, isle""")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = (F.col("l_linenumber") * 7 + F.col("l_partkey") % 11).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(lo.alias("lo"), (lo + 6).alias("hi"))).alias("spans"))
    return rows.select("l_orderkey", F.inline(text.merged_intervals(F.col("spans"))))


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "page string, k int")
    return table(spark, sf_dir, "events").select("event_id", p["page"].alias("page"), p["k"].alias("k"))


# --- rows for models


@query("""SELECT p_partkey, (p_size % 2 = 0)::INT AS is_even, CASE WHEN p_size > 25 THEN p_retailprice ELSE -1.0 END AS max_drug_weight_g, (p_size > 25)::INT AS has_drug_weight, CASE WHEN p_size > 25 THEN ln(1 + p_retailprice) ELSE 0.0 END AS log_drug_weight,
  contains(p_type, 'STEEL')::INT AS hot_steel, contains(p_type, 'BRASS')::INT AS hot_brass FROM part""")
def training_row_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("p_size") > 25, F.col("p_retailprice"))
    words = F.array_compact(F.array(*(F.when(F.contains("p_type", F.lit(w)), F.lit(w)) for w in ("STEEL", "BRASS"))))
    hot = training.one_hot(words, ["STEEL", "BRASS"])
    return table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") % 2 == 0).cast("int").alias("is_even"), *(c.alias(n) for n, c in training.weight_columns(weight).items()),
        hot[0].alias("hot_steel"), hot[1].alias("hot_brass"),
    )


_ASKED_FLAGS = tuple(f for f in training.FLAGS if f in ("art17_1", "art17_2", "art59", "recidivism"))
_SERVED = [
    *(f"{f}::INT AS {f}" for f in _ASKED_FLAGS), "n_behaviors::INT AS n_behaviors", "n_drug_levels::INT AS n_drug_levels", "n_counts::INT AS n_sentence_counts", "112 AS jyear",
    "coalesce(weight, -1.0) AS max_drug_weight_g", "(weight IS NOT NULL)::INT AS has_drug_weight", "coalesce(ln(1 + weight), 0.0) AS log_drug_weight",
    *(f"list_contains(behaviors, '{b}')::INT AS \"b_{b}\"" for b in extract.BEHAVIORS), *(f"list_contains(levels, {v})::INT AS lv_{v}" for v in extract.LEVELS),
    *(f"0 AS {f}" for f in training.FLAGS if f not in _ASKED_FLAGS), "0 AS sum_individual_months", *(f"0 AS a57_{f}_{d}" for f in training.FACTORS for d in training.DIRECTIONS),
    *(f"0 AS \"court_{c}\"" for c in training.COURT_CODES),
]


@query(f"""WITH {CASES}, g AS (SELECT order_id, count(DISTINCT behavior) AS n_behaviors, count(DISTINCT level) AS n_drug_levels, list(behavior) AS behaviors, list(level) AS levels, count(*) AS n_counts,
  {", ".join(f"bool_or({f}) AS {f}" for f in _ASKED_FLAGS)}, CASE WHEN order_id % 3 = 0 THEN max(weight_g)::DOUBLE END AS weight FROM cases GROUP BY order_id)
SELECT order_id AS _order_id, {", ".join(_SERVED)} FROM g""")
def serving_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole serving row of 62 features: what is asked, else 0."""
    asked = cases(spark, sf_dir).groupBy(F.col("order_id").alias("_order_id")).agg(
        F.collect_list("behavior").alias("behaviors"), F.collect_list("level").alias("drug_levels"), *(F.bool_or(f).alias(f) for f in _ASKED_FLAGS),
        F.count("*").alias("n_sentence_counts"), F.first(F.lit(112)).alias("jyear"), F.max("weight_g").cast("double").alias("_w"),
    ).withColumn("max_drug_weight_g", F.when(F.col("_order_id") % 3 == 0, F.col("_w"))).drop("_w")
    return training.serving_rows(asked, [c.split(" AS ")[-1].strip('"') for c in _SERVED])


@query(f"""WITH {CASES} SELECT order_id, court, behavior, months, rank FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY months DESC, case_id) AS rank FROM cases) WHERE rank <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("order_id").orderBy(F.desc("months"), "case_id")
    return cases(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("order_id", "court", "behavior", "months", "rank")


from corvia.plans import judgments, model_queries, review_queries, source_queries  # noqa: E402, F401  register their own
