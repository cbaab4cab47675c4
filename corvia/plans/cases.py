"""A case table made from lineitem, for queries that need the columns of judgments; and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvia.operators import statute

BEHAVIORS = tuple(statute.SEVERITY)
FLAG_MODULI = {"art17_1": 2, "art17_2": 3, "art59": 5, "attempt": 7, "surrender": 11, "recidivism": 13, "summary": 17}
COURTS = ("KL", "TP", "SL", "PC", "TY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {name: F.col("l_orderkey") % m == 0 for name, m in FLAG_MODULI.items()}
    return table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")) * 101 + F.col("l_suppkey") % 101).alias("case_id"), F.col("l_orderkey").alias("order_id"),
        _pick(BEHAVIORS, F.col("l_partkey")).alias("behavior"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("level"),
        F.col("l_quantity").alias("weight_g"), (F.col("l_linenumber") * F.col("l_quantity")).alias("months"),
        *(c.alias(n) for n, c in flags.items()), _pick(COURTS, F.col("l_orderkey")).alias("court"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("jdate"), (F.col("l_quantity") * 2 + F.col("l_discount") * 100).alias("predicted"),
        F.col("l_linenumber").alias("n_counts"), (F.col("l_returnflag") == "R").alias("joint"),
    )


REDUCTIONS = ["art17_1", "art17_2", "art59", "attempt", "surrender"]


def constrained_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases with the column c, the range of each after reductions."""
    return statute.with_constraint(cases(spark, sf_dir), "c", "behavior", "level", REDUCTIONS, "recidivism", "summary", "weight_g")


_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
CASES = f"""cases AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 101 + l_suppkey % 101 AS case_id, l_orderkey AS order_id, {_list(BEHAVIORS)}[l_partkey % 7 + 1] AS behavior,
    (l_suppkey % 4 + 1)::INT AS level, l_quantity AS weight_g, l_linenumber * l_quantity AS months,
    {", ".join(f"l_orderkey % {m} = 0 AS {n}" for n, m in FLAG_MODULI.items())},
    {_list(COURTS)}[l_orderkey % 5 + 1] AS court, strftime(l_shipdate, '%Y%m%d') AS jdate, l_quantity * 2 + l_discount * 100 AS predicted,
    l_linenumber AS n_counts, l_returnflag = 'R' AS joint
  FROM lineitem)"""
PENALTY = """penalty(behavior, level, lo, hi, life, capital) AS (VALUES
  ('販賣', 1, 180.0, 360.0, true, true), ('販賣', 2, 120, 360, true, false), ('販賣', 3, 84, 360, false, false), ('販賣', 4, 60, 144, false, false),
  ('運輸', 1, 180, 360, true, true), ('運輸', 2, 120, 360, true, false), ('運輸', 3, 84, 360, false, false), ('運輸', 4, 60, 144, false, false),
  ('製造', 1, 180, 360, true, true), ('製造', 2, 120, 360, true, false), ('製造', 3, 84, 360, false, false), ('製造', 4, 60, 144, false, false),
  ('意圖販賣而持有', 1, 120, 360, true, false), ('意圖販賣而持有', 2, 60, 144, false, false), ('意圖販賣而持有', 3, 36, 120, false, false), ('意圖販賣而持有', 4, 12, 84, false, false),
  ('轉讓', 1, 12, 84, false, false), ('轉讓', 2, 6, 60, false, false), ('轉讓', 3, 0, 36, false, false), ('轉讓', 4, 0, 12, false, false),
  ('施用', 1, 6, 60, false, false), ('施用', 2, 0, 36, false, false),
  ('持有', 1, 0, 36, false, false), ('持有', 2, 0, 24, false, false), ('持有', 3, 0, 12, false, false), ('持有', 4, 0, 12, false, false))"""
BASE = f"""{CASES}, {PENALTY}, based AS (
  SELECT c.*, CASE WHEN c.behavior = '持有' AND c.level = 1 AND weight_g >= 10 THEN 12 WHEN c.behavior = '持有' AND c.level = 2 AND weight_g >= 20 THEN 6 ELSE p.lo END AS lo,
    CASE WHEN c.behavior = '持有' AND c.level = 1 AND weight_g >= 10 THEN 84 WHEN c.behavior = '持有' AND c.level = 2 AND weight_g >= 20 THEN 60 ELSE p.hi END AS hi,
    p.life, p.capital
  FROM cases c LEFT JOIN penalty p USING (behavior, level)),
reduced AS (
  SELECT * EXCLUDE (lo, hi, life, capital), lo * f * CASE WHEN summary AND lo * f > 0 THEN 0.5 ELSE 1 END AS lo,
    CASE WHEN hi IS NULL THEN NULL WHEN recidivism THEN least(hi * f * 1.5, 360) ELSE hi * f END AS hi, CASE WHEN lo IS NOT NULL THEN life AND k = 0 END AS life, CASE WHEN lo IS NOT NULL THEN capital AND k = 0 END AS capital
  FROM (SELECT *, art17_1::INT + art17_2::INT + art59::INT + attempt::INT + surrender::INT AS k, pow(0.5, art17_1::INT + art17_2::INT + art59::INT + attempt::INT + surrender::INT) AS f FROM based))"""
