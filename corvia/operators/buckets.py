"""Look-up buckets: statistics by key, look-up with relaxation, conditional means, attribution in steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.operators import selection


def bucket_stats(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """keys, n, p25, p50, p75, mean; percentiles between ranks, rounded to one place; groups of fewer than `least` go."""
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).alias("_v"))
    sums = rows.groupBy("_key").agg(F.count("_v").alias("n"), F.round(F.avg("_v"), 1).alias("mean")).where(F.col("n") >= least)
    q = selection.percentiles(rows, ["_key"], "_v", [0.25, 0.5, 0.75]).select("_key", "percentiles")
    at = [F.round(F.col("percentiles")[i], 1).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return sums.join(q, "_key").select("_key.*", "n", *at, "mean")


def lookup_cascade(cases: DataFrame, buckets: DataFrame, exact: list[str], relaxed: list[str], loose: list[str], value: str) -> DataFrame:
    """cases with value and step: from the bucket of all keys, else fewer, else fewest.

    Where several buckets share the fewer keys, the one with the most rows serves, then the least by the other
    keys: the order of a file is no order of a table.
    """
    out = cases
    for i, keys in enumerate((exact, relaxed, loose), 1):
        first = W.partitionBy(*keys).orderBy(F.desc("n"), *[k for k in exact if k not in keys])
        best = buckets.withColumn("_r", F.row_number().over(first)).where("_r = 1")
        best = best.select(*(F.col(k).alias(f"_k{i}{j}") for j, k in enumerate(keys)), F.col(value).alias(f"_v{i}"))
        out = out.join(best, [F.col(k) == F.col(f"_k{i}{j}") for j, k in enumerate(keys)], "left").drop(*(f"_k{i}{j}" for j in range(len(keys))))
    found = [F.col(f"_v{i}") for i in (1, 2, 3)]
    step = F.when(found[0].isNotNull(), 1).when(found[1].isNotNull(), 2).when(found[2].isNotNull(), 3)
    return out.withColumns({value: F.coalesce(*found), "step": step}).drop("_v1", "_v2", "_v3")


def conditional_mean(where: Column, value: str = "p50", weight: str = "n") -> Column:
    """Mean of the buckets' values weighted by their rows, as an aggregate."""
    return F.try_divide(F.sum(F.when(where, F.col(value) * F.col(weight))), F.sum(F.when(where, F.col(weight))))


def waterfall(buckets: DataFrame, by: list[str], steps: list[tuple[str, Column]], value: str = "p50") -> DataFrame:
    """by, position, step, level, change: the conditional mean as conditions are added, and what each adds.

    A step without buckets has null level and change and does not move the level that the next is compared to,
    so the changes add up from the first level to the last.
    """
    conditions, so_far = [], F.lit(True)
    for _, c in steps:
        so_far = so_far & c
        conditions.append(so_far)
    levels = buckets.groupBy(*by).agg(*(conditional_mean(c, value).alias(f"_s{i}") for i, c in enumerate(conditions)))
    rows = levels.select(
        *by, F.posexplode(F.array(*(F.struct(F.lit(name).alias("step"), F.col(f"_s{i}").alias("level")) for i, (name, _) in enumerate(steps))))
    ).select(*by, F.col("pos").alias("position"), "col.*")
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("change", F.col("level") - F.last("level", ignorenulls=True).over(earlier))
