"""Evaluation metrics as grouped aggregates; rows never leave the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.operators import selection
from corvia.sources.written import materialise


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def regression(df: DataFrame, by: list[str], y: str, prediction: str, raw: str | None = None) -> DataFrame:
    """n, mae, raw_mae, rmse, r2 (1 - SSE / SST, null for one value), hit3, hit6."""
    e = F.col(y) - F.col(prediction)
    spread = F.var_pop(F.col(y)) * F.count("*")
    out = [
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.nullif(spread, F.lit(0.0)))).alias("r2"),
        F.avg((F.abs(e) <= 3).cast("double")).alias("hit3"), F.avg((F.abs(e) <= 6).cast("double")).alias("hit6"),
    ]
    if raw:
        out.append(F.avg(F.abs(F.col(y) - F.col(raw))).alias("raw_mae"))
    return df.groupBy(*by).agg(*out)


def pinball(y: Column, q: Column, alpha: float) -> Column:
    """Mean quantile loss, to be used as an aggregate."""
    return F.avg(F.greatest((y - q) * alpha, (y - q) * (alpha - 1)))


def coverage(y: Column, low: Column, high: Column, slack: float = 0.0) -> Column:
    return F.avg(y.between(low - slack, high + slack).cast("double"))


def crossings(p25: Column, p50: Column, p75: Column, eps: float = 1e-6) -> Column:
    return F.count_if((p25 > p50 + eps) | (p50 > p75 + eps))


def group_errors(df: DataFrame, by: list[str], y: str, prediction: str) -> DataFrame:
    """n, mae, median_abs_error of each group; the median by ranges of the errors."""
    errors = df.select(F.struct(F.lit(0).alias("_"), *by).alias("_g"), F.abs(F.col(y) - F.col(prediction)).alias("_e"))
    sums = errors.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_e").alias("mae"))
    median = selection.percentiles(errors, ["_g"], "_e", [0.5]).select("_g", F.col("percentiles")[0].alias("median_abs_error"))
    return sums.join(median, "_g", "left").select(*(F.col("_g").getField(c).alias(c) for c in by), "n", "mae", "median_abs_error")


def nearest_rank_quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The values at places n/4, n/2 and 3n/4 (rounded down, from 0) in order, mean and greatest."""
    rows = df.select(F.struct(F.lit(0).alias("_"), *by).alias("_g"), F.col(value).alias("_v"))
    sums = rows.where("_v IS NOT NULL").groupBy("_g").agg(F.avg("_v").alias("mean"), F.max("_v").alias("max"))
    at = selection.at_ranks(rows, ["_g"], "_v", [lambda n, k=k: F.floor(n * k / 4) for k in (1, 2, 3)])
    return at.join(sums, "_g").select(
        *(F.col("_g").getField(c).alias(c) for c in by), "n", *(F.col("values")[k - 1].alias(f"q{k}") for k in (1, 2, 3)), "mean", "max"
    )


def average_precision(df: DataFrame, by: list[str], score: str, positive: str, limit: int = 200_000) -> DataFrame:
    """Steps of recall times precision, ties of score taken together; null without positives.

    Running sums go over ranges of the scores first: each group is cut at up to `n / limit` edges of a sketch, the sums of
    its ranges are added up, and only rows of one range are put in order together.
    """
    g = F.struct(F.lit(0).alias("_"), *by)
    steps = df.groupBy(g.alias("g"), F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count("*").alias("k"))
    steps = materialise(steps, "scores")
    most = steps.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cuts = min(10_000, -(-most // limit))
    down = lambda *w: W.partitionBy(*w).orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    if cuts <= 1:
        run = steps.withColumns({"tp": F.sum("p").over(down("g")), "upto": F.sum("k").over(down("g"))})
    else:
        share = [i / cuts for i in range(1, cuts)]
        edges = materialise(steps.groupBy("g").agg(F.array_distinct(F.percentile_approx("s", share, 4 * cuts)).alias("e")), "score-edges")
        parts = steps.join(edges, "g").select("g", "s", "p", "k", F.size(F.filter("e", lambda e: e < F.col("s"))).alias("part"))
        sums = parts.groupBy("g", "part").agg(F.sum("p").alias("above_p"), F.sum("k").alias("above_k"))
        before = W.partitionBy("g").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select("g", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("above_p", "above_k")))
        run = parts.join(sums, ["g", "part"]).withColumns({
            "tp": F.col("above_p") + F.sum("p").over(down("g", "part")), "upto": F.col("above_k") + F.sum("k").over(down("g", "part")),
        })
    out = run.groupBy("g").agg(
        F.sum("k").alias("n"), F.sum("p").alias("positives"), F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("upto")), F.sum("p")).alias("average_precision"),
    ).select(*(F.col("g").getField(c).alias(c) for c in by), "n", "positives", "average_precision")
    base = F.col("positives") / F.col("n")
    return out.withColumn("base_rate", base).withColumn("lift", F.col("average_precision") / F.greatest(base, F.lit(1e-9)))


def confusion(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; rows without an actual value do not count, a missing prediction is no."""
    p = F.coalesce(predicted, F.lit(False))
    cells = df.where(actual.isNotNull()).groupBy(*by).agg(
        F.count_if(p & actual).alias("tp"), F.count_if(p & ~actual).alias("fp"),
        F.count_if(~p & actual).alias("fn"), F.count_if(~p & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return cells.withColumns({
        "precision": precision, "recall": recall, "f1": _div(2 * tp, 2 * tp + fp + fn), "accuracy": _div(tp + tn, tp + fp + fn + tn),
    })


def best_threshold(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """The threshold of 0.05, 0.10 .. 0.95 with the best F1, the least of equals; 0.5 below two positives.

    The grid is an array inside the aggregate, not a join: each row adds to its own steps only.
    """
    grid = [round(0.05 * i, 2) for i in range(1, 20)]
    parts = []
    for i, t in enumerate(grid):
        hit = F.col(score) >= t
        parts += [F.count_if(hit & F.col(positive)).alias(f"_tp{i}"), F.count_if(hit).alias(f"_k{i}")]
    sums = df.groupBy(*by).agg(F.count_if(F.col(positive)).alias("positives"), *parts)
    scored = F.array(*(
        F.struct(_div(2.0 * F.col(f"_tp{i}"), F.col(f"_k{i}") + F.col("positives")).alias("f1"), F.lit(-t).alias("minus")) for i, t in enumerate(grid)
    ))
    best = F.array_max(scored)
    return sums.select(
        *by, "positives",
        F.when(F.col("positives") >= 2, F.when(best["f1"] > 0, -best["minus"]).otherwise(0.5)).otherwise(0.5).alias("threshold"),
        F.when(F.col("positives") >= 2, best["f1"]).alias("f1"),
    )


def class_weight(positive: str) -> Column:
    """Square root of negatives over positives, at least 1; an aggregate."""
    p = F.count_if(F.col(positive))
    return F.sqrt(F.greatest(F.lit(1.0), (F.count("*") - p) / F.greatest(p, F.lit(1))))


def set_agreement(df: DataFrame, by: list[str], auto: str, truth: str) -> DataFrame:
    """Mean Jaccard of rows and precision and recall of all elements; rows without truth, or with both empty, do not count."""
    a, t = F.coalesce(F.col(auto), F.array().cast("array<string>")), F.col(truth)
    used = df.where(t.isNotNull() & (F.size(t) > 0))
    both, either = F.size(F.array_intersect(a, t)), F.size(F.array_union(a, t))
    return used.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(both / either).alias("jaccard"),
        _div(F.sum(both), F.sum(F.size(F.array_distinct(a)))).alias("precision"), _div(F.sum(both), F.sum(F.size(F.array_distinct(t)))).alias("recall"),
    )


def numeric_agreement(df: DataFrame, by: list[str], auto: str, truth: str) -> DataFrame:
    """Share of exact matches and mean absolute error; a missing value counts as 0."""
    e = F.abs(F.coalesce(F.col(auto), F.lit(0)) - F.col(truth))
    return df.where(F.col(truth).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((e == 0).cast("double")).alias("exact"), F.avg(e.cast("double")).alias("mae")
    )
