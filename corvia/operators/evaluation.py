"""Evaluation of the models on expanding folds: every row after the first run is predicted by heads that saw only earlier ones.

All folds and heads are trained in one run (boosting); each fold has its own ensemble over seeds, quantile heads with
their own conformal shifts, probation head and threshold. Predictions are one table; metrics are one grouped
aggregate over it, by fold and over all (fold null), so pooled figures are of rows, not means of folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvia.operators import folds as runs, metrics, models, selection, statute
from corvia.operators.boosting import train as boost
from corvia.sources.written import materialise


def predictions(
    rows: DataFrame, columns: list[str], constraint: Column, order: tuple[str, list[str]] = ("_jdate", ["jid"]), folds: int = 5, least: int = 30,
    seed: int = 7, seeds: int = models.SEEDS, rounds: int = 20, depth: int = 3, rule_clip: bool = True, calibrate: bool = True, **options,
) -> DataFrame:
    """A row for each tested row: the order's columns, fold, y, constraint, raw and final p25, p50, p75, the median of the
    training labels, probation (0 or 1), its probability, threshold and prediction (null where a fold has no such head).

    Edges of bins see the features of all rows, never a label. A fold without test rows, or with fewer than `least` to
    learn from, is left out.
    """
    date, tie = order
    kept = rows.withColumn("_c", constraint)
    edges = lambda n: [k * n // (folds + 1) for k in range(folds + 2)]
    starts = lambda n: max(1, int(n * 0.85))
    ready, bins, n = models.prepared(kept, columns, order, lambda n: [c for e in edges(n) for c in (e, models.held_back(e), starts(e))], ["_c"])
    edge = edges(n)
    used = [k for k in range(folds) if edge[k + 2] > edge[k + 1] >= least]
    seen = ready.agg(*(F.count_if((F.col("p") == 1) & (F.col("rank") < edge[k + 1])).alias(f"n{k}") for k in range(folds))).first()
    heads = [h for k in used for h in models.heads_for(k, edge[k + 1], seen[f"n{k}"], seed, seeds)]
    trained = boost(ready, bins, heads, rounds=rounds, depth=depth, **options) if heads else []
    named = {f"{m.head.name}@{m.head.fold}": m for m in trained}
    names = [f"p50-{i}" for i in range(seeds)] + ["p25", "p75", "probation"]
    parts = []
    for k in used:  # what a fold predicts: its tail, for shift and threshold, and its test rows
        n_train = edge[k + 1]
        mine = ready.where((F.col("rank") >= starts(n_train)) & (F.col("rank") < edge[k + 2]))
        parts.append((k, n_train, mine))
    scores = None
    for k, n_train, mine in parts:
        out = models.scored(mine, {m: named[f"{m}@{k}"] for m in names if f"{m}@{k}" in named}, len(columns))
        if f"probation@{k}" not in named:
            out = out.withColumn("probation", F.lit(None).cast("double"))
        out = out.select(
            date, *tie, "_c", "y", "p", F.lit(k).alias("fold"), (F.col("rank") >= n_train).alias("test"),
            models.mean_of(names[:seeds]).alias("raw50"), F.col("p25").alias("raw25"), F.col("p75").alias("raw75"), F.col("probation").alias("probability"),
        )
        scores = out if scores is None else scores.unionByName(out)
    if scores is None:
        kinds = "fold int, y double, raw25 double, raw50 double, raw75 double, p25 double, p50 double, p75 double, clipped boolean, guess double, p int, probability double, threshold double, probation boolean"
        empty = ready.limit(0)
        return empty.select(date, *tie, F.col("_c").alias("constraint"), *(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in kinds.split(", "))))
    scores = materialise(scores, "scores")
    tail = scores.where("NOT test")
    shifts = {k: (0.0, 0.0) for k in used}
    held = [k for k in used if edge[k + 1] >= 50]  # with fewer rows nothing was held back that could shift
    if calibrate and held:
        for i, (name, alpha) in enumerate(models.QUANTILES.items()):
            e = tail.where(F.col("fold").isin(held)).select("fold", (F.col("y") - F.col(f"raw{name[1:]}")).alias("e"))
            for r in selection.percentiles(e, ["fold"], "e", [alpha]).collect():  # a row a fold
                shifts[r["fold"]] = tuple(r["percentiles"][0] if j == i else s for j, s in enumerate(shifts[r["fold"]]))
    found = tail.where("probability IS NOT NULL").select("fold", F.col("probability").alias("s"), (F.col("p") == 1).alias("positive"))
    thresholds = {r["fold"]: r["threshold"] for r in metrics.best_threshold(found, ["fold"], "s", "positive").collect()}  # a row a fold
    learned = ready.select("y", F.explode(F.array(*(F.when(F.col("rank") < edge[k + 1], k) for k in used))).alias("fold")).where("fold IS NOT NULL")
    guesses = {r["fold"]: r["percentiles"][0] for r in selection.percentiles(learned, ["fold"], "y", [0.5]).collect()}  # a row a fold
    by_fold = lambda values, default: F.coalesce(F.element_at(F.create_map(*(x for k in used for x in (F.lit(k), F.lit(float(values.get(k, default)))))), F.col("fold")), F.lit(default))
    tested = scores.where("test").withColumns({
        "raw25": F.col("raw25") + by_fold({k: s[0] for k, s in shifts.items()}, 0.0), "raw75": F.col("raw75") + by_fold({k: s[1] for k, s in shifts.items()}, 0.0),
        "threshold": by_fold(thresholds, 0.5), "guess": by_fold(guesses, 0.0),
    })
    c = F.col("_c") if rule_clip else F.lit(None).cast(ready.schema["_c"].dataType)
    low, middle, high = (statute.clip(F.col(r), c) for r in ("raw25", "raw50", "raw75"))
    moved = F.coalesce(F.abs(middle - F.col("raw50")) > statute.EPS, F.lit(False))
    done = tested.withColumns({"clipped": moved, "p25": low})
    if rule_clip:  # each was clipped on its own, and so put in order again, rows without a range too
        done = done.withColumn("p50", F.greatest(middle, F.col("p25"))).withColumn("p75", F.greatest(high, F.col("p50")))
    else:
        done = done.withColumns({"p50": middle, "p75": high})
    return done.select(
        date, *tie, F.col("_c").alias("constraint"), "fold", "y", "raw25", "raw50", "raw75", "p25", "p50", "p75", "clipped", "guess", "p",
        "probability", "threshold", (F.col("probability") >= F.col("threshold")).alias("probation"),
    )


def report(found: DataFrame) -> DataFrame:
    """predictions() -> a row for each fold, and one with a null fold for all of them together."""
    y, a, b, d = (F.col(c) for c in ("y", "p25", "p50", "p75"))
    c = F.col("constraint")
    bad = lambda x: F.count_if(c.isNotNull() & ~statute.is_within(x, c))
    e, mean = y - b, lambda x: F.avg(x.cast("double"))
    known, positive, said = F.col("probability").isNotNull(), F.col("p") == 1, F.col("probation")
    right = F.count_if(known & said & positive)
    sums = found.groupingSets([["fold"], []], "fold").agg(
        F.count("*").alias("n"), mean(F.abs(e)).alias("mae"), mean(F.abs(y - F.col("raw50"))).alias("raw_mae"), F.sqrt(mean(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0)))).alias("r2"),
        mean(F.abs(e) <= 3).alias("hit3"), mean(F.abs(e) <= 6).alias("hit6"),
        metrics.pinball(y, a, 0.25).alias("pinball25"), metrics.pinball(y, b, 0.5).alias("pinball50"), metrics.pinball(y, d, 0.75).alias("pinball75"),
        metrics.coverage(y, a, d).alias("coverage"), metrics.crossings(F.col("raw25"), F.col("raw50"), F.col("raw75")).alias("crossed"),
        F.count_if("clipped").alias("n_clipped"), F.count_if(c.isNotNull()).alias("n_constrained"),
        bad(y).alias("bad_truth"), bad(F.col("raw50")).alias("bad_raw"), bad(b).alias("bad_final"),
        mean(F.abs(y - F.col("guess"))).alias("median_baseline_mae"),
        F.try_divide(F.count_if(known & positive), F.count_if(known)).alias("probation_base"),
        F.try_divide(F.count_if(known & (said == positive)), F.count_if(known)).alias("probation_accuracy"),
        F.coalesce(F.try_divide(right, F.count_if(known & said)), F.lit(0.0)).alias("probation_precision"),
        F.coalesce(F.try_divide(right, F.count_if(known & positive)), F.lit(0.0)).alias("probation_recall"),
    )
    scores = found.where(known).select("fold", "probability", positive.alias("positive"))
    each = metrics.average_precision(scores, ["fold"], "probability", "positive").select("fold", "average_precision")
    whole = metrics.average_precision(scores, [], "probability", "positive").select(F.lit(None).cast("int").alias("fold"), "average_precision")
    ap = each.unionByName(whole).withColumnRenamed("fold", "of")
    return sums.join(ap, F.col("fold").eqNullSafe(F.col("of")), "left").drop("of")


def errors_by(found: DataFrame, by: list[str]) -> DataFrame:
    """n, mae and the median error of each group over all folds, as metrics.group_errors."""
    return metrics.group_errors(found, by, "y", "p50")
