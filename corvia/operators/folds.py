"""Temporal order: ranks without a global sort in one task, expanding folds, tails, conformal shifts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType, TimestampType

from corvia.operators import selection
from corvia.sources.written import discard, materialise


def with_rank(df: DataFrame, date: str, tie: list[str], name: str = "rank", deal: int = 64) -> DataFrame:
    """A 0-based rank by date, then tie.

    Dates are few: their counts are summed up over the calendar. A date may hold a third of all rows, so its rows are
    numbered inside `deal` equal parts of the range that the first tie column has on it; counts of parts are few as
    well. A tie column that is no number or time has no such range: then a date is numbered whole.
    """
    if _has_range(df, tie[0]):
        x = F.col(tie[0]).cast("double")
        ranges = df.groupBy(date).agg(F.min(x).alias("_lo"), F.max(F.when(~F.isnan(x), x)).alias("_hi")).withColumnRenamed(date, "_day")
        part = F.when(x.isNull(), -1).when(F.isnan(x), deal + 1).when(F.col("_hi") > F.col("_lo"), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * deal)).otherwise(0)
        parted = df.join(ranges, F.col(date).eqNullSafe(F.col("_day"))).withColumn("_part", part.cast("int")).drop("_day", "_lo", "_hi")
    else:
        parted = df.withColumn("_part", F.lit(0))
    parts = parted.groupBy(date, "_part").agg(F.count("*").alias("_n"))
    earlier = W.orderBy(date, "_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col(date).alias("_date"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(date, "_part").orderBy(*tie)
    ranked = parted.withColumn("_in", F.row_number().over(inside) - 1)
    met = ranked.join(parts, F.col(date).eqNullSafe(F.col("_date")) & (F.col("_part") == F.col("_of")))
    return met.withColumn(name, F.col("_before") + F.col("_in")).drop("_date", "_before", "_in", "_of", "_part")


def with_sides(df: DataFrame, date: str, tie: list[str], cuts: Callable[[int], list[int]], name: str = "rank") -> tuple[DataFrame, int]:
    """df, written, with a number that is below, at or above each of cuts(number of rows) as the rank of with_rank is; and the number of rows.

    Counts of dates tell on which ones a cut lies. Only those dates' rows are ranked; others get the highest cut that is before their date.
    """
    counts = df.groupBy(date).agg(F.count("*").alias("_n"))
    upto = materialise(counts.withColumn("_upto", F.sum("_n").over(W.orderBy(date))), "dates")  # dates are few
    n = upto.agg(F.max("_upto")).first()[0] or 0
    inner = sorted({c for c in cuts(n) if 0 < c < n})
    hit = F.array(*map(F.lit, inner)).cast("array<long>")
    on = upto.where(F.exists(hit, lambda c: (c > F.col("_upto") - F.col("_n")) & (c <= F.col("_upto")))).orderBy(date).collect()  # a date a cut
    discard(upto)
    day, lit = F.col(date), lambda v: F.lit(v).cast(df.schema[date].dataType)
    side, split, before, seen = F.lit(0), F.lit(False), F.lit(0), 0
    for r in on:  # in order, so the last of what holds is the highest
        mine = [c for c in inner if r["_upto"] - r["_n"] < c <= r["_upto"]]
        later = day.isNotNull() if r[date] is None else F.coalesce(day > lit(r[date]), F.lit(False))
        side = F.when(later, mine[-1]).otherwise(side)
        if mine[0] < r["_upto"]:
            same = day.eqNullSafe(lit(r[date]))
            split, before = split | same, F.when(same, r["_upto"] - r["_n"] - seen).otherwise(before)
            seen += r["_n"]
    # In a written column: long conditions are not worked out again wherever the rank is read.
    out = materialise(df.withColumn(name, F.when(~split, side.cast("long"))), "sides")
    if not seen:
        return out, n
    ranked = with_rank(out.where(F.col(name).isNull()).drop(name), date, tie, name)
    ranked = materialise(ranked.withColumn(name, (F.col(name) + before).cast("long")), "cut-dates")
    return out.where(F.col(name).isNotNull()).unionByName(ranked), n


def _has_range(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (NumericType, TimestampType))


def walk_forward(df: DataFrame, date: str, tie: list[str], folds: int = 5, least: int = 30) -> DataFrame:
    """A row for each row and fold that has it: fold, role (train or test).

    Rows are cut into folds + 1 runs of equal length; fold k trains on the first k + 1 and tests on the next.
    Folds without test rows, or with fewer than `least` to train on, are left out.
    """
    ranked = with_rank(df, date, tie)
    n = df.agg(F.count("*").alias("_total"))
    ranked = ranked.crossJoin(F.broadcast(n))  # one row
    edge = lambda k: F.expr(f"({k}) * _total div {folds + 1}")
    held = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    low, high = edge("fold + 1"), edge("fold + 2")
    role = F.when(F.col("rank") < low, F.lit("train")).when(F.col("rank") < high, F.lit("test"))
    return held.withColumn("role", role).where(F.col("role").isNotNull() & (high > low) & (low >= least)).drop("_total")


def tail_shift(df: DataFrame, date: str, tie: list[str], y: str, prediction: str, alpha: float, share: float = 0.85, least: int = 50) -> DataFrame:
    """The alpha quantile of y - prediction on the last rows in order; 0 for fewer than `least` rows.

    Counts of dates tell on which one the tail begins; only that date's rows are ranked.
    """
    n = df.count()
    start = max(1, int(n * share))
    upto = F.sum("count").over(W.orderBy(date))  # dates are few
    edge = df.groupBy(date).count().withColumn("_upto", upto).where(F.col("_upto") > start).orderBy("_upto").first()
    e = (F.col(y) - F.col(prediction)).alias("e")
    if edge is None:
        tail = df.limit(0).select(e)
    else:
        day = F.lit(edge[date]).cast(df.schema[date].dataType)
        later = F.col(date).isNotNull() if edge[date] is None else F.col(date) > day
        first = with_rank(df.where(F.col(date).eqNullSafe(day)), date, tie).where(F.col("rank") >= start - (edge["_upto"] - edge["count"]))
        tail = df.where(later).select(e).unionByName(first.select(e))
    found = selection.percentiles(tail, [], "e", [alpha]).select(F.col("percentiles")[0].alias("p"))
    one = tail.agg(F.count("e").alias("n_tail"))
    shift = F.lit(0.0) if n < least else F.col("p")
    return one.join(found, F.lit(True), "left").select("n_tail", shift.alias("shift"))  # a row each


def sample_by_hash(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows on every run and for every partitioning."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
