"""Exact order statistics by group, for groups of any size: counts of ranges first, then only the range that holds a rank.

Equal values of a group are counted once, in a written table, so what the rows come from is computed a single time. A group's values are cut at edges from a bounded sketch. Counting the cells (each edge is a cell of its own, and so is
each gap between edges) and adding up over a group's few cells tells which cell holds a wanted rank; only rows of such
cells go on, to be cut again, until no cell has more than `limit` rows. Those few are put in order. A value that a third of all rows
share becomes an edge, so its cell is done at once. No task ever holds a group's values, and rows are
pre-aggregated before each shuffle.

Null values do not count; NaN comes last; a null in a group's columns is a group; a group of nulls alone is no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.sources.written import discard, materialise

#: Rows of a cell that one task puts in order, and cuts of a group at once.
LIMIT, CUTS = 200_000, 64


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: list[Callable[[Column], Column]], limit: int = LIMIT, count: str | None = None) -> DataFrame:
    """by, n, values: of each group its number of values, and those at the given ranks (from 0, as functions of n).

    A row stands for as many values as its column `count` says, or for one.
    """
    given = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).alias("v"), (F.col(count) if count else F.lit(1)).alias("k"))
    rows = materialise(given.groupBy("g", "v").agg(F.sum("k").alias("k")), "counted").withColumn("cell", F.lit(""))
    groups = rows.groupBy("g").agg(F.sum("k").alias("n"), F.count("*").alias("d"))
    most = groups.agg(F.max("d")).first()[0] or 0
    groups = groups.drop("d")
    if most > limit:
        groups = materialise(groups, "groups")
    n = F.col("n")
    asked = F.array(*(F.struct(F.lit(i).alias("i"), r(n).cast("long").alias("r")) for i, r in enumerate(ranks)))
    need = groups.select("g", F.lit("").alias("cell"), F.explode(asked).alias("x")).select("g", "cell", "x.*")  # rank r within the cell
    done = None
    held = None
    while most > limit:
        cells, found, need = _cut(rows, need)
        found = materialise(found, "found")
        done = found if done is None else done.unionByName(found)
        need = materialise(need, "needed")
        wanted = need.select("g", "cell").distinct()
        rows = materialise(cells.join(wanted, ["g", "cell"]), "cells")
        if held is not None:
            discard(held)
        held = rows
        most = rows.groupBy("g", "cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    upto = F.sum("k").over(W.partitionBy("g", "cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto)  # cells of at most `limit` values
    hit = placed.join(need, ["g", "cell"]).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("k"))).select("g", "i", "v")
    hit = hit if done is None else hit.unionByName(done)
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])  # a few a group
    out = hit.groupBy("g").agg(values.alias("values")).join(groups, "g")
    return out.select(*(F.col("g").getField(c).alias(c) for c in by), "n", "values")


def _cut(rows: DataFrame, need: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in finer cells; the ranks that fell on an edge, with its value; and the others, in their new cells."""
    share = [i / CUTS for i in range(1, CUTS)]
    edges = materialise(rows.groupBy("g", "cell").agg(F.array_distinct(F.percentile_approx("v", share, 4 * CUTS)).alias("e")), "edges")
    below = F.size(F.filter("e", lambda e: e < F.col("v")))
    on = F.array_contains("e", F.col("v"))
    placed = rows.join(edges, ["g", "cell"]).select("g", "v", "k", "cell", (2 * below + on.cast("int")).alias("part"))
    counts = placed.groupBy("g", "cell", "part").agg(F.sum("k").alias("k"), F.min("v").alias("v"))
    whole = W.partitionBy("g", "cell").orderBy("part").rowsBetween(W.unboundedPreceding, 0)  # at most 2 * CUTS rows
    counts = counts.withColumn("upto", F.sum("k").over(whole))
    met = need.join(counts, ["g", "cell"]).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("k")))
    finer = F.concat_ws("/", "cell", F.col("part").cast("string"))
    found = met.where("part % 2 = 1").select("g", "i", "v")
    left = met.where("part % 2 = 0").select("g", finer.alias("cell"), "i", (F.col("r") - (F.col("upto") - F.col("k"))).alias("r"))
    return placed.where("part % 2 = 0").select("g", "v", "k", finer.alias("cell")), found, left


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], limit: int = LIMIT, count: str | None = None) -> DataFrame:
    """by, n, percentiles: interpolated between the two nearest ranks of (n - 1) * share."""
    place = lambda s: lambda n: (n - 1) * F.lit(s)
    ranks = [f for s in shares for f in (lambda n, s=s: F.floor(place(s)(n)), lambda n, s=s: F.ceil(place(s)(n)))]
    found = at_ranks(df, by, value, ranks, limit, count)

    def between(i: int, s: float) -> Column:
        at = place(s)(F.col("n"))
        low, high = (F.col("values")[2 * i + j].cast("double") for j in (0, 1))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*by, "n", F.array(*(between(i, s) for i, s in enumerate(shares))).alias("percentiles"))
