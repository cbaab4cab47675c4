"""Connected components of a table of links, by aggregation and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvia.llm.store import materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """u, v (comparable ids, either order, repeats and loops allowed) -> id, component.

    component is the smallest id that the links reach; ids without links to others have no row.
    Alternates two star operations: every node's greater neighbours, then its smaller ones, are tied to
    the least node around. The link table never grows beyond twice its size and becomes stars in a
    logarithmic number of rounds. Nothing is gathered by node; minima are aggregated and joined back.
    """
    edges = materialise(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialise(least, "least")  # a hub's rows can then be split in the join
        large = (
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = materialise(large, "large-star")
        around = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(around, "u")
        small = (
            tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(around.select("u", F.col("m").alias("v")))
        ).distinct()
        small = materialise(small, "small-star")
        # A star forest: no node that is tied to another is itself tied to.
        again = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = small.groupBy("u").count().where("count > 1")
        if again.isEmpty() and several.isEmpty():
            leaves = small.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return leaves.unionByName(small.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        edges = small
    raise RuntimeError(f"no star forest after {max_rounds} rounds")
