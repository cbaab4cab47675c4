"""Sentence and probation models on training rows, with ranges applied to what they predict.

All heads (an ensemble of medians over seeds, two quantiles, probation) are boosted trees trained together in one
run over the data; see boosting. Quantile heads are shifted so that on the last 15 % of the rows in order
exactly their share lies below. With fewer than 50 rows nothing is held back: all rows teach, shifts are 0.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvia.operators import folds, selection, statute
from corvia.operators.boosting import Bins, Boosted, Head, Tree, _bytes, binned, learn_bins, train as boost
from corvia.operators.metrics import best_threshold

LABEL, PROBATION = "sentence_months", "_probation"
SEEDS = 3
QUANTILES = {"p25": 0.25, "p75": 0.75}


@dataclass
class Bundle:
    columns: list[str]
    bins: Bins
    heads: dict[str, Boosted]  # p50-0 .. p50-2, p25, p75 and, where there are positives, probation
    metadata: dict = field(default_factory=dict)


def held_back(n: int) -> int:
    """The rows that teach, of n in order; the others are the tail."""
    return n if n < 50 else max(1, int(n * 0.85))


def heads_for(fold: int, n: int, positives: int, seed: int, seeds: int = SEEDS) -> list[Head]:
    fit = held_back(n)
    out = [Head(f"p50-{i}", fold, 0.5, seed + i, fit, n) for i in range(seeds)] + [Head(k, fold, a, seed, fit, n) for k, a in QUANTILES.items()]
    if 2 <= positives < n:
        out.append(Head("probation", fold, None, seed, fit, n, max(1.0, (n - positives) / positives) ** 0.5))
    return out


def prepared(
    rows: DataFrame, columns: list[str], order: tuple[str, list[str]], cuts: Callable[[int], list[int]], keep: list[str] | None = None,
) -> tuple[DataFrame, Bins, int]:
    """rank (as far as cuts of the number of rows need it: folds.with_sides), key, y, p, the bytes of features' bins, and the columns to keep;
    the bins; the number of rows. All is in a written table; no row is shuffled but those of dates on which a cut lies."""
    date, tie = order
    bins = learn_bins(rows, columns)
    known = rows.withColumns({"key": F.xxhash64(*(F.col(c).cast("string") for c in tie)), "y": F.col(LABEL).cast("double"), "p": F.coalesce(F.col(PROBATION), F.lit(0)).cast("int")})
    slim = binned(known, bins).select(date, *tie, "key", "y", "p", "x", *(keep or []))
    ready, n = folds.with_sides(slim, date, tie, cuts)
    return ready, bins, n


def scored(rows: DataFrame, models: dict[str, Boosted], width: int) -> DataFrame:
    """rows with a column for each model's prediction, in one pass; rows have the bytes x, and only these go to Python."""

    @F.arrow_udf("struct<" + ", ".join(f"`{n}`: double" for n in models) + ">")
    def score(x: pa.Array) -> pa.Array:
        values = np.asfortranarray(_bytes(x, np.uint8, width))
        return pa.StructArray.from_arrays([pa.array(m.predict(values)) for m in models.values()], list(models))

    return rows.withColumn("_scores", score("x")).select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col("_scores")[n].alias(n) for n in models))


def mean_of(names: list[str]) -> Column:
    return sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`")) / len(names)


def _fitted(rows: DataFrame, columns: list[str], order: tuple[str, list[str]], seed: int, only: list[str] | None, **options) -> tuple[DataFrame, Bins, int, int, dict[str, Boosted]]:
    """Prepared rows, bins, numbers of rows and of positives, and the heads on all rows, or only some of them: no head hangs on another."""
    ready, bins, n = prepared(rows, columns, order, lambda n: [held_back(n), n])
    positives = ready.where("p = 1").count()
    heads = [h for h in heads_for(0, n, positives, seed) if only is None or h.name in only]
    return ready, bins, n, positives, {m.head.name: m for m in boost(ready, bins, heads, **options)}


def first_median(rows: DataFrame, columns: list[str], order: tuple[str, list[str]] = ("_jdate", ["jid"]), rounds: int = 20, depth: int = 3, seed: int = 7, **options) -> tuple[Boosted, Bins]:
    """The head p50-0 of train(), and the bins, without training the others."""
    _, bins, _, _, heads = _fitted(rows, columns, order, seed, ["p50-0"], rounds=rounds, depth=depth, **options)
    return heads["p50-0"], bins


def train(rows: DataFrame, columns: list[str], order: tuple[str, list[str]] = ("_jdate", ["jid"]), rounds: int = 20, depth: int = 3, seed: int = 7, **options) -> Bundle:
    """All heads on all rows; the last 15 % in order are held back for the number of rounds, the threshold and the shifts."""
    ready, bins, n, positives, heads = _fitted(rows, columns, order, seed, None, rounds=rounds, depth=depth, **options)
    about = {"n_rows": n, "base_rate": positives / n if n else 0.0, "threshold": 0.5, "delta25": 0.0, "delta75": 0.0, "calibrated": n >= 50}
    if n >= 50:
        tail = scored(ready.where(F.col("rank") >= held_back(n)).select("y", "p", "x"), {k: m for k, m in heads.items() if not k.startswith("p50")}, len(columns))
        for k, a in QUANTILES.items():
            found = selection.percentiles(tail.select((F.col("y") - F.col(k)).alias("e")), [], "e", [a]).first()
            about[f"delta{k[1:]}"] = float(found["percentiles"][0])
        if "probation" in heads:
            late = tail.select(F.col("probation").alias("s"), (F.col("p") == 1).alias("p"))
            about["threshold"] = float(best_threshold(late, [], "s", "p").first()["threshold"])
    return Bundle(columns, bins, heads, about)


def predict(bundle: Bundle, rows: DataFrame, constraint: Column) -> DataFrame:
    """rows with raw, p25, p50, p75 within the range and in order, clipped, rule_applied, probation and its probability.

    p25 and p75 are shifted as the bundle says before they are clipped; raw is the mean of the medians, unclipped.
    """
    own = rows.select(F.struct(*rows.columns).alias("_row"), constraint.alias("_c"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(bundle.columns)))
    ready = binned(own, Bins([f"f{i}" for i in range(len(bundle.columns))], bundle.bins.edges)).select("_row", "_c", "x")
    out = scored(ready, bundle.heads, len(bundle.columns)).withColumn("_raw", mean_of([k for k in bundle.heads if k.startswith("p50")]))
    low, high = F.col("p25") + bundle.metadata["delta25"], F.col("p75") + bundle.metadata["delta75"]
    probability = F.col("probation") if "probation" in bundle.heads else F.lit(0.0)
    done = out.select("_row", F.col("_raw").alias("raw"), statute.constrained(low, F.col("_raw"), high, F.col("_c")).alias("_o"), probability.alias("probation_probability"))
    return done.select("_row.*", "raw", "probation_probability", (F.col("probation_probability") >= bundle.metadata["threshold"]).alias("probation"), "_o.*")


def importances(bundle: Bundle, k: int = 20) -> list[tuple[str, float]]:
    """Features by their share of the gains of the first median's splits."""
    gain = np.zeros(len(bundle.columns))
    for t in bundle.heads["p50-0"].trees:
        np.add.at(gain, t.feature, t.gain)
    share = gain / max(gain.sum(), 1e-30)
    return sorted(zip(bundle.columns, share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def save(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Heads, bins and metadata as lines of JSON, by Spark's writer, so any store will do."""
    lines = [{"kind": "about", "columns": bundle.columns, "edges": [e.tolist() for e in bundle.bins.edges], "metadata": bundle.metadata}]
    for m in bundle.heads.values():
        trees = [{k: v.tolist() for k, v in vars(t).items()} for t in m.trees]
        lines.append({"kind": "head", "head": asdict(m.head), "base": m.base, "trees": trees})
    spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Bundle:
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]  # a line a head
    about = next(x for x in lines if x["kind"] == "about")
    heads = {}
    for x in lines:
        if x["kind"] == "head":
            head = Head(**x["head"])
            heads[head.name] = Boosted(head, x["base"], [Tree(**{k: np.array(v) for k, v in t.items()}) for t in x["trees"]])
    return Bundle(about["columns"], Bins(about["columns"], [np.array(e) for e in about["edges"]]), heads, about["metadata"])
