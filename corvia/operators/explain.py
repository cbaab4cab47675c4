"""Exact additive attributions of boosted trees: what each feature adds to a prediction, along the paths of the trees.

A leaf counts for a subset of known features by the product over its path of 1 or 0 (a known feature's splits all point
to it, or not) and of shares of training rows (an unknown one's). The attribution of a feature is its mean effect over
all orders in which features become known. For one leaf that is a polynomial: the product of (share + indicator t)
over the other features of the path has as coefficients the sums over subsets of each size, and each size has
its weight. A path has no more features than the tree's depth, so a leaf costs a few operations a row whatever
the number of features, and sums of leaves and trees give the whole. Attributions and the base (the mean over
unknown features) add up to the prediction exactly but for rounding.

Trees travel with the task (a few thousand numbers); rows stay where they are and go through in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from corvia.operators.boosting import Bins, Boosted, Tree, _bytes


def leaf_paths(t: Tree) -> Iterator[tuple[float, dict[int, tuple[int, int, float]]]]:
    """value, feature -> (lowest bin, highest bin, share of rows) of each leaf that training rows reached."""
    inner = len(t.feature)
    for leaf, value in enumerate(t.value.tolist()):
        node, path = inner + leaf, {}
        while node:
            parent = (node - 1) // 2
            f, b = int(t.feature[parent]), int(t.bin[parent])
            if b == 255:
                if node == 2 * parent + 2:  # the side of no split that no row takes
                    break
            else:
                low, high, share = path.get(f, (0, 255, 1.0))
                low, high = (max(low, b + 1), high) if node == 2 * parent + 2 else (low, min(high, b))
                path[f] = low, high, share * (t.cover[node] / t.cover[parent] if t.cover[parent] else 0.0)
            node = parent
        if not node:
            yield value, path


def base_value(model: Boosted) -> float:
    """The prediction with no feature known."""
    return model.base + sum(v * float(np.prod([s for *_, s in path.values()])) for t in model.trees for v, path in leaf_paths(t))


def attributions(model: Boosted, x: np.ndarray) -> np.ndarray:
    """Rows of bins -> what each feature adds to the raw prediction (months, or log odds)."""
    out = np.zeros(x.shape)
    for t in model.trees:
        for value, path in leaf_paths(t):
            if not value or not path:
                continue
            names = list(path)
            d = len(names)
            weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
            share = [path[f][2] for f in names]
            on = [((x[:, f] >= path[f][0]) & (x[:, f] <= path[f][1])).astype(np.float64) for f in names]
            for i, f in enumerate(names):
                ways = np.zeros((len(x), d))
                ways[:, 0] = 1.0
                for j in range(d):
                    if j != i:  # times (share + indicator t)
                        ways[:, 1:] = ways[:, 1:] * share[j] + ways[:, :-1] * on[j][:, None]
                        ways[:, 0] *= share[j]
                out[:, f] += value * (on[i] - share[i]) * (ways @ weight)
    return out


def expectation(model: Boosted, x: np.ndarray, known: set[int]) -> float:
    """The prediction for one row of bins where only some features are known: what attributions average. For checks."""
    total = model.base
    for t in model.trees:
        for value, path in leaf_paths(t):
            for f, (low, high, share) in path.items():
                value *= float(low <= x[f] <= high) if f in known else share
            total += value
    return total


def explained(rows: DataFrame, model: Boosted, bins: Bins, name: str = "contributions", x: str = "x") -> DataFrame:
    """rows (with the bytes of their bins) and base_value, predicted_raw, and an array of a number for each feature."""
    width, base = len(bins.columns), base_value(model)
    schema = rows.select("*", F.lit(0.0).alias("base_value"), F.lit(0.0).alias("predicted_raw"), F.array(F.lit(0.0)).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asfortranarray(_bytes(batch.column(x), np.uint8, width))
            each = attributions(model, values)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), pa.array(each.reshape(-1)))
            more = {"base_value": pa.array(np.full(len(values), base)), "predicted_raw": pa.array(model.raw(values)), name: flat}
            for k, v in more.items():
                batch = batch.append_column(k, v)
            yield batch

    return rows.mapInArrow(run, schema)


def _kinds(model: Boosted, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each of the rows of bins that all splits of a model send the same ways; for each row its place among them."""
    splits: dict[int, set[int]] = {}
    for t in model.trees:
        for f, b in zip(t.feature.tolist(), t.bin.tolist(), strict=True):
            if b != 255:
                splits.setdefault(f, set()).add(b)
    code, ways = np.zeros(len(x), dtype=np.int64), 1
    for f, of in splits.items():
        if ways * (len(of) + 1) > 1 << 40:
            _, code = np.unique(code, return_inverse=True)
            ways = len(x)
        code = code * (len(of) + 1) + np.searchsorted(sorted(of), np.arange(256), side="left")[x[:, f]]
        ways *= len(of) + 1
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return first, place


def summaries(rows: DataFrame, model: Boosted, bins: Bins, top: int = 10, x: str = "x") -> DataFrame:
    """rows without their bytes, base_value, predicted_raw, explained (the base with all contributions), top_contributions as below.

    Rows that all splits send the same ways are explained once a batch.
    """
    width, base, columns = len(bins.columns), base_value(model), bins.columns
    more = "base_value double, predicted_raw double, explained double, top_contributions array<struct<name: string, contribution: double>>"
    schema = StructType(rows.drop(x).schema.fields + _parse_datatype_string(more).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(columns)
        for batch in batches:
            values = _bytes(batch.column(x), np.uint8, width)
            first, place = _kinds(model, values)
            kinds = np.asfortranarray(values[first])
            each = attributions(model, kinds)
            total = np.zeros(len(kinds))
            for j in range(width):
                total += each[:, j]
            order = np.argsort(-np.abs(each), axis=1, kind="stable")[:, :top]
            k = order.shape[1]
            pairs = pa.StructArray.from_arrays([names.take(pa.array(order[place].reshape(-1))), pa.array(np.take_along_axis(each, order, axis=1)[place].reshape(-1))], ["name", "contribution"])
            found = {
                "base_value": pa.array(np.full(len(place), base)), "predicted_raw": pa.array(model.raw(kinds)[place]), "explained": pa.array((base + total)[place]),
                "top_contributions": pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * k, pa.int32()), pairs),
            }
            batch = batch.drop_columns([x])
            for name, v in found.items():
                batch = batch.append_column(name, v)
            yield batch

    return rows.mapInArrow(run, schema)


def top_contributions(columns: list[str], contributions: str = "contributions", top: int = 10) -> Column:
    """The features of the greatest effect either way, largest first, of equal ones by their place: array of (name, contribution)."""
    c = F.col(contributions)
    named = F.transform(c, lambda v, i: F.struct((-F.abs(v)).alias("o"), i.alias("i"), F.element_at(F.array(*map(F.lit, columns)), i + 1).alias("name"), v.alias("contribution")))
    return F.transform(F.slice(F.array_sort(named), 1, top), lambda s: F.struct(s["name"].alias("name"), s["contribution"].alias("contribution")))
