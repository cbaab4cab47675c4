"""Product codes of integer vectors: every assignment exact, most of the work in float32.

A vector's components become integers floor(scale * x) and are cut into equal consecutive parts. The codebook of a
part position starts as that part of the rows with the smallest ids, and is refined by rounds of assignment and
exact integer means; then all parts are assigned a last time.

Screening. Squared distances of a block of parts to all entries are |c|^2 - 2 x.c up to a term of the part alone: one
float32 matrix product for each position. Its error is bounded by the standard bound for inner products of that
length, evaluated by norms rounded up, so each value becomes an interval that holds the true one for certain.
Every entry whose interval begins before the least upper end might be the nearest: these are computed again in
int64, exactly, and of equal ones the lower index wins. So codes never depend on rounding, block size or machine.

A round moves no vectors: tasks sum parts by entry, those sums (positions x entries rows a task) are added up, and the
codebooks, a few thousand integers, go back with the next pass.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; so are rows whose
vector has another length than that of the first kept row, which must be a positive multiple of the number of
parts. Null ids come last, and of rows with one id the one with the lesser vector comes first; every row counts, repeated ones too. With
fewer rows than entries the codebooks have a entry for each row. Components too large for int64 arithmetic are
computed in Python's integers; an error that a long cannot hold is null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corvia.llm.arrow import map_columns, matrix
from corvia.llm.integers import floors, long_or_none, narrow, usable
from corvia.llm.store import materialise

#: Rows of groups of labels up to which their sums are sent to all tasks; with more they are joined by a shuffle.
FEW = 100_000
UNIT = 2.0**-24


def _intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts (positions x n x width) against entries (positions x entries x width): bounds of |c|^2 - 2 x.c.

    Integers under 2^27 become float32 with relative error UNIT at most, products and sums of `width` terms add
    (width + 1) UNIT of the sum of their magnitudes, which is no more than the product of the norms; the square
    of c and the last difference add a few more. All that, with the bound's own rounding, is under the `slack` taken.
    """
    width = x.shape[-1]
    norm_x = np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1))
    square = (c.astype(np.float64) ** 2).sum(axis=-1)
    dot = np.matmul(x.astype(np.float32), c.astype(np.float32).transpose(0, 2, 1))
    value = square.astype(np.float32)[:, None, :] - np.float32(2) * dot
    slack = (width + 8) * UNIT * 1.01
    error = (np.float32(2) * norm_x.astype(np.float32)[:, :, None] * np.sqrt(square).astype(np.float32)[:, None, :] + square.astype(np.float32)[:, None, :]) * np.float32(slack)
    return value - error * np.float32(1.001), value + error * np.float32(1.001)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (n x positions x width), c (positions x entries x width) -> index and squared distance (n x positions)."""
    n, positions, width = x.shape
    if not narrow(x, c):
        d = ((x.astype(object)[:, :, None, :] - c.astype(object)[None]) ** 2).sum(axis=-1)
        return d.argmin(axis=-1), d.min(axis=-1)
    turned = x.transpose(1, 0, 2)
    low, high = _intervals(turned, c)
    # Bounds are rounded to float32 once more here, which their own slack covers.
    part, row, entry = np.nonzero(low <= high.min(axis=-1, keepdims=True))
    d = ((turned[part, row] - c[part, entry]) ** 2).sum(axis=-1)
    group = part * n + row
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(d, first)
    size = np.diff(np.append(first, len(d)))
    best = np.flatnonzero(d == np.repeat(least, size))
    one = np.concatenate([[True], group[best[1:]] != group[best[:-1]]])  # entries ascend within a group
    return entry[best[one]].reshape(positions, n).T, least.reshape(positions, n).T


def _parts(vectors: list | np.ndarray, scale: int, positions: int) -> np.ndarray:
    x = floors(vectors, scale)
    return x.reshape(len(x), positions, x.shape[1] // positions)


def _refined(kept: DataFrame, c: np.ndarray, scale: int) -> np.ndarray:
    """One round: assignment, then exact means rounded down; entries without parts stay."""
    positions, entries, width = c.shape

    def make():
        def work(vectors):
            x = _parts(matrix(vectors), scale, positions)
            index = nearest(x, c)[0]
            key = index + np.arange(positions) * entries
            used, inverse = np.unique(key, return_inverse=True)
            total = np.zeros((len(used), width), dtype=x.dtype)
            np.add.at(total, inverse.reshape(-1), x.reshape(-1, width))
            count = np.bincount(inverse.reshape(-1))
            return {"key": used, "n": count, "sums": [[Decimal(int(v)) for v in row] for row in total]}

        return work

    sums = map_columns(kept.select("vector"), "key int, n long, sums array<decimal(38,0)>", make)
    added = [F.sum(F.col("sums")[i]).cast("string").alias(f"s{i}") for i in range(width)]
    out = c.copy()
    for r in sums.groupBy("key").agg(F.sum("n").alias("n"), *added).collect():  # positions x entries rows at most
        mean = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        if out.dtype != object and any(abs(m) >= 1 << 62 for m in mean):
            out = out.astype(object)
        out[r["key"] // entries, r["key"] % entries] = mean
    return out


def codebook_text(c: np.ndarray) -> str:
    return ",".join(str(int(v)) for v in c.reshape(-1))


def encode(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positions: int = 16,
    entries: int = 64, rounds: int = 2,
) -> DataFrame:
    """id, code (two hex digits a part), error, label_error, codebooks_sha256; scale is a power of two, entries at most 256."""
    kept = rows.select(F.col(id_).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(usable("vector"))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    width = sum(r["n"] for r in kept.orderBy(*order).select(F.size("vector").alias("n")).limit(1).collect())
    if width % positions:
        raise ValueError(f"vectors of {width} components are not {positions} equal parts")
    kept = kept.where((F.size("vector") == width) & (F.size("vector") > 0))
    first = kept.orderBy(*order).select("vector").limit(entries).collect()
    c = np.zeros((positions, 0, 1), dtype=np.int64)
    if first:
        c = np.ascontiguousarray(_parts([r["vector"] for r in first], scale, positions).transpose(1, 0, 2))
        for _ in range(rounds):
            c = _refined(kept, c, scale)

    def make():
        def work(ids, vectors, labels):
            index, d = nearest(_parts(matrix(vectors), scale, positions), c)
            codes = [bytes(row).hex() for row in index.astype(np.uint8)]
            return {"id": ids, "label": labels, "code": codes, "error": long_or_none(d.sum(axis=1))}

        return work

    of = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = materialise(map_columns(kept, f"id {of['id']}, label {of['label']}, code string, error long", make), "codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = materialise(sums.withColumnRenamed("label", "same"), "label-errors")
    few = sums.limit(FEW + 1).count() <= FEW
    met = coded.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("same")))
    digest = hashlib.sha256(codebook_text(c).encode()).hexdigest()
    return met.select(F.col("id").alias(id_), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
