"""Centroid clustering by exact integers, in rounds that touch only what the last round changed.

A vector's components become integers floor(scale * x). The first centroids are the rows whose salted ids have
the smallest SHA-256. Each round assigns every vector to the nearest centroid by squared distance (ties: the smaller
number) and replaces each centroid that owns vectors by the exact mean of theirs, rounded down.

Delta rounds. The owner and the distance of each vector are kept in a written table, sums and counts of each cluster by
the driver (clusters x components integers). A round knows which centroids changed. A vector whose owner did not
is compared with the changed ones alone: no unchanged one was better before, so none is now. One whose owner moved
is compared with all. When no centroid changed, the rounds are over. Vectors that change hands send their integers
to the new owner with a plus and to the old one with a minus; tasks add these up, so a round shuffles at most two rows
a cluster and task, and late rounds, where few vectors move, hardly any. The vectors themselves are never shuffled:
a round reads the table of the last one and writes the next, so a lost executor costs its own tasks only.

Defined results: rows with a null vector, null or non-finite components, or another number of components than
`width` take no part. Null ids come last among the first centroids, rows with one id in the order of their vectors; every row counts,
repeated ones too. With fewer rows than clusters there are as many clusters as rows. Components too
large for int64 arithmetic are computed in Python's integers; distances and sums that a long cannot hold are null. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corvia.llm.arrow import map_columns, matrix
from corvia.llm.integers import floors, long_or_none, narrow, usable
from corvia.llm.store import discard, materialise


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of n x width integers to k x width ones, exact."""
    if not narrow(x, c):
        x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, c: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; owner -1: none yet; changed: which of the centroids c moved in the last round."""
    own = owner.copy()
    best = distance.copy()
    whole = np.flatnonzero((owner < 0) | changed[owner])
    if len(whole):
        d = distances(x[whole], c)
        if d.dtype == object and best.dtype != object:
            best = best.astype(object)
        own[whole] = d.argmin(axis=1)
        best[whole] = d.min(axis=1)
    rest, moved = np.flatnonzero((owner >= 0) & ~changed[owner]), np.flatnonzero(changed)
    if len(rest) and len(moved):
        d = distances(x[rest], c[moved])
        if d.dtype == object and best.dtype != object:
            best = best.astype(object)
        least, number = d.min(axis=1), moved[d.argmin(axis=1)]
        better = (least < best[rest]) | (least == best[rest]) & (number < own[rest])
        own[rest[better]], best[rest[better]] = number[better], least[better]
    return own, best


def _first(kept: DataFrame, clusters: int, salt: str, scale: int) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.orderBy(name.asc_nulls_last(), "vector").select("vector").limit(clusters).collect()
    return floors([r["vector"] for r in rows], scale)


def _round(state: DataFrame, c: np.ndarray, changed: np.ndarray, scale: int) -> DataFrame:
    """id, vector, was, owner, distance of the last round -> the same of this one; was: the owner before."""

    def make():
        def work(ids, vectors, was, owners, before):
            known = pc.and_(owners.is_valid(), before.is_valid()).to_numpy(zero_copy_only=False)
            owner = np.where(known, owners.fill_null(-1).to_numpy().astype(np.int64), -1)
            own, best = reassigned(floors(matrix(vectors), scale), owner, before.fill_null(0).to_numpy(), c, changed)
            return {"id": ids, "vector": vectors, "was": owners, "owner": own, "distance": long_or_none(best) if best.dtype == object else best}

        return work

    return map_columns(state.select("id", "vector", "was", "owner", "distance"), state.schema, make)


def _transfers(state: DataFrame, clusters: int, scale: int) -> list:
    """For each cluster, what vectors that changed hands add to its count and sums."""
    moved = state.where("NOT owner <=> was").select("vector", "was", "owner")
    width = "sums array<decimal(38,0)>"

    def make():
        def work(vectors, was, owners):
            x = floors(matrix(vectors), scale)
            total: dict[int, np.ndarray] = {}
            count: dict[int, int] = {}
            for sign, ends in ((1, owners), (-1, was)):
                of = ends.fill_null(-1).to_numpy()
                for k in np.unique(of[of >= 0]).tolist():
                    mine = x[of == k]
                    total[k] = total.get(k, 0) + sign * mine.sum(axis=0)
                    count[k] = count.get(k, 0) + sign * len(mine)
            return {"cluster": list(total), "n": [count[k] for k in total], "sums": [[Decimal(int(v)) for v in t] for t in total.values()]}

        return work

    each = map_columns(moved, f"cluster int, n long, {width}", make)
    places = each.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    added = places.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").cast("string").alias("x"))
    return added.collect()  # clusters x components rows at most


def _by_cluster(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("owner") + 1)


def cluster(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", width: int = 64, clusters: int = 8, rounds: int = 10, salt: str = "3:",
    scale: int = 1024,
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256; scale is a power of two."""
    kept = rows.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).where(usable("vector") & (F.size(vector) == width))
    c = _first(kept, clusters, salt, scale)
    k = len(c)
    if k == 0:
        c = np.zeros((1, width), dtype=np.int64)
    nothing = F.lit(None).cast("int")
    state = kept.select("id", "vector", nothing.alias("was"), nothing.alias("owner"), F.lit(None).cast("long").alias("distance"))
    sums, counts, changed = np.zeros((max(k, 1), width), dtype=object), np.zeros(max(k, 1), dtype=object), np.ones(max(k, 1), dtype=bool)
    for last in range(rounds + 1):
        following = materialise(_round(state, c, changed, scale), f"clusters-{last}")
        if last:
            discard(state)
        state = following
        if last == rounds:
            break
        for r in _transfers(state, k, scale):
            sums[r["cluster"], r["at"]] += int(r["x"])
            if r["at"] == 0:
                counts[r["cluster"]] += r["n"]
        means = [[int(s) // int(n) for s in row] if n else list(old) for row, n, old in zip(sums, counts, c, strict=True)]
        wide = any(abs(int(m)) >= 1 << 62 for row in means for m in row)
        new = np.array([[int(m) for m in row] for row in means], dtype=object if wide else np.int64)
        changed = np.array([(a != b).any() for a, b in zip(new, c, strict=True)], dtype=bool)
        c = new
        if not changed.any():
            break
    found = dict(state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("string")).collect()) if k else {}  # clusters rows
    inertia = [int(found[i]) if found.get(i) is not None else 0 for i in range(max(k, 1))]
    names = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in c]
    return state.select(
        F.col("id").alias(id_), F.col("owner").alias("cluster"), "distance", _by_cluster(long_or_none(inertia)).cast("long").alias("cluster_inertia"),
        F.lit(long_or_none([sum(inertia)])[0]).cast("long").alias("inertia"), _by_cluster(names).alias("centroid_sha256"),
    )
