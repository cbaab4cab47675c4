"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one entry from each of several full-dimensional codebooks. The
codebooks are fitted on residuals of a bounded sample (`sample`, of least hash) and refitted by least
squares, one at a time, on the codes that they give. Every row is then encoded by beam search, with the squared norm
of what its code stands for. For a query, a table of its products with all entries turns a code into a
distance by look-ups; the best of each block of codes, then the best overall, are reranked by the exact
distance on the original vectors.

Copies: a vector with more equals than could be answers would fill the candidate list. A block's search
passes over a vector once `k + 1` equal ones with smaller ids have been seen, and so does the merge; those
cannot be among the nearest k, so nothing is lost.

Queries are a stated set; each block of them meets each block of codes once. Codes are dealt to groups of
blocks, and so are queries; a group of codes is sent to each group of queries and the other way round, so what moves
grows with groups and not with blocks. Which rows are found is approximate: a true neighbour that ranks behind `candidates` by its code
is lost; recall is measured (README), and the scores of what is found are exact.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id,
nor vectors of another dimension than most of the sample, from which no distance is defined; numbers too large for
a code (beyond 1e17) are cut for it, not for the score; fewer than k candidates give all; ties go to
the smaller id; rows with a query's own id are not its candidates, and repeated rows count once; empty input
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.llm.store import materialise

CODES_IN_BLOCK, QUERIES_IN_BLOCK = 4096, 64
#: Blocks in a group, of codes and of queries.
CODES_IN_GROUP, QUERIES_IN_GROUP = 64, 64
LARGE = 1e17


@dataclass
class Codebooks:
    entries: np.ndarray  # books x entries x dimension, float32

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """rows x books codes (uint8), by beam search over residuals."""
        books, size, _ = self.entries.shape
        n = len(x)
        residual = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        loss = np.einsum("nbd,nbd->nb", residual, residual)
        for c in self.entries:
            norms = np.einsum("kd,kd->k", c, c)
            cost = loss[:, :, None] - 2 * (residual @ c.T) + norms
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            chosen = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, entry = chosen // size, chosen % size
            loss = np.take_along_axis(flat, chosen, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), entry[:, :, None].astype(np.uint8)], axis=2)
            residual = np.take_along_axis(residual, parent[:, :, None], axis=1) - c[entry]
        return np.take_along_axis(codes, loss.argmin(axis=1)[:, None, None], axis=1)[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.entries[m][codes[:, m]] for m in range(codes.shape[1]))


def _kmeans(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 5) -> np.ndarray:
    centres = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        nearest = (np.einsum("kd,kd->k", centres, centres) - 2 * (x @ centres.T)).argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        found, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[found] = sums / np.diff(np.append(first, len(x)))[:, None]
        lost = np.setdiff1d(np.arange(size), found)
        if len(lost):
            centres[lost] = x[rng.choice(len(x), len(lost))]
    return centres


def train(x: np.ndarray, books: int, size: int, beam: int, refits: int = 2, seed: int = 4) -> Codebooks:
    rng = np.random.default_rng(seed)
    size = max(1, min(size, len(x)))
    residual, entries = x.astype(np.float32), []
    for _ in range(books):
        c = _kmeans(residual, size, rng)
        nearest = (np.einsum("kd,kd->k", c, c) - 2 * (residual @ c.T)).argmin(axis=1)
        residual = residual - c[nearest]
        entries.append(c)
    found = Codebooks(np.stack(entries))
    entries_, x32 = found.entries.copy(), x.astype(np.float32)
    for _ in range(refits):
        # Least squares for one book at a time, the others held: each entry moves to the mean of what it is to explain.
        codes = Codebooks(entries_).encode(x, beam)
        rest = x32 - Codebooks(entries_).decode(codes)
        for m in range(books):
            mine = rest + entries_[m][codes[:, m]]
            order = np.argsort(codes[:, m], kind="stable")
            used, first = np.unique(codes[order, m], return_index=True)
            entries_[m][used] = np.add.reduceat(mine[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
            rest = mine - entries_[m][codes[:, m]]
    refitted = Codebooks(entries_)
    errors = [float(((x - b.decode(b.encode(x, beam))) ** 2).sum()) for b in (found, refitted)]
    return refitted if errors[1] < errors[0] else found


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    flat = column.values if isinstance(column, pa.ListArray) else column.flatten()
    flat = flat.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _single(column: pa.Array) -> np.ndarray:
    """Vectors as codes see them."""
    return np.clip(_matrix(column, np.float64), -LARGE, LARGE).astype(np.float32)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, books: int = 24, size: int = 256, beam: int = 4,
    sample: int = 8_192, candidates: int = 400, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """key, vector -> query_id, rank, key, score: the k nearest found for each query, by Euclidean distance."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"])
    share = sample / max(vectors.count(), 1)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else rows
    learn = [r["v"] for r in sorted(some.select("id", "v").collect())]  # about `sample` rows
    if not learn:  # few of many rows can be used
        learn = [r["v"] for r in rows.limit(sample).collect()]
    answer = f"query_id long, rank int, {key} long, score double"
    if not learn:
        return vectors.sparkSession.createDataFrame([], answer)
    lengths = np.array([len(v) for v in learn])
    width = int(np.bincount(lengths).argmax())
    rows = materialise(rows.where(F.size("v") == width), "vectors")
    known = np.clip(np.array([v for v in learn if len(v) == width]), -LARGE, LARGE).astype(np.float32)
    books_ = train(known, books, size, beam)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CODES_IN_BLOCK):
                part = batch.slice(at, CODES_IN_BLOCK)
                ids, x, whole = part.column("id").to_numpy(), _single(part.column("v")), _matrix(part.column("v"), np.float64)
                order = np.argsort(ids, kind="stable")
                ids, x, whole = ids[order], x[order], whole[order]
                codes = books_.encode(x, beam)
                norms = np.einsum("nd,nd->n", d := books_.decode(codes), d).astype(np.float32)
                equal = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in whole], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.tobytes()], pa.binary()) for b in (ids, codes, norms, equal)], names=["ids", "codes", "norms", "equal"]
                )

    index = materialise(rows.select("id", "v").mapInArrow(encode, "ids binary, codes binary, norms binary, equal binary"), "codes")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_IN_BLOCK):
                part = batch.slice(at, QUERIES_IN_BLOCK)
                ids, x = part.column("id").to_numpy(), _single(part.column("v"))
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in (ids, x)], names=["ids", "vectors"])

    asked = rows.where("q").select("id", "v")
    n_blocks = max(1, -(-asked.count() // QUERIES_IN_BLOCK))
    spread = asked.repartition(n_blocks, "id").mapInArrow(gather, "ids binary, vectors binary")
    # A number for each block: hashed ids don't fill partitions evenly, so there may be more blocks than n_blocks.
    blocks = materialise(spread.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    n_codes = index.count()
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    code_groups = max(1, -(-n_codes // CODES_IN_GROUP), min(n_codes, parallel))
    query_groups = max(1, -(-n_blocks // QUERIES_IN_GROUP))

    def dealt(df: DataFrame, by: str, own: str, n: int, other: str, m: int) -> DataFrame:
        """A group for each row, and a copy of it for each group of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    asked_blocks = blocks.select("block", F.col("ids").alias("query_ids"), "vectors")
    left = dealt(asked_blocks, "block", "query_group", query_groups, "code_group", code_groups)
    right = dealt(index, "norms", "code_group", code_groups, "query_group", query_groups)
    # The sorted join takes one row of the left after the other to all of the right: a query block's way is in one piece.
    met = left.hint("merge").join(right, ["query_group", "code_group"])

    def score_block(r: dict) -> list[tuple[np.ndarray, ...]]:
        """Of each query of r's block, id, equal and near of the best codes of r."""
        ids, equal = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["equal"], np.int64)
        codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
        norms = np.frombuffer(r["norms"], np.float32)
        qs = np.frombuffer(r["query_ids"], np.int64)
        x = np.frombuffer(r["vectors"], np.float32).reshape(len(qs), -1)
        table = np.einsum("qd,mkd->mqk", x, books_.entries, optimize=True)
        score = np.repeat(norms[None, :], len(qs), axis=0)
        for m in range(codes.shape[1]):
            score -= 2 * table[m][:, codes[:, m]]
        score[qs[:, None] == ids[None, :]] = np.inf
        return [(ids, equal, row) for row in score]

    def best(ids: np.ndarray, equal: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
        """The candidates with the least (near, id), of equal vectors no more than k + 1."""
        by = np.lexsort((ids, equal))
        at = np.arange(len(by))
        nth = at - np.maximum.accumulate(np.where(np.concatenate([[True], equal[by][1:] != equal[by][:-1]]), at, 0))
        by = by[(nth <= k) & np.isfinite(near[by])]
        by = by[np.lexsort((ids[by], near[by]))][:candidates]
        return ids[by], equal[by], near[by]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, qs, held = None, None, []

        def out():
            n = [len(x[0]) for x in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qs, n)), *(pa.array(np.concatenate([x[i] for x in held])) for i in range(3))],
                names=["query_id", "id", "equal", "near"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["code_group"]) != name:
                    if name is not None:
                        yield from out()
                    name, qs, held = (r["block"], r["code_group"]), np.frombuffer(r["query_ids"], np.int64), []
                found = score_block(r)
                if held:
                    found = [tuple(map(np.concatenate, zip(old, new, strict=True))) for old, new in zip(held, found, strict=True)]
                held = [best(*x) for x in found]
        if name is not None:
            yield from out()

    found = met.mapInArrow(search, "query_id long, id long, equal long, near float")
    copies = W.partitionBy("query_id", "equal").orderBy("id")
    found = found.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1)
    order = W.partitionBy("query_id").orderBy("near", "id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= candidates).select("query_id", "id")
    pairs = (
        found.join(rows.select("id", "v"), "id")
        .join(rows.where("q").select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")
    )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _matrix(batch.column("v"), np.float64) - _matrix(batch.column("w"), np.float64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("id"), pa.array(np.sqrt((d * d).sum(axis=1)))], names=["query_id", "id", "score"]
                )

    exact = pairs.mapInArrow(rerank, "query_id long, id long, score double").dropDuplicates(["query_id", "id", "score"])
    last = W.partitionBy("query_id").orderBy("score", "id")
    ranked = exact.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
