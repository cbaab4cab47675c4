"""Packing documents into fixed-length sequences as a cutting-stock problem.

A document's tokens are cut into whole sequences and one remainder. The remainders' lengths, rounded up
to classes of `width` tokens, form a histogram, whose size does not depend on the corpus. Over it a
linear program chooses how often to use each pattern (a multiset of classes that fits one sequence);
its columns are generated: the duals price the classes, an unbounded knapsack finds the pattern of the
best price, and the program ends when none is worth more than a sequence. Pattern counts are rounded
down, what is left over (a few pieces for each class at most) is packed first-fit by decreasing length,
and the remainders, ranked within their class, take the places of the patterns.

Ranks are not numbered over a whole class, since one length may hold a third of all rows: a class has
about the square root of its count in buckets, whose totals are summed up before ranks are given inside.

Defined results: null text is empty; every document ends with `end_id`, so an empty one has one token;
rows that repeat are packed each; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from corvia.llm.arrow import map_rows
from corvia.llm.store import materialise

#: Outside these ranges the two libraries' Unicode tables might differ.
PLAIN = re.compile("[^\x00-ɏ‐-⁞]")


def encoder(vocabulary: str, ranks: str | None):
    """A function from a text to its ids as a uint32 array.

    vocabulary is a file of the tokenizers library and says what the ids are. ranks is the same vocabulary
    for tiktoken, several times as fast, and used for texts where both surely agree.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    special = [x.content for x in exact.get_added_tokens_decoder().values()]
    fast = None
    if ranks:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is None or PLAIN.search(text) or any(x in text for x in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_ordinary(text), dtype="<u4")

    return encode


def cut_documents(docs: DataFrame, vocabulary: str, ranks: str | None, capacity: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: whole sequences of a document, then its remainder."""

    def make():
        encode = encoder(vocabulary, ranks)
        end = np.array([end_id], dtype="<u4")

        def work(keys, texts):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for key, text in zip(keys, texts, strict=True):
                ids = np.concatenate([encode(text or ""), end])
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out["doc_id"].append(key)
                    out["start"].append(start)
                    out["length"].append(len(piece))
                    out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    out["doc_tokens"].append(len(ids))
            yield out

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def best_pattern(price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of classes 1..len(price), of sizes 1..len(price), that fits room at the greatest price."""
    value, choice = np.zeros(room + 1), np.zeros(room + 1, dtype=int)
    for free in range(1, room + 1):
        most = min(free, len(price))
        gain = price[:most] + value[free - 1 :: -1][:most]
        c = int(np.argmax(gain))
        value[free], choice[free] = (gain[c], c + 1) if gain[c] > value[free - 1] else (value[free - 1], 0)
    pattern, free = np.zeros(len(price), dtype=int), room
    while free > 0:
        if choice[free]:
            pattern[choice[free] - 1] += 1
            free -= choice[free]
        else:
            free -= 1
    return float(value[room]), pattern


def generate_patterns(demand: dict[int, int], room: int, max_columns: int = 20_000) -> list[tuple[dict[int, int], float]]:
    """Patterns {class: pieces} and how often the linear program's optimum uses each.

    demand: pieces of each class, a class being its size. The basis begins with a pattern of each class
    alone; a surplus column enters where a dual is negative.
    """
    classes = sorted(demand)
    if not classes:
        return []
    need = np.array([demand[c] for c in classes], dtype=float)
    n = len(classes)
    basis, cost = np.diag([float(room // c) for c in classes]), np.ones(n)
    for _ in range(max_columns):
        dual = np.linalg.solve(basis.T, cost)
        if dual.min() < -1e-9:
            column, price = np.zeros(n), 0.0
            column[int(np.argmin(dual))] = -1
        else:
            full = np.zeros(room)
            full[np.array(classes) - 1] = np.maximum(dual, 0)
            gain, pattern = best_pattern(full, room)
            if gain <= 1 + 1e-7:
                break
            column, price = pattern[np.array(classes) - 1].astype(float), 1.0
        used, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out], cost[out] = column, price
    used = np.linalg.solve(basis, need)
    return [
        ({classes[i]: int(round(basis[i, j])) for i in range(n) if basis[i, j] > 0.5}, float(used[j]))
        for j in range(n)
        if cost[j] and used[j] > 1e-9
    ]


def first_fit(left: Counter, room: int) -> list[dict[int, int]]:
    bins: list[tuple[int, Counter]] = []
    for size in sorted(left.elements(), reverse=True):
        for i, (free, held) in enumerate(bins):
            if size <= free:
                held[size] += 1
                bins[i] = (free - size, held)
                break
        else:
            bins.append((room - size, Counter({size: 1})))
    return [dict(held) for _, held in bins]


def places(demand: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(class, first rank, end of ranks, pieces a sequence, first sequence) of all patterns; sequences used."""
    done, rows, sequence = Counter(), [], 0

    def use(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        for c, n in pattern.items():
            rows.append((c, done[c], done[c] + n * times, n, sequence))
            done[c] += n * times
        sequence += times

    for pattern, used in generate_patterns(demand, room):
        times = min([math.floor(used + 1e-6), *((demand[c] - done[c]) // n for c, n in pattern.items())])
        if times > 0:
            use(pattern, times)
    for held in first_fit(Counter({c: n - done[c] for c, n in demand.items() if n > done[c]}), room):
        use(held, 1)
    return rows, sequence


def pack(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 2048, width: int = 8, end_id: int = 1
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: where each piece of each document goes."""
    pieces = cut_documents(docs, vocabulary, ranks, capacity, end_id)
    # Repeated rows are alike in all else; the salt, drawn once and written, spreads them over buckets.
    salted = pieces.withColumn("salt", (F.rand(5) * (1 << 20)).cast("int"))
    pieces = materialise(salted.withColumn("class", F.ceil(F.col("length") / width).cast("int")), "pieces")
    spark = pieces.sparkSession
    whole = F.col("length") == capacity
    pieces = pieces.withColumn("class", F.when(whole, 0).otherwise(F.col("class")))
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # a row for each class
    rows, n_patterns = places({c: n for c, n in counts.items() if c}, capacity // width)
    if counts.get(0):
        rows.append((0, 0, counts[0], 1, n_patterns))
    plan = spark.createDataFrame(rows, "class int, first long, end long, each long, sequence long")
    parts = spark.createDataFrame(
        [(c, max(1, n // max(128, math.isqrt(n)))) for c, n in counts.items()], "class int, parts int"
    )
    dealt = pieces.join(F.broadcast(parts), "class").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.col("parts")).cast("int")
    )
    before = W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = dealt.groupBy("class", "bucket").count().select(
        "class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin")
    )
    inside = W.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "salt")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(inside) - 1)
        .join(begins, ["class", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("begin"))
    )
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("class", "of")),
        (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    ).withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    earlier = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )
