"""n-gram Jaccard join: which documents' shingle sets have a similarity of at least num / den.

Tiles. Sizes are cut into bands; the tile of a band holds the sets of its sizes and those larger ones
that can still reach the threshold. In a tile two linked sets differ in at most H elements, so when the
hash space is cut into H + 1 + spare parts, at least spare + 1 parts are equal in both. Each set sends
a signature of each part; equal signatures in a tile make a bucket. (Parts without elements are sent
only by sets that have more than spare of them, so some part with elements is always shared.) A set of
which fewer parts stand in any bucket than a link needs is linked with nothing and takes no further part.

Signatures of whole sets. Each set has a bitmap of hashed elements; the bits in which two bitmaps differ
bound the overlap from above, so most pairs end there. The others get the exact intersection of the
sorted arrays.

Groups. Equal sets are one class before anything else, so copies are never paired. Within a bucket, each
class is first held against the least one only. When the links so found have been contracted, only
pairs of different components remain, in the buckets that have several: they are compared bitmap by
bitmap in blocks of bounded size, each with the blocks of sizes that can reach the threshold. Larger buckets share many of their classes with each other, so they
are first united; a pair then meets once, not in every bucket that it shares. Every link
between different components is found, so components are exact. BLOCK, ALONE, SLICES and STEP say how the work is
cut, not which links are found.

Defined results: null text, or text without words, is an empty set: n_shingles 0, linked with nothing;
fewer words than a shingle has make one shingle of all; rows with a null doc_id get n_shingles and a null
component; rows with the same doc_id are one document; repeated rows give repeated rows; other columns
are ignored; empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corvia.llm.arrow import map_rows
from corvia.llm.components import components
from corvia.llm.store import materialise

#: Spare parts: one for so many differences.
SPARE = 6
BAND_RATIO = 1.25
#: Classes in a block; in a bucket that stands alone; slices in which signatures are shuffled.
BLOCK, ALONE, SLICES = 192, 32, 4
#: Sizes of a band of blocks: from one power of it to the next.
STEP = 1.06
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; A-Z count as a-z, ASCII white space parts words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    take = min(n, len(h))
    out = np.zeros(len(h) - take + 1, dtype=np.uint64)
    for i in range(take):
        out = _mix(out * _K[0] + h[i : len(h) - take + 1 + i])
    return np.unique(out)


def bands(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(tile, parts, spare ones) of the tiles that hold sets of this size; none where only equal sets can be linked."""
    found, low, tile = [], 1, 0
    while low <= size:
        high = max(low, int(low * BAND_RATIO))
        over = high * den // num
        if size <= over:
            differ = (den - num) * (high + over) // (den + num)
            if differ:
                spare = max(1, differ // SPARE)
                found.append((tile, differ + 1 + spare, spare))
        low, tile = high + 1, tile + 1
    return found


def signatures(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """The signatures of a set, and how many of them a linked set shares, in even and in odd tiles.

    A signature's lowest bit is its tile's: the tiles of a set are neighbours.
    """
    keys, need = [], [0, 0]
    for tile, parts, spare in bands(len(s), num, den):
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        ends = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(s), dtype=np.uint64)])
        name = _mix(np.arange(parts, dtype=np.uint64) * _K[2] + np.uint64((tile + 1) * int(_K[0]) % (1 << 64)))
        sent = _mix(total[ends[1:]] - total[ends[:-1]] + name) & ~np.uint64(1) | np.uint64(tile & 1)
        filled = ends[1:] > ends[:-1]
        empty = int((~filled).sum())
        keys.append(sent if empty > spare else sent[filled])
        need[tile & 1] = max(1, spare + 1 - empty)  # a linked set need not send its empty parts
    return (np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)), need


def bitmap(s: np.ndarray) -> bytes:
    """Hashed elements, in a power of two of bits: two to four for each element, 64 at least."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(s % np.uint64(width)).astype(np.intp)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (uint64 words) at a smaller power of two of words: as if hashed to it."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def differing_bits(u: bytes, v: bytes) -> int:
    a, b = np.frombuffer(u, dtype=np.uint64), np.frombuffer(v, dtype=np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def _features(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    def make():
        def work(ids, texts):
            out: dict[str, list] = {k: [] for k in ("id", "n", "digest", "bits", "keys", "need")}
            for i, text in zip(ids, texts, strict=True):
                s = shingles(text, n)
                out["id"].append(i)
                out["n"].append(len(s))
                out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["bits"].append(bitmap(s))
                keys, need = signatures(s, num, den)
                out["keys"].append(keys.view(np.int64))
                out["need"].append(need)
            yield out

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"id {kind}, n long, digest binary, bits binary, keys array<long>, need array<int>", make)


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    def make():
        def work(ids, texts):
            yield {"id": ids, "elements": [shingles(x, n).view(np.int64) for x in texts]}

        return work

    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(wanted, f"id {kind}, elements array<long>", make)


def _may_link(same: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an overlap reaches the threshold; sizes: both sets' sizes added up."""
    return den * same >= num * (sizes - same)


#: Bytes of bitmaps that are compared at once; Spark's bound of rows in an Arrow batch.
CHUNK, BATCH = 8 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs u, v whose sets are similar enough, written: first by bitmap, then by exact intersection.

    Bitmaps and whole sets stand in the rows, so rows go to Python few at a time.
    """
    conf, before = docs.sparkSession.conf, docs.sparkSession.conf.get(BATCH)
    conf.set(BATCH, "500")
    try:
        return materialise(_checked(pairs, reps, docs, n, num, den), "verified")
    finally:
        conf.set(BATCH, before)


def _checked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    a = reps.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("bits").alias("bits_u"))
    b = reps.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("bits").alias("bits_v"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                sizes = x.column("n_u").to_numpy() + x.column("n_v").to_numpy()
                both = zip(x.column("bits_u").to_pylist(), x.column("bits_v").to_pylist(), strict=True)
                differ = np.array([differing_bits(u, v) for u, v in both], dtype=np.int64)
                keep = _may_link((sizes - differ) // 2, sizes, num, den)
                yield x.select(["u", "v"]).filter(pa.array(keep))

    near = materialise(
        pairs.join(a, "u").join(b, "v").mapInArrow(bound, pairs.select("u", "v").schema), "near-pairs"
    )
    ids = near.select(F.col("u").alias("id")).union(near.select("v")).distinct()
    sets = materialise(_sets(docs, ids, n), "sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keep = []
                for e, f in zip(x.column("e"), x.column("f"), strict=True):
                    e, f = e.values.to_numpy(), f.values.to_numpy()
                    keep.append(bool(_may_link(len(np.intersect1d(e, f, assume_unique=True)), len(e) + len(f), num, den)))
                yield x.select(["u", "v"]).filter(pa.array(keep))

    both = near.join(sets.select(F.col("id").alias("u"), F.col("elements").alias("e")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("elements").alias("f")), "v"
    )
    return both.mapInArrow(exact, near.schema)


def _across(rows: DataFrame, num: int, den: int) -> DataFrame:
    """key, id, label, n, bits -> the pairs u, v of a key with different labels whose bitmaps allow a link.

    The classes of a key are cut into blocks by size, and by hash where many have one size. A block meets only
    those whose sizes can reach the threshold.
    """
    reach = math.ceil(math.log(den / num) / math.log(STEP))
    rows = rows.withColumn("band", F.floor(F.log(F.col("n")) / math.log(STEP)))
    count = rows.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    count = materialise(count, "open-counts")
    others = count.select("key", F.col("band").alias("other_band"), F.col("blocks").alias("other_blocks"))
    dealt = rows.join(count, ["key", "band"]).withColumn("mine", (F.col("band") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("blocks"))))
    dealt = dealt.join(others, "key").where(F.abs(F.col("band") - F.col("other_band")) <= reach)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)))
    other = F.col("other_band") * (1 << 32) + F.col("other")
    dealt = dealt.select("key", F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), "mine", "id", "label", "n", "bits")
    schema = rows.select(F.col("id").alias("u"), F.col("id").alias("v")).schema

    def pairs(key, i, j, mine, ids, labels, n, bits):
        k, l = np.nonzero(np.triu(labels[:, None] != labels[None, :], 1))
        ok = (mine[k] == i) & (mine[l] == j) | (mine[k] == j) & (mine[l] == i)
        k, l = k[ok], l[ok]
        step = max(1, CHUNK // bits.itemsize // bits.shape[1])  # bitmaps of pairs a few megabytes at a time
        parts = [np.bitwise_count(bits[k[a : a + step]] ^ bits[l[a : a + step]]).sum(axis=1, dtype=np.int64) for a in range(0, len(k), step)]
        differ = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        keep = _may_link((n[k] + n[l] - differ) // 2, n[k] + n[l], num, den)
        k, l = k[keep], l[keep]
        return np.maximum(ids[k], ids[l]), np.minimum(ids[k], ids[l])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(ready: pa.Table):
            cols = [ready.column(k).to_numpy() for k in ("key", "i", "j", "mine", "id", "label", "n")]
            maps = [np.frombuffer(x, dtype=np.uint64) for x in ready.column("bits").to_pylist()]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            edges = [0, *change.tolist(), ready.num_rows]
            us, vs = [], []
            for s, e in zip(edges, edges[1:]):
                if e - s > 1:
                    words = min(map(len, maps[s:e]))
                    bits = np.stack([folded(x, words) for x in maps[s:e]])
                    u, v = pairs(cols[0][s], cols[1][s], cols[2][s], *(c[s:e] for c in cols[3:]), bits)
                    us.append(u)
                    vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for x in batches:
            if not x.num_rows:
                continue
            held.append(x)
            t = pa.Table.from_batches(held)
            last = [t.column(k)[-1].as_py() for k in ("key", "i", "j")]
            same = np.logical_and.reduce([t.column(k).to_numpy() == w for k, w in zip(("key", "i", "j"), last)])
            cut = int(np.argmax(same))
            if cut:
                yield from flush(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(run, schema).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id; links: den * intersection >= num * union."""
    features = materialise(_features(docs, n, num, den), "shingle-features")
    known = features.where("id IS NOT NULL AND n > 0")
    classes = materialise(known.groupBy("digest").agg(F.min("id").alias("rep")), "set-classes")
    twins = materialise(
        known.select("id", "digest").join(classes, "digest").where("id <> rep").select("id", "rep").distinct(), "copies"
    )

    rows = known.select(F.explode("keys").alias("key"), "id")
    # Each join below has two plain sides, so that it can be split where a key is hot. Signatures are met in
    # slices of their range, so that only a slice of them is between executors at a time.
    gone = twins.select("id").join(classes.select(F.col("rep").alias("id")), "id", "left_anti")
    parts = []
    for i in range(SLICES):
        mine = rows.where(F.pmod(F.shiftright("key", 1), F.lit(SLICES)) == i)
        met_keys = materialise(mine.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "met-keys")
        # Copies go here and not before, so that no signatures are moved for that.
        parts.append(materialise(mine.join(met_keys, "key").join(gone.hint("merge"), "id", "left_anti"), "met-rows"))
    shared = reduce(DataFrame.unionByName, parts)
    odd = F.col("key").bitwiseAND(F.lit(1)).cast("int")
    needs = known.select("id", F.posexplode("need").alias("odd", "need")).where("need > 0")
    needs = needs.groupBy("id", "odd").agg(F.min("need").alias("need"))
    enough = shared.groupBy("id", odd.alias("odd")).agg(F.count("*").alias("c")).join(needs, ["id", "odd"]).where("c >= need")
    enough = materialise(enough.select("id", "odd"), "candidates")
    shared = materialise(shared.withColumn("odd", odd).join(enough.hint("merge"), ["id", "odd"]).select("key", "id"), "candidate-rows")
    buckets = shared.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    buckets = materialise(buckets, "bucket-pivots")
    shared = materialise(shared.join(buckets, "key"), "buckets")
    # Only classes that share a bucket are ever compared.
    met = materialise(known.select("id", "n", "bits").join(shared.select("id").distinct().hint("merge"), "id", "left_semi"), "met")
    star = shared.where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct()
    links = _verified(star, met, docs, n, num, den)

    labels = materialise(components(links), "labels")
    rest = shared.where("c > 2").join(labels, "id", "left").select(
        "key", "id", "pivot", F.coalesce("component", "id").alias("label")
    )
    several = rest.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c"))
    several = materialise(several.where("a <> b").select("key", "c"), "open-keys")
    rest = materialise(
        rest.join(several, "key")
        .where("id <> pivot").select("key", "id", "label", "c")
        .join(met, "id"),
        "open-buckets",
    )
    # Large buckets that share a class become one, named by the least of their keys.
    large = rest.where(F.col("c") > ALONE)
    first = large.groupBy("id").agg(F.min("key").alias("v"))
    united = components(large.join(first, "id").select(F.col("key").alias("u"), "v"))
    merged = (
        large.join(united, large["key"] == united["id"], "left")
        .select(F.coalesce("component", "key").alias("key"), large["id"], "label", "n", "bits").distinct()
    )
    open_rows = materialise(rest.where(F.col("c") <= ALONE).drop("c").unionByName(merged), "open-rows")
    more = _verified(_across(open_rows, num, den), met, docs, n, num, den)
    copies = twins.select(F.col("id").alias("u"), F.col("rep").alias("v"))
    found = materialise(components(links.unionByName(more).unionByName(copies)), "components")
    per_class = classes.join(found, classes["rep"] == found["id"], "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    per_class = materialise(per_class, "class-components")
    out = features.select("id", "n", "digest").alias("f").join(per_class.alias("c"), "digest", "left")
    return out.select(
        F.col("f.id").alias("doc_id"),
        F.col("f.n").alias("n_shingles"),
        F.when(F.col("f.id").isNull(), None).when(F.col("f.n") == 0, F.col("f.id")).otherwise(F.col("c.component")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest doc_id stays.

    Rows without doc_id and documents without words stay.
    """
    found = jaccard_components(docs, n, num, den)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.select(F.struct("*").alias("d")).join(gone, F.col("d.doc_id") == F.col("_gone"), "left_anti").select("d.*")
