"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a shuffled order, queued again up to `max_repeat` times. As in
a network, a long document is served in packets, of at most `packet` words. A packet that ends at position c of its source's queue
has the virtual finish time c / target. All packets of all sources are put in the order of finish times and
served until the running total of their words is the budget, all words of the corpus; the packet on which
the budget ends is served in part. Targets add up to the budget, so that is near virtual time 1, and every source
is within some packets of its target; a document's words are served at most `max_repeat` times.

The global sort is by range: totals of ranges of finish times (few rows) find the range on which the budget
ends, and only the packets of that range are sorted, in partitions by range, whose totals find the
partition and in it the packet. Running positions are not computed over a whole source either, which may
hold a third of all rows: they are sums over (source, shuffle bucket) plus a window inside the bucket. The
shuffle draws by id and text, so null ids or one id on many texts are no bucket. Sources pass whole through one
window, a row each: there may be millions, not billions.

Defined results: null text or text without words has size 0 and nothing taken; null source is a source
of its own, ranked last; rows that repeat (the same doc_id) are served each on their own; empty input
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
KEYS = ["null_source", "source"]
#: Ranges of virtual time: so many in a unit, those beyond RANGES units in one.
FINE, RANGES = 1024, 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(null_source, source, source_size) -> the same with target.

    Water filling: the level L with sum(min(max_repeat * size, weight * L)) = all sizes is where resharing
    the excess of capped sources ends. One row per source goes through the window, never documents.
    """
    order = W.orderBy("null_source", "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeat)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "null_source", "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    t = t.withColumn("last_level", F.max("level").over(everything))
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(
        F.col("last_level") * F.col("weight")
    )
    return t.select("null_source", "source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, n_buckets: int, seed: str, *more: Column) -> DataFrame:
    """doc_id, null_source, source, size, draw and bucket of every row, beside more columns."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.md5(F.concat(own, F.lit(":"), F.coalesce(F.md5("text"), F.lit("")), F.lit(f":{seed}")))
    rows = docs.select(
        *more,
        "doc_id",
        F.col("source").isNull().alias("null_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        draw.alias("draw"),
    )
    return rows.withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 6), 16, 10).cast("long") * n_buckets / F.lit(1 << 24)).cast("int"))


def _within() -> Column:
    """Words of the bucket up to and with the row."""
    return F.sum("size").over(
        W.partitionBy(*KEYS, "bucket").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    )


def _packets(placed: DataFrame, max_repeat: int, packet: int) -> DataFrame:
    """Every packet of every service: its source, words, end in the queue, finish time and range of time."""
    repeats = F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))
    rows = placed.where((F.col("size") > 0) & (F.col("target") > 0)).select("*", repeats.alias("again"))
    last = F.floor((F.col("size") - 1) / packet)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("j"))
    words = F.least(F.lit(packet), F.col("size") - F.col("j") * packet).cast("long")
    ends = F.col("end") - F.col("size") + F.col("j") * packet + words + F.col("again") * F.col("source_size")
    rows = rows.select(*KEYS, words.alias("words"), ends.alias("place"), (ends / F.col("target")).alias("finish"))
    return rows.withColumn("time", F.least(F.floor(F.col("finish") * FINE), F.lit(FINE * RANGES)).cast("int"))


def _limits(packets: DataFrame, budget: int) -> DataFrame:
    """null_source, source, limit: the place in the queue up to which a source is served within the budget."""
    totals = materialise(packets.groupBy(*KEYS, "time").agg(F.sum("words").alias("words"), F.max("place").alias("place")), "mix-times")
    running = F.sum("words").over(W.orderBy("time"))
    times = totals.groupBy("time").agg(F.sum("words").alias("words")).withColumn("upto", running)
    cut = times.where(F.col("upto") >= budget).orderBy("time").first()  # ranges are few
    if cut is None:
        return totals.groupBy(*KEYS).agg(F.max("place").alias("limit"))
    order = ["finish", *KEYS, "place"]
    inside = packets.where(F.col("time") == cut["time"]).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    inside = materialise(inside, "mix-schedule")
    left = budget - (cut["upto"] - cut["words"])
    parts = inside.groupBy("part").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(W.orderBy("part")))
    part = parts.where(F.col("upto") >= left).orderBy("part").first()  # partitions are few
    left -= part["upto"] - part["words"]
    last = (
        inside.where(F.col("part") == part["part"]).withColumn("upto", F.sum("words").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
        .where(F.col("upto") >= left).orderBy(*order).first()
    )
    key, at = F.struct(*order), F.struct(*(F.lit(last[c]).alias(c) for c in order))
    place = F.when(key < at, F.col("place")).when(key == at, F.col("place") - (last["upto"] - left))
    served = totals.where(F.col("time") < cut["time"]).select(*KEYS, "place").unionByName(inside.select(*KEYS, place.alias("place")))
    return served.groupBy(*KEYS).agg(F.max("place").alias("limit"))


def _queues(docs: DataFrame, weights: tuple[int, ...], max_repeat: int, n_buckets: int, seed: str, packet: int) -> tuple[DataFrame, DataFrame]:
    """Documents by place in their source's queue, and of each bucket where it starts and how far its source is served."""
    sized = materialise(_sized(docs, n_buckets, seed), "mix-sizes")
    buckets = sized.groupBy(*KEYS, "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = source_targets(buckets.groupBy(*KEYS).agg(F.sum("bucket_size").alias("source_size")), weights, max_repeat)
    earlier = W.partitionBy(*KEYS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select(
        *KEYS, "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")
    ).join(sources, KEYS)
    starts = materialise(starts, "mix-buckets")
    placed = sized.withColumn("upto", _within()).join(starts, [*KEYS, "bucket"])
    placed = materialise(
        placed.select("doc_id", *KEYS, "bucket", "size", "source_size", "target", (F.col("bucket_start") + F.col("upto")).alias("end")), "mix-places"
    )
    budget = placed.agg(F.sum("size")).first()[0] or 0
    limits = _limits(_packets(placed, max_repeat, packet), budget)
    return placed, starts.join(limits, KEYS, "left").fillna(0, ["limit"])


def _taken(max_repeat: int) -> Column:
    """Words of the document at (end - size, end] that its source serves up to limit, repeats counted."""
    start = F.col("end") - F.col("size")
    served = [
        F.least(F.greatest(F.col("limit") - F.col("source_size") * n - start, F.lit(0)), F.col("size")) for n in range(max_repeat)
    ]
    return sum(served[1:], served[0]).cast("long")


def mix_to_weights(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, n_buckets: int = 1024, seed: str = "mix", packet: int = 32
) -> DataFrame:
    """doc_id, text, source -> doc_id, size, source_size, target, taken, start, finish.

    start and finish are the virtual times of the document's first service; taken is the number of its
    words served within the budget, repeats counted.
    """
    placed, served = _queues(docs, weights, max_repeat, n_buckets, seed, packet)
    rows = placed.join(served.select(*KEYS, "bucket", "limit"), [*KEYS, "bucket"])
    some = F.col("target") > 0
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        _taken(max_repeat).alias("taken"),
        F.when(some, (F.col("end") - F.col("size")) / F.col("target")).alias("start"),
        F.when(some, F.col("end") / F.col("target")).alias("finish"),
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, n_buckets: int = 1024, seed: str = "mix", packet: int = 32
) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each service of a document.

    A whole service gives the document as it is, a last service in part its first words joined by single
    spaces, with n_chars set to match; documents that are not served go. All other columns stay, whatever their names.
    """
    served = _queues(docs, weights, max_repeat, n_buckets, seed, packet)[1]
    # The document is one column beside the operator's own, so names cannot clash; it is placed as it was without it.
    rows = _sized(docs, n_buckets, seed, F.struct("*").alias("d")).withColumn("upto", _within())
    rows = rows.join(served, [*KEYS, "bucket"]).withColumn("end", F.col("bucket_start") + F.col("upto"))
    rows = rows.select("d", "size", _taken(max_repeat).alias("taken")).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    words = F.filter(F.split("d.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, 1, F.greatest(rest, F.lit(1)).cast("int")), " ")
    copies = F.flatten(
        F.array(
            F.array_repeat(F.struct(F.col("d.text").alias("text"), F.lit(False).alias("cut")), whole),
            F.when(rest > 0, F.array(F.struct(part.alias("text"), F.lit(True).alias("cut"))))
            .otherwise(F.array().cast("array<struct<text:string,cut:boolean>>")),
        )
    )
    out = rows.select("d", F.explode(copies).alias("served"))
    columns = []
    for field in docs.schema:
        own = F.col("d").getField(field.name)
        if field.name == "text":
            own = F.col("served.text")
        elif field.name == "n_chars":
            own = F.when(F.col("served.cut"), F.length("served.text").cast(field.dataType)).otherwise(own)
        columns.append(own.alias(field.name))
    return out.select(*columns)
