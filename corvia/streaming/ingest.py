"""New judgments as a stream: the batch filter on arriving files, each judgment stored once.

What has been stored is known by keyed state, an id for each judgment, in Spark's RocksDB state store: a micro-batch
looks up the ids that it brings and nothing else, so its work does not grow with the store, and the store is never read.
The file sink commits each batch once, so a batch that is tried again leaves no second copy. Where ids may be
forgotten after a time, `forget` says after how long (in time of judgments), and state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvia.operators.corpus_filter import select_cases
from corvia.sources.records import RECORD

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def each_once(cases: DataFrame, forget: str | None = None) -> DataFrame:
    """The rows of a stream (or table) whose jid has not come before; with `forget`, not within that time of jdate.

    Rows older than the greatest date by more than `forget` are late and go; rows without a readable date do not count as late.
    """
    if forget is None:
        return cases.dropDuplicates(["jid"])
    dated = cases.withColumn("_at", F.coalesce(F.try_to_timestamp("jdate", F.lit("yyyyMMdd")), F.current_timestamp()))
    return dated.withWatermark("_at", forget).dropDuplicatesWithinWatermark(["jid"]).drop("_at")


def ingest(
    spark: SparkSession, source: str, path: str, checkpoint: str, courts: tuple[str, ...] = ("KL",), forget: str | None = None
) -> StreamingQuery:
    """Reads JSON lines of records under source until all that is there is stored as Parquet at path."""
    arriving = spark.readStream.schema(RECORD).json(source)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:  # the query keeps the settings that it starts with
        return (
            each_once(select_cases(arriving, courts), forget).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events a window and key, for a stream or a table; rows later than `late` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
