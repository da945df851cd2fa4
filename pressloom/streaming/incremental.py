"""Incremental runs with Structured Streaming: new item files against the ledger, duplicates within a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressloom.operators.items import drop_seen, first_wins, keyed
from pressloom.operators.state import Ledger


def run_available(spark: SparkSession, path: str, schema: str, ledger: Ledger, out: str, checkpoint: str, week: str) -> StreamingQuery:
    """Process the files that are there and stop: per micro-batch drop seen keys, keep the first of each new key, write
    the items, and only then record them (a failure before that repeats the batch: at least once, like delivery)."""

    def one(batch: DataFrame, batch_id: int) -> None:
        fresh = first_wins(drop_seen(batch, ledger.read()), ["key"], [F.col("ord")]).persist()
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        ledger.append(
            fresh.withColumn("first_seen", F.current_timestamp()).withColumn("week", F.lit(week)), [F.col("ord")]
        )
        fresh.unpersist()

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def suppress_repeats(stream: DataFrame, event_time: str = "published", days: int = 180) -> DataFrame:
    """The first of each key within ``days`` of event time; state older than that is dropped."""
    return keyed(stream).withWatermark(event_time, f"{int(days)} days").dropDuplicatesWithinWatermark(["key"])


def weekly_counts(stream: DataFrame, event_time: str = "published", late: str = "7 days") -> DataFrame:
    """Items of each source and week, with late data up to ``late``."""
    return (
        stream.withWatermark(event_time, late)
        .groupBy(F.window(event_time, "7 days", startTime="4 days").alias("week"), "source")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )
