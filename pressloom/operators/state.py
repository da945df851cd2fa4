"""Ledger and cache as append-only Parquet tables; nothing is rewritten in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators.items import first_wins
from pressloom.runtime import small_side


def insert_or_ignore(ledger: DataFrame, rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows to append: the first of each new key. Null keys are not recorded."""
    new = rows.filter("key is not null").join(small_side(ledger.select("key").distinct(), 200_000), "key", "left_anti")
    return first_wins(new, ["key"], order)


def latest(cache: DataFrame, key: str = "key", created: str = "created", ties: str | None = None) -> DataFrame:
    """The last value written of each key (ties by ``ties``, the larger)."""
    rest = [c for c in cache.columns if c != key]
    rank = F.struct(created, *([ties] if ties else []))
    return cache.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(key, *(F.col("__r")[c].alias(c) for c in rest))


def probe(items: DataFrame, cache: DataFrame, now: Column, max_age_days: int, valid: Column) -> DataFrame:
    """Items with the latest cached value and ``hit``: present, young enough and ``valid`` (a falsy value is a miss)."""
    young = F.col("created") >= now - F.expr(f"INTERVAL {int(max_age_days)} DAYS")
    return items.join(latest(cache), "key", "left").withColumn("hit", F.coalesce(F.col("created").isNotNull() & young & valid, F.lit(False)))


def purge(rows: DataFrame, ts: str, now: Column, days: int = 180) -> DataFrame:
    """What is left when everything older than ``days`` is gone; rows without a date go too."""
    return rows.filter(F.col(ts) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


class Ledger:
    """Seen keys in a folder; every append is a new file set with a run id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        schema = "key string, url string, title string, source string, first_seen timestamp, week string, run string"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, order: list[Column]) -> None:
        new = insert_or_ignore(self.read(), rows, order)
        new.select("key", "url", "title", "source", "first_seen", "week").withColumn("run", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(self.path)
