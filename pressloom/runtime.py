"""Session-level helpers shared by all operators: table reading, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most rows and bytes of a side that may be broadcast. Above either the plain join is left to the planner.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint ``df`` for broadcast only if counting proves that it has at most ``max_rows`` rows and ``max_bytes`` bytes of values."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + F.lit(16) for c in df.columns), F.lit(0))
    n = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if n.rows <= max_rows and n.bytes <= max_bytes else df


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the folder that all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local master (one process, as in tests) gets a folder of its machine; a cluster must set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"{tempfile.gettempdir()}/pressloom-shared"
    return f"{at.rstrip('/')}/pressloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; ``release`` deletes it with all others of the application."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. Results that are still to be read must be written first."""
    remove(spark, shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ways into which the rows of one key are spread by ``salted_join``.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` (few rows a key) so that no task holds all rows of a hot key: the left rows of a key go
    to ``salts`` tasks by the hash of ``spread_by``, and each right row to all of them. Always a merge join: the repeated right
    rows compress so well that they might be taken for small enough to broadcast."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("merge"), [*on, "__salt"], how).drop("__salt")


#: Rows of one key that a task may hold without being called hot.
HUB = 100_000


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hub: int = HUB) -> DataFrame:
    """``left`` (a written table) joined with ``right`` (at most one row a key; null keys find nothing), hot keys apart.

    Keys with more than ``hub`` rows and a thousandth of all rows are hot: there are fewer than 1000 of them, so their right
    rows are broadcast, and their left rows are spread by their own hash instead of meeting in one task."""
    total = left.count()
    if total <= hub:
        return left.join(right, key, how)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max(hub, total // 1000)).select(key)
    value = F.struct(*[c for c in right.columns if c != key])
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi").select(key, value.alias("__hot")))
    spread = F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.xxhash64(*left.columns))
    rest = right.select(F.col(key).alias("__k"), value.alias("__cold"))
    got = left.join(few, key, "left").withColumn("__k", spread).join(rest, "__k", "left").withColumn("__v", F.coalesce("__hot", "__cold"))
    if how == "inner":
        got = got.filter("__v is not null")
    return got.select(*left.columns, "__v.*")


def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with further nullable columns (name=type)."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind, True)
    return out
