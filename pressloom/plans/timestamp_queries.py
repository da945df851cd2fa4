"""p1: every date that a feed wrote, as one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators.timestamps import to_utc_micros
from pressloom.runtime import small_side, table


def item_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, field, value, home_zone: one row for each non-null written date."""
    zones = table(spark, sf_dir, "sources").groupBy("source").agg(F.min("home_zone").alias("home_zone"))
    items = table(spark, sf_dir, "items").select(
        "item_id", "source", "published", F.get_json_object("extra", "$.page_age").alias("page_age")
    )
    fields = F.array(
        *(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("published", "page_age"))
    )
    return (
        items.select("item_id", "source", F.inline(F.filter(fields, lambda x: x["value"].isNotNull())))
        .join(small_side(zones), "source", "left")
        .select("item_id", "field", "value", "home_zone")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        to_utc_micros(item_dates(spark, sf_dir), "value", "home_zone")
        .filter(F.col("utc_us").isNotNull())
        .select("item_id", "field", "utc_us")
    )


def p1_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report: shape masks, how many values have each, and how many of them state a date."""
    from pressloom.operators.timestamps import shape_mask, tidy

    got = to_utc_micros(item_dates(spark, sf_dir), "value", "home_zone")
    return (
        got.groupBy("field", shape_mask(tidy(F.col("value"))).alias("mask"))
        .agg(F.count(F.lit(1)).alias("n_values"), F.count("utc_us").alias("n_dates"))
    )


QUERIES = {"p1_found": p1_found, "p1_formats": p1_formats}
ORACLES: dict[str, str] = {}
