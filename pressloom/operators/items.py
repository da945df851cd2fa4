"""Operators over Items: one row per item with ``ord``, the explicit position that decides every tie.

An Item has source, source_type, title, url, published (timestamp), summary, text and ord (unique, ascending order of
arrival). Null title, summary and text count as ''. Rows that repeat an ord are the caller's to drop beforehand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.text import body
from pressloom.functions.urls import item_key
from pressloom.runtime import cut, small_side


def union(parts: list[DataFrame]) -> DataFrame:
    """All sources' items as one table; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keyed(items: DataFrame) -> DataFrame:
    return items.withColumn("key", item_key(F.col("url"), F.coalesce("source_type", F.lit("")), F.coalesce("title", F.lit(""))))


# ---- filters ------------------------------------------------------------------------------------------------------


def window_floor(items: DataFrame, since: Column, strict: bool = False) -> DataFrame:
    """Items from ``since`` on; undated items pass (strict: only dated items after it)."""
    if strict:
        return items.filter(F.col("published") > since)
    return items.filter(F.col("published").isNull() | (F.col("published") >= since))


def term_filter(items: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, joint: str = "\n") -> DataFrame:
    """Items whose title or summary holds any ``include`` term and no ``exclude`` term as a substring, case ignored."""
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(joint), F.coalesce("summary", F.lit(""))))
    hits = lambda terms: reduce(lambda a, b: a | b, (F.contains(hay, F.lit(t.lower())) for t in terms))
    if include:
        items = items.filter(hits(include))
    if exclude:
        items = items.filter(~hits(exclude))
    return items


def lanes(items: DataFrame, separate: str = "imap") -> tuple[DataFrame, DataFrame]:
    """Stories, and the items of the type that has a lane of its own, newest first."""
    own = F.col("source_type") == separate
    return items.filter(~F.coalesce(own, F.lit(False))), items.filter(own)


# ---- ranks, caps, first wins --------------------------------------------------------------------------------------


def first_wins(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. A minimum per key over a struct: partial aggregates, no sort of hot keys."""
    rest = [c for c in items.columns if c not in keys]
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    best = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return best.select(*keys, *(F.col("__row")[c].alias(c) for c in rest))


def cap(items: DataFrame, per: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group (pruned map-side by the window group limit)."""
    w = Window.partitionBy(*per).orderBy(*order)
    return items.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def top(items: DataFrame, n: int, order: list[Column], name: str = "rank") -> DataFrame:
    """The first ``n`` rows of a total order with their rank: a distributed top-n; only its rows are numbered."""
    return items.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def cut_then_sort(items: DataFrame, per: list[str], n: int, score: str) -> DataFrame:
    """The first ``n`` in order of arrival, then ranked by score."""
    kept = cap(items, per, n, [F.col("ord")])
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc_nulls_last(score), "ord")))


def sort_then_cut(items: DataFrame, per: list[str], n: int, score: str) -> DataFrame:
    """The ``n`` best by score."""
    w = Window.partitionBy(*per).orderBy(F.desc_nulls_last(score), "ord")
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def global_index(items: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """0-based position in a total order without one task seeing all rows: a range-partitioned sort, then counts per
    partition, then row numbers inside partitions."""
    parts = items.sort(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    parts = cut(parts)  # partition ids must not change between the two uses
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__m")) - 1
    return parts.withColumn("__i", inside).join(small_side(before), "__p").withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__m", "__before", "__i")


def batches(items: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """batch and index_in_batch of every row in a total order."""
    got = global_index(items, order)
    return got.withColumn("batch", F.floor(F.col("index") / size)).withColumn("index_in_batch", F.pmod("index", F.lit(size))).drop("index")


# ---- duplicates ---------------------------------------------------------------------------------------------------


def dedupe_sets(items: DataFrame) -> DataFrame:
    """key, winner's ord, source and length, also_seen_in (sorted), n: the richest copy of each key.

    Richest is the longest body, the earliest among equals; also_seen_in are the other copies' sources. Aggregates
    only, with partial results before the shuffle: a key with a third of all rows is no special case.
    """
    length = F.length(body(F.col("text"), F.col("summary")))
    return (
        keyed(items)
        .withColumn("len", length)
        .groupBy("key")
        .agg(
            F.max_by(F.struct("ord", "source", "len"), F.struct("len", -F.col("ord"))).alias("w"),
            F.collect_set("source").alias("sources"),
            F.min("ord").alias("first_ord"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "key",
            F.col("w.ord").alias("ord"),
            F.col("w.source").alias("source"),
            F.col("w.len").alias("len"),
            F.array_sort(F.array_except("sources", F.array("w.source"))).alias("also_seen_in"),
            "first_ord",
            "n",
        )
    )


def dedupe_ordered(items: DataFrame) -> DataFrame:
    """key, ord, published, also_seen_in in the order of a sequential pass: on every takeover the list restarts with the
    former winner and its list, and a winner without date takes the loser's.

    The fold needs only the rows that change it: the first row of each (key, source, published null or not) and the
    rows that are longer than all before them. The latter are first rows of their (key, length), so partial aggregates come
    before any window: a hot key is reduced to its different lengths, then to (distinct sources x 2 + takeovers) rows.
    """
    k = cut(keyed(items).select(  # narrow, and used three times
        "key", "ord", F.coalesce("source", F.lit("")).alias("source"), "published", F.length(body(F.col("text"), F.col("summary"))).alias("len")
    ))
    of_length = k.groupBy("key", "len").agg(F.min(F.struct("ord", "source", "published")).alias("x")).select("key", "len", "x.*")
    before = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    taller = cut(of_length.withColumn("most", F.coalesce(F.max("len").over(before), F.lit(-1))).filter("len > most").drop("most"))
    losers = k.join(taller.select("key", "ord"), ["key", "ord"], "left_anti")
    firsts = losers.groupBy("key", "source", F.col("published").isNull().alias("undated")).agg(F.min(F.struct("ord", "len", "published")).alias("r"))
    rows = taller.select("key", F.struct("ord", "len", "source", "published").alias("r")).unionByName(
        firsts.select("key", F.struct("r.ord", "r.len", "source", "r.published").alias("r"))
    )
    # a loser between two takeovers matters to the list of the winner of its time: keep each (winner, source) first
    seq = F.array_sort(F.collect_list("r"))
    folded = rows.groupBy("key").agg(seq.alias("rows"))
    zero = F.struct(
        F.lit(None).cast("long").alias("ord"), F.lit(-1).alias("len"), F.lit("").alias("source"), F.lit(None).cast("timestamp").alias("published"),
        F.array().cast("array<string>").alias("also"),
    )

    def step(acc: Column, r: Column) -> Column:
        takes = r["len"] > acc["len"]
        started = acc["ord"].isNotNull()
        losers = F.when(takes, F.when(started, F.concat(F.array(acc["source"]), acc["also"])).otherwise(F.array().cast("array<string>"))).otherwise(F.array(r["source"]))
        winner = F.when(takes, r["source"]).otherwise(acc["source"])
        base = F.when(takes, F.array().cast("array<string>")).otherwise(acc["also"])
        also = F.array_distinct(F.concat(base, F.filter(losers, lambda s: s != winner)))
        return F.struct(
            F.when(takes, r["ord"]).otherwise(acc["ord"]).alias("ord"),
            F.greatest(acc["len"], r["len"]).alias("len"),
            winner.alias("source"),
            F.when(takes, F.coalesce(r["published"], acc["published"])).otherwise(F.coalesce(acc["published"], r["published"])).alias("published"),
            also.alias("also"),
        )

    done = folded.withColumn("x", F.aggregate("rows", zero, step))
    return done.select("key", F.col("x.ord").alias("ord"), F.col("x.source").alias("source"), F.col("x.published").alias("published"), F.col("x.also").alias("also_seen_in"))


# ---- history ------------------------------------------------------------------------------------------------------


def drop_seen(items: DataFrame, ledger: DataFrame, has_key: bool = False) -> DataFrame:
    """Items whose key the ledger lacks (``has_key``: the column key is the item's key). Only keys travel; a small ledger is
    broadcast after its size was checked."""
    return (items if has_key else keyed(items)).join(small_side(ledger.select("key").distinct(), 200_000), "key", "left_anti")


def seen(items: DataFrame, ledger: DataFrame) -> DataFrame:
    return keyed(items).join(small_side(ledger.select("key").distinct(), 200_000), "key", "left_semi")


def prefix_match(items: DataFrame, prefixes: list[tuple[str, float]], url: str = "url") -> Column:
    """The value of the first prefix that a url starts with; null where none does. The prefixes are a short list."""
    out = F.lit(None).cast("double")
    for p, gap in reversed(prefixes):
        out = F.when(F.startswith(F.col(url), F.lit(p)), F.lit(gap)).otherwise(out)
    return out
