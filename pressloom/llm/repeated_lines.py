"""Lines repeated across one source's documents (problem 5).

Method: every source has a weighted graph. Its nodes are the folded lines (trimmed, white space and digit runs
collapsed, case ignored) with the number of items that hold them; its edges are pairs of consecutive non-blank lines
with the number of items in which they follow each other. High-support nodes and edges are kept; the connected
components of what is kept are the source's boilerplate blocks (a node without a kept edge is a block of its own).
Every occurrence of a line of a block is matched and taken out.

Defined results: items without source (null) form one group; null and empty texts hold no line; blank lines are
never matched; rows with one and the same id count once; a text of boilerplate alone becomes ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators.graph import components
from pressloom.runtime import cut, table

#: Items of one source in which a line must stand to be repeated too often, and in which two lines must follow each other.
SUPPORT = 5
SALTS = 16


def folded(line: Column) -> Column:
    """Trimmed, each run of white space one space, each run of digits one digit, case ignored."""
    one = F.regexp_replace(F.regexp_replace(line, r"(?U)[\s\p{Z}]+", " "), r"\p{Nd}+", "0")
    return F.lower(F.trim(one))


def occurrences(items: DataFrame) -> DataFrame:
    """item_id, line_no, n1, n2, next1: each non-blank line with its node and the node of the next non-blank line."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), folded(x).alias("line")),
    )
    nodes = F.transform(
        F.filter(lines, lambda x: x["line"] != ""),
        lambda x: F.struct(
            x["line_no"].alias("line_no"),
            F.xxhash64(F.coalesce("source", F.lit("")), x["line"]).alias("n1"),
            F.hash(x["line"]).alias("n2"),
        ),
    )
    got = items.filter("text is not null and text <> ''").select("item_id", "source", nodes.alias("nodes"))
    return got.select("item_id", "source", F.posexplode("nodes").alias("pos", "x"), "nodes").select(
        "item_id", "source", "x.line_no", "x.n1", "x.n2", F.get("nodes", F.col("pos") + 1)["n1"].alias("next1")
    )


def blocks(items: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """The matched occurrences (item_id, source, line_no, n1, next1, n_items) and the blocks (n1, block)."""
    occ = cut(occurrences(items))
    # count distinct items: partial by (node, item), so that no task sees all items of a hot line
    nodes = occ.groupBy("n1", "n2").agg(F.countDistinct("item_id").alias("n_items")).filter(F.col("n_items") >= support)
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = occ.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int"))
    hits = cut(salted.join(nodes, ["n1", "n2", "salt"]).select("item_id", "source", "line_no", "n1", "next1", "n_items"))
    edges = (
        hits.filter("next1 is not null")
        .groupBy("n1", "next1")
        .agg(F.countDistinct("item_id").alias("weight"))
        .filter(F.col("weight") >= support)
    )
    parts = components(edges, "n1", "next1")
    kept = hits.select("n1").distinct()
    whole = kept.join(parts.withColumnRenamed("node", "n1"), "n1", "left")
    return hits, whole.select("n1", F.coalesce("component", "n1").alias("block"))


def matches(items: DataFrame, support: int = SUPPORT) -> DataFrame:
    """item_id, source, line_no, n1, n_items, block: each occurrence of a line of a boilerplate block."""
    hits, parts = blocks(items, support)
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int"))
    got = salted.join(parts, ["n1", "salt"]).select("item_id", "source", "line_no", "n1", "n_items", "block")
    return got.dropDuplicates(["item_id", "line_no"])


def without_repeated(items: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``items`` with ``text`` freed of the matched lines and ``n_removed``; other columns stay."""
    gone = matches(items.select("item_id", "source", "text"), support).groupBy("item_id").agg(
        F.collect_set("line_no").alias("__gone")
    )
    text = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", (i + 1).cast("long"))), "\n"
    )
    return (
        items.join(gone, "item_id", "left")
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(text))
        .withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)))
        .drop("__gone")
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "items").select("item_id", "source", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(_items(spark, sf_dir)).select("item_id", "line_no")


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each source: different lines, matched occurrences, items of the most frequent line."""
    got = matches(_items(spark, sf_dir))
    lines = got.groupBy("source", "block", "n1").agg(F.count(F.lit(1)).alias("n"), F.max("n_items").alias("n_items"))
    return lines.groupBy("source", "block").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_occurrences"), F.max("n_items").alias("n_items")
    ).drop("block")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated(_items(spark, sf_dir)).select("item_id", "text", F.col("n_removed").cast("long").alias("n_removed"))


QUERIES = {"p5_found": p5_found, "p5_blocks": p5_blocks, "p5_clean": p5_clean}

_LINES = r"""
WITH lines AS (
  SELECT item_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no
  FROM items WHERE text <> ''
), f AS (
  SELECT item_id, coalesce(source, '') AS source, line_no, raw,
    lower(trim(regexp_replace(regexp_replace(raw, '[\s\p{Z}]+', ' ', 'g'), '\p{Nd}+', '0', 'g'))) AS line
  FROM lines
), often AS (
  SELECT source, line FROM f WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT item_id) >= 5
)"""
ORACLES = {
    "p5_found": _LINES + " SELECT DISTINCT item_id, line_no FROM f JOIN often USING (source, line)",
    "p5_blocks": _LINES.replace("WITH lines", "WITH RECURSIVE lines")
    + """, n AS (SELECT item_id, source, line_no, line, lead(line) OVER (PARTITION BY item_id ORDER BY line_no) AS after FROM f WHERE line <> ''),
e AS (SELECT source, line AS a, after AS b FROM n WHERE after IS NOT NULL AND after <> line GROUP BY ALL HAVING count(DISTINCT item_id) >= 5),
both_ways AS (SELECT * FROM e UNION SELECT source, b, a FROM e),
reach(source, line, other) AS (SELECT source, line, line FROM often UNION SELECT r.source, r.line, b.b FROM reach r JOIN both_ways b ON b.source = r.source AND b.a = r.other),
part AS (SELECT source, line, min(other) AS block FROM reach GROUP BY source, line),
c AS (SELECT source, line, count(*) AS n, count(DISTINCT item_id) AS n_items FROM f GROUP BY source, line)
SELECT nullif(source, '') AS source, count(*) AS n_lines, sum(n)::BIGINT AS n_occurrences, max(n_items) AS n_items FROM part JOIN c USING (source, line) GROUP BY source, block""",
    "p5_clean": _LINES
    + """, kept AS (
  SELECT item_id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (often.line IS NULL) AS text, count(often.line) AS n_removed
  FROM f LEFT JOIN often USING (source, line) GROUP BY item_id)
SELECT i.item_id, CASE WHEN k.item_id IS NULL THEN i.text ELSE coalesce(k.text, '') END AS text, coalesce(n_removed, 0) AS n_removed
FROM items i LEFT JOIN kept k USING (item_id)""",
}
