"""Filling fixed-capacity containers with items (problem 8).

Method: optimal length buckets. The global histogram of token counts (at most ``capacity`` entries, whatever the
corpus) goes to the driver; dynamic programming over it chooses the BUCKETS boundaries that minimise padding, exactly
(convex-hull trick, O(buckets x lengths)). Token-budget batches form from the buckets: a batch takes as many items of
one bucket as its budget allows and fills what is left from shorter buckets, an item counting as its bucket's
boundary; since boundaries are fine, little is lost. The plan (how many containers of which make-up) has a bounded
number of lines; every item finds its container from its rank in its bucket alone. Ranks are distributed: counts of
(bucket, group), a running sum over those few rows, and row numbers inside groups of bounded size. Nothing is sorted
globally and no container is built on the driver.

Defined results:
* only documents larger than the capacity are split: into full containers and one rest that is packed like an item
* null and empty texts have 0 tokens and are packed (they count as 1); a spec with a language takes the documents of
  that language, case ignored; its null takes all, also those of unknown language
* rows with one and the same doc_id are one document (the longest); capacities below 1 take nothing
"""

from __future__ import annotations

import base64
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.runtime import cut, table

#: Length buckets for each capacity; items that one rank group holds on average; specs that are planned at once.
BUCKETS, GROUP, AT_ONCE = 128, 50_000, 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the vocabulary's own
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, lang, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(n, pa.int64())], names=["doc_id", "lang", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string, n_tokens long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding. ``lengths`` ascend."""
    d = len(lengths)
    if d <= buckets:
        return [int(x) for x in lengths]
    n, s = np.r_[0, np.cumsum(counts)].astype(float), np.r_[0, np.cumsum(counts * lengths)].astype(float)
    best = lengths * n[1:] - s[1:]  # one bucket for the first j lengths
    came = [np.zeros(d, int)]
    for _ in range(buckets - 1):
        # bucket (i, j]: lengths[j] * (n[j+1] - n[i+1]) - (s[j+1] - s[i+1]); lines of slope -n[i+1] over lengths[j]
        slopes, offsets = -n[1:], best + s[1:]
        hull: list[int] = []
        new, arg, at = np.empty(d), np.zeros(d, int), 0
        for j in range(d):
            new[j], arg[j] = best[j], -1
            if j:
                i = j - 1
                while len(hull) - at >= 2 and (offsets[i] - offsets[hull[-2]]) * (slopes[hull[-2]] - slopes[hull[-1]]) <= (
                    offsets[hull[-1]] - offsets[hull[-2]]
                ) * (slopes[hull[-2]] - slopes[i]):
                    hull.pop()
                hull.append(i)
                x = lengths[j]
                while len(hull) - at >= 2 and slopes[hull[at + 1]] * x + offsets[hull[at + 1]] <= slopes[hull[at]] * x + offsets[hull[at]]:
                    at += 1
                i = hull[at]
                v = slopes[i] * x + offsets[i] + x * n[j + 1] - s[j + 1]
                if v < new[j]:
                    new[j], arg[j] = v, i
        best = new
        came.append(arg)
    out, j, k = [], d - 1, len(came) - 1
    while True:
        out.append(int(lengths[j]))
        while k > 0 and came[k][j] < 0:
            k -= 1  # no further bucket paid here
        if k == 0:
            break
        j, k = int(came[k][j]), k - 1
    return out[::-1]


def plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(bucket, first rank, items per container, first container, containers): where the ranks of each bucket go.

    Containers are opened for the longest bucket that has items left and filled from the longest one that still fits;
    equal make-ups are written as one line for as many containers as all their buckets can supply.
    """
    left, used = list(counts), [0] * len(counts)
    out, container = [], 0
    top = len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room, made, k = capacity, {}, top
        while k >= 0 and room >= bounds[0]:
            fit = min(room // bounds[k], left[k])
            if fit:
                made[k] = fit
                room -= fit * bounds[k]
            k -= 1
        times = min(left[k] // a for k, a in made.items())
        for k, a in made.items():
            out.append((k, used[k], a, container, times))
            used[k] += a * times
            left[k] -= a * times
        container += times
    return out


def packed(counts: DataFrame, specs: list[tuple[int, int, str | None]], buckets: int = BUCKETS, at_once: int = AT_ONCE) -> DataFrame:
    """spec_id, container_id, doc_id, part, n_tokens: every item of ``counts`` (doc_id, lang, n_tokens), once for each spec
    (spec_id, capacity, lang) that takes it. Any number of specs: ``at_once`` of them share a pass over the counts."""
    specs = [s for s in specs if s[1] and s[1] >= 1]
    schema = "spec_id int, container_id long, doc_id long, part long, n_tokens long"
    if not specs:
        return counts.sparkSession.createDataFrame([], schema)
    one = cut(counts.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "lang")).alias("x")).select("doc_id", "x.lang", "x.n_tokens"))
    return functools.reduce(DataFrame.unionByName, (_packed_some(one, specs[lo : lo + at_once], buckets, schema) for lo in range(0, len(specs), at_once)))


def _packed_some(one: DataFrame, specs: list[tuple[int, int, str | None]], buckets: int, schema: str) -> DataFrame:
    spark = one.sparkSession
    options = F.array(*(F.struct(F.lit(i).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("cap"), F.lit(lang).cast("string").alias("want")) for i, c, lang in specs))
    each = one.select("doc_id", "n_tokens", F.lower("lang").alias("lang"), F.inline(options)).filter("want is null or lower(want) = lang")
    # a document beyond the capacity: full parts, then the rest
    whole = F.when(F.col("n_tokens") <= F.col("cap"), F.lit(0)).otherwise(F.floor((F.col("n_tokens") - 1) / F.col("cap")))
    parts = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), whole.cast("long"))))
    items = parts.select(
        "spec_id", "doc_id", "part", F.least(F.col("n_tokens") - F.col("part") * F.col("cap"), F.col("cap")).alias("n_tokens")
    ).withColumn("size", F.greatest("n_tokens", F.lit(1)))
    items = cut(items)
    # at most capacity rows a spec, whatever the corpus
    histogram = items.groupBy("spec_id", "size").agg(F.count(F.lit(1)).alias("n")).toPandas()
    plans: dict[int, tuple[np.ndarray, dict[int, np.ndarray]]] = {}
    for spec_id, capacity, _ in specs:
        h = histogram[histogram.spec_id == spec_id].sort_values("size")
        if not len(h):
            continue
        size, n = h["size"].to_numpy(), h["n"].to_numpy()
        bounds = boundaries(size, n, buckets)
        bucket = np.searchsorted(bounds, size)
        lines = np.array(plan(bounds, [int(n[bucket == k].sum()) for k in range(len(bounds))], capacity), np.int64)
        # of each bucket its lines (first rank, items per container, first container) by rank
        plans[spec_id] = np.array(bounds), {k: (own := lines[lines[:, 0] == k][:, 1:4])[np.argsort(own[:, 0], kind="stable")] for k in range(len(bounds))}
    if not plans:
        return spark.createDataFrame([], schema)
    # the plans are bounded by buckets and capacities, not by the corpus
    data = spark.sparkContext.broadcast(pickle.dumps(plans))
    groups = max(8, int(histogram.n.sum() // GROUP))

    def into_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = _plans(data.value)
        for b in batches:
            spec, size = b.column("spec_id").to_numpy(), b.column("size").to_numpy()
            bucket = np.zeros(len(spec), np.int32)
            for i in np.unique(spec):
                bucket[spec == i] = np.searchsorted(plans[i][0], size[spec == i])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("spec_id", "doc_id", "part", "n_tokens")), pa.array(bucket)], names=["spec_id", "doc_id", "part", "n_tokens", "bucket"])

    def into_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = _plans(data.value)
        for b in batches:
            spec, bucket, rank = (b.column(k).to_numpy() for k in ("spec_id", "bucket", "rank"))
            container = np.zeros(len(spec), np.int64)
            pair = spec.astype(np.int64) << 32 | bucket
            for x in np.unique(pair):
                own = pair == x
                lines = plans[int(x >> 32)][1][int(x & 0xFFFFFFFF)]
                line = lines[np.searchsorted(lines[:, 0], rank[own], side="right") - 1]
                container[own] = line[:, 2] + (rank[own] - line[:, 0]) // line[:, 1]
            yield pa.RecordBatch.from_arrays([b.column("spec_id"), pa.array(container), *(b.column(k) for k in ("doc_id", "part", "n_tokens"))], names=["spec_id", "container_id", "doc_id", "part", "n_tokens"])

    placed = items.mapInArrow(into_buckets, "spec_id int, doc_id long, part long, n_tokens long, bucket int")
    placed = cut(placed.withColumn("g", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)).cast("int")))
    sizes = placed.groupBy("spec_id", "bucket", "g").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("spec_id", "bucket", "g", (F.sum("n").over(Window.partitionBy("spec_id", "bucket").orderBy("g")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("spec_id", "bucket", "g").orderBy("doc_id", "part")) - 1
    ranked = placed.withColumn("inside", inside).join(before, ["spec_id", "bucket", "g"]).withColumn("rank", F.col("before") + F.col("inside"))
    return ranked.select("spec_id", "bucket", "rank", "doc_id", "part", "n_tokens").mapInArrow(into_containers, schema)


@functools.lru_cache(2)
def _plans(data: bytes) -> dict:
    return pickle.loads(data)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    specs = [(r.spec_id, r.capacity, r.lang) for r in table(spark, sf_dir, "pack_specs").select("spec_id", "capacity", "lang").toLocalIterator()]
    return packed(token_counts(table(spark, sf_dir, "documents")), specs), specs


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, items, split documents and unused share of each spec."""
    got, specs = _packed(spark, sf_dir)
    caps = spark.createDataFrame([(s, int(c)) for s, c, _ in specs], "spec_id int, capacity long")
    one = got.groupBy("spec_id").agg(
        F.countDistinct("container_id").alias("n_containers"),
        F.count(F.lit(1)).alias("n_items"),
        F.countDistinct(F.when(F.col("part") > 0, F.col("doc_id"))).alias("n_split"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    unused = 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    return one.join(caps, "spec_id").select("spec_id", "n_containers", "n_items", "n_split", "n_tokens", F.round(unused, 6).alias("unused"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: each spec's documents, and how many are missing, stand twice, are split although they
    fit, or overfill a container."""
    docs = token_counts(table(spark, sf_dir, "documents"))
    specs = [(r.spec_id, r.capacity, r.lang) for r in table(spark, sf_dir, "pack_specs").select("spec_id", "capacity", "lang").toLocalIterator()]
    docs = cut(docs)
    got = cut(packed(docs, specs))
    rules = F.broadcast(spark.createDataFrame([(s, int(c), lang) for s, c, lang in specs], "spec_id int, capacity long, want string"))  # one row a spec
    sizes = docs.groupBy("doc_id").agg(F.max("n_tokens").alias("n_all"), F.max(F.lower("lang")).alias("lang"))
    parts = got.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("n_parts"))
    each = parts.join(sizes, "doc_id").join(rules, "spec_id")
    of_docs = each.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("packed") < F.col("n_all")).alias("n_cut"), F.count_if(F.col("packed") > F.col("n_all")).alias("n_repeated"),
        F.count_if(F.col("n_parts") != F.greatest(F.ceil(F.col("n_all") / F.col("capacity")), F.lit(1))).alias("n_split_wrongly"),
    )
    full = got.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(rules, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_overfull"))
    return of_docs.join(full, "spec_id").select("spec_id", "n_documents", "n_cut", "n_repeated", "n_split_wrongly", "n_overfull")


QUERIES = {"p8_pack": p8_pack, "p8_report": p8_report, "p8_checks": p8_checks}
ORACLES = {
    "p8_checks": """SELECT spec_id, count(DISTINCT doc_id) AS n_documents, 0 AS n_cut, 0 AS n_repeated, 0 AS n_split_wrongly, 0 AS n_overfull
FROM pack_specs p JOIN documents d ON p.lang IS NULL OR lower(p.lang) = lower(d.lang) GROUP BY spec_id"""
}
