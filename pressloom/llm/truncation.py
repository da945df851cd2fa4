"""Text cut off by field limits (problem 7).

Method: the length of every value is recomputed as it would be under other encodings (UTF-8 bytes, UTF-16 units), with
entity escaping, JSON escaping and newline conversion, and without a trailing mark. Grouping by source, field and each
such length exposes hidden storage limits: lengths at which far more values stand than around them. Then the endings are
inspected: of values that end without a sentence's end, or with a mark of omission, the line model tells prose from
lists, counts, headings and furniture. Both are evidence (log-odds) and are added: a limit convicts the more, the more
values stand at it, as long as they end open too (a length at which whole values gather is no limit and counts against);
where a field has limits, a value that stops elsewhere needs more evidence of its own.

The values are read once; lengths, ending and the ending's log-odds go into one narrow row a value.

Defined results: null and blank values are whole; residue (p2) is no case for text; a value whose last sentence is
complete is whole even at a limit; a last line that breaks off inside the item's own headline is cut; repeated rows give
repeated results of one (item_id, field) once.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.llm.linewise import chunks, in_chunks
from pressloom.llm.pages import FURNITURE, HEADLINE, PROSE, SAMPLE, SUBHEAD, load, residue_pages, title_words, train_pages
from pressloom.runtime import cut, salted_join, table

#: A length is a limit if at least LEAST values of a source's field stand at it, and TIMES as many as at a length nearby.
LEAST, TIMES, NEAR, SHORTEST = 6, 6.0, 12, 60
#: Log-odds of a mark of omission, at most of a limit, and of standing elsewhere where the field has limits.
MARKED, MOST, ELSEWHERE = 2.0, 3.0, -0.5
MARK = re.compile(r"\s*(?:\[(?:…|\.\.\.|\+\d+ chars)\]|\((?:…|\.\.\.|more)\)|…|\.\.\.|\b(?:read more|continue reading|weiterlesen|lire la suite|leer más|leia mais)\W*)\s*$", re.I)
WHOLE = re.compile(r"[.!?][”\"»“’'‘)\]]*$|[.!?]\s*»\s*$|[。！？]$")
COUNTS = re.compile(r"^\W*\d[\d.,]*\s*[^\W\d]+\W+(?:[^\W\d]+\W+)?\d[\d.,]*\s*[^\W\d]+")
CRUMBS = re.compile(r" [>|·»/] ")
MEASURES = ["chars", "utf8", "utf16", "html", "html_quotes", "json", "json_ascii", "crlf", "unmarked"]
VALUE = "item_id long, source string, field string, lengths array<int>, odds float"


def byte_weights() -> np.ndarray:
    """(measures but the last, 256): what each byte of UTF-8 adds to each length."""
    w = np.ones((8, 256), np.int64)
    follow = slice(0x80, 0xC0)
    w[0] = w[2] = w[3] = w[4] = w[5] = w[6] = w[7] = 1
    w[[0, 2, 3, 4, 5, 6, 7], follow] = 0
    w[2, 0xF0:] = 2
    for row in (3, 4):
        w[row, ord("&")], w[row, ord("<")], w[row, ord(">")] = 5, 4, 4
    w[4, ord('"')] = w[4, ord("'")] = 6
    for row in (5, 6):
        for c in '"\\\n\t\r':
            w[row, ord(c)] = 2
    w[6, 0xC0:], w[6, 0xF0:] = 6, 12
    w[7, ord("\n")] = 2
    return w


def lengths(values: list[str]) -> np.ndarray:
    """(values, measures): lengths of non-empty values under the representations that storage limits are set in."""
    out = np.zeros((len(values), len(MEASURES)), np.int32)
    weights = byte_weights()
    for lo, hi in chunks(values):
        data = [v.encode("utf-8", "surrogatepass") for v in values[lo:hi]]
        b = np.frombuffer(b"".join(data), np.uint8)
        starts = np.cumsum([0] + [len(x) for x in data[:-1]])
        for k in range(8):
            out[lo:hi, k] = np.add.reduceat(weights[k][b], starts)
    out[:, 8] = out[:, 0]
    for i, v in enumerate(values):
        m = MARK.search(v[-40:])
        if m:
            out[i, 8] -= len(m[0])
    return out


def is_listing(s: str) -> bool:
    """Tags, counts and the like: short pieces between separators."""
    parts = [p for p in re.split(r"[,;|·/]", s.split(":", 1)[-1] if len(s.split(":", 1)[0]) < 20 else s) if p.strip()]
    if COUNTS.match(s) and len(s) < 120:
        return True
    return len(parts) >= 2 and all(len(p.split()) <= 3 for p in parts) and sum(len(p.split()) for p in parts) <= 2.2 * len(parts)


def unfinished(end: str, bare: str, title: str | None) -> float | None:
    """None: the last line ``end`` (``bare`` without its mark) is whole, whatever the line model says. Else what speaks for a
    cut besides that model."""
    if not bare or WHOLE.search(bare[-12:]) or is_listing(bare) or CRUMBS.search(bare):
        return None
    words, own = title_words(bare), title_words(title)
    if words and own and words == own:
        return None
    if len(words) >= 2 and len(bare) >= 8 and own[: len(words) - 1] == words[:-1] and len(own) >= len(words) and own[len(words) - 1].startswith(words[-1]):
        return 30.0  # inside its own headline
    return MARKED if len(bare) < len(end) else 0.0


def value_rows(items: DataFrame, weights: np.ndarray, page_model) -> DataFrame:
    """VALUE rows of the non-blank summaries and texts; odds: log-odds of a cut by the ending alone, null for whole values."""
    data = items.sparkSession.sparkContext.broadcast(pickle.dumps((weights, page_model)))
    names = [c.split()[0] for c in VALUE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, page_model = load(data.value)
        for b in batches:
            ids, sources, titles = (b.column(k).to_pylist() for k in ("item_id", "source", "title"))
            for field in ("summary", "text"):
                got = [(k, v) for k, v in enumerate(b.column(field).to_pylist()) if v and not v.isspace()]
                if not got:
                    continue
                odds = ending_odds([v for _, v in got], [titles[k] for k, _ in got], field == "text", weights, page_model)
                at, n = lengths([v for _, v in got]), len(got)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[k] for k, _ in got], pa.int64()), pa.array([sources[k] for k, _ in got], pa.string()), pa.array([field] * n),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(MEASURES), pa.int32()), pa.array(at.ravel())), pa.array(odds, pa.float32()),
                ], names=names)

    return items.select("item_id", "source", "title", "summary", "text").mapInArrow(run, VALUE)


def ending_odds(values: list[str], titles: list[str | None], page: bool, weights: np.ndarray, page_model) -> list[float | None]:
    """Log-odds of a cut by the endings alone. ``page``: values that are residue are no case."""
    ends = [v.rstrip().rsplit("\n", 1)[-1].strip() for v in values]
    bare = [MARK.sub("", e).rstrip() if e[-1:] in "….])!»>›→ " or e[-1:].isalpha() else e for e in ends]
    base = [unfinished(e, x, t) for e, x, t in zip(ends, bare, titles, strict=True)]
    open_ = [i for i, o in enumerate(base) if o is not None]
    out: list[float | None] = [None] * len(values)
    if not open_:
        return out
    logp = np.concatenate([lines.logp(weights) for _, _, lines in in_chunks([bare[i] for i in open_])])
    odds = np.array([base[i] for i in open_]) + logp[:, PROSE] - logp[:, [HEADLINE, FURNITURE, SUBHEAD]].max(axis=1)
    if page:
        hopeful = np.flatnonzero(odds > -MOST)  # no limit could convict the others
        some = [open_[k] for k in hopeful]
        residue = residue_pages([values[i] for i in some], [titles[i] for i in some], weights, page_model)
        odds[hopeful[residue]] = np.nan
    for i, o in zip(open_, odds.tolist(), strict=True):
        out[i] = None if o != o else o
    return out


def limits(vals: DataFrame) -> DataFrame:
    """source, field, measure, length, n, n_open, evidence: hidden storage limits. The evidence grows with how many times more
    values stand at the length than nearby, and is negative where most of them end whole."""
    each = F.transform("lengths", lambda x, i: F.struct(i.alias("measure"), x.alias("length")))
    counted = (
        vals.select("source", "field", F.col("odds").isNotNull().alias("open"), F.inline(each))
        .filter(F.col("length") >= SHORTEST)
        .groupBy("source", "field", "measure", "length")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"))
    )
    around = Window.partitionBy("source", "field", "measure").orderBy("length").rangeBetween(-NEAR, NEAR)
    near = F.greatest((F.sum("n").over(around) - F.col("n")) / (2.0 * NEAR), F.lit(1.0))
    found = counted.withColumn("near", near).filter((F.col("n") >= LEAST) & (F.col("n") >= TIMES * F.col("near")))
    share = (F.col("n_open") + 1) / (F.col("n") + 2)
    return found.withColumn("evidence", (F.least(F.log(F.col("n") / F.col("near")), F.lit(MOST)) * (2 * share - 1)).cast("float")).drop("near")


def judged(vals: DataFrame, found: DataFrame) -> DataFrame:
    """item_id, source, field, odds, limit (evidence of the best limit that the value stands at, else of standing elsewhere)."""
    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), "field")
    open_ = vals.filter("odds is not null").withColumn("key", key).withColumn("uid", F.xxhash64("item_id", "source", "field", "lengths", "odds"))
    known = found.withColumn("key", key).select("key", "measure", "length", "evidence")
    each = open_.select("uid", "key", F.inline(F.transform("lengths", lambda x, i: F.struct(i.alias("measure"), x.alias("length")))))
    best = salted_join(each, known, ["key", "measure", "length"], "uid").groupBy("uid").agg(F.max("evidence").alias("best"))
    has = known.filter("evidence > 0").select("key").distinct().withColumn("has", F.lit(True))
    got = salted_join(open_, has, ["key"], "uid", "left").join(best, "uid", "left")
    limit = F.coalesce(F.col("best"), F.when(F.col("has"), F.lit(ELSEWHERE)), F.lit(0.0))
    return got.select("item_id", "source", "field", "odds", limit.alias("limit"))


def measured(items: DataFrame, bound: int = SAMPLE) -> DataFrame:
    _, weights, page_model = train_pages(items, bound)
    return cut(value_rows(items, weights, page_model))


def cut_values(items: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """item_id, field of the values of the items (item_id, source, title, summary, text) that are cut."""
    vals = measured(items, bound)
    return judged(vals, limits(vals)).filter("odds + limit > 0").select("item_id", "field").distinct()


def named(measure: Column) -> Column:
    return F.get(F.array(*map(F.lit, MEASURES)), measure)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(table(spark, sf_dir, "items"))


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of each source's fields, with the values that stand at them and those of them that end open."""
    got = limits(measured(table(spark, sf_dir, "items")))
    return got.select("source", "field", named(F.col("measure")).alias("measure"), "length", "n", "n_open", F.round("evidence", 3).alias("evidence"))


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's values, cut values and their share, by field; n_by_limit: those that only a limit convicts."""
    vals = measured(table(spark, sf_dir, "items"))
    got = judged(vals, limits(vals)).filter("odds + limit > 0").groupBy("source", "field").agg(
        F.countDistinct("item_id").alias("n_cut"), F.countDistinct(F.when(F.col("odds") <= 0, F.col("item_id"))).alias("n_by_limit")
    )
    every = vals.groupBy("source", "field").agg(F.countDistinct("item_id").alias("n_values"))
    both = every.join(got, every.source.eqNullSafe(got.source) & (every.field == got.field), "left")
    zero = lambda c: F.coalesce(got[c], F.lit(0))
    return both.select(
        every.source, every.field, "n_values", zero("n_cut").alias("n_cut"), zero("n_by_limit").alias("n_by_limit"), F.round(zero("n_cut") / F.col("n_values"), 6).alias("share")
    )


QUERIES = {"p7_found": p7_found, "p7_limits": p7_limits, "p7_sources": p7_sources}
