"""Deduplicating new batches against all history (problem 4).

Method: every row gives exact hashes of its normalised content - folded key, page address, title - and *paragraph*
hashes, which for a ledger of titles are hashes of the title without each choice of up to MAY_DIFFER ordinary words
(rolling polynomial hashes: each costs a few multiplications, however long the title). Rows that share a hash tell the
same story, directly or through others. The hashes live in a Spark table bucketed by hash: a batch's hashes are joined
with it bucket by bucket (history is read in its buckets and never shuffled), and then appended.

* Titles can only agree if their names and numbers do. A title is kept by the hash of those (its signature), and it has its
  paragraph hashes taken once a second title has the same signature; from then on new titles meet hashes, not titles.

* Stories that a batch joins go into a table of roots (story -> root), through which later finds are resolved.
* Which words are ordinary is counted, and the counts grow. Where a batch makes a word ordinary, the old titles with that
  word are hashed again (and no others), so that no link is lost. A link once made stays.

Defined results:
* the batch of a row is the ISO week of first_seen; where that is null or no date, the week column, however written;
  rows without either count as the last week
* ordinary words are those that titles in sentence case write mostly in lower case; names and numbers never differ
* an added source name (before or after a separator) is no part of the title
* titles of one or two words must agree in all their letters and digits; at least three words must be left in common
* blank keys, urls and titles link nothing; repeated rows (one seen_id) are one row; late rows take their week's place
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.linewise import BASE, INVERSE, mixed
from pressloom.operators.graph import components
from pressloom.runtime import cut, hot_join, remove, salted_join, scratch, small_side, table

#: Ordinary words in which two titles of one story may differ; buckets of the tables (more for more data).
MAY_DIFFER, BUCKETS = 2, 16
#: Ordinary words that go to every task; beyond that they are joined.
VOCABULARY = 50_000
#: Weeks that p4_found takes as one batch.
WEEKS = 42
#: Rows of variants of one Arrow batch.
SLICE = 100_000
# Address parameters that choose a view or track a visit, and path pieces and hosts of views and mirrors.
VIEW_PARAMS = (
    "utm_[a-z_]+|gclid|fbclid|msclkid|dclid|mc_cid|mc_eid|igshid|ref|ref_src|referrer|share|output|view|via|cmpid|amp|print|"
    "outputtype|mode|format|smid|sh|nl|te|mod|source|_ga|spm"
)
VIEW_HOSTS = "www|m|mobile|amp|wap|touch|print|edition|beta"
VIEW_HEAD, VIEW_TAIL = "print|amp|m|mobile|printable", "amp|print|index\\.html?|index\\.php|default\\.aspx|mobile|printable"


def fold(c: Column) -> Column:
    """Letters and digits alone, case ignored (problem 6's folding)."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_address(url: Column) -> Column:
    """Folded address of the page behind a url: no scheme, port, view host, view path pieces, view parameters, fragment."""
    u = F.regexp_replace(F.regexp_replace(url, r"(?U)[\s\p{Z}]+", ""), r"#.*$", "")
    escaped = F.contains(u, F.lit("%"))
    u = F.when(escaped, F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%20"))), u)).otherwise(u)

    def parts(u: Column) -> Column:
        return bind(F.regexp_extract(u, r"^[^/?]*", 0), lambda host: address(u, host))

    def address(u: Column, host: Column) -> Column:
        bare = F.regexp_replace(host, rf"^(?:(?:{VIEW_HOSTS})\.)+(?=[^.]+\.)|:\d+$", "")
        path = F.regexp_extract(u, rf"^[^/?]*(?:/(?:{VIEW_HEAD}))*(?=/|\?|$)(/[^?]*?)?/*(?:/+(?:{VIEW_TAIL}))*/*(?:\?|$)", 1)
        kept = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{VIEW_PARAMS})(?:=|$)"))
        query = F.array_join(F.array_sort(F.array_distinct(F.transform(kept, fold))), "&")
        return F.when(fold(u) != "", F.concat_ws("|", fold(bare), fold(path), query))

    return bind(F.regexp_replace(F.lower(u), r"^[a-z][a-z0-9+.-]*://", ""), parts)


def iso_week(first_seen: Column, week: Column) -> Column:
    """Year * 100 + week."""
    t = F.try_to_timestamp(first_seen)
    seen = F.extract(F.lit("YEAROFWEEK"), t) * 100 + F.extract(F.lit("WEEK"), t)
    y, w = (F.regexp_extract(week, r"(\d{4})\s*-?\s*[Ww]\s*(\d{1,2})", i) for i in (1, 2))
    written = F.when(y != "", y.cast("int") * 100 + F.when(w != "", w).cast("int"))
    return F.coalesce(seen, written, F.lit(999_999)).cast("int")


def bare_titles(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Append ``bare``: the title, white space tidied, without a source name put before or after it."""
    names = small_side(sources.select(fold(F.col("source")).alias("__name")).filter("__name <> ''").distinct())
    t = F.trim(F.regexp_replace("title", r"(?U)[\s\p{Z}\p{Cf}]+", " "))
    sep = r"\s?(?:[|–—·•»]|::|\s-\s|\s/\s|:\s)\s?"
    cut_at = rows.withColumn("__t", t).withColumns(
        {
            "__front": F.regexp_extract("__t", rf"^(.+){sep}(.+?)$", 1),
            "__end": fold(F.regexp_extract("__t", rf"^(.+){sep}(.+?)$", 2)),
            "__start": fold(F.regexp_extract("__t", rf"^(.+?){sep}(.+)$", 1)),
            "__back": F.regexp_extract("__t", rf"^(.+?){sep}(.+)$", 2),
        }
    )
    ends = names.withColumnRenamed("__name", "__end").withColumn("__is_end", F.lit(True))
    begins = names.withColumnRenamed("__name", "__start").withColumn("__is_start", F.lit(True))
    got = cut_at.join(ends, "__end", "left").join(begins, "__start", "left")
    bare = F.when(F.col("__is_end"), F.col("__front")).when(F.col("__is_start"), F.col("__back")).otherwise(F.col("__t"))
    return got.withColumn("bare", bare).select(*rows.columns, "bare")


WORDS = r"([\p{L}\p{N}]+)"


def word_counts(bare: DataFrame) -> DataFrame:
    """word, low, all: occurrences after the first word of the different titles (bare) in sentence case, in lower case and in any."""
    ws = F.regexp_extract_all("bare", F.lit(WORDS), 1)
    rest = F.slice(ws, F.lit(2), F.size(ws))
    capital = F.size(F.filter(rest, lambda w: w.rlike(r"^\p{Lu}")))
    lower = F.size(F.filter(rest, lambda w: w.rlike(r"^\p{Ll}")))
    some = bare.select("bare").distinct().filter((capital > 0) & (lower * 10 >= capital * 4))
    return (
        some.select(F.explode(rest).alias("w"))
        .groupBy(F.lower("w").alias("word"))
        .agg(F.count_if(F.col("w").rlike(r"^\p{Ll}")).alias("low"), F.count(F.lit(1)).alias("all"))
    )


def is_ordinary(low: Column, total: Column) -> Column:
    return F.coalesce(low * 2 > total, F.lit(False))


@functools.lru_cache(200_000)
def word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


def variant_hashes(ws: list[str], free: list[int]) -> Iterator[np.ndarray]:
    """Hashes of the words without each choice of up to MAY_DIFFER of those at ``free``, as long as three words and more than
    were taken out are left: a polynomial over the words, of which parts shift down by one or two places."""
    n = len(ws)
    if n < 3:
        return
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, np.uint64(BASE))])
        a = np.r_[np.uint64(0), np.cumsum(np.array([word_hash(w) for w in ws], np.uint64) * up)]
        one, two, total = np.uint64(INVERSE), np.uint64(INVERSE * INVERSE % 2**64), a[n]
        yield mixed(np.array([total]), n)
        f = np.array(free, np.int64)
        if n >= 4 and len(f):
            yield mixed(a[f] + (total - a[f + 1]) * one, n - 1)
        if n >= 5:
            for k in range(len(f) - 1):
                i, j = f[k], f[k + 1 :]
                yield mixed(a[i] + (a[j] - a[i + 1]) * one + (total - a[j + 1]) * two, n - 2)


def variants(titles: DataFrame) -> DataFrame:
    """node, h of titles (node, ws, free: positions of ordinary words). A long title's hashes are handed on in slices."""

    def batch(nodes: list, hashes: list) -> pa.RecordBatch:
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        ids = np.repeat(np.array(nodes, np.int64), [len(x) for x in hashes])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64))], names=["node", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, hashes, size = [], [], 0
        for b in batches:
            for node, ws, free in zip(*(b.column(k).to_pylist() for k in ("node", "ws", "free")), strict=True):
                for h in variant_hashes(ws, free):
                    nodes.append(node)
                    hashes.append(h)
                    size += len(h)
                    if size >= SLICE:
                        yield batch(nodes, hashes)
                        nodes, hashes, size = [], [], 0
        yield batch(nodes, hashes)

    return titles.select("node", "ws", "free").mapInArrow(run, "node long, h long")


def signed(titles: DataFrame, ordinary: DataFrame) -> DataFrame:
    """t, node, ws, free, sig of titles (t, node, ws): places of ordinary words, and the hash of all others. ``ordinary``: word.
    At most VOCABULARY words (counted) go to the tasks, more are joined."""
    known = ordinary.limit(VOCABULARY + 1).collect()
    if len(known) <= VOCABULARY:
        words = titles.sparkSession.sparkContext.broadcast(frozenset(r.word for r in known))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free = words.value
            for b in batches:
                at = [[i for i, w in enumerate(ws or ()) if w in free] for ws in b.column("ws").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("t"), b.column("node"), b.column("ws"), pa.array(at, pa.list_(pa.int32()))], names=["t", "node", "ws", "free"])

        got = titles.select("t", "node", "ws").mapInArrow(mark, "t long, node long, ws array<string>, free array<int>")
    else:
        each = titles.select("t", F.posexplode("ws").alias("pos", "word"))
        each = salted_join(each, ordinary, ["word"], "t", "left_semi")
        places = each.groupBy("t").agg(F.array_sort(F.collect_list("pos")).alias("free"))
        got = titles.select("t", "node", "ws").join(places, "t", "left").withColumn("free", F.coalesce("free", F.array().cast("array<int>")))
    names = F.filter("ws", lambda w, i: ~F.array_contains("free", i))
    return got.withColumn("sig", F.xxhash64(F.array_join(names, " ")))


def prepared(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """node, seen_id, week_no, bare, ws, k, u, t: one line per row with its exact hashes (null: nothing to compare)."""
    h = lambda kind, c: F.when(c != "", F.xxhash64(F.lit(kind), c))
    return bare_titles(rows, sources).select(
        F.xxhash64(F.lit("r"), "seen_id").alias("node"), F.col("seen_id").cast("long").alias("seen_id"), iso_week(F.col("first_seen"), F.col("week")).alias("week_no"),
        "bare", F.regexp_extract_all(F.lower("bare"), F.lit(WORDS), 1).alias("ws"),
        h("k", fold(F.col("key"))).alias("k"), h("u", page_address(F.col("url"))).alias("u"), h("t", fold(F.col("bare"))).alias("t"),
    )


def pairs(told: DataFrame) -> DataFrame:
    """seen_id_a, seen_id_b of rows (seen_id, week_no, story): each story's first row with each row of a later week."""
    firsts = told.groupBy("story").agg(
        F.min(F.struct("week_no", "seen_id")).alias("first"), F.max("week_no").alias("last")
    ).filter("first.week_no < last").select("story", "first")
    got = salted_join(told, firsts, ["story"], "seen_id")
    return (
        got.filter("week_no > first.week_no and seen_id <> first.seen_id")
        .select(F.least("seen_id", "first.seen_id").alias("seen_id_a"), F.greatest("seen_id", "first.seen_id").alias("seen_id_b"))
        .distinct()
    )


class History:
    """The accepted rows as Spark tables bucketed by their key, under ``path``; a batch appends and rewrites nothing.

    hashes(h, story); roots(story, root): stories that later batches joined to others; firsts(story, week_no, seen_id): least
    counts; titles(sig, t, ws, free, story); words(word, low, all): counts that tell ordinary words. An existing ``path`` is opened.
    """

    TABLES = {
        "hashes": ("h", "h long, story long"), "roots": ("story", "story long, root long"), "firsts": ("story", "story long, week_no int, seen_id long"),
        "titles": ("sig", "sig long, t long, ws array<string>, free array<int>, story long"), "words": ("word", "word string, low long, total long"),
    }

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch(spark, "history")
        self.name = f"history_{uuid.uuid4().hex}"
        for t, (key, schema) in self.TABLES.items():
            spark.sql(f"CREATE TABLE {self.name}_{t} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{t}'")
        self.empty = path is None or self._read("hashes").isEmpty()
        self.merged = path is not None and not self._read("roots").isEmpty()

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        key, schema = self.TABLES[name]
        rows.select(*(c.split()[0] for c in schema.split(", "))).repartition(self.buckets, key).write.insertInto(f"{self.name}_{name}")

    def close(self, delete: bool = False) -> None:
        for t in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{t}")
        if delete:
            remove(self.spark, self.path)

    def learn(self, rows: DataFrame, sources: DataFrame) -> None:
        """Count the words of further titles beforehand (rows to be added with ``counted`` true)."""
        self._append("words", word_counts(bare_titles(rows, sources).filter("bare is not null")).withColumnRenamed("all", "total"))

    def resolve(self, stories: DataFrame) -> DataFrame:
        """story, root of distinct stories, through all roots."""
        got = stories.select("story", F.col("story").alias("root"))
        while self.merged:
            step = self._read("roots").groupBy("story").agg(F.min("root").alias("next")).withColumnRenamed("story", "root")
            got = cut(got.join(step, "root", "left").select("story", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            again = not got.filter("moved").isEmpty()
            got = got.select("story", "root")
            if not again:
                break
        return got

    def _ordinary(self, words: DataFrame, fresh: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The ordinary ones of ``words``; and those that ``fresh`` counts make so though history knew them otherwise."""
        old = self._read("words").join(words, "word", "left_semi")
        old = old.groupBy("word").agg(F.sum("low").alias("low"), F.sum("total").alias("total"))
        if fresh is None:
            return old.filter(is_ordinary(F.col("low"), F.col("total"))).select("word"), None
        new = words.join(fresh.select("word", F.col("low").alias("low_new"), F.col("all").alias("total_new")), "word", "left").join(old, "word", "left")
        n = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        now = is_ordinary(n("low_new", "low"), n("total_new", "total"))
        state = cut(new.select("word", now.alias("now"), is_ordinary(F.col("low"), F.col("total")).alias("before")))
        return state.filter("now").select("word"), state.filter("now and not before").select("word")

    def _turned(self, changed: DataFrame) -> DataFrame | None:
        """t, ws, story of old titles that hold a word that has turned ordinary."""
        if self.empty or changed.isEmpty():
            return None
        each = self._read("titles").select("t", F.explode("ws").alias("word"))
        holds = salted_join(each, changed, ["word"], "t", "left_semi").select("t").distinct()
        return cut(self._read("titles").join(holds, "t", "left_semi").groupBy("t").agg(F.min(F.struct("ws", "story")).alias("x")).select("t", "x.ws", "x.story"))

    def _rooted(self, titles: DataFrame) -> DataFrame:
        """``titles`` (.., story) with ``node``, the story's root."""
        return hot_join(titles, cut(self.resolve(titles.select("story").distinct())), "story", "inner").withColumn("node", F.col("root")).drop("story", "root")

    def add(self, batch: DataFrame, sources: DataFrame, counted: bool = False) -> DataFrame:
        """Check ``batch`` (seen_id, key, url, title, first_seen, week) against history, append it, and return (seen_id, week_no,
        story, first_week, first_id): of each row its story and that story's first row, history included."""
        p = cut(prepared(batch, sources))
        titles = cut(p.filter("t is not null and size(ws) > 0").groupBy("t").agg(F.min(F.struct("node", "ws")).alias("x")).select("t", "x.node", "x.ws"))
        fresh = None if counted else cut(word_counts(p.filter("bare is not null")))
        words = titles.select(F.explode("ws").alias("word"))
        words = (words if fresh is None else words.unionByName(fresh.select("word"))).distinct()
        ordinary, changed = self._ordinary(words, fresh)
        mine = signed(titles, ordinary)
        turned = self._turned(changed) if changed is not None else None
        if turned is not None:  # their other words need not stand in the batch
            ordinary, _ = self._ordinary(turned.select(F.explode("ws").alias("word")).distinct(), None)
            mine = mine.unionByName(signed(self._rooted(turned).select("t", "node", "ws"), ordinary.unionByName(changed).distinct()))
        mine = cut(mine)
        # signatures of several titles; where history has just one of them, that one's hashes are taken now
        own = mine.groupBy("sig").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        if self.empty:
            several, spread = own.filter("lo < hi").select("sig"), None
        else:
            kept = self._read("titles").join(own.select("sig"), "sig", "left_semi")
            kept = kept.groupBy("sig").agg(F.min(F.struct("t", "ws", "free", "story")).alias("x"), F.max("t").alias("top"))
            both = cut(own.join(kept, "sig", "left").filter("lo < hi or x.t <> lo or top <> lo"))
            several = both.select("sig")
            spread = self._rooted(both.filter("x.t = top").select("x.t", "x.ws", "x.free", "x.story")).select("node", "ws", "free")
        expand = salted_join(mine, several, ["sig"], "t").select("node", "ws", "free")
        exact = p.select("node", F.explode(F.array("k", "u", "t")).alias("h")).filter("h is not null")
        inc = cut(exact.unionByName(variants(expand if spread is None else expand.unionByName(spread))))
        shared = inc.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("z"))
        if self.empty:
            live, old = shared.filter("a < z").select("h", "a"), None
        else:
            shared = cut(shared)
            found = cut(self._read("hashes").join(shared.select("h"), "h").select("h", "story").distinct())
            old = cut(self._rooted(found).select("h", F.col("node").alias("story")).distinct())
            held = old.select("h").distinct().withColumn("held", F.lit(True))
            live = shared.join(held, "h", "left").filter("a < z or held").select("h", "a")
        # a star around the first member of each shared hash, and one edge from there to each story that holds the hash
        edges = salted_join(inc, live, ["h"], "node").filter("node <> a").select(F.col("node").alias("a"), F.col("a").alias("b"))
        if old is not None:
            edges = edges.unionByName(old.join(shared.select("h", F.col("a").alias("b")), "h").select(F.col("story").alias("a"), "b"))
        parts = components(edges)
        told = p.select("node", "seen_id", "week_no").distinct().join(parts, "node", "left")
        if old is None:
            told = cut(told.select("node", "seen_id", "week_no", F.coalesce("component", "node").alias("story")))
            known, stands, new_hashes = told.select("story", "week_no", "seen_id"), told.select("node", "story"), inc
        else:
            # old stories among the nodes: by hash, and those whose titles were hashed now
            olds = old.select("story").unionByName(inc.select(F.col("node").alias("story")).join(p.select(F.col("node").alias("story")), "story", "left_anti")).distinct()
            before = cut(olds.join(parts.withColumnRenamed("node", "story"), "story", "left").withColumn("component", F.coalesce("component", "story")))
            canon = before.groupBy("component").agg(F.min("story").alias("canon"))
            merges = cut(before.join(canon, "component").select("story", F.col("canon").alias("root")))
            told = cut(salted_join(told, canon, ["component"], "node", "left").select("node", "seen_id", "week_no", F.coalesce("canon", "component", "node").alias("story")))
            firsts = self._read("firsts").join(merges, "story").select(F.col("root").alias("story"), "week_no", "seen_id")
            known = told.select("story", "week_no", "seen_id").unionByName(firsts)
            joined = merges.filter("story <> root")
            if not joined.isEmpty():
                self._append("roots", joined)
                self.merged = True
            stands = told.select("node", "story").unionByName(merges.select(F.col("story").alias("node"), F.col("root").alias("story"))).distinct()
            new_hashes = salted_join(inc, old.select("h").distinct(), ["h"], "node", "left_anti")
        first = cut(known.groupBy("story").agg(F.min(F.struct("week_no", "seen_id")).alias("x")).select("story", "x.week_no", "x.seen_id"))
        out = salted_join(told, first.select("story", F.col("week_no").alias("first_week"), F.col("seen_id").alias("first_id")), ["story"], "node")
        out = cut(out.select("seen_id", "week_no", "story", "first_week", "first_id"))
        self._append("hashes", new_hashes.join(stands, "node").select("h", "story").distinct())
        self._append("firsts", first)
        self._append("titles", mine.join(stands, "node"))
        if fresh is not None:
            self._append("words", fresh.withColumnRenamed("all", "total"))
        self.empty = False
        return out


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "seen_items").select("seen_id", "key", "url", "title", "first_seen", "week")
    return rows, table(spark, sf_dir, "sources").select("source")


def told_in_batches(rows: DataFrame, sources: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """seen_id, week_no, story of all rows, fed to a history week by week in order, ``weeks`` at once. Words are counted over all
    rows beforehand. Undated rows are the last batch."""
    spark = rows.sparkSession
    dated = cut(rows.withColumn("__week", iso_week(F.col("first_seen"), F.col("week"))))
    known = [r[0] for r in dated.select("__week").distinct().orderBy("__week").collect()]  # one number a calendar week
    state = History(spark)
    state.learn(rows, sources)
    parts = []
    for lo in range(0, len(known), weeks):
        some = dated.filter(F.col("__week").between(known[lo], known[min(lo + weeks, len(known)) - 1])).drop("__week")
        parts.append(state.add(some, sources, counted=True).select("seen_id", "week_no", "story"))
    if not parts:
        return spark.createDataFrame([], "seen_id long, week_no int, story long")
    every = functools.reduce(DataFrame.unionByName, parts)
    if state.merged:
        every = cut(salted_join(every, state.resolve(every.select("story").distinct()), ["story"], "seen_id").select("seen_id", "week_no", F.col("root").alias("story")))
    state.close(delete=True)
    return every


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(told_in_batches(*_rows(spark, sf_dir)))


def p4_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest week, with the rows without any week, as a batch against all earlier weeks: every row of the batch, the
    story's first row where an earlier week holds it (else null), and whether the row is undated."""
    rows, sources = _rows(spark, sf_dir)
    dated = cut(rows.withColumn("__week", iso_week(F.col("first_seen"), F.col("week"))))
    last = dated.filter("__week < 999999").agg(F.max("__week")).first()[0] or 0  # one number
    state = History(spark)
    state.add(dated.filter(F.col("__week") < last).drop("__week"), sources)
    got = state.add(dated.filter(F.col("__week") >= last).drop("__week"), sources)
    state.close(delete=True)
    return got.select("seen_id", F.when(F.col("first_week") < F.col("week_no"), F.col("first_id")).alias("first_id"), (F.col("week_no") == 999_999).alias("undated"))


QUERIES = {"p4_found": p4_found, "p4_batch": p4_batch}
