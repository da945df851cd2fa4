"""Connectors as DataFrame readers over captured payloads, one per source type, all giving Items.

A reader takes a SparkSession, a SourceConfig and the window's start. Payloads lie in a folder (``options['path']``);
live fetching is left to whatever fills that folder. Readers are looked up by type; further ones register themselves.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.html import looks_paywalled, read_html
from pressloom.functions.urls import item_key, strip
from pressloom.operators.items import first_wins, term_filter, top, union, window_floor
from pressloom.operators.state import latest
from pressloom.operators.timestamps import to_utc_micros

ITEM = (
    "source string, source_type string, title string, url string, published timestamp, author string, summary string, text string, "
    "links array<string>, points long, score long, comments long, discussion string, paywalled boolean, subscription string, "
    "authenticated boolean, subreddit string, categories array<string>, page_age string, position long"
)
NAMES = [c.split()[0] for c in ITEM.split(", ")]


@dataclass
class SourceConfig:
    name: str
    type: str
    enabled: bool = True
    max_items: int | None = None
    options: dict[str, Any] = field(default_factory=dict)


Reader = Callable[[SparkSession, SourceConfig, Column], DataFrame]
_READERS: dict[str, tuple[Reader, tuple[str, ...]]] = {}


def register(kind: str, required: tuple[str, ...] = ("path",)) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        _READERS[kind] = (f, required)
        return f

    return add


def available_types() -> list[str]:
    return sorted(_READERS)


def missing_options(cfg: SourceConfig) -> list[str]:
    return [o for o in reader_of(cfg)[1] if not cfg.options.get(o)]


def reader_of(cfg: SourceConfig) -> tuple[Reader, tuple[str, ...]]:
    if cfg.type not in _READERS:
        raise ValueError(f"unknown source type {cfg.type!r}; known: {', '.join(available_types())}")
    return _READERS[cfg.type]


def limit_of(cfg: SourceConfig, default: int = 80) -> int:
    return cfg.max_items or default


def shaped(df: DataFrame, cfg: SourceConfig) -> DataFrame:
    """All Item columns, in order; missing ones null; strings stripped."""
    cols = []
    for c in ITEM.split(", "):
        name, kind = c.split(" ", 1)
        v = F.col(name) if name in df.columns else F.lit(None)
        if name == "source" and name not in df.columns:
            v = F.lit(cfg.name)
        elif name == "source_type" and name not in df.columns:
            v = F.lit(cfg.type)
        if name in ("title", "summary", "text"):
            v = strip(F.coalesce(v.cast("string"), F.lit("")))
        cols.append(v.cast(kind).alias(name))
    return df.select(*cols)


def dated(df: DataFrame, raw: str) -> DataFrame:
    """``published`` from a written date, in UTC where it names no zone."""
    got = to_utc_micros(df.withColumn("__zone", F.lit(None).cast("string")), raw, "__zone", "__us")
    return got.withColumn("published", F.timestamp_micros("__us")).drop("__zone", "__us")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)


@register("rss")
def rss(spark: SparkSession, cfg: SourceConfig, since: Column) -> DataFrame:
    """RSS items and Atom entries. Options: path, include, exclude, articles (a table of url and html), article_cache (a table
    of key, value and created: ``article:<item key>`` and the text of an earlier fetch; an empty text is a hit too)."""
    o = cfg.options
    a = _xml(spark, o["path"], "item", "title string, link string, pubDate string, description string, encoded string, author string")
    a = a.select("title", F.col("link").alias("url"), F.col("pubDate").alias("raw"), F.coalesce("description", "encoded").alias("html"), "author")
    b = _xml(
        spark, o["path"], "entry",
        "title string, link array<struct<_href: string, _rel: string>>, published string, updated string, created string, summary string, content string, author array<struct<name: string>>",
    )
    b = b.select(
        "title", F.get(F.col("link"), F.lit(0))["_href"].alias("url"), F.coalesce("published", "updated", "created").alias("raw"),
        F.coalesce("summary", "content").alias("html"), F.array_join(F.transform("author", lambda x: x["name"]), ", ").alias("author"),
    )
    both = a.unionByName(b).withColumn("position", F.monotonically_increasing_id())
    items = dated(both, "raw").withColumn("summary", F.left(read_html("html")["text"], F.lit(4000)))
    items = items.filter((strip(F.coalesce("title", F.lit(""))) != "") | (strip(F.coalesce("url", F.lit(""))) != ""))
    items = term_filter(window_floor(items, since), o.get("include"), o.get("exclude"))
    if o.get("full_text") and o.get("articles"):
        pages = spark.read.parquet(o["articles"]).select(F.col("url"), F.col("html").alias("page")).dropDuplicates(["url"])
        items = items.join(pages, "url", "left").withColumn("text", F.when(F.col("page").isNotNull(), read_html("page")["article"]))
        if o.get("article_cache"):
            known = latest(spark.read.parquet(o["article_cache"]).select("key", "value", "created")).select(F.col("key").alias("__key"), F.col("value").alias("__cached"))
            key = F.concat(F.lit("article:"), item_key(F.col("url"), F.lit(cfg.type), F.coalesce("title", F.lit(""))))
            items = items.withColumn("__key", key).join(known, "__key", "left").withColumn("text", F.coalesce("__cached", "text")).drop("__key", "__cached")
        stub = F.col("text").isNotNull() & looks_paywalled(F.col("text"))
        items = items.withColumn("paywalled", stub).withColumn("text", F.when(~stub, F.col("text")))
    return shaped(top(items, limit_of(cfg), [F.col("position")], "position_"), cfg)


@register("paywalled")
def paywalled(spark: SparkSession, cfg: SourceConfig, since: Column) -> DataFrame:
    """An rss source behind a login: full text unless switched off, and only with a login for its domain."""
    login = bool(cfg.options.get("login"))
    inner = SourceConfig(cfg.name, cfg.type, cfg.enabled, cfg.max_items, cfg.options | {"full_text": cfg.options.get("full_text", True) and login})
    return rss(spark, inner, since).withColumn("subscription", F.lit(cfg.options.get("domain") or cfg.name)).withColumn("authenticated", F.lit(login))


@register("hackernews")
def hackernews(spark: SparkSession, cfg: SourceConfig, since: Column) -> DataFrame:
    """Search replies {query_no, hits: [...]}. First of each id across queries; a query counts only while those before it gave
    fewer than the limit; ranked by points, then cut."""
    schema = "query_no long, hits array<struct<objectID: string, title: string, url: string, points: long, num_comments: long, created_at_i: long, story_text: string>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(cfg.options["path"])
    h = raw.select(F.coalesce("query_no", F.lit(0)).alias("q"), F.posexplode("hits").alias("p", "h")).select("q", "p", "h.*")
    h = h.filter((F.coalesce("objectID", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    h = h.filter((F.coalesce("points", F.lit(0)) >= cfg.options.get("min_points", 80)) & (F.timestamp_seconds("created_at_i") > since))
    h = first_wins(h, ["objectID"], [F.col("q"), F.col("p")])
    sizes = h.groupBy("q").agg(F.count(F.lit(1)).alias("n"))  # one row a query
    before = F.coalesce(F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.join(F.broadcast(sizes.withColumn("before", before).filter(F.col("before") < limit_of(cfg)).select("q")), "q", "left_semi")
    h = top(h, limit_of(cfg), [F.desc_nulls_last("points"), F.col("q"), F.col("p")], "position")
    talk = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID"))
    counts = F.format_string("%d points, %d comments on Hacker News.", F.coalesce("points", F.lit(0)), F.coalesce("num_comments", F.lit(0)))
    text = read_html("story_text")["text"]
    items = h.select(
        "title", F.coalesce(F.nullif("url", F.lit("")), talk).alias("url"), F.timestamp_seconds("created_at_i").alias("published"), "points",
        F.col("num_comments").alias("comments"), talk.alias("discussion"), F.coalesce(F.nullif(text, F.lit("")), counts).alias("summary"),
        "position",
    )
    return shaped(items, cfg)


@register("reddit")
def reddit(spark: SparkSession, cfg: SourceConfig, since: Column) -> DataFrame:
    """Listings {data: {children: [{data: ...}]}}. Cut in order of arrival, then ranked by score."""
    post = "title: string, score: long, permalink: string, num_comments: long, created_utc: double, url: string, selftext: string, subreddit: string"
    raw = spark.read.schema(f"data struct<children: array<struct<data: struct<{post}>>>>").option("multiLine", "true").json(cfg.options["path"])
    c = raw.select(F.posexplode("data.children").alias("p", "c")).select("p", "c.data.*").filter(F.col("title").isNotNull())
    c = c.withColumn("published", F.timestamp_micros((F.col("created_utc") * 1_000_000).cast("long")))
    c = window_floor(c.filter(F.coalesce("score", F.lit(0)) >= cfg.options.get("min_score", 50)), since)
    first = top(top(c, limit_of(cfg), [F.col("p")], "arrival"), limit_of(cfg), [F.desc_nulls_last("score"), F.col("p")], "position")
    counts = F.format_string("%d points, %d comments on r/%s", F.coalesce("score", F.lit(0)), F.coalesce("num_comments", F.lit(0)), "subreddit")
    talk = F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))
    items = first.select(
        F.concat(F.lit(f"{cfg.name}: r/"), F.col("subreddit")).alias("source"), "title", F.coalesce(F.nullif("url", F.lit("")), talk).alias("url"), "published",
        "score", F.col("num_comments").alias("comments"), talk.alias("discussion"), "subreddit", F.coalesce(F.nullif("selftext", F.lit("")), counts).alias("summary"),
        "position",
    )
    return shaped(items, cfg)


@register("arxiv")
def arxiv(spark: SparkSession, cfg: SourceConfig, since: Column) -> DataFrame:
    """Atom entries of the arXiv API: first five authors, abstract cut at 3000; keyword filter."""
    schema = (
        "id string, title string, summary string, published string, author array<struct<name: string>>, category array<struct<_term: string>>, "
        "link array<struct<_href: string, _rel: string>>"
    )
    e = _xml(spark, cfg.options["path"], "entry", schema).withColumn("position", F.monotonically_increasing_id())
    one = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    e = e.select(
        one("title").alias("title"), F.left(one("summary"), F.lit(3000)).alias("summary"), F.col("id").alias("url"), F.col("published").alias("raw"), "position",
        F.array_join(F.slice(F.transform("author", lambda a: a["name"]), 1, 5), ", ").alias("author"), F.transform("category", lambda c: c["_term"]).alias("categories"),
    )
    items = term_filter(window_floor(dated(e, "raw"), since), cfg.options.get("keywords"), joint=" ")
    return shaped(top(items, limit_of(cfg), [F.col("position")], "position_"), cfg)


@register("imap")
def imap(spark: SparkSession, cfg: SourceConfig, since: Column) -> DataFrame:
    """Messages as .eml files, newest (last name) first; only the last three times as many as the limit are looked at, whatever
    the filters leave of them. Options: path, senders, subject_include."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(cfg.options["path"])
    newest = files.select("path").orderBy(F.desc("path")).limit(3 * limit_of(cfg))
    files = files.select("path", "content").join(F.broadcast(newest), "path", "left_semi")
    schema = "path string, subject string, sender string, raw string, html string, plain string"

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *read_message(bytes(c))) for p, c in zip(f["path"], f["content"], strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

    m = dated(files.mapInPandas(parse, schema), "raw")
    page = read_html("html")
    m = m.withColumn("text", F.left(F.when(F.col("html") != "", page["text"]).otherwise(F.col("plain")), F.lit(60_000))).withColumn("links", page["links"])
    for col, terms in (("sender", cfg.options.get("senders")), ("subject", cfg.options.get("subject_include"))):
        if terms:
            hit = F.lit(False)
            for t in terms:
                hit = hit | F.contains(F.lower(F.col(col)), F.lit(t.lower()))
            m = m.filter(hit)
    m = window_floor(m.filter(strip(F.coalesce("text", F.lit(""))) != ""), since)
    m = top(m, limit_of(cfg), [F.desc("path")], "position")
    return shaped(
        m.select(
            F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)")).alias("title"), F.get("links", F.lit(0)).alias("url"), "published",
            F.col("sender").alias("author"), F.left("text", F.lit(600)).alias("summary"), "text", "links", "position",
        ), cfg,
    )


def read_message(raw: bytes) -> tuple[str, str, str, str, str]:
    """Subject, sender, date, all HTML parts, all plain parts (attachments are left out)."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    html, plain = [], []
    for part in m.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind in ("text/html", "text/plain"):
            try:
                (html if kind == "text/html" else plain).append(part.get_content())
            except (LookupError, UnicodeError):
                (html if kind == "text/html" else plain).append((part.get_payload(decode=True) or b"").decode("utf-8", "replace"))
    return str(m["Subject"] or ""), str(m["From"] or ""), str(m["Date"] or ""), "\n".join(html), "\n".join(plain)


@register("websearch")
def websearch(spark: SparkSession, cfg: SourceConfig, since: Column) -> DataFrame:
    """Captured search results {query_no, results: [{url, title, page_age}]}; the first of each url; allow or block domains."""
    allowed, blocked = cfg.options.get("allowed_domains"), cfg.options.get("blocked_domains")
    if allowed and blocked:
        raise ValueError("allowed_domains and blocked_domains exclude each other")
    schema = "query_no long, results array<struct<url: string, title: string, page_age: string>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(cfg.options["path"])
    r = raw.select(F.coalesce("query_no", F.lit(0)).alias("q"), F.posexplode("results").alias("p", "r")).select("q", "p", "r.*").filter(F.coalesce("url", F.lit("")) != "")
    from pressloom.functions.urls import domain, within_domain

    for ds, keep in ((allowed, True), (blocked, False)):
        if ds:
            hit = F.lit(False)
            for d in ds:
                hit = hit | within_domain(domain(F.col("url")), F.lit(d))
            r = r.filter(hit if keep else ~hit)
    r = window_floor(dated(first_wins(r, ["url"], [F.col("q"), F.col("p")]), "page_age"), since)
    return shaped(top(r, limit_of(cfg), [F.col("q"), F.col("p")], "position"), cfg)


def collect(spark: SparkSession, sources: list[SourceConfig], since: Column, check: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """All enabled sources' items with ``ord`` (source by source, in each one's order), and what went wrong by source.

    A broken source gives no items and does not stop the others. ``check`` reads each source once (its count) so that
    errors that only show at run time are told apart as well."""
    parts, errors = [], {}
    for k, cfg in enumerate(sources):
        if not cfg.enabled:
            continue
        try:
            if missing := missing_options(cfg):
                raise ValueError(f"missing options: {', '.join(missing)}")
            df = reader_of(cfg)[0](spark, cfg, since)
            if check:
                df.count()
            parts.append(df.withColumn("__k", F.lit(k)))
        except Exception as e:
            errors[cfg.name] = f"{type(e).__name__}: {str(e)[:200]}"
    if not parts:
        return spark.createDataFrame([], ITEM + ", ord long"), errors
    both = union(parts)
    return both.withColumn("ord", F.col("__k").cast("long") * F.lit(1 << 40) + F.coalesce("position", F.lit(0))).drop("__k"), errors
