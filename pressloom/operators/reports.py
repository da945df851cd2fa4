"""Aggregates about sources and digests, payload projections and rendering."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.text import body, excerpt
from pressloom.operators.items import global_index

# Fixed value: display order of topics and their headings.
TOPIC_HEADINGS = {
    "models-and-releases": "Models and releases",
    "policy-and-regulation": "Policy and regulation",
    "business-and-funding": "Business and funding",
    "safety-and-alignment": "Safety and alignment",
    "compute-and-infrastructure": "Compute and infrastructure",
    "research": "Research",
    "products-and-tools": "Products and tools",
    "society-and-labor": "Society and labour",
    "other": "Everything else",
    "unclassified": "Collected stories",
}


def probe(configured: DataFrame, items: DataFrame, now: Column, window_days: int) -> DataFrame:
    """source, n_items, newest, age_days, status of each configured source: EMPTY, UNDATED, STALE or OK."""
    got = items.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.max("published").alias("newest"))
    age = F.floor((F.unix_micros(now) - F.unix_micros("newest")) / F.lit(86_400_000_000))
    status = (
        F.when(F.col("n_items") == 0, "EMPTY").when(F.col("newest").isNull(), "UNDATED").when(F.col("age_days") > window_days, "STALE").otherwise("OK")
    )
    return (
        configured.select("source").distinct().join(got, "source", "left")
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)))
        .withColumn("age_days", age.cast("long"))
        .withColumn("status", status)
    )


def subscription_health(items: DataFrame) -> DataFrame:
    """source, n_items, stubs, unfetchable and the two warnings (at least 3 and half of the items).

    ``items``: source, text, paywalled, has_login, full_text."""
    none = F.coalesce(F.trim("text"), F.lit("")) == ""
    stub = F.coalesce("paywalled", F.lit(False))
    got = items.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(stub).alias("stubs"),
        F.count_if(~stub & none & F.col("full_text")).alias("unfetchable"),
        F.bool_or("has_login").alias("has_login"),
    )
    least = F.greatest(F.lit(3), F.floor(F.col("n_items") / 2))
    return got.withColumns(
        {"login_expired": F.col("has_login") & (F.col("stubs") >= least), "refused": F.col("has_login") & (F.col("unfetchable") >= least)}
    )


def topic_sections(clusters: DataFrame) -> DataFrame:
    """section, topic, heading, ranks: clusters by topic in display order; unknown topics follow by first appearance.

    ``clusters``: topic, rank. The ranks of a topic are sorted; their number is bounded by the digest's cut."""
    known = list(TOPIC_HEADINGS)
    place = F.array_position(F.array(*map(F.lit, known)), F.col("topic"))
    got = clusters.groupBy("topic").agg(F.array_sort(F.collect_list("rank")).alias("ranks"), F.min("rank").alias("first"))
    headings = F.create_map(*(x for k, v in TOPIC_HEADINGS.items() for x in (F.lit(k), F.lit(v))))
    w = Window.orderBy(F.when(place > 0, place).otherwise(10_000), "first")
    return got.select(F.row_number().over(w).alias("section"), "topic", F.coalesce(F.try_element_at(headings, F.col("topic")), F.col("topic")).alias("heading"), "ranks")


def since(explicit: str | None, days: int, now: datetime) -> datetime:
    """Where a run's window begins: an explicit ISO date or time (UTC if it names no zone), else ``days`` before ``now``."""
    if not explicit:
        return now - timedelta(days=days)
    try:
        t = datetime.fromisoformat(explicit)
    except ValueError as e:
        raise ValueError(f"not an ISO date: {explicit!r}") from e
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def listing(items: DataFrame) -> DataFrame:
    """position, line: the items newest first (undated last, ties by ord), as date, source (28 characters) and title (90)."""
    date = F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("undated"))
    line = F.concat(date, F.lit("  "), F.rpad(F.left("source", F.lit(28)), 28, " "), F.lit("  "), F.left("title", F.lit(90)))
    got = global_index(items.select("ord", "published", line.alias("line")), [F.desc_nulls_last("published"), F.col("ord")])
    return got.select((F.col("index") + 1).alias("position"), "line")


def engagement_of(*names: str) -> Column:
    """An object of those numbers that are there, as JSON; null if none is."""
    return F.nullif(F.to_json(F.struct(*names)), F.lit("{}"))


def coverage_entry(per_item: int) -> Column:
    """What the digest's writer gets of an item: title, source, url, published, one_liner, paywalled, also_seen_in, engagement, body."""
    return F.struct(
        "title", "source", "url", F.date_format("published", "yyyy-MM-dd").alias("published"), "one_liner", F.coalesce("paywalled", F.lit(False)).alias("paywalled"),
        F.coalesce("also_seen_in", F.array().cast("array<string>")).alias("also_seen_in"), engagement_of("points", "score", "comments").alias("engagement"),
        excerpt(body(F.col("text"), F.col("summary")), per_item).alias("body"),
    )


def digest_stories(members: DataFrame, ranked: DataFrame, per_item: int) -> DataFrame:
    """rank, headline, topic, importance, coverage (in the cluster's order) of clusters already cut to the digest's size.

    ``members``: window, cluster, position and the items' columns; ``ranked``: window, cluster, importance, rank."""
    each = members.join(F.broadcast(ranked.select("window", "cluster", "rank", F.col("importance").alias("__importance"))), ["window", "cluster"])
    entry = F.struct("position", "topic", coverage_entry(per_item).alias("entry"))
    got = each.groupBy("rank").agg(F.max("__importance").alias("importance"), F.array_sort(F.collect_list(entry)).alias("e"))
    first = F.get("e", F.lit(0))
    return got.select("rank", first["entry"]["title"].alias("headline"), first["topic"].alias("topic"), "importance", F.transform("e", lambda x: x["entry"]).alias("coverage"))


def payload(stories: list[dict], newsletters: list[dict], counts: dict, sources: list[str], start: str, end: str, most: int) -> dict:
    """The writer's input."""
    return {
        "week": {"start": start, "end": end}, "requested_top_stories": most, "counts": counts, "sources": sources, "stories": stories, "newsletters": newsletters,
    }


def to_html(markdown: str, footer: str = "") -> str:
    """The digest's Markdown (headings, lists, links, bold, emphasis, paragraphs) as a self-contained page."""
    out, depth = [], 0

    def inline(t: str) -> str:
        t = html.escape(t, quote=False)
        t = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: f'<a href="{m[2].replace(chr(34), "%22")}">{m[1]}</a>', t)
        t = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", t)
        return re.sub(r"(?<!\w)_(.+?)_(?!\w)", r"<em>\1</em>", t)

    for line in markdown.split("\n"):
        item = re.match(r"( *)- (.*)", line)
        level = (len(item[1]) // 2 + 1) if item else depth if line.startswith("  ") and line.strip() else 0
        while depth > level:
            out.append("</ul>")
            depth -= 1
        while depth < level:
            out.append("<ul>")
            depth += 1
        head = re.match(r"(#{1,6}) (.*)", line)
        if item:
            out.append(f"<li>{inline(item[2])}</li>")
        elif head:
            out.append(f"<h{len(head[1])}>{inline(head[2])}</h{len(head[1])}>")
        elif line.strip():
            out.append(f"<p>{inline(line.strip())}</p>")
    out += ["</ul>"] * depth
    foot = f"<footer>{html.escape(footer, quote=False)}</footer>" if footer else ""
    return f"<!doctype html>\n<html><head><meta charset='utf-8'><style>body{{max-width:44em;margin:auto;font-family:sans-serif}}</style></head><body>{''.join(out)}{foot}</body></html>"


def write_week(spark: SparkSession, folder: str, week: str, markdown: str, footer: str = "") -> list[str]:
    """Write <week>.md and <week>.html (any file system Spark knows) and return their paths."""
    paths = []
    for kind, text in (("md", markdown), ("html", to_html(markdown, footer))):
        path = f"{folder.rstrip('/')}/{week}.{kind}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        paths.append(path)
    return paths


def shrink(measure: Callable[[int], int], start: int, limit: int = 500_000, floor: int = 800, passes: int = 4) -> int:
    """Characters per item: halved (not below ``floor``) until ``measure`` fits ``limit``, ``passes`` tries at most."""
    n = start
    for _ in range(passes - 1):
        if measure(n) <= limit:
            break
        n = max(floor, n // 2)
    return n


def render(clusters: list[dict], newsletters: list[dict], n_sources: int) -> str:
    """The digest as Markdown. Input is already cut to the digest's size and ordered."""
    link = lambda text, url: f"[{text}]({url})" if url else text
    out: list[str] = []
    top = [c for c in clusters if c["importance"] >= 4][:6]
    if top:
        out += ["## The short version", ""] + [f"- {link(c['headline'], c['url'])} ({', '.join(c['sources'][:2])})" for c in top] + [""]
    topics = list(TOPIC_HEADINGS) + [t for t in dict.fromkeys(c["topic"] for c in clusters) if t not in TOPIC_HEADINGS]
    for t in topics:
        group = [c for c in clusters if c["topic"] == t]
        if not group:
            continue
        out += [f"## {TOPIC_HEADINGS.get(t, t)}", ""]
        for c in group:
            out.append(f"- **{link(c['headline'], c['url'])}** — {', '.join(c['sources'][:3])}")
            if c.get("one_liner"):
                out.append(f"  {c['one_liner']}")
            out += [f"  - also: [{s}]({u})" for s, u in c.get("also", [])[:2] if u]
        out.append("")
    if newsletters:
        out += ["## From your newsletters", ""] + [f"- **{n['title']}** — {n['source']}, {n.get('date') or 'undated'}" for n in newsletters] + [""]
    stories = sum(c["size"] for c in clusters)
    word = lambda n, one, many: f"{n} {one if n == 1 else many}"
    out.append(f"_Coverage: {word(stories, 'story', 'stories')} from {word(n_sources, 'source', 'sources')}._")
    return "\n".join(out)


def find_json(reply: str) -> object | None:
    """The JSON value of a reply: the whole, else a fenced block, else from the first to the last brace; None if neither parses."""
    for text in [reply, *re.findall(r"```(?:json)?\s*(.*?)```", reply, re.S), reply[reply.find("{") : reply.rfind("}") + 1]]:
        try:
            return json.loads(text.strip())
        except ValueError:
            continue
    return None
