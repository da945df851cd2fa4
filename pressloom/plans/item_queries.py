"""Queries over items, verdicts, the ledger and sources, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import scoring, text, urls
from pressloom.functions.html import PAYWALL, looks_paywalled
from pressloom.operators import cluster, items as ops, reports, state
from pressloom.plans.timestamp_queries import p1_found as found
from pressloom.runtime import cut, small_side, table

#: The reports' fixed present.
NOW = "2026-06-30 00:00:00"
LX = scoring.Lexicon()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


def item_view(spark: SparkSession, d: str) -> DataFrame:
    """The items as Items: ord is item_id; published is the time of fetching, which SQL can read too (``dated_view`` has p1's dates)."""
    number = lambda k: F.get_json_object("extra", f"$.{k}").try_cast("long").alias(k)
    return table(spark, d, "items").select(
        F.col("item_id").alias("ord"), "source", "source_type", text.tidy(F.col("title")).alias("title"), "url", F.col("fetched_at").cast("timestamp").alias("published"),
        text.tidy(F.col("summary")).alias("summary"), text.tidy(F.col("text")).alias("text"), number("points"), number("score"), number("comments"),
        (F.get_json_object("extra", "$.paywalled") == "true").alias("paywalled"), (F.get_json_object("extra", "$.authenticated") == "true").alias("authenticated"),
    )


def dated_view(spark: SparkSession, d: str) -> DataFrame:
    """The item view with the dates that the feeds wrote, as p1 normalises them; items without a readable one are undated."""
    written = found(spark, d).filter("field = 'published'").select(F.col("item_id").alias("ord"), F.timestamp_micros("utc_us").alias("published"))
    return item_view(spark, d).drop("published").join(written, "ord", "left")


_TRIM = r"regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_TRACKING = f"regexp_matches(n, '(?i)^(?:{urls.TRACKING})$')"
_ENC = "replace(url_encode({0}), '%20', '+')"
_DEC = "url_decode(replace({0}, '+', ' '))"
#: items as the item view, in SQL: with the parts of the url and its normal form
V = rf"""
WITH i AS (
  SELECT item_id AS ord, source, source_type, {_TRIM.format('title')} AS title, url, fetched_at AS published, {_TRIM.format('summary')} AS summary, {_TRIM.format('text')} AS text,
    try_cast(json_extract_string(extra, '$.points') AS BIGINT) AS points, try_cast(json_extract_string(extra, '$.score') AS BIGINT) AS score, try_cast(json_extract_string(extra, '$.comments') AS BIGINT) AS comments,
    coalesce(json_extract_string(extra, '$.paywalled') = 'true', false) AS paywalled, coalesce(json_extract_string(extra, '$.authenticated') = 'true', false) AS authenticated,
    regexp_extract({_TRIM.format('url')}, '(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['scheme', 'authority', 'path', 'query']) AS u
  FROM items
), p AS (
  SELECT *, regexp_replace(lower(u.authority), '^www\.', '') AS host,
    list_filter(string_split(coalesce(u.query, ''), '&'), lambda x: x <> '') AS ps
  FROM i
), v AS (
  SELECT * EXCLUDE (u, ps), coalesce(host, '') AS domain,
    CASE WHEN url IS NULL OR url = '' THEN '' WHEN u.scheme = '' AND u.authority = '' THEN {_TRIM.format('url')}
    ELSE (CASE WHEN lower(u.scheme) IN ('http', 'https') THEN 'https:' WHEN u.scheme <> '' THEN lower(u.scheme) || ':' ELSE '' END)
      || (CASE WHEN host <> '' THEN '//' || regexp_replace(regexp_replace(host, ':80$', ''), ':443$', '') ELSE '' END)
      || coalesce(nullif(regexp_replace(u.path, '/+$', ''), ''), '/')
      || coalesce('?' || nullif(list_aggregate(list_transform(
          list_filter(ps, lambda x: NOT regexp_matches({_DEC.format("regexp_extract(x, '^([^=]*)', 1)")}, '(?i)^(?:{urls.TRACKING})$')),
          lambda x: {_ENC.format(_DEC.format("regexp_extract(x, '^([^=]*)', 1)"))} || '=' || {_ENC.format(_DEC.format("regexp_extract(x, '=(.*)$', 1)"))}), 'string_agg', '&'), ''), '')
    END AS url_norm,
    list_transform(ps, lambda x: {_DEC.format("regexp_extract(x, '^([^=]*)', 1)")}) AS names
  FROM p
), k AS (
  SELECT *, left(sha1(CASE WHEN url_norm <> '' THEN url_norm ELSE source_type || ':' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) END), 16) AS key,
    CASE WHEN text <> '' THEN text ELSE summary END AS body
  FROM v
)"""


# ---- addresses and identities -------------------------------------------------------------------------------------


@query(V + " SELECT ord, url_norm FROM k")
def url_normalize(spark, d):
    return item_view(spark, d).select("ord", urls.normalize_url(F.col("url")).alias("url_norm"))


@query(V + " SELECT ord, key FROM k")
def item_key(spark, d):
    return ops.keyed(item_view(spark, d)).select("ord", "key")


@query(V + " SELECT domain, count(*) AS n FROM k GROUP BY domain")
def url_domain(spark, d):
    return item_view(spark, d).groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(V + f" SELECT n AS name, count(*) AS n_urls FROM (SELECT unnest(names) AS n FROM k) WHERE {_TRACKING} GROUP BY n")
def tracking_params(spark, d):
    names = item_view(spark, d).select(F.explode(urls.params(urls.part(F.coalesce("url", F.lit("")), 4))).alias("p")).select(F.col("p.name").alias("name"))
    return names.filter(urls.is_tracking(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("n_urls"))


@query(V + " SELECT source, count(DISTINCT url_norm) AS n_urls FROM k WHERE url_norm <> '' GROUP BY source")
def coverage_urls(spark, d):
    n = item_view(spark, d).select("source", urls.normalize_url(F.col("url")).alias("u")).filter("u <> ''")
    return n.groupBy("source").agg(F.countDistinct("u").alias("n_urls"))


@query(V + " SELECT s.source, count(*) AS n_items, count(*) FILTER (WHERE k.domain = s.domain OR ends_with(k.domain, '.' || s.domain)) AS n_within FROM k JOIN sources s USING (source) WHERE k.domain <> '' GROUP BY s.source")
def domain_scope(spark, d):
    """Items of each source, and those whose host is the source's domain or within it."""
    i = item_view(spark, d).select("source", urls.domain(F.col("url")).alias("host")).filter("host <> ''")
    s = small_side(table(spark, d, "sources").select("source", "domain"))
    return i.join(s, "source").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(urls.within_domain(F.col("host"), F.col("domain"))).alias("n_within")
    )


# ---- filters, ranks, caps -----------------------------------------------------------------------------------------


@query(V + " SELECT ord FROM k WHERE published IS NULL OR published >= TIMESTAMP '2026-01-01'")
def window_floor(spark, d):
    return ops.window_floor(item_view(spark, d), F.lit("2026-01-01").cast("timestamp")).select("ord")


@query(V + r""" SELECT ord FROM k WHERE (contains(lower(title || chr(10) || summary), 'model') OR contains(lower(title || chr(10) || summary), 'chip'))
  AND NOT contains(lower(title || chr(10) || summary), 'doubts')""")
def include_exclude(spark, d):
    return ops.term_filter(item_view(spark, d), ["model", "chip"], ["doubts"]).select("ord")


@query(V + " SELECT ord FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 80")
def cap_per_source(spark, d):
    return ops.cap(item_view(spark, d), ["source"], 80, [F.col("ord")]).select("ord")


@query(V + " SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY points DESC NULLS LAST, ord) AS rank FROM k WHERE source_type = 'hackernews' QUALIFY rank <= 30")
def hn_sort_then_cut(spark, d):
    some = item_view(spark, d).filter("source_type = 'hackernews'")
    return ops.sort_then_cut(some, ["source"], 30, "points").select("source", "ord", "rank")


@query(V + """, c AS (SELECT * FROM k WHERE source_type = 'reddit' AND coalesce(score, 0) >= 50 QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 30)
SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, ord) AS rank FROM c""")
def reddit_cut_then_sort(spark, d):
    some = item_view(spark, d).filter("source_type = 'reddit' AND coalesce(score, 0) >= 50")
    return ops.cut_then_sort(some, ["source"], 30, "score").select("source", "ord", "rank")


@query(V + " SELECT source, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS slug, min(ord) AS ord FROM k GROUP BY 1, 2")
def first_wins(spark, d):
    i = item_view(spark, d).select("source", urls.slug(F.col("title")).alias("slug"), "ord")
    return ops.first_wins(i, ["source", "slug"], [F.col("ord")])


@query(V + " SELECT ord, (row_number() OVER (ORDER BY published DESC NULLS LAST, ord) - 1) // 40 AS batch, (row_number() OVER (ORDER BY published DESC NULLS LAST, ord) - 1) % 40 AS index_in_batch FROM k")
def triage_batches(spark, d):
    i = item_view(spark, d).select("ord", "published")
    return ops.batches(i, 40, [F.desc_nulls_last("published"), F.col("ord")]).select("ord", "batch", "index_in_batch")


@query(V + " SELECT ord, row_number() OVER (ORDER BY published DESC NULLS LAST, ord) AS rank FROM k WHERE source_type = 'imap'")
def newsletter_lane(spark, d):
    own = ops.lanes(item_view(spark, d).select("ord", "source_type", "published"))[1]
    return ops.global_index(own, [F.desc_nulls_last("published"), F.col("ord")]).select("ord", (F.col("index") + 1).alias("rank"))


# ---- duplicates and history ---------------------------------------------------------------------------------------


@query(V + """, w AS (SELECT *, length(body) AS len, row_number() OVER (PARTITION BY key ORDER BY length(body) DESC, ord) AS r FROM k)
SELECT key, max(ord) FILTER (r = 1) AS ord, max(source) FILTER (r = 1) AS source, max(len) FILTER (r = 1) AS len, min(ord) AS first_ord, count(*) AS n,
  list_sort(list_filter(list(DISTINCT source), lambda x: x <> max(source) FILTER (r = 1))) AS also_seen_in FROM w GROUP BY key""".replace("list_sort(list_filter(list(DISTINCT source), lambda x: x <> max(source) FILTER (r = 1)))", "list_sort(list(DISTINCT source))").replace("SELECT key,", "SELECT * EXCLUDE (also_seen_in), list_filter(also_seen_in, lambda x: x <> source) AS also_seen_in FROM (SELECT key,") + ")")
def dedupe_richest(spark, d):
    return ops.dedupe_sets(item_view(spark, d))


#: The sequential fold of each key's copies: longer bodies take over, lists restart with the former winner, dates are kept.
FOLD = """, o AS (SELECT key, ord, coalesce(source, '') AS source, published, length(body) AS len, row_number() OVER (PARTITION BY key ORDER BY ord) AS r FROM k),
fold(key, r, ord, source, published, len, also) AS (
  SELECT key, r, ord, source, published, len, []::VARCHAR[] FROM o WHERE r = 1
  UNION ALL SELECT o.key, o.r, CASE WHEN o.len > f.len THEN o.ord ELSE f.ord END, CASE WHEN o.len > f.len THEN o.source ELSE f.source END,
    CASE WHEN o.len > f.len THEN coalesce(o.published, f.published) ELSE coalesce(f.published, o.published) END, greatest(o.len, f.len),
    CASE WHEN o.len > f.len THEN list_filter(list_concat(CASE WHEN list_contains(f.also, f.source) THEN [] ELSE [f.source] END, f.also), lambda x: x <> o.source)
      WHEN o.source = f.source OR list_contains(f.also, o.source) THEN f.also ELSE list_append(f.also, o.source) END
  FROM fold f JOIN o ON o.key = f.key AND o.r = f.r + 1
), folded AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1)"""
VR = V.replace("WITH i AS", "WITH RECURSIVE i AS")


@query(VR + FOLD + " SELECT key, ord, source, epoch_us(published) AS published_us, also AS also_seen_in FROM folded")
def dedupe_ordered(spark, d):
    """Order-exact provenance and date backfill (a sequential fold)."""
    got = ops.dedupe_ordered(item_view(spark, d))
    return got.select("key", "ord", "source", F.unix_micros("published").alias("published_us"), "also_seen_in")


LEDGER_SQL = "ledger AS (SELECT seen_id, regexp_replace(lower(key), '[^0-9a-z]', '', 'g') AS key, url, title, source, first_seen, week FROM seen_items)"


def ledger_view(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seen_items").withColumn("key", F.regexp_replace(F.lower("key"), "[^0-9a-z]", ""))


@query(V + f", {LEDGER_SQL} SELECT ord FROM k WHERE key NOT IN (SELECT key FROM ledger WHERE key IS NOT NULL)")
def drop_seen(spark, d):
    return ops.drop_seen(item_view(spark, d), ledger_view(spark, d)).select("ord")


@query(V + f", {LEDGER_SQL} SELECT ord FROM k WHERE key IN (SELECT key FROM ledger)")
def seen_lookup(spark, d):
    return ops.seen(item_view(spark, d), ledger_view(spark, d)).select("ord")


@query(f"""WITH {LEDGER_SQL} SELECT key, min(seen_id) AS seen_id FROM ledger WHERE key <> '' AND first_seen >= '2026-01-01'
  AND key NOT IN (SELECT key FROM ledger WHERE key IS NOT NULL AND first_seen < '2026-01-01') GROUP BY key""")
def ledger_insert_ignore(spark, d):
    """The rows of 2026 put into a ledger that holds all earlier ones."""
    rows = ledger_view(spark, d).filter("key <> ''").select("key", "seen_id", "first_seen")
    new = state.insert_or_ignore(rows.filter("first_seen < '2026-01-01'"), rows.filter("first_seen >= '2026-01-01'"), [F.col("seen_id")])
    return new.select("key", "seen_id")


LATEST_SQL = """latest AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY judged_at DESC NULLS LAST, coalesce(importance, -1) DESC, coalesce(topic, '') DESC,
  coalesce(CAST(ai_related AS INT), -1) DESC, coalesce(one_liner, '') DESC) = 1)"""


def latest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verdicts").withColumn("judged_at", F.col("judged_at").cast("timestamp"))
    v = v.withColumn("tie", F.struct(F.coalesce("importance", F.lit(-1)), F.coalesce("topic", F.lit("")), F.coalesce(F.col("ai_related").cast("int"), F.lit(-1)), F.coalesce("one_liner", F.lit(""))))
    return state.latest(v, "item_id", "judged_at", "tie").drop("tie")


@query(f"WITH {LATEST_SQL} SELECT item_id, ai_related, importance, topic, one_liner FROM latest")
def cache_latest(spark, d):
    return latest_verdicts(spark, d).select("item_id", "ai_related", "importance", "topic", "one_liner")


@query(f"WITH {LATEST_SQL} SELECT i.item_id, coalesce(l.judged_at >= TIMESTAMP '{NOW}' - INTERVAL 180 DAY AND l.ai_related IS NOT NULL AND l.importance IS NOT NULL, false) AS hit FROM items i LEFT JOIN latest l USING (item_id)")
def cache_probe(spark, d):
    cache = latest_verdicts(spark, d).withColumnsRenamed({"item_id": "key", "judged_at": "created"})
    valid = F.col("ai_related").isNotNull() & F.col("importance").isNotNull()
    i = table(spark, d, "items").select(F.col("item_id").alias("key"))
    return state.probe(i, cache, now(), 180, valid).select(F.col("key").alias("item_id"), "hit")


@query(f"SELECT seen_id FROM seen_items WHERE CAST(first_seen AS TIMESTAMPTZ) >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 180 DAY")
def purge(spark, d):
    rows = table(spark, d, "seen_items").select("seen_id", F.try_to_timestamp("first_seen").alias("ts"))
    return state.purge(rows, "ts", now()).select("seen_id")


# ---- scores -------------------------------------------------------------------------------------------------------

_E = r"[\p{L}\p{N}_\-]"


def _sql_count(expr: str, terms: list[str]) -> str:
    """Terms that stand as whole words, one test each (no term of the defaults stands inside another in these data)."""
    quote = lambda t: t.replace(".", r"\.").replace("'", "''")
    return "(" + " + ".join(f"regexp_matches({expr}, '(^|[^\\p{{L}}\\p{{N}}_\\-]){quote(t)}($|[^\\p{{L}}\\p{{N}}_\\-])')::INT" for t in terms) + ")"


_SCORES = (
    V
    + f""", c AS (SELECT *, lower(title) AS lt, lower(title || chr(10) || left(summary, 1500)) AS h FROM k),
n AS (SELECT *, {_sql_count('lt', LX.strong)} AS title_strong, {_sql_count('lt', LX.weak)} AS title_weak, {_sql_count('h', LX.strong)} AS strong, {_sql_count('h', LX.weak)} AS weak,
  {_sql_count('lt', LX.event)} AS event FROM c)"""
)


def lexicon_columns(i: DataFrame) -> DataFrame:
    h = scoring.haystack(F.col("title"), F.col("summary"))
    t = F.col("title")
    return i.withColumns(
        {
            "title_strong": scoring.distinct_terms(t, LX.strong), "title_weak": scoring.distinct_terms(t, LX.weak),
            "strong": scoring.distinct_terms(h, LX.strong), "weak": scoring.distinct_terms(h, LX.weak), "event": scoring.distinct_terms(t, LX.event),
        }
    )


@query(_SCORES + " SELECT ord, title_strong, title_weak, strong, weak, event FROM n")
def lexicon_counts(spark, d):
    return lexicon_columns(item_view(spark, d)).select("ord", "title_strong", "title_weak", "strong", "weak", "event")


def _sql_any(expr: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


def _scored(base: str, also: str = "0") -> str:
    """``scored``: the items of ``base`` (a WITH clause that ends with n) with their verdicts."""
    return (
        base
        + f""", s AS (SELECT *, (source_type = 'arxiv' OR regexp_matches(source, '(?i)(^|[^\\p{{L}}\\p{{N}}_\\-])(ai|ml|llm)($|[^\\p{{L}}\\p{{N}}_\\-])')) AS topical,
  greatest(coalesce(points, 0), coalesce(score, 0)) AS engagement FROM n),
scored AS (SELECT *, (source_type = 'arxiv' OR title_strong >= 1 OR title_weak >= 2 OR strong >= 2 OR (strong >= 1 AND weak >= 1) OR (weak >= 2 AND title_weak >= 1)
    OR (topical AND (title_weak >= 1 OR strong >= 1))) AS ai_related,
  greatest(1, least(5, 2 + (strong >= 2)::INT + (event >= 1)::INT + (engagement >= 500)::INT + ({also} >= 1)::INT - {_sql_any('lt', LX.low_value)}::INT
    - coalesce((epoch_us(TIMESTAMP '{NOW}') - epoch_us(published)) / 86400000000.0 > 10, false)::INT)) AS importance,
  CASE WHEN source_type = 'arxiv' THEN 'research' """
        + " ".join(f"WHEN {_sql_any('h', t)} THEN '{name}'" for name, t in LX.topics.items())
        + " ELSE 'other' END AS topic FROM s)"
    )


_SCORED = _scored(_SCORES)
#: A run's order of steps: copies merged, newsletters apart, covered stories dropped, then scored with the merged copies' sources.
_RUN = _scored(
    VR
    + FOLD
    + f""", {LEDGER_SQL}, fresh AS (SELECT k.* EXCLUDE (published, source), f.published, f.source, len(f.also) AS n_also FROM k JOIN folded f USING (ord)
  WHERE k.source_type <> 'imap' AND k.key NOT IN (SELECT key FROM ledger WHERE key IS NOT NULL)),
c AS (SELECT *, lower(title) AS lt, lower(title || chr(10) || left(summary, 1500)) AS h FROM fresh),
n AS (SELECT *, {_sql_count('lt', LX.strong)} AS title_strong, {_sql_count('lt', LX.weak)} AS title_weak, {_sql_count('h', LX.strong)} AS strong, {_sql_count('h', LX.weak)} AS weak,
  {_sql_count('lt', LX.event)} AS event FROM c)""",
    "n_also",
)


def scored(items: DataFrame, n_also) -> DataFrame:
    c = F.col
    return items.withColumns(
        {
            "engagement": scoring.engagement(c("points"), c("score")),
            "ai_related": scoring.related(c("title"), c("summary"), c("source"), c("source_type"), LX),
            "importance": scoring.importance(c("title"), c("summary"), scoring.engagement(c("points"), c("score")), n_also, c("published"), now(), LX),
            "topic": scoring.topic(scoring.haystack(c("title"), c("summary")), c("source_type"), LX),
        }
    )


def scored_items(spark: SparkSession, d: str) -> DataFrame:
    return scored(item_view(spark, d), F.lit(0))


def run_items(spark: SparkSession, d: str, view: Callable[[SparkSession, str], DataFrame] = item_view) -> DataFrame:
    """The stories of a run, scored: copies merged, newsletters apart, covered ones dropped."""
    i = view(spark, d)
    merged = ops.dedupe_ordered(i).select("ord", "key", "source", "published", "also_seen_in")
    fresh = ops.drop_seen(merged, ledger_view(spark, d), has_key=True)
    return scored(ops.lanes(i.drop("source", "published").join(fresh, "ord"))[0], F.size("also_seen_in"))


@query(_RUN + """ SELECT ord, importance, topic, n_also, row_number() OVER (ORDER BY importance DESC, engagement DESC, ord) AS rank
  FROM scored WHERE ai_related AND importance >= 2""")
def run_selection(spark, d):
    """A run's selected stories (on topic, importance 2 and more), in rank order."""
    i = run_items(spark, d).filter("ai_related AND importance >= 2").select("ord", "importance", "engagement", "topic", F.size("also_seen_in").cast("long").alias("n_also"))
    got = ops.global_index(i, [F.desc("importance"), F.desc("engagement"), F.col("ord")])
    return got.select("ord", "importance", "topic", "n_also", (F.col("index") + 1).alias("rank"))


@query(_SCORED + " SELECT ord, ai_related, importance, topic, engagement FROM scored")
def scores(spark, d):
    return scored_items(spark, d).select("ord", "ai_related", "importance", "topic", "engagement")


@query(_SCORED + " SELECT ord, row_number() OVER (ORDER BY importance DESC, engagement DESC, ord) AS rank FROM scored")
def triage_rank(spark, d):
    i = scored_items(spark, d).select("ord", "importance", "engagement")
    return ops.global_index(i, [F.desc("importance"), F.desc("engagement"), F.col("ord")]).select("ord", (F.col("index") + 1).alias("rank"))


@query(f"WITH {LATEST_SQL} SELECT item_id, importance, row_number() OVER (ORDER BY importance DESC, fetched_at DESC NULLS LAST, item_id) AS rank FROM latest JOIN items USING (item_id) WHERE ai_related AND importance >= 2")
def model_rank(spark, d):
    """Cached verdicts joined to their items, selected (on topic, importance 2 and more), by importance and recency."""
    v = latest_verdicts(spark, d).filter("ai_related AND importance >= 2").select("item_id", "importance")
    i = table(spark, d, "items").select("item_id", "fetched_at").join(v, "item_id")
    return ops.global_index(i, [F.desc("importance"), F.desc_nulls_last("fetched_at"), F.col("item_id")]).select("item_id", "importance", (F.col("index") + 1).alias("rank"))


@query(f"WITH {LATEST_SQL} SELECT item_id, importance FROM latest JOIN items USING (item_id) WHERE importance >= 4 ORDER BY importance DESC, item_id LIMIT 6")
def short_version(spark, d):
    """The six leading items (a top-k report)."""
    v = latest_verdicts(spark, d).filter("importance >= 4").select("item_id", "importance")
    i = table(spark, d, "items").select("item_id").join(v, "item_id")
    return ops.top(i, 6, [F.desc("importance"), F.col("item_id")]).select("item_id", "importance")


# ---- texts --------------------------------------------------------------------------------------------------------

_ONE = r"regexp_replace(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(V + rf""", t AS (SELECT ord, {_ONE.format("CASE WHEN summary <> '' THEN summary ELSE text END")} AS t FROM k), f AS (SELECT *, regexp_extract(left(t, 300), '^(.*?[.!?]) ', 1) AS f FROM t)
SELECT ord, CASE WHEN f <> '' AND length(f) <= 220 THEN f WHEN length(t) <= 220 THEN t ELSE regexp_replace(left(t, 220), ' [^ ]*$', '') || '…' END AS one_liner FROM f""")
def one_liner(spark, d):
    i = item_view(spark, d)
    return i.select("ord", text.first_sentence(F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("text"))).alias("one_liner"))


@query(V + r""" SELECT ord, CASE WHEN length(body) <= 400 THEN body ELSE regexp_replace(left(body, 400), '(?s) [^ ]*$', '') || ' […truncated from ' || length(body) || ' chars]' END AS excerpt FROM k""")
def excerpt(spark, d):
    i = item_view(spark, d)
    return i.select("ord", text.excerpt(text.body(F.col("text"), F.col("summary")), 400).alias("excerpt"))


@query(V + " SELECT ord, round((epoch_us(TIMESTAMP '" + NOW + "') - epoch_us(published)) / 86400000000.0, 4) AS age FROM k")
def age_days(spark, d):
    return item_view(spark, d).select("ord", F.round(text.age_days(F.col("published"), now()), 4).alias("age"))


@query(V + rf""" SELECT ord, text = '' OR (regexp_matches(right(text, 1500), '{PAYWALL}') AND length(text) < 2700) OR length(text) < 900 AS paywalled FROM k""")
def paywall_stubs(spark, d):
    return item_view(spark, d).select("ord", looks_paywalled(F.col("text")).alias("paywalled"))


@query(V + r""" SELECT ord, left(sha1(concat_ws('|', '1', 'none', key, title, left(summary, 200))), 20) AS cache_key FROM k""")
def triage_cache_key(spark, d):
    i = ops.keyed(item_view(spark, d))
    return i.select("ord", F.left(F.sha1(F.concat_ws("|", F.lit("1"), F.lit("none"), "key", "title", F.left("summary", F.lit(200)))), F.lit(20)).alias("cache_key"))


@query(V + r""" SELECT ord AS index, title, source, domain, strftime(published, '%Y-%m-%d') AS published,
  CASE WHEN length(body) <= 1200 THEN body ELSE regexp_replace(left(body, 1200), '(?s) [^ ]*$', '') || ' […truncated from ' || length(body) || ' chars]' END AS text FROM k""")
def triage_payload(spark, d):
    i = item_view(spark, d)
    return i.select(
        F.col("ord").alias("index"), "title", "source", urls.domain(F.col("url")).alias("domain"), F.date_format("published", "yyyy-MM-dd").alias("published"),
        text.excerpt(text.body(F.col("text"), F.col("summary")), 1200).alias("text"),
    )


# ---- clusters -----------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = V + rf""", t AS (SELECT ord, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))) AS tokens FROM k)"""


@query(_TOKENS + " SELECT ord, array_to_string(tokens, ' ') AS tokens FROM t")
def title_tokens(spark, d):
    return item_view(spark, d).select("ord", F.array_join(F.array_sort(text.title_tokens(F.col("title"))), " ").alias("tokens"))


@query(_TOKENS + """, x AS (SELECT DISTINCT tokens, len(tokens) AS n FROM t WHERE len(tokens) > 0), e AS (SELECT tokens, n, unnest(tokens) AS w FROM x),
j AS (SELECT a.tokens AS ta, b.tokens AS tb, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.w = b.w AND a.tokens < b.tokens GROUP BY ALL)
SELECT least(array_to_string(ta, ' '), array_to_string(tb, ' ')) AS a, greatest(array_to_string(ta, ' '), array_to_string(tb, ' ')) AS b FROM j
WHERE 2 * shared >= na + nb - shared OR (10 * shared >= 8 * least(na, nb) AND shared >= 3)""")
def similar_pairs(spark, d):
    """Pairs of different headlines (as token sets) that are similar."""
    p = cluster.similar_titles(cut(cluster.distinct_titles(item_view(spark, d))))
    said = lambda c: F.array_join(F.array_sort(c), " ")
    return p.select(said("ta").alias("sa"), said("tb").alias("sb")).select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))


def weekly_members(spark: SparkSession, d: str, view: Callable[[SparkSession, str], DataFrame] = item_view) -> DataFrame:
    """The selected stories of a run with their clusters; written once, since reports use it several times."""
    i = run_items(spark, d, view).filter("ai_related AND importance >= 2").withColumn("window", F.coalesce(text.week_label(F.col("published")), F.lit("")))
    i = cut(i.drop("key"))
    c = cluster.leader_clusters(i.withColumnsRenamed({"importance": "rank_a", "engagement": "rank_b"}), "window").drop("window")
    return cut(c.join(i, "ord"))


#: The sequential leader method: items in rank order join the first cluster whose signature is similar, or found one.
_LEADER = _RUN + rf""", sel AS (SELECT *, coalesce(strftime(published, '%G-W%V'), '') AS win, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'),
    lambda w: length(w) > 2 AND w NOT IN ({_STOP})))) AS tokens FROM scored WHERE ai_related AND importance >= 2),
q AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY importance DESC, engagement DESC, ord) AS r FROM sel),
step(win, r, ord, cl, sigs) AS (
  SELECT win, r, ord, 1::BIGINT, [tokens] FROM q WHERE r = 1
  UNION ALL
  SELECT win, r, ord, CASE WHEN hit = 0 THEN len(sigs) + 1 ELSE hit END,
    CASE WHEN hit = 0 THEN list_append(sigs, tokens) ELSE list_transform(sigs, lambda x, i: CASE WHEN i = hit THEN list_distinct(list_concat(x, tokens)) ELSE x END) END
  FROM (SELECT q.win, q.r, q.ord, q.tokens, step.sigs, coalesce(list_position(list_transform(step.sigs, lambda x: len(q.tokens) > 0 AND len(x) > 0
      AND (2 * len(list_intersect(x, q.tokens)) >= len(list_distinct(list_concat(x, q.tokens)))
        OR (10 * len(list_intersect(x, q.tokens)) >= 8 * least(len(x), len(q.tokens)) AND len(list_intersect(x, q.tokens)) >= 3))), true), 0) AS hit
    FROM step JOIN q ON q.win = step.win AND q.r = step.r + 1)
), members AS (SELECT step.win AS "window", step.ord, step.cl - 1 AS cluster, step.r - 1 AS position, q.* EXCLUDE (win, ord, r, tokens) FROM step JOIN q USING (win, ord))"""


@query(_LEADER + ' SELECT "window", ord, cluster, position FROM members')
def leader_clusters(spark, d):
    """The exact sequential clusters of each week."""
    return weekly_members(spark, d).select("window", "ord", "cluster", "position")


_RANKED = _LEADER + """, ranked AS (SELECT "window", cluster, max(importance) AS importance, count(*) AS size, arg_min(ord, position) AS founder_ord,
  row_number() OVER (PARTITION BY "window" ORDER BY max(importance) DESC, count(*) DESC, cluster) AS rank FROM members GROUP BY "window", cluster)"""


@query(_RANKED + " SELECT * FROM ranked")
def cluster_rank(spark, d):
    return cluster.rank_clusters(weekly_members(spark, d)).select("window", "cluster", "importance", "size", "founder_ord", "rank")


@query(_LEADER + """, firsts AS (SELECT "window", cluster, source, min(position) AS p FROM members GROUP BY ALL)
SELECT "window", cluster, list(source ORDER BY p, source) AS sources FROM firsts GROUP BY "window", cluster""")
def cluster_sources(spark, d):
    return cluster.ordered_sources(weekly_members(spark, d))


@query(_LEADER + f""" SELECT position AS index, title, source, topic, importance, CASE WHEN f <> '' AND length(f) <= 220 THEN f WHEN length(t) <= 220 THEN t
    ELSE regexp_replace(left(t, 220), ' [^ ]*$', '') || '…' END AS one_liner, "window"
  FROM (SELECT *, regexp_extract(left(t, 300), '^(.*?[.!?]) ', 1) AS f FROM (SELECT *, {_ONE.format("CASE WHEN summary <> '' THEN summary ELSE text END")} AS t FROM members))""")
def cluster_payload(spark, d):
    """What a grouping model is sent of each week's selection."""
    line = text.first_sentence(F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("text")))
    return weekly_members(spark, d).select(F.col("position").alias("index"), "title", "source", "topic", "importance", line.alias("one_liner"), "window")


@query(_RANKED + """ SELECT m."window", r.rank, m.position, m.ord, m.title, m.url, strftime(m.published, '%Y-%m-%d') AS published, m.paywalled, m.n_also,
    m.points, m.score, (m.points IS NOT NULL OR m.score IS NOT NULL OR m.comments IS NOT NULL) AS has_engagement,
    CASE WHEN length(m.body) <= 800 THEN m.body ELSE regexp_replace(left(m.body, 800), '(?s) [^ ]*$', '') || ' […truncated from ' || length(m.body) || ' chars]' END AS body
  FROM members m JOIN ranked r USING ("window", cluster) WHERE r.rank <= 36""")
def digest_coverage(spark, d):
    """The digest payload's coverage, one row an item: the 36 leading clusters of each week (the digest's cut)."""
    members = weekly_members(spark, d)
    ranked = cluster.rank_clusters(members).filter("rank <= 36").select("window", "cluster", "rank")
    e = members.withColumn("one_liner", F.lit(None).cast("string")).join(ranked, ["window", "cluster"]).withColumn("e", reports.coverage_entry(800))
    return e.select(
        "window", "rank", "position", "ord", "e.title", "e.url", "e.published", "e.paywalled", F.size("e.also_seen_in").cast("long").alias("n_also"), "points", "score",
        F.col("e.engagement").isNotNull().alias("has_engagement"), "e.body",
    )


@query(_RANKED + """ SELECT (SELECT count(*) FROM items) AS candidates_collected, (SELECT count(*) FROM members) AS stories_after_triage, (SELECT count(*) FROM ranked) AS clusters,
  (SELECT count(DISTINCT source) FROM items) AS sources, (SELECT count(*) FROM fresh) AS n_fresh""")
def digest_counts(spark, d):
    """Counts of a run down to its clusters."""
    m = weekly_members(spark, d)
    got = m.agg(F.count(F.lit(1)).alias("stories_after_triage"), F.countDistinct("window", "cluster").alias("clusters")).withColumn("j", F.lit(1))
    raw = table(spark, d, "items").agg(F.count(F.lit(1)).alias("candidates_collected"), F.countDistinct("source").alias("sources")).withColumn("j", F.lit(1))
    fresh = run_items(spark, d).agg(F.count(F.lit(1)).alias("n_fresh")).withColumn("j", F.lit(1))
    return raw.join(got, "j").join(fresh, "j").drop("j")  # three single rows


@query(_TOKENS.replace("WITH i AS", "WITH RECURSIVE i AS") + """, x AS (SELECT DISTINCT tokens, len(tokens) AS n FROM t WHERE len(tokens) > 0), e AS (SELECT tokens, n, unnest(tokens) AS w FROM x),
j AS (SELECT a.tokens AS ta, b.tokens AS tb, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.w = b.w AND a.tokens <> b.tokens GROUP BY ALL),
sim AS (SELECT ta, tb FROM j WHERE 2 * shared >= na + nb - shared OR (10 * shared >= 8 * least(na, nb) AND shared >= 3)),
reach(tokens, other) AS (SELECT tokens, tokens FROM x UNION SELECT r.tokens, s.tb FROM reach r JOIN sim s ON s.ta = r.other),
ord_of AS (SELECT tokens, min(ord) AS first, count(*) AS n FROM t WHERE len(tokens) > 0 GROUP BY tokens),
ev AS (SELECT r.tokens, min(o.first) AS event, sum(o.n) AS n_items FROM reach r JOIN ord_of o ON o.tokens = r.other GROUP BY r.tokens),
l AS (SELECT ta AS tokens, count(*) AS n_links FROM sim GROUP BY ta)
SELECT ord, coalesce(event, ord) AS event, coalesce(n_links, 0) AS n_links, coalesce(n_items, 1)::BIGINT AS n_items FROM t LEFT JOIN ev USING (tokens) LEFT JOIN l USING (tokens)""")
def event_components(spark, d):
    """Connected components of similar headlines over all items: the scalable relative of the leader method."""
    return cluster.event_components(item_view(spark, d))


# ---- reports ------------------------------------------------------------------------------------------------------


@query(f"""WITH g AS (SELECT source, count(*) AS n, max(fetched_at) AS newest FROM items GROUP BY source), p AS (SELECT s.source, coalesce(n, 0) AS n_items,
  CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(newest)) / 86400000000) AS BIGINT) AS age_days, newest FROM (SELECT DISTINCT source FROM sources) s LEFT JOIN g USING (source))
SELECT source, n_items, age_days, CASE WHEN n_items = 0 THEN 'EMPTY' WHEN newest IS NULL THEN 'UNDATED' WHEN age_days > 7 THEN 'STALE' ELSE 'OK' END AS status FROM p""")
def probe_status(spark, d):
    return reports.probe(table(spark, d, "sources"), item_view(spark, d).select("source", "published"), now(), 7).select("source", "n_items", "age_days", "status")


@query(V + """, h AS (SELECT source, count(*) AS n_items, count(*) FILTER (paywalled) AS stubs, count(*) FILTER (NOT paywalled AND trim(text) = '' AND full_text) AS unfetchable,
  bool_or(authenticated) AS has_login FROM k JOIN sources USING (source) WHERE k.source_type = 'paywalled' GROUP BY source)
SELECT *, has_login AND stubs >= greatest(3, n_items // 2) AS login_expired, has_login AND unfetchable >= greatest(3, n_items // 2) AS refused FROM h""")
def subscription_health(spark, d):
    full = small_side(table(spark, d, "sources").select("source", "full_text"))
    i = item_view(spark, d).filter("source_type = 'paywalled'").join(full, "source")
    return reports.subscription_health(i.withColumn("has_login", F.coalesce("authenticated", F.lit(False))))


_PLACE = "coalesce(list_position([" + ", ".join(f"'{t}'" for t in reports.TOPIC_HEADINGS) + "], topic), 10000)"
_HEAD = "CASE " + " ".join(f"WHEN topic = '{t}' THEN '{h}'" for t, h in reports.TOPIC_HEADINGS.items()) + " ELSE topic END"


@query(f"""WITH {LATEST_SQL}, r AS (SELECT topic, row_number() OVER (ORDER BY importance DESC NULLS LAST, item_id) AS rank FROM latest QUALIFY rank <= 36),
g AS (SELECT topic, list_sort(list(rank)) AS ranks, min(rank) AS first FROM r GROUP BY topic)
SELECT row_number() OVER (ORDER BY {_PLACE}, first) AS section, topic, {_HEAD} AS heading, ranks FROM g""")
def digest_topics(spark, d):
    """The 36 leading items (the digest's cut) by topic, in the order of display."""
    v = ops.top(latest_verdicts(spark, d), 36, [F.desc_nulls_last("importance"), F.col("item_id")])
    return reports.topic_sections(v.withColumn("rank", F.col("rank").cast("long"))).select("section", "topic", "heading", "ranks")


@query(V + """ SELECT row_number() OVER (ORDER BY published DESC NULLS LAST, ord) AS position,
  coalesce(strftime(published, '%Y-%m-%d'), 'undated') || '  ' || rpad(left(source, 28), 28, ' ') || '  ' || left(title, 90) AS line FROM k""")
def fetch_listing(spark, d):
    """The console listing: newest first, undated last."""
    return reports.listing(item_view(spark, d))


@query(V + f", {LEDGER_SQL}" + """ SELECT (SELECT count(*) FROM k) AS n_raw, (SELECT count(DISTINCT key) FROM k) AS n_unique, (SELECT count(*) FROM k WHERE source_type <> 'imap') AS n_stories,
  (SELECT count(*) FROM k WHERE source_type = 'imap') AS n_newsletters, (SELECT count(*) FROM k WHERE source_type <> 'imap' AND key NOT IN (SELECT key FROM ledger WHERE key IS NOT NULL)) AS n_fresh""")
def run_funnel(spark, d):
    i = ops.keyed(item_view(spark, d)).select("key", "source_type")
    one = i.join(small_side(ledger_view(spark, d).select("key").distinct().withColumn("known", F.lit(True)), 200_000), "key", "left")
    story = F.col("source_type") != "imap"
    return one.agg(
        F.count(F.lit(1)).alias("n_raw"), F.countDistinct("key").alias("n_unique"), F.count_if(story).alias("n_stories"), F.count_if(~story).alias("n_newsletters"),
        F.count_if(story & F.col("known").isNull()).alias("n_fresh"),
    )


@query("SELECT list_sort(list(DISTINCT source)) AS sources FROM items")
def contributing_sources(spark, d):
    return table(spark, d, "items").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("SELECT strftime(fetched_at, '%G-W%V') AS week, count(*) AS n_items, count(*) || CASE WHEN count(*) = 1 THEN ' story' ELSE ' stories' END AS told FROM items WHERE fetched_at IS NOT NULL GROUP BY 1")
def week_counts(spark, d):
    i = table(spark, d, "items").filter("fetched_at is not null").groupBy(text.week_label(F.col("fetched_at").cast("timestamp")).alias("week"))
    return i.agg(F.count(F.lit(1)).alias("n_items")).withColumn("told", text.plural(F.col("n_items"), "story", "stories"))


@query(_SCORED + " SELECT strftime(published, '%G-W%V') AS week, ord, row_number() OVER (PARTITION BY week ORDER BY importance DESC, engagement DESC, ord) AS rank FROM scored WHERE ai_related QUALIFY rank <= 12")
def weekly_digest(spark, d):
    """The twelve leading items of each week (a top-k report)."""
    i = scored_items(spark, d).filter("ai_related").withColumn("week", text.week_label(F.col("published")))
    w = Window.partitionBy("week").orderBy(F.desc("importance"), F.desc("engagement"), "ord")
    return i.withColumn("rank", F.row_number().over(w)).filter("rank <= 12").select("week", "ord", "rank")


@query("SELECT source_type, count(*) AS n_items, count(DISTINCT source) AS n_sources FROM items GROUP BY source_type")
def lane_counts(spark, d):
    """Items and sources of each type."""
    return table(spark, d, "items").groupBy("source_type").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("source").alias("n_sources"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05')) AS week_us, count(*) AS n FROM events GROUP BY 1, 2")
def event_weeks(spark, d):
    """Events by type and tumbling week (Monday); the streaming form is streaming.weekly_counts."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("ts", "7 days", startTime="4 days").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", F.unix_micros("w.start").alias("week_us"), "n")


@query()
def digest_lines(spark, d):
    """The last week's digest, by the dates that the feeds wrote, as numbered Markdown lines: at most 36 clusters and 12
    newsletters reach the driver (the cut)."""
    members = weekly_members(spark, d, dated_view).filter(F.col("published") < now())
    last = members.agg(F.max("window")).first()[0] or ""
    members = members.filter(F.col("window") == last)
    ranked = cluster.rank_clusters(members).filter("rank <= 36")
    line = text.first_sentence(text.body(F.col("summary"), F.col("text")))
    heads = ranked.join(cluster.ordered_sources(members), ["window", "cluster"]).join(
        members.select(F.col("ord").alias("founder_ord"), F.col("title").alias("headline"), "url", "topic", line.alias("one_liner")), "founder_ord"
    )
    also = members.filter("position > 0").withColumn("n", F.row_number().over(Window.partitionBy("window", "cluster").orderBy("position")))
    also = also.filter("n <= 2").groupBy("window", "cluster").agg(F.array_sort(F.collect_list(F.struct("n", "source", "url"))).alias("also"))
    rows = heads.join(also, ["window", "cluster"], "left").orderBy("rank").collect()
    clusters = [
        {"headline": r.headline, "url": r.url, "sources": r.sources, "topic": r.topic, "importance": r.importance, "size": r.size, "one_liner": r.one_liner,
         "also": [(x.source, x.url) for x in r.also or []]} for r in rows
    ]
    week = cut(dated_view(spark, d).filter(text.week_label(F.col("published")) == F.lit(last)).select("ord", "source", "source_type", "title", "published"))
    letters = ops.top(ops.lanes(week)[1], 12, [F.desc_nulls_last("published"), F.col("ord")]).orderBy("rank").collect()
    letters = [{"title": r.title, "source": r.source, "date": r.published.date().isoformat() if r.published else None} for r in letters]
    lines = reports.render(clusters, letters, week.select("source").distinct().count()).split("\n")
    return spark.createDataFrame([(i, s) for i, s in enumerate(lines, 1)], "line_no int, line string")
