import collections
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressloom.operators import cluster, items as ops, reports, state
from pressloom.operators.graph import components
from pressloom.runtime import hot_join, salted_join

ITEM = "ord long, source string, source_type string, title string, url string, published timestamp, summary string, text string"


def frame(spark, rows, schema=ITEM):
    return spark.createDataFrame(rows, schema)


def brute_dedupe(rows):
    """A sequential pass: the longer body takes over, lists restart with the loser."""
    held = {}
    for r in rows:
        new = {"ord": r[0], "source": r[1], "published": r[5], "len": len(r[7] or r[6] or ""), "also": []}
        old = held.get(r[4])
        if old is None:
            held[r[4]] = new
            continue
        keep, lose = (new, old) if new["len"] > old["len"] else (old, new)
        for name in [lose["source"], *lose["also"]]:
            if name != keep["source"] and name not in keep["also"]:
                keep["also"].append(name)
        keep["published"] = keep["published"] or lose["published"]
        held[r[4]] = keep
    return {k: (v["ord"], v["source"], v["published"], v["also"]) for k, v in held.items()}


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_against_a_sequential_pass(spark, seed):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.5 else dt.datetime(2026, 1, rng.randint(1, 28))
    rows = [(i, rng.choice("ABCDE"), "rss", "t", f"https://x.example/{rng.randint(0, 8)}", day(), "s" * rng.randint(0, 4), "t" * rng.choice([0, 0, 3, 6])) for i in range(120)]
    want = {k: v for k, v in brute_dedupe(rows).items()}
    df = frame(spark, rows)
    keys = {r.url: r.key for r in ops.keyed(df).select("url", "key").distinct().collect()}
    got = {r.key: r for r in ops.dedupe_ordered(df).collect()}
    sets = {r.key: r for r in ops.dedupe_sets(df).collect()}
    for url, (ord_, source, published, also) in want.items():
        r = got[keys[url]]
        assert (r.ord, r.source, r.published, r.also_seen_in) == (ord_, source, published, also)
        assert (sets[keys[url]].ord, sets[keys[url]].also_seen_in) == (ord_, sorted(also))


def test_filters_lanes_caps_and_nulls(spark):
    rows = [
        (1, "A", "rss", "Model one", "https://x.example/1", dt.datetime(2026, 1, 1), "", ""),
        (2, "A", "imap", None, None, None, None, None),
        (3, None, "rss", "other", "", dt.datetime(2026, 2, 1), "a MODEL said", "x" * 100_000),
        (4, "A", None, "", None, dt.datetime(2026, 2, 2), "model doubts", ""),
    ]
    df = frame(spark, rows).withColumn("key0", F.lit(1))
    ids = lambda d: sorted(r.ord for r in d.collect())
    assert ids(ops.window_floor(df, F.lit("2026-02-01").cast("timestamp"))) == [2, 3, 4]
    assert ids(ops.window_floor(df, F.lit("2026-02-01").cast("timestamp"), strict=True)) == [4]
    assert ids(ops.term_filter(df, ["model"], ["doubts"])) == [1, 3]
    stories, letters = ops.lanes(df)
    assert ids(stories) == [1, 3, 4] and ids(letters) == [2]
    assert ids(ops.cap(df, ["source"], 2, [F.col("ord")])) == [1, 2, 3]
    assert [r["index"] for r in ops.global_index(df, [F.desc_nulls_last("published"), F.col("ord")]).orderBy("ord").collect()] == [2, 3, 1, 0]
    assert ops.dedupe_sets(df.limit(0)).count() == 0 and ops.dedupe_ordered(df.limit(0)).count() == 0
    ledger = ops.keyed(df.filter("ord = 1")).select("key")
    assert ids(ops.drop_seen(df, ledger)) == [2, 3, 4] and ids(ops.seen(df, ledger)) == [1]
    gaps = df.select(ops.prefix_match(df, [("https://x.example/", 3.0), ("https://", 1.0)]).alias("g"), "ord")
    assert {r.ord: r.g for r in gaps.collect()} == {1: 3.0, 2: None, 3: None, 4: None}


def test_cut_orders_differ(spark):
    df = spark.createDataFrame([(i, "S", s) for i, s in enumerate([5, 1, 9, 7, None])], "ord long, source string, score long")
    assert [r.ord for r in ops.sort_then_cut(df, ["source"], 2, "score").orderBy("rank").collect()] == [2, 3]
    assert [r.ord for r in ops.cut_then_sort(df, ["source"], 2, "score").orderBy("rank").collect()] == [0, 1]
    assert [r.ord for r in ops.top(df, 2, [F.desc_nulls_last("score")]).collect()] == [2, 3]


def test_state(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    ledger = spark.createDataFrame([("a", 1)], "key string, n int")
    rows = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 5)], "key string, n int")
    assert [tuple(r) for r in state.insert_or_ignore(ledger, rows, [F.col("n")]).collect()] == [("b", 3)]
    cache = spark.createDataFrame([("x", "old", t(1)), ("x", "new", t(20)), ("y", "aged", t(1))], "key string, value string, created timestamp")
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "key string")
    hits = {r.key: r.hit for r in state.probe(items, cache, F.lit(t(28)), 10, F.col("value").isNotNull()).collect()}
    assert hits == {"x": True, "y": False, "z": False}
    assert state.purge(cache, "created", F.lit(t(28)), 10).count() == 1


def brute_leader(titles):
    sigs, out = [], []
    for t in titles:
        for k, s in enumerate(sigs):
            n = len(t & s)
            if t and s and (n / len(t | s) >= 0.5 or (n / min(len(t), len(s)) >= 0.8 and n >= 3)):
                sigs[k] = s | t
                out.append(k)
                break
        else:
            sigs.append(t)
            out.append(len(sigs) - 1)
    return out


def test_clusters_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(14)]
    rows = [(i, rng.choice("AB"), "2026-W01" if i % 2 else None, " ".join(rng.sample(words, rng.randint(0, 6))), rng.randint(1, 5), 0) for i in range(160)]
    df = spark.createDataFrame(rows, "ord long, source string, week string, title string, rank_a int, rank_b int")
    got = {r.ord: r.cluster for r in cluster.leader_clusters(df, "week").collect()}
    for week in ("2026-W01", None):
        mine = sorted((r for r in rows if r[2] == week), key=lambda r: (-r[4], r[0]))
        assert [got[r[0]] for r in mine] == brute_leader([set(r[3].split()) for r in mine])
    sets = {tuple(sorted(r[3].split())) for r in rows if r[3]}
    sim = lambda a, b: 2 * len(a & b) >= len(a | b) or (10 * len(a & b) >= 8 * min(len(a), len(b)) and len(a & b) >= 3)
    want = {(a, b) for a in sets for b in sets if a < b and sim(set(a), set(b))}
    names = {r.t: tuple(r.tokens) for r in cluster.distinct_titles(df).collect()}
    pairs = {tuple(sorted((names[r.a], names[r.b]))) for r in cluster.similar_pairs(df).collect()}
    assert pairs == want
    assert cluster.event_components(df).count() == len(rows) and cluster.leader_clusters(df.limit(0), "week").count() == 0


def shuffled(spark) -> dict[int, int]:
    """Records that the tasks of each stage have written for others."""
    jvm, empty = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, empty, jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_pairs_of_headlines_cut_from_one_pattern(spark):
    """Two million pairs share one of the rarest words of a headline, some 600 are similar; what is shuffled follows the headlines."""
    rng = random.Random(7)
    slots = [tuple(rng.choice(["north", "south", "east", "west", "upper"]) + str(i) for i in range(6)) for _ in range(4500)]
    rows = [(i, " ".join([*s, f"name{i}", f"place{i}", f"firm{i}"])) for i, s in enumerate(slots)]
    df = spark.createDataFrame(rows, "ord long, title string")
    before = max(shuffled(spark), default=-1)
    got = cluster.similar_pairs(df).select(F.hash("a"), F.hash("b")).collect()
    assert 0 < sum(n for k, n in shuffled(spark).items() if k > before) < 150 * len(rows)
    n = collections.Counter(slots)
    assert len(got) == sum(k * (k - 1) // 2 for k in n.values())


def test_events_of_headlines_cut_from_one_pattern(spark):
    """The same for events: each has the headlines of one choice of words, all linked; copies and empty titles keep their rows."""
    rng = random.Random(8)
    slots = [tuple(rng.choice(["north", "south", "east", "west", "upper"]) + str(i) for i in range(6)) for _ in range(3000)]
    rows = [(i, " ".join([*s, f"name{i}", f"place{i}", f"firm{i}"])) for i, s in enumerate(slots)]
    rows += [(5000 + i, t) for i, t in rows[:50]] + [(9000, ""), (9001, None)]
    before = max(shuffled(spark), default=-1)
    got = {r.ord: (r.event, r.n_links, r.n_items) for r in cluster.event_components(spark.createDataFrame(rows, "ord long, title string")).collect()}
    assert 0 < sum(n for k, n in shuffled(spark).items() if k > before) < 150 * len(rows)
    held = collections.defaultdict(list)
    for i, s in [*enumerate(slots), *((5000 + i, s) for i, s in enumerate(slots[:50]))]:
        held[s].append(i)
    want = {i: (min(ids), sum(x < 5000 for x in ids) - 1, len(ids)) for ids in held.values() for i in ids}
    assert got == want | {9000: (9000, 0, 1), 9001: (9001, 0, 1)}


@pytest.mark.parametrize("few, most", [(128, 4_000_000), (2, 30), (0, 0)])
def test_longer_keys_lose_no_pair(spark, few, most):
    rng = random.Random(few)
    words = [f"word{i}" for i in range(18)] + [f"rare{i}" for i in range(150)]
    titles = [" ".join(rng.choices(words, [20] * 8 + [5] * 10 + [1] * 150, k=rng.randint(1, 13))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    sets = sorted({tuple(sorted(set(t.split()))) for t in titles})
    sim = lambda n, x, y: 3 * n >= x + y or (10 * n >= 8 * min(x, y) and n >= 3)
    want = [(a, b) for a in sets for b in sets if a < b and sim(len(set(a) & set(b)), len(a), len(b))]
    names = {r.t: tuple(r.tokens) for r in cluster.distinct_titles(df).collect()}
    got = sorted(tuple(sorted((names[r.a], names[r.b]))) for r in cluster.similar_pairs(df, few, most).collect())
    assert got == want


def test_clusters_keep_all_items_of_a_large_source(spark):
    rows = [(i, "A" if i < 200 else "B", "2026-W01", f"word{i % 97} thing{i % 97} other{i % 97}", 1 + i % 5, i % 7) for i in range(230)]
    df = spark.createDataFrame(rows, "ord long, source string, week string, title string, rank_a int, rank_b int")
    got = cluster.leader_clusters(df, "week").collect()
    mine = sorted(rows, key=lambda r: (-r[4], -r[5], r[0]))
    assert [r.ord for r in sorted(got, key=lambda r: r.position)] == [r[0] for r in mine]
    at = {r.ord: r.cluster for r in got}
    assert [at[r[0]] for r in mine] == brute_leader([set(r[3].split()) for r in mine])


def test_members_of_a_reply(spark):
    groups = spark.createDataFrame([(0, [0, 1, 1, 99]), (1, [1])], "grp long, members array<long>")
    items = spark.createDataFrame([(0,), (1,), (2,)], "index long")
    assert {r["index"]: r.grp for r in cluster.resolve_members(groups, items).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r["index"]: r.grp for r in cluster.resolve_members(groups.limit(0), items).collect()} == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, 101 + i) for i in range(50)] + [(200 + i, 201 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(pd.DataFrame(edges, columns=["a", "b"]))
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_reports(spark):
    conf = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "source string")
    day = lambda d: dt.datetime(2026, 1, d)
    items = spark.createDataFrame([("A", day(27)), ("B", None), ("C", day(1)), ("X", day(1))], "source string, published timestamp")
    got = {r.source: r.status for r in reports.probe(conf, items, F.lit(day(28)), 7).collect()}
    assert got == {"A": "OK", "B": "UNDATED", "C": "STALE", "D": "EMPTY"}
    rows = [("S", "", True, True, True)] * 3 + [("S", None, False, True, True), ("S", "x", None, True, True)]
    h = reports.subscription_health(spark.createDataFrame(rows, "source string, text string, paywalled boolean, has_login boolean, full_text boolean")).first()
    assert (h.n_items, h.stubs, h.unfetchable, h.login_expired, h.refused) == (5, 3, 1, True, False)
    t = spark.createDataFrame([("zeta", 1), ("research", 2), ("other", 3), ("research", 4)], "topic string, rank int")
    got = [(r.heading, r.ranks) for r in reports.topic_sections(t).orderBy("section").collect()]
    assert got == [("Research", [2, 4]), ("Everything else", [3]), ("zeta", [1])]


def test_digest_text_and_replies():
    c = {"headline": "H", "url": "https://x.example", "sources": ["A", "B", "C", "D"], "topic": "research", "importance": 4, "size": 2, "one_liner": "One.", "also": [("B", "https://y.example")]}
    out = reports.render([c, c | {"topic": "zeta", "importance": 1, "url": None}], [{"title": "N", "source": "L"}], 1)
    assert "## The short version" in out and "- [H](https://x.example) (A, B)" in out and "## Research" in out and "## zeta" in out
    assert "A, B, C\n" in out and "- **N** — L, undated" in out and out.endswith("_Coverage: 4 stories from 1 source._")
    assert reports.find_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and reports.find_json('so: {"a": [1]} ok') == {"a": [1]} and reports.find_json("no") is None
    assert reports.shrink(lambda n: n * 100, 8000) == 4000 and reports.shrink(lambda n: 10**9, 8000) == 1000


def test_hubs_are_joined_apart(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 399 - i) for i in range(50)] + [(2000, 2001)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, hub=20).collect()}
    assert got == {r.node: r.component for r in components(df).collect()} and got[1049] == 0 and got[2001] == 2000
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (None, 1)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, w string")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(hot_join(left, right, "k", "left", 10)) == rows(left.join(right, "k", "left"))
    assert rows(hot_join(left, right, "k", "inner", 10)) == rows(left.join(right, "k"))
    assert rows(salted_join(left, right, ["k"], "v")) == rows(left.join(right, "k"))


def test_windows_listing_and_weekly_files(spark, tmp_path):
    now = dt.datetime(2026, 6, 30, tzinfo=dt.timezone.utc)
    assert reports.since(None, 7, now) == now - dt.timedelta(days=7)
    assert reports.since("2026-06-01", 7, now) == dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)
    assert reports.since("2026-06-01T02:00:00+02:00", 7, now).utcoffset() == dt.timedelta(hours=2)
    with pytest.raises(ValueError):
        reports.since("June", 7, now)
    rows = [(1, "S" * 40, "rss", "T" * 100, None, None, "", ""), (2, "A", "rss", "t", None, dt.datetime(2026, 1, 2), "", "")]
    got = [r.line for r in reports.listing(frame(spark, rows)).orderBy("position").collect()]
    assert got == ["2026-01-02  " + "A".ljust(28) + "  t", "undated  " + "S" * 28 + "  " + "T" * 90]
    text = "## Head <1>\n\n- **[A](https://x.example/?a=1&b=2)** and _more_\n  One line\n  - also: [B](https://y.example)\n\nEnd"
    page = reports.to_html(text, "foot")
    assert "<h2>Head &lt;1&gt;</h2>" in page and '<strong><a href="https://x.example/?a=1&amp;b=2">A</a></strong> and <em>more</em>' in page
    assert page.count("<ul>") == page.count("</ul>") == 2 and "<p>End</p><footer>foot</footer>" in page and reports.to_html("") != ""
    paths = reports.write_week(spark, str(tmp_path), "2026-W27", text)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["2026-W27.md", "2026-W27.html"] and (tmp_path / "2026-W27.md").read_text() == text


def test_digest_stories(spark):
    schema = "window string, cluster long, position long, title string, source string, url string, published timestamp, one_liner string, paywalled boolean, also_seen_in array<string>, points long, score long, comments long, summary string, text string, topic string"
    rows = [("w", 0, 1, "B", "S2", "u2", None, "o2", None, None, None, None, None, "sum", None, "other"), ("w", 0, 0, "A", "S1", "u1", dt.datetime(2026, 1, 2), "o1", True, ["X"], 5, None, 7, "s", "word " * 300, "research")]
    ranked = spark.createDataFrame([("w", 0, 4, 1)], "window string, cluster long, importance int, rank int")
    r = reports.digest_stories(spark.createDataFrame(rows, schema), ranked, 100).first()
    assert (r.headline, r.topic, r.importance, [c.title for c in r.coverage]) == ("A", "research", 4, ["A", "B"])
    assert r.coverage[0].engagement == '{"points":5,"comments":7}' and r.coverage[1].engagement is None and r.coverage[1].also_seen_in == []
    assert "truncated" in r.coverage[0].body and r.coverage[1].body == "sum" and r.coverage[1].paywalled is False
