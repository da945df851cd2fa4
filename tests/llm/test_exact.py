"""Problems 4, 5, 6, 8 and 9 against brute force on small tables, with odd rows."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressloom.llm import folding, history, leakage, packing, repeated_lines
from tests.oracle import compare, views

# ---- 6 ------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=6))
def test_hashes_agree_exactly_with_the_comparison(texts):
    import pyarrow as pa

    h = folding.fold_hash(pa.array(texts))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (tuple(h[i]) == tuple(h[j])) == folding.skipping_equal(a, b)


def test_a_hash_does_not_depend_on_its_batch():
    import pyarrow as pa

    texts = ["\uf900", "e\u0301", "é", "A\u030a", "\u212b", "plain"]
    alone = [tuple(folding.fold_hash(pa.array([t]))[0]) for t in texts]
    assert [tuple(x) for x in folding.fold_hash(pa.array(texts))] == alone and alone[1] == alone[2] and alone[3] == alone[4]


def test_copies_and_odd_rows(spark):
    rows = [
        ("items", 1, "rss", "Größe, A!", "https://a.example/x-y?a=1&b=2"),
        ("items", 2, "imap", "GRÖSSE a", "HTTPS://A.EXAMPLE/x_y/?b=2&a=1&"),
        ("items", 3, "rss", "Größe A", "https://a.example/x-y?a=1&b=2&c=3"),
        ("items", 4, "rss", "größe a", "https://a.example/x%2Dy?a=1&b=2"),
        ("items", 5, "imap", "Letter 1", None),
        ("items", 6, "imap", "letter 1!", " "),
        ("items", 7, "rss", "letter 1", None),
        ("items", 8, "rss", None, None),
        ("items", 9, "rss", "", None),
        ("items", 1, "rss", "Größe, A!", "https://a.example/x-y?a=1&b=2"),
        ("seen_items", 1, "", '"AB-cd"', None),
        ("seen_items", 2, "", " abcd\n", None),
        ("seen_items", 3, "", None, None),
        ("items", 10, "rss", "x" * 200_000, "https://a.example/long"),
        ("items", 11, "rss", "X" * 200_000, "https://a.example/LONG"),
    ]
    df = spark.createDataFrame(rows, "tab string, id long, source_type string, title string, url string")
    df = df.selectExpr("*", "'clash' AS h1", "1 AS salt")
    got = {(r.tab, r.keep_id, r.dup_id) for r in folding.copies(df.drop("salt")).collect()}
    assert got == {("items", 1, 2), ("items", 1, 4), ("items", 5, 6), ("seen_items", 1, 2), ("items", 10, 11)}
    assert folding.copies(df.limit(0)).count() == 0


def test_copies_against_sql(spark, data):
    compare(folding.QUERIES["p6_found"](spark, data), views(data), folding.ORACLES["p6_found"])


def test_colliding_texts_are_not_merged(spark):
    assert not folding.skipping_equal("ab", "abc") and not folding.same_url("https://a/x?p=1", "https://a/x?p=2")
    assert folding.same_url("https://a/x?p=1&q=2", "https://a/x?q=2&p=1&p=1")


# ---- 5 ------------------------------------------------------------------------------------------------------------


def test_repeated_lines(spark, data):
    con = views(data)
    for name in ("p5_found", "p5_clean"):
        compare(repeated_lines.QUERIES[name](spark, data), con, repeated_lines.ORACLES[name])


def test_blocks_and_odd_rows(spark):
    body = lambda i: f"Own line {chr(97 + i)}{chr(98 + i)}\n  ©  {2000 + i} Site\n\nAll rights\nreserved"
    rows = [(i, "A", body(i), "kept") for i in range(5)] + [(0, "A", body(0), "kept")] + [(20 + i, None, "same", "kept") for i in range(5)]
    rows += [(30, "A", None, "x"), (31, "A", "", "x"), (32, "B", body(1), "x"), (33, "A", "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "item_id long, source string, text string, n1 string")
    got = repeated_lines.matches(df.drop("n1")).collect()
    assert {(r.item_id, r.line_no) for r in got} == {(i, n) for i in range(5) for n in (2, 4, 5)} | {(20 + i, 1) for i in range(5)}
    assert len({r.block for r in got if r.source == "A"}) == 1
    clean = {r.item_id: r for r in repeated_lines.without_repeated(df).collect()}
    assert clean[1].text == "Own line bc\n" and clean[1].n1 == "kept" and clean[30].text is None and clean[20].text == ""
    assert repeated_lines.matches(df.drop("n1").limit(0)).count() == 0


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_leaks(spark, data):
    for name in ("p9_found", "p9_items"):
        compare(leakage.QUERIES[name](spark, data), views(data), leakage.ORACLES[name])


def test_retrieval_is_that_of_a_full_scan():
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 300)
    ix = leakage.Index([(k, text(int(rng.integers(13, 60))), "", "") for k in range(150)])
    docs = [text(int(n)).split() for n in rng.integers(0, 200, 40)]
    got = set(ix.search(docs))
    weight = np.zeros((len(ix.vocab), 150))
    for t in range(len(ix.vocab)):
        for e in range(ix.first[t], ix.first[t + 1]):
            weight[t, ix.item[ix.at[e] : ix.at[e + 1]]] = ix.weight[ix.at[e] : ix.at[e + 1]]
    step, want = leakage.WINDOW - leakage.N + 1, set()
    for d, ws in enumerate(docs):
        for lo in range(0, max(1, len(ws)), step):
            terms = {ix.vocab[w] for w in ws[lo : lo + leakage.WINDOW] if w in ix.vocab}
            want |= {(d, int(k), lo, leakage.WINDOW) for k in np.flatnonzero(weight[sorted(terms)].sum(axis=0) >= 0.999)}
    assert got == want and want


def test_leaks_at_every_offset(spark):
    from pyspark.sql import Row

    rng = random.Random(3)
    word = lambda: "w" + str(rng.randint(0, 400))
    items = [Row(eval_id=k, passage=" ".join(word() for _ in range(40)), question="what is w1", answer="B") for k in range(70)]
    items.append(Row(eval_id=99, passage="too short", question=None, answer=None))
    docs, want = [], set()
    for d in range(160):
        ws = [word() for _ in range(rng.randint(0, 260))]
        n = rng.choice([12, 13, 20])
        k, at = rng.randrange(70), rng.randrange(28 - n + 13)
        run = items[k].passage.split()[at : at + n]
        pos = rng.randint(0, len(ws))
        ws[pos:pos] = [f"sep{d}", *run, f"end{d}"]
        docs.append((d, " ".join(ws).upper().replace(" ", rng.choice([" ", ", ", "\n\n", " "]))))
        if len(run) >= 13:
            want.add((k, d))
    df = spark.createDataFrame(docs + docs[:2] + [(900, None), (901, "")], "doc_id long, text string")
    got = {(r.eval_id, r.doc_id) for r in leakage.leaks(df, items).collect()}
    assert got == want
    small = {(r.eval_id, r.doc_id) for r in leakage.leaks(df, iter(items), size=2000).collect()}  # many passes
    assert small == want
    assert leakage.leaks(df, []).count() == 0 and leakage.leaks(df.limit(0), items).count() == 0


# ---- 8 ------------------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(25):
        lengths = np.sort(rng.choice(np.arange(1, 60), rng.integers(3, 14), replace=False))
        counts = rng.integers(1, 9, len(lengths))
        b = int(rng.integers(1, 5))
        cost = lambda bounds: sum(c * (min(x for x in bounds if x >= v) - v) for v, c in zip(lengths, counts, strict=True))
        import itertools

        best = min(cost([*pick, lengths[-1]]) for pick in itertools.combinations(lengths[:-1], min(b, len(lengths)) - 1))
        got = packing.boundaries(lengths, counts, b)
        assert len(got) <= max(b, 1) and got[-1] == lengths[-1] and cost(got) == best


def test_every_item_once_within_capacity(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["en", "DE", None]), rng.choice([0, 3, 9, 40, 99, 100, 101, 250])) for i in range(400)] + [(5, "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_tokens long")
    one = {}
    for i, lang, n in rows:
        one[i] = max(one.get(i, (0, "")), (n, lang or ""))
    got = packing.packed(df, [(1, 100, None), (2, 64, "de"), (3, 0, None)], buckets=4).toPandas()
    for spec, cap, want in ((1, 100, None), (2, 64, "de")):
        g = got[got.spec_id == spec]
        docs = {i: n for i, (n, lang) in one.items() if want is None or lang.lower() == want}
        assert g.groupby("container_id").n_tokens.sum().max() <= cap
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == docs
        parts = g.groupby("doc_id").size()
        assert all(parts[i] == max(1, -(-n // cap)) for i, n in docs.items()) and not g.duplicated(["doc_id", "part"]).any()
    many = [(k, 90 + k, None) for k in range(7)]
    apart = packing.packed(df, many, buckets=4, at_once=2).groupBy("spec_id").count().collect()
    assert len(apart) == 7 and all(r["count"] >= 400 for r in apart)
    assert packing.packed(df.limit(0), [(1, 100, None)]).count() == 0 and packing.packed(df, []).count() == 0


def test_packing_leaves_little_room(spark, data):
    caps = {1: 512, 2: 2048, 3: 2048, 4: 8192}
    for r in packing.p8_report(spark, data).collect():
        assert r.n_containers <= 1.03 * r.n_tokens / caps[r.spec_id] + 2


# ---- 4 ------------------------------------------------------------------------------------------------------------

NAMES = ["Orsa", "Velt", "Mirrow", "Tandis"]


def ledger(spark, rows):
    return spark.createDataFrame(rows, "seen_id long, key string, url string, title string, first_seen string, week string")


def test_addresses(spark):
    same = [
        "https://www.a.example/news/1/x-y", "http://m.a.example:443/news/1/x%2Dy/?utm_source=q", "https://amp.a.example/news/1/x-y/amp",
        "https://a.example/print/news/1/x-y?output=1&view=full", "https://a.example/news/1/x-y/index.html#top", "https://A.example/news/1/x-y?share=1",
    ]
    other = ["https://a.example/news/2/x-y", "https://b.example/news/1/x-y", "https://a.example/news/1/x-y?id=3"]
    df = spark.createDataFrame([(u,) for u in same + other + ["", None]], "u string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(history.page_address(F.col("u"))).collect()]
    assert len(set(got[:6])) == 1 and len(set(got[:9])) == 4 and got[9:] == [None, None]


def test_stories(spark):
    filler = [(100 + i, f"k{i}", "", f"Word {NAMES[i % 4]} opened the {w} library of {NAMES[(i + 1) % 4]} number {i}", "2026-01-05T00:00:00+00:00", None) for i, w in enumerate(["quiet", "large", "early", "sparse"] * 5)]
    t = "2026-0{}-05T00:00:00+00:00".format
    rows = filler + [
        (1, "AB-1", "https://a.example/1", "Why Orsax opened the quiet library of Veltu", t(1), "2026-W02"),
        (2, "ab1", "", "Different Mirrowx text entirely", t(2), None),  # same key
        (3, "zz", "https://m.a.example/1/amp", "Nothing Tandisy alike", t(3), "x"),  # same page
        (4, "yy", "https://c.example/9", "Why Orsax opened the large library of Veltu", t(4), None),  # one ordinary word
        (5, "xx", "https://c.example/10", "WHY ORSAX OPENED THE QUIET LIBRARY OF VELTU | The Wire", t(4), None),  # source name added
        (6, "ww", "https://c.example/11", "Why Orsay opened the quiet library of Veltu", t(4), None),  # another name
        (7, "vv", "https://c.example/12", "Word Orsa opened the quiet library of Velt number 0", t(4), None),  # row 100's title
        (8, "uu", "https://c.example/13", "Word Orsa opened the quiet library of Velt number 77", t(4), None),  # another number
        (9, None, None, None, None, None), (10, "", "", "", "not a date", "2026-W01"),
        (1, "AB-1", "https://a.example/1", "Why Orsax opened the quiet library of Veltu", t(1), "2026-W02"),
        (11, "tt", "https://c.example/14", "x " * 3000, t(4), None),
    ]
    sources = spark.createDataFrame([("The Wire",), (None,)], "source string")
    df = ledger(spark, rows).withColumn("story", history.F.lit("clash")).drop("story")
    got = {(r.seen_id_a, r.seen_id_b) for r in history.pairs(history.told_in_batches(df, sources)).collect()}
    assert {p for p in got if p[0] < 7} == {(1, 2), (1, 3), (1, 4), (1, 5)} and {p for p in got if p[0] >= 7} == {(7, 100)}
    assert history.pairs(history.told_in_batches(df.limit(0), sources)).count() == 0


def brute_stories(spark, rows, sources):
    """Pairs by union-find over all rows; titles are compared with each other word by word."""
    p = [r for r in history.prepared(rows, sources).distinct().collect()]
    counts = {r.word: r.low * 2 > r["all"] for r in history.word_counts(history.prepared(rows, sources).filter("bare is not null")).collect()}
    up = {r.node: r.node for r in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def less(ws):
        out = set()
        for k in range(3):
            if len(ws) - k > max(2, k):
                free = [i for i, w in enumerate(ws) if counts.get(w)]
                out |= {tuple(w for i, w in enumerate(ws) if i not in gone) for gone in itertools.combinations(free, k)}
        return out

    forms = [less(r.ws) if r.t is not None else set() for r in p]
    for i, x in enumerate(p):
        for j in range(i):
            y = p[j]
            if any(x[c] is not None and x[c] == y[c] for c in "kut") or forms[i] & forms[j]:
                up[find(x.node)] = find(y.node)
    stories = defaultdict(list)
    for r in p:
        stories[find(r.node)].append((r.week_no, r.seen_id))
    out = set()
    for s in stories.values():
        w, first = min(s)
        out |= {tuple(sorted((first, i))) for v, i in s if v > w and i != first}
    return out


def test_stories_against_brute_force_whatever_the_batches(spark, data):
    rows, sources = history._rows(spark, data)
    pairs = lambda weeks: {tuple(r) for r in history.pairs(history.told_in_batches(rows, sources, weeks)).collect()}
    want = brute_stories(spark, rows, sources)
    assert want and pairs(1000) == want and pairs(12) == want  # 12: at least six batches


def weekly(spark, sources, batches):
    state = history.History(spark, buckets=2)
    got = [{r.seen_id: r.first_id for r in state.add(ledger(spark, b), sources).collect()} for b in batches]
    state.close(delete=True)
    return got


def test_merges_are_carried_on(spark):
    sources = spark.createDataFrame([("The Wire",)], "source string")
    t = "2026-01-{:02d}T00:00:00+00:00".format
    rows = [
        (1, "k1", "", "", t(5), None), (2, "k2", "https://a.example/u2", "", t(12), None), (3, "k1", "https://a.example/u2", "", t(19), None),
        (4, "k2", "", "", t(26), None), (5, "k5", "https://a.example/u5", "", t(27), None), (6, "k5", "https://a.example/u2", "", t(28), None), (7, "", "https://a.example/u5", "", t(29), None),
    ]
    got = weekly(spark, sources, [[r] for r in rows])
    assert [g[i] for i, g in enumerate(got, 1)] == [1, 2, 1, 1, 5, 1, 1]


def test_words_that_turn_ordinary_link_old_titles(spark):
    sources = spark.createDataFrame([("The Wire",)], "source string")
    t = "2026-01-{:02d}T00:00:00+00:00".format
    filler = [(100 + i, f"f{i}", "", f"Tandis said a {w} plan of Mirrow number {i} was kept", t(12), None) for i, w in enumerate(["quiet", "large"] * 3)]
    first = [(1, "a", "", "Orsa Opened Its Quiet Library Of Velt", t(5), None)]
    second = [(2, "b", "", "ORSA OPENED ITS LARGE LIBRARY OF VELT", t(12), None), *filler]
    got = weekly(spark, sources, [first, second, [(3, "c", "", "Orsa Opened Its Quiet Library Of Velt | The Wire", t(19), None)]])
    assert got[1][2] == 1 and got[2][3] == 1
    assert brute_stories(spark, ledger(spark, first + second), sources) == {(1, 2)}


def test_history_is_not_shuffled(spark, data):
    rows, sources = history._rows(spark, data)
    state = history.History(spark, buckets=4)
    state.add(rows, sources)
    keys = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.range(1000).selectExpr("id AS h").repartition(3)
        plan = state._read("hashes").join(batch, "h")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keys)
        state.close(delete=True)
    side = plan[plan.index("hashes") - 1500 : plan.index("hashes")] if "hashes" in plan else plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, side


def test_long_titles_have_all_their_variants():
    rng = random.Random(4)
    ws = [f"w{rng.randint(0, 50)}" for _ in range(60)]
    free = [i for i in range(60) if i % 3]
    got = np.concatenate(list(history.variant_hashes(ws, free)))
    assert len(got) == 1 + len(free) + len(free) * (len(free) - 1) // 2
    cut_ws = [w for i, w in enumerate(ws) if i not in (1, 58)]
    assert np.concatenate(list(history.variant_hashes(cut_ws, [])))[0] in got
    assert sum(len(x) for x in history.variant_hashes(["w"] * 3000, list(range(2000)))) == 1 + 2000 + 2000 * 1999 // 2


def test_a_large_vocabulary_gives_the_same_pairs(spark, data, monkeypatch):
    rows, sources = history._rows(spark, data)
    pairs = lambda: {tuple(r) for r in history.pairs(history.told_in_batches(rows, sources, 1000)).collect()}
    want = pairs()
    monkeypatch.setattr(history, "VOCABULARY", 0)
    assert want and pairs() == want


@pytest.mark.parametrize("name", ["p6_counts", "p9_items", "p5_blocks", "p8_checks"])
def test_reports_against_sql(spark, data, name):
    from pressloom.llm.queries import ORACLES, QUERIES

    compare(QUERIES[name](spark, data), views(data), ORACLES[name])


def test_the_newest_week_as_a_batch(spark, data):
    """Every row of the newest week and every undated one, once, with the first row that p4_found pairs it with."""
    rows, _ = history._rows(spark, data)
    weeks = {r.seen_id: r.w for r in rows.select("seen_id", history.iso_week(history.F.col("first_seen"), history.F.col("week")).alias("w")).collect()}
    last = max(w for w in weeks.values() if w < 999_999)
    got = {r.seen_id: (r.first_id, r.undated) for r in history.p4_batch(spark, data).collect()}
    assert set(got) == {i for i, w in weeks.items() if w >= last} and all(u == (weeks[i] == 999_999) for i, (_, u) in got.items())
    pairs = {tuple(r) for r in history.p4_found(spark, data).collect()}
    found = {tuple(sorted((i, f))) for i, (f, _) in got.items() if f is not None}
    assert found <= pairs and {p for p in pairs if p[0] in got and weeks[p[0]] > weeks[p[1]] or p[1] in got and weeks[p[1]] > weeks[p[0]]} == found
