"""Grouping items about one event.

``leader_clusters`` is the exact sequential method: items in rank order join the first cluster whose signature (the
union of its members' headline tokens) is similar. It is sequential by nature, so one task takes all items of a window
(week): the largest window bounds it. ``similar_pairs`` and ``event_components`` are the scalable relatives without
order: candidate pairs come from shared rare tokens.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.text import similar, title_tokens
from pressloom.operators.graph import components
from pressloom.operators.items import global_index
from pressloom.runtime import cut, hot_join, salted_join, small_side


def _leader(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["rank_a", "rank_b", "ord"], ascending=[False, False, True], kind="stable")
    signatures: list[set[str]] = []
    holders: dict[str, list[int]] = {}
    out = []
    for tokens in pdf["tokens"]:
        mine, found = set(tokens), None
        if mine:
            shared: dict[int, int] = {}
            for t in mine:
                for c in holders.get(t, ()):
                    shared[c] = shared.get(c, 0) + 1
            for c in sorted(shared):
                n, s = shared[c], signatures[c]
                small, union = min(len(mine), len(s)), len(mine) + len(s) - n
                if 2 * n >= union or (10 * n >= 8 * small and n >= 3):
                    found = c
                    break
        if found is None:
            found = len(signatures)
            signatures.append(set())
        for t in mine - signatures[found]:
            holders.setdefault(t, []).append(found)
        signatures[found] |= mine
        out.append(found)
    return pd.DataFrame({"window": pdf["window"].to_numpy(), "ord": pdf["ord"].to_numpy(), "cluster": out, "position": range(len(out))})


def leader_clusters(items: DataFrame, window: str) -> DataFrame:
    """window, ord, cluster (founding order from 0), position (rank within the window).

    ``items``: ord, title, rank_a, rank_b (both descending, ties by ord) and the window column. All items are clustered.
    Null windows form one window; a title without tokens founds its own cluster.
    """
    toks = items.select(F.coalesce(F.col(window), F.lit("")).alias("window"), "ord", "rank_a", "rank_b", title_tokens(F.col("title")).alias("tokens"))
    return toks.groupBy("window").applyInPandas(_leader, "window string, ord long, cluster long, position long")


def rank_clusters(members: DataFrame) -> DataFrame:
    """window, cluster, importance (the largest), size, founder_ord, rank: by importance, size, founding order.

    ``members``: window, cluster, ord, position, importance."""
    c = members.groupBy("window", "cluster").agg(
        F.max("importance").alias("importance"), F.count(F.lit(1)).alias("size"), F.min_by("ord", "position").alias("founder_ord")
    )
    w = Window.partitionBy("window").orderBy(F.desc("importance"), F.desc("size"), "cluster")
    return c.withColumn("rank", F.row_number().over(w))


def ordered_sources(members: DataFrame) -> DataFrame:
    """window, cluster, sources: distinct, in order of first appearance (a minimum per source before collecting)."""
    firsts = members.groupBy("window", "cluster", "source").agg(F.min("position").alias("p"))
    seq = F.array_sort(F.collect_list(F.struct("p", "source")))
    return firsts.groupBy("window", "cluster").agg(F.transform(seq, lambda x: x["source"]).alias("sources"))


def distinct_titles(items: DataFrame) -> DataFrame:
    """t (hash), tokens: one row for each set of headline tokens; copies collapse here, before any pairing."""
    toks = items.select(F.array_sort(title_tokens(F.col("title"))).alias("tokens")).filter(F.size("tokens") > 0)
    return toks.distinct().withColumn("t", F.xxhash64("tokens"))


#: Smaller sets under one key, and pairs of one key, beyond which the key gets one more token.
FEW, MOST = 128, 4_000_000

#: Least size of what a smaller set, and sets of na <= nb tokens, must share to be similar (SQL over n, and over na and nb).
_LEAST, _NEED = "((2 * n + 2) div 3)", "least((na + nb + 2) div 3, greatest(3, (4 * na + 4) div 5))"


def ordered_titles(titles: DataFrame) -> DataFrame:
    """t, tokens and their hashes h, both rarest first (document frequency, then the token), n, alone (tokens of no other
    title, the first ones), s and u: the hashes as 128 bits. Written once. ``titles``: t, tokens, a written table."""
    tokens = titles.select("t", F.explode("tokens").alias("w"))
    df = tokens.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    o = tokens.join(df, "w").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    h = o.select("t", F.col("o.w").alias("tokens"), F.size("o").alias("n"), F.size(F.filter("o", lambda x: x["df"] == 1)).alias("alone"))
    h = h.withColumn("h", F.transform("tokens", lambda w: F.xxhash64(w)))
    bits = lambda half: F.expr(f"aggregate(h, 0L, (z, x) -> z | if((x & 64) = {half}, shiftleft(1L, cast(x & 63 as int)), 0L))")
    return cut(h.withColumns({"s": bits(0), "u": bits(64)}))


def _meet(rows: DataFrame, k: int) -> DataFrame:
    """a, b: a smaller set and another one that meet under a key of k tokens and that neither sizes, places nor bits tell apart."""
    left = rows.filter("x").select("key", *[F.col(c).alias(c + "a") for c in ("t", "n", "at", "s", "u")])
    right = rows.select("key", *[F.col(c).alias(c + "b") for c in ("t", "n", "at", "s", "u")])
    missing = lambda p, q: f"bit_count(s{p} & ~s{q}) + bit_count(u{p} & ~u{q}) <= n{p} - need"
    told = f"(na < nb or (na = nb and ta < tb)) and {k} + least(na - ata, nb - atb) >= need and {missing('a', 'b')} and {missing('b', 'a')}"
    return left.join(right.hint("merge"), "key").filter(told.replace("need", _NEED)).select(F.col("ta").alias("a"), F.col("tb").alias("b"))


def candidates(titles: DataFrame, few: int = FEW, most: int = MOST) -> DataFrame:
    """a, b: pairs among which are all similar ones of ``ordered_titles``; a pair may come more than once.

    The key of a pair is its rarest shared token, then its two rarest, and so on. A key under which at most ``few`` smaller
    sets and ``most`` pairs meet is joined; any other is given every further token, so that the pairs that are looked at stay
    in proportion to the rows however common a token is. The i-th rarest of m shared tokens stands at n - m + i or before in
    either set. Sets whose k tokens of a common key already suffice are similar and paired under it.
    """
    rows = titles.select("t", "n", "alone", "s", "u", F.posexplode("h").alias("at", "key")).withColumn("at", F.col("at") + 1).filter("at > alone")
    rows, k, found = rows.drop("alone").withColumn("x", F.expr(f"at <= n - {_LEAST} + 1")), 1, []
    while True:
        met = rows.groupBy("key").agg(F.count_if("x").alias("nx"), F.count(F.lit(1)).alias("ny"), F.min(F.when(F.col("x"), F.col("n"))).alias("na"))
        hot = cut(met.filter((F.col("nx") > few) | (F.col("nx") * F.col("ny") > most)).filter("nx > 0").select("key", "na"))
        least = hot.agg(F.min("na")).first()[0]  # one number
        if least is None:
            found.append(_meet(rows, k))
            return reduce(DataFrame.unionByName, found)
        few_hot = small_side(hot, 200_000)
        found.append(cut(_meet(rows.join(few_hot, "key", "left_anti"), k)))
        need = _NEED.replace("nb", "n")  # of the least set under the key: the least that this one must share
        warm = cut(rows.join(few_hot, "key").withColumn("last", F.expr(f"n - {need} + {k + 1}")))
        if (2 * least + 2) // 3 <= k:
            done = warm.filter(f"x and {_LEAST} <= {k}").select("key", F.col("t").alias("a"), F.col("n").alias("na"))
            other = warm.filter(f"{need} <= {k}").select("key", F.col("t").alias("b"), F.col("n").alias("nb"))
            same = salted_join(other, done, ["key"], "b").filter("na < nb or (na = nb and a < b)").filter(f"{_NEED} <= {k}")
            found.append(cut(same.select("a", "b").distinct()))
        more = warm.filter("last > at").join(titles.select("t", "h"), "t")
        more = more.select("t", "n", "s", "u", "key", "at", "x", F.posexplode(F.expr("slice(h, at + 1, last - at)")).alias("i", "w"))
        rows = more.select(
            "t", "n", "s", "u", F.xxhash64("key", "w").alias("key"), (F.col("at") + F.col("i") + 1).alias("at"),
            F.expr(f"x and greatest(3, (4 * n + 4) div 5) > {k} and at + i + 1 <= n - {_LEAST} + {k + 1}").alias("x"),
        )
        rows, k = cut(rows), k + 1


def similar_titles(titles: DataFrame, few: int = FEW, most: int = MOST) -> DataFrame:
    """a, b (a < b), ta, tb (their tokens): pairs of ``titles`` (t, tokens; a written table) that are similar. Complete, by
    prefix filtering with keys as long as needed.

    A pair that is similar shares at least 2/3 of the smaller set by the first rule (3 x shared >= |x| + |y| >= 2 |x|) and
    4/5 of it by the second, so it shares one of the |x| - ceil(2 |x| / 3) + 1 rarest tokens of the smaller set x under one
    global order (document frequency, then the token), and so on for its two rarest shared tokens (``candidates``).
    """
    o = ordered_titles(titles)
    cand = candidates(o, few, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = cand.join(o.select(F.col("t").alias("a"), F.col("tokens").alias("ta")), "a").join(o.select(F.col("t").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.filter(similar(F.col("ta"), F.col("tb"))).select("a", "b", "ta", "tb")


def similar_pairs(items: DataFrame, few: int = FEW, most: int = MOST) -> DataFrame:
    """a, b (a < b): pairs of distinct token sets of the items' titles that are similar."""
    return similar_titles(cut(distinct_titles(items)), few, most).select("a", "b")


def event_components(items: DataFrame, few: int = FEW, most: int = MOST) -> DataFrame:
    """ord, event (the smallest ord of its items), n_links (of its headline with other headlines), n_items: connected components
    of similar headlines, one row per item; items without tokens stand alone. Not the sequential method."""
    rows = items.select("ord", F.array_sort(title_tokens(F.col("title"))).alias("tokens"))
    rows = cut(rows.withColumn("t", F.when(F.size("tokens") > 0, F.xxhash64("tokens")).otherwise(F.xxhash64(F.lit("alone"), "ord"))))
    pairs = cut(similar_titles(cut(rows.filter(F.size("tokens") > 0).select("t", "tokens").distinct()), few, most).select("a", "b"))
    parts = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_links"))
    linked = cut(parts.withColumnRenamed("node", "t").join(links, "t"))  # each headline of a pair has both
    parted = cut(hot_join(rows.select("ord", "t"), linked, "t").select("ord", F.coalesce("component", "t").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    events = cut(parted.groupBy("c").agg(F.min("ord").alias("event"), F.count(F.lit(1)).alias("n_items")))
    return hot_join(parted, events, "c", "inner").select("ord", "event", "n_links", "n_items")


def missing_rank(rows: DataFrame) -> DataFrame:
    """index, k: position among the rows left over."""
    return global_index(rows, [F.col("index").asc()], "k")


def resolve_members(groups: DataFrame, n_items: DataFrame) -> DataFrame:
    """index, grp: the group of every item under a grouping reply (grp, members array).

    Members out of range or already taken by an earlier group are ignored (an index repeated within a group counts
    once); items that no group names become groups of their own, after all others, in order. ``n_items``: index."""
    named = groups.select("grp", F.explode("members").alias("index")).groupBy("index").agg(F.min("grp").alias("grp"))
    kept = n_items.select("index").distinct().join(named, "index", "left")
    top = groups.agg(F.coalesce(F.max("grp") + 1, F.lit(0))).first()[0]  # one number
    singles = missing_rank(kept.filter("grp is null").select("index")).select("index", (F.lit(top) + F.col("k")).cast("long").alias("grp"))
    return kept.filter("grp is not null").select("index", F.col("grp").cast("long").alias("grp")).unionByName(singles)
