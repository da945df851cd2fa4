import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressloom.operators import providers
from pressloom.operators.providers import Refused, triage

NOW = dt.datetime(2026, 3, 1)


def tables(spark):
    items = spark.createDataFrame([(i, f"k{i}", f"title {i}") for i in range(7)], "ord long, key string, title string")
    rows = [("k0", dt.datetime(2026, 2, 20), True, 5, "research", "old"), ("k1", dt.datetime(2025, 1, 1), True, 5, "research", "aged"), ("k2", dt.datetime(2026, 2, 20), None, None, None, None)]
    return items, spark.createDataFrame(rows, "key string, created timestamp, ai_related boolean, importance int, topic string, one_liner string")


def test_cache_batches_and_failures(spark):
    def provider(batch):
        if any(p["ord"] == 5 for p in batch):
            raise ValueError("busy")
        return [{"index_in_batch": p["index_in_batch"], "ai_related": True, "importance": 9, "topic": "other", "one_liner": p["title"]} for p in batch[:-1]] + [{"index_in_batch": 99}]

    items, cache = tables(spark)
    judged, failed = triage(items, cache, provider, F.lit(NOW), [F.col("ord")], size=2)
    got = {r.ord: (r.importance, r.one_liner) for r in judged.collect()}
    # misses are 1..6 in batches (1, 2), (3, 4), (5, 6): the last of each is unanswered, the third call fails
    assert got == {0: (5, "old"), 1: (5, "title 1"), 3: (5, "title 3")}
    assert [r.error for r in failed.collect()] == ["ValueError: busy"]


def test_refused_credentials_stop_the_run(spark):
    def provider(batch):
        raise Refused("key")

    items, cache = tables(spark)
    with pytest.raises(Exception, match="Refused"):
        triage(items, cache, provider, F.lit(NOW), [F.col("ord")])[0].collect()


def test_grouping_falls_back_to_single_stories():
    some = [{"title": t, "source": "S", "topic": "other", "importance": i, "one_liner": ""} for t, i in (("A", 2), ("B", 5), ("C", 2), ("D", 1))]
    reply = lambda payload: [{"members": [2, 0, 0, 9, -1]}, {"headline": "H", "importance": 3, "members": [0, 3]}]
    got = providers.grouped(some, reply)
    assert [(c["headline"], c["importance"], c["members"]) for c in got] == [("B", 5, [1]), ("H", 3, [3]), ("C", 2, [2, 0])]

    def broken(payload):
        raise RuntimeError("no reply")

    assert [c["members"] for c in providers.grouped(some, broken)] == [[0], [1], [2], [3]]
    assert providers.grouped(some[:1], broken)[0]["headline"] == "A" and providers.grouped([], broken) == []

    def refused(payload):
        raise providers.Refused("key")

    with pytest.raises(providers.Refused):
        providers.grouped(some, refused)


def test_writing_shrinks_and_falls_back():
    sizes = []

    def payload_of(n):
        sizes.append(n)
        return {"body": "x" * n}

    assert providers.written(payload_of, lambda s: f"{len(s)}", lambda: "plain", per_item=4000, limit=2500) == str(len('{"body": ""}') + 2000)

    def broken(s):
        raise RuntimeError("no reply")

    assert providers.written(payload_of, broken, lambda: "plain") == "plain"
