import datetime as dt

from pyspark.sql import functions as F

from pressloom.operators.state import Ledger
from pressloom.streaming.incremental import run_available, suppress_repeats, weekly_counts

SCHEMA = "ord long, source string, source_type string, title string, url string, published timestamp"


def items(spark, *rows):
    return spark.createDataFrame([(i, "A", "rss", "t", u, dt.datetime(2026, 1, 1 + d)) for i, u, d in rows], SCHEMA)


def test_incremental_run_and_ledger(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    items(spark, (1, "https://a.example/1", 0), (2, "https://www.a.example/1?ref=x", 1), (3, "https://a.example/2", 2)).write.parquet(src)
    run_available(spark, src, SCHEMA, ledger, out, ck, "2026-W01").awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(out).collect()) == [1, 3] and ledger.read().count() == 2
    items(spark, (4, "https://a.example/1/", 9), (5, "https://a.example/9", 9)).write.mode("append").parquet(src)
    run_available(spark, src, SCHEMA, ledger, out, ck, "2026-W02").awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(out).collect()) == [1, 3, 5]
    assert {r.week for r in ledger.read().collect()} == {"2026-W01", "2026-W02"}


def test_windows_and_suppression(spark, tmp_path):
    src = str(tmp_path / "in")
    items(spark, (1, "https://a.example/1", 4), (2, "https://a.example/1", 5), (3, "https://a.example/3", 12)).write.parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    for name, df, mode in (("once", suppress_repeats(stream()), "append"), ("weeks", weekly_counts(stream()), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    got = {str(r.week.start.date()): r.n_items for r in spark.table("weeks").collect()}
    assert got == {"2026-01-05": 2, "2026-01-12": 1}
    assert spark.table("weeks").filter(F.col("source") == "A").count() == 2
