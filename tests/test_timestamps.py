import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressloom.operators.timestamps import parser, to_utc_micros, wall_offset

UTC = dt.timezone.utc


def us(*a, zone=UTC, micro=0):
    return int((dt.datetime(*a, tzinfo=zone) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + micro


NY, BERLIN, KOLKATA = "America/New_York", "Europe/Berlin", "Asia/Kolkata"
CASES = [
    ("2025-03-22T15:31:15Z", NY, us(2025, 3, 22, 15, 31, 15)),
    ("2025-08-02T18:56:09.217+0530", NY, us(2025, 8, 2, 13, 26, 9, micro=217000)),
    ("2025-08-24T12:53:04.5668160Z", None, us(2025, 8, 24, 12, 53, 4, micro=566816)),
    ("2026-01-17T00:29:01.561500042Z", None, us(2026, 1, 17, 0, 29, 1, micro=561500)),
    ("Sun, 19 Jan 2025 03:51:39 GMT", KOLKATA, us(2025, 1, 19, 3, 51, 39)),
    ("Tue, 19 Aug 25 18:19:58 +0000", None, us(2025, 8, 19, 18, 19, 58)),
    ("Apr 1, 2025, 11:19 AM PDT", None, us(2025, 4, 1, 18, 19)),
    ("Jan 1, 2025, 12:00 a.m. EST", None, us(2025, 1, 1, 5)),
    ("2025-04-15 15:06 GMT+1", None, us(2025, 4, 15, 14, 6)),
    ("2025-12-09 10:05 UTC+5:30", None, us(2025, 12, 9, 4, 35)),
    ("2025-04-23T19:07:33+01:00[Europe/London]", NY, us(2025, 4, 23, 18, 7, 33)),
    ("2026-02-10 12:41:57 Asia/Kolkata", NY, us(2026, 2, 10, 7, 11, 57)),
    ("2025-11-02 01:30:00", NY, us(2025, 11, 2, 5, 30)),  # twice: the earlier
    ("2025-03-09 02:30:00", NY, us(2025, 3, 9, 7, 30)),  # skipped: forward by the gap
    ("2025-03-22", BERLIN, us(2025, 3, 21, 23)),
    ("17/06/2025 22:36", None, us(2025, 6, 17, 22, 36)),
    ("5/14/2025 9:12 AM", None, us(2025, 5, 14, 9, 12)),
    ("03.04.2026 14:54", None, us(2026, 4, 3, 14, 54)),
    ("30. Mai 2026, 03:51 Uhr", BERLIN, us(2026, 5, 30, 1, 51)),
    ("22 mars 2026 à 05h23", None, us(2026, 3, 22, 5, 23)),
    ("11 de agosto de 2025 às 09h20", None, us(2025, 8, 11, 9, 20)),
    ("24 de mayo de 2025, 18:51", None, us(2025, 5, 24, 18, 51)),
    ("  1758239076  ", NY, 1758239076000000),
    ("1761834885199", NY, 1761834885199000),
    ("1778712355.5", NY, 1778712355500000),
    ("20250921T010626Z", NY, us(2025, 9, 21, 1, 6, 26)),
    ("20250921", None, us(2025, 9, 21)),
    ("10/Oct/2025:13:55:36 -0700", None, us(2025, 10, 10, 20, 55, 36)),
] + [(v, NY, None) for v in ("2025-02-30", "0000-00-00 00:00:00", "2025-13-04T10:00:00Z", "3 hours ago", "vor 2 Stunden", "soon", "", "  ", "-", "n/a", "Invalid Date", "2025", None, "x" * 5000)]


def test_cases_nulls_repeats_and_extra_columns(spark):
    rows = [(k, v, z, "kept") for k, (v, z, _) in enumerate(CASES + CASES[:3])]
    df = spark.createDataFrame(rows, "id int, v string, z string, mask string").selectExpr("*", "'old' AS utc_us")
    got = {r.id: r for r in to_utc_micros(df, "v", "z").collect()}
    assert len(got) == len(rows) and all(r.mask == "kept" for r in got.values())
    wrong = [(c[0], got[k].utc_us, c[2]) for k, c in enumerate(CASES + CASES[:3]) if got[k].utc_us != c[2]]
    assert not wrong


def test_empty_table(spark):
    assert to_utc_micros(spark.createDataFrame([], "v string, z string"), "v", "z").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2037, 12, 1)), st.sampled_from([NY, BERLIN, KOLKATA, "Australia/Sydney", "America/Sao_Paulo"]))
def test_wall_times_agree_with_zoneinfo(t, zone):
    import numpy as np

    wall = int((t - dt.datetime(1970, 1, 1)).total_seconds())
    got = int(wall_offset(np.array([wall]), zone)[0])
    assert got == int(t.replace(tzinfo=ZoneInfo(zone), fold=0).utcoffset().total_seconds())


@pytest.mark.parametrize("form", ["%Y-%m-%dT%H:%M:%SZ", "%a, %d %b %Y %H:%M:%S +0000", "%B %d, %Y %I:%M:%S %p", "%d.%m.%Y %H:%M:%S", "%Y%m%dT%H%M%S"])
def test_round_trip(form):
    import numpy as np
    import pyarrow as pa
    import re

    for day in range(0, 20000, 611):
        t = dt.datetime(1971, 1, 1, 13, 5, 9) + dt.timedelta(days=day)
        v = t.strftime(form)
        mask = re.sub(r"\d", "9", re.sub(r"[^\W\d_]+", "A", v))
        assert parser(mask).parse(pa.array([v]), np.array([None], object))[0] == us(*t.timetuple()[:6])


def test_dates_after_the_tables_follow_the_last_rule():
    for year in (2099, 2100, 2150, 2467, 2600, 3001, 9000):
        for month in (1, 7):
            wall = dt.datetime(year, month, 15, 12)
            want = int(wall.replace(tzinfo=ZoneInfo(BERLIN)).utcoffset().total_seconds())
            s = np.array([int((wall - dt.datetime(1970, 1, 1)).total_seconds())])
            assert wall_offset(s, BERLIN)[0] == want
