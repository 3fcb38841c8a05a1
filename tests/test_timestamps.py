from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.zones import US, build_zone_table
from corvane.operators.timestamps import compile_mask, is_exact_utc, normalise_timestamps

ZONES = [("yt", "America/Los_Angeles", "mdy"), ("forum", "Europe/Berlin", "dmy"), ("reddit", "UTC", "ymd"), ("store", "Asia/Kolkata", "dmy")]
NAMES = [("PST", -480), ("CEST", 120), ("UTC", 0), ("IST", 330)]


@pytest.fixture
def run(spark):
    zones = spark.createDataFrame(ZONES, "source string, home_zone string, date_order string")
    names = spark.createDataFrame(NAMES, "abbr string, utc_offset_min int")

    def go(cases, **more):
        rows = [(f"c{i}", s, t) for i, (s, t) in enumerate(cases)]
        frame = spark.createDataFrame(rows, "source_id string, source string, timestamp string")
        found = {r.source_id: r.utc_ts for r in normalise_timestamps(frame, zones, names, **more).collect()}
        return [found.get(f"c{i}") for i in range(len(cases))]

    return go


CASES = [
    ("yt", "2023-01-01T00:00:00Z", "2023-01-01T00:00:00.000000Z"),
    ("yt", "2023-06-01 12:00:00", "2023-06-01T19:00:00.000000Z"),
    (" YT ", "06/01/2023 12:00 PM", "2023-06-01T19:00:00.000000Z"),
    ("forum", "01/06/2023 12:00", "2023-06-01T10:00:00.000000Z"),
    ("forum", "1.6.23 12:00 AM", "2023-05-31T22:00:00.000000Z"),
    ("reddit", "23/06/01 12:00", "2023-06-01T12:00:00.000000Z"),
    ("yt", "12 Mar 2023 04:05:06 PST", "2023-03-12T12:05:06.000000Z"),
    ("yt", "Sun, 12 Mar 2023 04:05:06 +0530", "2023-03-11T22:35:06.000000Z"),
    ("yt", "2023-03-12T04:05:06.1234567+05:45", "2023-03-11T22:20:06.123456Z"),
    ("yt", "2023-03-12t04:05:06,5 -05", "2023-03-12T09:05:06.500000Z"),
    ("yt", "2023-W10-7T04:05:06+00:00", "2023-03-12T04:05:06.000000Z"),
    ("yt", "2023-071T04:05:06+00:00", "2023-03-12T04:05:06.000000Z"),
    ("yt", "20230312T040506Z", "2023-03-12T04:05:06.000000Z"),
    ("forum", "20230612040506", "2023-06-12T02:05:06.000000Z"),
    ("forum", "11. März 2023, 03:32 Uhr", "2023-03-11T02:32:00.000000Z"),
    ("forum", "21 de enero de 2023 05:39", "2023-01-21T04:39:00.000000Z"),
    ("forum", "January 5, 2023 10:46 PM", "2023-01-05T21:46:00.000000Z"),
    ("forum", "26 Mar 2023", "2023-03-25T23:00:00.000000Z"),
    ("yt", "2023-06-01 12:00:00[Europe/London]", "2023-06-01T11:00:00.000000Z"),
    ("yt", "2023-06-01T12:00:00 (UTC)", "2023-06-01T12:00:00.000000Z"),
    ("yt", "2023-02-13 15:23:57 America/Los_Angeles", "2023-02-13T23:23:57.000000Z"),
    ("forum", "2023-02-13T15:23:57 America/Los_Angeles", "2023-02-13T23:23:57.000000Z"),
    ("yt", "2023-02-13 15:23:57 Asia/Kolkata", "2023-02-13T09:53:57.000000Z"),
    ("yt", "2023-02-13T15:23:57 Asia/Kolkata", "2023-02-13T09:53:57.000000Z"),
    ("yt", "2023-02-13 03:23:57 PM Asia/Kolkata", "2023-02-13T09:53:57.000000Z"),
    ("yt", "2023-11-05 01:30:00 America/Los_Angeles", "ambiguous"),
    ("yt", "2023-02-13 15:23:57 Nowhere/Atall", "unreadable"),
    ("yt", "2023-02-13T15:23:57." + "1234567890" * 10 + "Z", "2023-02-13T15:23:57.123456Z"),
    ("yt", "2023-02-13T15:23:57." + "1" * 200 + "Z", "unreadable"),
    ("yt", "1672553429", "2023-01-01T06:10:29.000000Z"),
    ("yt", "1672553429123", "2023-01-01T06:10:29.123000Z"),
    ("yt", "1672553429123456", "2023-01-01T06:10:29.123456Z"),
    ("yt", "1672553429123456789", "2023-01-01T06:10:29.123456Z"),
    ("yt", "２０２３-０１-０２T２３:０５:４３Z", "2023-01-02T23:05:43.000000Z"),
    ("yt", "२०२३-०१-०४T००:२२:१९Z", "2023-01-04T00:22:19.000000Z"),
    ("yt", "\t'2023-01-04T00:22:19Z' ", "2023-01-04T00:22:19.000000Z"),
    ("yt", "2023-03-12 02:30:00", "skipped"),
    ("yt", "2023-11-05 01:30:00", "ambiguous"),
    ("yt", "2023-11-05 01:30:00 PST", "2023-11-05T09:30:00.000000Z"),
    ("forum", "2023-10-29 02:30:00[Europe/Berlin]", "ambiguous"),
    ("yt", "2023-02-30T08:51:00Z", "unreadable"),
    ("yt", "2023-01-01T24:00:00Z", "unreadable"),
    ("yt", "13/24/2024 10:00", "unreadable"),
    ("yt", "13:61 PM", "unreadable"),
    ("yt", "20 hours ago", "unreadable"),
    ("yt", "", "unreadable"),
    ("yt", "   ", "unreadable"),
    ("yt", "2023-01-01 00:00:00 XYZ", "unreadable"),
    ("yt", "x" * 100_000, "unreadable"),
    ("nobody", "2023-06-01 12:00:00", "unreadable"),
    (None, "2023-06-01 12:00:00", "unreadable"),
    (None, "2023-06-01 12:00:00Z", "2023-06-01T12:00:00.000000Z"),
    ("yt", "1999-01-01T00:00:00Z", "unreadable"),
    ("yt", None, None),
]


def test_forms(run):
    assert run([c[:2] for c in CASES]) == [c[2] for c in CASES]


def test_wall_clocks_against_zoneinfo():
    """Every wall clock of random minutes agrees with what zoneinfo makes of both folds."""
    table, draw = build_zone_table(2021, 2027, ["America/New_York", "Australia/Lord_Howe", "Europe/Berlin", "Asia/Kolkata", "Africa/Casablanca"]), random.Random(3)
    for name in table.rules:
        zone = ZoneInfo(name)
        moments = [datetime(2022, 1, 1) + timedelta(minutes=draw.randrange(5 * 525_600)) for _ in range(3000)]
        for since in table.rules[name][0][1:]:
            moments += [datetime(1970, 1, 1) + timedelta(seconds=int(since) + int(o) + d) for o in table.rules[name][1] for d in (-3600, -1, 0, 1, 1800)]
        local = np.array([int((m - datetime(1970, 1, 1)).total_seconds()) * US for m in moments])
        instants, found = table.to_utc(name, local)
        for m, instant, n in zip(moments, instants, found):
            possible = {d.astimezone(timezone.utc) for f in (0, 1) if (d := m.replace(tzinfo=zone, fold=f)).astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None) == m}
            assert n == len(possible), (name, m)
            if n == 1:
                assert instant == int(possible.pop().timestamp()) * US


def test_masks_compile_once():
    compile_mask.cache_clear()
    for _ in range(5):
        assert compile_mask("9999-99-99A99:99:99A")
    assert compile_mask.cache_info().misses == 1


def test_exact_form(spark):
    frame = spark.createDataFrame([("2023-01-01T00:00:00Z",), ("2023-02-30T00:00:00Z",), ("2023-01-01T00:00:00Z\n",), ("2023-01-01T25:00:00Z",), (None,)], "t string")
    assert [r[0] for r in frame.select(is_exact_utc(F.col("t"))).collect()] == [True, False, False, False, None]


def test_empty_table_repeats_and_other_columns(spark, run):
    zones = spark.createDataFrame(ZONES, "source string, home_zone string, date_order string")
    names = spark.createDataFrame(NAMES, "abbr string, utc_offset_min int")
    frame = spark.createDataFrame([("a", "yt", "1672553429", "x"), ("a", "yt", "1672553429", "y"), (None, "yt", "1672553429", "z")], "source_id string, source string, timestamp string, utc_ts string")
    found = normalise_timestamps(frame, zones, names)
    assert found.columns == ["source_id", "utc_ts"] and found.count() == 3
    assert normalise_timestamps(frame.limit(0), zones, names).count() == 0
    assert normalise_timestamps(frame, zones.limit(0), names.limit(0)).count() == 3
