"""Written timestamps and implausible readings."""

from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import clock, sequence, spikes


def us(*a, zone=UTC, fold=0):
    d = datetime(*a, tzinfo=ZoneInfo(zone) if isinstance(zone, str) else zone, fold=fold)
    return round(d.timestamp() * 1_000_000)


P, D, NY = "Europe/Paris", "America/Denver", "America/New_York"
CASES = [
    # text, zone, site zone, order, is_local, instant
    ("2021-11-01 23:14:06", P, None, "DMY", None, us(2021, 11, 1, 23, 14, 6, zone=P)),
    ("2021-11-01T23:14", None, P, "DMY", False, us(2021, 11, 1, 23, 14, zone=P)),
    ("2021-11-01T23:14", "  ", P, "DMY", True, us(2021, 11, 1, 23, 14, zone=P)),
    ("2021-11-01T23:14", None, None, "DMY", True, None),
    ("2021-11-01T23:14", "Nowhere/Land", None, "DMY", True, None),
    ("2021-11-01T23:14:06.5Z", P, None, "DMY", None, us(2021, 11, 1, 23, 14, 6, 500000)),
    ("2021-11-01T23:14:06Z", P, None, "DMY", True, us(2021, 11, 1, 23, 14, 6, zone=P)),
    ("2021-11-01T23:14:06+00:00", None, None, "DMY", True, None),
    ("2021-11-01T23:14:06,271+0530", None, None, None, False, us(2021, 11, 1, 23, 14, 6, 271000, zone=timezone(timedelta(hours=5.5)))),
    ("2021-11-01 23:14:06 UTC-06:00", P, P, None, True, us(2021, 11, 1, 23, 14, 6, zone=timezone(timedelta(hours=-6)))),
    ("2021-11-01T23:14:06+01", None, None, None, None, us(2021, 11, 1, 22, 14, 6)),
    ("2022-09-02T22:34:38-06:00[America/Denver]", P, None, None, None, us(2022, 9, 3, 4, 34, 38)),
    ("2022-09-02 22:34:38 MDT", None, D, None, None, us(2022, 9, 2, 22, 34, 38, zone=D)),
    ("2022-09-02 22:34:38 MDT", P, D, None, None, None),
    ("2019-11-03 01:30:00 EST", NY, None, None, None, us(2019, 11, 3, 6, 30)),
    ("2019-11-03 01:30:00 EDT", NY, None, None, None, us(2019, 11, 3, 5, 30)),
    ("2022-07-02 22:34:38 GMT", P, None, None, None, us(2022, 7, 2, 22, 34, 38)),
    ("2022-01-02 22:34:38 GMT", "Europe/London", None, None, None, us(2022, 1, 2, 22, 34, 38)),
    ("2022-07-02 22:34:38 GMT", "Europe/London", None, None, None, None),
    ("2019-11-03 01:30:00", NY, None, None, None, None),
    ("2019-03-10 02:30:00", NY, None, None, None, None),
    ("2019-03-10 03:00:00", NY, None, None, None, us(2019, 3, 10, 7)),
    ("09/13/2024 00:20:12", D, None, "MDY", None, us(2024, 9, 13, 0, 20, 12, zone=D)),
    ("13/09/2024 00:20:12", P, None, "DMY", None, us(2024, 9, 13, 0, 20, 12, zone=P)),
    ("13/09/2024 00:20:12", P, None, "MDY", None, None),
    ("04/05/2024 00:20", P, None, None, None, None),
    ("2020/01/04 22:13:49", "America/Phoenix", None, "DMY", None, us(2020, 1, 5, 5, 13, 49)),
    ("06/09/2020 11:34:26.1313030 pm", "America/St_Johns", None, "MDY", None, us(2020, 6, 9, 23, 34, 26, 131303, zone="America/St_Johns")),
    ("05/16/2021 12:57:05 am", D, None, "MDY", None, us(2021, 5, 16, 0, 57, 5, zone=D)),
    ("05/16/2021 13:57:05 am", D, None, "MDY", None, None),
    ("16.05.21 00.53.00", P, None, "MDY", None, us(2021, 5, 16, 0, 53, zone=P)),
    ("31.02.21 22.15.00", P, None, None, None, None),
    ("09-Jun-2018 22:41:13.144198", P, None, None, None, us(2018, 6, 9, 22, 41, 13, 144198, zone=P)),
    ("09-Jux-2018 22:41:13", P, None, None, None, None),
    ("Sun, 29 Sep 2019 22:53:20 +0530", None, None, None, None, us(2019, 9, 29, 17, 23, 20)),
    ("20190107T034153Z", None, None, None, False, us(2019, 1, 7, 3, 41, 53)),
    ("20190107T034153", P, None, None, False, us(2019, 1, 7, 2, 41, 53)),
    ("1623098621", None, None, None, None, 1623098621000000),
    ("1704488201000", None, None, None, True, 1704488201000000),
    (" 1718941861000123\t", None, None, None, None, 1718941861000123),
    ("2024-02-29 12:00:00", P, None, None, None, us(2024, 2, 29, 12, zone=P)),
    ("2023-02-29 12:00:00", P, None, None, None, None),
    ("2023-02-28 24:00:00", P, None, None, None, None),
    ("0000-00-00 00:00:00", P, None, None, None, None),
    ("Thu, 29 Feb 2024 12:00:00 GMT", None, None, None, None, us(2024, 2, 29, 12)),
    ("Fri, 29 Feb 2024 12:00:00 GMT", P, None, None, None, None),
    ("22:41:07", P, None, None, None, None),
    ("unknown", P, None, None, None, None),
    ("", P, None, None, None, None),
    (None, P, None, None, None, None),
    ("x" * 100_000, P, None, None, None, None),
]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_instants(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        rows = [(i, *c[:5]) for i, c in enumerate(CASES)]
        df = spark.createDataFrame(rows, "i int, written string, tz string, site string, ord string, loc boolean")
        got = clock.instants(df, "written", F.col("tz"), site_zone=F.col("site"), date_order=F.col("ord"), is_local=F.col("loc"))
        found = {r.i: r.utc_us for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(found) == len(CASES)
    wrong = [(CASES[i][:5], CASES[i][5], found[i]) for i in found if found[i] != CASES[i][5]]
    assert not wrong, wrong


def test_instants_against_zoneinfo(spark):
    rng = np.random.default_rng(3)
    zones = [P, NY, "Australia/Lord_Howe", "Asia/Kathmandu", "America/St_Johns", "Pacific/Auckland"]
    days = [datetime(2021, 3, 14), datetime(2021, 11, 7), datetime(2021, 4, 4), datetime(2021, 10, 31), datetime(2021, 3, 28), datetime(2021, 9, 26), datetime(2021, 10, 3)]
    rows = []
    for i in range(600):
        zone, local = zones[i % 6], days[int(rng.integers(7))] + timedelta(seconds=int(rng.integers(0, 5 * 3600)))
        hits = {d.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(UTC) for d in [local] for f in (0, 1)}
        hits = {h for h in hits if h.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == local}
        rows.append((i, local.strftime("%Y-%m-%d %H:%M:%S"), zone, round(next(iter(hits)).timestamp() * 1e6) if len(hits) == 1 else None))
    df = spark.createDataFrame(rows, "i int, t string, z string, want bigint")
    n = F.lit(None).cast("string")
    got = clock.instants(df, "t", F.col("z"), site_zone=n, date_order=n, is_local=F.lit(False))
    assert got.where("not (want <=> utc_us)").count() == 0
    assert got.where("want is null").count() > 20


def test_instants_empty_and_clashing(spark):
    df = spark.createDataFrame([("2021-01-01 00:00:00", 7, P)], "t string, utc_us int, tz string")
    n = F.lit(None).cast("string")
    got = clock.instants(df, "t", F.col("tz"), site_zone=n, date_order=n, is_local=F.lit(None).cast("boolean"))
    assert got.columns == ["t", "tz", "utc_us"] and got.first().utc_us == us(2021, 1, 1, zone=P)
    assert clock.instants(df.limit(0), "t", F.col("tz"), site_zone=n, date_order=n, is_local=F.lit(False)).count() == 0


def frame(spark, values, source="s", start=0):
    rows = [(start + i, source, float(i * 60), 2 + i % 3, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, src string, t double, stage int, hr double")


def flags(df, **kw):
    got = spikes.flag(df, ident="id", source="src", time="t", season="stage", fields={"hr": (20, 250)}, **kw)
    return {r.ident: (r.implausible, r.stuck, r.extreme) for r in got.collect()}


def ordinary(n=200, seed=0, sd=2.0):
    rng = np.random.default_rng(seed)
    return [60 + 2 * (i % 3) + 0.01 * i + float(np.clip(rng.normal(), -3, 3)) * sd for i in range(n)]


def test_spikes(spark):
    v = ordinary()
    v[10], v[20], v[30], v[31] = 110.0, 5.0, None, float("nan")
    v[50:55] = [63.5] * 5
    v[60:64] = [63.5] * 4
    v[100:106] = [64.25, 64.25, None, 64.25, 64.25, 64.25]
    got = flags(frame(spark, v))
    assert 30 not in got and 31 not in got and 102 not in got
    assert got[10] == (False, False, True) and got[20][0]
    assert {i for i, f in got.items() if f[1]} == {50, 51, 52, 53, 54, 100, 101, 103, 104, 105}
    assert {i for i, f in got.items() if f[2]} <= {10, 20}


def test_spikes_across_slices(spark):
    v = ordinary(400, 1)
    v[95:105] = [61.0] * 10
    v[7] = 150.0
    df = frame(spark, v)
    assert flags(df, slice_width=600.0, whole=0) == flags(df)


def test_spikes_per_source(spark):
    quiet, wild = ordinary(150, 2, 0.5), [float(x) for x in np.random.default_rng(4).uniform(40, 100, 150)]
    quiet[40] = 90.0
    df = frame(spark, quiet, "a").unionByName(frame(spark, wild, "b", 1000)).unionByName(frame(spark, [60.0, 61.0], None, 5000))
    assert [i for i, f in flags(df).items() if f[2]] == [40]


def test_spikes_clashing_columns(spark):
    df = frame(spark, ordinary(40)).withColumns({"ident": F.lit(1), "value": F.lit("x"), "field": F.lit(None), "_slice": F.lit(2), "level": F.lit(3)})
    assert flags(df) == flags(frame(spark, ordinary(40)))


def test_spikes_degenerate(spark):
    assert flags(frame(spark, [])) == {}
    assert flags(frame(spark, [None, None])) == {}
    assert flags(frame(spark, [60.0])) == {0: (False, False, False)}
    assert set(flags(frame(spark, [60.0] * 4 + [300.0, float("inf")])).values()) == {(False, False, False), (True, False, False)}
    tied = frame(spark, ordinary(30)).withColumn("t", F.lit(None).cast("double"))
    assert len(flags(tied)) == 30


def test_equal_runs(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, int(rng.integers(0, 2)) if rng.random() > 0.1 else None) for k in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): r.run_length for r in sequence.equal_runs(df, ["k"], ["i"], "v", F.floor(F.col("i") / 7)).collect()}
    for k in ("a", None):
        seq = [r[2] for r in rows if r[0] == k]
        at = 0
        while at < len(seq):
            end = at
            while end < len(seq) and seq[end] == seq[at]:
                end += 1
            assert all(got[k, j] == end - at for j in range(at, end))
            at = end
