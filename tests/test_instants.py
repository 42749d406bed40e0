import datetime
import zoneinfo

import pytest
from hypothesis import given, settings, strategies as st

from lexiloom.operators import instants
from lexiloom.operators.instants import local_to_epoch, normalise_instants, offset_seconds, parse_clock, parse_date
from pyspark.sql import functions as F


def day(y, m, d):
    return datetime.date(y, m, d).toordinal() - 719163


@pytest.mark.parametrize(
    "date,month,year,order,want",
    [
        ("2008-01-22", None, None, "either", day(2008, 1, 22)),
        ("20080122", "Jan", "2008", "either", day(2008, 1, 22)),
        ("31-10-2015", None, None, "either", day(2015, 10, 31)),
        ("10-31-15", None, None, "either", day(2015, 10, 31)),
        ("03/04/2010", "april", None, "either", day(2010, 4, 3)),
        ("03/04/2010", "3", None, "either", day(2010, 3, 4)),
        ("03/04/2010", None, None, "either", None),
        ("04/04/2010", None, None, "either", day(2010, 4, 4)),
        ("03/04/2010", "July", None, "either", None),
        ("3/4/10", None, None, "written", day(2010, 3, 4)),
        ("03.04.2010", None, None, "written", day(2010, 4, 3)),
        ("21st April 2008", None, None, "either", day(2008, 4, 21)),
        ("Fri, Apr 10 2009", "04", "2009", "either", day(2009, 4, 10)),
        ("April 9, 2008", None, "2009", "either", None),
        ("Apr-03-2010", None, None, "either", day(2010, 4, 3)),
        ("2008-02-31", None, None, "either", None),
        ("00-00-0000", None, None, "either", None),
        ("yesterday", "1", "2008", "either", None),
        ("", None, None, "either", None),
        (None, None, None, "either", None),
    ],
)
def test_dates(date, month, year, order, want):
    assert parse_date(date, month, year, order)[0] == want


def test_epochs_and_rests():
    assert parse_date("1201315853246")[2] == 1201315853
    assert parse_date("1201182927")[2] == 1201182927
    assert parse_date("200801261608", order="written")[:2] == (day(2008, 1, 26), "16:08")
    assert parse_date("20080302T051439-0500", order="written")[:2] == (day(2008, 3, 2), "05:14:39-0500")


@pytest.mark.parametrize(
    "time,ampm,want",
    [
        ("7:31", "PM", (19 * 3600 + 31 * 60, None)), ("22:42:47", "PM", (81767, None)), ("15:03", "AM", (None, None)), ("12:20", "a.m.", (1200, None)), ("12:20", "P", (44400, None)),
        ("05h54", None, (21240, None)), ("6.51", "PM ", (67860, None)), ("1741", "", (63660, None)), ("28:42", None, (None, None)), ("9:46:40 pm", None, (78400, None)),
        ("12:20 AM EST", None, (1200, -18000)), ("03:23:52 PST", None, (12232, -28800)), ("8:35PM GMT-0700", None, (74100, -25200)), ("17:45+09", None, (63900, 32400)),
        ("09:48:40+0545", None, (35320, 20700)), ("09:48:40+", None, (None, None)), ("15:36:", None, (None, None)), ("9:00 XYZ", None, (None, None)), (None, "AM", (None, None)),
    ],
)
def test_clocks(time, ampm, want):
    assert parse_clock(time, ampm) == want


def test_offsets():
    assert [offset_seconds(z) for z in ("Z", "cest", "GMT-05:00", "+0530", "+15", "moon")] == [0, 7200, -18000, 19800, None, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1_190_000_000, 1_450_000_000), st.sampled_from(["America/New_York", "Europe/London", "Europe/Berlin", "America/Phoenix", "Asia/Kolkata"])), min_size=1, max_size=30))
def test_wall_times_like_zoneinfo(spark, cases):
    def want(local, zone):
        z = zoneinfo.ZoneInfo(zone)
        naive = datetime.datetime.fromtimestamp(local, datetime.UTC).replace(tzinfo=None)
        found = set()
        for fold in (0, 1):
            u = naive.replace(tzinfo=z, fold=fold).astimezone(datetime.UTC)
            if u.astimezone(z).replace(tzinfo=None) == naive:
                found.add(int(u.timestamp()))
        return found.pop() if len(found) == 1 else None

    rows = [(i, x, z) for i, (x, z) in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, x long, z string").select("i", local_to_epoch(F.col("x"), F.col("z")).alias("e")).collect()
    assert {r.i: r.e for r in got} == {i: want(x, z) for i, x, z in rows}


def test_skipped_and_repeated(spark):
    at = lambda *a: int(datetime.datetime(*a, tzinfo=datetime.UTC).timestamp())
    rows = [(1, at(2010, 3, 14, 2, 30)), (2, at(2010, 11, 7, 1, 30)), (3, at(2010, 7, 1, 12, 0))]
    got = spark.createDataFrame(rows, "i int, x long").select("i", local_to_epoch(F.col("x"), F.lit("America/New_York")).alias("e")).collect()
    assert {r.i: r.e for r in got} == {1: None, 2: None, 3: at(2010, 7, 1, 16, 0)}


SCHEMA = "id long, date string, time string, ampm string, month string, year string, zone string, rest string, epoch long, cur string"


def test_rows_and_kept_dictionary(spark, tmp_path):
    rows = [
        (1, "2010-07-01", "12:00", None, None, None, "America/New_York", None, None, None), (1, "2010-07-01", "12:00", None, None, None, "America/New_York", None, None, None),
        (2, "2010-07-01", "12:00", None, None, None, None, None, None, None), (3, "2010-07-01T12:00:00+02:00", None, None, None, None, None, None, None, None),
        (4, None, None, None, None, None, "Europe/Berlin", None, None, None), (5, "x" * 100_000, "", "", "", "", "Europe/Berlin", None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda d, **k: sorted((r.row_id, r.epoch_s) for r in normalise_instants(d, "id", "date", "zone", "time", "ampm", "month", "year", **k).collect())
    want = [(1, 1278000000), (1, 1278000000), (3, 1277978400)]
    assert run(df) == want
    kept = str(tmp_path / "dictionary")
    assert run(df, dictionary=kept) == want
    keys = lambda: spark.read.parquet(*instants._batches(spark, kept + "/dates_either")).count()
    before = keys()
    assert run(df, dictionary=kept) == want and keys() == before
    assert run(df.limit(0), dictionary=kept) == [] and run(df.limit(0)) == []


def test_each_string_parsed_once(spark, tmp_path):
    """No parser stands in the plan over the rows, and the kept dictionary holds each string once."""
    rows = [(i, f"2010-07-0{1 + i % 3}", "12:00", None, None, None, "Europe/Berlin", None, None, None) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = normalise_instants(df, "id", "date", "zone", "time", "ampm", "month", "year", dictionary=str(tmp_path / "kept"))
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().toString() and plan.count() == 50
    dates = spark.read.parquet(*instants._batches(spark, str(tmp_path / "kept") + "/dates_either"))
    assert sorted(r.d for r in dates.collect()) == ["2010-07-01", "2010-07-02", "2010-07-03"]


def test_two_writers_of_one_dictionary(spark, tmp_path):
    path = str(tmp_path / "kept")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    parse = {"n": F.length("k")}
    first = instants.extend_dictionary(df, ["k"], parse, path)
    first.write.parquet(path + "/another")  # a second writer brings the same keys
    (tmp_path / "kept" / "unfinished").mkdir()
    got = instants.extend_dictionary(df.unionByName(spark.createDataFrame([("ccc",)], "k string")), ["k"], parse, path)
    assert sorted((r.k or "", r.n) for r in got.collect()) == [("", None), ("a", 1), ("b", 1), ("ccc", 3)]
