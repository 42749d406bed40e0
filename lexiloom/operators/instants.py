"""Mixed date and time notations to one UTC instant, through distinct-value dictionaries.

Rows carry few distinct spellings next to their number, so nothing is parsed per row:

1. every raw string (a date with its helpers, a clock time with its AM/PM field, a whole stamp)
   goes once into a dictionary keyed by source and string;
2. the dictionary is parsed exhaustively, each string once;
3. it may be kept as Parquet batches and is then only extended by strings it lacks;
4. distinct local times with their zone are turned into instants in a second dictionary;
5. both are joined back to the rows.
"""

from __future__ import annotations

import datetime
import hashlib
import inspect
import re
import sys
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import cut, shared_folder

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
}

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MON = r"(" + "|".join(MONTHS) + r")[a-z]*\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_ISO = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[t ]?(\d{1,2}[:.h].*))?")
_TWO = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?: (.*))?")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(?:t?(\d{4}(?:\d{2})?)(?!\d)(.*))?")
_DMY = re.compile(_DAY + r"(\d{1,2})(?:st|nd|rd|th)?[ -]" + _MON + r",?[ -](\d{4}|\d{2})(?: (.*))?")
_MDY = re.compile(_DAY + _MON + r"[ -](\d{1,2})(?:st|nd|rd|th)?,?[ -](\d{4})(?: (.*))?")
_CLOCK = re.compile(r"(\d{1,2})[:.h](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)?(?:\s*([ap])\.?(?:m\.?)?(?![a-z]))?\s*(.*)")
_OFFSET = re.compile(r"(?:gmt|utc)?([+-])(\d{2})(?::?(\d{2}))?")


def month_number(text: str | None) -> int | None:
    """1 to 12 from a number or an English month name in any case; else None."""
    low = (text or "").strip().lower()
    if low.isdigit():
        return int(low) if 1 <= int(low) <= 12 else None
    return MONTHS.index(low[:3]) + 1 if low[:3] in MONTHS else None


def year_number(text: str | None) -> int | None:
    """A four-digit year, or 20yy for two digits, with any sign around; else None."""
    m = re.fullmatch(r"\D*(\d{4}|\d{2})\D*", (text or "").strip())
    return None if m is None else _year(m[1])


def _year(digits: str) -> int:
    return int(digits) + (2000 if len(digits) == 2 else 0)


def offset_seconds(zone: str) -> int | None:
    """Seconds east of UTC of a written offset or abbreviation; None where it is none.

    An offset after GMT or UTC counts as written (GMT-05:00 is five hours west).
    """
    z = re.sub(r"\s", "", zone.lower())
    m = _OFFSET.fullmatch(z)
    if m:
        hours, minutes = int(m[2]), int(m[3] or 0)
        return (1 if m[1] == "+" else -1) * (hours * 3600 + minutes * 60) if hours <= 14 and minutes < 60 else None
    known = ABBREVIATIONS.get(z.upper())
    return None if known is None else known * 60


def parse_date(date: str | None, month: str | None = None, year: str | None = None, order: str = "either") -> tuple[int | None, str | None, int | None]:
    """``(day, rest, epoch)`` of a written date: days since 1970, the clock written behind it, or
    an epoch second; all None where it is no date.

    ``order`` says how two small numbers before a year are read: ``either`` lets ``month`` decide
    (none, where it is null and they differ), ``written`` puts the month first with slashes or
    dashes, the day first with dots. A month or year that contradicts the date makes it none.
    """
    s = " ".join((date or "").lower().split())
    if re.fullmatch(r"\d{10}|\d{13}", s):
        return None, None, int(s) // (1000 if len(s) == 13 else 1)
    rest: str | None
    if m := _ISO.fullmatch(s):
        y, mo, d, rest = int(m[1]), int(m[3]), int(m[4]), m[5]
    elif m := _COMPACT.fullmatch(s):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
        rest = m[4] and ":".join(m[4][i : i + 2] for i in range(0, len(m[4]), 2)) + m[5]
    elif m := _TWO.fullmatch(s):
        a, b, y, rest = int(m[1]), int(m[3]), _year(m[4]), m[5]
        told = month_number(month)
        if order == "written":
            day_first = m[2] == "."
        elif a > 12 or b > 12:
            day_first = a > 12
        elif a != b and told not in (a, b):
            return None, None, None
        else:
            day_first = a == b or told == b
        d, mo = (a, b) if day_first else (b, a)
    elif m := _DMY.fullmatch(s):
        d, mo, y, rest = int(m[1]), MONTHS.index(m[2]) + 1, _year(m[3]), m[4]
    elif m := _MDY.fullmatch(s):
        d, mo, y, rest = int(m[2]), MONTHS.index(m[1]) + 1, int(m[3]), m[4]
    else:
        return None, None, None
    told_m, told_y = month_number(month), year_number(year)
    if told_m not in (None, mo) or told_y not in (None, y) or not 1900 <= y <= 2100:
        return None, None, None
    try:
        return datetime.date(y, mo, d).toordinal() - 719163, rest or None, None
    except ValueError:
        return None, None, None


def parse_clock(time: str | None, ampm: str | None = None) -> tuple[int | None, int | None]:
    """``(seconds, offset)`` of a clock time: since midnight, and its written offset or None; both
    None where it is not whole.

    Missing seconds count as zero. AM beside an hour above 12 or two unlike marks are contradictions.
    """
    s = re.sub(r"^(\d{2})(\d{2})$", r"\1:\2", " ".join((time or "").lower().split()))
    m = _CLOCK.fullmatch(s)
    if not m:
        return None, None
    hour, minute, second, inner, zone = int(m[1]), int(m[2]), int(m[3] or 0), m[4], m[5]
    beside = re.sub(r"[^a-z]", "", (ampm or "").lower())[:1]
    beside = beside if beside in ("a", "p") else None
    mark = inner or beside
    if (inner and beside and inner != beside) or (mark == "a" and hour > 12) or (mark == "p" and hour == 0):
        return None, None
    hour = 0 if mark == "a" and hour == 12 else hour + 12 if mark == "p" and hour < 12 else hour
    offset = offset_seconds(zone) if zone else None
    if hour > 23 or minute > 59 or second > 59 or (zone and offset is None):
        return None, None
    return hour * 3600 + minute * 60 + second, offset


_DATE_TYPE = T.StructType([T.StructField("day", T.LongType()), T.StructField("rest", T.StringType()), T.StructField("epoch", T.LongType())])
_CLOCK_TYPE = T.StructType([T.StructField("seconds", T.LongType()), T.StructField("offset", T.LongType())])


def _none(v: object) -> str | None:
    return v if isinstance(v, str) else None


def _dates(order: str):
    def run(d: pd.Series, m: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [parse_date(_none(a), _none(b), _none(c), order) for a, b, c in zip(d, m, y, strict=True)]
        return pd.DataFrame({"day": pd.array([r[0] for r in rows], "Int64"), "rest": pd.Series([r[1] for r in rows], dtype="object"), "epoch": pd.array([r[2] for r in rows], "Int64")})

    return F.pandas_udf(run, _DATE_TYPE)


def _clocks():
    def run(t: pd.Series, ap: pd.Series) -> pd.DataFrame:
        rows = [parse_clock(_none(a), _none(b)) for a, b in zip(t, ap, strict=True)]
        return pd.DataFrame({"seconds": pd.array([r[0] for r in rows], "Int64"), "offset": pd.array([r[1] for r in rows], "Int64")})

    return F.pandas_udf(run, _CLOCK_TYPE)


def local_to_epoch(local_s: Column, zone: Column) -> Column:
    """UTC seconds of a local wall time in a named zone; null where it was skipped or repeated.

    The offsets a day before and after give the only two candidate instants; exactly one of them
    must read as the wall time. A null or unknown zone gives null.
    """

    def offset(at: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), zone)) - F.unix_seconds(F.timestamp_seconds(at))

    before, after = local_s - offset(local_s - 86400), local_s - offset(local_s + 86400)
    fits_b, fits_a = before + offset(before) == local_s, after + offset(after) == local_s
    return F.when(fits_b & fits_a & (before == after), before).when(fits_b & ~fits_a, before).when(fits_a & ~fits_b, after)


def _batches(spark, path: str) -> list[str]:
    """Folders below ``path`` whose writer has finished; a batch that is still being written is not seen."""
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(p)]
    return sorted(f for f in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f + "/_SUCCESS")))


def extend_dictionary(values: DataFrame, keys: Sequence[str], parse: dict[str, Column], path: str | None) -> DataFrame:
    """Distinct ``keys`` of ``values`` with the columns of ``parse``, each key parsed once.

    The distinct keys are materialised before they are parsed, and the parsed ones after, so that no
    filter on a parsed column brings the parser down to the rows. With a ``path`` the dictionary is
    kept there: only keys it lacks are parsed, as a batch in a folder of its own, so writers do not
    meet; a key that two of them brought counts once. Null keys are kept as keys of their own.
    """
    spark = values.sparkSession
    distinct = values.select(*keys).distinct()
    columns = [*keys, *[c.alias(k) for k, c in parse.items()]]
    if path is None:
        return cut(cut(distinct).select(*columns))
    known = _batches(spark, path)
    if known:
        got = spark.read.parquet(*known).select(*[F.col(k).alias(f"__{k}") for k in keys])
        distinct = distinct.join(got, on=[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how="left_anti")
    lacking = cut(distinct)
    if not known or not lacking.isEmpty():
        lacking.select(*columns).write.parquet(f"{path}/{uuid.uuid4().hex}")
        known = _batches(spark, path)
    # a key stands in one batch, unless two writers brought it at once
    return spark.read.parquet(*known).dropDuplicates(list(keys)) if len(known) > 1 else spark.read.parquet(*known)


def kept_dictionaries(spark) -> str:
    """Folder of the kept dictionaries in the shared folder; its name follows the text of this module,
    so a changed parser starts anew."""
    text = hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:12]
    return f"{shared_folder(spark)}/lexiloom-instants-{text}"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of ``left`` are kept once."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [left[k].eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(r, on=cond, how=how).drop(*[f"__r_{k}" for k in keys])


def normalise_instants(
    rows: DataFrame,
    row_id: str,
    date: str,
    zone: str,
    time: str | None = None,
    ampm: str | None = None,
    month: str | None = None,
    year: str | None = None,
    order: str = "either",
    dictionary: str | None = None,
) -> DataFrame:
    """``(row_id, epoch_s)`` for each row of ``rows`` that states exactly one instant.

    ``zone`` holds the zone name that applies where none is written (null: none). ``time`` None
    means that ``date`` holds a whole stamp. ``dictionary`` names a folder for the kept
    dictionaries. Null, empty, unreadable, contradictory or cut-short values give no row, a
    repeated row gives its instant again; other columns are ignored, whatever their names.
    """
    null = F.lit(None).cast("string")
    pick = lambda c: F.col(c).cast("string") if c else null
    raw = rows.select(F.col(row_id).alias("row_id"), pick(date).alias("d"), pick(month).alias("m"), pick(year).alias("y"), pick(time).alias("t"), pick(ampm).alias("ap"), pick(zone).alias("zone"))
    raw = raw.filter(F.trim("d") != "").withColumn("t", F.when(F.trim("t") != "", F.trim("t"))).withColumn("ap", F.when(F.col("t").isNotNull(), F.col("ap")))
    at = lambda name: None if dictionary is None else f"{dictionary}/{name}_{order}"
    days = extend_dictionary(raw, ["d", "m", "y"], {"dd": _dates(order)("d", "m", "y")}, at("dates")).filter("dd.day is not null or dd.epoch is not null")
    # clocks stand in a field of their own or behind the date; both go into one dictionary
    behind = days.filter("dd.rest is not null").select(F.col("dd.rest").alias("t"), null.alias("ap"))
    asked = behind if time is None else raw.filter("t is not null").select("t", "ap").unionByName(behind)
    clocks = extend_dictionary(asked, ["t", "ap"], {"tt": _clocks()("t", "ap")}, at("clocks")).filter("tt.seconds is not null")
    one = F.when(F.col("dd.rest").isNull(), F.col("t")).when(F.col("t").isNull(), F.col("dd.rest"))  # two clocks are none
    dated = null_safe_join(raw, days, ["d", "m", "y"], "inner").select("row_id", "zone", F.col("dd.epoch").alias("epoch"), F.col("dd.day").alias("day"), one.alias("t"), F.when(F.col("dd.rest").isNull(), F.col("ap")).alias("ap"))
    local = null_safe_join(dated, clocks, ["t", "ap"], "left")
    local = local.select("row_id", "epoch", "zone", (F.col("day") * 86400 + F.col("tt.seconds")).alias("local_s"), F.col("tt.offset").alias("offset"))
    stated = cut(local.select("row_id", "zone", "local_s", F.coalesce("epoch", F.col("local_s") - F.col("offset")).alias("epoch_s")))
    zoned = stated.filter("epoch_s is null and local_s is not null and zone is not null")
    walls = extend_dictionary(zoned, ["local_s", "zone"], {"epoch_s": local_to_epoch(F.col("local_s"), F.col("zone"))}, at("walls")).filter("epoch_s is not null")
    return stated.filter("epoch_s is not null").select("row_id", "epoch_s").unionByName(zoned.drop("epoch_s").join(walls, ["local_s", "zone"]).select("row_id", "epoch_s"))
