"""Timestamps written in many formats and zones, brought to one instant.

An ordered cascade of anchored patterns reads the text; every field is checked
by arithmetic, never by a lenient parser. A reading that names a local time is
placed by trying the offsets its zone uses shortly before and after: none that
fits means the time never happened, two mean it happened twice. All of it is
Catalyst expressions; the session time zone has no influence.
"""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
_ZONE = r"(Z|z|(?:UTC|GMT|UT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?"
_BRACKET = r"(?:\[([A-Za-z0-9_+/-]+)\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_DOW = r"(?:(Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?"
_DAYS = "MonTueWedThuFriSatSun"

#: Name, anchored pattern, and which group holds year, month, day, hour,
#: minute, second, fraction, am/pm, zone, bracketed zone and weekday (0: absent). The
#: first pattern that matches decides. In "slashed", year is group 3 and the
#: order of the other two is the site's.
PATTERNS = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME} ?{_ZONE}{_BRACKET}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9, 0)),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0, 0)),
    ("year_slash", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}}) {_TIME} ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0, 0)),
    ("slashed12", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_TIME} ?([AaPp][Mm])$", (3, 1, 2, 4, 5, 6, 7, 8, 0, 0, 0)),
    ("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_TIME} ?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 0, 8, 0, 0)),
    ("dotted", r"^(\d{2})\.(\d{2})\.(\d{2}) (\d{2})\.(\d{2})\.(\d{2})$", (3, 2, 1, 4, 5, 6, 0, 0, 0, 0, 0)),
    ("named", rf"^(\d{{1,2}})-([A-Za-z]{{3}})-(\d{{4}}) {_TIME} ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 0, 0)),
    ("mail", rf"^{_DOW}(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {_TIME} ?{_ZONE}$", (4, 3, 2, 5, 6, 7, 8, 0, 9, 0, 1)),
)
_DIGITS = r"^\d{9,16}$"
_HOUR, _DAY = 3_600_000_000, 86_400_000_000


def zone_ids(spark: SparkSession) -> list[str]:
    """Region ids that the session's JVM knows (about 600, a closed set)."""
    return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())


@lru_cache(maxsize=4)
def abbreviation_rows(first: int = 1990, last: int = 2037) -> list[tuple[str, str, list[int]]]:
    """Zone, abbreviation and the offsets in seconds that it stands for there, by asking every zone in January and July of each year."""
    probes = [datetime(y, m, 1, tzinfo=UTC) for y in range(first, last + 1) for m in (1, 7)]
    found: dict[tuple[str, str], set[int]] = {}
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)
        for at in probes:
            local = at.astimezone(zone)
            if (abbr := local.tzname()) and abbr.isalpha():
                found.setdefault((name, abbr.upper()), set()).add(int(local.utcoffset().total_seconds()))
    return [(z, a, sorted(o)) for (z, a), o in sorted(found.items())]


def abbreviations(spark: SparkSession, first: int = 1990, last: int = 2037) -> DataFrame:
    """``(abbr_zone, abbr, abbr_offsets)``: a few thousand rows whatever the data, so it may be broadcast."""
    return spark.createDataFrame(abbreviation_rows(first, last), "abbr_zone string, abbr string, abbr_offsets array<int>")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date."""
    yy = y - (m <= 2).cast("int")
    era = F.floor(yy / F.lit(400))
    yoe = yy - era * 400
    doy = F.floor(((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2) / F.lit(5)) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / F.lit(4)) - F.floor(yoe / F.lit(100)) + doy - 719468


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _offset(utc_us: Column, zone: Column) -> Column:
    """The zone's offset in microseconds at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us


def parse(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_f`` (pattern name) and the fields ``_y _mo _d _h _mi _s _us _zone _bracket _dow`` and ``_epoch``.

    Nothing matches: all null. Fields are strings turned to ints; whether they
    make a date is checked later.
    """
    t = F.regexp_replace(F.col(text), r"^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$", "")
    df = df.withColumn("_t", t)
    name, parts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, pattern, groups in reversed(PATTERNS):
        hit = F.col("_t").rlike(pattern)
        name = F.when(hit, label).otherwise(name)
        parts = F.when(hit, F.regexp_replace("_t", pattern, "|".join(f"${g}" if g else "" for g in groups))).otherwise(parts)
    df = df.withColumn("_f", name).withColumn("_p", F.split(parts, r"\|", -1))
    at = lambda i: F.nullif(F.try_element_at("_p", F.lit(i)), F.lit(""))
    number = lambda c: c.try_cast("int")
    place = F.position(F.upper(at(2)), F.lit(_MONTHS))
    month = F.when(at(2).rlike("^[A-Za-z]{3}$"), F.when(place % 3 == 1, F.floor((place + 2) / F.lit(3)).cast("int"))).otherwise(number(at(2)))
    digits = F.when(F.col("_t").rlike(_DIGITS), F.col("_t").try_cast("bigint"))
    length = F.length("_t")
    return df.select(
        "*",
        F.when(F.col("_f") == "dotted", number(at(1)) + 2000).otherwise(number(at(1))).alias("_y"),
        month.alias("_mo"),
        number(at(3)).alias("_d"),
        number(at(4)).alias("_h0"),
        number(at(5)).alias("_mi"),
        F.coalesce(number(at(6)), F.lit(0)).alias("_s"),
        F.coalesce(number(F.rpad(F.substring(at(7), 1, 6), 6, "0")), F.lit(0)).alias("_us"),
        F.upper(at(8)).alias("_ampm"),
        at(9).alias("_zone"),
        at(10).alias("_bracket"),
        at(11).alias("_dow"),
        F.when(length <= 10, digits * 1_000_000).when(length.isin(12, 13), digits * 1000).when(length >= 15, digits).alias("_epoch"),
    )


def instants(
    df: DataFrame,
    text: str,
    zone: Column,
    *,
    site_zone: Column,
    date_order: Column,
    is_local: Column,
    out: str = "utc_us",
) -> DataFrame:
    """``df`` plus ``out``: microseconds since 1970 UTC that ``text`` names, or null.

    zone, site_zone: default zones of a reading without one (blank or unknown
    to the JVM counts as none; the first known one holds). date_order: ``DMY``
    or ``MDY`` for slashed dates that do not begin with the year. is_local: true
    makes a reading local although the text marks it as UTC.

    Null when the text is null or matches no pattern, when the date or time is
    impossible or the weekday isn't the date's, when no zone is known, and when the local reading happened
    twice or never. A zone abbreviation settles which of two readings is meant;
    one that the zone does not show at that reading gives null (GMT, where the
    zone has no such name, is offset 0). Added columns
    begin with an underscore and are dropped again; columns of ``df`` that clash
    with them are not kept.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c != out]
    known = zone_ids(spark)
    tidy = lambda c: F.when(F.trim(c).isin(known), F.trim(c))
    df = df.select(*own, tidy(zone).alias("_z1"), tidy(site_zone).alias("_z2"), F.upper(F.trim(date_order)).alias("_order"), F.coalesce(is_local, F.lit(False)).alias("_local"))
    df = parse(df, text)

    slashed = F.col("_f").startswith("slashed")
    day_first = F.col("_order") == "DMY"
    c = F.col
    df = df.withColumns(
        {
            "_mo2": F.when(slashed, F.when(day_first, c("_d")).when(c("_order") == "MDY", c("_mo"))).otherwise(c("_mo")),
            "_d2": F.when(slashed, F.when(day_first, c("_mo")).when(c("_order") == "MDY", c("_d"))).otherwise(c("_d")),
            "_h": F.when(c("_ampm").isNull(), c("_h0")).when(c("_h0").between(1, 12), c("_h0") % 12 + F.when(c("_ampm") == "PM", 12).otherwise(0)),
        }
    )
    good = (
        c("_y").between(1900, 2199)
        & c("_mo2").between(1, 12)
        & (c("_d2") >= 1)
        & (c("_d2") <= _month_length(c("_y"), c("_mo2")))
        & c("_h").between(0, 23)
        & c("_mi").between(0, 59)
        & c("_s").between(0, 59)
    )
    days = _days(c("_y"), c("_mo2"), c("_d2"))
    # 1970-01-01 was a Thursday
    good &= c("_dow").isNull() | (F.pmod(days + 3, F.lit(7)) * 3 + 1 == F.position(c("_dow"), F.lit(_DAYS)))
    seconds = days * 86400 + c("_h") * 3600 + c("_mi") * 60 + c("_s")
    df = df.withColumn("_wall", F.when(good, seconds.cast("bigint") * 1_000_000 + c("_us")))

    mark = F.upper(c("_zone"))
    numeric = F.coalesce(F.regexp_extract("_zone", r"^(?:UTC|GMT|UT)?([+-]\d{2}(?::?\d{2})?)$", 1), F.lit(""))
    hours, minutes = F.substring(numeric, 2, 2).try_cast("int"), F.coalesce(F.regexp_extract(numeric, r"(\d{2})$", 1).try_cast("int"), F.lit(0))
    minutes = F.when(F.length(numeric) > 3, minutes).otherwise(0)
    signed = (hours * 3600 + minutes * 60) * F.when(F.startswith(numeric, F.lit("-")), -1).otherwise(1)
    df = df.withColumns(
        {
            "_off": F.when(mark.isin("Z", "UTC", "UT"), F.lit(0)).when((numeric != "") & (hours <= 18) & (minutes < 60), signed),
            "_bad_off": (numeric != "") & ~((hours <= 18) & (minutes < 60)),
            "_abbr": F.when(c("_zone").isNotNull() & (numeric == "") & ~mark.isin("Z", "UTC", "UT"), mark),
            "_zb": tidy(c("_bracket")),
        }
    )
    df = df.withColumn("_off", F.when(c("_local") & (c("_off") == 0), F.lit(None)).otherwise(c("_off")))
    df = df.withColumn("_z", F.coalesce(c("_zb"), c("_z1"), c("_z2")))
    df = df.join(F.broadcast(abbreviations(spark)), (c("_z") == c("abbr_zone")) & (c("_abbr") == c("abbr")), "left")
    # GMT is Greenwich's offset where it isn't an abbreviation of the zone itself
    df = df.withColumn("_off", F.when((c("_abbr") == "GMT") & c("abbr_offsets").isNull() & ~c("_local"), 0).otherwise(c("_off")))

    before, after = _offset(c("_wall") - _DAY, c("_z")), _offset(c("_wall") + _DAY, c("_z"))
    df = df.withColumns({"_u1": c("_wall") - before, "_u2": c("_wall") - after})
    fits = lambda u: F.when(_offset(c(u), c("_z")) == c("_wall") - c(u), c(u))
    df = df.withColumns({"_u1": fits("_u1"), "_u2": fits("_u2")})
    named = lambda u: F.when(c("_abbr").isNull() | F.array_contains("abbr_offsets", ((c("_wall") - c(u)) / F.lit(1_000_000)).cast("int")), c(u))
    df = df.withColumns({"_u1": named("_u1"), "_u2": named("_u2")})
    local = F.when(c("_u1").isNull(), c("_u2")).when(c("_u2").isNull() | (c("_u1") == c("_u2")), c("_u1"))
    value = F.when(c("_epoch").isNotNull(), c("_epoch")).when(c("_off").isNotNull(), c("_wall") - c("_off").cast("bigint") * 1_000_000).when(~c("_bad_off"), local)
    return df.select(*own, value.alias(out))
