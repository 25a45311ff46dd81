"""Calendar and clock arithmetic on Column expressions: validation without exceptions, no session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def iso_day(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a calendar day, null if it does not exist (month 13, 30 February, year 0)."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    month_days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    ok = y.between(1, 9999) & m.between(1, 12) & d.between(1, month_days)
    return F.when(ok, F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), two(m), two(d)))


def day_number(iso: Column) -> Column:
    """Days since 1970-01-01 of an ISO day text."""
    return F.unix_date(F.to_date(iso))


def clock_micros(h: Column, mi: Column, s: Column, us: Column) -> Column:
    """Microseconds since midnight; 24:00 is the next midnight; null if the clock reading does not exist."""
    whole = (h == 24) & (mi == 0) & (s == 0) & (us == 0)
    ok = (h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)) | whole
    return F.when(ok, ((h * 60 + mi) * 60 + s).cast("bigint") * 1_000_000 + us)


def iso_instant(micros: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ of microseconds since the epoch, whatever the session time zone."""
    day = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    rest = F.pmod(micros, F.lit(86_400_000_000))
    sec = F.floor(rest / F.lit(1_000_000)).cast("int")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"),
        two(F.floor(sec / 3600).cast("int")), F.lit(":"), two(F.pmod(F.floor(sec / 60).cast("int"), F.lit(60))), F.lit(":"),
        two(F.pmod(sec, F.lit(60))), F.lit("."), F.lpad(F.pmod(rest, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"),
    )


def wall_to_utc_micros(micros: Column, zone: Column) -> Column:
    """Wall-clock microseconds in ``zone`` to UTC. java.time rules: the earlier instant where a wall time occurs
    twice, the offset before the change where it is skipped."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(micros), zone))
