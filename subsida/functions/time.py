"""Calendar functions as column expressions: decimal years, modified Julian dates, GPS time, clock strings.

A decimal year is 365.25 days long throughout; 2000.0 is MJD 51544.5 (J2000). Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Fixed values.
MJD_1970 = 40587
MJD_J2000 = 51544.5
MJD_GPS = 44244
DAYS_PER_YEAR = 365.25
DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def fix(x: Column) -> Column:
    """Truncation towards zero, as a double."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def mjd(ts: Column) -> Column:
    return micros(ts) / F.lit(float(DAY_US)) + F.lit(float(MJD_1970))


def mjd_of_day(ts: Column) -> Column:
    """MJD of the day that a timestamp lies in, by whole microseconds: a double of the moment can't tell them apart at midnight."""
    us = micros(ts)
    return (us - F.pmod(us, F.lit(DAY_US))) / F.lit(float(DAY_US)) + F.lit(float(MJD_1970))


def mjd_to_timestamp(m: Column) -> Column:
    """Timestamp of an MJD, to the microsecond."""
    us = F.round((m - F.lit(float(MJD_1970))) * F.lit(float(DAY_US))).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def mjd_to_dyear(m: Column) -> Column:
    return (m - F.lit(MJD_J2000)) / F.lit(DAYS_PER_YEAR) + F.lit(2000.0)


def dyear_to_mjd(d: Column) -> Column:
    return F.lit(MJD_J2000) + (d - F.lit(2000.0)) * F.lit(DAYS_PER_YEAR)


def dyear(ts: Column) -> Column:
    return mjd_to_dyear(mjd(ts))


def dyear_to_timestamp(d: Column) -> Column:
    return mjd_to_timestamp(dyear_to_mjd(d))


def full_year(year: Column) -> Column:
    """Two-digit years: 0-49 are 2000-2049, 50-99 are 1950-1999."""
    return F.when(year.between(0, 49), year + 2000).when(year.between(50, 99), year + 1900).otherwise(year)


def ymd_to_mjd(year: Column, month: Column, day: Column) -> Column:
    """MJD of a Gregorian date with a fractional day; null for months outside 1..12 or years before -4699."""
    y = full_year(F.round(year)).cast("int")
    m = F.round(month).cast("int")
    whole = F.datediff(F.make_date(y, m, F.lit(1)), F.lit("1970-01-01").cast("date")) + F.lit(MJD_1970) - 1
    return F.when(m.between(1, 12) & (y >= -4699), whole.cast("double") + day.cast("double"))


def mjd_to_ymd(m: Column) -> Column:
    """struct<year int, month int, day double> of an MJD, the day with its fraction."""
    whole = F.floor(m)
    date = F.date_add(F.lit("1970-01-01").cast("date"), (whole - MJD_1970).cast("int"))
    return F.struct(F.year(date).alias("year"), F.month(date).alias("month"), (F.dayofmonth(date) + (m - whole)).alias("day"))


def ymd_to_dyear(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    part = F.lit(0.0) if hour is None else (hour + minute / 60.0 + second / 3600.0) / 24.0
    return mjd_to_dyear(ymd_to_mjd(year, month, day) + part)


def dyear_to_ymdhms(d: Column) -> Column:
    """struct<year, month, day, hour, minute, second> of a decimal year; a day that lacks under 1e-7 days counts as begun."""
    m = dyear_to_mjd(d)
    whole = fix(m + F.lit(1e-7))
    date, clock = mjd_to_ymd(whole), sec_to_hms((m - whole) * 86400.0)
    return F.struct(date["year"].alias("year"), date["month"].alias("month"), date["day"].cast("int").alias("day"), clock["hour"].alias("hour"), clock["minute"].alias("minute"), clock["second"].alias("second"))


def sec_to_hms(sec: Column) -> Column:
    hour = fix(sec / 3600.0)
    minute = fix(sec / 60.0) - hour * 60
    return F.struct(hour.cast("int").alias("hour"), minute.cast("int").alias("minute"), (sec - minute * 60 - hour * 3600).alias("second"))


def hms_to_sec(hour: Column, minute: Column, second: Column) -> Column:
    return (hour * 60 + minute) * 60 + second


def hms_to_str(hour: Column, minute: Column, second: Column) -> Column:
    return F.format_string("%02d:%02d:%06.3f", hour.cast("int"), minute.cast("int"), second.cast("double"))


def sec_to_str(sec: Column) -> Column:
    h = sec_to_hms(sec)
    return hms_to_str(h["hour"], h["minute"], h["second"])


def str_to_sec(s: Column) -> Column:
    """Seconds of 'hh:mm:ss.sss', 'hh:mm' or plain seconds."""
    p = F.split(s, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, hms_to_sec(part(0), part(1), part(2))).when(F.size(p) == 2, hms_to_sec(part(0), part(1), F.lit(0.0))).when(F.size(p) == 1, part(0))


def str_to_date(s: Column) -> Column:
    """Date of 'dd-mmm-yyyy', 'yyyy-mm-dd', 'dd-mm-yyyy' or 'dd-mm-yy' (two-digit years as in full_year); else null."""
    p = F.split(s, "-")
    short = F.make_date(full_year(F.get(p, F.lit(2)).try_cast("int")), F.get(p, F.lit(1)).try_cast("int"), F.get(p, F.lit(0)).try_cast("int"))
    by = lambda pattern: F.to_date(F.try_to_timestamp(s, F.lit(pattern)))
    return F.when(s.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), by("d-MMM-yyyy")).when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), by("yyyy-M-d")).when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), by("d-M-yyyy")).when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), short)


def date_to_str(d: Column) -> Column:
    return F.date_format(d, "dd-MMM-yyyy")


def mjd_to_gps(m: Column, group: list[str] | None = None) -> Column:
    """struct<week long, second double>. One week holds for all rows of the group, the earliest (all rows if no group)."""
    days = m - F.lit(float(MJD_GPS))
    week = F.min(F.floor(days / 7.0)).over(Window.partitionBy(*(group or [])))
    return F.struct(week.alias("week"), ((days - week * 7) * 86400.0).alias("second"))


def mjd_to_gps_rowwise(m: Column) -> Column:
    """As mjd_to_gps, each row with a week of its own; needs no window."""
    days = m - F.lit(float(MJD_GPS))
    week = F.floor(days / 7.0)
    return F.struct(week.alias("week"), ((days - week * 7) * 86400.0).alias("second"))


def gps_to_mjd(week: Column, second: Column) -> Column:
    return week * 7 + second / 86400.0 + F.lit(float(MJD_GPS))


def gps_to_timestamp(week: Column, second: Column) -> Column:
    return mjd_to_timestamp(gps_to_mjd(week, second))


def gps_to_str(week: Column, second: Column) -> Column:
    """'dd-mmm-yyyy HH:MM:SS.sss'."""
    day = F.floor(second / 86400.0)
    sec = second - day * 86400.0
    date = F.date_add(F.lit("1980-01-06").cast("date"), (week * 7 + day).cast("int"))
    return F.concat(date_to_str(date), F.lit(" "), sec_to_str(sec))


def str_to_gps(s: Column) -> Column:
    """struct<week, second> of 'date clock'."""
    days = F.datediff(str_to_date(F.substring_index(s, " ", 1)), F.lit("1980-01-06").cast("date"))
    week = F.floor(days / 7.0)
    return F.struct(week.alias("week"), (str_to_sec(F.substring_index(s, " ", -1)) + (days - week * 7) * 86400.0).alias("second"))


def gps_report(s: Column) -> Column:
    """struct<week, dow, doy, first, last> of a date string."""
    d = str_to_date(s)
    days = F.datediff(d, F.lit("1980-01-06").cast("date"))
    week = F.floor(days / 7.0)
    dow = days - week * 7
    return F.struct(week.alias("week"), dow.alias("dow"), F.dayofyear(d).alias("doy"), (dow * 86400).alias("first"), ((dow + 1) * 86400).alias("last"))
