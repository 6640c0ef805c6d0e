"""Dates and times as Catalyst expressions. Instants are in UTC; sessions run with spark.sql.session.timeZone=UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The academic window and the share of confidence that parts of a date earn.
WINDOW_BACK, WINDOW_AHEAD = 60, 300
BASE, EXPLICIT_YEAR, WEEKDAY, CHANGED, SEVERAL, TIMED, ZONED, CAP = 0.85, 0.05, 0.05, -0.1, -0.1, 0.05, 0.05, 0.98
RELATIVE, REVIEW_UNDER, EXACT = 0.7, 0.6, 0.98


def infer_year(month: Column, day: Column, read: Column) -> Column:
    """The date of a month and day without a year: the earliest valid one from 60 days before the read date on, else the latest valid one."""
    possible = F.transform(F.sequence(F.year(read) - 1, F.year(read) + 1), lambda y: F.try_to_date(F.concat_ws("-", y, month, day), "y-M-d"))
    valid = F.filter(possible, lambda d: d.isNotNull())
    return F.coalesce(F.array_min(F.filter(valid, lambda d: d >= F.date_sub(read, WINDOW_BACK))), F.array_max(valid))


def next_weekday(base: Column, weekday: Column) -> Column:
    """The first day after ``base`` with that weekday, Monday 0."""
    ahead = F.pmod(weekday - F.weekday(base), F.lit(7))
    return F.date_add(base, F.when(ahead == 0, 7).otherwise(ahead))


def weekday_conflict(stated: Column, day: Column) -> Column:
    return stated.isNotNull() & (F.weekday(day) != stated)


DEFAULT_ZONE = "America/New_York"


def known_zone(zone: Column, default: Column | None = None) -> Column:
    """The zone if Spark knows it, else ``default``, else DEFAULT_ZONE: an unknown name must not stop a job."""
    # a time written with the zone can be read only if there is such a zone; other ways of asking fail
    known = lambda z: z.rlike(r"^[A-Za-z+-][A-Za-z0-9_+:/-]*$") & F.concat(F.lit("2000-01-01 00:00:00 "), z).try_cast("timestamp").isNotNull()
    other = F.lit(DEFAULT_ZONE) if default is None else F.when(known(default), default).otherwise(DEFAULT_ZONE)
    return F.when(known(zone), zone).otherwise(other)


def instant(day: Column, clock: Column, zone: Column) -> Column:
    """Instant of a wall clock 'HH:mm' on a day in a zone."""
    part = lambda k: F.split(clock, ":")[k].cast("int")
    return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), part(0), part(1), F.lit(0).cast("decimal(16,6)"), zone)


def iso_local(at: Column, zone: Column) -> Column:
    """ISO 8601 with the zone's offset at that instant."""
    local = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(at)) / 60).cast("int")
    size = F.abs(minutes)
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def written_day(iso: Column) -> Column:
    """The day as an ISO string writes it, whatever its offset."""
    return F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd")


def exclusive_end(last: Column) -> Column:
    """Calendars end all-day events on the day after."""
    return F.date_add(last, 1)


def api_bounds(start: Column, end: Column, all_day: Column) -> Column:
    """Struct (start, end) as calendars take them: days with an exclusive end, times as they are; nulls without a start."""
    last = F.coalesce(end, start)
    return F.struct(
        F.when(all_day, written_day(start).cast("string")).otherwise(start).alias("start"),
        F.when(start.isNull(), None).when(all_day, exclusive_end(written_day(last)).cast("string")).otherwise(last).alias("end"),
    )


def inclusive_end(start: Column, exclusive: Column) -> Column:
    return F.greatest(start, F.date_sub(exclusive, 1))


def confidence(explicit_year: Column, weekday: Column, changed: Column, several: Column, timed: Column, zoned: Column) -> Column:
    add = lambda flag, x: F.when(flag, F.lit(x)).otherwise(F.lit(0.0))
    total = F.lit(BASE) + add(explicit_year, EXPLICIT_YEAR) + add(weekday, WEEKDAY) + add(changed, CHANGED) + add(several, SEVERAL) + add(timed, TIMED) + add(timed & zoned, ZONED)
    return F.round(F.least(total, F.lit(CAP)), 2)


def same_schedule(a, b) -> Column:
    """Null-safe equality of start, end and all_day of two frames' columns; null-safe terms stay hash keys of a join."""
    return a["start"].eqNullSafe(b["start"]) & a["end"].eqNullSafe(b["end"]) & a["all_day"].eqNullSafe(b["all_day"])


def posted_day(text: Column) -> Column:
    """Day of ISO, month-day-year, numeric or day-month-year text; null without a year."""
    two = lambda y: F.when(F.length(y) <= 2, y.cast("int") + 2000).otherwise(y.cast("int"))
    at = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    named = lambda d, m, y: F.try_to_date(F.concat_ws(" ", d, F.initcap(F.substring(m, 1, 3)), y), "d MMM y")
    md, dm, n = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b", r"\b(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})\b", r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"
    return F.coalesce(
        F.try_to_date(at(r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd"),
        named(at(md, 2), at(md, 1), at(md, 3)),
        F.try_to_date(F.concat_ws("-", two(at(n, 3)), at(n, 1), at(n, 2)), "y-M-d"),
        named(at(dm, 1), at(dm, 2), at(dm, 3)),
    )


ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?$"


def moment(text: Column, zone: Column) -> Column:
    """Instant of an ISO time with Z or an offset, or in ``zone`` without; null if it isn't one."""
    fine = F.regexp_replace(text, "Z$", "+00:00").rlike(ISO_TIME)
    stated = text.rlike(r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$")
    at = F.try_to_timestamp(F.when(fine, text))
    return F.when(stated, at).otherwise(F.to_utc_timestamp(at, zone))


def exact(start: Column, end: Column, all_day: Column, zone: Column) -> Column:
    """Like a parsed phrase, from a source's own times: rendered in the course's zone, ends never before starts.

    A date alone, or a time of an item that lasts all day, gives days as
    written; what is no time makes the item one to look at.
    """
    whole = F.coalesce(all_day, F.lit(False)) | ((F.length(start) == 10) & ~F.contains(start, F.lit("T")))
    first, last = written_day(start), written_day(F.coalesce(F.nullif(end, F.lit("")), start))
    at, until = moment(start, zone), F.when(F.coalesce(end, F.lit("")) == "", moment(start, zone)).otherwise(moment(end, zone))
    fine = F.when(whole, first.isNotNull() & last.isNotNull()).otherwise(at.isNotNull() & until.isNotNull())
    told = lambda day, time: F.when(fine, F.when(whole, day.cast("string")).otherwise(iso_local(time, zone)))
    return F.struct(
        told(first, at).alias("start"),
        told(last, F.greatest(at, until)).alias("end"),
        (whole | ~fine).alias("all_day"),
        F.when(fine, EXACT).otherwise(0.0).alias("confidence"),
        (~fine).alias("needs_review"),
        F.when(fine, "").otherwise(F.concat(F.lit("unparseable machine timestamp '"), start, F.lit("'"))).alias("reason"),
        F.lit(None).cast("string").alias("superseded"),
        F.when(fine, F.array(F.when(whole, "exact date from the source system").otherwise("exact timestamp from the source system"))).otherwise(F.array().cast("array<string>")).alias("assumptions"),
    )


def read_day(iso: Column) -> Column:
    """The day that an ISO time writes."""
    return written_day(iso)


def shown(event: Column) -> Column:
    """An event's days or time as change notes show them."""
    days = F.when(F.coalesce(event["end"], event["start"]) == event["start"], event["start"]).otherwise(F.concat_ws("..", event["start"], event["end"]))
    return F.when(event["start"].isNull(), "(no date)").when(event["all_day"], days).otherwise(event["start"])
