"""Calendar feeds, in built-in functions."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import dates as D
from ..functions import text as T

# Fixed value: what feeds append to a summary.
SUFFIX = r"(?i)\s*[-–:]\s*(due|due date|availability (starts|ends)|starts|ends|opens|closes|available)\s*$"


def status(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("BEGIN:VCALENDAR")), "ok").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("error")


def _rest(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def components(text: Column) -> Column:
    """The bodies of VEVENTs, continuation lines joined."""
    unfolded = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n[ \t]", "")
    return F.transform(_rest(F.split(unfolded, "BEGIN:VEVENT\n")), lambda x: F.split(x, "\nEND:VEVENT")[0])


def prop(body: Column, name: str) -> Column:
    """Value of a property, the last if it is repeated; null if it is missing."""
    return F.nullif(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(body, F.lit(rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$"), 1)), -1), F.lit(""))


def params(body: Column, name: str) -> Column:
    return F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(body, F.lit(rf"(?m)^{name}((?:;[^:\n]*)?):.*$"), 1)), -1)


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")


def clean_summary(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(T.clean_ascii(unescape(c)), r"\s*\[[^\]]*\]\s*$", ""), SUFFIX, "")
    return F.regexp_replace(bare, r"^[ \-–:]+|[ \-–:]+$", "")


def zone(written: Column, default: Column) -> Column:
    """TZID if it names a known zone of a region, else the course's."""
    tzid = F.regexp_extract(written, r'TZID="?([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)"?', 1)
    return F.when(tzid.rlike("^[A-Z][A-Za-z_]+/[A-Z]"), D.known_zone(tzid, default)).otherwise(default)


def moment(body: Column, name: str, tz: Column) -> Column:
    """Struct (day, at): a day, or an instant. UTC with Z, else in the TZID or the course's zone."""
    value, written = prop(body, name), params(body, name)
    is_day = value.rlike(r"^\d{8}$") | F.contains(F.upper(written), F.lit("VALUE=DATE")) & ~F.contains(F.upper(written), F.lit("VALUE=DATE-TIME"))
    clock = F.concat_ws(":", F.substring(value, 10, 2), F.substring(value, 12, 2))
    day = F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd")
    in_zone = F.when(value.endswith("Z"), F.lit("UTC")).otherwise(zone(written, tz))
    seconds = F.coalesce(F.try_to_number(F.substring(value, 14, 2), F.lit("00")).cast("int"), F.lit(0))
    at = D.instant(day, clock, in_zone) + F.make_dt_interval(secs=seconds)
    return F.struct(F.when(is_day, day).alias("day"), F.when(~is_day, at).alias("at"))


def items(feeds: DataFrame) -> DataFrame:
    """feeds: (course_id, source_url, timezone, text) to items with exact times.

    A recurring event has no exact time and says so in review_reason; an event
    without a start gets 'TBD'.
    """
    tz = F.col("timezone")
    feeds = feeds.withColumn("timezone", D.known_zone(tz))
    ev = feeds.filter(status(F.col("text")) == "ok").select("course_id", "source_url", "timezone", F.posexplode(components(F.col("text"))).alias("pos", "b"))
    b = F.col("b")
    ev = ev.withColumns({"title": clean_summary(F.coalesce(prop(b, "SUMMARY"), F.lit(""))), "s": moment(b, "DTSTART", tz), "e": moment(b, "DTEND", tz), "due": moment(b, "DUE", tz), "rrule": prop(b, "RRULE"), "url": F.coalesce(prop(b, "URL"), "source_url"), "detail": F.substring(T.clean_ascii(unescape(prop(b, "DESCRIPTION"))), 1, 500)})
    ev = ev.withColumn("e", F.when(prop(b, "DTEND").isNull(), F.col("due")).otherwise(F.col("e")))
    all_day = F.col("s.day").isNotNull()
    start = F.when(all_day, F.col("s.day").cast("string")).otherwise(D.iso_local(F.col("s.at"), tz))
    last = D.inclusive_end(F.col("s.day"), F.col("e.day")).cast("string")
    end = F.coalesce(F.when(all_day, last).otherwise(D.iso_local(F.col("e.at"), tz)), start)
    recurs = F.col("rrule").isNotNull()
    text = F.when(recurs, F.concat(F.lit("recurring ("), F.col("rrule"), F.lit(") from "), F.coalesce(start, F.lit("?")))).when(start.isNull(), "TBD").when(end != start, F.concat(start, F.lit(" to "), end)).otherwise(start)
    exact = ~recurs & start.isNotNull()
    return ev.filter("title <> ''").select(
        "course_id", "pos", "title", text.alias("date_text"),
        F.when(recurs, "class").when(start.isNull(), "assignment").otherwise(T.kind_in_feed(F.col("title"))).alias("kind"),
        "url", F.when(exact, start).alias("start"), F.when(exact, end).alias("end"), F.when(exact, all_day).alias("all_day"), "detail",
        F.when(recurs, "recurring event").alias("review_reason"),
    )


NIGHT_ITEM = ("course_id", "ord", "pos", "title", "date_text", "kind", "url", "source_url", "posted_at", "detail", "start", "end", "all_day", "review_reason", "read_at", "timezone")
"""Columns of items as a night takes them."""


def for_a_night(items_: DataFrame, ord_: int) -> DataFrame:
    """Items of a source as a night takes them: reading number ``ord_`` of each course, columns that the source lacks null."""
    have = items_.withColumn("ord", F.lit(ord_))
    return have.select(*[F.col(c) if c in have.columns else F.lit(None).cast("boolean" if c == "all_day" else "string").alias(c) for c in NIGHT_ITEM])


def readings(feeds: DataFrame, ord_: int = 1) -> tuple[DataFrame, DataFrame]:
    """Readings and items of what feeds gave, for a night: (course_id, source_url, timezone, text, error, read_at), a row a feed.

    A feed that couldn't be had, or is no calendar, is an error with its reason;
    one without text is empty. Each course has one feed here; give further ones
    another ``ord_``.
    """
    had = F.when(F.col("error").isNotNull(), "error").otherwise(status(F.col("text")))
    why = F.coalesce("error", F.when(had == "error", "not a calendar"))
    told = feeds.select("course_id", F.lit(ord_).alias("ord"), "source_url", "read_at", had.alias("status"), why.alias("error"), D.known_zone(F.col("timezone")).alias("timezone"), F.lit(False).alias("partial"))
    return told, for_a_night(items(feeds.filter(F.col("error").isNull())), ord_)


TIMEOUT_S = 30


@dataclass
class Feed(InputPartition):
    course: str
    url: str


class FeedReader(DataSourceReader):
    """One partition a feed; a feed that can't be had gives a row with an error. Option feeds: JSON of course ids and urls."""

    def __init__(self, options):
        self.feeds = json.loads(options["feeds"])

    def partitions(self):
        return [Feed(c, u) for c, u in sorted(self.feeds.items())]

    def read(self, partition: Feed):
        try:
            request = urllib.request.Request(partition.url, headers={"User-Agent": "coursewatch"})
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
                yield partition.course, partition.url, answer.read().decode("utf-8", "replace"), None
        except Exception as e:  # noqa: BLE001 - the reading has failed, the others go on
            yield partition.course, partition.url, None, str(e)


class FeedSource(DataSource):
    @classmethod
    def name(cls):
        return "course_feed"

    def schema(self):
        return "course_id string, source_url string, text string, error string"

    def reader(self, schema):
        return FeedReader(self.options)
