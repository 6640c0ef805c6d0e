"""Check-in deadlines as timers of keyed state.

Silence makes no row, so what must happen when nothing came is a timer: each
person's state has one for the next time a check-in is due and one for the end
of its grace. A timer fires when the stream's clock, its watermark, has passed
it. What leaves is the moment at which something may have to be said; what to
say is the planner's business, who has the logs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import checkin
from ..scratch import Scratch

EVENT = "person bigint, at timestamp, kind string, due string, grace int, days array<string>, timezone string"
"""kind is settings (with the fields after it), checkin, or clock, which only moves the time on."""
MOMENT = "person bigint, at timestamp, stage string, day date"
KEPT_DAYS = 2
CLOCK = "clock"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass
class Kept:
    """One person's state: settings, what comes next (at, day, stage), the first check-in of each recent day, days missed with their end of grace, timers."""

    due: str | None = None
    grace: int | None = None
    days: list[str] = field(default_factory=list)
    timezone: str | None = None
    next: tuple[int, str, str] | None = None
    first: dict[str, int] = field(default_factory=dict)
    missed: dict[str, int] = field(default_factory=dict)
    timers: set[int] = field(default_factory=set)

    SCHEMA = "due string, grace int, days array<string>, timezone string, next_at bigint, next_day string, next_stage string, first_days array<string>, first_at array<bigint>, missed_days array<string>, missed_at array<bigint>, timers array<bigint>"

    @classmethod
    def of(cls, row: tuple | None) -> Kept:
        if row is None:
            return cls()
        due, grace, days, zone, at, day, stage, first_days, first_at, missed_days, missed_at, timers = row
        lasting = dict(zip(first_days, first_at, strict=True)), dict(zip(missed_days, missed_at, strict=True))
        return cls(due, grace, list(days), zone, None if at is None else (at, day, stage), *lasting, set(timers))

    def row(self) -> tuple:
        return (self.due, self.grace, self.days, self.timezone, *(self.next or (None, None, None)), list(self.first), list(self.first.values()), list(self.missed), list(self.missed.values()), sorted(self.timers))

    def day(self, ms: int) -> date:
        return datetime.fromtimestamp(ms / 1000, tz=ZoneInfo(self.timezone)).date()

    def next_due(self, after: int) -> None:
        """The next time a check-in is due after ``after``; none if no day is asked for."""
        asked, zone, today = {d[:3].lower() for d in self.days}, ZoneInfo(self.timezone), self.day(after)
        hour, minute = map(int, self.due.split(":"))
        for k in range(9):
            day = today + timedelta(days=k)
            due = _ms(datetime(day.year, day.month, day.day, hour, minute, tzinfo=zone))
            if due > after and checkin.DAYS[day.weekday()] in asked:
                self.next = (due, day.isoformat(), "remind")
                return
        self.next = None


class Deadlines(StatefulProcessor):
    """One person: remind at due, missed at due + grace, all_clear at a check-in after that; each once a day.

    State keeps the first check-in of each recent day, the next due time or end
    of grace, and the days that were missed, as one value that is read and
    written once a call: each access is a message between two processes.
    Moments leave only once the watermark has passed them, whatever order rows
    come in and however far the watermark moves at once, so a check-in that was
    under way is known by then.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", Kept.SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mine = Kept.of(self.kept.get())
        for _, when, told in sorted(rows, key=lambda r: (r[1], r[2] is None or r[2] == CLOCK)):
            at = _ms(_utc(when))
            if told == CLOCK:
                continue
            if told is not None:
                said = json.loads(told)
                mine.due, mine.grace, mine.days, mine.timezone = said.get("due"), said.get("grace"), said.get("days") or [], said.get("timezone")
                mine.next_due(at)
            elif mine.timezone is not None:
                day = mine.day(at).isoformat()
                mine.first[day] = min(at, mine.first.get(day, at))
        self._arm(mine)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, mine = timerValues.getCurrentWatermarkInMs(), Kept.of(self.kept.get())
        mine.timers.discard(expiredTimerInfo.getExpiryTimeInMs())  # a timer that fired is gone
        while mine.next is not None and mine.next[0] <= now:
            at, day, stage = mine.next
            checked = mine.first.get(day)
            silent = checked is None or checked > at
            if silent:
                yield _moment(key[0], at, stage, day)
            if silent and stage == "remind":
                mine.next = (at + mine.grace * 60_000, day, "missed")
            else:
                if silent:
                    mine.missed[day] = at
                mine.next_due(at)
        for day, late in list(mine.missed.items()):
            back = mine.first.get(day)
            if back is not None and late < back <= now:
                yield _moment(key[0], back, "all_clear", day)
                del mine.missed[day]
        old = (mine.day(now) - timedelta(days=KEPT_DAYS)).isoformat()
        for days in (mine.first, mine.missed):
            for day in [d for d in days if d < old]:
                del days[day]
        self._arm(mine)

    def close(self) -> None:
        pass

    def _arm(self, mine: Kept) -> None:
        """A timer for what comes next, and one for the check-in after a missed one; then the state is written."""
        wanted = {mine.next[0]} if mine.next is not None else set()
        wanted |= {mine.first[day] for day, late in mine.missed.items() if mine.first.get(day, late) > late}
        for t in mine.timers - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - mine.timers:
            self.handle.registerTimer(t)
        mine.timers = wanted
        if mine.timezone is not None:
            self.kept.update(mine.row())


def _utc(at: datetime) -> datetime:
    """Naive times of rows are in the session's zone, which is UTC."""
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def _ms(at: datetime) -> int:
    return (at - EPOCH) // timedelta(milliseconds=1)


def _moment(person: int, at: int, stage: str, day: str) -> Row:
    return Row(person=person, at=datetime.fromtimestamp(at / 1000, tz=UTC).replace(tzinfo=None), stage=stage, day=date.fromisoformat(day))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def moments(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """events: a stream of EVENT to MOMENT, each moment once. ``late``: how long check-ins may be under way.

    Rows of kind clock may have any person; they only move the watermark. The
    session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass`` = ROCKS).
    """
    # each cell that reaches Python costs microseconds, so a row has three: what is said is null for a check-in, else settings as JSON, else the clock
    settings = F.when(F.col("kind") == "settings", F.to_json(F.struct("due", "grace", "days", "timezone")))
    told = events.select("person", "at", F.coalesce(settings, F.when(~F.coalesce(F.col("kind") == "checkin", F.lit(False)), CLOCK)).alias("told"))
    return told.withWatermark("at", late).groupBy("person").transformWithState(Deadlines(), MOMENT, "Append", "EventTime")


def over_files(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """MOMENT of the events in the files at ``path``, run to the end once: for replays, and for questions about the past."""
    out, name = scratch.path("moments"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        moments(spark.readStream.schema(EVENT).parquet(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path("timers")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(MOMENT).parquet(out)


def planned(found: DataFrame, people: DataFrame, contacts: DataFrame, checkins: DataFrame, sent: DataFrame, plans: DataFrame, places: DataFrame, zone: Column | None = None) -> DataFrame:
    """The planner's messages at each of the moments ``found``: (person, stage, at) and checkin.MESSAGE, ``blocked``.

    people: checkin.PERSON without ``now``. Each moment is a plan of its own,
    with the check-ins up to it, so a batch may hold several of one person.
    """
    local = F.from_utc_timestamp("at", zone if zone is not None else F.col("timezone")).cast("timestamp_ntz")
    asked = found.select("person", "at", "stage").join(people.drop("now"), "person").withColumn("now", local)
    asked = asked.withColumn("moment", F.xxhash64("person", "at"))
    ids = asked.select("person", "moment", F.col("now").alias("_now"), "stage", F.col("at").alias("_at"))
    mine = lambda df: df.join(ids.select("person", "moment", "_now"), "person").drop("person").withColumnRenamed("moment", "person")
    seen = mine(checkins).filter(F.col("at").cast("timestamp_ntz") <= F.col("_now")).drop("_now")
    rest = [mine(df).drop("_now") for df in (contacts, sent, plans, places)]
    none = lambda names: found.sparkSession.createDataFrame([], names)
    messages, _ = checkin.plan(asked.drop("person", "at", "stage").withColumnRenamed("moment", "person"), rest[0], seen, rest[1], none("person bigint, key string, to string, subject string, body string"), rest[2], rest[3], none("person bigint, day date, title string, course string, kind string"))
    back = ids.select(F.col("moment"), F.col("person").alias("_person"), "stage", F.col("_at").alias("at"))
    return messages.withColumnRenamed("person", "moment").join(back, "moment").drop("moment").withColumnRenamed("_person", "person")


def each_moment(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, late: str = "0 seconds"):
    """Run ``send(moments, batch)`` over what has come due, once for each batch."""
    return moments(events, late).writeStream.foreachBatch(lambda df, n: send(df, n)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
