"""Feeds that are polled: a stream that reads a feed again when its server says that it changed.

An offset holds each feed's validator, its ETag or else its Last-Modified, as
the last poll saw it. A feed whose validator is another one by the next poll is
read by a task; one without either is read at every poll. A feed that can't be
had gives a row with its error, once for each error, so that a night knows that
the reading failed.
"""

from __future__ import annotations

import json
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .ical import TIMEOUT_S

SCHEMA = "course_id string, source_url string, text string, error string, read_at string"
POLLERS = 16
"""Feeds that are asked at the same time for their validators."""


@dataclass
class Changed(InputPartition):
    course: str
    url: str


def _request(url: str, method: str):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "coursewatch"}, method=method), timeout=TIMEOUT_S)


def validator(url: str, poll: int) -> str:
    try:
        with _request(url, "HEAD") as answer:
            return answer.headers.get("ETag") or answer.headers.get("Last-Modified") or f"poll {poll}"
    except Exception as e:  # noqa: BLE001 - it can't be had; that is what the reading says
        return f"error {e}"


class PollReader(DataSourceStreamReader):
    """Option feeds: JSON of course ids and urls."""

    def __init__(self, options):
        self.feeds = sorted(json.loads(options["feeds"]).items())
        self.polls = 0

    def initialOffset(self) -> dict:
        return {"polls": 0, "seen": {}}

    def latestOffset(self) -> dict:
        self.polls += 1
        with ThreadPoolExecutor(POLLERS) as pool:
            seen = dict(zip((c for c, _ in self.feeds), pool.map(lambda f: validator(f[1], self.polls), self.feeds), strict=True))
        return {"polls": self.polls if any(v.startswith("poll ") for v in seen.values()) else 0, "seen": seen}

    def partitions(self, start: dict, end: dict):
        return [Changed(c, u) for c, u in self.feeds if c in end["seen"] and end["seen"][c] != start["seen"].get(c)]

    def read(self, partition: Changed):
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        try:
            with _request(partition.url, "GET") as answer:
                yield partition.course, partition.url, answer.read().decode("utf-8", "replace"), None, now
        except Exception as e:  # noqa: BLE001 - the reading has failed, the others go on
            yield partition.course, partition.url, None, str(e), now

    def commit(self, end: dict) -> None:
        pass


class PolledFeeds(DataSource):
    @classmethod
    def name(cls):
        return "polled_feeds"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return PollReader(self.options)
