"""Rows sent to a service over HTTP, one request a row, each answer kept as it comes.

A task that is lost after it sent some of its rows is run again by Spark, and a
job may be run again by a person. So each answer is appended at once to a file
of its own under ``results``, and what those files say was done isn't sent
again; every request also carries the row's key as its Idempotency-Key, for a
service that got a request whose answer was lost with the task.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .store_table import fs, open_fs

TIMEOUT_S = 30
RESULTS = "key string, op string, event_id string, status string, seq bigint"


@dataclass
class Sent(WriterCommitMessage):
    ok: int
    failed: int
    before: int


class HttpWriter(DataSourceWriter):
    """Options: url; results, a folder that driver and executors share; key and op, the columns that name a row (key and op by default).

    A row's answer may have ``event_id``. Rows that were answered before, in any
    earlier attempt or job with the same results, are passed over; failed ones
    are sent again.
    """

    def __init__(self, options):
        self.url, self.results = options["url"], options["results"].rstrip("/")
        self.key, self.op = options.get("key", "key"), options.get("op", "op")

    def write(self, rows: Iterator) -> Sent:
        store, where = open_fs(self.results)
        store.create_dir(where, recursive=True)
        # rows are dealt by key, so what an earlier attempt did lies under this partition's number
        part = f"{where}/part-{TaskContext.get().partitionId():06d}"
        done, seq = self._done(store, part)
        count = {"ok": 0, "failed": 0}
        for row in rows:
            r = row.asDict(recursive=True)
            name = (r[self.key], r.get(self.op))
            if name in done:
                continue
            seq += 1
            found = self._send(r, name) | {"key": name[0], "op": name[1], "seq": seq}
            with store.open_output_stream(f"{part}/{seq:09d}-{uuid.uuid4().hex}.json") as f:
                f.write(json.dumps(found).encode())
            count[found["status"]] += 1
        return Sent(count["ok"], count["failed"], len(done))

    def _done(self, store, part: str) -> tuple[set, int]:
        """What was answered before, and the highest number of an answer: as many as a partition has rows."""
        store.create_dir(part, recursive=True)
        done, seq = set(), 0
        for i in store.get_file_info(fs.FileSelector(part)):
            with store.open_input_stream(i.path) as f:
                found = json.loads(f.read() or b"{}")
            seq = max(seq, found.get("seq", 0))
            if found.get("status") == "ok":
                done.add((found["key"], found["op"]))
        return done, seq

    def _send(self, row: dict, name: tuple) -> dict:
        try:
            head = {"Content-Type": "application/json", "Idempotency-Key": f"{name[1]}:{name[0]}"}
            request = urllib.request.Request(self.url, json.dumps(row, default=str).encode(), head, method="POST")
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
                body = json.loads(answer.read() or b"{}")
            return {"status": "ok", "event_id": body.get("event_id", row.get("event_id"))}
        except Exception as e:  # noqa: BLE001 - this row has failed, the others go on
            return {"status": "failed", "event_id": row.get("event_id"), "error": str(e)}


class HttpSink(DataSource):
    @classmethod
    def name(cls):
        return "course_sink"

    def writer(self, schema, overwrite):
        return HttpWriter(self.options)


PARTS = 32


def send(rows: DataFrame, url: str, results: str, key: str = "key", op: str = "op", parts: int = PARTS) -> DataFrame:
    """Send rows and return what is known of them: RESULTS, as nightly.record() takes them.

    Rows are dealt by key over ``parts`` partitions, the same ones each time.
    """
    spark = rows.sparkSession
    spark.dataSource.register(HttpSink)
    # a fixed number of partitions by key: a row finds its earlier answer wherever the job runs again
    rows.repartition(parts, key).write.format("course_sink").mode("append").option("url", url).option("results", results).option("key", key).option("op", op).save()
    return read_results(spark, results)


def read_results(spark: SparkSession, results: str) -> DataFrame:
    """The last answer of each (key, op)."""
    found = spark.read.schema(RESULTS).option("recursiveFileLookup", "true").json(results)
    return found.groupBy("key", "op").agg(F.max(F.struct("seq", "event_id", "status")).alias("r")).select("key", "op", "r.event_id", "r.status", "r.seq")
