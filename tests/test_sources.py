"""Feeds and REST pages over HTTP on this machine, and the store read as a table."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from coursewatch.plans.state import Store
from coursewatch.plans import nightly
from coursewatch.sources import ical, polling, rest_json, sink, store_table

FEED = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:{0}\nDTSTART;VALUE=DATE:20261014\nEND:VEVENT\nEND:VCALENDAR"


@pytest.fixture
def site():
    """A server of whatever is put in its pages: path -> (status, headers, body)."""
    pages, asked = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self):
            asked.append((self.command, self.path))
            status, headers, body = pages.get(self.path, (404, {}, "nothing here"))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body.encode())

        do_GET = do_HEAD = answer

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", pages, asked
    server.shutdown()


def test_polled_feeds(spark, site, tmp_path):
    """A feed is read when it is new and when its server says that it changed; one that fails is a reading with an error."""
    base, pages, asked = site
    spark.dataSource.register(polling.PolledFeeds)
    pages["/a"], pages["/b"] = (200, {"ETag": "1"}, FEED.format("Quiz")), (200, {"Last-Modified": "Mon"}, "no calendar")
    feeds = json.dumps({c: f"{base}/{c}" for c in "abc"})

    def run():
        got = []
        q = spark.readStream.format("polled_feeds").option("feeds", feeds).load().writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()
        return got

    first = run()
    assert {(r.course_id, r.text is None) for r in first} == {("a", False), ("b", False), ("c", True)}
    rows = spark.createDataFrame(first, polling.SCHEMA).withColumn("timezone", F.lit("Mars/Base"))
    told, items = ical.readings(rows)
    assert {(r.course_id, r.status, r.error) for r in told.collect()} == {("a", "ok", None), ("b", "error", "not a calendar"), ("c", "error", "HTTP Error 404: Not Found")}
    assert [(i.course_id, i.title, i.start, i.ord) for i in items.collect()] == [("a", "Quiz", "2026-10-14", 1)]
    asked.clear()
    pages["/a"] = (200, {"ETag": "2"}, FEED.format("Essay"))
    second = run()
    assert [(r.course_id, "Essay" in r.text) for r in second] == [("a", True)]
    assert [p for m, p in asked if m == "GET"] == ["/a"]


def test_rest_pages_to_readings(spark, site):
    base, pages, _ = site
    spark.dataSource.register(rest_json.RestSource)
    page = "/api/v1/courses/{0}/assignments?per_page=100"
    one = [{"id": 1, "name": "HW &eacute;&copy; 1", "due_at": "2026-10-14T03:59:00Z", "published": True}]
    pages[page.format(7)] = (200, {"Link": f'<{base}/more>; rel="next"'}, json.dumps(one))
    pages["/more"] = (200, {}, json.dumps([{"id": 2, "name": "HW 2", "due_at": None, "published": True}]))
    pages[page.format(8)] = (500, {}, "down")
    rows = spark.read.format("course_rest").option("base", base).option("courses", "7,8").option("endpoint", "assignments").load()
    told, items = rest_json.readings(rows, F.lit("2026-09-05T23:00:00Z"), F.lit("UTC"))
    assert {(r.course_id, r.status, r.error) for r in told.collect()} == {("7", "ok", None), ("8", "error", "HTTP Error 500: Internal Server Error")}
    assert {(i.course_id, i.title, i.start) for i in items.collect()} == {("7", "HW &eacute;&copy; 1", "2026-10-14T03:59:00Z"), ("7", "HW 2", None)}


def test_saved_answers(spark, tmp_path):
    for name, text in (("assignments/c1", '[{"id": 1, "name": "HW", "due_at": "2026-10-14T03:59:00Z"}]'), ("assignments/c2", "{broken"), ("events/c1", '{"items": [{"title": "Talk", "start_at": "2026-10-15T10:00:00Z"}]}')):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(text)
    found = rest_json.files(spark, {e: str(tmp_path / e) for e in ("assignments", "events")}).collect()
    assert {(r.course_id, r.title, r.error) for r in found} == {("c1", "HW", None), ("c1", "Talk", None), ("c2", None, "json of assignments can't be read")}


def test_entities(spark):
    texts = ["caf&eacute; &copy; 2026", "a &lt;b&gt; &amp;lt; c", "&nosuch; &amp &#233;&#x2014;x", "x &ndash; y&nbsp;z", "AT&T & co", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rest_json.strip_html(F.col("t"))).collect()]
    assert got == ["café © 2026", "a <b> &lt; c", "&nosuch; &amp é-x", "x - y z", "AT&T & co", ""]


def test_store_as_a_table(spark, tmp_path):
    """Buckets by course, runs by id, earlier versions, views for SQL."""
    store = Store(spark, str(tmp_path), courses=4, keys=2)
    rows = lambda n, put=True: spark.createDataFrame([(f"c{i % 6}", f"c{i % 6}::{i}", put, i) for i in n], "course_id string, key string, put boolean, n int")
    for k, run in enumerate(("r1", "r2", "r3")):
        store.archive(run, {"changes": rows(range(k, k + 2)).drop("put")}, {"base": k})
        if run != "r3":
            store.commit(run, {"belief": rows(range(50 * k, 50 * k + 60))}, k, f"2026-09-0{k + 1}")
    belief = store_table.load(spark, str(tmp_path), "belief")
    assert belief.count() == 110 and store_table.load(spark, str(tmp_path), "belief", 1).count() == 60
    assert {(r.course_id, r.key, r.n) for r in belief.collect()} == {(r.course_id, r.key, r.n) for r in store.read("belief", "course_id string, key string, n int").collect()}
    one = belief.filter("course_id = 'c1'")
    assert {r.course_id for r in one.collect()} == {"c1"} and one.rdd.getNumPartitions() < belief.rdd.getNumPartitions()
    changes = store_table.load(spark, str(tmp_path), "changes")
    assert {(r.run_id, r.as_of, r.n) for r in changes.collect()} == {("r1", "2026-09-01", 0), ("r1", "2026-09-01", 1), ("r2", "2026-09-02", 1), ("r2", "2026-09-02", 2)}
    late = changes.filter("run_id > 'r1'")
    assert late.count() == 2 and late.rdd.getNumPartitions() == 1
    assert set(store_table.views(spark, str(tmp_path))) == {"course_belief", "course_changes"}
    assert spark.sql("SELECT count(*) FROM course_belief b JOIN course_changes c ON b.key = c.key WHERE c.run_id = 'r1'").first()[0] == 2
    with pytest.raises(Exception, match="has no table"):
        store_table.load(spark, str(tmp_path), "nothing")


def test_sink_sends_each_row_once(spark, tmp_path):
    """Failed rows are sent again, done ones aren't, whatever the job's attempt; answers are what a night records."""
    got, down = [], {"k3"}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            row = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append((row["key"], self.headers["Idempotency-Key"]))
            self.send_response(503 if row["key"] in down else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"event_id": "e-" + row["key"]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, results = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "results")
    ops = spark.createDataFrame([(f"k{i}", "create", None, f"Quiz {i}") for i in range(9)], "key string, op string, event_id string, summary string")
    first = {(r.key, r.status): r.event_id for r in sink.send(ops, url, results, parts=3).collect()}
    assert first == {(f"k{i}", "ok"): f"e-k{i}" for i in range(9) if i != 3} | {("k3", "failed"): None}
    assert sorted(k for k, _ in got) == sorted(f"k{i}" for i in range(9)) and ("k1", "create:k1") in got
    got.clear()
    down.clear()
    second = sink.send(ops, url, results, parts=3)
    assert got == [("k3", "create:k3")] and {r.status for r in second.collect()} == {"ok"} and second.count() == 9
    assert set(second.columns) == {f.split()[0] for f in nightly.RESULTS.split(", ")}
    server.shutdown()
