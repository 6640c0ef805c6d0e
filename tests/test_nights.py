"""Guards, folds, state, sources and streams on small hand-made cases."""

import datetime

from pyspark.sql import functions as F

from coursewatch.functions import text as T
from coursewatch.operators import diff, resolve
from coursewatch.plans import ledger, reports
from coursewatch.plans.state import next_run_id
from coursewatch.scratch import Scratch
from coursewatch.sources import html_items, ical, readings, rest_json
from coursewatch.streaming import incremental

ITEM = "course_id string, key string, title string, start string, end string, all_day boolean"


def items(spark, *rows):
    return spark.createDataFrame([(c, f"{c}::{t.lower()}", t, s, s, True) for c, t, s in rows], ITEM)


def test_null_schedules_are_equal(spark):
    a = items(spark, ("c", "X", None), ("c", "Y", "2026-10-01"))
    assert diff.changes(a, a).count() == 0


def test_guards(spark):
    prev = items(spark, ("ok", "A", "2026-10-01"), ("bad", "B", "2026-10-01"), ("gone", "C", "2026-10-01"), ("blank", "D", "2026-10-01"))
    cur = items(spark, ("ok", "A", "2026-10-02"), ("bad", "Z", "2026-10-01"))
    reads = spark.createDataFrame([("ok", "ok"), ("bad", "error"), ("blank", "ok")], "course_id string, status string")
    got = {(r.course_id, r.type) for r in diff.guarded(prev, cur, reads).collect()}
    assert got == {("ok", "moved"), ("bad", "unreadable"), ("gone", "not_read"), ("blank", "unreadable")}


def test_greedy_equals_one_pass(spark):
    pairs = [("c", f"r{r}", f"a{a}", ((r * 7 + a * 5) % 11) / 10) for r in range(8) for a in range(6)]
    df = spark.createDataFrame(pairs, "course_id string, removed string, added string, sim double")
    used, want = set(), set()
    for sim, r, a in sorted(((p[3], p[1], p[2]) for p in pairs), reverse=True):
        if r not in used and a not in used:
            used |= {r, a}
            want.add((r, a))
    assert {(r.removed, r.added) for r in diff.assign(df, Scratch(spark)).collect()} == want


def test_few_pairs_are_compared_letter_by_letter(monkeypatch):
    """Ratios of at least the threshold are exact; of random titles, whose letters are the same, none is compared in full."""
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(4)
    title = lambda n: " ".join("".join(rnd.choices("0123456789abcdef", k=16)) for _ in range(n))
    near = lambda s: "".join(rnd.choice("0123456789abcdef") if rnd.random() < 0.3 else c for c in s)
    x = [title(2) for _ in range(300)] + [title(5) for _ in range(20)] + ["", None, "exam 1", "a" * 64, "b" * 65]
    y = [near(s) for s in x[:200]] + [title(2) for _ in range(100)] + [near(s) for s in x[300:320]] + ["exam", "exam", "exam 1 revised", "a" * 70, "b" * 65]
    want = [SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y, strict=True)]
    got = T.ratios_from(x, y, 0.55)
    assert all(g == w if w >= 0.55 else g < 0.55 for g, w in zip(got, want, strict=True)) and sum(w >= 0.55 for w in want) > 50
    monkeypatch.setattr(T, "SequenceMatcher", None)
    assert not T.ratios_from([title(2) for _ in range(300)], [title(2) for _ in range(300)], 0.55).any()


def test_single_mentions_pass_without_python_values(spark, monkeypatch):
    """Only items with several mentions, or whose sources repeat, are folded; single ones come out as the fold leaves them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    types = "start string, end string, all_day boolean, date_text string, confidence double, needs_review boolean, review_reason string, superseded string, detail string, sources array<string>, assumptions array<string>, carry string"
    rows = [(k, *mention(0, f"2026-10-{d:02}", **more)[2:], "") for k, d, more in (("a", 1, {}), ("b", 2, {}), ("b", 3, {}), ("c", 4, {"sources": ["u", "u"]}), ("d", 5, {"sources": None, "assumptions": None}), (None, 6, {}), (None, 6, {}), ("e", 7, {}), ("f", 8, {}))]
    ins = to_arrow_schema(spark.createDataFrame([], f"key string, {types}").schema)
    outs = to_arrow_schema(spark.createDataFrame([], f"key string, n_mentions long, event {resolve.EVENT}").schema)
    cut = lambda *at: [pa.RecordBatch.from_pylist([dict(zip(ins.names, r, strict=True)) for r in rows[a:b]], schema=ins) for a, b in zip((0, *at), (*at, len(rows)), strict=True)]
    told = lambda *at: sorted(str(sorted(r.items())) for b in resolve._folded(iter(cut(*at)), ["key"], outs) for r in b.to_pylist())
    alone = resolve._alone
    fast = [told(), told(2), told(1, 6), told(1, 2, 3, 4, 5, 6, 7, 8)]
    assert pa.compute.sum(alone(cut()[0], 1, None)).as_py() == 2  # a and e
    monkeypatch.setattr(resolve, "_alone", lambda batch, n_by, last: pa.array([False] * batch.num_rows, pa.bool_()))
    assert all(f == told() for f in fast) and len(told()) == 7


def mention(pos, start, **more):
    base = {"start": start, "end": start, "all_day": True, "date_text": start, "confidence": 0.85, "needs_review": False, "review_reason": "", "superseded": None, "detail": "", "sources": [f"s{pos}"], "assumptions": []}
    return ("k", pos, *(base | more).values())


def fold(spark, *rows):
    types = "start string, end string, all_day boolean, date_text string, confidence double, needs_review boolean, review_reason string, superseded string, detail string, sources array<string>, assumptions array<string>"
    return resolve.fold(spark.createDataFrame(list(rows), f"key string, pos int, {types}"), ["key"], ["pos"]).first()["event"]


def test_fold(spark):
    assert fold(spark, mention(1, "2026-10-14"), mention(2, "2026-10-16"))["needs_review"]
    changed = fold(spark, mention(1, "2026-10-14"), mention(2, "2026-10-16", superseded="2026-10-14"))
    assert (changed["start"], changed["needs_review"], changed["sources"]) == ("2026-10-16", False, ["s1", "s2"])
    assert fold(spark, mention(1, "2026-10-14"), mention(2, "2026-10-16"), mention(3, "2026-10-17"))["start"] == "2026-10-17"
    assert not fold(spark, mention(1, "2026-10-14"), mention(2, "2026-10-14T10:00:00-04:00", all_day=False))["all_day"]


def test_fold_of_very_many_mentions(spark):
    """A key with nearly all rows, over several Arrow batches, by the same rules as a loop; null keys are a key; an empty table gives none."""
    def loop(rows):
        event = None
        for r in rows:
            m = dict(zip(resolve.FIELDS[:-1], r, strict=True))
            m |= {"sources": dict.fromkeys(m["sources"]), "assumptions": list(m["assumptions"])}
            event = m if event is None else resolve.merge_two(event, m)
        return event | {"sources": list(event["sources"]), "assumptions": list(event["assumptions"])}

    many = [(("big", pos) if pos % 50 else (None, pos)) + mention(pos, f"2026-10-{14 + pos % 2 * (pos > 24_000)}", confidence=0.5 + pos % 7 / 20, sources=[f"s{pos % 9}"])[2:] for pos in range(25_000)]
    schema = "key string, pos int, start string, end string, all_day boolean, date_text string, confidence double, needs_review boolean, review_reason string, superseded string, detail string, sources array<string>, assumptions array<string>"
    found = {r.key: r for r in resolve.fold(spark.createDataFrame(many, schema).repartition(7), ["key"], ["pos"]).collect()}
    for key in ("big", None):
        rows = [m[2:] for m in many if m[0] == key]
        want, got = loop(rows), found[key].event.asDict()
        assert found[key].n_mentions == len(rows) and {k: got[k] for k in want} == want
    assert resolve.fold(spark.createDataFrame([], schema), ["key"], ["pos"]).count() == 0


def test_rewording_bounds_lose_nothing(spark):
    words = "quiz essay final lab report draft one two three on the of".split()
    titles = [" ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 5)) for i in range(40)] + ["", "!!", "a"]
    side = lambda name: spark.createDataFrame([("c", f"{name}{i}", t, "2026-10-01", "2026-10-01", True) for i, t in enumerate(titles)], ITEM)
    got = {(r.removed, r.added): r.sim for r in diff.reword_pairs(side("r"), side("a")).collect()}
    pairs = spark.createDataFrame([(f"r{i}", f"a{j}", x, y) for i, x in enumerate(titles) for j, y in enumerate(titles)], "r string, a string, x string, y string")
    slow = {(p.r, p.a): p.s for p in pairs.select("r", "a", T.similarity(T.slug(F.col("x")), T.slug(F.col("y"))).alias("s")).collect() if p.s >= diff.REWORD_THRESHOLD}
    assert got == slow and len(got) > 100


def test_unknown_zones(spark):
    """A zone that isn't one falls back to the course's, and that to the default; other feeds are read all the same."""
    event = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:Quiz\nDTSTART;TZID={0}:20261014T100000\nEND:VEVENT\nEND:VCALENDAR"
    rows = [("a", "America/Chicago", event.format("America/Nowhere")), ("b", "Mars/Base", event.format("Europe/Berlin")), ("c", None, event.format("Eastern Time")), ("d", "Mars/Base", event.format("Mars/Base"))]
    feed = spark.createDataFrame([(c, "u", z, t) for c, z, t in rows], "course_id string, source_url string, timezone string, text string")
    assert {r.course_id: r.start for r in ical.items(feed).collect()} == {"a": "2026-10-14T10:00:00-05:00", "b": "2026-10-14T04:00:00-04:00", "c": "2026-10-14T10:00:00-04:00", "d": "2026-10-14T10:00:00-04:00"}


def test_gate_of_too_many_deletions(spark):
    rows = [("c", "delete", None, True, False, 0.9, "e", True, 5, datetime.date(2026, 9, 1))] * 3 + [("d", "delete", None, True, False, 0.9, "e", True, 7, datetime.date(2026, 9, 1))] * 3
    df = spark.createDataFrame(rows, "course_id string, op string, course_state string, has_change boolean, needs_review boolean, confidence double, event_id string, confirmed boolean, n_belief int, start_day date")
    got = {(r[0], r[1]) for r in ledger.gate(df, F.lit("2026-09-05").cast("date")).select("course_id", "block_reason").collect()}
    assert got == {("c", "mass deletion"), ("d", "")}


def test_gate_counts_deletions_of_a_missing_course(spark):
    rows = [(None, op, None, True, False, 0.9, "e", True, 4, datetime.date(2026, 9, 9)) for op in ("delete", "delete", "delete", "update")] + [("c", "delete", None, True, False, 0.9, "e", True, 1, datetime.date(2026, 9, 9))]
    df = spark.createDataFrame(rows, "course_id string, op string, course_state string, has_change boolean, needs_review boolean, confidence double, event_id string, confirmed boolean, n_belief int, start_day date")
    got = sorted((r.course_id or "", r.op, r.block_reason) for r in ledger.gate(df, F.lit("2026-09-05").cast("date")).collect())
    assert got == [("", "delete", "mass deletion")] * 3 + [("", "update", ""), ("c", "delete", "")]
    assert ledger.gate(df.limit(0), F.lit("2026-09-05").cast("date")).columns == [*df.columns, "block_reason"]


def test_digest_of_nothing_and_of_one_day(spark):
    today, line = F.lit("2026-10-01").cast("date"), "section string, ord string, line string"
    lines = lambda rows: [(r.section[0], r.line) for r in reports.headed(spark.createDataFrame(rows, line), today, Scratch(spark)).orderBy("section", "ord", "line").collect()]
    none = [("2", "Changed since 2026-09-24: 0"), ("2", "nothing has changed"), ("3", "Dates that moved this term")]
    assert lines([]) == [("0", "Week of 2026-10-01"), ("1", "Due until 2026-10-08: 0"), ("1", "nothing is due in this time"), *none, ("3", "no date has moved")]
    rows = [("1 due", "2026-10-02T10:00:00-04:00 Quiz", "q"), ("1 due", "2026-10-02 Essay", "e"), ("1 due", "2026-10-03 Lab", "l"), ("3 volatility", "999999999999999997c", "c: 0"), ("3 volatility", "999999998999999997d", "d: 1"), ("5 needs your decision", "c x", "x")]
    assert lines(rows) == [("0", "Week of 2026-10-01"), ("1", "Due until 2026-10-08: 3"), ("1", "Fri Oct 02: 2"), ("1", "e"), ("1", "q"), ("1", "Sat Oct 03: 1"), ("1", "l"), *none, ("3", "d: 1"), ("3", "c: 0"), ("3", "moves most: d: 1"), ("5", "To decide: 1"), ("5", "x")]


def test_run_ids():
    assert next_run_id("x", {"x", "x-2"}) == "x-3" and next_run_id("y", {"x"}) == "y"


def test_html_tolerates_bad_markup(spark):
    pages = [
        "<nav><li>Oct 1</li></nav><h2>Syllabus</h2><table><tr><th>Date</th><th>Oct 9</th></tr><tr><td>Midterm</td><td class=date>Oct 14</tr></table></div><p>end",
        "",
        "<p>x</p>",
        "<div>" * 5000 + "Quiz due Oct 14 with enough text" + "</div>" * 5000,
        None,
        '<h3>News</h3><div class="announcement"><a href="/n?a=1">Exam room</a> Posted: Sep 3, 2026 <p>The quiz is on Oct 16 in room 2.</p></div><li>Essay due: Oct 20</li><li>nothing here</li>',
        '<ul class="card-list"><li class="item">Outer Oct 1 <div class="item"><b>Inner</b> Oct 2</div></li></ul> and more text here',
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    got = {r.k: (r.r["status"], [(i["title"], i["date_text"], i["section"], i["url"], i["posted_at"], i["detail"]) for i in r.r["items"]]) for r in df.select("k", html_items.items_of(F.col("html")).alias("r")).collect()}
    assert got[0] == ("ok", [("Midterm", "Oct 14", "syllabus", "", None, "")])
    assert got[1] == got[2] == got[4] == ("empty", []) and got[3] == ("ok", [])
    assert got[5] == ("ok", [("Exam room", "The quiz is on Oct 16 in room 2.", "announcements", "/n?a=1", "Sep 3, 2026", "The quiz is on Oct 16 in room 2."), ("Essay", "Essay due: Oct 20", "announcements", "", None, "")])
    assert got[6] == ("ok", [("Inner", "Oct 2", "", "", None, "")])


def test_ical(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Essay\\, one [CS]\r\nDTSTART;VALUE=DATE:20261014\r\nDTEND;VALUE=DATE:20261017\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Quiz 2 - Due\r\nDTSTART;TZID=America/Chicago:20261014T100000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Class\r\nDTSTART:20261014T100000Z\r\nRRULE:FREQ=WEEKLY\r\nEND:VEVENT\r\nEND:VCALENDAR"
    feed = spark.createDataFrame([("c", "u", "America/New_York", text)], "course_id string, source_url string, timezone string, text string")
    got = {r.title: r for r in ical.items(feed).collect()}
    assert (got["Essay, one"].start, got["Essay, one"].end, got["Essay, one"].all_day) == ("2026-10-14", "2026-10-16", True)
    assert got["Quiz 2"].start == "2026-10-14T11:00:00-04:00" and got["Quiz 2"].kind == "exam"
    assert got["Class"].review_reason and got["Class"].start is None


def test_rest_and_links(spark):
    a = spark.createDataFrame([("c", 1, "HW", "2026-10-14T03:59:00Z", None, True, None), ("c", 2, "No", None, None, False, None), ("c", 3, "Open", None, None, True, None)], "course_id string, " + rest_json.ASSIGNMENT)
    n = spark.createDataFrame([("c", 1, "News", "<p>Quiz&nbsp;moved to Oct 16</p>", "2026-09-01T00:00:00Z", None, None), ("c", 2, "Hi", "<p>hello</p>", None, None, None)], "course_id string, " + rest_json.ANNOUNCEMENT)
    e = spark.createDataFrame([], "course_id string, " + rest_json.EVENT)
    assert {(r.title, r.date_text) for r in rest_json.items(a, n, e).collect()} == {("HW", "due 2026-10-14T03:59:00Z"), ("Open", "no due date set"), ("News", "Quiz moved to Oct 16")}
    assert rest_json.next_link('<http://a>; rel="prev", <http://b>; rel="next"') == "http://b"


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"course_id": "c", "read_at": "2026-09-05T23:00:00-04:00", "source_url": "u", "items": [{"title": " A ", "date_text": "Oct 1"}, {"title": ""}]}')
    (tmp_path / "b.json").write_text("{nonsense")
    r = readings.read_json(spark, str(tmp_path)).cache()
    assert readings.invalid(r).count() == 1
    assert [(i.title, i.source, i.kind) for i in readings.items(r.filter("course_id is not null")).collect()] == [("A", "u", "assignment")]


def test_streamed_counter_equals_batch(spark, tmp_path):
    days = [datetime.date(2026, 9, d) for d in range(1, 9)]
    here = {"x": {1, 4}, "y": {1, 2, 7}, "z": {1}}
    rows = [(k, d, d.day in seen) for k, seen in here.items() for d in days]
    schema = "key string, day date, present boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = incremental.removal_counter(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("removed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    streamed = {(r.key, r.first_missing, r.confirmed_on) for r in spark.table("removed").collect()}
    seen = spark.createDataFrame([(k, datetime.date(2026, 9, d)) for k, s in here.items() for d in s], "key string, day date")
    batch = {(r.key, r.first_missing, r.confirmed_on) for r in diff.removals(seen, spark.createDataFrame([(d,) for d in days], "day date")).collect()}
    assert streamed == batch


def test_deadline_timers_and_the_planner(spark, tmp_path):
    """Silence reminds at due and alerts at the end of grace, once each, whatever order rows come in; the planner says it; who comes back is cleared."""
    from coursewatch.plans import checkin
    from coursewatch.streaming import deadlines

    at, days = datetime.datetime.fromisoformat, list(checkin.DAYS)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", deadlines.ROCKS)
    settings = [(1, at("2024-01-01T00:00"), "settings", "21:30", 90, days, "UTC"), (2, at("2024-01-01T00:00"), "settings", "21:30", 90, ["wed"], "America/New_York")]
    row = lambda person, when, kind="checkin": (person, at(when), kind, None, None, None, None)
    batches = [
        [*settings, row(1, "2024-01-01T20:00"), row(1, "2024-01-02T22:00")],
        [row(1, "2024-01-03T23:10"), row(1, "2024-01-04T21:30"), row(0, "2024-01-04T03:00", "clock")],
        [row(1, "2024-01-04T09:00"), row(0, "2024-01-05T12:00", "clock")],
    ]
    said, sent = [], []
    person = {"person": 0, "enabled": True, "owner_name": "Ann", "now": None, "timezone": "UTC", "checkin_enabled": True, "due": "21:30", "grace": 90, "days": days, "quiet_start": "00:00", "quiet_end": "00:00", "share_enabled": False, "share_day": "sun", "share_time": "18:00", "share_contacts": [], "cap": 5, "include_location": False}
    people = spark.createDataFrame([tuple((person | {"person": p, "timezone": z}).values()) for p, z in ((1, "UTC"), (2, "America/New_York"))], checkin.PERSON)
    contacts = spark.createDataFrame([(p, "mum", "Mum", "m@x.test", 0) for p in (1, 2)], "person bigint, contact string, name string, address string, pos int")
    seen = spark.createDataFrame([(1, at(r[1].date().isoformat()).date(), r[1], None, None) for b in batches for r in b if r[2] == "checkin"], "person bigint, day date, at timestamp_ntz, note string, place string")

    def send(df, n):
        log = spark.createDataFrame(sent, "person bigint, key string, kind string, to string, status string, day date")
        empty = lambda names: spark.createDataFrame([], names)
        said.extend((r.person, r.stage, str(r.at)) for r in df.collect())
        for m in deadlines.planned(df, people, contacts, seen, log, empty("person bigint, day date, note string"), empty("person bigint, place string, seen_at timestamp_ntz")).collect():
            sent.append((m.person, m.key, m.key.split(":")[0], m.to, "ok", m.at.date()))

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, deadlines.EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(deadlines.EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        deadlines.each_moment(stream, send, str(tmp_path / "cp")).awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(said) == sorted([(1, "remind", "2024-01-02 21:30:00"), (1, "remind", "2024-01-03 21:30:00"), (1, "missed", "2024-01-03 23:00:00"), (1, "all_clear", "2024-01-03 23:10:00"), (2, "remind", "2024-01-04 02:30:00"), (2, "missed", "2024-01-04 04:00:00")])
    assert sorted(m[:2] for m in sent) == sorted([(1, "remind:2024-01-02"), (1, "remind:2024-01-03"), (1, "missed:2024-01-03:mum"), (2, "remind:2024-01-03"), (2, "missed:2024-01-03:mum")])


def test_deadline_state_is_read_and_written_once_a_call():
    """However many check-ins a call brings and however many days pass, state is one read and one write."""
    import json

    from coursewatch.plans import checkin
    from coursewatch.streaming import deadlines

    class Handle:
        def __init__(self):
            self.calls, self.value, self.timers = 0, None, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    class Now:
        def __init__(self, at):
            self.at = deadlines._ms(deadlines._utc(at))

        def getCurrentWatermarkInMs(self):
            return self.at

        def getExpiryTimeInMs(self):
            return min(handle.timers)

    handle, one = Handle(), deadlines.Deadlines()
    one.init(handle)
    at, day = datetime.datetime(2024, 1, 1), datetime.timedelta(days=1)
    settings = json.dumps({"due": "21:30", "grace": 90, "days": list(checkin.DAYS), "timezone": "UTC"})
    list(one.handleInputRows((1,), iter([(1, at, settings), *((1, at + day * k + datetime.timedelta(hours=9 + h), None) for k in range(0, 30, 2) for h in range(5))]), None))
    assert handle.calls == 2 and len(handle.timers) == 1
    said = list(one.handleExpiredTimer((1,), Now(at + day * 30), Now(at)))
    assert handle.calls == 4 and sorted(r["stage"] for r in said) == ["missed"] * 15 + ["remind"] * 15


def test_plain_markup_needs_no_parser(monkeypatch):
    """Pages read without the general parser give what it gives; it isn't asked where a page is plain."""
    import random

    rnd = random.Random(7)
    bits = ["<ul>", "</ul>", '<li class="item">', "</li>", "due Oct 1", " 2024-05-01 > noon ", "<tr>", "<td>", "</td>", '<th class="date title">', "</tr>", "<br/>", "<br />", "<img src=\"x\">", '<a href="/a?id=1" class="title">', "</a>", "<B>", "</b>", "<h2>Homework</h2>", '<div id="Card" class="row">', "</div>", '<P CLASS="due">', "</p>", "<time datetime=\"2024-05-02\">", "</time>", "<nav>", "</nav>", "\n\u00a0x\u2013y "]
    odd = ["a &amp; b", "a < b", "<!-- x -->", "<script>if (a<b) '</li>'</script>", "<title>a<b>c</title>", "<p class=due>", "</ p>", "<li", "<a href='x'>", '<a href="/a?copy=1&copy=2&lt=3&sid=4">', '<a href="/a?b&amp;c&d">', '<a href="x"class="due">', "</p x>", "<1>"]
    pages = ["".join(rnd.choices(bits, k=rnd.randint(1, 40))) for _ in range(1500)]
    pages += ["".join(rnd.choices(bits + odd, k=rnd.randint(1, 25))) for _ in range(1500)]
    pages += [f'<li class="item"><a class="title" href="/a?{q}">Homework 1</a> 2024-05-01</li>' for q in ("a&copy=2", "a&lt", "a&sid=4", "b&amp;c", "a&#65;")]
    got = [html_items.scan(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(html_items.Scan, "feed", None)
        assert html_items.scan('<ul><li class="item"><a class="title" href="/a">Homework 1</a> 2024-05-01</li></ul>')[1]
    monkeypatch.setattr(html_items.Scan, "read", html_items.Scan.feed)
    assert [p for p, g in zip(pages, got, strict=True) if g != html_items.scan(p)] == [] and sum(bool(g[1]) for g in got) > 500


def test_a_page_is_read_once(spark):
    """A filter on exploded items doesn't read the pages again."""
    pages = spark.createDataFrame([("<li>Quiz 1 on 2024-05-01</li>",)], "html string")
    items = pages.select(html_items.items_of(F.col("html")).alias("r")).select(F.explode("r.items").alias("i")).select("i.title")
    assert items._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_plain_mail_needs_no_library(monkeypatch):
    """What is read without the email library is what that says; anything less plain goes to it."""
    from itertools import product

    from coursewatch.sources import mail

    heads = ["Subject: Re: [X] news", "Subject: a  b", "Subject: =?utf-8?q?h=C3=A9?=", "From: p.q@x.test", "From: Ann <a@x.test>", "Date: Mon, 02 Jan 2023 10:00:00 +0000", "Date: soon", "Date: 31 Feb 2023 10:00:00 +0000", "To: a@x.test, b@x.test", "X-A: 1\r\n two", "Subject: caf\u00e9", "Message-ID: <a@x.test>", "Subject: x", "Content-Transfer-Encoding: base64"]
    bodies = ["Content-Type: text/plain{n}{n}Hello.{n}{n}Bye.{n}", "Content-Type: text/html{n}{n}<p>x</p>", "{n}no type{n}", "Content-Type: text/plain; charset=utf-8{n}{n}x", "Content-Type: image/png{n}{n}x", "MIME-Version: 1.0{n}"]
    multi = 'Content-Type: multipart/alternative; boundary="b1"{n}{n}'
    bodies += [multi + rest for rest in ("--b1{n}Content-Type: text/html{n}{n}<p>no</p>{n}--b1{n}Content-Type: text/plain{n}{n}O{n}--b1--{n}", "--b1{n}{n}x{n}--b1--", "--b1{n}Content-Type: text/plain{n}{n}{n}--b1--{n}", "--b1{n}Content-Type: text/plain{n}{n}a--b1{n}b{n}--b1--{n}", "pre{n}--b1{n}{n}x{n}--b1--{n}", "--b1{n}{n}x{n}--b12{n}{n}y{n}--b1--{n}post", "--b1{n}Content-Type: text/plain{n}--b1--{n}", "x", "--b1--{n}", "--b1{n}--b1{n}{n}x{n}--b1--{n}", "--b1{n}Content-Type: text/plain{n}Content-Disposition: attachment{n}{n}x{n}--b1{n}{n}y{n}--b1--{n}")]
    raws = [f"{a}{n}{b}{n}{body.format(n=n)}".encode() for a, b, body, n in product(heads, heads, bodies, ("\n", "\r\n"))]
    fast = [mail.plainly(r) for r in raws]
    monkeypatch.setattr(mail, "plainly", lambda raw: None)
    assert [r for r, f in zip(raws, fast, strict=True) if f is not None and f != mail.opened(r)] == [] and sum(f is not None for f in fast) > 200
    monkeypatch.undo()
    monkeypatch.setattr(mail, "BytesParser", None)
    assert mail.opened(b"Subject: Order 7\r\nFrom: c1@x.test\r\nDate: Mon, 02 Jan 2023 12:00:00 +0000\r\n\r\nF")["error"] is None


def test_reports(spark):
    import uuid

    ns = "6ba7b8109dad11d180b400c04fd430c8"
    assert spark.range(1).select(reports.uuid5(ns, F.lit("a|b"))).first()[0] == str(uuid.uuid5(uuid.UUID(ns), "a|b"))


def test_mentions(spark):
    score = lambda a, b: spark.range(1).select(T.mention_score(F.lit(a), F.lit(b))).first()[0]
    assert (score("midterm 1", "the midterm 1 moved"), score("midterm 1", "the midterm moved"), score("final paper", "paper and final"), score("quiz", "essay")) == (1.0, 0.6, 0.8, 0.0)
