"""Whole plans against loops: the semester map, the nightly run's harder cases, the planner's texts."""

import datetime as dt

from pyspark.sql import functions as F

from coursewatch.functions import dates
from coursewatch.operators import resolve
from coursewatch.plans import checkin, ledger, nightly, slots
from coursewatch.scratch import Scratch

START = dt.date(2026, 1, 12)


def loops(exams, topics, days, weeks=14):
    """The semester map of one course, by the docstring's words."""
    ahead = sorted((d, t) for t, d in exams if d >= START) or [(START + dt.timedelta(weeks=weeks), "end of term")]
    segs, at = [], START
    for d, _ in ahead:
        segs.append([at + dt.timedelta(i) for i in range((d - at).days) if (at + dt.timedelta(i)).weekday() in days])
        at = d + dt.timedelta(1)
    names = [t.lower() for _, t in ahead]
    mine = [[t for t in topics if t[1] and t[1].lower() in names and names.index(t[1].lower()) == i] for i in range(len(segs))]
    free, pos, total = [t for t in topics if not (t[1] and t[1].lower() in names)], 0, sum(map(len, segs)) or 1
    for i, s in enumerate(segs):
        n = round(len(free) * len(s) / total) if i + 1 < len(segs) else len(free) - pos
        mine[i] += free[pos : pos + n]
        pos += n
    out, n = [], 0
    for s, ts, (d, t) in zip(segs, mine, ahead):
        if not s:
            continue
        teach = s[:-1] if len(s) > 1 else s
        for k, day in enumerate(teach):
            here = [x[0] for j, x in enumerate(ts) if min(len(teach) - 1, j * len(teach) // len(ts)) == k]
            n += 1
            out.append((n, day, "class" if here else "practice", tuple(here), t))
        if len(s) > 1:
            n += 1
            out.append((n, s[-1], "review", tuple(x[0] for x in ts), t))
        out.append((None, d, "exam", (), t))
    return out


def test_semester_map(spark):
    courses = {
        "a": ([("Midterm", dt.date(2026, 3, 2)), ("Final", dt.date(2026, 4, 27)), ("Old", dt.date(2025, 1, 1))], [(f"t{i}", "final" if i == 3 else "nothing" if i == 4 else None) for i in range(12)]),
        "b": ([], [(f"u{i}", None) for i in range(40)]),
        "c": ([("Soon", dt.date(2026, 1, 13)), ("Next day", dt.date(2026, 1, 14)), ("Late", dt.date(2026, 2, 20))], [(f"v{i}", "Next day" if i == 0 else None) for i in range(5)]),
        "d": ([("Only", dt.date(2026, 1, 16))], []),
    }
    exams = spark.createDataFrame([(c, t, d) for c, (e, _) in courses.items() for t, d in e], "course_id string, title string, exam_day date")
    topics = spark.createDataFrame([(c, i, t, f"week {i}", x) for c, (_, ts) in courses.items() for i, (t, x) in enumerate(ts)], "course_id string, pos int, title string, source string, exam string")
    names = spark.createDataFrame([(c,) for c in courses], "course_id string")
    classes, notes = slots.semester_map(exams, topics, names, F.lit(START), [0, 2])
    got = {}
    for r in classes.collect():
        got.setdefault(r.course_id, []).append((r.n, r.day, r.kind, tuple(r.topics), r.for_exam))
    key = lambda x: (x[1], x[2] == "exam")
    for c, (e, ts) in courses.items():
        assert sorted(got[c], key=key) == sorted(loops(e, ts, {0, 2}), key=key), c
    said = {(r.course_id, r.note) for r in notes.collect()}
    assert ("b", "no exam dates in the belief; mapped 14 weeks") in said and any(c == "b" and "some classes cover two" in n for c, n in said)
    assert any(c == "c" and "unplaced" in n for c, n in said)


def night(spark, readings, items, belief=None, missing=None, known=None):
    r = spark.createDataFrame(readings, "course_id string, ord int, source_url string, read_at string, status string, error string, timezone string, partial boolean")
    i = spark.createDataFrame(items, "course_id string, ord int, pos int, title string, date_text string, start string, url string, review_reason string").withColumns({"kind": F.lit("assignment"), "posted_at": F.lit(None).cast("string"), "detail": F.lit(""), "end": F.lit(None).cast("string"), "all_day": F.lit(None).cast("boolean"), "read_at": F.lit(""), "timezone": F.lit(""), "source_url": F.lit("")})
    none = lambda s: spark.createDataFrame([], s)
    run = nightly.plan(r, i, spark.createDataFrame([("x", "X")], "course_id string, name string"), none(resolve.BELIEF) if belief is None else belief, none(nightly.MISSING) if missing is None else missing, none(nightly.LEDGER) if known is None else known, F.lit(dt.date(2026, 9, 6)), Scratch(spark))
    return run


def reading(course, day, status="ok", partial=False, ord_=1):
    return (course, ord_, f"page-{ord_}", f"2026-09-{day:02d}T23:00:00-04:00", status, "down" if status != "ok" else None, "America/New_York", partial)


def item(course, pos, title, text, start=None, ord_=1, review=None):
    return (course, ord_, pos, title, text, start, "", review)


def test_nights(spark):
    """Two sources merge, mail moves, a vanished item is removed on the second day, a vague date keeps the old event, noise changes nothing."""
    first = night(spark, [reading("x", 5)], [item("x", 0, "Essay 1 draft", "Oct 14"), item("x", 1, "Quiz", "Oct 16 at 11:59 PM"), item("x", 2, "Lab", "Oct 20"), item("x", 3, "Talk", "TBD"), item("x", 4, "Quiz", "2026-10-16", "2026-10-17T03:59:00Z")])
    assert {(c.type, c.title) for c in first.changes.collect()} == {("added", t) for t in ("Essay 1 draft", "Quiz", "Lab")}
    quiz = first.belief(spark.createDataFrame([], resolve.BELIEF)).filter("title = 'Quiz'").first()
    assert (quiz.start, quiz.all_day, len(quiz.sources), quiz.confidence) == ("2026-10-16T23:59:00-04:00", False, 1, 0.98)
    assert [r.title for r in first.review.collect()] == ["Talk"]
    belief, _ = Scratch(spark).write(first.belief(spark.createDataFrame([], resolve.BELIEF)), "b")
    none = spark.createDataFrame([], nightly.MISSING)
    known = belief.select("key", F.concat(F.lit("e-"), F.col("key")).alias("event_id"), *[F.lit("").alias(c) for c in ("summary", "start", "end", "written_at")])

    same = night(spark, [reading("x", 6)], [item("x", 9, "Quiz", "due  Oct 16, 11:59 PM"), item("x", 2, "Lab", "Oct 20"), item("x", 0, " Essay 1  draft", "Oct 14 ")], belief, None, known)
    assert same.changes.count() == 0 and same.pending.count() == 0 and same.ops.count() == 0

    second = night(spark, [reading("x", 6), reading("x", 6, partial=True, ord_=2)], [item("x", 0, "Essay 1: first draft", "Oct 14"), item("x", 1, "Quiz", "date TBA"), item("x", 0, "Lab", "moved from Oct 20 to Oct 22", ord_=2)], belief, None, known)
    assert {(c.type, c.title) for c in second.changes.collect()} == {("reworded", "Essay 1: first draft"), ("moved", "Lab")}
    ops = {(o.op, o.block_reason, o.replaces_key) for o in second.ops.collect()}
    assert ops == {("update", "", "x::essay 1 draft"), ("update", "", None)}
    assert any("calendar keeps 2026-10-16T23:59:00-04:00" in r.review_reason for r in second.review.collect())
    assert {b.title for b in second.belief(belief).collect()} == {"Essay 1: first draft", "Quiz", "Lab"}

    gone = night(spark, [reading("x", 6)], [item("x", 1, "Quiz", "Oct 16 at 11:59 PM"), item("x", 0, "Essay 1 draft", "Oct 14")], belief, None, known)
    assert [p.title for p in gone.pending.collect()] == ["Lab"] and gone.ops.count() == 0
    counters, _ = Scratch(spark).write(gone.missing(none), "m")
    again = night(spark, [reading("x", 6)], [item("x", 1, "Quiz", "Oct 16 at 11:59 PM"), item("x", 0, "Essay 1 draft", "Oct 14")], belief, counters, known)
    assert again.changes.count() == 0 and again.missing(counters).first()["count"] == 1  # the same day doesn't count twice
    later = night(spark, [reading("x", 7)], [item("x", 1, "Quiz", "Oct 16 at 11:59 PM"), item("x", 0, "Essay 1 draft", "Oct 14")], belief, counters, known)
    assert [(o.op, o.event_id, o.block_reason) for o in later.ops.collect()] == [("delete", "e-x::lab", "")]
    assert later.missing(counters).count() == 0 and "Lab" not in {b.title for b in later.belief(belief).collect()}

    for bad in ([reading("x", 7, "error")], []):
        run = night(spark, bad, [], belief, counters, known)
        assert run.changes.count() == 0 and run.ops.count() == 0 and run.belief(belief).count() == 3 and run.missing(counters).count() == 1
        assert run.courses.filter("course_id = 'x'").first().state == ("unreadable" if bad else "not_read")
    mail = night(spark, [reading("x", 7, "error"), reading("x", 7, partial=True, ord_=2)], [item("x", 0, "Lab", "now Oct 23", ord_=2)], belief, None, known)
    assert [(c.type, c.note) for c in mail.changes.collect()] == [("moved", "2026-10-20 -> 2026-10-23 (from a partial source)")]
    assert [f.note for f in mail.failures.collect()] == ["page-1 failed (down); the course's other sources were used"]
    assert {n.note for n in nightly.notes(gone).collect()} == {"1 item(s) missing once; no deletion until confirmed on a later day"}
    lines = nightly.night_summary(second, spark.createDataFrame([("x", "Course X")], "course_id string, name string")).collect()
    assert any(r.line.startswith("MOVED — Course X: Lab — 2026-10-20 -> 2026-10-22") for r in lines)


def night_frames(spark, *items):
    return (
        spark.createDataFrame([reading("x", 5)], "course_id string, ord int, source_url string, read_at string, status string, error string, timezone string, partial boolean"),
        spark.createDataFrame(list(items), "course_id string, ord int, pos int, title string, date_text string, start string, url string, review_reason string").withColumns({"kind": F.lit("exam"), "posted_at": F.lit(None).cast("string"), "detail": F.lit(""), "end": F.lit(None).cast("string"), "all_day": F.lit(None).cast("boolean"), "read_at": F.lit(""), "timezone": F.lit(""), "source_url": F.lit("")}),
    )


def test_a_crash_between_writing_and_committing(spark, tmp_path):
    """Reported operations of a run that wasn't committed reach the ledger before the next plan, so nothing is created twice."""
    from coursewatch.plans.state import Store

    store, day = Store(spark, str(tmp_path)), F.lit(dt.date(2026, 9, 6))
    names = spark.createDataFrame([("x", "X")], "course_id string, name string")
    frames = lambda *items: night_frames(spark, *items)
    some = (item("x", 0, "Quiz", "Oct 14"), item("x", 1, "Lab", "Oct 20"), item("x", 2, "Talk", "TBD"))
    first = nightly.plan_run(spark, store, *frames(*some), names, "n", day)
    one = [("x::quiz", "create", "e1", "ok", 1)]
    nightly.record(spark, store, first, spark.createDataFrame(one, nightly.RESULTS))
    nightly.record(spark, store, first, spark.createDataFrame(one, nightly.RESULTS))  # reported twice
    second = nightly.plan_run(spark, store, *frames(*some), names, "n", day)
    assert (first, second) == ("n", "n-2") and store.is_committed(first) and not store.is_committed(second)
    assert [(r.key, r.event_id, r.summary) for r in store.read("ledger", nightly.LEDGER).collect()] == [("x::quiz", "e1", "Exam: Quiz (X)")]
    assert {(o.key, o.op) for o in store.archived(second, "ops").collect()} == {("x::lab", "create")}  # not believed yet, proposed again
    assert [r.title for r in ledger.open_review(store.read("review", nightly.REVIEW)).collect()] == ["Talk"]
    assert nightly.commit_run(spark, store, second, spark.createDataFrame([("x::lab", "create", "e2", "ok", 1)], nightly.RESULTS))
    assert not nightly.commit_run(spark, store, second)
    assert {r.key for r in store.read("belief", resolve.BELIEF).collect()} == {"x::quiz", "x::lab"}
    assert {(c.run_id, c.key) for c in nightly.committed_changes(spark, store).collect()} == {("n", "x::quiz"), ("n", "x::lab"), ("n-2", "x::lab")}
    assert store.latest_run() == "n-2"


def test_late_reports_are_rebased(spark, tmp_path):
    """A and B are planned from one state, B is committed, A's report comes late: the next plan takes A over key by key, and nothing is refused."""
    from coursewatch.plans.state import Store

    store, day, names = Store(spark, str(tmp_path)), F.lit(dt.date(2026, 9, 6)), spark.createDataFrame([("x", "X")], "course_id string, name string")
    some = [("x::quiz", "create", "{0}1", "ok", 1), ("x::lab", "create", "{0}2", "ok", 1)]
    results = lambda run, rows: spark.createDataFrame([(k, o, e.format(run), *r) for k, o, e, *r in rows], nightly.RESULTS)
    frames = night_frames(spark, item("x", 0, "Quiz", "Oct 14"), item("x", 1, "Lab", "Oct 20"), item("x", 2, "Talk", "TBD"))
    a, b = (nightly.plan_run(spark, store, *frames, names, run, day) for run in ("a", "b"))
    nightly.record(spark, store, a, results("a", some))
    nightly.resolve_items(store, spark.createDataFrame([("x::talk", "no talk", "2026-09-07")], "key string, note string, at string"))
    assert nightly.commit_run(spark, store, b, results("b", some[1:]))
    c = nightly.plan_run(spark, store, *frames, names, "c", day)
    assert store.is_committed(a) and {(r.key, r.event_id) for r in store.read("ledger", nightly.LEDGER).collect()} == {("x::quiz", "a1"), ("x::lab", "b2")}
    assert {(r.tab, r.key, r.by) for r in nightly.conflicts(store, a).collect()} == {("belief", "x::lab", "b"), ("ledger", "x::lab", "b")}
    assert store.archived(c, "ops").count() == 0 and store.meta(c)["recovered"] == [a]
    lines = {(r.section, r.line) for r in store.archived(c, "summary").collect()}
    assert ("10 recovery", "run a had been interrupted; committed with its 2 reported results") in lines
    assert not any(s == "6 needs review" for s, _ in lines)  # the talk is settled
    talk = store.read("review", nightly.REVIEW).first()
    assert (talk.resolved, talk.resolution, talk.resolved_at) == (True, "no talk", "2026-09-07")
    again = nightly.plan_run(spark, store, *night_frames(spark, item("x", 2, "Talk", "date TBA")), names, "d", day)
    assert [r.title for r in store.archived(again, "review").collect()] == ["Talk"]  # other words, asked again


def test_buckets_versions_and_vacuum(spark, tmp_path):
    from coursewatch.plans.state import Store, merged

    store = Store(spark, str(tmp_path), courses=4, keys=2)
    rows = lambda n, put=True, start="s": spark.createDataFrame([(f"c{i % 6}", f"c{i % 6}::{i}", put, start) for i in n], "course_id string, key string, put boolean, start string")
    schema, current = "course_id string, key string, start string", lambda **at: sorted((r.key, r.start) for r in store.read("belief", schema, **at).collect())
    assert store.commit("r1", {"belief": rows(range(200))}, 0, "2026-09-01") and not store.commit("r1", {"belief": rows([1])}, 0)
    first = store.manifest()["tables"]["belief"]
    assert store.commit("r2", {"belief": rows([0, 6], start="t")}, 1, "2026-09-02")
    second = store.manifest()["tables"]["belief"]
    moved = {b for b in first if first[b] != second[b]}
    assert moved and moved <= {str(b) for b in store.buckets_of(["c0"], [4, 2])}  # only what the commit touches is written
    assert store.commit("r3", {"belief": rows([7], put=False)}, 2) and len(current()) == 199 and len(current(version=1)) == 200
    assert dict(current())["c0::6"] == "t" and dict(current(version=1))["c0::6"] == "s"
    assert {r.course_id for r in store.read("belief", schema, courses=["c1"]).filter("course_id = 'c1'").collect()} == {"c1"}
    assert store.read("belief", schema, courses=["c1"]).count() < 199
    assert store.commit("late", {"belief": rows([6, 8], start="u")}, 1) and dict(current())["c0::6"] == "t" and dict(current())["c2::8"] == "u"
    assert [(r.key, r.by) for r in store.archived("late", "conflicts").collect()] == [("c0::6", "r2")]
    whole = merged(spark.createDataFrame([("c", "k", "s")], schema), rows([], True).unionByName(rows([1])), ["course_id", "key"])
    assert whole.count() == 2
    kept = current()
    assert store.vacuum(keep=1, older_than_s=0) > 0 and current() == kept and store.versions() == [4]
    assert store.vacuum(keep=1, older_than_s=0) == 0
    store.reset(keep=("belief",))
    assert current() == kept and store.manifest()["runs"] == []
    assert store.commit("r1", {"belief": rows([1], start="v")}, 5)  # runs from before count no more


def test_two_writers_both_commit(spark, tmp_path, monkeypatch):
    """A commit that finds another version published meanwhile starts again from that one."""
    from coursewatch.plans.state import Store

    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    row = lambda k: spark.createDataFrame([(k, True, "e")], "key string, put boolean, event_id string")
    publish, raced = Store._publish, []

    def late(self, manifest):
        if self is store and not raced:
            raced.append(other.commit("other", {"ledger": row("b")}, 0))
        publish(self, manifest)

    monkeypatch.setattr(Store, "_publish", late)
    assert store.commit("mine", {"ledger": row("a")}, 0) and raced == [True]
    assert {r.key for r in store.read("ledger", "key string, event_id string").collect()} == {"a", "b"}


def test_forced_review_and_disagreement(spark):
    run = night(spark, [reading("x", 5), reading("x", 5, ord_=2)], [item("x", 0, "Quiz", "Oct 14"), item("x", 0, "Quiz", "Oct 15", ord_=2), item("x", 1, "Lab", "Oct 20", review="look here"), item("x", 2, "Bad", "", "soonish")])
    why = {r.title: r.review_reason for r in run.review.collect()}
    assert why["Quiz"] == "sources disagree: 'Oct 14' vs 'Oct 15'" and why["Lab"] == "look here" and why["Bad"].startswith("unparseable machine timestamp 'soonish'")
    assert run.changes.count() == 0


def test_exact_times_and_bounds(spark):
    rows = [("2026-10-14", None, None), ("2026-10-14T03:59:00Z", None, False), ("2026-10-14T10:00:00", "2026-10-14T09:00:00", None), ("2026-10-14T10:00:00+0200", None, None), ("2026-13-14", None, None), ("2026-10-14T10:00:00Z", "nonsense", None), ("2026-10-14T23:00:00-04:00", "2026-10-16", True)]
    df = spark.createDataFrame(rows, "s string, e string, a boolean")
    got = [(r.x.start, r.x.end, r.x.all_day, r.x.needs_review) for r in df.select(dates.exact(F.col("s"), F.col("e"), F.col("a"), F.lit("America/New_York")).alias("x")).collect()]
    assert got == [
        ("2026-10-14", "2026-10-14", True, False), ("2026-10-13T23:59:00-04:00", "2026-10-13T23:59:00-04:00", False, False), ("2026-10-14T10:00:00-04:00", "2026-10-14T10:00:00-04:00", False, False),
        ("2026-10-14T04:00:00-04:00", "2026-10-14T04:00:00-04:00", False, False), (None, None, True, True), (None, None, True, True), ("2026-10-14", "2026-10-16", True, False),
    ]
    b = spark.createDataFrame([("2026-10-22", "2026-10-24", True), ("2026-10-07", None, True), ("2026-10-07T10:00:00Z", None, False), (None, None, True)], "s string, e string, a boolean")
    assert [tuple(r.x) for r in b.select(dates.api_bounds(F.col("s"), F.col("e"), F.col("a")).alias("x")).collect()] == [("2026-10-22", "2026-10-25"), ("2026-10-07", "2026-10-08"), ("2026-10-07T10:00:00Z", "2026-10-07T10:00:00Z"), (None, None)]


def test_planner_texts(spark):
    now = dt.datetime(2024, 1, 10, 22, 45)
    person = (1, True, "Ann", now, "America/New_York", True, "21:00", 90, ["Wednesday"], None, None, False, None, None, None, 2, True)
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    contacts = make([(1, "m", "Mo", "m@x.test", 0), (1, "d", "Di", "d@x.test", 1)], "person bigint, contact string, name string, address string, pos int")
    before = make([(1, dt.date(2024, 1, 8), dt.datetime(2024, 1, 8, 20, 5), "bye", "gym")], "person bigint, day date, at timestamp_ntz, note string, place string")
    none = lambda s: make([], s)
    sent, outbox, plans = none("person bigint, key string, kind string, to string, status string, day date"), none("person bigint, key string, to string, subject string, body string"), none("person bigint, day date, note string")
    agenda, places = none("person bigint, day date, title string, course string, kind string"), none("person bigint, place string, seen_at timestamp_ntz")
    got, _ = checkin.plan(make([person], checkin.PERSON), contacts, before, sent, outbox, plans, places, agenda)
    body = {m.to: m.body for m in got.collect()}
    assert set(body) == {"m", "d"} and body["m"].startswith("Hi Mo,") and 'last check-in Mon Jan 08, 8:05 PM ("bye")' in body["m"] and "gym (said at the check-in of 2024-01-08)" in body["m"] and "9:00 PM (America/New_York)" in body["m"]
    seen = make([(1, "library", now - dt.timedelta(minutes=95))], "person bigint, place string, seen_at timestamp_ntz")
    got, _ = checkin.plan(make([person], checkin.PERSON), contacts, before.filter("false"), sent, outbox, plans, seen, agenda)
    assert all("library (seen Wed 9:10 PM, 1 h ago)" in m.body and "no earlier check-in on record" in m.body for m in got.collect())
    early = (1, True, "", now.replace(hour=21, minute=30), *person[4:])
    got, _ = checkin.plan(make([early], checkin.PERSON), contacts, before, sent, outbox, make([(1, now.date(), "a game")], "person bigint, day date, note string"), places, agenda)
    ask = got.collect()
    assert len(ask) == 1 and ask[0].to == "owner" and "10:30 PM I'll let Mo and Di know" in ask[0].body and "a game" in ask[0].body
    asked = make([(1, "say:2024-01-10:m:x", "m", "s", "b")], "person bigint, key string, to string, subject string, body string")
    done = make([(1, "say:2024-01-10:m:x", "say", "m", "ok", now.date())], "person bigint, key string, kind string, to string, status string, day date")
    assert checkin.after_sending(asked, done).count() == 0 and checkin.after_sending(asked, sent).count() == 1


def test_outbox(spark):
    """What is asked for twice is one message; what was sent goes."""
    asked = spark.createDataFrame([(1, dt.date(2024, 1, 10), "mum", "hi", "all fine")] * 2 + [(1, dt.date(2024, 1, 10), "mum", "hi", "other words"), (2, dt.date(2024, 1, 10), "mum", "hi", "all fine")], "person bigint, day date, to string, subject string, body string")
    box = checkin.log_outbox(spark.createDataFrame([], "person bigint, key string, to string, subject string, body string"), asked)
    keys = [(r.person, r.key) for r in box.collect()]
    assert len(keys) == 3 and all(k.startswith("say:2024-01-10:mum:") for _, k in keys)
    assert checkin.log_outbox(box, asked).count() == 3
    assert checkin.after_sending(box, spark.createDataFrame([(*keys[0], "ok")], "person bigint, key string, status string")).count() == 2


def test_tracking(spark):
    rows = spark.createDataFrame([("jobs", "a"), ("Jobs", "b"), (None, "c"), ("x" * 33, "d")], "kind string, key string")
    assert {r.key for r in ledger.bad_kinds(rows).collect()} == {"b", "c", "d"}
