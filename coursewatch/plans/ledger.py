"""From changes to calendar operations: plan, gate, results, commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The gate's limits and the calendar's colours.
MIN_CONFIDENCE, MAX_DELETES, PAST_DAYS, FUTURE_DAYS = 0.6, 2, 120, 400
CLASS_COLOR, OTHER_COLOR = "7", "11"


def build_plan(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """``changes`` (type, key, before_key, ...) with op, event_id and replaces_key.

    ledger: (key, event_id). A reworded item falls back to the event of its old
    key. Removals of what the ledger doesn't have aren't ours and give no row.
    """
    own = ledger.select("key", F.col("event_id").alias("_own"))
    old = ledger.select(F.col("key").alias("before_key"), F.col("event_id").alias("_old"))
    joined = changes.filter(F.col("type").isin("added", "moved", "reworded", "removed")).join(own, "key", "left").join(old, "before_key", "left")
    event = F.when(F.col("type") == "removed", F.col("_own")).otherwise(F.coalesce("_own", "_old"))
    op = F.when(F.col("type") == "removed", "delete").when(event.isNotNull(), "update").otherwise("create")
    replaces = F.when((F.col("type") == "reworded") & (F.col("before_key") != F.col("key")), F.col("before_key"))
    return joined.withColumns({"op": op, "event_id": event, "replaces_key": replaces}).drop("_own", "_old").filter("op <> 'delete' or event_id is not null")


def color(kind: Column) -> Column:
    return F.when(kind == "class", CLASS_COLOR).otherwise(OTHER_COLOR)


def description(event: Column, course: Column, key: Column) -> Column:
    """What an event's text says of where it comes from, a line each; its last line finds it again if the ledger is lost."""
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    lines = F.concat(
        F.array(say("Course: ", course), say("Kind: ", event["kind"]), say('As written: "', event["date_text"], '"')),
        F.transform(event["sources"], lambda x: say("Source: ", x, " (read ", event["read_at"], ")")),
        F.array_compact(F.array(
            F.when(F.size(event["assumptions"]) > 0, say("Assumptions: ", F.array_join(event["assumptions"], "; "))),
            say("Confidence: ", F.format_string("%.2f", event["confidence"])),
            F.when(event["detail"] != "", say("Notes: ", event["detail"])),
            say("key: ", key),
        )),
    )
    return F.array_join(lines, "\n")


def gate(ops: DataFrame, today: Column) -> DataFrame:
    """``ops`` with ``block_reason``: why an operation must not run, the first reason that holds; '' if none.

    Columns: course_id, op, course_state, has_change, needs_review, confidence,
    event_id, confirmed, n_belief, start_day. Deletions are counted apart, and
    only the counts of courses with too many are joined back, so that no task
    holds a course's operations.
    """
    delete = F.col("op") == "delete"
    many = ops.filter(delete).groupBy(F.col("course_id").alias("_course")).agg(F.count(F.lit(1)).alias("_deletes")).filter(F.col("_deletes") > MAX_DELETES)
    counted = ops.join(many, F.col("course_id").eqNullSafe(F.col("_course")), "left")
    reason = (
        F.when(~F.col("op").isin("create", "update", "delete"), "unknown op")
        .when(F.col("course_state") == "unreadable", "course unreadable")
        .when(~F.col("has_change"), "no matching change")
        .when(F.col("needs_review"), "needs review")
        .when(F.col("confidence") < MIN_CONFIDENCE, "low confidence")
        .when(F.col("op").isin("update", "delete") & F.col("event_id").isNull(), "no event id")
        .when(delete & ~F.col("confirmed"), "unconfirmed removal")
        .when(delete & (2 * F.col("_deletes") >= F.greatest(F.col("n_belief"), F.lit(1))), "mass deletion")
        .when(delete, "")
        .when(F.col("start_day").isNull(), "no start date")
        .when(F.col("start_day") < F.date_sub(today, PAST_DAYS), "too far past")
        .when(F.col("start_day") > F.date_add(today, FUTURE_DAYS), "too far ahead")
        .otherwise("")
    )
    return counted.withColumn("block_reason", reason).drop("_course", "_deletes")


def last_results(results: DataFrame) -> DataFrame:
    """The last report of each (run_id, key, op); at-least-once reporting becomes once."""
    best = F.max(F.struct("seq", *[c for c in results.columns if c not in ("run_id", "key", "op", "seq")])).alias("r")
    return results.groupBy("run_id", "key", "op").agg(best).select("run_id", "key", "op", "r.*")


def ledger_delta(ops: DataFrame, results: DataFrame, written_at: Column) -> DataFrame:
    """What reported results change in the ledger: (key, put, event_id, summary, start, end, written_at).

    Operations that are ok put their event, with what was written and when;
    deletions that are ok, and what an ok operation replaces, drop their key.
    """
    done = ops.join(results.filter("status = 'ok'").select("key", "op", F.col("event_id").alias("_id")), ["key", "op"])
    puts = done.filter("op <> 'delete'").select("key", F.lit(True).alias("put"), F.col("_id").alias("event_id"), "summary", "start", "end", written_at.alias("written_at"))
    gone = done.filter("op = 'delete'").select("key").union(done.filter("replaces_key is not null").select(F.col("replaces_key").alias("key"))).distinct().join(puts.select("key"), "key", "left_anti")
    none = F.lit(None).cast("string")
    return puts.unionByName(gone.select("key", F.lit(False).alias("put"), *[none.alias(c) for c in ("event_id", "summary", "start", "end", "written_at")]))


def held_keys(ops: DataFrame, results: DataFrame) -> DataFrame:
    """Keys whose operation was blocked, failed or not reported, and the keys those would have replaced."""
    ok = results.filter("status = 'ok'").select("key", "op").distinct()
    bad = ops.filter("block_reason <> ''").unionByName(ops.filter("block_reason = ''").join(ok, ["key", "op"], "left_anti").select(*ops.columns))
    return bad.select("key").union(bad.filter("replaces_key is not null").select(F.col("replaces_key").alias("key"))).distinct()


def belief_delta(told: DataFrame) -> DataFrame:
    """What a night changes in the belief: course_id, key, put, and the item's fields.

    told: (course_id, key, type, before, after, is_partial) for every item.
    Items that are new, moved or reworded, and what a full reading shows anew of
    others, are put; what was removed or replaced is dropped. All else stays.
    """
    seen = (F.col("type") == "same") & ~F.coalesce("is_partial", F.lit(False)) & ~F.col("before").eqNullSafe(F.col("after"))
    put = F.col("type").isin("added", "moved", "reworded") | seen
    return told.filter(put | F.col("type").isin("removed", "replaced")).select("course_id", "key", put.alias("put"), "after.*")


def unheld(delta: DataFrame, held: DataFrame) -> DataFrame:
    """A belief's delta without held keys, which keep their old row, or stay out if they had none."""
    return delta.join(held, "key", "left_anti")


def merge_review(bucket: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """The review bucket after a run: first_seen stays, a resolved row reopens when its date text changed.

    bucket: (key, date_text, first_seen, last_seen, resolved, reopened_at); seen: (key, date_text).
    """
    b, s = bucket.alias("b"), seen.select("key", "date_text").alias("s")
    reopened = F.col("b.resolved") & F.col("s.date_text").isNotNull() & ~F.col("b.date_text").eqNullSafe(F.col("s.date_text"))
    here = F.col("s.date_text").isNotNull()
    return b.join(s, "key", "full_outer").select(
        "key",
        F.coalesce("s.date_text", "b.date_text").alias("date_text"),
        F.coalesce(F.col("b.first_seen"), now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("b.last_seen")).alias("last_seen"),
        (F.coalesce("b.resolved", F.lit(False)) & ~F.coalesce(reopened, F.lit(False))).alias("resolved"),
        F.when(reopened, now).otherwise(F.col("b.reopened_at")).alias("reopened_at"),
    )


def review_bucket(bucket: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """merge_review() of whole buckets: what is seen brings its course, title, reason, candidate and sources along.

    bucket: nightly.REVIEW; seen: events to review.
    """
    merged = merge_review(bucket, seen, now)
    new = seen.select("key", F.struct("course_id", "title", F.col("review_reason").alias("reason"), F.col("start").alias("candidate"), "sources").alias("_new"))
    old = bucket.select("key", F.struct("course_id", "title", "reason", "candidate", "sources").alias("_old"), "resolution", "resolved_at")
    both = merged.join(new, "key", "left").join(old, "key", "left").withColumn("_it", F.coalesce("_new", "_old"))
    kept = lambda c: F.when(F.col("resolved"), F.col(c)).alias(c)
    return both.select("key", "_it.course_id", "_it.title", "date_text", "_it.reason", "_it.candidate", "_it.sources", "first_seen", "last_seen", "resolved", kept("resolution"), kept("resolved_at"), "reopened_at")


def open_review(bucket: DataFrame) -> DataFrame:
    return bucket.filter("not coalesce(resolved, false)")


def resolve_review(bucket: DataFrame, keys: DataFrame) -> DataFrame:
    """The bucket after a person's decisions (key, note, at): resolved, with what was said and when; unknown keys say nothing."""
    done = keys.groupBy("key").agg(F.max(F.struct("at", "note")).alias("_done"))
    both = bucket.join(done, "key", "left")
    now = F.col("_done").isNotNull()
    return both.withColumns({"resolved": F.coalesce("resolved", F.lit(False)) | now, "resolution": F.when(now, F.col("_done.note")).otherwise(F.col("resolution")), "resolved_at": F.when(now, F.col("_done.at")).otherwise(F.col("resolved_at"))}).drop("_done")


def insert_if_absent(known: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``rows`` whose (kind, key) is new, the first of each by ``order``."""
    first = Window.partitionBy("kind", "key").orderBy(*order)
    return rows.join(known.select("kind", "key").distinct(), ["kind", "key"], "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


KIND = r"^[a-z][a-z0-9_-]{0,31}$"


def track_has(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (kind, key) with whether each is known."""
    return asked.join(known.select("kind", "key").distinct().withColumn("known", F.lit(True)), ["kind", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def track_remove(known: DataFrame, gone: DataFrame) -> DataFrame:
    return known.join(gone.select("kind", "key").distinct(), ["kind", "key"], "left_anti")


def track_kinds(known: DataFrame) -> DataFrame:
    return known.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def bad_kinds(rows: DataFrame) -> DataFrame:
    """Rows whose kind isn't a lower-case name of up to 32 letters, digits, - and _."""
    return rows.filter(~F.coalesce(F.col("kind").rlike(KIND), F.lit(False)))


def upsert_courses(courses: DataFrame, given: DataFrame, fields: tuple[str, ...] = ("name", "platform", "url", "timezone", "kind")) -> DataFrame:
    """Courses by id: a given field replaces, a null one leaves what was there; new ids are added."""
    c, g = courses.alias("c"), given.alias("g")
    return c.join(g, "id", "full_outer").select("id", *[F.coalesce(f"g.{f}", f"c.{f}").alias(f) for f in fields])


ID_BLOCK = 10_000


def create_events(ops: DataFrame, calendar: DataFrame, next_id: int) -> DataFrame:
    """A calendar's answer to approved operations: (key, op, event_id, status).

    New events get consecutive ids in order of op_ord, a whole number; updates
    and deletions of an unknown event fail. Ids are numbered within blocks of
    op_ord and shifted by the counts of earlier blocks, so that no task holds
    all operations.
    """
    made = ops.filter("op = 'create'").withColumn("_block", F.floor(F.col("op_ord") / ID_BLOCK))
    blocks = made.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("_block", before.alias("_before"))  # a row for ID_BLOCK operations
    n = F.row_number().over(Window.partitionBy("_block").orderBy("op_ord")) + F.col("_before")
    ids = made.join(shift, "_block").select("key", "op", F.concat(F.lit("evt-"), (n + next_id - 1).cast("string")).alias("event_id"), F.lit("ok").alias("status"))
    known = calendar.select("event_id", F.lit(True).alias("known"))
    changed = ops.filter("op <> 'create'").join(known, "event_id", "left").select("key", "op", "event_id", F.when(F.col("known"), "ok").otherwise("failed").alias("status"))
    return ids.unionByName(changed)
