"""Belief against observation: added, moved, reworded and removed items.

Frames of items have course_id, key, title, start, end, all_day. One full outer
join on (course_id, key) labels every change; nothing is compared across courses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import same_schedule
from ..scratch import Scratch

REWORD_THRESHOLD = 0.55
CONFIRMATIONS = 2
ITEM = ("title", "start", "end", "all_day")


def sides(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """course_id, key, and structs before and after, null where a side lacks the key."""
    pack = lambda df, name: df.select("course_id", "key", F.struct(*[c for c in df.columns if c not in ("course_id", "key")]).alias(name))
    return pack(prev, "before").join(pack(cur, "after"), ["course_id", "key"], "full_outer")


def label() -> Column:
    """added, missing, moved or same for a row of sides()."""
    same = same_schedule(F.col("before"), F.col("after"))
    return F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "missing").when(same, "same").otherwise("moved")


def changes(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return sides(prev, cur).withColumn("type", label()).filter("type <> 'same'")


def course_state(status: Column, n_read: Column, n_believed: Column, partial: Column) -> Column:
    """not_read, unreadable, or null where a reading may change something. A full reading that is ok but has no item of a course with some is unreadable."""
    empty = (F.coalesce(n_read, F.lit(0)) == 0) & (F.coalesce(n_believed, F.lit(0)) > 0) & ~F.coalesce(partial, F.lit(False))
    return F.when(status.isNull() | (status == "not_read"), "not_read").when((status != "ok") | empty, "unreadable")


def guarded(prev: DataFrame, cur: DataFrame, reads: DataFrame) -> DataFrame:
    """changes() with what a bad read must not do.

    reads: (course_id, status), one row a course. A course without a row is
    not_read; one that isn't ok, or is ok without any item while the belief has
    some, is unreadable. Such a course gives one row of that type and no others.
    """
    believed = prev.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_prev"))
    observed = cur.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_cur"))
    courses = believed.join(observed, "course_id", "full_outer").join(reads, "course_id", "full_outer")
    courses = courses.select("course_id", course_state(F.col("status"), F.col("n_cur"), F.col("n_prev"), F.lit(False)).alias("state"))
    found = changes(prev, cur).join(courses, "course_id", "left").filter("state is null").select("course_id", "key", "type", "before", "after")
    none = {c: F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("key", "before", "after")}
    stopped = courses.filter("state is not null").select("course_id", none["key"], F.col("state").alias("type"), none["before"], none["after"])
    return found.unionByName(stopped)


def reword_pairs(removed: DataFrame, added: DataFrame, score=T.similarity_from) -> DataFrame:
    """(course_id, removed, added, sim) of equal schedule and similar title.

    A hash join on course and schedule, null-safe, before any title is compared.
    Words of each title are told apart once, before the join; pairs whose
    words and lengths rule the threshold out go before Python sees a title.
    Titles of one course and schedule are all compared, which grows with the
    square of their number, at about a microsecond a pair.
    """
    ready = lambda df: df.withColumn("_s", T.slug(F.col("title"))).withColumn("_words", T.words(F.col("_s"))).select("course_id", "key", "start", "end", "all_day", "_s", "_words")
    r, a = ready(removed).alias("r"), ready(added).alias("a")
    on = (F.col("r.course_id") == F.col("a.course_id")) & F.col("r.start").eqNullSafe(F.col("a.start")) & F.col("r.end").eqNullSafe(F.col("a.end")) & F.col("r.all_day").eqNullSafe(F.col("a.all_day"))
    x, y = (F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("_s", "_words")]) for side in "ra")
    paired = r.join(a, on).filter(F.greatest(T.length_bound(x, y), T.shared_words(x, y)) >= REWORD_THRESHOLD)
    scored = paired.select(F.col("r.course_id").alias("course_id"), F.col("r.key").alias("removed"), F.col("a.key").alias("added"), score(x, y, REWORD_THRESHOLD).alias("sim"))
    return scored.filter(F.col("sim") >= REWORD_THRESHOLD)


def assign(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Greedy one-to-one assignment, best pair first (sim, removed, added, all descending).

    A pair that is the best of both its sides is in the greedy result wherever
    else the order goes, so all of those are taken at once, their sides are
    struck out, and the rest is looked at again. No course is collected.
    """
    rest, path = scratch.write(pairs.select("course_id", "removed", "added", "sim").distinct(), "pairs")
    taken = []
    while not rest.isEmpty():
        order = F.struct("sim", "removed", "added")
        best = lambda side: rest.groupBy("course_id", side).agg(F.max(order).alias("b")).select("course_id", "b.removed", "b.added", "b.sim")
        now, _ = scratch.write(best("removed").join(best("added"), ["course_id", "removed", "added", "sim"]), "taken")
        taken.append(now)
        left = rest.join(now.select("course_id", "removed"), ["course_id", "removed"], "left_anti").join(now.select("course_id", "added"), ["course_id", "added"], "left_anti")
        old = path
        rest, path = scratch.write(left, "pairs")
        scratch.drop(old)
    out = rest
    for t in taken:
        out = out.unionByName(t)
    return out


def removals(seen: DataFrame, days: DataFrame, confirmations: int = CONFIRMATIONS) -> DataFrame:
    """(key, first_missing, confirmed_on) of every run of absences long enough.

    seen: (key, day) present; days: (day) of successful reads. Days are numbered
    in order; between two presences of a key lie as many absences as the
    numbers leave out, so no key x day grid is made. Days without a
    successful read have no number: they neither count nor reset.
    """
    # one row a calendar day: the only window without a partition
    numbered = days.select("day").distinct().withColumn("n", F.row_number().over(Window.orderBy("day")))
    last = numbered.agg(F.max("n").alias("n")).first()["n"] or 0
    by_key = Window.partitionBy("key").orderBy("n")
    present = seen.select("key", "day").distinct().join(numbered, "day")
    gaps = present.withColumn("next", F.coalesce(F.lead("n").over(by_key), F.lit(last + 1))).filter(F.col("next") - F.col("n") > confirmations)
    first, done = numbered.select(F.col("n").alias("f"), F.col("day").alias("first_missing")), numbered.select(F.col("n").alias("d"), F.col("day").alias("confirmed_on"))
    return gaps.join(first, F.col("f") == F.col("n") + 1).join(done, F.col("d") == F.col("n") + confirmations).select("key", "first_missing", "confirmed_on")
