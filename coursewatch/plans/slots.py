"""Class slots up to exams, and topics spread over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_slots(spans: DataFrame, days: list[int]) -> DataFrame:
    """(…, day) of the given weekdays (Monday 0) from start_day to end_day of each row; calendars bound the expansion."""
    some = spans.filter("start_day <= end_day").withColumn("day", F.explode(F.sequence("start_day", "end_day")))
    return some.filter(F.weekday("day").isin(days))


def with_term_end(exams: DataFrame, courses: DataFrame, start: Column, weeks: int = 14) -> DataFrame:
    """Exams from ``start`` on (course_id, title, exam_day), and for a course without any the end of a term of that many weeks."""
    ahead = exams.filter(F.col("exam_day") >= start).select("course_id", "title", "exam_day", F.lit(True).alias("is_exam"))
    without = courses.select("course_id").distinct().join(ahead.select("course_id").distinct(), "course_id", "left_anti")
    return ahead.unionByName(without.select("course_id", F.lit("end of term").alias("title"), F.date_add(start, 7 * weeks).alias("exam_day"), F.lit(False).alias("is_exam")))


def segments(exams: DataFrame, start: Column) -> DataFrame:
    """(course_id, seg, start_day, end_day, exam): from the start or the day after an exam to the day before the next."""
    by = Window.partitionBy("course_id").orderBy("exam_day", "title")
    return exams.select("course_id", (F.row_number().over(by) - 1).alias("seg"), F.coalesce(F.date_add(F.lag("exam_day").over(by), 1), start).alias("start_day"), F.date_sub("exam_day", 1).alias("end_day"), F.col("title").alias("exam"))


def numbered(slots: DataFrame) -> DataFrame:
    """Slots with n in the course, k and size in the segment, and is_review: the last of two or more."""
    by, part = Window.partitionBy("course_id").orderBy("day"), Window.partitionBy("course_id", "seg")
    out = slots.withColumns({"n": F.row_number().over(by), "k": F.row_number().over(part.orderBy("day")) - 1, "size": F.count(F.lit(1)).over(part)})
    return out.withColumn("is_review", (F.col("size") > 1) & (F.col("k") == F.col("size") - 1))


def shares(sizes: DataFrame, n_topics: Column) -> DataFrame:
    """Topics for each segment in proportion to its slots, half to even, the rest to the last. sizes: (course_id, seg, size)."""
    part = Window.partitionBy("course_id")
    running = part.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    rounded = sizes.withColumns({"_total": F.greatest(F.sum("size").over(part), F.lit(1)), "_last": F.max("seg").over(part)}).withColumn("_r", F.bround(n_topics * F.col("size") / F.col("_total")).cast("long"))
    rest = n_topics - F.coalesce(F.sum("_r").over(running), F.lit(0))
    return rounded.withColumn("share", F.when(F.col("seg") == F.col("_last"), rest).otherwise(F.col("_r"))).drop("_total", "_last", "_r")


def topic_slot(position: Column, n_slots: Column, n_topics: Column) -> Column:
    """Slot of the i-th of m topics on n slots."""
    return F.least(n_slots - 1, F.floor(position * n_slots / n_topics))


def semester_map(exams: DataFrame, topics: DataFrame, courses: DataFrame, start: Column, days: list[int], weeks: int = 14) -> tuple[DataFrame, DataFrame]:
    """Classes (course_id, n, day, kind, topics, sources, for_exam) and notes (course_id, note).

    exams: (course_id, title, exam_day); topics: (course_id, pos, title, source,
    exam): tagged ones go before the exam they name, the others are split over
    the segments in proportion to their slots. Each segment's topics are spread
    over its slots but the last, which reviews them all; a slot without a topic
    is practice. A course's calendar and topics are one window: a term's.
    """
    all_ = with_term_end(exams, courses, start, weeks)
    segs = segments(all_, start).join(all_.select("course_id", F.col("title").alias("exam"), "exam_day", "is_exam"), ["course_id", "exam"])
    segs = segs.filter(F.date_add("end_day", 1) == F.col("exam_day"))
    placed = numbered(session_slots(segs.select("course_id", "seg", "start_day", "end_day", "exam"), days))
    sizes = segs.select("course_id", "seg", "exam", "exam_day", "is_exam").join(placed.groupBy("course_id", "seg").agg(F.max("size").alias("size")), ["course_id", "seg"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    tag = F.lower(F.trim(F.coalesce(topics["exam"], F.lit(""))))
    named = segs.groupBy("course_id", F.lower("exam").alias("_tag")).agg(F.min("seg").alias("_seg"))
    told = topics.withColumn("_tag", tag).join(named, ["course_id", "_tag"], "left")
    free = told.filter("_seg is null").withColumn("_i", F.row_number().over(Window.partitionBy("course_id").orderBy("pos")) - 1)
    many = free.groupBy("course_id").agg(F.count(F.lit(1)).alias("_free"))
    part = Window.partitionBy("course_id").orderBy("seg")
    split = shares(sizes.join(many, "course_id"), F.col("_free")).withColumn("_from", F.coalesce(F.sum("share").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    split = split.select(F.col("course_id").alias("_course"), F.col("seg").alias("_at"), "_from", "share")
    fits = (F.col("course_id") == F.col("_course")) & (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_from") + F.col("share"))
    given = free.join(split, fits).select("course_id", F.col("_at").alias("seg"), F.lit(1).alias("_late"), "pos", "title", "source")
    given = given.unionByName(told.filter("_seg is not null").select("course_id", F.col("_seg").alias("seg"), F.lit(0).alias("_late"), "pos", "title", "source"))
    inside = Window.partitionBy("course_id", "seg")
    given = given.withColumns({"_t": F.row_number().over(inside.orderBy("_late", "pos")) - 1, "_m": F.count(F.lit(1)).over(inside)}).join(sizes.select("course_id", "seg", "size"), ["course_id", "seg"])
    teach = F.when(F.col("size") > 1, F.col("size") - 1).otherwise(F.col("size"))
    given = given.withColumn("k", F.when(teach > 0, topic_slot(F.col("_t"), teach, F.col("_m"))).cast("int"))
    listed = lambda df, *by: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_t", "title", F.coalesce("source", F.lit("")).alias("source")))).alias("ts"))
    at, whole = listed(given.filter("k is not null"), "course_id", "seg", "k"), listed(given, "course_id", "seg").withColumnRenamed("ts", "all")
    rows = placed.join(at, ["course_id", "seg", "k"], "left").join(whole, ["course_id", "seg"], "left")
    titles = lambda c: F.coalesce(F.transform(c, lambda x: x["title"]), F.array().cast("array<string>"))
    nothing = F.array().cast("array<string>")
    kind = F.when(F.col("is_review"), "review").when(F.col("ts").isNull(), "practice").otherwise("class")
    classes = rows.select("course_id", "n", "day", kind.alias("kind"), F.when(F.col("is_review"), titles(F.col("all"))).otherwise(titles(F.col("ts"))).alias("topics"), F.when(F.col("is_review") | F.col("ts").isNull(), nothing).otherwise(F.transform("ts", lambda x: x["source"])).alias("sources"), F.col("exam").alias("for_exam"))
    held = sizes.filter("size > 0").select("course_id", F.lit(None).cast("int").alias("n"), F.col("exam_day").alias("day"), F.lit("exam").alias("kind"), nothing.alias("topics"), nothing.alias("sources"), F.col("exam").alias("for_exam"))
    per = sizes.join(given.groupBy("course_id", "seg").agg(F.count(F.lit(1)).alias("m")), ["course_id", "seg"])
    say = lambda df, *parts: df.select("course_id", F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]).alias("note"))
    notes = (
        say(all_.filter("not is_exam"), "no exam dates in the belief; mapped ", F.lit(str(weeks)), " weeks")
        .unionByName(say(per.filter("size = 0"), "no session days before ", F.col("exam"), "; ", F.col("m").cast("string"), " topic(s) unplaced"))
        .unionByName(say(per.filter((F.col("size") > 0) & (F.col("m") > teach)), F.col("m").cast("string"), " topics for ", teach.cast("string"), " classes before ", F.col("exam"), ": some classes cover two topics"))
    )
    return classes.unionByName(held), notes
