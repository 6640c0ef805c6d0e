"""What is due, what moved, how an item came about: the read side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def upcoming(belief: DataFrame, today: Column, weeks: int = 7) -> DataFrame:
    return belief.filter(F.col("start_day").between(today, F.date_add(today, 7 * weeks)))


def recent(belief: DataFrame, today: Column, weeks: int = 7) -> DataFrame:
    return belief.filter(F.col("start_day").between(F.date_sub(today, 7 * weeks), today))


def volatility(changes: DataFrame) -> DataFrame:
    """Moves and changes by course; what the first run of a course added isn't a change."""
    first = changes.groupBy("course_id").agg(F.min("run_id").alias("first_run"))
    counted = changes.join(first, "course_id").filter(~((F.col("type") == "added") & (F.col("run_id") == F.col("first_run"))))
    return counted.groupBy("course_id").agg(F.count_if(F.col("type") == "moved").alias("n_moved"), F.count(F.lit(1)).alias("n_changes"))


def most_volatile(by_course: DataFrame) -> DataFrame:
    return by_course.orderBy(F.desc("n_moved"), F.desc("n_changes"), "course_id").limit(1)


def search(belief: DataFrame, query: str) -> DataFrame:
    """Rows of the best rung that has any: exact key, equal title, part of title or key."""
    q = query.strip()
    title, key, low = F.lower("title"), F.lower("key"), F.lit(q.lower())
    rung = F.when(F.col("key") == q, 1).when(title == low, 2).when(F.contains(title, low) | F.contains(key, low), 3)
    found = belief.withColumn("rung", rung).filter("rung is not null")
    best = found.agg(F.min("rung")).first()[0]
    return found.filter(F.col("rung") == F.lit(best))


def item_history(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """Changes that name a key as their own, before or after; three hash joins instead of one with OR."""
    wanted = keys.select(F.col("key").alias("item")).distinct()
    parts = [changes.join(wanted, changes[c] == wanted["item"]) for c in ("key", "before_key", "after_key")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace (32 hex digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def episode_body(course: Column, kind: Column, change: Column, title: Column, old: Column, new: Column, day: Column) -> Column:
    """A sentence for each change, for a temporal graph."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(change == "moved", say("In ", course, " the ", kind, " '", title, "' moved from ", old, " to ", new, ", seen on ", day, "."))
        .when(change == "added", say("In ", course, " a new ", kind, " '", title, "' is scheduled for ", new, ", first seen on ", day, "."))
        .when(change == "removed", say("In ", course, " the ", kind, " '", title, "' of ", old, " was removed, confirmed on ", day, "."))
        .when(change == "reworded", say("In ", course, " '", old, "' is now titled '", title, "', seen on ", day, "."))
    )


def snapshot_json(belief: DataFrame) -> DataFrame:
    """One JSON text for each course with its dated items in order of start and title."""
    item = F.struct("start", "title", "kind", "end", "all_day")
    return belief.filter("start is not null").groupBy("course_id").agg(F.to_json(F.struct(F.first("course_id").alias("id"), F.sort_array(F.collect_list(item)).alias("items"))).alias("body"))


EPISODES = "2f1c1d7e6d3a4d249e3f7c1b1a7b0a11"
"""Fixed value: the namespace of episode ids."""
PART_ITEMS = 500
"""Items of a course that one snapshot episode holds; a course with more has several, numbered."""


def episodes(changes: DataFrame, belief: DataFrame, names: DataFrame, run_id: str, as_of: str, group: str = "courses") -> DataFrame:
    """A run's episodes for a temporal graph: key, uuid, name, body, source, reference_time, group_id.

    One for each change, a sentence, and for each course its dated items as JSON
    in order of start and title, PART_ITEMS an episode, so that no course is
    collected whole. The ids follow from run and key: sending again is the same.
    """
    day = F.lit(as_of[:10])
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    named = lambda df: df.join(names.select("course_id", F.col("name").alias("_name")), "course_id", "left").withColumn("_name", F.coalesce("_name", "course_id"))
    at = lambda side: when(F.col(f"{side}.start"), F.col(f"{side}.end"), F.col(f"{side}.all_day"))
    reworded = F.col("type") == "reworded"
    body = episode_body(F.col("_name"), F.coalesce("after.kind", "before.kind"), F.col("type"), F.col("title"), F.when(reworded, F.col("before.title")).otherwise(at("before")), at("after"), day)
    source = F.get(F.coalesce("after.sources", "before.sources"), F.lit(0))
    told = named(changes).select(F.col("key"), F.col("type").alias("_kind"), say(F.col("type"), ": ", F.col("title"), " (", F.col("course_id"), ")").alias("name"), say(body, F.when(F.coalesce(source, F.lit("")) != "", say(" Source: ", source, ".")).otherwise("")).alias("body"), F.lit("text").alias("source"))
    dated = named(belief.filter("start is not null"))
    # items of a course are numbered by month of start first, then within it: no window holds a course
    month = F.substring("start", 1, 7)
    sizes = dated.groupBy("course_id", month.alias("_month")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("course_id").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("course_id", "_month").orderBy("start", "title", "key")) - 1
    placed = dated.withColumn("_month", month).join(before, ["course_id", "_month"]).withColumn("_place", place).withColumn("_part", F.floor(F.col("_place") / PART_ITEMS))
    item = F.struct("title", "kind", "start", "end", "all_day", F.get("sources", F.lit(0)).alias("source"))
    parts = placed.groupBy("course_id", "_name", "_part").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", item.alias("i")))), lambda x: x["i"]).alias("items"))
    number = F.when(F.col("_part") > 0, say(" (", (F.col("_part") + 1).cast("string"), ")")).otherwise("")
    text = F.to_json(F.struct(F.struct(F.col("course_id").alias("id"), F.col("_name").alias("name")).alias("course"), day.alias("observed_on"), "items"))
    whole = parts.select(say(F.col("course_id"), F.when(F.col("_part") > 0, say("#", F.col("_part").cast("string"))).otherwise("")).alias("key"), F.lit("snapshot").alias("_kind"), say("snapshot: ", F.col("_name"), " on ", day, number).alias("name"), text.alias("body"), F.lit("json").alias("source"))
    id_ = uuid5(EPISODES, F.concat_ws("|", F.lit(run_id), "_kind", "key"))
    return told.unionByName(whole).select("key", id_.alias("uuid"), "name", "body", "source", F.lit(as_of).alias("reference_time"), F.lit(group).alias("group_id"))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def when(start: Column, end: Column, all_day: Column) -> Column:
    """(no date), a day, a range of days, or a time."""
    return F.when(start.isNull(), "(no date)").when(all_day & end.isNotNull() & (end != start), F.concat(start, F.lit(".."), end)).otherwise(start)


def mastery_latest(scores: DataFrame) -> DataFrame:
    """(course_id, concept, score, at, n) with the last score of each concept by (at, pos)."""
    last = F.max(F.struct("at", "pos", "score"))
    return scores.groupBy("course_id", "concept").agg(last["score"].alias("score"), last["at"].alias("at"), F.count(F.lit(1)).alias("n"))


def weak(latest: DataFrame, under: int = 2) -> DataFrame:
    return latest.filter(F.col("score") < under)


def valid_scores(scores: DataFrame) -> DataFrame:
    """Fails on a score outside 0..3."""
    return scores.withColumn("score", F.when(F.assert_true(F.col("score").between(0, 3), "score must be 0..3").isNull(), F.col("score")))


def mastery_summary(latest: DataFrame) -> DataFrame:
    """(course_id, concepts, weak, solid) of latest scores."""
    return latest.groupBy("course_id").agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("score") < 2).alias("weak"), F.count_if(F.col("score") >= 2).alias("solid"))


# --- whole reports, a row a line -----------------------------------------------------


def weekday_time(iso: Column, all_day: Column) -> Column:
    """'Wed Oct 14, 2026', with the time and offset of what isn't all day; 'no date' for null."""
    local = F.try_to_timestamp(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    offset = F.regexp_extract(iso, r"([+-]\d{2}:\d{2})$", 1)
    timed = F.concat(F.date_format(local, "EEE MMM dd, yyyy h:mm a"), F.when(offset != "", F.concat(F.lit(" ("), offset, F.lit(")"))).otherwise(""))
    return F.when(iso.isNull(), "no date").when(all_day, F.date_format(F.to_date(F.substring(iso, 1, 10)), "EEE MMM dd, yyyy")).otherwise(F.coalesce(timed, iso))


def digest(belief: DataFrame, changes: DataFrame, missing: DataFrame, review: DataFrame, names: DataFrame, today: Column, weeks: int = 1) -> DataFrame:
    """(section, ord, line): what is due, what changed, which courses move most, what is missing once, what a person must decide.

    belief: resolved events; changes: (run_id, as_of, course_id, type, title,
    note, source) of committed runs; missing: removal counters with title;
    review: open rows of the bucket; names: (course_id, name).
    """
    called = lambda df: df.join(names.select("course_id", "name"), "course_id", "left").withColumn("_c", F.coalesce("name", "course_id"))
    rows = lambda df, section, ord_, line: df.select(F.lit(section).alias("section"), ord_.cast("string").alias("ord"), line.alias("line"))
    due = called(upcoming(belief.withColumn("start_day", F.to_date(F.substring("start", 1, 10))), today, weeks))
    clock = F.when(F.col("all_day"), "").otherwise(F.date_format(F.try_to_timestamp(F.substring("start", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), " h:mm a"))
    out = rows(due, "1 due", F.concat_ws(" ", "start", "title"), F.concat(F.date_format("start_day", "EEE MMM dd"), F.lit(": "), F.col("title"), F.lit(" — "), F.col("_c"), clock))
    seen = called(recent(changes.withColumn("start_day", F.to_date(F.substring("as_of", 1, 10))), today, weeks))
    source = F.when(F.col("source").isNotNull(), F.concat(F.lit(" (source: "), F.col("source"), F.lit(")"))).otherwise("")
    out = out.unionByName(rows(seen, "2 changed", F.concat_ws(" ", "run_id", "_c", "title"), F.concat(F.col("start_day").cast("string"), F.lit(": "), F.upper("type"), F.lit(" — "), F.col("_c"), F.lit(": "), F.col("title"), F.lit(" — "), F.col("note"), source)))
    moved = called(volatility(changes))
    rank = F.concat(F.lpad((F.lit(999_999_999) - F.col("n_moved")).cast("string"), 9, "0"), F.lpad((F.lit(999_999_999) - F.col("n_changes")).cast("string"), 9, "0"), F.col("course_id"))
    out = out.unionByName(rows(moved, "3 volatility", rank, F.concat(F.col("_c"), F.lit(": "), F.col("n_moved").cast("string"), F.lit(" deadline move(s), "), F.col("n_changes").cast("string"), F.lit(" change(s) total"))))
    lost = called(missing)
    out = out.unionByName(rows(lost, "4 pending removals", F.concat_ws(" ", "_c", "title"), F.concat(F.col("_c"), F.lit(": "), F.col("title"), F.lit(" — missing since "), F.col("first_missing").cast("string"), F.lit(" ("), F.col("count").cast("string"), F.lit("/2)"))))
    open_ = called(review)
    return out.unionByName(rows(open_, "5 needs your decision", F.concat_ws(" ", "_c", "title"), F.concat(F.col("_c"), F.lit(": "), F.col("title"), F.lit(' — "'), F.col("date_text"), F.lit('" — '), F.col("reason"))))


def headed(told: DataFrame, today: Column, scratch: Scratch, weeks: int = 1) -> DataFrame:
    """digest() with a title, a heading and count for each section and each day that something is due, what moves most, and a line where a section has none.

    Read in the order of (section, ord, line). Sections on removals and
    decisions stand only where they have lines.
    """
    told, _ = scratch.write(told, "digest")
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    row = lambda df, section, ord_, line: df.select(section.alias("section"), ord_.alias("ord"), line.alias("line"))
    day = lambda n: F.date_add(today, 7 * n).cast("string")
    section, n = F.col("section"), F.col("n")
    known = [("1 due", "nothing is due in this time"), ("2 changed", "nothing has changed"), ("3 volatility", "no date has moved"), ("4 pending removals", None), ("5 needs your decision", None)]
    counts = told.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    sections = told.sparkSession.createDataFrame(known, "section string, nothing string").join(counts, "section", "left").na.fill(0, ["n"]).filter("n > 0 or nothing is not null")
    count = say(": ", n.cast("string"))
    heading = (
        F.when(section == "1 due", say("Due until ", day(weeks), count))
        .when(section == "2 changed", say("Changed since ", day(-weeks), count))
        .when(section == "3 volatility", "Dates that moved this term")
        .when(section == "4 pending removals", say("Missing, not yet removed", count))
        .otherwise(say("To decide", count))
    )
    due = told.filter(section == "1 due").groupBy(F.substring("ord", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # what moves most has the lowest rank; a rank of all nines has not moved
    most = told.filter((section == "3 volatility") & (F.substring("ord", 1, 9) < "999999999")).agg(F.min(F.struct("ord", "line"))["line"].alias("line")).filter("line is not null")
    out = told.unionByName(row(told.sparkSession.range(1), F.lit("0 digest"), F.lit(""), say("Week of ", today.cast("string"))))
    out = out.unionByName(row(sections, section, F.lit(""), heading)).unionByName(row(sections.filter("n = 0"), section, F.lit(" "), F.col("nothing")))
    out = out.unionByName(row(due, F.lit("1 due"), F.col("day"), say(F.date_format(F.to_date("day"), "EEE MMM dd"), count)))
    return out.unionByName(row(most, F.lit("3 volatility"), F.lit("~"), say("moves most: ", F.col("line"))))


def receipts(belief: DataFrame, known: DataFrame, missing: DataFrame, changes: DataFrame, names: DataFrame) -> DataFrame:
    """(key, ord, line) for every believed item: where its date comes from and how it came about.

    known: the ledger (key, event_id, written_at); changes: committed ones
    (as_of, key, before_key, type, before, after, note), before and after being
    events. Ask for one item by filtering on what search() finds.
    """
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    e = belief.join(names.select("course_id", "name"), "course_id", "left").join(known.select("key", "event_id", "written_at"), "key", "left").join(missing.select("key", "first_missing", "count"), "key", "left")
    until = F.when(F.col("end").isNotNull() & (F.col("end") != F.col("start")), say(" to ", weekday_time(F.col("end"), F.col("all_day")))).otherwise("")
    parts = F.concat(
        F.array(say(F.col("title"), " — ", F.coalesce("name", "course_id")), say("Now: ", weekday_time(F.col("start"), F.col("all_day")), until), say('As written: "', F.col("date_text"), '"')),
        F.array_compact(F.array(
            F.when(F.size("sources") > 0, say("Sources: ", F.array_join("sources", ", "))),
            say("Last read: ", F.coalesce(F.nullif("read_at", F.lit("")), F.lit("unknown")), "; confidence ", F.format_string("%.2f", "confidence")),
        )),
        F.transform("assumptions", lambda a: say("Assumed: ", a)),
        F.array_compact(F.array(
            say("Calendar event: ", F.coalesce("event_id", F.lit("none yet")), F.when(F.col("written_at").isNotNull(), say(" (written ", F.substring("written_at", 1, 16), ")")).otherwise(""), "; key ", F.col("key")),
            F.when(F.col("count").isNotNull(), say("Pending removal: missing since ", F.col("first_missing").cast("string"), " (", F.col("count").cast("string"), "/2 reads)")),
        )),
    )
    told = e.select("key", F.posexplode(parts).alias("pos", "line")).select("key", F.format_string("0 %04d", "pos").alias("ord"), "line")
    at = lambda side: weekday_time(F.col(f"{side}.start"), F.col(f"{side}.all_day"))
    day = F.substring("as_of", 1, 10)
    source = F.coalesce(F.get(F.coalesce("after.sources", "before.sources"), F.lit(0)), F.lit(""))
    from_ = F.when(source != "", say(" (source: ", source, ")")).otherwise("")
    line = (
        F.when(F.col("type") == "added", say(day, ": first seen, ", at("after"), ', page said "', F.col("after.date_text"), '"', from_))
        .when(F.col("type") == "moved", say(day, ": moved from ", at("before"), " to ", at("after"), '; page changed from "', F.col("before.date_text"), '" to "', F.col("after.date_text"), '"', from_))
        .when(F.col("type") == "reworded", say(day, ': title reworded to "', F.col("after.title"), '" (same date)', from_))
        .when(F.col("type") == "removed", say(day, ": confirmed removed after two successful reads"))
        .otherwise(say(day, ": ", F.col("type"), " — ", F.col("note")))
    )
    named = changes.select(F.array_distinct(F.array("key", F.coalesce("before_key", "key"))).alias("keys"), F.concat_ws(" ", F.lit("1"), "as_of", "type").alias("ord"), line.alias("line"))
    history = named.select(F.explode("keys").alias("key"), "ord", "line").join(belief.select("key"), "key", "left_semi")
    return told.unionByName(history)


def status(belief: DataFrame, review: DataFrame, missing: DataFrame, known: DataFrame) -> DataFrame:
    """(course_id, n_items, n_written, n_missing, n_review) of each course that has anything."""
    count = lambda df, name: df.groupBy("course_id").agg(F.count(F.lit(1)).alias(name))
    written = belief.join(known.select("key").distinct(), "key", "left_semi")
    parts = [count(belief, "n_items"), count(written, "n_written"), count(missing, "n_missing"), count(review.filter("not coalesce(resolved, false)"), "n_review")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "course_id", "full_outer")
    return out.na.fill(0)
