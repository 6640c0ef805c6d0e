"""The check-in planner: what to send to whom, as a function of configuration, logs and a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def day_name(day: Column) -> Column:
    return F.array(*map(F.lit, DAYS))[F.weekday(day)]


def minutes(clock: Column) -> Column:
    """Minutes since midnight of 'HH:mm'."""
    return F.split(clock, ":")[0].cast("int") * 60 + F.split(clock, ":")[1].cast("int")


def action(now_minute: Column, due: Column, grace: Column, checked_in: Column, scheduled: Column) -> Column:
    """all_clear, missed, remind or wait; null on a day without a check-in."""
    return F.when(~scheduled, F.lit(None)).when(checked_in, "all_clear").when(now_minute >= due + grace, "missed").when(now_minute >= due, "remind").otherwise("wait")


def in_quiet_hours(minute: Column, start: Column, end: Column) -> Column:
    """Half-open; hours that wrap midnight are a union of two."""
    return F.when(start == end, False).when(start < end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def message_key(kind: str, day: Column, contact: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), day.cast("string"), contact)


def share_key(day: Column, contact: Column) -> Column:
    return F.concat(F.lit("share:"), F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit(":"), contact)


def said_key(day: Column, contact: Column, body: Column) -> Column:
    return F.concat_ws(":", F.lit("say"), day.cast("string"), contact, F.substring(F.sha1(body), 1, 10))


def gated(messages: DataFrame, sent: DataFrame, people: DataFrame) -> DataFrame:
    """Messages not sent yet, with ``blocked`` set where the contact's daily cap is reached.

    messages: (person, key, kind, to, ...); sent: (person, key, kind, to,
    status, day); people: (person, today, cap), a null cap counts as 2.
    All-clears and the owner are exempt and all-clears don't count; messages
    approved in the same plan don't count either.
    """
    fresh = messages.join(sent.filter("status = 'ok'").select("person", "key").distinct(), ["person", "key"], "left_anti")
    today = people.select("person", F.col("today").alias("day"))
    used = sent.filter("status = 'ok' and kind <> 'clear'").join(today, ["person", "day"], "left_semi").groupBy("person", "to").agg(F.count(F.lit(1)).alias("_n"))
    over = (F.coalesce("_n", F.lit(0)) >= F.coalesce("cap", F.lit(2))) & ~F.col("kind").isin("clear", "all_clear") & (F.col("to") != "owner")
    both = fresh.join(used, ["person", "to"], "left").join(people.select("person", "cap"), "person")
    return both.select(*messages.columns, F.when(over, F.concat(F.lit("daily cap reached for "), F.col("to"))).alias("blocked"))


def all_clears(contacts: DataFrame, sent: DataFrame) -> DataFrame:
    """Contacts (person, today, to, ...) that were alerted today, and only they, with the key of their all-clear."""
    alerted = sent.filter("status = 'ok'").select("person", F.col("key").alias("_alert")).distinct()
    asked = contacts.withColumn("_alert", message_key("missed", F.col("today"), F.col("to")))
    return asked.join(alerted, ["person", "_alert"], "left_semi").drop("_alert").withColumn("key", message_key("clear", F.col("today"), F.col("to")))


def last_checkin(checkins: DataFrame, until: DataFrame) -> DataFrame:
    """The latest check-in (person, day, at, ...) of each person on or before a day. until: (person, until)."""
    rest = [c for c in checkins.columns if c not in ("person", "day", "at")]
    best = F.max(F.struct("day", "at", *rest))
    return checkins.join(until, "person").filter("day <= until").groupBy("person").agg(best.alias("b")).select("person", "b.*")


# --- the whole plan ---------------------------------------------------------------

PERSON = "person bigint, enabled boolean, owner_name string, now timestamp_ntz, timezone string, checkin_enabled boolean, due string, grace int, days array<string>, quiet_start string, quiet_end string, share_enabled boolean, share_day string, share_time string, share_contacts array<string>, cap int, include_location boolean"
"""A person's settings and the wall clock at which the plan is made."""
SHARE_DAYS = 7
MESSAGE = ("person", "key", "kind", "to", "to_name", "to_address", "subject", "body", "reason")


def _say(*parts) -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])


def _clock(c: Column) -> Column:
    return F.date_format(c, "h:mm a")


def _ago(seen: Column, now: Column) -> Column:
    m = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(seen.cast("timestamp"))) / 60)
    return F.when(m < 1, "just now").when(m < 90, _say(m.cast("string"), " min ago")).when(m < 48 * 60, _say(F.floor(m / 60).cast("string"), " h ago")).otherwise(_say(F.floor(m / 1440).cast("string"), " days ago"))


def plan(people: DataFrame, contacts: DataFrame, checkins: DataFrame, sent: DataFrame, outbox: DataFrame, plans: DataFrame, places: DataFrame, agenda: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (MESSAGE, and ``blocked`` with the reason of those that must not go) and notes (person, note).

    people: PERSON; contacts: (person, contact, name, address, pos); checkins:
    (person, day, at, note, place); sent: (person, key, kind, to, status, day);
    outbox: (person, key, to, subject, body) that the person asked for; plans:
    (person, day, note); places: (person, place, seen_at), the last one shared;
    agenda: (person, day, title, course, kind). Times are local. What was sent
    before isn't planned again; nothing is approved for who has it off.
    """
    name = F.coalesce(F.nullif("owner_name", F.lit("")), F.lit("your student"))
    on = people.withColumns({"today": F.to_date("now"), "minute": F.hour("now") * 60 + F.minute("now"), "who": name})
    off, on = on.filter("not coalesce(enabled, false)"), on.filter("enabled")
    mine = checkins.select("person", F.col("day").alias("today"), F.struct("at", "note").alias("_in"))
    listed = contacts.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_named"))
    tonight = plans.groupBy("person", F.col("day").alias("today")).agg(F.array_sort(F.collect_set("note")).alias("_plans"))
    on = on.join(mine, ["person", "today"], "left").join(listed, "person", "left").join(tonight, ["person", "today"], "left")
    day = day_name(F.col("today"))
    scheduled = F.coalesce("checkin_enabled", F.lit(True)) & F.array_contains(F.transform("days", lambda d: F.substring(F.lower(d), 1, 3)), day)
    on = on.withColumns({"_day": day, "_do": action(F.col("minute"), minutes(F.col("due")), F.col("grace"), F.col("_in").isNotNull(), scheduled)})
    due = F.col("today").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes(F.col("due")))
    on = on.withColumns({"_due": due, "_late": due + F.make_dt_interval(mins=F.col("grace"))})
    to = contacts.select("person", F.col("contact").alias("to"), F.col("name").alias("to_name"), F.col("address").alias("to_address"))

    before = last_checkin(checkins, on.select("person", F.date_sub("today", 1).alias("until"))).select("person", F.struct("day", "at", "note", "place").alias("_before"))
    late = on.filter("_do = 'missed'").join(to, "person").join(before, "person", "left").join(places, "person", "left")
    last = F.when(F.col("_before").isNull(), "no earlier check-in on record").otherwise(_say("last check-in ", F.date_format("_before.at", "EEE MMM dd, h:mm a"), F.when(F.coalesce("_before.note", F.lit("")) != "", _say(' ("', F.col("_before.note"), '")')).otherwise("")))
    where = (
        F.when(F.col("place").isNotNull(), _say(F.col("place"), " (seen ", F.date_format("seen_at", "EEE h:mm a"), ", ", _ago(F.col("seen_at"), F.col("now")), ")"))
        .when(F.coalesce("_before.place", F.lit("")) != "", _say(F.col("_before.place"), " (said at the check-in of ", F.col("_before.day").cast("string"), ")"))
        .otherwise("not available")
    )
    place = F.when(F.col("include_location"), _say("\nLast place that ", F.col("who"), " shared: ", where, ".")).otherwise("")
    alert = _say("Hi ", F.col("to_name"), ",\n\n", F.col("who"), " asked for this message if a nightly check-in couldn't be confirmed. There was none by ", _clock(F.col("_due")), " (", F.col("timezone"), ") or in the time allowed after it.\n\nIt is sent automatically and needn't mean anything; please call or text ", F.col("who"), ". One more message follows if the check-in still comes.\n\nRecord: ", last, ".", place)
    missed = late.select("person", message_key("missed", F.col("today"), F.col("to")).alias("key"), F.lit("missed_checkin").alias("kind"), "to", "to_name", "to_address", _say("Check-in: could not reach ", F.col("who"), " tonight").alias("subject"), alert.alias("body"), _say("no check-in by ", F.date_format("_due", "HH:mm"), " + grace").alias("reason"))

    names = F.transform("_named", lambda x: x["name"])
    told = F.when(F.coalesce(F.size("_named"), F.lit(0)) == 0, "nobody (no contacts yet)").when(F.size("_named") == 1, names[0]).otherwise(_say(F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "), " and ", F.element_at(names, -1)))
    out_ = F.when(F.col("_plans").isNotNull(), _say(" I have you down for ", F.array_join("_plans", " and "), "; say if you'll be later.")).otherwise("")
    ask = on.filter("_do = 'remind'").select(
        "person", F.concat_ws(":", F.lit("remind"), F.col("today").cast("string")).alias("key"), F.lit("owner_reminder").alias("kind"), F.lit("owner").alias("to"), F.lit("owner").alias("to_name"), F.lit("").alias("to_address"), F.lit("Check-in").alias("subject"),
        _say("Checking in: are you good tonight? Any answer counts. Without one by ", _clock(F.col("_late")), " I'll let ", told, " know.", out_).alias("body"),
        _say("check-in due ", F.date_format("_due", "HH:mm"), ", not yet received", F.when(F.col("_plans").isNotNull(), _say("; plans tonight: ", F.array_join("_plans", ", "))).otherwise("")).alias("reason"),
    )

    back = all_clears(on.filter("_do = 'all_clear'").join(to, "person"), sent)
    said = F.when(F.coalesce("_in.note", F.lit("")) != "", _say(' and said: "', F.col("_in.note"), '"')).otherwise("")
    clear = back.select("person", "key", F.lit("all_clear").alias("kind"), "to", "to_name", "to_address", _say("All clear: ", F.col("who"), " checked in").alias("subject"), _say("Hi ", F.col("to_name"), ",\n\nall clear: ", F.col("who"), " checked in at ", _clock(F.col("_in.at")), said, ".").alias("body"), F.lit("owner checked in after an alert went out").alias("reason"))

    asked = outbox.join(on.select("person"), "person", "left_semi").join(to, ["person", "to"], "left")
    own = asked.select("person", "key", F.lit("owner_message").alias("kind"), "to", F.coalesce("to_name", "to").alias("to_name"), F.coalesce("to_address", F.lit("")).alias("to_address"), "subject", "body", F.lit("owner asked for it").alias("reason"))

    sharing = on.filter(F.col("share_enabled") & (F.substring(F.lower("share_day"), 1, 3) == F.col("_day")) & (F.col("minute") >= minutes(F.col("share_time"))))
    quiet = F.coalesce(in_quiet_hours(F.col("minute"), minutes(F.col("quiet_start")), minutes(F.col("quiet_end"))), F.lit(False))
    sharing = sharing.withColumn("_quiet", quiet)
    week = agenda.join(sharing.select("person", "today"), "person").filter(F.col("day").between(F.col("today"), F.date_add("today", SHARE_DAYS)) & F.col("kind").isin("exam", "assignment"))
    line = _say("- ", F.date_format("day", "EEE MMM dd"), ": ", F.col("title"), " (", F.col("course"), ", ", F.col("kind"), ")")
    lines = week.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "title", line.alias("line")))), lambda x: x["line"]).alias("_lines"))
    who = F.coalesce(F.nullif("owner_name", F.lit("")), F.lit("Your student"))
    shared = sharing.filter("not _quiet").withColumn("to", F.explode("share_contacts")).join(to.withColumn("_known", F.lit(True)), ["person", "to"], "left").join(lines, "person", "left")
    body = _say(who, "'s exams and deadlines, ", F.date_format("today", "MMM dd"), " to ", F.date_format(F.date_add("today", SHARE_DAYS), "MMM dd"), ":\n\n", F.coalesce(F.array_join("_lines", "\n"), F.lit("- nothing due this week")), "\n\nDates come from the course pages; what they leave open isn't listed.")
    share = shared.filter("_known").select("person", share_key(F.col("today"), F.col("to")).alias("key"), F.lit("schedule_share").alias("kind"), "to", "to_name", "to_address", _say(who, "'s week: exams and deadlines").alias("subject"), body.alias("body"), F.lit("weekly schedule share is on for this contact").alias("reason"))

    messages = missed.unionByName(ask).unionByName(clear).unionByName(own).unionByName(share)
    messages = gated(messages.select(*MESSAGE), sent, on)

    none = F.coalesce(F.size("_named"), F.lit(0)) == 0
    note = lambda df, text: df.select("person", (text if isinstance(text, Column) else F.lit(text)).alias("note"))
    notes = (
        note(off, "check-ins are off")
        .unionByName(note(on.filter(none), "no contacts; nothing can be sent"))
        .unionByName(note(on.filter("_do = 'wait'"), _say("check-in due at ", F.date_format("_due", "HH:mm"))))
        .unionByName(note(on.filter("_do = 'all_clear'"), _say("checked in today at ", F.date_format("_in.at", "HH:mm"))))
        .unionByName(note(on.filter((F.col("_do") == "missed") & none), _say("check-in missed at ", F.date_format("_late", "HH:mm"), " but there is nobody to tell")))
        .unionByName(note(on.filter(F.col("_do").isNull() & F.coalesce("checkin_enabled", F.lit(True))), _say("no check-in scheduled on ", F.col("_day"))))
        .unionByName(note(sharing.filter("_quiet"), "schedule share held: quiet hours"))
        .unionByName(note(shared.filter("_known is null"), _say("schedule share: unknown contact ", F.col("to"))))
    )
    return messages, notes


def log_outbox(outbox: DataFrame, asked: DataFrame) -> DataFrame:
    """The outbox (person, key, to, subject, body) after what a person asked for (person, day, to, subject, body): the same words to the same contact on one day are one message."""
    new = asked.select("person", said_key(F.col("day"), F.col("to"), F.col("body")).alias("key"), "to", "subject", "body")
    return outbox.unionByName(new).dropDuplicates(["person", "key"])


def after_sending(outbox: DataFrame, sent: DataFrame) -> DataFrame:
    """What is left in the outbox: messages that weren't sent."""
    return outbox.join(sent.filter("status = 'ok'").select("person", "key").distinct(), ["person", "key"], "left_anti")


def recipient(key: Column) -> Column:
    """Whom a message key names."""
    parts = F.split(key, ":")
    return F.when(parts[0] == "remind", "owner").otherwise(F.coalesce(F.get(parts, F.lit(2)), F.lit("")))


def log_checkins(checkins: DataFrame, new: DataFrame) -> DataFrame:
    """Check-ins (person, day, at, note, place) after new ones: the last of a day stays."""
    all_ = checkins.unionByName(new)
    return all_.groupBy("person", "day").agg(F.max(F.struct("at", "note", "place")).alias("x")).select("person", "day", "x.*")


def log_plans(plans: DataFrame, new: DataFrame) -> DataFrame:
    """Plans (person, day, note), each once."""
    return plans.unionByName(new).distinct()


def log_sent(sent: DataFrame, reports: DataFrame) -> DataFrame:
    """sent (person, key, kind, to, status, day) after reports (person, key, status, at): the last report of a key stands."""
    last = reports.groupBy("person", "key").agg(F.max(F.struct("at", "status")).alias("x"))
    new = last.select("person", "key", F.split("key", ":")[0].alias("kind"), recipient(F.col("key")).alias("to"), "x.status", F.to_date("x.at").alias("day"))
    return sent.join(new.select("person", "key"), ["person", "key"], "left_anti").select(*new.columns).unionByName(new)
