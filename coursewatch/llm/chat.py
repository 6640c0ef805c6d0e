"""Chat formatting by quotation linking, in built-in functions only.

Lines that start with > marks are quoted, once for each mark; lines of one
level in a row are a passage. A quoted passage is normalised (lower-cased,
white space and line ends collapsed, so that a mail program's new wrapping
changes nothing) and hashed, as a whole, by sentence and by line, and each hash
is linked to the latest earlier message of the same conversation that has it
among its own. The message that most words of a message's least deep quotes
come from is what it replies to. Conversations are built of the messages
without their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let

BLOCK_TURNS = 512
"""Turns of a conversation that one window partition holds for a hash."""
PART_MESSAGES = 512
"""About so many messages of a conversation that one row holds; a longer one takes several rows, in order."""
MARKS = r"^(?:[ \t]{0,3}>)+"
SENTENCE_ENDS = r"(?<=[.!?]) "


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def content(line: Column) -> Column:
    """The line without its marks and the space after them."""
    return F.regexp_replace(line, MARKS + r"[ \t]?", "")


def normal(line: Column) -> Column:
    """Lower-cased, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def runs(lines: Column) -> Column:
    """Lines of (level, line) cut into passages: one starts where the level changes, and after a blank line that isn't quoted."""
    blank = lambda x: (x["level"] == 0) & (normal(x["line"]) == "")
    first = lambda i: (i == 0) | (F.get(lines, i - 1)["level"] != F.get(lines, i)["level"]) | blank(F.get(lines, i - 1))
    starts = F.filter(F.transform(lines, lambda x, i: i), first)
    return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at)))


def units(run: Column) -> Column:
    """Normalised texts of a passage: the whole, its sentences, its lines."""
    each = F.transform(run, lambda x: normal(x["line"]))
    return let(each, lambda parts: let(F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " ")), lambda whole: F.array_distinct(F.filter(F.concat(F.array(whole), F.split(whole, SENTENCE_ENDS), parts), lambda u: u != ""))))


def parsed(text: Column) -> Column:
    """Own text; array of (level, units) of quoted passages that aren't blank; and hashes of own units."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(level(x).alias("level"), content(x).alias("line")))
    words = lambda u: F.size(F.split(u, " "))
    hashed = lambda us: F.transform(us, lambda u: F.struct(F.md5(u).alias("h"), words(u).alias("n")))
    quoted = lambda all_: F.filter(F.transform(F.filter(all_, lambda r: r[0]["level"] > 0), lambda r: F.struct(r[0]["level"].alias("level"), hashed(units(r)).alias("units"))), lambda q: F.size(q["units"]) > 0)
    own = lambda all_: F.array_distinct(F.flatten(F.transform(F.filter(all_, lambda r: r[0]["level"] == 0), lambda r: F.transform(units(r), F.md5))))
    # all of a message's own text too, which quotes of several paragraphs are equal to
    whole = lambda all_: units(F.flatten(F.filter(all_, lambda r: r[0]["level"] == 0)))
    return let(
        lines,
        lambda ls: let(
            runs(ls),
            lambda all_: F.struct(
                F.btrim(F.array_join(F.transform(F.filter(ls, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(" \t\r\n")).alias("body"),
                quoted(all_).alias("quoted"),
                F.array_union(own(all_), F.transform(whole(all_), F.md5)).alias("own"),
            ),
        ),
    )


def latest_before(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For each (conv_id, h, turn) of ``asked``, the largest earlier turn of ``known`` with conv_id and h.

    A scan in two levels: within blocks of turns, and over what is latest in
    each earlier block, so that a line said in every turn of a huge
    conversation isn't one partition, and no pairs are made.
    """
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    asked = asked.select("conv_id", "h", "turn", block.alias("block")).distinct()
    known = known.select("conv_id", "h", "turn").distinct().join(asked.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").withColumn("block", block)
    within = Window.partitionBy("conv_id", "h", "block").orderBy("turn", "known").rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.withColumn("known", F.lit(0)).union(known.withColumn("known", F.lit(1)))
    near = rows.withColumn("near", F.max(F.when(F.col("known") == 1, F.col("turn"))).over(within)).filter("known = 0").select("conv_id", "h", "turn", "block", "near")
    across = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "h", "block").agg(F.max(F.when(F.col("known") == 1, F.col("turn"))).alias("top"))
    far = blocks.select("conv_id", "h", "block", F.max("top").over(across).alias("far"))
    return near.join(far, ["conv_id", "h", "block"], "left").select("conv_id", "h", "turn", F.coalesce("near", "far").alias("source")).filter("source is not null")


def messages(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a message: conv_id, turn, role, body, parent_turn, n_quoted, n_linked, depth, chat.

    ``body`` is the text without quoted lines; parent_turn the turn replied to
    (most linked words at the lowest level that has links, then the latest),
    null where nothing is quoted or no earlier message has it; a parent is
    always earlier, so (conv_id, turn) is a reply order. n_quoted counts quoted
    passages, n_linked those with a source, depth is the deepest level. Null
    text counts as empty, a null role as 'unknown'; rows without conv_id or
    turn are kept and link to nothing; repeated rows are kept. Other columns
    are left out; an empty table gives an empty table.
    """
    base = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.xxhash64("role", "text").alias("_m"), parsed(F.col("text")).alias("p"))
    base, _ = scratch.write(base, "messages")
    asking = base.filter((F.size("p.quoted") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = asking.select("conv_id", "turn", "_m", F.posexplode("p.quoted").alias("at", "q")).select("conv_id", "turn", "_m", "at", "q.level", F.explode("q.units").alias("u")).select("conv_id", "turn", "_m", "at", "level", "u.h", "u.n").distinct()
    # only conversations in which something is quoted are hashed out
    known = base.filter("turn is not null").join(asking.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode("p.own").alias("h"))
    linked, _ = scratch.write(quoted.join(latest_before(quoted, known), ["conv_id", "h", "turn"]), "links")
    votes = linked.groupBy("conv_id", "turn", "_m", "level", "source").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(-F.col("level"), F.col("n"), F.col("source").alias("source")))
    found = linked.groupBy("conv_id", "turn", "_m").agg(F.count_distinct("at").alias("n_linked"))
    replies = votes.groupBy("conv_id", "turn", "_m").agg(best["source"].alias("parent_turn")).join(found, ["conv_id", "turn", "_m"])
    return base.join(replies, ["conv_id", "turn", "_m"], "left").select(
        "conv_id",
        "turn",
        "role",
        F.col("p.body").alias("body"),
        "parent_turn",
        F.size("p.quoted").cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_max(F.transform("p.quoted", lambda q: q["level"])), F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("p.body"), F.lit("\n")).alias("chat"),
    )


PREFIX = 4
"""Characters of a message by which the messages of one turn are first sorted."""


def places(said: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, chat, ..., n equal ones) with ``place``, how many messages of the conversation stand before them.

    The order is turn, role, chat, depth, whether it replies. Counts are summed up
    over blocks of turns, turns of a block, beginnings of a turn's messages, and
    messages of one beginning, so that no task sorts a conversation, nor a turn
    but for messages that differ and begin alike.
    """
    earlier = lambda total, by, order: F.coalesce(F.sum(total).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = said.withColumns({"block": F.floor(F.col("turn") / BLOCK_TURNS), "start": F.concat_ws("\n", "role", F.substring("chat", F.length("role") + 6, F.lit(PREFIX)))})
    levels = [(["conv_id"], ["block"]), (["conv_id", "block"], ["turn"]), (["conv_id", "block", "turn"], ["role", "start"])]
    place = earlier("n", ["conv_id", "block", "turn", "role", "start"], ["chat", "depth", "replies"])
    out = said.withColumn("place", place)
    for by, order in levels:
        sums = said.groupBy(*by, *order).agg(F.sum("n").alias("_n"))
        out = out.join(sums.withColumn("_before", earlier("_n", by, order)).drop("_n"), [*by, *order]).withColumn("place", F.col("place") + F.col("_before")).drop("_before")
    return out.drop("block", "start")


def conversations(formatted: DataFrame) -> DataFrame:
    """Conversations as text, messages in reply order: conv_id, part, first_turn, n_messages, n_replies, depth, text.

    ``formatted`` is what messages() gives. A conversation is one row, part 0,
    unless it has more than PART_MESSAGES messages: then each part has that
    many, the last one what is left, and the texts of its parts, put together by
    part, are the conversation. Messages of one turn stand by role and text. A
    row without conv_id or turn is a conversation of its own. Repeated rows
    count; equal messages of a turn are counted before anything is sorted, so
    that any number of them fills no task.
    """
    whole = formatted.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    alike = whole.groupBy("conv_id", "turn", "role", "chat", "depth", F.col("parent_turn").isNotNull().cast("long").alias("replies")).agg(F.count(F.lit(1)).alias("n"))
    long_ = whole.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > PART_MESSAGES).select("conv_id")
    short = alike.join(long_, "conv_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    size = F.lit(PART_MESSAGES)
    placed = places(alike.join(long_, "conv_id", "left_semi")).withColumn("part", F.explode(F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("n") - 1) / size))))
    here = F.least(F.col("place") + F.col("n"), (F.col("part") + 1) * size) - F.greatest("place", F.col("part") * size)
    dealt = short.unionByName(placed.withColumn("n", here).drop("place"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "chat", "n")))
    told = (F.sum("n").alias("n_messages"), F.sum(F.col("n") * F.col("replies")).alias("n_replies"), F.max("depth").alias("depth"))
    grouped = dealt.groupBy("conv_id", "part").agg(turns.alias("m"), F.min("turn").alias("first_turn"), *told)
    text = F.array_join(F.transform("m", lambda x: F.repeat(x["chat"], x["n"].cast("int"))), "").alias("text")
    alone = formatted.filter(F.col("conv_id").isNull() | F.col("turn").isNull()).select("conv_id", F.lit(0).cast("long").alias("part"), F.col("turn").alias("first_turn"), F.lit(1).cast("long").alias("n_messages"), F.lit(0).cast("long").alias("n_replies"), "depth", F.col("chat").alias("text"))
    return grouped.select("conv_id", F.col("part").cast("long").alias("part"), "first_turn", "n_messages", "n_replies", "depth", text).unionByName(alone)
