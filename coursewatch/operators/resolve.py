"""Several mentions of an item to one event: an ordered fold, and the merge of readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import date_text
from ..functions import dates as D
from ..functions import text as T
from ..scratch import Scratch

EVENT = "struct<start:string,end:string,all_day:boolean,date_text:string,confidence:double,needs_review:boolean,review_reason:string,superseded:string,detail:string,sources:array<string>,assumptions:array<string>,carry:string>"
"""``carry`` is what the caller wants to keep of the mention that stays, of any type; empty if the mentions have no such column."""
TYPES = dict(f.split(":") for f in EVENT.removeprefix("struct<").removesuffix(">").split(","))
FIELDS = list(TYPES)


def _day(event: dict) -> str:
    return (event["start"] or "")[:10]


def _noted(event: dict, other: dict, sources: dict, note: str | None) -> dict:
    """The mention that stays, with the sources of both and the other one's detail where it has none."""
    event["sources"] = sources
    if event["detail"] == "":
        event["detail"] = other["detail"]
    if not isinstance(event["assumptions"], dict):
        event["assumptions"] = dict.fromkeys(event["assumptions"])
    event["assumptions"][note] = None
    return event


def merge_two(a: dict, b: dict) -> dict:
    """The event so far, which may be changed, and the next mention to the event after it. sources is a dict, for its order."""
    first_b = next(iter(b["sources"]), None)
    first_a = next(iter(a["sources"]), None)
    a["sources"].update(b["sources"])
    sources = a["sources"]
    say = lambda *parts: None if None in parts else "".join(parts)
    keep_a = lambda note=None: _noted(a, b, sources, note or say("also listed as '", b["date_text"], "'"))
    keep_b = lambda note=None: _noted(b, a, sources, note or say("also listed as '", a["date_text"], "'"))
    if a["needs_review"] and not b["needs_review"]:
        return keep_b()
    if a["needs_review"] or b["needs_review"]:
        return keep_a()
    if _day(a) != _day(b):
        replaces = lambda old, source: say("supersedes '", old["date_text"], "' still shown at ", source or "")
        if a["superseded"] is not None and a["superseded"] == _day(b):
            return keep_a(replaces(b, first_b))
        if b["superseded"] is not None and b["superseded"] == _day(a):
            return keep_b(replaces(a, first_a))
        reason = say("sources disagree: '", a["date_text"], "' vs '", b["date_text"], "'")
        return a | {"needs_review": True, "review_reason": reason, "assumptions": [*a["assumptions"], *b["assumptions"]]}
    if a["all_day"] is True and b["all_day"] is False:
        return keep_b()
    surer = a["confidence"] is not None and b["confidence"] is not None and b["confidence"] > a["confidence"]
    return keep_b() if surer and a["all_day"] is not None and a["all_day"] == b["all_day"] else keep_a()


_HELD = 4096


def _alone(batch: pa.RecordBatch, n_by: int, last: tuple | None) -> pa.BooleanArray:
    """Mentions that are their item's only one and need nothing done; the batch's last one may go on in the next batch. last: the key before the batch."""
    size = batch.num_rows
    if size < 2:
        return pa.array([False] * size, pa.bool_())
    same = None
    for c in range(n_by):
        a, b = batch.column(c).slice(0, size - 1), batch.column(c).slice(1)
        one = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same = one if same is None else pc.and_(same, one)
    first = tuple(batch.column(c)[0].as_py() for c in range(n_by)) != last
    begins = pa.concat_arrays([pa.array([first], pa.bool_()), pc.invert(same)])
    ends = pa.concat_arrays([pc.invert(same), pa.array([False], pa.bool_())])
    sources, assumptions = (batch.column(n_by + FIELDS.index(f)) for f in ("sources", "assumptions"))
    plain = pc.and_(pc.fill_null(pc.less_equal(pc.list_value_length(sources), 1), False), pc.is_valid(assumptions))
    return pc.and_(pc.and_(begins, ends), plain)


def _as_they_are(batch: pa.RecordBatch, n_by: int, schema: pa.Schema) -> pa.RecordBatch:
    """Single mentions to events without a Python value for any of them."""
    kind = schema.field("event").type
    event = pa.StructArray.from_arrays([batch.column(n_by + k).cast(kind.field(k).type) for k in range(len(FIELDS))], fields=list(kind))
    keys = [batch.column(k).cast(schema.field(k).type) for k in range(n_by)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(np.ones(batch.num_rows, np.int64)), event], schema=schema)


def _folded(batches: Iterator[pa.RecordBatch], by: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Mentions that arrive sorted to events: one running event is held, however many mentions it has."""
    done: list[tuple] = []
    key, n, event = None, 0, None

    def out() -> pa.RecordBatch:
        columns = [pa.array([d[0][k] for d in done], schema.field(k).type) for k in range(len(by))]
        lists = [d[2] | {"sources": list(d[2]["sources"]), "assumptions": list(d[2]["assumptions"])} for d in done]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int64()), pa.array(lists, schema.field("event").type)], schema=schema)
        done.clear()
        return batch

    for batch in batches:
        alone = _alone(batch, len(by), key if n else None)
        if pc.any(alone).as_py():
            yield _as_they_are(batch.filter(alone), len(by), schema)
            batch = batch.filter(pc.invert(alone))
        columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            mention = dict(zip(FIELDS, row[len(by) :], strict=True))
            mention["sources"] = dict.fromkeys(mention["sources"] or ())
            mention["assumptions"] = mention["assumptions"] or []
            if n and row[: len(by)] == key:
                event, n = merge_two(event, mention), n + 1
                continue
            if n:
                done.append((key, n, event))
                if len(done) >= _HELD:
                    yield out()
            key, n, event = row[: len(by)], 1, mention
    if n:
        done.append((key, n, event))
    yield out()


def fold(mentions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One event for each ``by``, mentions merged in ``order``: by, n_mentions, event.

    mentions carry the columns of EVENT. The merge isn't associative, so the
    order is data and an item's mentions can't be dealt out; they are sorted,
    which spills, and pass by one running event, so that an item may have any
    number of them. Sources and assumptions are kept distinct as they come.
    """
    if "carry" not in mentions.columns:
        mentions = mentions.withColumn("carry", F.lit(""))
    ready = mentions.select(*by, F.struct(*order).alias("_order"), *[F.col(f) if f == "carry" else F.col(f).cast(t).alias(f) for f, t in TYPES.items()])
    rows = ready.repartition(*by).sortWithinPartitions(*by, "_order").drop("_order")
    event = T_.StructType([T_.StructField(f.name, ready.schema["carry"].dataType if f.name == "carry" else f.dataType) for f in T_._parse_datatype_string(EVENT)])
    out = T_.StructType([*(ready.schema[c] for c in by), T_.StructField("n_mentions", T_.LongType()), T_.StructField("event", event)])
    arrow = to_arrow_schema(out)
    return rows.mapInArrow(lambda batches: _folded(batches, by, arrow), out)


def merge_readings(readings: DataFrame) -> DataFrame:
    """Which readings of a course count: (course_id, reading_ord, read_at, status, is_partial, merged_status, merged_partial, merged_read_at, used).

    Full readings that are ok take in all ok partial ones; without such, ok
    partial ones stand alone; without those the first failed full one stands
    and the course is unreadable (or, with failed partial ones only, not read).
    """
    ok, full = F.col("status") == "ok", ~F.col("is_partial")
    per = readings.groupBy("course_id").agg(
        F.bool_or(ok & full).alias("any_full"),
        F.bool_or(ok & ~full).alias("any_part"),
        F.min(F.when(~ok & full, F.col("reading_ord"))).alias("first_failed"),
        F.max(F.when(ok, F.col("read_at"))).alias("last_ok"),
    )
    used = F.when(F.col("any_full") | F.col("any_part"), ok).otherwise(F.col("reading_ord") == F.col("first_failed"))
    merged = F.when(F.col("any_full") | F.col("any_part"), "ok").when(F.col("first_failed").isNotNull(), "unreadable").otherwise("not_read")
    return readings.join(per, "course_id").select("course_id", "reading_ord", "read_at", "status", "is_partial", merged.alias("merged_status"), (~F.col("any_full") & F.col("any_part")).alias("merged_partial"), F.col("last_ok").alias("merged_read_at"), F.coalesce(used, F.lit(False)).alias("used"))


def match_titles(mentions: DataFrame, titles: DataFrame, score: Column, threshold: float = 0.55) -> DataFrame:
    """Best title for each mention within its course, and whether several are as good.

    mentions: (course_id, mention_id, ...); titles: (course_id, title). The
    score is an expression over both. Ties are counted, not guessed.
    """
    scored = mentions.join(titles, "course_id").withColumn("score", score).filter(F.col("score") >= threshold)
    best = best_titles(scored, ["course_id", "mention_id"])
    return best.select("course_id", "mention_id", "score", F.array_min("best").alias("title"), F.size("best").cast("long").alias("n_best"), (F.size("best") > 1).alias("needs_review"))


def best_titles(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, score and ``best``, the titles of the highest score in order: several if they are as good. scored: by, title, score."""
    top = scored.groupBy(*by).agg(F.max("score").alias("score"))
    return scored.join(top, [*by, "score"]).groupBy(*by, "score").agg(F.array_sort(F.collect_set("title")).alias("best"))


BELIEF = "course_id string, key string, title string, kind string, start string, end string, all_day boolean, date_text string, confidence double, needs_review boolean, review_reason string, superseded string, detail string, sources array<string>, assumptions array<string>, read_at string"
"""Columns of a resolved event, as beliefs hold it."""
DETAIL_CHARS = 500


def mentions_of(items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Items with their place to mentions with dates: BELIEF's columns, ``ord`` and ``pos``.

    items: course_id, ord (of the reading), pos, title, date_text, kind, url,
    source_url, posted_at, detail, start, end, all_day, review_reason, read_at,
    timezone. Untitled items go. A start makes an item exact; else its text is
    read. An item with a review_reason goes to review whatever its date. With
    ``scratch`` items are written first, and exact ones don't pass through the
    date language, which is left out of the plan where all of them are exact.
    """
    df = items.withColumn("title", T.clean_text(F.col("title"))).filter("title <> ''").withColumn("date_text", T.clean_text(F.coalesce("date_text", F.lit(""))))
    df = df.withColumns({"__seen": D.read_day(F.col("read_at")), "__posted": D.written_day(F.col("posted_at")), "__said": F.when(F.coalesce("start", F.lit("")) == "", F.col("date_text"))})
    exact = D.exact(F.col("start"), F.col("end"), F.col("all_day"), F.col("timezone"))
    if scratch is not None:
        df, _ = scratch.write(df, "said")
        told, open_ = df.filter("__said is null").withColumn("__p", exact).drop("__posted"), df.filter("__said is not null")
        df = told
        if not open_.isEmpty():
            read = date_text.parse(open_, "__said", "__seen", "timezone", "__posted").withColumn("__p", F.col("parsed"))
            df = told.unionByName(read.select(*told.columns))
    else:
        df = date_text.parse(df, "__said", "__seen", "timezone", "__posted").withColumn("__p", F.when(F.coalesce("start", F.lit("")) != "", exact).otherwise(F.col("parsed")))
    forced = F.coalesce("review_reason", F.lit("")) != ""
    own = F.when(F.col("__p.reason") != "", F.concat(F.lit(" ("), F.col("__p.reason"), F.lit(")"))).otherwise("")
    return df.select(
        "course_id",
        T.item_key(F.col("course_id"), F.col("title")).alias("key"),
        "title",
        F.coalesce("kind", F.lit("assignment")).alias("kind"),
        F.col("__p.start").alias("start"),
        F.col("__p.end").alias("end"),
        F.col("__p.all_day").alias("all_day"),
        "date_text",
        F.col("__p.confidence").alias("confidence"),
        (forced | F.col("__p.needs_review")).alias("needs_review"),
        F.when(forced, F.concat("review_reason", own)).otherwise(F.col("__p.reason")).alias("review_reason"),
        F.col("__p.superseded").alias("superseded"),
        F.substring(T.clean_text(F.coalesce("detail", F.lit(""))), 1, DETAIL_CHARS).alias("detail"),
        F.array(F.coalesce(F.nullif("url", F.lit("")), "source_url", F.lit(""))).alias("sources"),
        F.col("__p.assumptions").alias("assumptions"),
        "read_at",
        "ord",
        "pos",
    )


def resolve(items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One event for each course and title, BELIEF's columns; those with needs_review are for a person and never believed.

    Mentions of one item merge in order of reading and place; title and kind
    are those of the mention that stays.
    """
    m = mentions_of(items, scratch)
    folded = fold(m.withColumn("carry", F.struct("title", "kind", "read_at")), ["course_id", "key"], ["ord", "pos"])
    out = folded.select("course_id", "key", *[F.col(f"event.carry.{c}").alias(c) for c in ("title", "kind", "read_at")], *[F.col(f"event.{c}").alias(c) for c in FIELDS if c != "carry"])
    return out.select(*[f.split()[0] for f in BELIEF.split(", ")])
