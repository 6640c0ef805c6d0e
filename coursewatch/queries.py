"""The operators bound to the driver's tables, each with its SQL where SQL can say it.

None of the tables holds two observations of the same items, so two nights are
made of every order: last night lacks those with k % 20 = 3 (they are new
tonight); tonight lacks k % 20 = 0, moves k % 20 = 1 by two days and rewords
k % 20 = 2. Dated text is written from date columns and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import date_text, dates as D, text as T
from .operators import diff, resolve
from .plans import checkin, ledger, nightly, reports, slots
from .plans.state import KEYS, Store, merged
from .scratch import Scratch
from .sources import html_items, ical, mail, pages, rest_json
from .streaming import deadlines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NY, PT = "America/New_York", "America/Los_Angeles"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- two nights of orders -------------------------------------------------

NIGHTS = """
o AS (SELECT o_orderkey AS k, 'c' || (o_custkey % 40) AS c, CAST(o_orderdate AS DATE) AS d, md5(CAST(o_orderkey AS VARCHAR))[1:16] || ' ' || md5(CAST(o_orderkey AS VARCHAR))[17:32] AS t FROM orders),
prev AS (SELECT c AS course_id, k, c || '::' || t AS key, t AS title, d AS start FROM o WHERE k % 20 <> 3),
cur AS (SELECT c AS course_id, k, c || '::' || t || CASE WHEN k % 20 = 2 THEN ' revised' ELSE '' END AS key,
  t || CASE WHEN k % 20 = 2 THEN ' revised' ELSE '' END AS title, d + CASE WHEN k % 20 = 1 THEN 2 ELSE 0 END AS start FROM o WHERE k % 20 <> 0),
ch AS (SELECT coalesce(p.course_id, c.course_id) AS course_id, coalesce(p.key, c.key) AS key, coalesce(p.k, c.k) AS k,
  CASE WHEN p.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'missing' WHEN p.start <> c.start THEN 'moved' ELSE 'same' END AS type,
  CAST(p.start AS VARCHAR) AS before_start, CAST(c.start AS VARCHAR) AS after_start FROM prev p FULL JOIN cur c ON p.course_id = c.course_id AND p.key = c.key)
"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("course_id"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))


def night(o: DataFrame, title: Column, day: Column) -> DataFrame:
    start = day.cast("string")
    return o.select("course_id", T.item_key(F.col("course_id"), T.clean_ascii(title)).alias("key"), title.alias("title"), start.alias("start"), start.alias("end"), F.lit(True).alias("all_day"))


def _title() -> Column:
    """Titles that are alike only if they are one order's."""
    h = F.md5(F.col("k").cast("string").cast("binary"))
    return F.concat_ws(" ", F.substring(h, 1, 16), F.substring(h, 17, 16))


def nights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, m = observed(spark, sf_dir), F.col("k") % 20
    title = _title()
    prev = night(o.filter(m != 3), title, F.col("d"))
    cur = night(o.filter(m != 0), F.concat(title, F.when(m == 2, " revised").otherwise("")), F.date_add("d", F.when(m == 1, 2).otherwise(0)))
    return prev, cur


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changes(*nights(spark, sf_dir)).select("course_id", "key", "type", F.col("before.start").alias("before_start"), F.col("after.start").alias("after_start"))


@query(f"WITH {NIGHTS} SELECT course_id, key, after_start FROM ch WHERE type = 'added'")
def diff_added(spark, sf_dir):
    return _changes(spark, sf_dir).filter("type = 'added'").select("course_id", "key", "after_start")


@query(f"WITH {NIGHTS} SELECT course_id, key, before_start FROM ch WHERE type = 'missing'")
def diff_missing(spark, sf_dir):
    return _changes(spark, sf_dir).filter("type = 'missing'").select("course_id", "key", "before_start")


@query(f"WITH {NIGHTS} SELECT course_id, key, before_start, after_start FROM ch WHERE type = 'moved'")
def diff_moved(spark, sf_dir):
    return _changes(spark, sf_dir).filter("type = 'moved'").select("course_id", "key", "before_start", "after_start")


@query(f"WITH {NIGHTS} SELECT course_id, type, CAST(count(*) AS BIGINT) AS n FROM ch WHERE type <> 'same' GROUP BY ALL")
def diff_full_counts(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("course_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NIGHTS} SELECT course_id, key, type FROM ch WHERE type <> 'same' AND course_id NOT IN ('c7', 'c8', 'c9')
UNION ALL SELECT * FROM (VALUES ('c7', NULL, 'unreadable'), ('c8', NULL, 'not_read'), ('c9', NULL, 'unreadable'))""")
def diff_guarded(spark, sf_dir):
    """Course c7's read failed, c8 wasn't read, c9's page came empty."""
    prev, cur = nights(spark, sf_dir)
    courses = prev.select("course_id").distinct()
    reads = courses.filter("course_id <> 'c8'").withColumn("status", F.when(F.col("course_id") == "c7", "error").otherwise("ok"))
    return diff.guarded(prev, cur.filter(~F.col("course_id").isin("c7", "c8", "c9")), reads).select("course_id", "key", "type")


@query(f"""WITH {NIGHTS} SELECT coalesce(c.course_id, p.course_id) AS course_id, coalesce(c.key, p.key) AS key, CAST(coalesce(c.start, p.start) AS VARCHAR) AS start
FROM prev p FULL JOIN cur c ON p.course_id = c.course_id AND p.key = c.key""")
def diff_partial_upsert(spark, sf_dir):
    """What a partial reading changes: its new and moved items; silence and equal items say nothing."""
    prev, cur = nights(spark, sf_dir)
    told = diff.sides(prev, cur).withColumn("type", F.when(F.col("after").isNull(), "kept").otherwise(diff.label())).withColumn("is_partial", F.lit(True))
    return merged(prev, ledger.belief_delta(told), KEYS["belief"]).select("course_id", "key", "start")


REWORDS = f"""WITH {NIGHTS}, r AS (SELECT p.* FROM prev p ANTI JOIN cur c ON p.key = c.key), a AS (SELECT c.* FROM cur c ANTI JOIN prev p ON p.key = c.key),
w AS (SELECT r.course_id, r.key AS removed, a.key AS added, string_split(lower(r.title), ' ') AS x, string_split(lower(a.title), ' ') AS y FROM r JOIN a ON r.course_id = a.course_id AND r.start = a.start),
s AS (SELECT course_id, removed, added, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS sim FROM w)"""


def _reword_sides(spark, sf_dir):
    prev, cur = nights(spark, sf_dir)
    on = ["course_id", "key"]
    return prev.join(cur, on, "left_anti"), cur.join(prev, on, "left_anti")


@query(REWORDS + " SELECT course_id, removed, added, round(sim, 6) AS sim FROM s WHERE sim >= 0.55")
def reword_pairs_jaccard(spark, sf_dir):
    pairs = diff.reword_pairs(*_reword_sides(spark, sf_dir), score=lambda x, y, _: T.shared_words(x, y))
    return pairs.select("course_id", "removed", "added", F.round("sim", 6).alias("sim"))


@query(f"WITH {NIGHTS} SELECT c AS course_id, c || '::' || t || ' revised' AS added, c || '::' || t AS removed FROM o WHERE k % 20 = 2")
def reword_greedy(spark, sf_dir):
    """Ratcliff-Obershelp or Jaccard, then greedy one-to-one; each reworded order finds its own old title."""
    pairs = diff.reword_pairs(*_reword_sides(spark, sf_dir))
    return diff.assign(pairs, Scratch(spark)).select("course_id", "added", "removed")


@query()
def reword_similarity(spark, sf_dir):
    """Similarity of each part's name with its brand and type added; SQL has no Ratcliff-Obershelp."""
    p = table(spark, sf_dir, "part")
    a, b = T.slug(F.col("p_name")), T.slug(F.concat_ws(" ", "p_name", "p_type"))
    return p.select("p_partkey", F.round(T.similarity(a, b), 6).alias("sim"))


# --- removals ---------------------------------------------------------------

REMOVALS = """WITH e AS (SELECT DISTINCT user_id AS key, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events {where}),
n AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM d), u AS (SELECT DISTINCT e.key FROM e JOIN n USING (day)),
g AS (SELECT u.key, n.day, n.n, CASE WHEN e.day IS NULL THEN 0 ELSE 1 END AS here FROM u CROSS JOIN n LEFT JOIN e ON e.key = u.key AND e.day = n.day),
h AS (SELECT *, lag(here, 1) OVER w AS h1, lag(here, 2) OVER w AS h2, lag(day, 1) OVER w AS d1 FROM g WINDOW w AS (PARTITION BY key ORDER BY n))
SELECT key, CAST(d1 AS VARCHAR) AS first_missing, CAST(day AS VARCHAR) AS confirmed_on FROM h WHERE here = 0 AND h1 = 0 AND h2 = 1"""


def _removals(spark, sf_dir, ok: Column):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    seen = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), "day")
    found = diff.removals(seen, e.select("day").distinct().filter(ok))
    return found.select("key", F.col("first_missing").cast("string").alias("first_missing"), F.col("confirmed_on").cast("string").alias("confirmed_on"))


@query(REMOVALS.format(where=""))
def removal_two_reads(spark, sf_dir):
    return _removals(spark, sf_dir, F.lit(True))


@query(REMOVALS.format(where="WHERE day(ts) % 7 <> 0"))
def removal_failed_reads(spark, sf_dir):
    """The reads of every seventh day of a month failed; they neither count nor reset."""
    return _removals(spark, sf_dir, F.dayofmonth("day") % 7 != 0)


# --- several sources ----------------------------------------------------------


def mentions(spark, sf_dir) -> DataFrame:
    """Each line of an order as a mention of it: its ship date, timed if it was returned, surer with more items."""
    x = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate").cast("string")
    timed = F.col("l_returnflag") == "R"
    start = F.when(timed, F.concat(day, F.lit("T23:59:00-04:00"))).otherwise(day)
    sure = F.when(F.col("l_quantity") > 25, 0.9).otherwise(0.85)
    empty = F.array().cast("array<string>")
    cols = {"start": start, "end": start, "all_day": ~timed, "date_text": day, "confidence": sure, "needs_review": F.lit(False), "review_reason": F.lit(""), "superseded": F.lit(None).cast("string"), "detail": F.lit(""), "sources": F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))), "assumptions": empty}
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", *[c.alias(n) for n, c in cols.items()])


ORDERED = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
MENTIONS = """m AS (SELECT *, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_returnflag = 'R' AS timed, CASE WHEN l_quantity > 25 THEN 0.9 ELSE 0.85 END AS sure,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem)"""


@query(f"""WITH {MENTIONS}, d AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey, day ORDER BY pos) AS pos) FROM m),
b AS (SELECT l_orderkey, day, timed, sure, row_number() OVER (PARTITION BY l_orderkey, day ORDER BY timed DESC, sure DESC, pos) AS best, count(*) OVER (PARTITION BY l_orderkey, day) AS n FROM d)
SELECT l_orderkey, day, CASE WHEN timed THEN day || 'T23:59:00-04:00' ELSE day END AS start, CAST(sure AS DOUBLE) AS confidence, CAST(n AS BIGINT) AS n FROM b WHERE best = 1""")
def merge_sources_sameday(spark, sf_dir):
    """Mentions of one day: the first of the timed ones, else of the surest, is what stays."""
    m = mentions(spark, sf_dir).withColumn("day", F.col("date_text"))
    return resolve.fold(m, ["l_orderkey", "day"], ORDERED).select("l_orderkey", "day", F.col("event.start").alias("start"), F.col("event.confidence").alias("confidence"), F.col("n_mentions").alias("n"))


@query(f"""WITH RECURSIVE {MENTIONS}, r AS (SELECT l_orderkey, pos, day, timed, sure, false AS review FROM m WHERE pos = 1
UNION ALL SELECT r.l_orderkey, m.pos,
  CASE WHEN r.review OR (r.day = m.day AND ((m.timed AND NOT r.timed) OR (m.timed = r.timed AND m.sure > r.sure))) THEN m.day ELSE r.day END,
  CASE WHEN r.review OR (r.day = m.day AND ((m.timed AND NOT r.timed) OR (m.timed = r.timed AND m.sure > r.sure))) THEN m.timed ELSE r.timed END,
  CASE WHEN r.review OR (r.day = m.day AND ((m.timed AND NOT r.timed) OR (m.timed = r.timed AND m.sure > r.sure))) THEN m.sure ELSE r.sure END,
  NOT r.review AND r.day <> m.day FROM r JOIN m ON m.l_orderkey = r.l_orderkey AND m.pos = r.pos + 1)
SELECT r.l_orderkey, r.day, r.review AS needs_review FROM r JOIN (SELECT l_orderkey, max(pos) AS pos FROM m GROUP BY 1) USING (l_orderkey, pos)""")
def merge_disagree_review(spark, sf_dir):
    """The fold over all mentions of an order: a disagreement makes it one to review, a later clean mention settles it."""
    found = resolve.fold(mentions(spark, sf_dir), ["l_orderkey"], ORDERED)
    return found.select("l_orderkey", F.substring("event.start", 1, 10).alias("day"), F.col("event.needs_review").alias("needs_review"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, 's' || l_suppkey AS src FROM lineitem),
f AS (SELECT l_orderkey, src, min(pos) AS pos FROM s GROUP BY ALL) SELECT l_orderkey, string_agg(src, ',' ORDER BY pos) AS sources FROM f GROUP BY 1""")
def sources_union_distinct(spark, sf_dir):
    found = resolve.fold(mentions(spark, sf_dir), ["l_orderkey"], ORDERED)
    return found.select("l_orderkey", F.array_join("event.sources", ",").alias("sources"))


READINGS = """r AS (SELECT o_custkey AS course_id, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS read_at, o_orderstatus <> 'F' AS ok, o_orderpriority[1] = '5' AS part FROM orders),
g AS (SELECT course_id, bool_or(ok AND NOT part) AS f, bool_or(ok AND part) AS p, min(ord) FILTER (NOT ok AND NOT part) AS failed, max(read_at) FILTER (ok) AS last_ok FROM r GROUP BY 1)"""


@query(f"""WITH {READINGS} SELECT r.course_id, r.ord AS reading_ord, CASE WHEN f OR p THEN 'ok' WHEN failed IS NOT NULL THEN 'unreadable' ELSE 'not_read' END AS merged_status, (NOT f AND p) AS merged_partial,
CAST(last_ok AS VARCHAR) AS merged_read_at, coalesce(CASE WHEN f OR p THEN ok ELSE ord = failed END, false) AS used FROM r JOIN g USING (course_id)""")
def merge_readings_course(spark, sf_dir):
    """Orders as readings of a customer: F failed, priority 5 partial."""
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("reading_ord"), F.to_date("o_orderdate").cast("string").alias("read_at"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), F.col("o_orderpriority").startswith("5").alias("is_partial"))
    return resolve.merge_readings(r).select("course_id", "reading_ord", "merged_status", "merged_partial", "merged_read_at", "used")


# --- text ---------------------------------------------------------------------

SLUG = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT p_partkey, {SLUG.format('p_name')} AS slug FROM part")
def slug_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(T.clean_ascii(F.col("p_name"))).alias("slug"))


@query(f"SELECT item_id, 'bench::' || {SLUG.format('text')} AS key FROM benchmark")
def item_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.item_key(F.lit("bench"), T.clean_ascii(F.col("text"))).alias("key"))


@query()
def clean_text_docs(spark, sf_dir):
    """NFKC, folded dashes and quotes, over whole documents; SQL has no NFKC."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


PHRASES = ("Quiz on {0}", "Essay draft", "Read chapter 3", "Homework TBD", "Lab before class", "Talk on Wednesday")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS dated FROM orders""")
def date_hint_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.element_at(F.array(F.concat(F.lit("Quiz on "), F.date_format("o_orderdate", "MMM d")), *map(F.lit, PHRASES[1:])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", T.has_date_hint(text).alias("dated"))


TITLES = ("Midterm exam", "Final paper", "Final", "Lecture notes", "Lab session 2", "Reading")
TITLE_SQL = "list_value('Midterm exam', 'Final paper', 'Final', 'Lecture notes', 'Lab session 2', 'Reading')[CAST(p_partkey % 6 AS INT) + 1]"


@query(f"""WITH t AS (SELECT p_partkey, {TITLE_SQL} AS t FROM part), e AS (SELECT *, regexp_matches(t, '(?i)\\b(exam|midterm|quiz|test)\\b') OR (regexp_matches(t, '(?i)^final\\b')
AND NOT regexp_matches(t, '(?i)^final\\b.*\\b(project|paper|essay|portfolio|presentation|report|draft)\\b')) AS exam FROM t)
SELECT p_partkey, CASE WHEN exam THEN 'exam' WHEN regexp_matches(t, '(?i)\\b(lecture|class meeting|class session|lab session|recitation|seminar meeting)\\b') THEN 'class' ELSE 'assignment' END AS page,
CASE WHEN exam THEN 'exam' WHEN regexp_matches(t, '(?i)\\b(lecture|class|lab|recitation|seminar|office hours)\\b') THEN 'class' ELSE 'assignment' END AS feed,
CASE WHEN regexp_matches(t, '(?i)\\b(exam|midterm|quiz|test|final)\\b') THEN 'exam' ELSE 'announcement' END AS mail FROM e""")
def kind_classifier(spark, sf_dir):
    t = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.kind_on_page(t, F.lit("assignments")).alias("page"), T.kind_in_feed(t).alias("feed"), T.kind_in_mail(t).alias("mail"))


@query("""WITH m AS (SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM conversations),
c AS (SELECT conv_id, turn, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM m)
SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM c WHERE s <> '' GROUP BY ALL""")
def sentences(spark, sf_dir):
    all_ = F.filter(F.transform(F.split("text", mail.SENTENCES), T.clean_ascii), lambda s: s != "")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(all_).alias("s"))
    return c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS n FROM conversations) SELECT conv_id, role, turn, text FROM c WHERE n = 1""")
def first_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", "role").agg(F.min(F.struct("turn", "text")).alias("f")).select("conv_id", "role", "f.turn", "f.text")


@query("""WITH x AS (SELECT n_nationkey, lower(n_name) AS n, string_split(lower(n_name), ' ') AS w FROM nation), p AS (SELECT p_partkey, lower(p_name) AS t FROM part)
SELECT p_partkey, n_nationkey, 1.0::DOUBLE AS score FROM p JOIN x ON contains(t, n)
UNION ALL SELECT p_partkey, -1, CASE WHEN contains(t, string_split(t, ' ')[1]) THEN 1.0 ELSE 0.0 END::DOUBLE FROM p""")
def mention_score(spark, sf_dir):
    """Nations named in part names (every part against the 25 nations, a query set), and each part's first word in its name."""
    p = table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("t"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", T.slug(F.col("n_name")).alias("n"))
    named = p.join(F.broadcast(n), F.contains("t", "n")).select("p_partkey", "n_nationkey", T.mention_score(F.col("n"), F.col("t")).alias("score"))
    own = p.select("p_partkey", F.lit(-1).alias("n_nationkey"), T.mention_score(F.split("t", " ")[0], F.col("t")).alias("score"))
    return named.union(own)


@query("""WITH m AS (SELECT o_orderkey AS mention_id, o_custkey % 40 AS c, CAST(o_totalprice AS BIGINT) % 7 AS a FROM orders), t AS (SELECT c, x FROM (SELECT DISTINCT o_custkey % 40 AS c FROM orders) CROSS JOIN range(0, 5) r(x)),
s AS (SELECT mention_id, m.c, x, CASE WHEN x = a THEN 1.0 WHEN x = a - 2 OR (a = 5 AND x <= 1) THEN 0.8 ELSE 0.0 END AS score FROM m JOIN t ON m.c = t.c),
b AS (SELECT mention_id, c, max(score) AS top FROM s GROUP BY ALL)
SELECT 'c' || b.c AS course_id, b.mention_id, CAST(top AS DOUBLE) AS score, min('t' || x) AS title, CAST(count(*) AS BIGINT) AS n_best FROM b JOIN s ON s.mention_id = b.mention_id AND s.score = b.top WHERE top >= 0.55 GROUP BY ALL""")
def title_match_ties(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    course = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("course_id")
    m = o.select(course, F.col("o_orderkey").alias("mention_id"), (F.col("o_totalprice").cast("decimal(18,2)").cast("double")).alias("_p"), F.round("o_totalprice").cast("long").alias("_r"))
    m = m.withColumn("a", F.bround("_p").cast("long") % 7)
    t = o.select(course).distinct().withColumn("x", F.explode(F.array(*map(F.lit, range(5))))).withColumn("title", F.concat(F.lit("t"), F.col("x").cast("string")))
    score = F.when(F.col("x") == F.col("a"), 1.0).when((F.col("x") == F.col("a") - 2) | ((F.col("a") == 5) & (F.col("x") <= 1)), 0.8).otherwise(0.0)
    return resolve.match_titles(m, t, score).select("course_id", "mention_id", "score", "title", "n_best")


@query("SELECT page_id, rtrim(regexp_replace(u, '([?&])(sid|session|token|_t)=[^&]*', '\\1', 'g'), '?&') AS url FROM (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'sid=' || page_id AS u FROM pages)")
def url_clean(spark, sf_dir):
    u = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("sid="), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.clean_url(u).alias("url"))


# --- dates ------------------------------------------------------------------------

DAY = "CAST(o_orderdate AS DATE)"


def dated(spark, sf_dir, text: Column, posted: Column | None = None) -> DataFrame:
    """Orders with a phrase made of their date, read on the day before, and the phrase parsed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    o = o.withColumns({"phrase": text, "seen": F.date_sub("d", 1), "tz": F.lit(NY)})
    if posted is not None:
        o = o.withColumn("posted", posted)
    return date_text.parse(o, "phrase", "seen", "tz", "posted" if posted is not None else None)


def _start(df: DataFrame, *more) -> DataFrame:
    return df.select("o_orderkey", F.col("parsed.start").alias("start"), *more)


SAME_DAY = f"SELECT o_orderkey, CAST({DAY} AS VARCHAR) AS start, {{0}}::DOUBLE AS confidence FROM orders"
SURE = "parsed.confidence"


@query(SAME_DAY.format("0.85"))
def date_parse_md(spark, sf_dir):
    return _start(dated(spark, sf_dir, F.concat(F.lit("due "), F.date_format("d", "MMMM d"))), SURE)


@query(SAME_DAY.format("0.9"))
def date_parse_iso(spark, sf_dir):
    return _start(dated(spark, sf_dir, F.concat(F.lit("due "), F.date_format("d", "yyyy-MM-dd"))), SURE)


@query(SAME_DAY.format("0.9"))
def date_parse_numeric(spark, sf_dir):
    return _start(dated(spark, sf_dir, F.date_format("d", "M/d/yyyy")), SURE)


@query(SAME_DAY.format("0.9"))
def date_parse_dm(spark, sf_dir):
    return _start(dated(spark, sf_dir, F.concat(F.date_format("d", "d"), F.lit(" of "), F.date_format("d", "MMMM yyyy"))), SURE)


YEARS = """c AS (SELECT o_orderkey, o_shift, ref, y, try_cast(y || '-' || lpad(CAST(month(d) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(d) AS VARCHAR), 2, '0') AS DATE) AS x
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 500 - 250 AS o_shift, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 - 250 AS INT) AS ref FROM orders), unnest([year(ref) - 1, year(ref), year(ref) + 1]) AS u(y))"""


@query(f"WITH {YEARS} SELECT o_orderkey, CAST(coalesce(min(x) FILTER (x >= ref - 60), max(x)) AS VARCHAR) AS day FROM c GROUP BY 1")
def date_year_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    ref = F.date_add("d", (F.col("o_orderkey") % 500 - 250).cast("int"))
    return o.select("o_orderkey", D.infer_year(F.month("d"), F.dayofmonth("d"), ref).cast("string").alias("day"))


@query(f"SELECT o_orderkey, CAST({DAY} AS VARCHAR) AS start, CAST(CASE WHEN day({DAY}) <= 26 THEN {DAY} + 2 ELSE {DAY} END AS VARCHAR) AS \"end\" FROM orders")
def date_range_tail(spark, sf_dir):
    tail = F.when(F.dayofmonth("d") <= 26, F.concat(F.lit(" to "), (F.dayofmonth("d") + 2).cast("string"))).otherwise("")
    return _start(dated(spark, sf_dir, F.concat(F.date_format("d", "MMM d"), tail)), F.col("parsed.end").alias("end"))


@query(f"SELECT o_orderkey, CAST({DAY} + 3 AS VARCHAR) AS start, CAST({DAY} AS VARCHAR) AS superseded, 0.75::DOUBLE AS confidence FROM orders")
def date_inline_change(spark, sf_dir):
    phrase = F.concat(F.lit("moved from "), F.date_format("d", "MMM d"), F.lit(" to "), F.date_format(F.date_add("d", 3), "MMM d"))
    return _start(dated(spark, sf_dir, phrase), F.col("parsed.superseded").alias("superseded"), SURE)


@query(f"SELECT o_orderkey, CAST({DAY} + CAST(CASE WHEN (4 - (isodow({DAY}) - 1) + 7) % 7 = 0 THEN 7 ELSE (4 - (isodow({DAY}) - 1) + 7) % 7 END AS INT) AS VARCHAR) AS start, CAST({DAY} + 1 AS VARCHAR) AS tomorrow FROM orders")
def date_weekday_relative(spark, sf_dir):
    found = dated(spark, sf_dir, F.lit("due Friday"), F.col("d"))
    again = date_text.parse(found.withColumn("friday", F.col("parsed.start")).drop("parsed").withColumn("phrase", F.lit("tomorrow")), "phrase", "seen", "tz", "posted")
    return again.select("o_orderkey", F.col("friday").alias("start"), F.col("parsed.start").alias("tomorrow"))


@query(f"SELECT o_orderkey, isodow({DAY}) <> 1 AS needs_review, CASE WHEN isodow({DAY}) <> 1 THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence FROM orders")
def date_weekday_conflict(spark, sf_dir):
    return dated(spark, sf_dir, F.concat(F.lit("Monday "), F.date_format("d", "MMM d"))).select("o_orderkey", F.col("parsed.needs_review").alias("needs_review"), SURE)


VAGUE = ("TBD", "week of Oct 5", "end of the semester", "finals week", "midterm week", "every Tuesday", "before class", "soon")
REASONS = ("date is TBD/TBA", "'week of' names a week, not a day", "vague period, not a date", "'finals week' without a date", "'midterm week' without a date", "recurring schedule; one-off events only", "relative to a class meeting, no date given", "no date found")
REASON_SQL = ", ".join("'" + r.replace("'", "''") + "'" for r in REASONS)


@query(f"SELECT o_orderkey, list_value({REASON_SQL})[CAST(o_orderkey % 8 AS INT) + 1] AS reason FROM orders")
def date_review_phrases(spark, sf_dir):
    phrase = F.element_at(F.array(*map(F.lit, VAGUE)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return dated(spark, sf_dir, phrase).filter("parsed.needs_review").select("o_orderkey", F.col("parsed.reason").alias("reason"))


@query(f"""SELECT o_orderkey, CAST(epoch(timezone('{NY}', {DAY} + INTERVAL '23:59' HOUR TO MINUTE)) AS BIGINT) AS local_s,
CAST(epoch(timezone('{PT}', {DAY} + INTERVAL '23:59' HOUR TO MINUTE)) AS BIGINT) AS pacific_s FROM orders""".replace("INTERVAL '23:59' HOUR TO MINUTE", "INTERVAL 1439 MINUTE"))
def date_time_tz(spark, sf_dir):
    """11:59 PM in the course's zone and in a stated one, as instants."""
    day = F.date_format("d", "MMM d, yyyy")
    one = dated(spark, sf_dir, F.concat(day, F.lit(" at 11:59 PM"))).select("o_orderkey", F.unix_timestamp(F.to_timestamp("parsed.start")).alias("local_s"))
    two = dated(spark, sf_dir, F.concat(day, F.lit(" 11:59 pm PT"))).select("o_orderkey", F.unix_timestamp(F.to_timestamp("parsed.start")).alias("pacific_s"))
    return one.join(two, "o_orderkey")


FLAGS = {"explicit_year": 2, "weekday": 3, "changed": 5, "several": 7, "timed": 11, "zoned": 13}


@query("""SELECT o_orderkey, CAST(round(least(0.98, 0.85 + CASE WHEN o_orderkey % 2 = 0 THEN 0.05 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.05 ELSE 0 END - CASE WHEN o_orderkey % 5 = 0 THEN 0.1 ELSE 0 END
- CASE WHEN o_orderkey % 7 = 0 THEN 0.1 ELSE 0 END + CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 0.1 ELSE 0.05 END ELSE 0 END), 2) AS DOUBLE) AS confidence FROM orders""")
def date_confidence(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.confidence(**{k: F.col("o_orderkey") % m == 0 for k, m in FLAGS.items()}).alias("confidence"))


@query(f"SELECT event_id, strftime(timezone('{NY}', ts AT TIME ZONE 'UTC'), '%Y-%m-%dT%H:%M:%S') || '-05:00' AS start FROM events")
def exact_ts_to_course_tz(spark, sf_dir):
    """All events are in January, when New York is five hours behind."""
    return table(spark, sf_dir, "events").select("event_id", D.iso_local(F.col("ts").cast("timestamp"), F.lit(NY)).alias("start"))


@query(f"SELECT o_orderkey, CAST({DAY} + 1 AS VARCHAR) AS exclusive, CAST({DAY} AS VARCHAR) AS inclusive FROM orders")
def exclusive_end(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    after = D.exclusive_end(F.col("d"))
    return o.select("o_orderkey", after.cast("string").alias("exclusive"), D.inclusive_end(F.col("d"), after).cast("string").alias("inclusive"))


# --- plan, gate, commit -------------------------------------------------------------

CHANGED = f"""{NIGHTS}, x AS (SELECT course_id, key, key AS before_key, CASE type WHEN 'missing' THEN 'removed' ELSE type END AS type, coalesce(after_start, before_start) AS start FROM ch
WHERE type <> 'same' AND NOT (type IN ('added', 'missing') AND k % 20 = 2)
UNION ALL SELECT c, c || '::' || t || ' revised', c || '::' || t, 'reworded', CAST(d AS VARCHAR) FROM o WHERE k % 20 = 2),
led AS (SELECT c || '::' || t AS key, 'evt-' || k AS event_id FROM o WHERE k % 2 = 0),
ops AS (SELECT x.course_id, x.key, x.type, x.start, CASE WHEN type = 'removed' THEN 'delete' WHEN coalesce(a.event_id, b.event_id) IS NOT NULL THEN 'update' ELSE 'create' END AS op,
CASE WHEN type = 'removed' THEN a.event_id ELSE coalesce(a.event_id, b.event_id) END AS event_id, CASE WHEN type = 'reworded' THEN before_key END AS replaces_key
FROM x LEFT JOIN led a ON a.key = x.key LEFT JOIN led b ON b.key = x.before_key WHERE type <> 'removed' OR a.event_id IS NOT NULL)"""


def told(spark, sf_dir) -> DataFrame:
    """Tonight's items labelled, rewordings told apart: before, after, and the key that a new wording had. One outer join, written once, labels all."""
    scratch = Scratch(spark)
    on = ["course_id", "key"]
    rows, _ = scratch.write(diff.changes(*nights(spark, sf_dir)), "labelled")
    side = lambda name, kind: rows.filter(F.col("type") == kind).select(*on, f"{name}.*")
    paired, _ = scratch.write(diff.assign(diff.reword_pairs(side("before", "missing"), side("after", "added")), scratch), "reworded")
    gone = paired.select("course_id", F.col("removed").alias("key"), F.lit(True).alias("_gone"))
    new = paired.select("course_id", F.col("added").alias("key"), F.col("removed").alias("_old"))
    kind = F.when(F.col("_gone"), "replaced").when(F.col("_old").isNotNull(), "reworded").when(F.col("type") == "missing", "removed").otherwise(F.col("type"))
    return rows.join(gone, on, "left").join(new, on, "left").select(*on, F.coalesce("_old", "key").alias("before_key"), kind.alias("type"), "before", "after", F.lit(False).alias("is_partial"))


def changed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tonight's changes, and a ledger that has the even orders."""
    changes = told(spark, sf_dir).filter("type <> 'replaced'").select("course_id", "key", "before_key", "type", F.coalesce("after.start", "before.start").alias("start"))
    o = observed(spark, sf_dir).filter("k % 2 = 0")
    ledger_ = o.select(F.concat_ws("::", "course_id", _title()).alias("key"), F.concat(F.lit("evt-"), F.col("k").cast("string")).alias("event_id"))
    return changes, ledger_


def planned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The plan of tonight's changes, written once, and the ledger it was made with."""
    changes, known = changed(spark, sf_dir)
    return Scratch(spark).write(ledger.build_plan(changes, known), "ops")[0], known


@query(f"WITH {CHANGED} SELECT course_id, key, type, op, event_id, replaces_key FROM ops")
def plan_ops(spark, sf_dir):
    return ledger.build_plan(*changed(spark, sf_dir)).select("course_id", "key", "type", "op", "event_id", "replaces_key")


GATE_SQL = """CASE WHEN course_id = 'c7' THEN 'course unreadable' WHEN op IN ('update', 'delete') AND event_id IS NULL THEN 'no event id'
WHEN op = 'delete' AND n_del > 2 AND 2 * n_del >= greatest(n_belief, 1) THEN 'mass deletion' WHEN op = 'delete' THEN ''
WHEN CAST(start AS DATE) < DATE '1998-01-01' - 120 THEN 'too far past' WHEN CAST(start AS DATE) > DATE '1998-01-01' + 400 THEN 'too far ahead' ELSE '' END"""


def _gated(spark, sf_dir):
    ops, _ = planned(spark, sf_dir)
    prev, _ = nights(spark, sf_dir)
    n = prev.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_belief"))
    ops = ops.join(n, "course_id", "left").withColumns({"course_state": F.when(F.col("course_id") == "c7", "unreadable"), "has_change": F.lit(True), "needs_review": F.lit(False), "confidence": F.lit(0.9), "confirmed": F.lit(True), "start_day": F.to_date("start")})
    return ledger.gate(ops, F.lit("1998-01-01").cast("date"))


@query(f"""WITH {CHANGED}, n AS (SELECT course_id, count(*) AS n_belief FROM prev GROUP BY 1), g AS (SELECT ops.*, n_belief, count(*) FILTER (op = 'delete') OVER (PARTITION BY course_id) AS n_del FROM ops LEFT JOIN n USING (course_id))
SELECT key, op, {GATE_SQL} AS block_reason FROM g""")
def gate_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).select("key", "op", "block_reason")


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus = 'F' AS del FROM orders), n AS (SELECT *, count(*) FILTER (del) OVER (PARTITION BY c) AS d, count(*) OVER (PARTITION BY c) AS b FROM o)
SELECT k, CASE WHEN del AND d > 2 AND 2 * d >= b THEN 'mass deletion' ELSE '' END AS block_reason FROM n""")
def gate_mass_delete(spark, sf_dir):
    """A customer's orders as a course's events, those of status F up for deletion."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("update").alias("op"))
    n = o.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_belief"))
    true = F.lit(True)
    rows = o.join(n, "course_id").withColumns({"course_state": F.lit("ok"), "has_change": true, "needs_review": ~true, "confidence": F.lit(0.9), "event_id": F.lit("e"), "confirmed": true, "start_day": F.lit("1998-01-01").cast("date")})
    return ledger.gate(rows, F.lit("1998-01-01").cast("date")).select("k", "block_reason")


RESULTS = "res AS (SELECT key, op, CASE WHEN length(key) % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, coalesce(event_id, 'new-' || key) AS event_id FROM ops)"


def _results(ops: DataFrame) -> DataFrame:
    return ops.select("key", "op", F.when(F.length("key") % 9 == 0, "failed").otherwise("ok").alias("status"), F.coalesce("event_id", F.concat(F.lit("new-"), F.col("key"))).alias("event_id"))


@query(f"""WITH {CHANGED}, {RESULTS}, done AS (SELECT ops.key, ops.op, replaces_key, res.event_id FROM ops JOIN res ON res.key = ops.key AND res.op = ops.op WHERE status = 'ok'),
gone AS (SELECT key FROM done WHERE op = 'delete' UNION SELECT replaces_key FROM done WHERE replaces_key IS NOT NULL), kept AS (SELECT * FROM led ANTI JOIN gone USING (key))
SELECT coalesce(d.key, k.key) AS key, coalesce(d.event_id, k.event_id) AS event_id FROM kept k FULL JOIN (SELECT * FROM done WHERE op <> 'delete') d ON d.key = k.key""")
def commit_ledger(spark, sf_dir):
    ops, old = planned(spark, sf_dir)
    none = F.lit(None).cast("string")
    delta = ledger.ledger_delta(ops.withColumns({"summary": none, "end": none}), _results(ops), none)
    return merged(old.withColumns({c: none for c in ("summary", "start", "end", "written_at")}), delta, ["key"]).select("key", "event_id")


@query(f"""WITH {CHANGED}, {RESULTS}, bad AS (SELECT ops.* FROM ops JOIN res ON res.key = ops.key AND res.op = ops.op WHERE status <> 'ok'), held AS (SELECT key FROM bad UNION SELECT replaces_key FROM bad WHERE replaces_key IS NOT NULL)
SELECT key, title, CAST(start AS VARCHAR) AS start FROM cur WHERE key NOT IN (SELECT key FROM held) UNION ALL SELECT key, title, CAST(start AS VARCHAR) FROM prev WHERE key IN (SELECT key FROM held)""")
def commit_belief(spark, sf_dir):
    """Operations whose key has a length divisible by 9 failed; their items, and those they replace, stay as they were."""
    ops = planned(spark, sf_dir)[0].withColumn("block_reason", F.lit(""))
    prev, _ = nights(spark, sf_dir)
    scratch = Scratch(spark)
    held, _ = scratch.write(ledger.held_keys(ops, _results(ops)), "held")
    delta, _ = scratch.write(ledger.unheld(ledger.belief_delta(told(spark, sf_dir)), held), "delta")
    return merged(prev, delta, KEYS["belief"]).select("key", "title", "start")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id FROM e WHERE n = 1""")
def partial_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.lit("run").alias("run_id"), F.col("user_id").alias("key"), F.col("event_type").alias("op"), F.struct("ts", "event_id").alias("seq"), "event_id")
    return ledger.last_results(r).select(F.col("key").alias("user_id"), F.col("op").alias("event_type"), "event_id")


@query("""WITH b AS (SELECT o_orderkey AS key, o_orderstatus AS t, o_orderkey % 3 = 0 AS resolved FROM orders WHERE o_orderkey % 4 <> 0), s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS t FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(b.key, s.key) AS key, coalesce(s.t, b.t) AS date_text, CASE WHEN b.key IS NULL THEN '2024-01-02' ELSE '2024-01-01' END AS first_seen, CASE WHEN s.key IS NULL THEN '2024-01-01' ELSE '2024-01-02' END AS last_seen,
coalesce(b.resolved AND NOT (s.key IS NOT NULL AND s.t <> b.t), false) AS resolved, CASE WHEN b.resolved AND s.t <> b.t THEN '2024-01-02' END AS reopened_at FROM b FULL JOIN s ON b.key = s.key""")
def review_bucket_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("t"))
    none = F.lit(None).cast("string")
    bucket = o.filter("key % 4 <> 0").select("key", F.col("t").alias("date_text"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-01").alias("last_seen"), (F.col("key") % 3 == 0).alias("resolved"), none.alias("reopened_at"))
    seen = o.filter("key % 7 <> 0").select("key", F.when(F.col("key") % 5 == 0, "X").otherwise(F.col("t")).alias("date_text"))
    return ledger.merge_review(bucket, seen, F.lit("2024-01-02"))


@query("""WITH k AS (SELECT DISTINCT event_type AS kind, user_id AS key FROM events WHERE ts < TIMESTAMP '2024-01-10'), r AS (SELECT event_type AS kind, user_id AS key, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT r.kind, r.key, event_id FROM r ANTI JOIN k ON k.kind = r.kind AND k.key = r.key WHERE n = 1""")
def track_insert_if_absent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key"), "event_id", "ts")
    split = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz").cast(dict(e.dtypes)["ts"])
    return ledger.insert_if_absent(e.filter(split), e.filter(~split), ["ts", "event_id"]).select("kind", "key", "event_id")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Exam: ' WHEN 1 THEN '' ELSE 'Due: ' END || 'Order ' || o_orderkey || ' (' || o_orderpriority || ')' AS summary, CASE o_orderkey % 3 WHEN 1 THEN '7' ELSE '11' END AS color FROM orders")
def op_summary(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("exam"), F.lit("class"), F.lit("assignment")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.summary(kind, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")).alias("summary"), ledger.color(kind).alias("color"))


@query("""SELECT s_suppkey, 'Course: c' || s_nationkey || chr(10) || 'Kind: exam' || chr(10) || 'As written: "due ' || s_suppkey || '"' || chr(10) || 'Source: ' || s_name || ' (read 2024-01-01)' || chr(10) || 'Source: mail (read 2024-01-01)' || chr(10)
|| CASE WHEN s_suppkey % 2 = 0 THEN 'Assumptions: balance; year' || chr(10) ELSE '' END || 'Confidence: 0.85' || chr(10) || CASE WHEN s_suppkey % 3 = 0 THEN 'Notes: bring paper' || chr(10) ELSE '' END || 'key: ' || s_suppkey AS description FROM supplier""")
def op_description(spark, sf_dir):
    """What a calendar event says of itself; every second supplier has assumptions, every third a note."""
    k = F.col("s_suppkey")
    event = F.struct(
        F.lit("exam").alias("kind"), F.concat(F.lit("due "), k.cast("string")).alias("date_text"), F.array(F.col("s_name"), F.lit("mail")).alias("sources"), F.lit("2024-01-01").alias("read_at"),
        F.when(k % 2 == 0, F.array(F.lit("balance"), F.lit("year"))).otherwise(F.array().cast("array<string>")).alias("assumptions"), F.lit(0.85).alias("confidence"), F.when(k % 3 == 0, "bring paper").otherwise("").alias("detail"),
    )
    course = F.concat(F.lit("c"), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", ledger.description(event, course, k.cast("string")).alias("description"))


@query("""WITH o AS (SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n, o_orderstatus AS s FROM orders) SELECT k AS key, CASE s WHEN 'O' THEN 'create' WHEN 'F' THEN 'update' ELSE 'delete' END AS op,
CASE WHEN s = 'O' THEN 'evt-' || (1000 + n - 1) ELSE 'evt-' || (k % 100) END AS event_id, CASE WHEN s = 'O' OR k % 100 < 50 THEN 'ok' ELSE 'failed' END AS status FROM o""")
def calendar_apply(spark, sf_dir):
    """A calendar that knows events 0 to 49 answers creations with ids from 1000 on."""
    o = table(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderstatus") == "O", "create").when(F.col("o_orderstatus") == "F", "update").otherwise("delete")
    ops = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("op_ord"), op.alias("op"), F.concat(F.lit("evt-"), (F.col("o_orderkey") % 100).cast("string")).alias("event_id"))
    return ledger.create_events(ops, spark.range(50).select(F.concat(F.lit("evt-"), F.col("id").cast("string")).alias("event_id")), 1000)


# --- whole nights ------------------------------------------------------------------


def night_readings(spark, sf_dir, tonight: int) -> tuple[DataFrame, DataFrame]:
    """Readings of 40 courses and their items: the orders, with exact days, as both nights() show them.

    Tonight (1, and again a day later, 2) c7's read fails, c8 isn't read, c9's
    page is empty of items; c10 is only told of by mail, of its moved and new
    orders.
    """
    prev, cur = nights(spark, sf_dir)
    at = F.lit(f"2024-05-0{tonight + 1}T23:00:00-04:00")
    course = prev.select("course_id").distinct()
    later = F.lit(tonight > 0)
    mail = later & (F.col("course_id") == "c10")
    readings = course.filter(~later | (F.col("course_id") != "c8")).select(
        "course_id", F.lit(1).alias("ord"), F.lit("u").alias("source_url"), at.alias("read_at"), F.when(later & (F.col("course_id") == "c7"), "error").otherwise("ok").alias("status"),
        F.lit("down").alias("error"), F.lit(NY).alias("timezone"), mail.alias("partial"),
    )
    shown = (cur if tonight else prev).select("course_id", F.lit(1).alias("ord"), F.xxhash64("key").alias("pos"), "title", F.col("start").alias("date_text"), F.lit("assignment").alias("kind"), F.lit("").alias("url"), F.lit(None).cast("string").alias("posted_at"), F.lit("").alias("detail"), "start", F.lit(None).cast("string").alias("end"), F.lit(True).alias("all_day"), F.lit(None).cast("string").alias("review_reason"))
    if tonight:
        shown = shown.filter("course_id not in ('c7', 'c8', 'c9')")
    none = F.lit(None).cast("string")
    return readings, shown.withColumns({"read_at": none, "timezone": none, "source_url": none})


_FIRST: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _first_night(spark, sf_dir):
    """Belief and operations of the first night, written once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _FIRST:
        scratch = Scratch(spark)
        readings, items = night_readings(spark, sf_dir, 0)
        empty = lambda schema: spark.createDataFrame([], schema)
        none = empty(resolve.BELIEF)
        run = nightly.plan(readings, items, _names(readings), none, empty(nightly.MISSING), empty(nightly.LEDGER), today(), scratch)
        _FIRST[at] = scratch.write(run.belief(none), "belief")[0], scratch.write(run.ops, "first-ops")[0]
    return _FIRST[at]


def _names(readings: DataFrame) -> DataFrame:
    return readings.select("course_id", F.col("course_id").alias("name")).distinct()


NIGHT = f"""{NIGHTS}, nx AS (SELECT course_id, key, k, type, before_start, after_start FROM ch WHERE type <> 'same' AND course_id NOT IN ('c7', 'c8', 'c9') AND NOT (course_id = 'c10' AND type = 'missing')
  AND NOT (course_id <> 'c10' AND k % 20 = 2)),
night AS (SELECT course_id, key, CASE type WHEN 'missing' THEN 'pending_removal' ELSE type END AS type,
  CASE type WHEN 'moved' THEN before_start || ' -> ' || after_start || CASE WHEN course_id = 'c10' THEN ' (from a partial source)' ELSE '' END
  WHEN 'added' THEN after_start || CASE WHEN course_id = 'c10' THEN ' (from a partial source)' ELSE '' END ELSE 'missing since 2024-05-02 (1/2); removed if still absent on a later day' END AS note FROM nx
UNION ALL SELECT c, c || '::' || t || ' revised', 'reworded', chr(39) || t || chr(39) || ' -> ' || chr(39) || t || ' revised' || chr(39) || ' (similarity ' || printf('%.2f', greatest(2 / 3, 2 * length(t) / (2 * length(t) + 8))) || ')' FROM o WHERE k % 20 = 2 AND c NOT IN ('c7', 'c8', 'c9', 'c10'))"""


def today() -> Column:
    return F.lit("1998-01-01").cast("date")


def _known(ops: DataFrame) -> DataFrame:
    return ops.select("key", F.concat(F.lit("evt-"), F.col("key")).alias("event_id"), "summary", "start", "end", F.lit("t").alias("written_at"))


def _second_night(spark, sf_dir):
    belief, first_ops = _first_night(spark, sf_dir)
    readings, items = night_readings(spark, sf_dir, 1)
    none = spark.createDataFrame([], nightly.MISSING)
    return nightly.plan(readings, items, _names(belief), belief, none, _known(first_ops), today(), Scratch(spark)), belief


@query(f"""WITH {NIGHTS} SELECT course_id, key, 'removed' AS type, 'absent on 2 successful reads (2024-05-02 .. 2024-05-03); confirmed' AS note, 'delete' AS op, 'evt-' || key AS event_id, '' AS block_reason
FROM ch WHERE type = 'missing' AND k % 20 = 0 AND course_id NOT IN ('c7', 'c8', 'c9', 'c10')""")
def night_removals(spark, sf_dir):
    """A third night that shows what the second one did: what was missing once is removed, nothing else changes."""
    second, believed = _second_night(spark, sf_dir)
    scratch = Scratch(spark)
    belief, _ = scratch.write(second.belief(believed), "belief")
    missing, _ = scratch.write(second.missing(spark.createDataFrame([], nightly.MISSING)), "missing")
    readings, items = night_readings(spark, sf_dir, 2)
    third = nightly.plan(readings, items, _names(belief), belief, missing, _known(_first_night(spark, sf_dir)[1]), today(), scratch)
    return third.changes.select("course_id", "key", "type", "note").join(third.ops.select("key", "op", "event_id", "block_reason"), "key", "left")


@query(f"WITH {NIGHT} SELECT course_id, key, type, note FROM night")
def night_changes(spark, sf_dir):
    """Two nights of readings, resolved and diffed: what changed and what is missing once."""
    run, _ = _second_night(spark, sf_dir)
    return run.changes.unionByName(run.pending).select("course_id", "key", "type", "note")


@query(f"""WITH {NIGHT}, p AS (SELECT course_id, key, type, CASE type WHEN 'added' THEN 'create' ELSE 'update' END AS op, CASE type WHEN 'reworded' THEN left(key, length(key) - 8) WHEN 'moved' THEN key END AS own FROM night WHERE type <> 'pending_removal'),
s AS (SELECT p.*, c.start FROM p JOIN cur c USING (course_id, key))
SELECT key, op, CASE WHEN own IS NOT NULL THEN 'evt-' || own END AS event_id, CAST(start AS VARCHAR) AS start, CAST(start + 1 AS VARCHAR) AS "end", 'Due: ' || regexp_replace(key, '^[^:]*::', '') || ' (' || course_id || ')' AS summary,
CASE WHEN start < DATE '1998-01-01' - 120 THEN 'too far past' WHEN start > DATE '1998-01-01' + 400 THEN 'too far ahead' ELSE '' END AS block_reason FROM s""")
def night_plan(spark, sf_dir):
    """The calendar operations of the second night, through the gate."""
    run, _ = _second_night(spark, sf_dir)
    return run.ops.select("key", "op", "event_id", "start", "end", "summary", "block_reason")


@query(f"""WITH {NIGHT}, gone AS (SELECT left(key, length(key) - 8) AS key FROM night WHERE type = 'reworded')
SELECT coalesce(c.course_id, p.course_id) AS course_id, coalesce(c.key, p.key) AS key, CAST(coalesce(CASE WHEN coalesce(c.course_id, p.course_id) NOT IN ('c7', 'c8', 'c9') THEN c.start END, p.start) AS VARCHAR) AS start
FROM prev p FULL JOIN cur c ON p.course_id = c.course_id AND p.key = c.key WHERE coalesce(p.key, '') NOT IN (SELECT key FROM gone) AND (p.key IS NOT NULL OR c.course_id NOT IN ('c7', 'c8', 'c9'))""")
def night_belief(spark, sf_dir):
    """The belief that the second night proposes: missing items stay until they are confirmed, unread courses stay as they were."""
    run, believed = _second_night(spark, sf_dir)
    return run.belief(believed).select("course_id", "key", "start")


@query(f"""WITH {NIGHT}, c AS (SELECT n.*, regexp_replace(n.key, '^[^:]*::', '') AS title FROM night n WHERE type <> 'pending_removal'), e AS (SELECT c.*, CAST(p.start AS VARCHAR) AS old, CAST(q.start AS VARCHAR) AS new FROM c LEFT JOIN prev p ON p.key = c.key LEFT JOIN cur q ON q.key = c.key)
SELECT key, type || ': ' || title || ' (' || course_id || ')' AS name, CASE type WHEN 'moved' THEN 'In ' || course_id || ' the assignment ' || chr(39) || title || chr(39) || ' moved from ' || old || ' to ' || new || ', seen on 2024-05-02.'
  WHEN 'added' THEN 'In ' || course_id || ' a new assignment ' || chr(39) || title || chr(39) || ' is scheduled for ' || new || ', first seen on 2024-05-02.'
  ELSE 'In ' || course_id || ' ' || chr(39) || left(title, length(title) - 8) || chr(39) || ' is now titled ' || chr(39) || title || chr(39) || ', seen on 2024-05-02.' END || ' Source: u.' AS body FROM e
UNION ALL SELECT course_id || CASE WHEN i > 0 THEN '#' || i ELSE '' END, 'snapshot: ' || course_id || ' on 2024-05-02' || CASE WHEN i > 0 THEN ' (' || (i + 1) || ')' ELSE '' END, CAST(least(500, n - 500 * i) AS VARCHAR)
FROM (SELECT course_id, count(*) AS n FROM prev GROUP BY 1), unnest(range(0, (n - 1) // 500 + 1)) AS u(i)""")
def run_episodes(spark, sf_dir):
    """Episodes of the second night's changes and of what was believed before it; of a snapshot's JSON its number of items."""
    run, believed = _second_night(spark, sf_dir)
    found = reports.episodes(run.changes, believed, _names(believed), "night-2", "2024-05-02T23:00:00-04:00")
    n = F.size(F.from_json("body", "items array<struct<title:string>>")["items"]).cast("string")
    return found.select("key", "name", F.when(F.col("source") == "json", n).otherwise(F.col("body")).alias("body"))


@query("""SELECT * FROM (VALUES ('c7', 'unreadable'), ('c8', 'not_read'), ('c9', 'unreadable')) AS t(course_id, state)""")
def night_courses(spark, sf_dir):
    run, _ = _second_night(spark, sf_dir)
    return run.courses.filter("state is not null").select("course_id", "state")


WINDOW = "BETWEEN DATE '1998-01-01' - 120 AND DATE '1998-01-01' + 400"
REPLAY = f"""{NIGHTS}, p1 AS (SELECT * FROM prev WHERE start {WINDOW}), b AS (SELECT coalesce(p.course_id, c.course_id) AS course_id, coalesce(p.key, c.key) AS key, coalesce(p.k, c.k) AS k, p.start AS was, c.start AS now
  FROM p1 p FULL JOIN (SELECT * FROM cur WHERE course_id NOT IN ('c7', 'c8', 'c9')) c ON p.course_id = c.course_id AND p.key = c.key),
t AS (SELECT b.*, course_id NOT IN ('c7', 'c8', 'c9', 'c10') AS whole, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'missing' WHEN was <> now THEN 'moved' ELSE 'same' END AS type FROM b),
r AS (SELECT n.key, o.key AS old FROM t n JOIN t o ON n.k = o.k AND n.course_id = o.course_id WHERE n.whole AND n.type = 'added' AND o.type = 'missing')"""


@query(f"""WITH {REPLAY}, ops AS (SELECT key, now FROM t WHERE type IN ('added', 'moved')), bad AS (SELECT key FROM ops WHERE NOT (now {WINDOW}) OR length(key) % 9 = 0),
held AS (SELECT key FROM bad UNION SELECT old FROM r WHERE key IN (SELECT key FROM bad)),
prop AS (SELECT key FROM t WHERE NOT (whole AND type = 'missing' AND key IN (SELECT old FROM r))), bel AS (SELECT key FROM prop EXCEPT SELECT key FROM held UNION SELECT key FROM p1 WHERE key IN (SELECT key FROM held)),
led AS (SELECT key FROM p1 EXCEPT SELECT old FROM r WHERE key NOT IN (SELECT key FROM bad) UNION SELECT key FROM ops WHERE key NOT IN (SELECT key FROM bad))
SELECT 'belief' AS tab, count(*)::BIGINT AS n FROM bel UNION ALL SELECT 'ledger', count(*)::BIGINT FROM led UNION ALL SELECT 'missing', count(*)::BIGINT FROM t WHERE whole AND type = 'missing' AND key NOT IN (SELECT old FROM r) UNION ALL SELECT 'again', 0::BIGINT""")
def commit_replay(spark, sf_dir):
    """Both nights with a store: planned, reported and committed, the second one twice; rows of each state table.

    What the gate blocks isn't believed, so that it is proposed again. Of the
    second night's operations those with a key length divisible by 9 fail.
    Committing again changes nothing.
    """
    store = Store(spark, Scratch(spark).path("store"))
    for tonight in (0, 1):
        readings, items = night_readings(spark, sf_dir, tonight)
        run = nightly.plan_run(spark, store, readings, items, _names(nights(spark, sf_dir)[0]), f"night-{tonight}", today())
        _report(spark, store, run, F.lit(tonight == 1) & (F.length("key") % 9 == 0))
        nightly.commit_run(spark, store, run)
    again = nightly.commit_run(spark, store, run)
    counts = [store.read(n, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tab"), "n") for n, s in (("belief", resolve.BELIEF), ("ledger", nightly.LEDGER), ("missing", nightly.MISSING))]
    return counts[0].union(counts[1]).union(counts[2]).union(spark.range(1).select(F.lit("again").alias("tab"), F.lit(int(again)).cast("long").alias("n")))


def _report(spark, store: Store, run: str, failed: Column, prefix: str = "evt-") -> None:
    """Report every operation of a run that the gate let through."""
    ops = store.archived(run, "ops").filter("block_reason = ''")
    nightly.record(spark, store, run, ops.select("key", "op", F.coalesce("event_id", F.concat(F.lit(prefix), F.col("key"))).alias("event_id"), F.when(failed, "failed").otherwise("ok").alias("status"), F.lit(1).cast("long").alias("seq")))


@query(f"""WITH {NIGHTS}, p1 AS (SELECT key, k, c.start FROM prev c WHERE start {WINDOW}), a AS (SELECT * FROM p1 WHERE k % 3 <> 0), b AS (SELECT * FROM p1 WHERE k % 3 = 0 OR k % 5 = 0)
SELECT key, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'b-' ELSE 'a-' END || key AS event_id, (k % 3 <> 0 AND k % 5 = 0) AS conflict FROM p1""")
def night_recovery(spark, sf_dir):
    """Run A and run B are planned from one state; A's report (of orders not divisible by 3) is late, B is committed with what it reported (of orders divisible by 3 or 5); the next plan commits A.

    The ledger then has A's events where B wrote none; what both wrote keeps
    B's event and is listed as A's conflict.
    """
    store, names = Store(spark, Scratch(spark).path("store")), _names(nights(spark, sf_dir)[0])
    first = night_readings(spark, sf_dir, 0)
    a, b = (nightly.plan_run(spark, store, *first, names, stamp, today()) for stamp in ("a", "b"))
    k = observed(spark, sf_dir).select(F.concat_ws("::", "course_id", _title()).alias("key"), "k")
    for run, wrote in ((a, "k % 3 <> 0"), (b, "k % 3 = 0 or k % 5 = 0")):
        ops = store.archived(run, "ops").filter("block_reason = ''").join(k.filter(wrote).select("key"), "key", "left_semi")
        nightly.record(spark, store, run, ops.select("key", "op", F.concat(F.lit(f"{run}-"), F.col("key")).alias("event_id"), F.lit("ok").alias("status"), F.lit(1).cast("long").alias("seq")))
        if run == b:
            nightly.commit_run(spark, store, run)
    nightly.plan_run(spark, store, *night_readings(spark, sf_dir, 1), names, "c", today())
    lost = nightly.conflicts(store, a).filter("tab = 'ledger'").select("key", F.lit(True).alias("conflict"))
    return store.read("ledger", nightly.LEDGER).select("key", "event_id").join(lost, "key", "left").na.fill(False)


@query(f"""WITH {REPLAY}, talk AS (SELECT DISTINCT course_id FROM prev), x AS (SELECT t.course_id, regexp_replace(t.key, '^[^:]*::', '') AS title, r.old, t.type, CAST(was AS VARCHAR) AS was, CAST(now AS VARCHAR) AS now, now AS day,
  CASE WHEN t.course_id = 'c10' THEN ' (from a partial source)' ELSE '' END AS part FROM t LEFT JOIN r ON r.key = t.key WHERE t.type IN ('added', 'moved')),
c AS (SELECT *, CASE WHEN old IS NOT NULL THEN 'reworded' ELSE type END AS kind FROM x),
m AS (SELECT course_id, regexp_replace(key, '^[^:]*::', '') AS title FROM t WHERE whole AND type = 'missing' AND key NOT IN (SELECT old FROM r)),
p AS (SELECT *, CASE kind WHEN 'added' THEN 'create' ELSE 'update' END AS op, CASE WHEN day < DATE '1998-01-01' - 120 THEN 'too far past' WHEN day > DATE '1998-01-01' + 400 THEN 'too far ahead' ELSE '' END AS why FROM c),
v AS (SELECT course_id FROM talk WHERE CAST(course_id[2:] AS INT) % 2 = 1 AND course_id NOT IN ('c7', 'c9')),
n AS (SELECT (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM m) AS m, (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM p WHERE why <> '') AS b)
SELECT '0 totals' AS section, c || ' changes, ' || m || ' pending removals, 2 courses unreadable, 2 sources failed, 1 courses not read, ' || v || ' items to review' AS line FROM n
UNION ALL SELECT '1 changes', upper(kind) || ' — ' || course_id || ': ' || title || ' — ' || CASE kind WHEN 'added' THEN now || part WHEN 'moved' THEN was || ' -> ' || now || part
  ELSE chr(39) || left(title, length(title) - 8) || chr(39) || ' -> ' || chr(39) || title || chr(39) || ' (similarity ' || printf('%.2f', greatest(2 / 3, 2 * (length(title) - 8) / (2 * length(title) - 8))) || ')' END || ' (source: u)' FROM c
UNION ALL SELECT '2 pending removals', course_id || ': ' || title || ' — missing since 2024-05-02 (1/2); removed if still absent on a later day' FROM m
UNION ALL SELECT '3 unreadable', course_id || ': ' || CASE course_id WHEN 'c7' THEN 'read status ' || chr(39) || 'error' || chr(39) || ': down; belief unchanged' ELSE 'no dated items read but ' || (SELECT count(*) FROM p1 WHERE p1.course_id = talk.course_id) || ' believed; taken as an empty read, belief unchanged' END FROM talk WHERE course_id IN ('c7', 'c9')
UNION ALL SELECT * FROM (VALUES ('4 failed sources', 'c1: http://b failed (timed out); the course' || chr(39) || 's other sources were used'), ('4 failed sources', 'c2: a source failed (empty); the course' || chr(39) || 's other sources were used'), ('5 not read', 'c8'))
UNION ALL SELECT '6 needs review', course_id || ': Talk — "TBD" — ' || 'date is TBD/TBA' FROM v
UNION ALL SELECT '7 blocked', op || ' Due: ' || title || ' (' || course_id || ') — ' || why FROM p WHERE why <> ''
UNION ALL SELECT '8 approved', op || ' ' || count(*) FROM p WHERE why = '' GROUP BY op
UNION ALL SELECT '9 notes', unnest([b || ' operation(s) blocked', m || ' item(s) missing once; no deletion until confirmed on a later day', '2 course(s) unreadable; their beliefs were left untouched', v || ' item(s) need review and were not written']) FROM n""")
def night_summary_lines(spark, sf_dir):
    """The second night's summary: talks without a date to review, which a person has settled in the even courses, and second sources of two courses that failed."""
    store, names = Store(spark, Scratch(spark).path("store")), _names(nights(spark, sf_dir)[0])
    for tonight in (0, 1):
        readings, items = night_readings(spark, sf_dir, tonight)
        none = F.lit(None).cast("string")
        talks = readings.filter("course_id not in ('c7', 'c9')").select("course_id", "ord", F.lit(0).cast("long").alias("pos"), F.lit("Talk").alias("title"), F.lit("TBD").alias("date_text"), F.lit("assignment").alias("kind"), *[none.alias(c) for c in items.columns if c not in ("course_id", "ord", "pos", "title", "date_text", "kind", "all_day")], F.lit(False).alias("all_day"))
        if tonight:
            second = readings.filter("course_id in ('c1', 'c2')").withColumns({"ord": F.lit(2), "source_url": F.when(F.col("course_id") == "c1", "http://b"), "status": F.when(F.col("course_id") == "c1", "error").otherwise("empty"), "error": F.when(F.col("course_id") == "c1", "timed out")})
            readings = readings.unionByName(second)
        run = nightly.plan_run(spark, store, readings, items.unionByName(talks), names, f"night-{tonight}", today())
        if not tonight:
            _report(spark, store, run, F.lit(False))
            nightly.commit_run(spark, store, run)
            even = store.archived(run, "review").filter("cast(substring(course_id, 2) as int) % 2 = 0")
            nightly.resolve_items(store, even.select("key", F.lit("no talk this year").alias("note"), F.lit("2024-05-02").alias("at")))
    return store.archived(run, "summary").select("section", "line")


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN 3 THEN NULL WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00' ELSE strftime(timezone('{NY}', ts AT TIME ZONE 'UTC'), '%Y-%m-%dT%H:%M:%S') || '-05:00' END AS start,
CASE event_id % 4 WHEN 0 THEN CAST(CAST(ts AS DATE) + 1 AS VARCHAR) WHEN 3 THEN NULL WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00' ELSE strftime(timezone('{NY}', ts AT TIME ZONE 'UTC'), '%Y-%m-%dT%H:%M:%S') || '-05:00' END AS "end",
event_id % 4 IN (0, 3) AS all_day, CASE event_id % 4 WHEN 3 THEN 0.0 ELSE 0.98 END::DOUBLE AS confidence, event_id % 4 = 3 AS needs_review FROM events""")
def exact_items(spark, sf_dir):
    """Items with their source's own times: days, instants with Z that end before they start, times without a zone, and what is no time."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k, plain = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    day, next_ = F.date_format("ts", "yyyy-MM-dd"), F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd")
    start = F.when(k == 0, day).when(k == 1, F.concat(plain, F.lit("Z"))).when(k == 2, plain).otherwise("soon")
    end = F.when(k == 0, next_).when(k == 1, F.concat(day, F.lit("T00:00:00Z")))
    x = D.exact(start, end, k == 0, F.lit(NY))
    return e.select("event_id", *[x[c].alias(c) for c in ("start", "end", "all_day", "confidence", "needs_review")])


# --- reports -----------------------------------------------------------------------------


def _belief(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start_day"))


@query(f"SELECT o_orderkey, CAST({DAY} AS VARCHAR) AS day FROM orders WHERE {DAY} BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + 49")
def digest_upcoming(spark, sf_dir):
    return reports.upcoming(_belief(spark, sf_dir), F.lit("1998-01-01").cast("date")).select("o_orderkey", F.col("start_day").cast("string").alias("day"))


@query(f"SELECT o_orderkey, CAST({DAY} AS VARCHAR) AS day FROM orders WHERE {DAY} BETWEEN DATE '1998-01-01' - 49 AND DATE '1998-01-01'")
def digest_recent(spark, sf_dir):
    return reports.recent(_belief(spark, sf_dir), F.lit("1998-01-01").cast("date")).select("o_orderkey", F.col("start_day").cast("string").alias("day"))


CHANGE_LOG = """l AS (SELECT user_id AS course_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, CASE event_type WHEN 'click' THEN 'moved' WHEN 'signup' THEN 'added' ELSE 'reworded' END AS type FROM events),
v AS (SELECT l.course_id, CAST(count(*) FILTER (type = 'moved') AS BIGINT) AS n_moved, CAST(count(*) AS BIGINT) AS n_changes FROM l JOIN (SELECT course_id, min(run_id) AS f FROM l GROUP BY 1) USING (course_id) WHERE NOT (type = 'added' AND run_id = f) GROUP BY 1)"""


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("course_id"), F.to_date("ts").cast("string").alias("run_id"), F.when(F.col("event_type") == "click", "moved").when(F.col("event_type") == "signup", "added").otherwise("reworded").alias("type"))


@query(f"WITH {CHANGE_LOG} SELECT * FROM v")
def digest_volatility(spark, sf_dir):
    return reports.volatility(_log(spark, sf_dir))


@query(f"WITH {CHANGE_LOG} SELECT * FROM v ORDER BY n_moved DESC, n_changes DESC, course_id LIMIT 1")
def most_volatile(spark, sf_dir):
    return reports.most_volatile(reports.volatility(_log(spark, sf_dir)))


@query(f"WITH {CHANGE_LOG} SELECT course_id, type, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY ROLLUP (course_id, type)")
def volatility_rollup(spark, sf_dir):
    return _log(spark, sf_dir).rollup("course_id", "type").agg(F.count(F.lit(1)).alias("n"))


SEARCH = "WITH r AS (SELECT p_partkey, CASE WHEN 'part::' || p_partkey = '{0}' THEN 1 WHEN lower(p_name) = lower('{0}') THEN 2 WHEN contains(lower(p_name), lower('{0}')) OR contains('part::' || p_partkey, lower('{0}')) THEN 3 END AS rung FROM part) SELECT p_partkey, CAST(rung AS INT) AS rung FROM r WHERE rung = (SELECT min(rung) FROM r)"


@query(f"SELECT * FROM ({SEARCH.format('part::17')}) UNION ALL SELECT * FROM ({SEARCH.format('Green')})")
def why_search_ladder(spark, sf_dir):
    b = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("key"))
    return reports.search(b, "part::17").select("p_partkey", "rung").union(reports.search(b, "Green").select("p_partkey", "rung"))


@query("""SELECT DISTINCT event_id, c.c_custkey AS item FROM events e JOIN customer c ON e.user_id = c.c_custkey OR e.event_id % 997 = c.c_custkey OR e.event_id % 499 = c.c_custkey""")
def item_history(spark, sf_dir):
    """Events as changes that name a customer as their key, or before, or after."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), (F.col("event_id") % 997).alias("before_key"), (F.col("event_id") % 499).alias("after_key"))
    return reports.item_history(e, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))).select("event_id", "item")


NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


@query(f"""WITH h AS (SELECT o_orderkey, sha1(unhex('{NAMESPACE}') || encode('run|moved|' || o_orderkey)) AS h FROM orders) SELECT o_orderkey,
h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def episode_uuid(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.uuid5(NAMESPACE, F.concat(F.lit("run|moved|"), F.col("o_orderkey").cast("string"))).alias("uuid"))


@query("SELECT r_name AS course_id, CAST(count(*) AS BIGINT) AS n, string_agg(n_name, ',' ORDER BY n_name) AS titles FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def episode_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = n.select(F.col("r_name").alias("course_id"), F.lit("2024-01-01").alias("start"), F.col("n_name").alias("title"), F.lit("exam").alias("kind"), F.lit("2024-01-01").alias("end"), F.lit(True).alias("all_day"))
    items = F.from_json("body", "id string, items array<struct<title:string>>")["items"]
    return reports.snapshot_json(b).select("course_id", F.size(items).cast("long").alias("n"), F.array_join(F.transform(items, lambda x: x["title"]), ",").alias("titles"))


@query(f"""WITH {NIGHTS} SELECT key, CASE type WHEN 'moved' THEN 'In ' || course_id || ' the exam ''' || key || ''' moved from ' || before_start || ' to ' || after_start || ', seen on 2024-01-02.'
WHEN 'added' THEN 'In ' || course_id || ' a new exam ''' || key || ''' is scheduled for ' || after_start || ', first seen on 2024-01-02.' ELSE 'In ' || course_id || ' the exam ''' || key || ''' of ' || before_start || ' was removed, confirmed on 2024-01-02.' END AS body FROM ch WHERE type <> 'same'""")
def episode_text(spark, sf_dir):
    c = _changes(spark, sf_dir)
    kind = F.when(F.col("type") == "missing", "removed").otherwise(F.col("type"))
    return c.select("key", reports.episode_body(F.col("course_id"), F.lit("exam"), kind, F.col("key"), F.col("before_start"), F.col("after_start"), F.lit("2024-01-02")).alias("body"))


@query("SELECT item_id, substr(sha1(text), 1, 12) AS hash FROM benchmark")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", reports.content_hash(F.col("text")).alias("hash"))


@query("""SELECT user_id AS course_id, event_type AS concept, CAST(arg_max(event_id % 4, (ts, event_id)) AS BIGINT) AS score, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def mastery_latest(spark, sf_dir):
    return _mastery(spark, sf_dir).select("course_id", "concept", "score", "n")


def _mastery(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("course_id"), F.col("event_type").alias("concept"), F.col("ts").alias("at"), F.col("event_id").alias("pos"), (F.col("event_id") % 4).alias("score"))
    return reports.mastery_latest(reports.valid_scores(e))


@query("""WITH l AS (SELECT user_id AS course_id, event_type AS concept, CAST(arg_max(event_id % 4, (ts, event_id)) AS BIGINT) AS score FROM events GROUP BY ALL) SELECT * FROM l WHERE score < 2""")
def mastery_weak(spark, sf_dir):
    return reports.weak(_mastery(spark, sf_dir)).select("course_id", "concept", "score")


# --- slots ---------------------------------------------------------------------------------

EXAMS = """x AS (SELECT n_nationkey AS course_id, e, DATE '2024-01-15' + CAST(40 * (e + 1) + n_nationkey AS INT) AS exam_day FROM nation, range(0, 3) r(e)),
s AS (SELECT course_id, e AS seg, coalesce(lag(exam_day) OVER (PARTITION BY course_id ORDER BY e) + 1, DATE '2024-01-15') AS a, exam_day - 1 AS b FROM x),
d AS (SELECT course_id, seg, CAST(day AS DATE) AS day FROM s, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) u(day) WHERE isodow(day) IN (1, 3)),
z AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY day) AS n, row_number() OVER (PARTITION BY course_id, seg ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY course_id, seg) AS size FROM d)"""


def _slots(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("course_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("e"))
    start = F.lit("2024-01-15").cast("date")
    x = n.select("course_id", F.concat(F.lit("Exam "), F.col("e").cast("string")).alias("title"), F.date_add(start, 40 * (F.col("e") + 1) + F.col("course_id")).alias("exam_day"))
    return slots.numbered(slots.session_slots(slots.segments(x, start), [0, 2]))


@query(f"WITH {EXAMS} SELECT course_id, CAST(seg AS INT) AS seg, CAST(day AS VARCHAR) AS day, CAST(n AS INT) AS n, (size > 1 AND k = size - 1) AS is_review FROM z")
def session_slots(spark, sf_dir):
    return _slots(spark, sf_dir).select("course_id", "seg", F.col("day").cast("string").alias("day"), "n", "is_review")


@query(f"""WITH {EXAMS}, g AS (SELECT DISTINCT course_id, seg, size FROM z), r AS (SELECT *, CAST(round_even(37 * size / CAST(sum(size) OVER (PARTITION BY course_id) AS DOUBLE), 0) AS BIGINT) AS x, max(seg) OVER (PARTITION BY course_id) AS l FROM g)
SELECT course_id, CAST(seg AS INT) AS seg, CAST(CASE WHEN seg = l THEN 37 - coalesce(sum(x) OVER (PARTITION BY course_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE x END AS BIGINT) AS share FROM r""")
def topic_shares(spark, sf_dir):
    sizes = _slots(spark, sf_dir).groupBy("course_id", "seg").agg(F.first("size").alias("size"))
    return slots.shares(sizes, F.lit(37).cast("long")).select("course_id", "seg", F.col("share").cast("long").alias("share"))


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS m FROM part) SELECT p_partkey, CAST(least(11, i * 12 // m) AS BIGINT) AS slot FROM p""")
def topic_spread(spark, sf_dir):
    by = Window.partitionBy("p_brand")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(by.orderBy("p_partkey")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("m"))
    return p.select("p_partkey", slots.topic_slot(F.col("i"), F.lit(12), F.col("m")).cast("long").alias("slot"))


# --- check-in --------------------------------------------------------------------------------

NOW_SQL = "date_part('hour', ts) * 60 + date_part('minute', ts)"


def _at(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumns({"day": F.to_date("ts"), "minute": F.hour("ts") * 60 + F.minute("ts")})


@query(f"""SELECT event_id, CASE WHEN isodow(ts) IN (6, 7) THEN NULL WHEN event_type = 'signup' THEN 'all_clear' WHEN {NOW_SQL} >= 1290 + 90 THEN 'missed' WHEN {NOW_SQL} >= 1290 THEN 'remind' ELSE 'wait' END AS action FROM events""")
def checkin_action(spark, sf_dir):
    """Each event as a moment at which the planner runs: due 21:30 on weekdays, 90 minutes' grace."""
    scheduled = F.array_contains(F.array(*map(F.lit, checkin.DAYS[:5])), checkin.day_name(F.col("day")))
    return _at(spark, sf_dir).select("event_id", checkin.action(F.col("minute"), checkin.minutes(F.lit("21:30")), F.lit(90), F.col("event_type") == "signup", scheduled).alias("action"))


@query("""WITH e AS (SELECT user_id AS person, ts - INTERVAL 5 HOUR AS t FROM events), f AS (SELECT person, CAST(t AS DATE) AS day, min(t) AS t FROM e GROUP BY ALL),
d AS (SELECT person, CAST(x AS DATE) AS day FROM (SELECT DISTINCT person FROM e), generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) g(x)),
m AS (SELECT person, day, t, day + INTERVAL 1290 MINUTE AS due, day + INTERVAL 1380 MINUTE AS late FROM d LEFT JOIN f USING (person, day)),
s AS (SELECT person, day, 'remind' AS stage, due AS t FROM m WHERE coalesce(t > due, true) UNION ALL SELECT person, day, 'missed', late FROM m WHERE coalesce(t > late, true) UNION ALL SELECT person, day, 'all_clear', t FROM m WHERE t > late)
SELECT person, CAST(day AS VARCHAR) AS day, stage, strftime(t + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS "at" FROM s""")
def checkin_deadlines(spark, sf_dir):
    """Events as a stream of check-ins of people in New York who are asked at 21:30 every day with 90 minutes' grace: timers of keyed state say when somebody must be reminded, was missed, or is back."""
    e = table(spark, sf_dir, "events")
    none = lambda kind: F.lit(None).cast(kind)
    at = lambda text: F.lit(text).cast("timestamp")
    row = lambda df, when, kind: df.select(F.col("person").cast("bigint").alias("person"), when.alias("at"), F.lit(kind).alias("kind"), none("string").alias("due"), none("int").alias("grace"), none("array<string>").alias("days"), none("string").alias("timezone"))
    people = e.select(F.col("user_id").alias("person")).distinct()
    asked = row(people, at("2023-12-31 12:00:00"), "settings").withColumns({"due": F.lit("21:30"), "grace": F.lit(90), "days": F.array(*map(F.lit, checkin.DAYS)), "timezone": F.lit(NY)})
    came = row(e.select(F.col("user_id").alias("person"), "ts"), F.col("ts").cast("timestamp"), "checkin")
    clock = row(people.limit(1), at("2024-02-04 12:00:00"), "clock")
    scratch = Scratch(spark)
    _, path = scratch.write(asked.unionByName(came).unionByName(clock), "events")
    found = deadlines.over_files(spark, path, scratch)
    return found.select("person", F.col("day").cast("string").alias("day"), "stage", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


SENT = """sent AS (SELECT CASE event_type WHEN 'click' THEN 'missed' WHEN 'error' THEN 'clear' ELSE 'share' END || ':' || CAST(ts AS DATE) || ':' || user_id AS key, CASE event_type WHEN 'click' THEN 'missed' WHEN 'error' THEN 'clear' ELSE 'share' END AS kind, CAST(user_id AS VARCHAR) AS "to", CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(ts AS DATE) AS day FROM events)"""


def _sent(spark, sf_dir):
    e = _at(spark, sf_dir)
    kind = F.when(F.col("event_type") == "click", "missed").when(F.col("event_type") == "error", "clear").otherwise("share")
    return e.select(F.lit(0).alias("person"), F.concat_ws(":", kind, F.col("day").cast("string"), F.col("user_id").cast("string")).alias("key"), kind.alias("kind"), F.col("user_id").cast("string").alias("to"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("ok").alias("status"), "day")


@query(f"""WITH {SENT}, c AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS contact FROM events) SELECT contact, 'clear:2024-01-10:' || contact AS key FROM c WHERE 'missed:2024-01-10:' || contact IN (SELECT key FROM sent WHERE status = 'ok')""")
def checkin_allclear(spark, sf_dir):
    contacts = table(spark, sf_dir, "events").select(F.lit(0).alias("person"), F.lit("2024-01-10").cast("date").alias("today"), F.col("user_id").cast("string").alias("to")).distinct()
    return checkin.all_clears(contacts, _sent(spark, sf_dir)).select(F.col("to").alias("contact"), "key")


@query(f"""WITH {SENT}, m AS (SELECT DISTINCT 'share:2024-W02:' || user_id AS key, 'share' AS kind, CAST(user_id AS VARCHAR) AS "to" FROM events), u AS (SELECT "to", count(*) AS n FROM sent WHERE status = 'ok' AND kind <> 'clear' AND day = DATE '2024-01-10' GROUP BY 1)
SELECT m.key, m.kind, m."to", CASE WHEN coalesce(n, 0) >= 2 THEN 'daily cap reached for ' || m."to" END AS blocked FROM m LEFT JOIN u ON u."to" = m."to" """)
def daily_cap(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("to")).distinct()
    messages = u.select(F.lit(0).alias("person"), F.concat(F.lit("share:2024-W02:"), F.col("to")).alias("key"), F.lit("share").alias("kind"), "to")
    person = spark.range(1).select(F.lit(0).alias("person"), F.lit("2024-01-10").cast("date").alias("today"), F.lit(2).alias("cap"))
    return checkin.gated(messages, _sent(spark, sf_dir), person).drop("person")


@query("SELECT o_orderkey, 'share:' || isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') || ':' || o_custkey AS key FROM orders")
def weekly_share_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", checkin.share_key(F.to_date("o_orderdate"), F.col("o_custkey").cast("string")).alias("key"))


@query(f"SELECT event_id, ({NOW_SQL} >= 1320 OR {NOW_SQL} < 420) AS overnight, ({NOW_SQL} >= 780 AND {NOW_SQL} < 840) AS midday FROM events")
def quiet_hours(spark, sf_dir):
    quiet = lambda a, b: checkin.in_quiet_hours(F.col("minute"), checkin.minutes(F.lit(a)), checkin.minutes(F.lit(b)))
    return _at(spark, sf_dir).select("event_id", quiet("22:00", "07:00").alias("overnight"), quiet("13:00", "14:00").alias("midday"))


@query("""WITH e AS (SELECT user_id AS person, CAST(ts AS DATE) AS day, event_id AS "at" FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) <= DATE '2024-01-15') SELECT person, CAST(max(day) AS VARCHAR) AS day, arg_max("at", (day, "at")) AS "at" FROM e GROUP BY 1""")
def last_checkin_before(spark, sf_dir):
    c = _at(spark, sf_dir).filter("event_type = 'signup'").select(F.col("user_id").alias("person"), "day", F.col("event_id").alias("at"))
    until = c.select("person").distinct().withColumn("until", F.lit("2024-01-15").cast("date"))
    return checkin.last_checkin(c, until).select("person", F.col("day").cast("string").alias("day"), "at")


# --- sources ------------------------------------------------------------------------------------


@query("""SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM pages""")
def html_title_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query()
def html_visible_text(spark, sf_dir):
    """Text of each page outside scripts, styles and navigation; SQL has no tolerant parser."""
    return table(spark, sf_dir, "pages").select("page_id", html_items.visible(F.col("html")).alias("text"))


@query(f"SELECT o_orderkey, 'Homework ' || o_orderkey AS title, CAST({DAY} AS VARCHAR) AS date_text, 'https://x.test/a?id=' || o_orderkey AS url, 'assignment' AS kind FROM orders")
def html_items_rendered(spark, sf_dir):
    """A page for each order, written and read back; dates in its menu, its foot and what its items say of themselves don't count."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))
    key = F.col("o_orderkey").cast("string")
    parts = (
        F.lit('<html><body><nav><li>Oct 1</li></nav><h2>Assignments</h2><ul><li class="assignment"><span class="generated">Generated Sep 5</span><a class="title" href="/a?id='), key, F.lit('&sid=zz9"><i class="session">s77</i> Homework '), key,
        F.lit('</a><p>note<span class="due"><em class="generated">read 2021-05-05</em>'), F.col("day"), F.lit("</span></li></ul><footer>Generated 2020-01-01</footer></body></html>"),
    )
    found = o.withColumn("r", html_items.items_of(F.concat(*parts))).select("o_orderkey", F.lit("https://x.test/p").alias("source_url"), F.explode("r.items").alias("i")).select("o_orderkey", "source_url", "i.*")
    return html_items.finish(found).select("o_orderkey", "title", "date_text", "url", "kind")


@query(f"""SELECT o_orderkey, 'Homework ' || o_orderkey AS title, CAST({DAY} AS VARCHAR) AS date_text, 'https://x.test/a?id=' || o_orderkey AS url, 'assignment' AS kind FROM orders
UNION ALL SELECT o_orderkey, 'Quiz ' || o_orderkey, CAST({DAY} + 7 AS VARCHAR), '', 'exam' FROM orders""")
def page_blocks_sql(spark, sf_dir):
    """A page for each order, read by the table function in SQL: a card with a date around two items isn't one itself."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    key, day = F.col("o_orderkey").cast("string"), lambda n: F.date_add("day", n).cast("string")
    html = F.concat(
        F.lit('<h2>Assignments</h2><div class="card">Week of '), day(0), F.lit('<ul><li><a class="title" href="/a?id='), key, F.lit('&sid=z1">Homework '), key, F.lit('</a><span class="due">'), day(0),
        F.lit("</span></li><li><b>Quiz "), key, F.lit('</b> <span class="when">'), day(7), F.lit("</span></li></ul></div>"),
    )
    pages.register(spark)
    blocks = spark.sql("SELECT p.o_orderkey, 'https://x.test/p' AS source_url, b.* FROM {saved} AS p, LATERAL page_blocks(p.html) AS b", saved=o.select("o_orderkey", html.alias("html")))
    return pages.items(blocks, "o_orderkey").select("o_orderkey", "title", "date_text", "url", "kind")


@query(f"SELECT o_orderkey, 'Order ' || o_orderkey AS subject, 'c' || o_custkey || '@x.test' AS sender, CAST({DAY} AS VARCHAR) AS sent, o_orderstatus AS plain FROM orders")
def mail_parts_sql(spark, sf_dir):
    """A message for each order, with a marked-up body beside the plain one, taken apart by the table function in SQL."""
    # a message takes milliseconds, so few files are dealt over all cores
    o = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism).withColumn("key", F.col("o_orderkey").cast("string"))
    lines = (
        F.concat(F.lit("Subject: Order "), F.col("key")), F.concat(F.lit("From: c"), F.col("o_custkey").cast("string"), F.lit("@x.test")), F.concat(F.lit("Date: "), F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 12:00:00 +0000")),
        F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary="b1"\r\n\r\n--b1\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--b1\r\nContent-Type: text/plain\r\n'), F.col("o_orderstatus"), F.lit("--b1--\r\n"),
    )
    pages.register(spark)
    return spark.sql("SELECT m.o_orderkey, p.subject, p.sender, p.sent, p.plain FROM {mails} AS m, LATERAL mail_parts(m.raw) AS p", mails=o.select("o_orderkey", F.encode(F.concat_ws("\r\n", *lines), "UTF-8").alias("raw")))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN s_nationkey < 12 THEN 'Lab ' || s_suppkey END AS title, CASE WHEN s_nationkey < 12 THEN '2024-02-' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') END AS date_text,
CASE WHEN s_nationkey < 12 THEN 'https://x.test/s?id=' || s_suppkey END AS url FROM supplier""")
def course_pages(spark, sf_dir):
    """Suppliers as courses; those of nations under 12 have their page saved in a file, the others have none and read as empty."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    key = F.col("s_suppkey").cast("string")
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"))
    html = F.concat(F.lit('<h2>Labs and dates</h2><ul><li class="assignment"><a class="title" href="/s?id='), key, F.lit('">Lab '), key, F.lit('</a><span class="due">'), day, F.lit("</span></li></ul>"))
    root = Scratch(spark).path("pages")
    s.filter("s_nationkey < 12").select(key.alias("course"), html.alias("value")).repartition("course").write.partitionBy("course").text(root)
    courses = s.select(key.alias("course_id"), F.lit("https://x.test/home").alias("source_url"), F.lit(NY).alias("timezone"), F.lit("2024-02-01T12:00:00Z").alias("read_at"))
    told, items = pages.readings(pages.load(courses, root, named=r"/course=([^/]+)/"))
    return told.join(items.select("course_id", "title", "date_text", "url"), "course_id", "left").select(F.col("course_id").cast("long").alias("s_suppkey"), "status", "title", "date_text", "url")


@query("""SELECT event_id AS title_id, 'assignment' AS kind, 'due ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date_text FROM events WHERE event_type <> 'error'
UNION ALL SELECT CAST(json_extract(props, '$.k') AS BIGINT), 'other', '2024-02-01 to 2024-02-01' FROM events WHERE event_type = 'error'""")
def rest_json_items(spark, sf_dir):
    """Events as assignments, errors among them as all-day calendar events titled by their JSON."""
    e = table(spark, sf_dir, "events").withColumn("course_id", F.lit("c"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    none = F.lit(None).cast("string")
    a = e.filter("event_type <> 'error'").select("course_id", F.concat(F.lit("HW "), F.col("event_id").cast("string")).alias("name"), stamp.alias("due_at"), none.alias("html_url"), F.lit(True).alias("published"))
    n = spark.createDataFrame([], "course_id string, " + rest_json.ANNOUNCEMENT)
    v = e.filter("event_type = 'error'").select("course_id", F.concat(F.lit("Day "), F.get_json_object("props", "$.k")).alias("title"), stamp.alias("start_at"), none.alias("end_at"), F.lit(True).alias("all_day"), F.lit("2024-02-01").alias("all_day_date"), none.alias("html_url"), none.alias("description"))
    return rest_json.items(a, n, v).select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("title_id"), "kind", "date_text")


@query(f"SELECT event_id, 'Quiz ' || event_id AS title, 'exam' AS kind, strftime(timezone('{NY}', date_trunc('second', ts) AT TIME ZONE 'UTC'), '%Y-%m-%dT%H:%M:%S') || '-05:00' AS start FROM events")
def ical_decode(spark, sf_dir):
    """A feed for each event, with a folded line and a decorated summary, decoded."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id").cast("string")
    feed = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Quiz "), key, F.lit(" - D\r\n ue\r\nDTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    found = ical.items(e.select(key.alias("course_id"), F.lit("u").alias("source_url"), F.lit(NY).alias("timezone"), feed.alias("text")))
    return found.select(F.col("course_id").cast("long").alias("event_id"), "title", "kind", "start")


@query(f"SELECT o_orderkey, 'Homework ' || o_orderkey % 10 AS title, 'announcement' AS kind, CAST({DAY} AS VARCHAR) AS posted_at FROM orders")
def mail_items(spark, sf_dir):
    """A mail for each order that moves one of ten known items, parsed and matched."""
    # a message takes long beside its size, so few files are dealt over all cores
    o = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism).select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("course_id"))
    name = F.concat(F.lit("Homework "), (F.col("o_orderkey") % 10).cast("string"))
    raw = F.concat(F.lit("Subject: Re: [X] news\r\nFrom: p@x.test\r\nDate: "), F.date_format("d", "dd MMM yyyy"), F.lit(" 10:00:00 +0000\r\nContent-Type: text/plain\r\n\r\nHello all.\n\n"), name, F.lit(" is moved from Oct 14 to Oct 16. See you.\r\n")).cast("binary")
    mails = o.withColumn("p", mail.parsed(raw)).select("course_id", F.col("o_orderkey").alias("mail_id"), "p.subject", "p.sender", "p.sent", "p.body", "p.message_id")
    return mail.items(mails, o.select("course_id", name.alias("title"))).select(F.col("mail_id").alias("o_orderkey"), "title", "kind", "posted_at")


# --- whole plans and reports ---------------------------------------------------------------

PEOPLE = """p AS (SELECT c_custkey AS k, c_custkey % 11 <> 0 AS on_, c_custkey % 7 <> 0 AS sched, c_custkey % 3 = 0 AS inn, c_custkey % 2 = 0 AS late, c_custkey % 13 <> 0 AS has FROM customer),
c AS (SELECT k, 'c' || i AS c FROM p, range(1, 3) r(i) WHERE has), m AS (
SELECT k, 'missed:2024-01-10:' || c AS key, 'missed_checkin' AS kind, c AS "to" FROM p JOIN c USING (k) WHERE on_ AND sched AND NOT inn AND late AND NOT (k % 5 = 0 AND c = 'c1')
UNION ALL SELECT k, 'remind:2024-01-10', 'owner_reminder', 'owner' FROM p WHERE on_ AND sched AND NOT inn AND NOT late
UNION ALL SELECT k, 'clear:2024-01-10:c1', 'all_clear', 'c1' FROM p WHERE on_ AND sched AND inn AND has AND k % 5 = 0
UNION ALL SELECT k, 'say:2024-01-10:c1:x', 'owner_message', 'c1' FROM p WHERE on_ AND k % 4 = 0
UNION ALL SELECT k, 'share:2024-W02:c2', 'schedule_share', 'c2' FROM p WHERE on_ AND has AND k % 9 = 0)"""


def _checkin_plan(spark, sf_dir):
    """Customers as people at a quarter to eleven on Wednesday, January 10: every third has checked in, every fifth's first contact was alerted, every sixth's has had two messages."""
    k = F.col("c_custkey")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    c, day = table(spark, sf_dir, "customer"), F.lit("2024-01-10").cast("date")
    people = c.select(
        k.alias("person"), (k % 11 != 0).alias("enabled"), F.col("c_name").alias("owner_name"), at("2024-01-10 22:45:00").alias("now"), F.lit(NY).alias("timezone"), F.lit(True).alias("checkin_enabled"), F.lit("21:00").alias("due"),
        F.when(k % 2 == 0, 90).otherwise(120).alias("grace"), F.when(k % 7 == 0, F.array(F.lit("mon"))).otherwise(F.array(*map(F.lit, checkin.DAYS))).alias("days"), F.lit("23:00").alias("quiet_start"), F.lit("07:00").alias("quiet_end"),
        (k % 9 == 0).alias("share_enabled"), F.lit("wed").alias("share_day"), F.lit("18:00").alias("share_time"), F.array(F.lit("c2"), F.lit("c9")).alias("share_contacts"), F.lit(2).alias("cap"), F.lit(True).alias("include_location"),
    )
    contacts = c.filter(k % 13 != 0).select(k.alias("person"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).select("person", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("contact"), F.concat(F.lit("Name "), F.col("pos").cast("string")).alias("name"), F.lit("a@x.test").alias("address"), "pos")
    checkins = c.select(k.alias("person"), F.when(k % 3 == 0, day).otherwise(F.date_sub(day, 2)).alias("day"), at("2024-01-10 20:10:00").alias("at"), F.lit("fine").alias("note"), F.lit("home").alias("place"))
    row = lambda df, key, kind, status: df.select(k.alias("person"), F.lit(key).alias("key"), F.lit(kind).alias("kind"), F.lit("c1").alias("to"), F.lit(status).alias("status"), day.alias("day"))
    sent = row(c.filter(k % 5 == 0), "missed:2024-01-10:c1", "missed", "ok").union(row(c.filter(k % 6 == 0), "say:2024-01-10:c1:a", "say", "ok")).union(row(c.filter(k % 6 == 0), "say:2024-01-10:c1:b", "say", "ok")).union(row(c, "say:2024-01-10:c1:x", "say", "failed"))
    outbox = c.filter(k % 4 == 0).select(k.alias("person"), F.lit("say:2024-01-10:c1:x").alias("key"), F.lit("c1").alias("to"), F.lit("s").alias("subject"), F.lit("b").alias("body"))
    plans = c.filter(k % 10 == 1).select(k.alias("person"), day.alias("day"), F.lit("a game").alias("note"))
    places = c.filter(k % 10 == 2).select(k.alias("person"), F.lit("library").alias("place"), at("2024-01-10 21:45:00").alias("seen_at"))
    agenda = c.select(k.alias("person"), F.date_add(day, (k % 12).cast("int")).alias("day"), F.lit("Essay").alias("title"), F.lit("Arts").alias("course"), F.lit("exam").alias("kind"))
    return checkin.plan(people, contacts, checkins, sent, outbox, plans, places, agenda)


@query(f"""WITH {PEOPLE}, u AS (SELECT c_custkey AS k, 'c1' AS "to", CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 0 END AS n FROM customer)
SELECT k AS person, key, kind, m."to", CASE WHEN coalesce(n, 0) >= 2 AND kind <> 'all_clear' THEN 'daily cap reached for ' || m."to" END AS blocked FROM m LEFT JOIN u USING (k, "to")""")
def checkin_plan(spark, sf_dir):
    return _checkin_plan(spark, sf_dir)[0].select("person", "key", "kind", "to", "blocked")


@query(f"""WITH {PEOPLE} SELECT k AS person, 'check-ins are off' AS note FROM p WHERE NOT on_ UNION ALL SELECT k, 'no contacts; nothing can be sent' FROM p WHERE on_ AND NOT has
UNION ALL SELECT k, 'checked in today at 20:10' FROM p WHERE on_ AND sched AND inn UNION ALL SELECT k, 'check-in missed at 22:30 but there is nobody to tell' FROM p WHERE on_ AND sched AND NOT inn AND late AND NOT has
UNION ALL SELECT k, 'no check-in scheduled on wed' FROM p WHERE on_ AND NOT sched UNION ALL SELECT k, 'schedule share: unknown contact c' || i FROM p, (VALUES (2), (9)) r(i) WHERE on_ AND k % 9 = 0 AND (i = 9 OR NOT has)""")
def checkin_notes(spark, sf_dir):
    return _checkin_plan(spark, sf_dir)[1]


@query(f"""WITH {PEOPLE}, d AS (SELECT k, DATE '2024-01-10' + CAST(k % 12 AS INT) AS d FROM p) SELECT k AS person, c_name || chr(39) || 's exams and deadlines, Jan 10 to Jan 17:' || chr(10) || chr(10) ||
CASE WHEN k % 12 <= 7 THEN '- ' || strftime(d, '%a %b %d') || ': Essay (Arts, exam)' ELSE '- nothing due this week' END || chr(10) || chr(10) || 'Dates come from the course pages; what they leave open isn' || chr(39) || 't listed.' AS body FROM m JOIN d USING (k) JOIN customer ON c_custkey = k WHERE kind = 'schedule_share'""")
def checkin_share_text(spark, sf_dir):
    return _checkin_plan(spark, sf_dir)[0].filter("kind = 'schedule_share'").select("person", "body")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' new' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'u2' ELSE 'u1' END AS url FROM customer UNION ALL SELECT -n_nationkey - 1, n_name, 'u3' FROM nation""")
def course_upsert(spark, sf_dir):
    """Customers as courses; every third is renamed, every second moves, nations are new."""
    c, k, none = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit(None).cast("string")
    courses = c.select(k.alias("id"), F.col("c_name").alias("name"), F.lit("u1").alias("url"))
    given = c.select(k.alias("id"), F.when(k % 3 == 0, F.concat("c_name", F.lit(" new"))).alias("name"), F.when(k % 2 == 0, "u2").alias("url"))
    new = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("u3").alias("url"))
    return ledger.upsert_courses(courses, given.unionByName(new), ("name", "url"))


@query("""WITH k AS (SELECT DISTINCT event_type AS kind, user_id AS key FROM events WHERE event_id % 2 = 0), a AS (SELECT DISTINCT event_type AS kind, user_id AS key FROM events)
SELECT kind, key, (k.key IS NOT NULL) AS known FROM a LEFT JOIN k USING (kind, key)""")
def track_has(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key"), "event_id")
    return ledger.track_has(e.filter("event_id % 2 = 0"), e.select("kind", "key").distinct())


@query("""WITH k AS (SELECT DISTINCT event_type AS kind, user_id AS key FROM events) SELECT kind, CAST(count(*) AS BIGINT) AS n FROM k WHERE key % 4 <> 1 GROUP BY kind""")
def track_remove(spark, sf_dir):
    """What is left of each kind when every fourth user's entries are taken out."""
    k = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key")).distinct()
    return ledger.track_kinds(ledger.track_remove(k, k.filter("key % 4 = 1")))


@query("""WITH b AS (SELECT o_custkey AS course_id, o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT o_custkey AS course_id, o_orderkey % 5 = 0 AS done FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT o_custkey AS course_id FROM orders WHERE o_orderkey % 7 = 0), x AS (SELECT course_id, count(*) AS n_items, count(*) FILTER (key % 2 = 0) AS n_written, 0 AS n_missing, 0 AS n_review FROM b GROUP BY 1
UNION ALL SELECT course_id, 0, 0, count(*), 0 FROM m GROUP BY 1 UNION ALL SELECT course_id, 0, 0, 0, count(*) FROM r WHERE NOT done GROUP BY 1)
SELECT course_id, sum(n_items)::BIGINT AS n_items, sum(n_written)::BIGINT AS n_written, sum(n_missing)::BIGINT AS n_missing, sum(n_review)::BIGINT AS n_review FROM x GROUP BY 1""")
def status_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("key"), "o_orderstatus")
    known = o.filter("key % 2 = 0").select("key")
    return reports.status(o.filter("o_orderstatus <> 'P'"), o.filter("key % 3 = 0").withColumn("resolved", F.col("key") % 5 == 0), o.filter("key % 7 = 0"), known)


def _reported(spark, sf_dir):
    """Tonight's belief of the orders with the changes of two nights, as reports read them."""
    prev, cur = nights(spark, sf_dir)
    day = lambda c: F.struct(F.col(f"{c}.start").alias("start"), F.col(f"{c}.all_day").alias("all_day"), F.col(f"{c}.title").alias("title"), F.concat(F.lit("on "), F.col(f"{c}.start")).alias("date_text"), F.array(F.lit("page")).alias("sources"))
    c = diff.changes(prev, cur)
    changes = c.select(F.lit("r2").alias("run_id"), F.lit("1998-01-05T23:00:00-05:00").alias("as_of"), "course_id", "key", F.col("key").alias("before_key"), F.when(F.col("type") == "missing", "removed").otherwise(F.col("type")).alias("type"), F.coalesce("after.title", "before.title").alias("title"), day("before").alias("before"), day("after").alias("after"), F.lit("n").alias("note"), F.lit("page").alias("source"))
    belief = cur.select("course_id", "key", "title", "start", "end", "all_day", F.concat(F.lit("on "), F.col("start")).alias("date_text"), F.array(F.lit("page")).alias("sources"), F.lit("r").alias("read_at"), F.lit(0.9).alias("confidence"), F.array(F.lit("a guess")).alias("assumptions"))
    names = cur.select("course_id", F.concat(F.lit("Course "), F.col("course_id")).alias("name")).distinct()
    return belief, changes, names


DIGEST = f"""WITH {NIGHTS}, t AS (SELECT course_id, key, type, coalesce(after_start, before_start) AS s, regexp_replace(key, '^[^:]*::', '') AS title FROM ch WHERE type <> 'same'),
v AS (SELECT course_id, count(*) FILTER (type = 'moved') AS a, count(*) FILTER (type <> 'added') AS n FROM t GROUP BY 1)
SELECT '1 due' AS section, strftime(start, '%a %b %d') || ': ' || title || ' — Course ' || course_id AS line FROM cur WHERE start BETWEEN DATE '1998-01-07' AND DATE '1998-01-14'
UNION ALL SELECT '2 changed', '1998-01-05: ' || upper(CASE type WHEN 'missing' THEN 'removed' ELSE type END) || ' — Course ' || course_id || ': ' || title || ' — n (source: page)' FROM t
UNION ALL SELECT '3 volatility', 'Course ' || course_id || ': ' || a || ' deadline move(s), ' || n || ' change(s) total' FROM v WHERE n > 0
UNION ALL SELECT '4 pending removals', 'Course ' || course_id || ': ' || title || ' — missing since 1998-01-02 (1/2)' FROM prev WHERE k % 40 = 0
UNION ALL SELECT '5 needs your decision', 'Course ' || course_id || ': ' || title || ' — "TBD" — date is TBD/TBA' FROM prev WHERE k % 50 = 1"""


@query(DIGEST)
def digest_lines(spark, sf_dir):
    """The weekly digest of all courses, a row a line."""
    return _digest(spark, sf_dir).select("section", "line")


@query(f"""WITH d AS ({DIGEST}), v AS (SELECT *, TRY_CAST(regexp_extract(line, ': (\\d+) deadline', 1) AS INT) AS a, TRY_CAST(regexp_extract(line, ', (\\d+) change', 1) AS INT) AS n, regexp_extract(line, '^Course ([^:]+):', 1) AS c FROM d WHERE section = '3 volatility')
SELECT * FROM d UNION ALL SELECT '0 digest', 'Week of 1998-01-07'
UNION ALL SELECT s, h || CASE WHEN s = '3 volatility' THEN '' ELSE ': ' || (SELECT count(*) FROM d WHERE section = s) END FROM (VALUES ('1 due', 'Due until 1998-01-14'), ('2 changed', 'Changed since 1997-12-31'), ('3 volatility', 'Dates that moved this term'), ('4 pending removals', 'Missing, not yet removed'), ('5 needs your decision', 'To decide')) AS x(s, h)
WHERE s < '4' OR s IN (SELECT section FROM d)
UNION ALL SELECT s, t FROM (VALUES ('1 due', 'nothing is due in this time'), ('2 changed', 'nothing has changed'), ('3 volatility', 'no date has moved')) AS x(s, t) WHERE s NOT IN (SELECT section FROM d)
UNION ALL SELECT section, left(line, 10) || ': ' || count(*) FROM d WHERE section = '1 due' GROUP BY 1, left(line, 10)
UNION ALL SELECT section, 'moves most: ' || line FROM (SELECT * FROM v WHERE a > 0 ORDER BY a DESC, n DESC, c LIMIT 1)""")
def digest_report(spark, sf_dir):
    """The digest with what stands above and between its lines."""
    return reports.headed(_digest(spark, sf_dir), F.lit("1998-01-07").cast("date"), Scratch(spark)).select("section", "line")


def _digest(spark, sf_dir):
    belief, changes, names = _reported(spark, sf_dir)
    o, title = observed(spark, sf_dir), _title().alias("title")
    missing = o.filter("k % 40 = 0").select("course_id", title, F.lit("1998-01-02").alias("first_missing"), F.lit(1).alias("count"))
    review = o.filter("k % 50 = 1").select("course_id", title, F.lit("TBD").alias("date_text"), F.lit("date is TBD/TBA").alias("reason"))
    return reports.digest(belief, changes, missing, review, names, F.lit("1998-01-07").cast("date"))


@query(f"""WITH {NIGHTS}, c AS (SELECT *, strftime(start, '%a %b %d, %Y') AS w FROM cur), f AS (SELECT strftime(CAST(x AS DATE), '%a %b %d, %Y') AS w, x FROM (SELECT DISTINCT before_start AS x FROM ch UNION SELECT DISTINCT after_start FROM ch) WHERE x IS NOT NULL)
SELECT key, title || ' — Course ' || course_id AS line FROM c UNION ALL SELECT key, 'Now: ' || w FROM c UNION ALL SELECT key, 'As written: "on ' || start || '"' FROM c UNION ALL SELECT key, 'Sources: page' FROM c
UNION ALL SELECT key, 'Last read: r; confidence 0.90' FROM c UNION ALL SELECT key, 'Assumed: a guess' FROM c UNION ALL SELECT key, 'Calendar event: ' || CASE WHEN k % 2 = 0 THEN 'e (written 1998-01-05T23:00)' ELSE 'none yet' END || '; key ' || key FROM c
UNION ALL SELECT key, '1998-01-05: first seen, ' || a.w || ', page said "on ' || after_start || '" (source: page)' FROM ch JOIN f a ON a.x = after_start WHERE type = 'added'
UNION ALL SELECT key, '1998-01-05: moved from ' || b.w || ' to ' || a.w || '; page changed from "on ' || before_start || '" to "on ' || after_start || '" (source: page)' FROM ch JOIN f a ON a.x = after_start JOIN f b ON b.x = before_start WHERE type = 'moved'""")
def receipt_lines(spark, sf_dir):
    """Where each believed date comes from, a row a line."""
    belief, changes, names = _reported(spark, sf_dir)
    o = observed(spark, sf_dir).filter("k % 2 = 0")
    key = F.concat_ws("::", "course_id", F.concat(_title(), F.when(F.col("k") % 20 == 2, " revised").otherwise("")))
    known = o.select(key.alias("key"), F.lit("e").alias("event_id"), F.lit("1998-01-05T23:00:00-05:00").alias("written_at"))
    missing = spark.createDataFrame([], "key string, first_missing date, count int")
    return reports.receipts(belief, known, missing, changes, names).select("key", "line")


@query(f"""WITH {CHANGED}, n AS (SELECT course_id, count(*) AS n_belief FROM prev GROUP BY 1), g AS (SELECT ops.*, n_belief, count(*) FILTER (op = 'delete') OVER (PARTITION BY course_id) AS n_del FROM ops LEFT JOIN n USING (course_id)),
b AS (SELECT op, {GATE_SQL} AS why FROM g) SELECT op, count(*) FILTER (why = '')::BIGINT AS n_approved, count(*) FILTER (why <> '')::BIGINT AS n_blocked FROM b GROUP BY 1""")
def ops_by_type(spark, sf_dir):
    return nightly.ops_by_type(_gated(spark, sf_dir))


@query("""WITH l AS (SELECT user_id AS course_id, event_type, arg_max(event_id % 4, (ts, event_id)) AS score FROM events GROUP BY ALL)
SELECT course_id, count(*)::BIGINT AS concepts, count(*) FILTER (score < 2)::BIGINT AS weak, count(*) FILTER (score >= 2)::BIGINT AS solid FROM l GROUP BY 1""")
def mastery_summary(spark, sf_dir):
    return reports.mastery_summary(_mastery(spark, sf_dir))


@query("""SELECT o_orderkey AS key, o_orderstatus AS date_text FROM orders WHERE NOT (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)""")
def review_open(spark, sf_dir):
    """What is left to decide when every fifth item is resolved and every third was before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("date_text"), (F.col("o_orderkey") % 3 == 0).alias("resolved"), F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("string").alias("resolved_at"))
    return ledger.open_review(ledger.resolve_review(o, o.filter("key % 5 = 0").select("key", F.lit("settled").alias("note"), F.lit("2024-01-02").alias("at")))).select("key", "date_text")


@query("""WITH l AS (SELECT user_id AS person, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_type)) AS note FROM events GROUP BY ALL) SELECT person, CAST(day AS VARCHAR) AS day, note FROM l""")
def checkin_log(spark, sf_dir):
    """Events as check-ins, half of them logged later; the last of a day stays."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), F.to_date("ts").alias("day"), F.col("ts").alias("at"), F.col("event_type").alias("note"), F.lit("").alias("place"), "event_id")
    side = lambda k: e.filter(F.col("event_id") % 2 == k).drop("event_id")
    return checkin.log_checkins(side(0), side(1)).select("person", F.col("day").cast("string").alias("day"), "note")


@query("""WITH k AS (SELECT user_id AS person, 'say:' || CAST(ts AS DATE) || ':' || event_type || ':x' AS key, event_type AS "to", max((ts, event_id % 2)) AS x FROM events GROUP BY ALL)
SELECT person, key, 'say' AS kind, "to", CASE WHEN x[2] = 0 THEN 'ok' ELSE 'failed' END AS status FROM k""")
def checkin_sent_log(spark, sf_dir):
    """Events as reports of sent messages; of several reports of a key the last stands."""
    e = table(spark, sf_dir, "events")
    key = F.concat_ws(":", F.lit("say"), F.to_date("ts").cast("string"), "event_type", F.lit("x"))
    r = e.select(F.col("user_id").alias("person"), key.alias("key"), F.struct("ts", (F.col("event_id") % 2).alias("odd")).alias("at"))
    last = r.groupBy("person", "key").agg(F.max("at").alias("a")).select("person", "key", F.when(F.col("a.odd") == 0, "ok").otherwise("failed").alias("status"), F.col("a.ts").alias("at"))
    sent = last.filter("person % 2 = 0").select("person", "key", F.lit("say").alias("kind"), F.lit("nobody").alias("to"), F.lit("old").alias("status"), F.to_date("at").alias("day"))
    return checkin.log_sent(sent, last).select("person", "key", "kind", "to", "status")
