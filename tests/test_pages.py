"""Pages of a folder as readings, and the table functions of SQL."""

import pytest
from pyspark.sql import functions as F

from coursewatch.sources import html_items, pages

NESTED = '<ul class="card-list"><li class="item">Outer Oct 1 <div class="item"><b>Inner</b> Oct 2</div></li><li><b>Other</b> due Oct 9</li></ul> and more text here'


def test_files_of_courses(spark, tmp_path):
    for path, html in {"a b+ç.html": NESTED, "later/a b+ç.html": "<li>Second Oct 3</li> and more text here", "empty.html": "", "stranger.html": NESTED, "notes.txt": NESTED}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(html, encoding="utf-8")
    courses = spark.createDataFrame([("a b+ç", 1, "own"), ("empty", 2, None), ("none", 3, None), (None, 4, None), ("a b+ç", 5, None)], "course_id string, k int, html string")
    got = pages.load(courses, str(tmp_path))
    assert got.columns == ["course_id", "k", "html"]
    assert {r.k: r.html for r in got.collect()} == {1: NESTED, 2: "", 3: "", 4: "", 5: NESTED}


def test_readings_of_pages(spark):
    rows = [("a", "https://x.test/p", "Nowhere/Zone", "2026-09-05", NESTED), ("b", None, None, None, None), ("c", "u", "America/Denver", "2026-09-05", "x")]
    told, items = pages.readings(spark.createDataFrame(rows, "course_id string, source_url string, timezone string, read_at string, html string"))
    assert {r.course_id: (r.status, r.error, r.partial) for r in told.collect()} == {"a": ("ok", None, False), "b": ("empty", None, False), "c": ("empty", None, False)}
    assert {r.course_id: r.timezone for r in told.collect()}["c"] == "America/Denver"
    assert sorted((r.course_id, r.pos, r.title, r.date_text) for r in items.collect()) == [("a", 0, "Inner", "Oct 2"), ("a", 1, "Other", "due Oct 9")]


def test_items_of_blocks_equal_items_of_pages(spark):
    """The choice by rows in SQL and that by arrays agree, on pages with much nesting."""
    deep = "<div class='item'>Quiz Oct 1" * 6 + "<b>In</b> Oct 2" + "</div>" * 3 + "<li><h3>Side</h3>Oct 3</li>" + "</div>" * 3
    undated = "<li>Essay Oct 4<div class='item'>Oct 5</div></li> the inner one has no title"
    df = spark.createDataFrame(list(enumerate([NESTED, deep, undated, "", None, "<li>Oct 1</li>", NESTED])), "k int, html string").withColumn("source_url", F.lit("https://x.test/"))
    pages.register(spark)
    blocks = spark.sql("SELECT p.k, p.source_url, b.* FROM {saved} AS p, LATERAL page_blocks(p.html) AS b", saved=df)
    by_rows = sorted((r.k, r.title, r.date_text) for r in pages.items(blocks, "k").collect())
    whole = df.select("k", F.explode(html_items.items_of(F.col("html"))["items"]).alias("i"))
    assert by_rows == sorted((r.k, r.i.title, r.i.date_text) for r in whole.collect()) and len(by_rows) >= 6


def test_mail_parts(spark):
    pages.register(spark)
    mails = spark.createDataFrame([(1, b"Subject: Hi\r\nFrom: q@x.test\r\nDate: Mon, 05 Jan 2026 10:00:00 +0000\r\n\r\nbody"), (2, None), (3, b"")], "k int, raw binary")
    got = {r.k: (r.subject, r.sender, r.sent) for r in spark.sql("SELECT m.k, p.* FROM {mails} AS m, LATERAL mail_parts(m.raw) AS p", mails=mails).collect()}
    assert got == {1: ("Hi", "q@x.test", "2026-01-05"), 2: ("", "", None), 3: ("", "", None)}


@pytest.mark.parametrize("call, kind", [("page_blocks(1)", "string"), ("mail_parts('x')", "binary")])
def test_functions_say_what_they_take(spark, call, kind):
    pages.register(spark)
    with pytest.raises(Exception, match=f"takes {kind}, not"):
        spark.sql(f"SELECT * FROM {call}").collect()
