"""Saved pages of courses as readings, and pages and mails as table functions of SQL.

``load`` gives every course its page of a folder, ``readings`` what a night
takes. ``register`` makes ``page_blocks`` and ``mail_parts`` known to SQL, to be
used by LATERAL; ``items`` chooses items among rows of ``page_blocks``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, NullType, StringType, StructType

from ..functions import dates as D
from . import html_items, mail
from .ical import for_a_night

FILE_NAME = r"([^/]+)\.html?$"


def load(courses: DataFrame, root: str, named: str = FILE_NAME) -> DataFrame:
    """courses (course_id, ...) with ``html`` of their files below ``root``; ``named`` takes the course's id from a path.

    A course without a file, or with an empty one, has an empty page. Of several
    files of a course the one with the first path counts. Files of no course are
    left out; a course that comes twice has its page twice.
    """
    spark = courses.sparkSession
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select("_metadata.file_path", F.col("value").alias("html"))
    path = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))  # paths are told as URIs
    own = F.nullif(F.regexp_extract(path, named, 1), F.lit(""))
    found = files.select(own.alias("_course"), "file_path", "html").filter("_course is not null")
    first = found.groupBy("_course").agg(F.min(F.struct("file_path", "html")).alias("_file"))
    joined = courses.join(first, F.col("course_id").cast("string") == F.col("_course"), "left")
    return joined.withColumn("html", F.coalesce("_file.html", F.lit(""))).drop("_course", "_file")


def readings(pages: DataFrame, ord_: int = 0) -> tuple[DataFrame, DataFrame]:
    """Readings and items of pages, for a night: (course_id, source_url, timezone, read_at, html), a row a course.

    A page without text, or with next to none, is empty; it never fails. Other
    columns aren't read.
    """
    read = pages.select("course_id", "source_url", "read_at", D.known_zone(F.col("timezone")).alias("timezone"), html_items.items_of(F.col("html")).alias("_read"))
    place = [F.col(c) for c in ("course_id", "source_url", "read_at", "timezone")]
    told = read.select("course_id", F.lit(ord_).alias("ord"), "source_url", "read_at", F.col("_read.status").alias("status"), F.lit(None).cast("string").alias("error"), "timezone", F.lit(False).alias("partial"))
    flat = read.select(*place, F.posexplode("_read.items").alias("pos", "_item")).select(*place, "pos", "_item.*")
    return told, for_a_night(html_items.finish(flat), ord_)


def _asked(function: str, argument: AnalyzeArgument, *kinds: type) -> None:
    if not isinstance(argument.dataType, (*kinds, NullType)):
        raise ValueError(f"{function} takes {' or '.join(k.typeName() for k in kinds)}, not {argument.dataType.simpleString()}")


@udtf
class PageBlocks:
    """page_blocks(html): a row for each block of a page that has a date in it, with its marked elements."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        _asked("page_blocks", html, StringType)
        part = StructType().add("roles", ArrayType(StringType())).add("text", StringType()).add("href", StringType()).add("stamp", StringType())
        whole, said = IntegerType(), StringType()  # no session is there to read a schema's text
        return AnalyzeResult(StructType().add("text_chars", whole).add("at", whole).add("last", whole).add("section", said).add("text", said).add("parts", ArrayType(part)))

    def eval(self, html: str) -> Iterator[tuple]:
        text, blocks = html_items.scan(html)
        for b in blocks:
            parts = [(p["roles"], p["text"], p["href"], p["stamp"]) for p in b["parts"]]
            yield len(text), b["at"], b["last"], b["section"], b["text"], parts


@udtf
class MailParts:
    """mail_parts(raw): one row with a message's headers and first bodies, or why it can't be read."""

    @staticmethod
    def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
        _asked("mail_parts", raw, BinaryType)
        schema = StructType()
        for name in mail.FIELDS:
            schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, raw: bytes) -> Iterator[tuple]:
        yield tuple(mail.opened(raw if raw is not None else b"").values())


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_blocks", PageBlocks)
    spark.udtf.register("mail_parts", MailParts)


def items(blocks: DataFrame, *page: str) -> DataFrame:
    """Flat items among rows of ``page_blocks`` with source_url beside them; ``page`` names the columns that tell pages apart.

    Blocks lie within each other or apart. So a block holds another that is an
    item exactly if the next item in the order of their starts is within it.
    A page with next to no text has none, as with ``html_items.items_of``.
    """
    block = F.struct("at", "last", "section", "text", "parts")
    told = blocks.filter(F.col("text_chars") >= html_items.LEAST_TEXT).select(*page, "source_url", html_items.chosen(block).alias("_item")).filter("_item.ok")
    after = F.lead("_item.at").over(Window.partitionBy(*page).orderBy("_item.at"))
    inner = told.withColumn("_next", after).filter("_next is null or _next > _item.last")
    return html_items.finish(inner.select(*page, "source_url", "_item.*").drop("last", "ok"))
