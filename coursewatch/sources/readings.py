"""The interchange schema, and its JSON source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "title string, date_text string, kind string, url string, section string, posted_at string, detail string, start string, end string, all_day boolean, review_reason string"
ITEM_STRUCT = "struct<" + ", ".join(f"{n}:{t}" for n, t in (f.split() for f in ITEM.split(", "))) + ">"
READING = f"course_id string, source_url string, read_at string, status string, error string, timezone string, partial boolean, items array<{ITEM_STRUCT}>"
DEFAULT_TZ = "America/New_York"


def read_json(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Reading files, one object each; a file that isn't one has ``_corrupt`` set. Missing fields get their defaults."""
    raw = spark.read.schema(READING + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(paths, multiLine=True)
    return raw.withColumn("file", F.input_file_name()).withColumns({"status": F.coalesce("status", F.lit("ok")), "timezone": F.coalesce("timezone", F.lit(DEFAULT_TZ)), "partial": F.coalesce("partial", F.lit(False))})


def invalid(readings: DataFrame) -> DataFrame:
    """Readings without what every reading needs."""
    return readings.filter(F.col("_corrupt").isNotNull() | F.col("course_id").isNull() | F.col("read_at").isNull() | ~F.col("status").isin("ok", "empty", "error"))


def items(readings: DataFrame) -> DataFrame:
    """One row an item with its place: (course_id, source_url, read_at, timezone, partial, pos, …). Blank titles go; an item without a url gets the reading's."""
    flat = readings.filter("status = 'ok'").select("course_id", "source_url", "read_at", "timezone", "partial", F.posexplode("items").alias("pos", "item")).select("course_id", "source_url", "read_at", "timezone", "partial", "pos", "item.*")
    flat = flat.withColumns({"title": F.trim("title"), "date_text": F.trim(F.coalesce("date_text", F.lit(""))), "kind": F.coalesce("kind", F.lit("assignment")), "source": F.coalesce(F.nullif("url", F.lit("")), "source_url")})
    return flat.filter("title is not null and title <> ''").withColumn("detail", F.substring(F.coalesce("detail", F.lit("")), 1, 500))
