"""A corpus pipeline of five stages: language, toxicity, near-duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
gets it as written and reread Parquet. docs needs doc_id, text, source and lang;
other columns stay as they are, whatever their names. An empty table gives an
empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewatch.llm import decontaminate, langid, mixing, simhash, toxicity
from coursewatch.llm.common import SENT_ROWS, Scratch, table
from coursewatch.llm.queries import crc
from coursewatch.ship import ship

TOXIC = 0.8
"""Score from which the toxicity stage rejects; above the predictor's 0.5, so that clean documents stay."""

#: Not expressible in SQL: trained models, fingerprints and raking. tests/llm tests the stages.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without doubt; null, letterless and ambiguous texts and ties go. Repeated rows stay or go together."""
    ship(spark)
    model = langid.fit(docs.filter(crc("doc_id", 4) != 2))
    told = docs.withColumn("__langid", langid.predict_column(docs, model, F.col("text")))
    return told.filter(~F.col("__langid.rejected")).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under TOXIC.

    Null and empty texts have the score of no words and stay where that is
    under it; rows without an id are scored like others; repeated rows stay or
    go together.
    """
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc("doc_id", 5) != 0)
    told = docs.withColumn("__toxicity", toxicity.score_column(docs, model, F.col("text")))
    return told.filter(F.col("__toxicity") < TOXIC).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group, once if it is repeated; rows without an id stay.

    Null, empty and wordless texts are one group. Texts are shuffled once and
    not sorted: what goes and what is repeated is left out by one join whose
    other side holds ids and hashes only.
    """
    ship(spark)
    scratch = Scratch(spark)
    found, _ = scratch.write(simhash.near_duplicates(docs, scratch).filter("doc_id is not null"), "groups")
    id_, hash_ = F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
    here = lambda marks: (docs["doc_id"] == marks["_id"]) & (F.xxhash64(docs["text"]) == marks["_hash"])
    repeated, _ = scratch.write(found.filter("component = doc_id").groupBy(id_, hash_).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    out = found.filter("component < doc_id").select(id_, hash_).distinct().union(repeated)
    kept = docs.join(out.hint("shuffle_hash"), here(out), "left_anti")
    if not (n := repeated.count()):
        return kept
    once = docs.join(F.broadcast(repeated) if n <= SENT_ROWS else repeated, here(repeated), "left_semi")
    return kept.union(once.dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts and rows without an id or text stay; repeated rows stay or go together."""
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics, and each document's weight.

    Null sources and languages are values of their own, null and empty texts
    count one token; rows of one id and cell stay or go together. topic,
    n_tokens, probability and weight are added, or replaced where docs has them.
    """
    ship(spark)
    return mixing.mix(docs, Scratch(spark))


STAGES = [("language", language), ("toxicity", clean), ("near-duplicates", deduplicate), ("decontamination", decontaminated), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
