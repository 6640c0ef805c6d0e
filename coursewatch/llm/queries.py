"""The operators bound to the driver's tables: one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, langid, lm_score, minhash, mixing, quality, simhash, spelling, token_count, toxicity, warc
from .common import Scratch, table
from .sql import ORACLE  # noqa: F401 - registered beside queries()

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def crc(key: str, of: int):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc("doc_id", 5) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), Scratch(spark))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "source", "lang", "topic", F.col("n_tokens").cast("long").alias("n_tokens"), "probability", "weight")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark).path("warc"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counter = token_count.prepare(docs, str(public_tokenizers.path(TOKENIZER)))
    return token_count.token_counts(docs, counter).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark)).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))
    return found.select("doc_id", "item_id", "start", "aligned", "equal")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(chat.messages(table(spark, sf_dir, "conversations"), Scratch(spark)))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(crc("doc_id", 4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc("doc_id", 4) == 2).alias("held_out"), "langid.lang_pred", "langid.score", "langid.margin", "langid.rejected")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = alignment.prepare(*(str(public_tokenizers.path(name)) for name in (TOKENIZER, PIECES)))
    return alignment.aligned_documents(table(spark, sf_dir, "documents"), words, Scratch(spark))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), damage=199), scratch)


def queries() -> dict:
    found = (op1_toxicity, op2_lm_score, op3_simhash, op4_mixing, op5_warc, op6_token_counts, op7_quality, op8_decontamination, op9_chat, op10_langid, op11_alignment, op12_minhash, op13_spelling)
    return {f.__name__: f for f in found}
