"""Language identification by compression.

Each language has a zstandard raw-content dictionary, the whole texts of a
bounded sample of its labelled rows. A text costs as many bytes as its compression with a
dictionary takes; the language with the smallest cost wins. The text is cut
into blocks that are compressed one by one, so that a long text can't replace
the dictionary by its own past, and all of it counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

UNKNOWN = "und"
SAMPLE_ROWS = 200
"""Labelled rows a language that a model is fitted on, at most (about), each with its whole text."""
BLOCK_CHARS = 2048
LEVEL = 5
MIN_MARGIN_BYTES = 1
MIN_MARGIN = 0.001
RESULT = "lang_pred string, score double, margin double, rejected boolean"

_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words of letters, one space between and around; empty without a letter.

    Numerals such as ½ and ² count as parts of words but aren't letters.
    """
    words = _NO_LETTER.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


@dataclass
class Model:
    """Dictionaries by language, in the order of their names (the first of equal costs wins, and is rejected)."""

    dictionaries: dict[str, bytes]

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_compressors": None}

    def _compress(self):
        if self._compressors is None:
            self._compressors = []
            for data in self.dictionaries.values():
                # zstandard takes no dictionary under 8 bytes
                d = zstandard.ZstdCompressionDict(data.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return self._compressors

    def costs(self, text: str) -> list[int]:
        data = letters(text)
        blocks = [data[i : i + BLOCK_CHARS].encode() for i in range(0, len(data), BLOCK_CHARS)]
        return [sum(len(c(b)) for b in blocks) for c in self._compress()]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score in [0, 1], bytes by which it wins, and whether that is too few."""
        if not self.dictionaries or text is None or not letters(text):
            return UNKNOWN, 0.0, 0.0, True
        costs = self.costs(text)
        best = min(costs)
        at = costs.index(best)
        others = costs[:at] + costs[at + 1 :]
        score = 1 / (1 + sum(2.0 ** -min(60, c - best) for c in others))
        margin = float(min(others) - best) if others else float(best)
        return list(self.dictionaries)[at], score, margin, margin < max(MIN_MARGIN_BYTES, MIN_MARGIN * best)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model of at most (about) SAMPLE_ROWS rows a language. Rows without text or language teach nothing, repeated ones once."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.lit(11), F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    taken = bounded_sample(rows, "lang", F.col("h"), SAMPLE_ROWS, 7).dropDuplicates(["h", "lang"]).collect()
    by: dict[str, list] = {}
    for r in sorted(taken, key=lambda r: (r["h"], r["text"])):
        by.setdefault(r["lang"], []).append(letters(r["text"]))
    return Model({k: "".join(by[k]).encode() for k in sorted(by) if any(by[k])})


def predict_column(df: DataFrame, model: Model, text: Column) -> Column:
    """RESULT for each text, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return predict.asNondeterministic()(text)  # else a filter on the result runs it twice


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with a struct ``langid`` of RESULT.

    Null texts and texts without a letter get ``und``, score 0, and are
    rejected. Ties go to the first language by name and are rejected.
    Repeated rows get equal results; columns of df are kept, a clashing
    ``langid`` is replaced; an empty table gives an empty table.
    """
    return df.withColumn("langid", predict_column(df, model, F.col(text)))
