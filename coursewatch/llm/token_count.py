"""Token counts by a map-side two-tier lookup of pre-tokens.

A byte-level BPE encodes each pre-token by itself, so a text has as many
tokens as its pre-tokens have together. A compact table of the lengths of
frequent pre-tokens goes to every worker; the others are encoded once a worker
and kept in a bounded cache. Nothing is shuffled. The library decides in all
cases of doubt: texts with a character on whose class ``regex`` and the
library's own pre-tokenizer disagree are encoded by the library as they are.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
"""Rows (about) that the frequent pre-tokens are counted on. They only decide what is looked up and what is encoded; counts don't depend on them."""
FREQUENT = 50_000
CACHE_ENTRIES = 300_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: the pre-token pattern of byte-level BPE."""


def disputed(tokenizer) -> str:
    """Characters that the library's pre-tokenizer classes otherwise than PATTERN does."""
    pattern, bad = regex.compile(PATTERN), []
    known = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if not regex.match(r"\p{Cn}|\p{Co}", c)]
    for at in range(0, len(known), 4096):
        part = known[at : at + 4096]
        probes = [f"x{c}x1{c}1!{c}! " for c in part]
        text = "".join(probes)
        ours = {m.start() for m in pattern.finditer(text)}
        theirs = {span[0] for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        width = len(probes[0])
        bad += [part[k] for k in sorted({x // width for x in ours ^ theirs})]
    return "".join(bad)


@dataclass
class PretokenCounter:
    """The vocabulary as JSON, the frequent pre-tokens with their lengths, and the special and disputed strings."""

    vocabulary: str
    frequent: list[str]
    lengths: bytes
    specials: list[str]
    odd: str

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _start(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.vocabulary)
        t.no_truncation()
        t.no_padding()
        special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        odd, unknown, fine = frozenset(self.odd), regex.compile(r"[\p{Cn}\p{Co}]").match, set()

        def doubt(text: str) -> bool:
            fresh = set(text) - fine
            if any(c in odd or unknown(c) for c in fresh):
                return True
            fine.update(fresh)
            return False

        table = dict(zip(self.frequent, self.lengths, strict=True))
        self._ready = t, special, doubt, regex.compile(PATTERN).findall, table, {}
        return self._ready

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        t, special, doubt, findall, table, cache = self._ready or self._start()
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        out, split, direct = [0] * len(texts), {}, []
        for i, text in enumerate(texts):
            if not text:
                continue
            if doubt(text):
                direct.append(i)
                continue
            if special and special.search(text):
                out[i] = len(special.findall(text))
                split[i] = [p for part in special.split(text) for p in findall(part)]
            else:
                split[i] = findall(text)
        misses = list({p for pieces in split.values() for p in pieces if p not in table and p not in cache})
        cache.update(zip(misses, (len(e) for e in t.encode_batch(misses, add_special_tokens=False)), strict=True))
        for i, pieces in split.items():
            out[i] += sum([table.get(p) or cache[p] for p in pieces])
        for i in direct:
            out[i] = len(t.encode(texts[i], add_special_tokens=False))
        return out


def prepare(docs: DataFrame, path: str, text: str = "text") -> PretokenCounter:
    """Read the vocabulary at ``path`` (on the driver only) and measure frequent pre-tokens of a bounded sample."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    config = json.loads(vocabulary)
    pre = config.get("pre_tokenizer") or {}
    if config.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE without normalizer and prefix space is split into pre-tokens here")
    t = Tokenizer.from_str(vocabulary)
    rows = docs.select(F.col(text).alias("text")).filter("text is not null")
    n = max(1, rows.count())
    pieces, findall = Counter(), regex.compile(PATTERN).findall
    start = 1 + F.pmod(F.xxhash64(F.lit(17), "text"), F.greatest(F.length("text") - 4000, F.lit(1)))
    for r in rows.filter(F.rand(29) < min(1.0, SAMPLE_ROWS / n)).select(F.substring("text", start.cast("int"), F.lit(4000)).alias("text")).collect():
        pieces.update(findall(r["text"]))
    specials = [a["content"] for a in config.get("added_tokens", [])]
    frequent = [p for p, _ in pieces.most_common(FREQUENT) if not any(s in p for s in specials)]
    lengths = [len(e) for e in t.encode_batch(frequent, add_special_tokens=False)]
    kept = [(p, k) for p, k in zip(frequent, lengths, strict=True) if 0 < k < 256]
    return PretokenCounter(vocabulary, [p for p, _ in kept], bytes(k for _, k in kept), specials, disputed(t))


def count_column(df: DataFrame, counter: PretokenCounter, text: Column) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(counter)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([n for i in range(0, len(texts), 256) for n in shared.value.count(texts.iloc[i : i + 256].tolist())], dtype="int64")

    return counted.asNondeterministic()(text)


def token_counts(df: DataFrame, counter: PretokenCounter, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit of each whole text.

    Null counts as empty: 0 bytes, 0 tokens. Repeated rows get equal counts;
    df's columns are kept, clashing names are replaced; an empty table gives an
    empty table.
    """
    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", count_column(df, counter, F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
