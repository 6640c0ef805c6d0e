"""Benchmark decontamination by spaced seeds.

A mask keeps some tokens of a short span and ignores the others, so a
substituted token in an ignored place doesn't break the match. Hashes of the
kept tokens of every span of the benchmark items are joined with those of the
training texts; around each hit the two token sequences are compared without
gaps, and any stretch that is long and equal enough decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MASKS = ("111011", "1001111", "11100011", "11000001011")
"""Five tokens kept in each. Of passages of 16 tokens, a fifth of them substituted at random, these hit 98 %."""
SHORTEST = min(map(len, MASKS))
MIN_TOKENS = 12
"""Equal tokens that an overlap has at least, or MIN_SHARE of a shorter item."""
MIN_SHARE = 0.8
MIN_IDENTITY = 0.75
MISMATCH = 2
"""What a substituted token costs; an equal one earns 1."""
EXACT_SEEDS = 1_000_000
"""Up to that many (seed, item, place) of the benchmark go to the executors whole (20 MB), else only a bitmap of fixed size, and the join with them is salted."""
SALTS = 32
FEW_BITS, MANY_BITS = 24, 27
CACHE_WORDS = 250_000

_WORD = re.compile(r"[^\W_]+").findall
_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3) & (2**64 - 1) | 1 for k in range(16)], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Hashes(dict):
    """64-bit hashes of lower-cased words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = _WORD(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seeds(tokens: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask, its span and the hash of each span of ``tokens``; for each size in ``short``, those of all runs of that size."""
    for k, mask in [*enumerate(MASKS), *((100 + n, "1" * n) for n in short)]:
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, (k + 1) * 0x2545F4914F6CDD1D & (2**64 - 1), np.uint64)
        for j, c in enumerate(mask):
            if c == "1":
                h += tokens[j : j + n] * _MULT[j]
        h ^= h >> np.uint64(31)
        yield len(mask), h * _MIX


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Hashes()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([words.of(t).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["item_id", "tokens"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of an item: of all masks, or of the whole item if it is shorter than they are."""
    for b in batches:
        for item, tokens in zip(b.column("item").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            for _, h in seeds(np.array(tokens, np.int64).view(np.uint64), (len(tokens),) if 0 < len(tokens) < SHORTEST else ()):
                yield pa.RecordBatch.from_pydict({"seed": pa.array(h.view(np.int64)), "item": pa.array(np.full(len(h), item, np.int64)), "at": pa.array(np.arange(len(h), dtype=np.int32))})


class Filter:
    """Which seeds the benchmark may have: all of them, or a bitmap of fixed size. ``short``: sizes of items that are shorter than every mask."""

    def __init__(self, exact: np.ndarray | None, bitmap: np.ndarray | None, short: tuple[int, ...]):
        self.exact, self.bitmap, self.short, self.bits = exact, bitmap, short, MANY_BITS if exact is None else FEW_BITS
        if exact is not None:
            self.bitmap = np.zeros(1 << (FEW_BITS - 6), np.uint64)
            slot = exact >> np.uint64(64 - FEW_BITS)
            np.bitwise_or.at(self.bitmap, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions of h that pass."""
        slot = h >> np.uint64(64 - self.bits)
        at = np.flatnonzero((self.bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
        if self.exact is not None and len(at):
            i = np.searchsorted(self.exact, h[at])
            at = at[self.exact[np.minimum(i, len(self.exact) - 1)] == h[at]] if len(self.exact) else at[:0]
        return at


def seed_filter(item_seeds: DataFrame, items: DataFrame) -> tuple[Filter, bool]:
    """The filter, and whether the seeds are few enough to go to the executors whole."""
    size = F.size("tokens")
    short = tuple(sorted(r["n"] for r in items.filter((size > 0) & (size < SHORTEST)).select(size.alias("n")).distinct().collect()))
    column = lambda df, name: df.toArrow().column(name).to_numpy().astype(np.int64)
    if item_seeds.limit(EXACT_SEEDS + 1).count() <= EXACT_SEEDS:
        return Filter(np.sort(column(item_seeds.select("seed").distinct(), "seed").view(np.uint64)), None, short), True
    slot = F.shiftrightunsigned("seed", 64 - MANY_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - MANY_BITS}) & 63 as int))")
    words = item_seeds.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    bitmap = np.zeros(1 << (MANY_BITS - 6), np.int64)
    bitmap[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return Filter(None, bitmap.view(np.uint64), short), False


def _hits(shared, id_type: str):
    names = ["doc_id", "text_hash", "tokens", "seed", "at"]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, passes = Hashes(), shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                docs = [words.of(t) for t in b.column("text").to_pylist()]
                size = np.array([len(d) for d in docs])
                start = np.cumsum(size) - size
                tokens = np.concatenate(docs)
                doc_of = np.repeat(np.arange(len(docs)), size)
                found = []
                for span, h in seeds(tokens, passes.short):
                    at = passes(h)
                    at = at[doc_of[at] == doc_of[at + span - 1]]
                    found.append((doc_of[at], at, h[at]))
                if not found or not sum(len(f[0]) for f in found):
                    continue
                doc, at, h = (np.concatenate([f[k] for f in found]) for k in range(3))
                order = np.argsort(doc, kind="stable")
                doc, at, h = doc[order], at[order], h[order]
                hit, first = np.unique(doc, return_index=True)
                cut = [*first, len(doc)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(hit)),
                        b.column("text_hash").take(pa.array(hit)),
                        pa.array([docs[d].view(np.int64) for d in hit], pa.list_(pa.int64())),
                        pa.array([h[i:j].view(np.int64) for i, j in zip(cut, cut[1:])], pa.list_(pa.int64())),
                        pa.array([(at[i:j] - start[d]).astype(np.int32) for d, i, j in zip(hit, cut, cut[1:])], pa.list_(pa.int32())),
                    ],
                    names=names,
                )

    return hits, f"doc_id {id_type}, text_hash long, tokens array<long>, seed array<long>, at array<int>"


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Start in the text, aligned and equal tokens of the best stretch on a diagonal (text position less item position)."""
    lo, hi = max(0, diagonal), min(len(doc), len(item) + diagonal)
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    gain = score - np.minimum.accumulate(score)
    end = int(gain.argmax())
    begin = int(score[: end + 1].argmin())
    return lo + begin, end - begin, int(same[begin:end].sum())


def fullest(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Like overlap(): of all stretches of MIN_IDENTITY the one with most equal tokens, then the shortest, then the first."""
    lo, hi = max(0, diagonal), min(len(doc), len(item) + diagonal)
    same = np.concatenate([[0], np.cumsum(doc[lo:hi] == item[lo - diagonal : hi - diagonal])])
    score = same - MIN_IDENTITY * np.arange(len(same))
    begin = np.searchsorted(-np.minimum.accumulate(score), -score)  # the first place from which the identity holds
    end = int((same - same[begin]).argmax())
    found, n = int(begin[end]), int(same[end] - same[begin[end]])
    ends = np.searchsorted(same, same[found:] + n)
    starts = np.arange(found, len(same))[ends < len(same)]
    ends = ends[ends < len(same)]
    k = int((ends - starts).argmin())
    return lo + int(starts[k]), int(ends[k] - starts[k]), n


def enough(aligned: int, equal: int, item_size: int) -> bool:
    """MIN_TOKENS equal ones or MIN_SHARE of the item, at MIN_IDENTITY; an item shorter than every mask must be there as it is."""
    if item_size < SHORTEST:
        return equal == aligned == item_size
    return equal >= min(MIN_TOKENS, np.ceil(MIN_SHARE * item_size)) and equal >= MIN_IDENTITY * aligned


def _verify(docs: pd.Series, items: pd.Series, diagonals: pd.Series) -> pd.DataFrame:
    """Accepted if any stretch on any diagonal is enough(); best-scored stretches that are enough are reported before others."""
    out = []
    for d, i, all_ in zip(docs, items, diagonals, strict=True):
        for stretch in (overlap, fullest):
            found = [stretch(d, i, int(g)) for g in all_]
            accepted = [o for o in found if enough(o[1], o[2], len(i))]
            if accepted:
                break
        out.append((*max(accepted or found, key=lambda o: (o[2], -o[1], -o[0])), bool(accepted)))
    return pd.DataFrame(out, columns=["start", "aligned", "equal", "accepted"])


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, item_id, start, aligned, equal) for each text that repeats a passage of an item.

    Words are compared lower-cased and without punctuation. Items of the same
    words are one, named by the smallest id. An item of fewer words than the
    shortest mask spans matches texts that hold it whole. Null and empty items
    and texts never match; rows of equal doc_id and text are reported once;
    ``text_hash`` tells rows of one doc_id apart; ids may be of any type that
    sorts, a null doc_id is kept. Of several overlaps with an item the accepted
    one with most equal tokens is reported, then the shortest, then the first;
    stretches of the best score come before others. Empty tables give an empty
    table; other columns aren't read.
    """
    spark = docs.sparkSession
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    items = items.mapInArrow(_tokenize, f"item_id {kind(benchmark, 'item_id')}, tokens array<long>").filter(F.size("tokens") > 0).groupBy("tokens").agg(F.min("item_id").alias("item_id"))
    items, _ = scratch.write(items.select(F.xxhash64("tokens").alias("item"), "item_id", "tokens"), "items")
    item_seeds, _ = scratch.write(items.mapInArrow(_item_seeds, "seed long, item long, at int").distinct(), "item-seeds")
    passes, few = seed_filter(item_seeds, items)
    hits, schema = _hits(spark.sparkContext.broadcast(passes), kind(docs, "doc_id"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").filter("text is not null")
    found, _ = scratch.write(texts.mapInArrow(hits, schema).dropDuplicates(["doc_id", "text_hash"]), "hits")
    asked = found.select("doc_id", "text_hash", F.explode(F.arrays_zip("seed", "at")).alias("hit")).select("doc_id", "text_hash", F.col("hit.seed").alias("seed"), F.col("hit.at").alias("doc_at"))
    if few:
        met = asked.join(F.broadcast(item_seeds), "seed")
    else:  # a seed that very many texts have is dealt over SALTS tasks
        salted = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    pairs = met.groupBy("doc_id", "text_hash", "item").agg(F.collect_set(F.col("doc_at") - F.col("at")).alias("diagonals"))
    same = pairs["doc_id"].eqNullSafe(found["doc_id"]) & (pairs["text_hash"] == found["text_hash"])
    both = pairs.join(found.select("doc_id", "text_hash", "tokens"), same).select(pairs["doc_id"], pairs["text_hash"], "item", "diagonals", "tokens")
    named = items.withColumnRenamed("tokens", "item_tokens")
    both = both.join(F.broadcast(named) if few else named, "item")  # an item has at least a seed
    verify = F.pandas_udf(_verify, "start int, aligned int, equal int, accepted boolean").asNondeterministic()
    return both.select("doc_id", "text_hash", "item_id", verify("tokens", "item_tokens", "diagonals").alias("o")).filter("o.accepted").select("doc_id", "text_hash", "item_id", "o.start", "o.aligned", "o.equal")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows that contamination() reports; all its columns and repeated rows stay, rows that match nothing too."""
    bad, _ = scratch.write(contamination(docs, benchmark, scratch).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs["text"]) == bad["__bad_hash"]), "left_anti")
