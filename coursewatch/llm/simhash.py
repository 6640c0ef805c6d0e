"""SimHash near-duplicates over a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of
their 8 bytes, so they share at least 4 positional bytes. A posting for each
(position, byte) would hold a 256th of the corpus and every pair in it, so
postings are kept for triples of positions instead: 20 of the 56 triples
suffice for every set of 4 shared positions to contain one (the Turan system
T(8, 4, 3)). Fingerprints that meet in a posting are tallied on all 8
positions, pairs under the guaranteed minimum of 4 are left out, the rest are
verified by their differing bits. A posting of very many fingerprints is cut by
a fourth position: those that share 4 share one of the other 5, so they meet in
one of its 5 x 256 parts. Parts that are still large are cut into blocks that
are compared pair by pair of blocks, each within one bounded task, and a block
pair returns a spanning forest of its links rather than the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS
BLOCK = 1024
"""Fingerprints of a posting that are compared in one task with as many others."""

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def triples() -> list[tuple[int, int, int]]:
    """T(8, 4, 3): positions are dealt into three parts; triples within a part, or two of a part and one of the next."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    return [t for t in combinations(range(8), 3) if len(p := {part[i] for i in t}) == 1 or (len(p) == 2 and _leans(sorted(part[i] for i in t)))]


def _leans(parts: list[int]) -> bool:
    twice = parts[1]
    once = parts[0] if parts[0] != twice else parts[2]
    return once == (twice + 1) % 3


TRIPLES = triples()


def fingerprint(text: str | None) -> int:
    """64 bits, each set where over half of the shingles' XXH64 have it; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip([0, *ends[: n - 1]], (e - 1 for e in ends[len(words) - n :]), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``df`` with the signed 64-bit fingerprint of the whole text; null and wordless texts get 0."""
    return df.withColumn(out, F.pandas_udf(_fingerprints, "long").asNondeterministic()(F.col(text)))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j) to the spanning forests of the links in each group."""
    held: list[np.ndarray] = []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forest(rows: np.ndarray) -> pa.RecordBatch:
        edges = _forest(rows)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=schema)

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "fp", "node")], 1)
        if held:
            rows = np.concatenate([*held, rows])
        if not len(rows):
            continue
        last = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
        if cut:
            yield forest(rows[:cut])
        held = [rows[cut:]]
    if held and len(held[0]):
        yield forest(held[0])


def _forest(rows: np.ndarray) -> np.ndarray:
    """Links between rows of equal (key, i, j), reduced to a star for each connected set of a group.

    Row r is compared with row r + d of its group for d = 1, 2, ... until no
    group is that long, so that many small groups cost as few steps as one.
    """
    group = np.cumsum(np.concatenate([[0], (rows[1:, :3] != rows[:-1, :3]).any(1)]))
    fp, node = rows[:, 4].astype(np.uint64), rows[:, 5]
    crossing = rows[:, 1] != rows[:, 2]  # two blocks: within each, pairs are compared elsewhere
    side = rows[:, 3]
    label = np.arange(len(rows))
    at, d, found = np.arange(len(rows)), 0, []
    while len(at):
        d += 1
        at = at[at + d < len(rows)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + d]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        ok = (shared >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS) & (~crossing[at] | (side[at] != side[at + d]))
        if ok.any():
            found.append((at[ok], at[ok] + d))
        if sum(len(f[0]) for f in found) > 1 << 20:
            label, found = _settle(label, found), []
    label = _settle(label, found)
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return np.stack([node[moved], node[label[moved]]], 1) if len(moved) else np.zeros((0, 2), np.int64)


def _settle(label: np.ndarray, found: list) -> np.ndarray:
    """Labels after merging along links: minimum label passing with pointer jumping."""
    if not found:
        return label
    u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    while True:
        lu, lv = label[u], label[v]
        low, high = np.minimum(lu, lv), np.maximum(lu, lv)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text_hash, fp, component) for each row of ``docs``: the smallest key reachable over links of at most MAX_BITS bits.

    Rows of equal fingerprints are one node, named by its smallest key, so a
    group of copies costs one row from there on. A row with a null key keeps
    its fingerprint and gets the component of rows with that fingerprint, null
    if none of them has a key. Null, empty and wordless texts share
    fingerprint 0 and are linked like any other. Repeated rows get equal
    results; an empty table gives an empty table; other columns aren't read.
    """
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    printed, _ = scratch.write(with_fingerprint(texts).select("key", "text_hash", "fp"), "fingerprints")
    nodes, _ = scratch.write(printed.groupBy("fp").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    byte = lambda i: F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(F.lit(255))
    posting = F.explode(F.array(*[sum((byte(p) * F.lit(1 << 8 * k) for k, p in enumerate(t)), F.lit(n << 24).cast("long")) for n, t in enumerate(TRIPLES)]))
    entries = nodes.filter("node is not null").select(posting.alias("key"), "fp", "node")
    # only postings of more than a block are looked up: at most a BLOCK-th of the entries
    sizes = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    large, _ = scratch.write(sizes(entries), "large-postings")
    met = entries.join(large, "key", "left_anti").withColumns({"blocks": F.lit(1), "own": F.lit(0)})
    # the other 5 positions of a large posting's triple, each with its byte
    others = F.get(F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in t]) for t in TRIPLES]), F.shiftright("key", 24).cast("int"))
    bytes_ = F.array(*[byte(p) for p in range(8)])
    parts = entries.join(large, "key", "left_semi").withColumn("bytes", bytes_).select("key", "fp", "node", "bytes", F.explode(others).alias("p")).select(F.xxhash64("key", "p", F.get("bytes", F.col("p"))).alias("key"), "fp", "node")
    parts, _ = scratch.write(parts, "parts")
    heavy, _ = scratch.write(sizes(parts), "large-parts")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
    cut = parts.join(heavy, "key", "left").select("key", "fp", "node", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(1), "fp"), blocks).cast("int").alias("own"))
    met = met.select("key", "fp", "node", "blocks", "own").unionByName(cut)
    # a row of block x goes to the pairs of blocks (x, x), (x, y) and (y, x)
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("key", "fp", "node", "own", pairs).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "fp", "node")
    cast = [F.col(c).cast("long").alias(c) for c in ("key", "i", "j", "side", "fp", "node")]
    sorted_ = dealt.select(*cast).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    edges = sorted_.mapInArrow(_links, "a long, b long")
    found = components(edges, scratch)
    classes, _ = scratch.write(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "n"), "classes")
    return join_hot(printed, classes, "fp", scratch).select(F.col("key").alias(key), "text_hash", "fp", "component")
