"""Near-duplicates by b-bit MinHash.

A document is the set of its different 4-word shingles. 128 minima of the set
are taken; they name its place in 32 bands of 4 minima each, and of each minimum
the low 2 bits are kept, packed into bit planes. Documents that share a band
are compared by these planes alone: two minima agree where no plane differs, so
a bit count gives the agreements, and as unequal minima agree in a quarter of
cases too, the similarity s is estimated by (share - 1/4) / (3/4). A pair at 0.8
fails to share any band in 5 of 10^8 cases, and FEWEST is set so that the
estimate turns it away in one of 10^6.

What remains joins documents into groups of candidates, of which spanning
forests are kept, not pairs. Within a group full sets are compared, in blocks
of bounded size, unless both documents are linked already: what comes out is a
spanning forest of true links. Documents of equal sets are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_hot
from .components import components

SHINGLE = 4
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 2
PLANES = HASHES * BITS // 64
PERCENT = 80
BLOCK = 1024
"""Documents of a band that are compared with as many others in one task."""
VERIFY_DOCUMENTS, VERIFY_SHINGLES = 512, 1 << 20
"""Documents and shingles (about) of a block whose full sets are compared in one task. A longer document has a block of its own."""
CHUNK = 1 << 16
SLOTS = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(12).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(13).integers(0, 1 << 63, BANDS * ROWS, np.uint64).reshape(BANDS, ROWS) * np.uint64(2) + np.uint64(1)


def fewest(percent: int = PERCENT, miss: float = 1e-6) -> int:
    """Agreements of HASHES minima that a pair of that similarity falls short of with a chance of at most ``miss``."""
    p = percent / 100 + (1 - percent / 100) / 2**BITS
    below = 0.0
    for k in range(HASHES):
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > miss:
            return k
    return HASHES


FEWEST = fewest()


def shingles(text: str | None) -> np.ndarray:
    """XXH64 of the different shingles of lower-cased words, sorted; the whole sequence where words are fewer; empty without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE])) for i in range(n)), np.uint64, n))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima, 32 bits each, of each non-empty set."""
    out = np.full((len(sets), HASHES), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CHUNK):
            size, end = size + len(sets[end]), end + 1
        if size > CHUNK:  # one long document, a piece at a time
            for i in range(0, size, CHUNK):
                _lower(out[at:end], sets[at][i : i + CHUNK], np.zeros(1, np.int64))
        else:
            _lower(out[at:end], np.concatenate(sets[at:end]), np.cumsum([0, *(len(s) for s in sets[at : end - 1])]))
        at = end
    return (out >> np.uint64(32)).astype(np.uint32)


def _lower(out: np.ndarray, values: np.ndarray, starts: np.ndarray) -> None:
    buffer = np.empty_like(values)
    for k, odd in enumerate(_ODD):
        np.multiply(values, odd, out=buffer)
        np.minimum(out[:, k], np.minimum.reduceat(buffer, starts), out=out[:, k])


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of minima as bit planes of 64-bit words: plane 0 of all minima, then plane 1."""
    planes = [np.packbits(((low >> b) & 1).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, 1)).view(np.uint64)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two lists of packed signatures, how many minima agree in all kept bits, row by row."""
    x = a ^ b
    words = PLANES // BITS
    differ = x[:, :words]
    for k in range(1, BITS):
        differ = differ | x[:, k * words : (k + 1) * words]
    return HASHES - np.bitwise_count(differ).sum(1, dtype=np.int64)


def similarity(agreeing: np.ndarray) -> np.ndarray:
    """The similarity that so many agreements tell, less what agrees by chance."""
    chance = 1 / 2**BITS
    return (agreeing / HASHES - chance) / (1 - chance)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text_hash, text) to (key, text_hash, n_shingles, set_id, sig, bands); the last three null without words."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            ids, sigs, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if some:
                low = minima([sets[i] for i in some])
                keys = (low.reshape(-1, BANDS, ROWS).astype(np.uint64) * _MIX).sum(2, dtype=np.uint64) + _MIX[:, 0]
                keys = (keys ^ (keys >> np.uint64(29))) * _MIX[0, 0]
                keys ^= keys >> np.uint64(32)
                for i, sig, key in zip(some, packed(low), keys.astype(np.int64), strict=True):
                    ids[i], sigs[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), sig.astype(np.int64), key
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                ["key", "text_hash", "n_shingles", "set_id", "sig", "bands"],
            )


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows that arrive sorted by ``names`` as tables of whole groups, many small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if held:
            last = np.array([held[-1].column(n)[-1].as_py() for n in names])
            new = np.concatenate([[0], new]) if (last != keys[0]).any() else new
        if len(new):
            cut = int(new[-1])  # the last group may go on in the next batch
            if (done := [*held, batch.slice(0, cut)])[0].num_rows or held:
                yield pa.Table.from_batches(done)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j) to spanning forests of the pairs that the packed bits let through."""
    for table in groups_of(batches, ["key", "i", "j"]):
        col = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "side", "node")}
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, PLANES).view(np.uint64)
        keys = np.stack([col["key"], col["i"], col["j"]], 1)
        group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(1)]))
        crossing, side, node = col["i"] != col["j"], col["side"], col["node"]
        at, d, label, found = np.arange(len(node)), 0, np.arange(len(node)), []
        while len(at):  # row r with row r + d of its group, for d = 1, 2, ...
            d += 1
            at = at[at + d < len(node)]
            at = at[group[at] == group[at + d]]
            ok = at[(agreements(sig[at], sig[at + d]) >= FEWEST) & (~crossing[at] | (side[at] != side[at + d]))]
            found.append((ok, ok + d))
            if sum(len(f[0]) for f in found) > 1 << 20:
                label, found = settle(label, found), []
        label = settle(label, found)
        moved = np.flatnonzero(node != node[label])
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], schema=_EDGES)


def settle(label: np.ndarray, found: list) -> np.ndarray:
    """Labels after merging along links: minimum label passing with pointer jumping."""
    if not found:
        return label
    u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, a, b) to spanning forests of true links: full sets of pairs that aren't linked yet, the likeliest first."""
    for table in groups_of(batches, ["cluster", "a", "b"]):
        keys = np.stack([table.column(c).to_numpy() for c in ("cluster", "a", "b")], 1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        edges: list[tuple[int, int]] = []
        for lo, hi in zip(starts, starts[1:], strict=False):
            edges += _verified(table.slice(lo, hi - lo), crossing=keys[lo, 1] != keys[lo, 2])
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=_EDGES)


def _verified(group: pa.Table, crossing: bool) -> list[tuple[int, int]]:
    sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, PLANES).view(np.uint64)
    own, node, size = (group.column(c).to_numpy() for c in ("own", "node", "n_shingles"))
    pairs = []
    for r in range(len(node) - 1):
        near = agreements(sig[r : r + 1], sig[r + 1 :])
        fits = (near >= FEWEST) & (100 * np.minimum(size[r], size[r + 1 :]) >= PERCENT * np.maximum(size[r], size[r + 1 :]))
        if crossing:
            fits &= own[r + 1 :] != own[r]
        other = np.flatnonzero(fits)
        pairs.append(np.stack([near[other], np.full(len(other), r), other + r + 1], 1))
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
    texts, sets, parent, edges = group.column("text"), {}, list(range(len(node))), []

    def full(i: int) -> set:
        if i not in sets:
            sets[i] = set(shingles(texts[i].as_py()).tolist())
        return sets[i]

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, x, y in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
        if (p := top(x)) != (q := top(y)):
            common = len(full(x) & full(y))
            if 100 * common >= PERCENT * (len(full(x)) + len(full(y)) - common):
                parent[max(p, q)] = min(p, q)
                edges.append((int(node[x]), int(node[y])))
    return edges


def candidate_groups(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of nodes that share a band with another and whose packed bits agree enough."""
    entries = nodes.select(F.explode("bands").alias("key"), "node", "sig")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared, _ = scratch.write(sizes.withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")).drop("k"), "shared-bands")
    met = entries.join(shared, "key").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), "blocks").cast("int"))
    # a row of block x goes to the pairs of blocks (x, x), (x, y) and (y, x)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("key", "node", "sig", "own", other).select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), F.col("own").cast("long").alias("side"), F.col("node").cast("long").alias("node"), "sig")
    edges = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_met, "a long, b long")
    return components(edges, scratch)


def true_links(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): a spanning forest of the links of each group. members: cluster, node, set_id, key, text_hash, n_shingles, sig.

    A group of more than a block is dealt by classes of size, of which only
    equal and adjacent ones can hold similar sets, and these by blocks.
    """
    size_class = F.floor(F.log("n_shingles") / math.log(1.3)).cast("int")  # 1.25, the most that sizes can differ, with room for rounding
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("s"))
    large, _ = scratch.write(whole.filter((F.col("k") > VERIFY_DOCUMENTS) | (F.col("s") > VERIFY_SHINGLES)).select("cluster"), "large-groups")
    columns = [F.col("cluster"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("own").cast("long").alias("own"), F.col("node"), F.col("set_id"), F.col("key"), F.col("text_hash"), F.col("n_shingles"), F.col("sig")]
    small = members.join(large, "cluster", "left_anti").withColumns({"a": F.lit(0), "b": F.lit(0), "own": F.lit(0)})
    classed, _ = scratch.write(members.join(large, "cluster").withColumn("class", size_class), "classed")
    units = classed.groupBy("cluster", "class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / VERIFY_DOCUMENTS), F.ceil(F.sum("n_shingles") / VERIFY_SHINGLES)).cast("int").alias("blocks"))
    units, _ = scratch.write(units, "units")
    beside = lambda step, name: units.select("cluster", (F.col("class") - step).alias("class"), F.col("blocks").alias(name))
    around = units.join(beside(1, "above"), ["cluster", "class"], "left").join(beside(-1, "below"), ["cluster", "class"], "left")
    place = lambda c, block: F.shiftleft(c.cast("long"), 32) + block
    cls, own = F.col("class"), F.col("own")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array())
    group = lambda n, a, b: F.transform(upto(F.coalesce(n, F.lit(0))), lambda x: F.struct(a(x).alias("a"), b(x).alias("b")))
    pairs = F.concat(
        group(F.col("blocks"), lambda x: place(cls, F.least(own, x)), lambda x: place(cls, F.greatest(own, x))),
        group(F.col("above"), lambda x: place(cls, own), lambda x: place(cls + 1, x)),
        group(F.col("below"), lambda x: place(cls - 1, x), lambda x: place(cls, own)),
    )
    dealt = classed.join(around, ["cluster", "class"]).withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    dealt = dealt.select("cluster", F.inline(pairs), place(cls, own).alias("own"), "node", "set_id", "key", "text_hash", "n_shingles", "sig")
    # most texts are in no group: those that can't be are left out where they are read, by a table of at most SLOTS numbers
    slot = F.pmod("text_hash", F.lit(SLOTS)).alias("slot")
    slots, _ = scratch.write(members.select(slot).distinct(), "slots")
    some = texts.join(F.broadcast(slots), F.pmod("text_hash", F.lit(SLOTS)) == F.col("slot"), "left_semi") if slots.count() < SLOTS // 2 else texts
    one = some.join(members.select("key", "text_hash"), ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"])
    one, _ = scratch.write(one, "texts")
    told = small.select(columns).unionByName(dealt.select(columns)).join(one, ["key", "text_hash"]).drop("key", "text_hash", "set_id")
    return told.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b").mapInArrow(_true, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text_hash, n_shingles, component) for each row of ``docs``: the smallest key reachable over links.

    Sets of at least PERCENT % common shingles are linked. Null, empty and
    wordless texts have 0 shingles, link with nothing and are their own
    component. A row with a null key has the component of rows with its set,
    null if none of them has a key. Rows of one key are one node. Repeated rows
    get equal results; an empty table gives an empty table; other columns
    aren't read. Keys are whole numbers.
    """
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    fields = [("key", docs.schema[key].dataType), ("text_hash", long), ("n_shingles", long), ("set_id", T.BinaryType()), ("sig", longs), ("bands", longs)]
    signed, _ = scratch.write(texts.mapInArrow(_signed, T.StructType([T.StructField(*f) for f in fields])), "signatures")
    rep = F.min(F.struct("key", "text_hash", "n_shingles", "sig", "bands")).alias("r")
    found = signed.filter("set_id is not null and key is not null").groupBy("set_id").agg(rep, F.count(F.lit(1)).alias("n"))
    nodes, _ = scratch.write(found.select("set_id", F.col("r.key").cast("long").alias("node"), "r.*", "n"), "nodes")
    grouped = candidate_groups(nodes, scratch)
    members, _ = scratch.write(nodes.join(grouped, "node").select(F.col("component").alias("cluster"), "node", "set_id", "key", "text_hash", "n_shingles", "sig"), "members")
    linked = components(true_links(members, texts, scratch), scratch)
    classes, _ = scratch.write(nodes.join(linked, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"), "n"), "classes")
    told = join_hot(signed.filter("set_id is not null").drop("sig", "bands"), classes, "set_id", scratch, how="left")
    alone = signed.filter("set_id is null").select("key", "text_hash", "n_shingles", F.col("key").cast("long").alias("component"))
    return told.select("key", "text_hash", "n_shingles", "component").unionByName(alone).withColumnRenamed("key", key)
