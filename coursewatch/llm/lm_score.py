"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

Each token is predicted from its neighbours on either side, itself left out:
position-wise embeddings of the neighbours are summed, go through tanh, and a
two-level softmax (class, word in class) gives the token's probability. The
logarithms, summed over a text, are its pseudo-likelihood.

Every word that occurs at least sqrt(N) times among all N words has a token of
its own, so the vocabulary follows the corpus' counts and has sqrt(N) words at
most. Any other word has the token of its longest prefix (up to PREFIX
characters) that so many of the other words share, and what follows the prefix
is spelled byte by byte, with probabilities counted over all such words. So no
two words are scored alike for want of a token, and a word's probability is the
network's times its spelling's. The network is trained in numpy on all
partitions at once: each starts from the shared weights, learns from its own
texts, and each row of the weights is averaged by how often it was used,
ROUNDS times. Every token is a target in exactly one round.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 3
DIM = 16
CLASSES = 32
VOCAB = CLASSES * CLASSES
"""Size of a network that isn't given one; id 0 is the edge of a text."""
LEAST_COUNT = 20
"""No word or prefix of fewer occurrences has a token, also in a small corpus."""
PREFIX = 3
ROUNDS = 2
STRIDE = ROUNDS
BATCH = 8192
RATE = 0.2
LOGIT = 40
"""Bound of logits, so that none overflows."""
COUNTED_WORDS = 300_000
BLOCK_FLOATS = 4096
FAN_IN = 16
"""Blocks of weights that are averaged in one group; more partitions make more levels."""

_OFFSETS = [k for k in range(-WINDOW, WINDOW + 1) if k]
_START = " "
"""Marks prefixes; no word holds white space. Alone it is the token of words without a known prefix."""
_TOKEN = np.dtype([("id", "<u4"), ("spelled", "<f8")])


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Speller:
    """Logarithms of the probabilities of each byte after each other; 0 begins and ends what is spelled."""

    def __init__(self, counts: np.ndarray):
        self.table = np.log((counts + 1) / (counts.sum(1, keepdims=True) + 256))


def token_of(word: str, ids: dict[str, int]) -> tuple[int, bytes]:
    """A word's id, and what is left to spell: the last byte of its prefix and the rest; nothing for words with an id."""
    if (own := ids.get(word)) is not None:
        return own, b""
    marked, raw = _START + word, word.encode("utf-8", "surrogatepass")
    plain = len(raw) == len(word)
    for n in range(min(PREFIX, len(word)), 0, -1):
        if (i := ids.get(marked[: n + 1])) is not None:
            return i, raw[(n if plain else len(word[:n].encode("utf-8", "surrogatepass"))) - 1 :]
    return ids[_START], b"\0" + raw


class Tokens:
    """token_of() with its spelling for many words at once: prefixes and bytes are looked up in arrays, nothing is kept between calls."""

    def __init__(self, ids: dict[str, int], speller: Speller):
        self.ids, self.table = ids, speller.table.ravel()
        # prefixes by their code points, the longest first
        known = [(w[1:], i) for w, i in ids.items() if w.startswith(_START) and len(w) > 1]
        self.prefixes = []
        for n in range(PREFIX, 0, -1):
            keys = sorted((sum(ord(c) << 21 * (PREFIX - 1 - k) for k, c in enumerate(p)), i) for p, i in known if len(p) == n)
            self.prefixes.append((n, np.array([k for k, _ in keys] or [-1], np.int64), np.array([i for _, i in keys] or [0], np.int64)))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """_TOKEN of each word of each text."""
        words = [w for t in texts for w in t]
        found = np.zeros(len(words), _TOKEN)
        found["id"] = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        at = np.flatnonzero(found["id"] == 0)
        if len(at):
            found["id"][at], found["spelled"][at] = self._spelled([words[k] for k in at.tolist()])
        return np.split(found, np.cumsum([len(t) for t in texts])[:-1]) if texts else []

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size  # in characters, a 0 before each word
        text = "\0" + "\0".join(words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        stop = np.cumsum(width) - 1  # last byte of each character
        code = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
        steps = np.append(self.table[(code[:-1] << 8) | code[1:]], 0.0)  # from each byte to the next
        ids, length = np.full(len(words), self.ids[_START], np.int64), np.zeros(len(words), np.int64)
        left = np.arange(len(words))
        for n, keys, values in self.prefixes:
            left = left[size[left] >= n] if n > 1 else np.flatnonzero(length == 0)
            key = sum(points[start[left] + k] << 21 * (PREFIX - 1 - k) for k in range(n))
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            ids[left[hit]], length[left[hit]] = values[place[hit]], n
            left = np.flatnonzero(length == 0)
        spans = np.stack([stop[start - 1 + length], stop[start + size]], 1).ravel()
        return ids, np.add.reduceat(steps, spans)[::2]


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def vocabulary(docs: DataFrame, scratch: Scratch) -> tuple[list[str], Speller]:
    """Tokens by falling counts, the bare start mark last, and the speller; counted per task, summed by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(words_of(t))
                if len(c) > COUNTED_WORDS:
                    yield _counts(c)
                    c.clear()
        yield _counts(c)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: dict = defaultdict(int)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for end in range(1, min(PREFIX, len(w)) + 1):
                    c[_START + w[:end]] += n
        yield _counts(c)

    schema = "word string, n long"
    counts, _ = scratch.write(docs.select("text").mapInArrow(counted, schema).groupBy("word").agg(F.sum("n").alias("n")), "words")
    least = max(LEAST_COUNT, math.isqrt(counts.agg(F.sum("n")).first()[0] or 0))
    rare = counts.filter(F.col("n") < least)
    parts = rare.mapInArrow(prefixes, schema).groupBy("word").agg(F.sum("n").alias("n"))
    kept = counts.union(parts).filter(F.col("n") >= least)  # of each kind sqrt(N) at most, times PREFIX for prefixes
    known = [r["word"] for r in sorted(kept.collect(), key=lambda r: (-r["n"], r["word"]))] + [_START]
    ids = docs.sparkSession.sparkContext.broadcast({w: i + 1 for i, w in enumerate(known)})

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.float64)
        for b in batches:
            rests = [token_of(w, ids.value)[1] for w in b.column(0).to_pylist()]
            size = np.fromiter(map(len, rests), np.int64, len(rests))
            codes = np.frombuffer(b"\0".join(rests) + b"\0", np.uint8).astype(np.int64)
            weight = np.repeat(b.column(1).to_numpy().astype(np.float64), size + 1)
            weight[np.cumsum(size + 1) - 1] = 0
            total += np.bincount((codes[:-1] << 8) | codes[1:], weight[:-1], 1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"step": pa.array(at, pa.int64()), "n": pa.array(total[at].astype(np.int64))})

    pairs = np.zeros(1 << 16)
    for r in rare.mapInArrow(steps, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():  # 65,536 at most
        pairs[r["step"]] = r["n"]
    return known, Speller(pairs.reshape(256, 256))


def _counts(c: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})


@dataclass
class Network:
    """embed: offsets x size x DIM; hidden: DIM; to_class: DIM + 1 rows; to_word: classes x (DIM + 1) x words in a class."""

    embed: np.ndarray
    hidden: np.ndarray
    to_class: np.ndarray
    to_word: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 1, size: int = VOCAB) -> Network:
        rng = np.random.default_rng(seed)
        width = math.isqrt(size - 1) + 1
        some = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(some(len(_OFFSETS), size, DIM), np.zeros(DIM, np.float32), some(DIM + 1, width), some(width, DIM + 1, width))

    def copy(self) -> Network:
        return Network(*(getattr(self, f.name).copy() for f in fields(self)))

    @property
    def width(self) -> int:
        return self.to_word.shape[2]

    def rows(self) -> list[np.ndarray]:
        """Each weight array as rows that are averaged apart: of embed one for each id, of to_word one for each class."""
        return [self.embed.transpose(1, 0, 2).reshape(self.embed.shape[1], -1), self.hidden[None], self.to_class.reshape(1, -1), self.to_word.reshape(len(self.to_word), -1)]

    def with_rows(self, rows: list[np.ndarray]) -> Network:
        offsets, size, dim = self.embed.shape
        embed = np.ascontiguousarray(rows[0].reshape(size, offsets, dim).transpose(1, 0, 2))
        return Network(embed, rows[1].reshape(self.hidden.shape), rows[2].reshape(self.to_class.shape), rows[3].reshape(self.to_word.shape))

    def _hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.tile(self.hidden, (len(at), 1))
        for k, o in enumerate(_OFFSETS):
            total += self.embed[k][ids[at + o]]
        return np.tanh(total)

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithm of each target's probability; ids has WINDOW edges at either end."""
        out, ones = np.empty(len(at), np.float32), np.ones(self.width, np.float32)
        for lo in range(0, len(at), BATCH):
            h, cls, word, order, cut = self._by_class(ids, at[lo : lo + BATCH])
            z = np.clip(h @ self.to_class, -LOGIT, LOGIT)
            lp = z[np.arange(len(h)), cls] - np.log(np.exp(z) @ ones)
            for c in np.flatnonzero(np.diff(cut)):
                i = slice(cut[c], cut[c + 1])
                y = np.clip(h[i] @ self.to_word[c], -LOGIT, LOGIT)
                lp[i] += y[np.arange(len(y)), word[i]] - np.log(np.exp(y) @ ones)
            out[lo + order] = lp
        return out

    def _by_class(self, ids: np.ndarray, at: np.ndarray) -> tuple:
        """Hidden values with a one, classes, words in their class, in order of class; the order; where each class begins."""
        target = ids[at].astype(np.int64)
        cls = target // self.width
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        h = np.ones((len(at), DIM + 1), np.float32)
        h[:, :-1] = self._hidden(ids, at[order])
        cls = cls[order]
        return h, cls, target[order] % self.width, order, np.searchsorted(cls, np.arange(self.width + 1))

    def learn(self, ids: np.ndarray, at: np.ndarray, squares: list[np.ndarray]) -> None:
        """One Adagrad step on the targets."""
        h1, cls, word, order, cut = self._by_class(ids, at)
        at, ones = at[order], np.ones(self.width, np.float32)
        scale = np.float32(1 / len(at))
        s_embed, s_hidden, s_class, s_word = squares

        def step(grad: np.ndarray, s: np.ndarray) -> np.ndarray:
            grad = grad * scale
            s += grad * grad
            return RATE * grad / (np.sqrt(s) + 1e-6)

        z = np.exp(np.clip(h1 @ self.to_class, -LOGIT, LOGIT))
        z /= (z @ ones)[:, None]
        z[np.arange(len(at)), cls] -= 1
        gh = z @ self.to_class[:-1].T
        self.to_class -= step(h1.T @ z, s_class)
        for c in np.flatnonzero(np.diff(cut)):
            i = slice(cut[c], cut[c + 1])
            y = np.exp(np.clip(h1[i] @ self.to_word[c], -LOGIT, LOGIT))
            y /= (y @ ones)[:, None]
            y[np.arange(len(y)), word[i]] -= 1
            gh[i] += y @ self.to_word[c, :-1].T
            self.to_word[c] -= step(h1[i].T @ y, s_word[c])
        h = h1[:, :-1]
        g = (gh * (1 - h * h)).astype(np.float32)
        for k, o in enumerate(_OFFSETS):
            near = ids[at + o]
            order = np.argsort(near, kind="stable")
            near = near[order]
            first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
            seen, s = near[first], s_embed[k][near[first]]
            self.embed[k][seen] -= step(np.add.reduceat(g[order], first), s)
            s_embed[k][seen] = s
        self.hidden -= step(g.sum(0), s_hidden)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids with edges between the texts; positions of the tokens; where each text's tokens begin."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    ids = np.zeros(int(size.sum()) + WINDOW * (len(texts) + 1), max((t.dtype for t in texts), key=lambda d: d.itemsize, default=np.dtype(np.uint16)))
    at = np.arange(int(size.sum())) + WINDOW * (np.repeat(np.arange(len(texts)), size) + 1)
    if len(at):
        ids[at] = np.concatenate(texts)
    return ids, at, start


def train(encoded: DataFrame, start: Network) -> Network:
    """ROUNDS rounds of training on every partition; each row of the weights is averaged by its uses."""
    spark, net, tasks = encoded.sparkSession, start, encoded.rdd.getNumPartitions()
    dtype, schema = id_type(net.embed.shape[1]), "part int, at int, branch int, n binary, x binary"
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net)

        def local(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            own = shared.value.copy()
            squares, kept = [np.full_like(getattr(own, f.name), 1e-6) for f in fields(own)], []
            size, width = own.embed.shape[1], own.width
            near, classes = np.zeros(size, np.int64), np.zeros(width, np.int64)
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    texts = [np.frombuffer(x, dtype) for x in b.column("ids").slice(lo, 512).to_pylist()]
                    ids, at, first = joined(texts)
                    shift = np.repeat([zlib.crc32(t.tobytes()) for t in texts], [len(t) for t in texts])
                    at = at[(np.arange(len(at)) - np.repeat(first, [len(t) for t in texts]) + shift) % STRIDE == r * (STRIDE // ROUNDS)]
                    for o in _OFFSETS:
                        near += np.bincount(ids[at + o], minlength=size)
                    classes += np.bincount(ids[at] // width, minlength=width)
                    kept.append((ids, at))
                    if sum(len(k[1]) for k in kept) >= BATCH:
                        _step(own, kept, squares)
                        kept = []
            _step(own, kept, squares)
            if n := int(classes.sum()):
                branch = (TaskContext.get().partitionId() if TaskContext.get() else 0) // FAN_IN
                for part, (x, uses) in enumerate(zip(own.rows(), (near, np.array([n]), np.array([n]), classes), strict=True)):
                    high = max(1, BLOCK_FLOATS // x.shape[1])
                    cuts = [c for c in range(0, len(x), high) if uses[c : c + high].any()]
                    for lo in range(0, len(cuts), 256):
                        some = cuts[lo : lo + 256]
                        yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([branch] * len(some), pa.int32()), pa.array([uses[c : c + high].tobytes() for c in some], pa.binary()), pa.array([x[c : c + high].tobytes() for c in some], pa.binary())], names=["part", "at", "branch", "n", "x"])

        def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
            total, uses = 0.0, 0
            for x, n in sorted(zip(pdf["x"], pdf["n"], strict=True)):
                n = np.frombuffer(n, np.int64)
                total, uses = total + np.frombuffer(x, np.float32).reshape(len(n), -1).astype(np.float64) * n[:, None], uses + n
            mean = (total / np.maximum(uses, 1)[:, None]).astype(np.float32)
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "at": [pdf["at"].iloc[0]], "branch": [pdf["branch"].iloc[0] // FAN_IN], "n": [uses.tobytes()], "x": [mean.tobytes()]})

        blocks = encoded.select("ids").mapInArrow(local, schema)
        for _ in range(max(1, math.ceil(math.log(max(2, tasks), FAN_IN)))):  # a tree of fixed fan-in
            blocks = blocks.groupBy("part", "at", "branch").applyInPandas(averaged, schema)
        rows = [x.copy() for x in net.rows()]
        for b in blocks.collect():  # the weights, once
            n = np.frombuffer(b["n"], np.int64)
            used, x = np.flatnonzero(n), np.frombuffer(b["x"], np.float32).reshape(len(n), -1)
            rows[b["part"]][b["at"] + used] = x[used]
        net = net.with_rows(rows)
    return net


def _step(net: Network, kept: list, squares: list) -> int:
    if not kept:
        return 0
    shift = np.cumsum([0, *(len(i) for i, _ in kept)])[:-1]
    ids = np.concatenate([i for i, _ in kept])
    at = np.concatenate([a + s for (_, a), s in zip(kept, shift, strict=True)])
    for lo in range(0, len(at), BATCH):
        net.learn(ids, at[lo : lo + BATCH], squares)
    return len(at)


def score(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, sum_logprob, mean_logprob) of each row of ``docs``, whole texts.

    Null, empty and wordless texts have 0 words, sum 0 and a null mean, which
    is a word's. Repeated rows get equal scores, up to rounding; columns named
    alike are no matter; a null key is kept; an empty table gives an empty table;
    other columns aren't read.
    """
    docs = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    spark = docs.sparkSession
    known, speller = vocabulary(docs, scratch)
    dtype = id_type(len(known) + 1)
    shared = spark.sparkContext.broadcast(({w: i + 1 for i, w in enumerate(known)}, speller))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(*shared.value)
        for texts in batches:
            for lo in range(0, max(1, len(texts)), 256):
                found = tokens.of([words_of(t) for t in texts.iloc[lo : lo + 256]])
                done = pd.DataFrame({"n_words": np.array([len(x) for x in found], np.int64), "spelled": np.array([x["spelled"].sum() for x in found], np.float64), "ids": [x["id"].astype(dtype).tobytes() for x in found]})
                whole = done if lo == 0 else pd.concat([whole, done], ignore_index=True)
            yield whole

    encoded = docs.select(key, F.pandas_udf(encode, "n_words long, spelled double, ids binary").asNondeterministic()("text").alias("e")).select(key, "e.n_words", "e.spelled", "e.ids")
    encoded, _ = scratch.write(encoded, "ids")
    model = spark.sparkContext.broadcast(train(encoded, Network.fresh(size=len(known) + 1)))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for all_ in batches:
            out = [np.zeros(0)]
            for lo in range(0, len(all_), 256):
                texts = [np.frombuffer(x, dtype) for x in all_.iloc[lo : lo + 256]]
                words, at, start = joined(texts)
                sums = np.concatenate([[0], np.cumsum(model.value.log_probs(words, at), dtype=np.float64)])
                size = np.array([len(t) for t in texts], np.int64)
                out.append(sums[start + size] - sums[start])
            yield pd.Series(np.concatenate(out))

    s = encoded.select(key, "n_words", (F.pandas_udf(scored, "double").asNondeterministic()("ids") + F.col("spelled")).alias("sum_logprob"))
    return s.select(key, "n_words", "sum_logprob", F.when(F.col("n_words") > 0, F.col("sum_logprob") / F.col("n_words")).alias("mean_logprob"))
