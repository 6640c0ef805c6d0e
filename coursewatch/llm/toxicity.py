"""Toxicity: averaged subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, so a
misspelling that training never saw shares most vectors with the word. The
linear layer gives a word's difference of logits, a text has the mean of its
WORST worst words, and the softmax over that is the text's score. The mean over
all words of a text, the plain form, flags clean texts: a few insults among a
thousand words weigh so little in it that it must learn huge weights, and odd
words of clean texts then reach them (figures in the README).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

SAMPLE_ROWS = 1500
"""Labelled rows of each label that a model is fitted on, at most (about)."""
BITS = 17
DIM = 8
NGRAMS = (3, 4, 5)
WORST = 3
"""So many words, the worst ones with repeats, decide (all of a text with fewer)."""
STEPS = 80
WARM_STEPS = 8
"""The first steps weigh all words of a text, worse ones more: what is worst isn't known yet."""
WARM_SHARPNESS = 0.5
RATE = 0.1
DECAY = 1e-3
LEAST_TEXTS = 8
"""Features seen in fewer training texts stay zero: they would be learned by heart."""
TOXIC_WEIGHT = 0.2
"""Share of the loss that toxic texts have, whatever their share of the sample."""
CACHE_WORDS = 250_000
EDGE = "\"'.,;:!?()[]{}<>|«»“”„…-–—*_~`"

_P, _C = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word index of every feature of the words: n-grams of <word>, and the word as a whole."""
    marked = [f"<{w.strip(EDGE) or w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * _P + codes[n - 1 :]
        if n in NGRAMS:
            inside = owner[:m] == owner[n - 1 :]
            buckets.append(((rolled[inside] + np.uint64(n)) * _C) >> np.uint64(64 - BITS))
            owners.append(owner[:m][inside])
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _P, np.uint64))
    whole = np.add.reduceat(codes * powers[np.arange(len(codes)) - np.repeat(starts, sizes)], starts) if len(words) else np.zeros(0, np.uint64)
    buckets.append((whole * _C) >> np.uint64(64 - BITS))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """embeddings: buckets x DIM; softmax: DIM x 2; bias: 2."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def word_logits(self, words: list[str], pull: np.ndarray) -> np.ndarray:
        """Averaging and the linear layer commute: each word adds its own difference of logits."""
        bucket, owner = subwords(words)
        return np.bincount(owner, pull[bucket], len(words)) / np.bincount(owner, minlength=len(words))

    def scorer(self):
        """A function from a list of texts to their scores, with a bounded cache of words."""
        pull = (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)
        bias = float(self.bias[1] - self.bias[0])
        cache: dict[str, float] = {}

        def score(texts: list[str | None]) -> np.ndarray:
            docs = [words_of(t) for t in texts]
            if len(cache) > CACHE_WORDS:
                cache.clear()
            fresh = list({w for d in docs for w in d if w not in cache})
            if fresh:
                cache.update(zip(fresh, self.word_logits(fresh, pull).tolist(), strict=True))
            out = np.empty(len(docs))
            for i, d in enumerate(docs):
                z = bias
                if d:
                    x = np.fromiter(map(cache.__getitem__, d), np.float64, len(d))
                    z += float((np.partition(x, -WORST)[-WORST:] if len(x) > WORST else x).mean())
                out[i] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            return out

        return score


def _common_features(words: list[str], texts_of: np.ndarray, part: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and owners of the features that enough texts have; and how many each word has in all."""
    counts, per_word = np.zeros(1 << BITS), np.zeros(len(words))
    for lo in range(0, len(words), part):
        bucket, owner = subwords(words[lo : lo + part])
        counts += np.bincount(bucket, texts_of[lo + owner], 1 << BITS)
        per_word[lo : lo + part] = np.bincount(owner, minlength=len(words[lo : lo + part]))
    kept = []
    for lo in range(0, len(words), part):
        bucket, owner = subwords(words[lo : lo + part])
        common = counts[bucket] >= LEAST_TEXTS
        kept.append((bucket[common].astype(np.int32), (owner[common] + lo).astype(np.int32)))
    return np.concatenate([b for b, _ in kept]), np.concatenate([o for _, o in kept]), per_word


def _share(d: np.ndarray, doc_of: np.ndarray, doc_at: np.ndarray, warm: bool) -> tuple[np.ndarray, float]:
    """What each word counts for in its text, and how sharply that depends on d."""
    if warm:
        a = np.exp(WARM_SHARPNESS * (d - np.maximum.reduceat(d, doc_at)[doc_of]))
        return a / np.add.reduceat(a, doc_at)[doc_of], WARM_SHARPNESS
    a, left = np.zeros(len(d)), d.copy()
    each = 1 / np.minimum(WORST, np.diff(np.append(doc_at, len(d))))
    for _ in range(WORST):  # the worst that is left in each text, the first of equal ones
        top = np.flatnonzero(left == np.maximum.reduceat(left, doc_at)[doc_of])
        doc, first = np.unique(doc_of[top], return_index=True)
        a[top[first]] = each[doc]
        left[top[first]] = -np.inf
    return a, 0.0


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Full-batch Adam over embeddings and softmax together. Without both labels, the model always says their share.

    Averaging and the linear layer commute, so a step passes one number for
    each feature and word forth and back, and vectors only for buckets.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    prior = np.array([0, np.log(share / (1 - share)) if 0 < share < 1 else -9.0], np.float32)
    if len(y) == 0 or y.min() == y.max() or not any(map(words_of, texts)):
        return Model(np.zeros((1 << BITS, DIM), np.float32), np.zeros((DIM, 2), np.float32), prior)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)] or [index.setdefault("", len(index))], np.int32) for t in texts]
    vocabulary = list(index)
    texts_of = np.zeros(len(index), np.int64)
    for d in docs:
        texts_of[np.unique(d)] += 1
    bucket, owner, per_word = _common_features(vocabulary, texts_of)
    used, local = np.unique(bucket, return_inverse=True)
    local = local.astype(np.int32)
    tokens = np.concatenate(docs)
    lengths = np.array([len(d) for d in docs])
    doc_at = np.cumsum(lengths) - lengths
    doc_of = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
    del docs, vocabulary, index, bucket
    weight = np.where(y == 1, TOXIC_WEIGHT / y.sum(), (1 - TOXIC_WEIGHT) / (1 - y).sum()).astype(np.float32)

    E = (rng.standard_normal((len(used), DIM)) * 0.1).astype(np.float32)
    U = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    b = np.zeros(2, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (E, U, b)]
    for step in range(1, STEPS + 1):
        u = U[:, 1] - U[:, 0]
        of_word = np.bincount(owner, (E @ u)[local], len(per_word)) / per_word
        d = of_word[tokens] + (b[1] - b[0])
        a, sharp = _share(d, doc_of, doc_at, step <= WARM_STEPS)
        pooled = np.add.reduceat(a * d, doc_at)
        p = 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))
        gd = (weight * (p - y))[doc_of] * a * (1 + sharp * (d - pooled[doc_of]))
        g_word = np.bincount(tokens, gd, len(per_word)) / per_word
        g = np.bincount(local, g_word[owner], len(used)).astype(np.float32)
        gE, gu = g[:, None] * u + DECAY * E / len(lengths), E.T @ g
        for param, grad, (m, v) in zip((E, U, b), (gE, np.stack([-gu, gu], 1), np.array([-gd.sum(), gd.sum()])), state, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((1 << BITS, DIM), np.float32)
    full[used] = E
    return Model(full, U, b)


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """A model from labelled documents, at most (about) SAMPLE_ROWS of each label, whole texts; ``learn`` limits which rows teach.

    Null texts, labels other than 0 and 1, and labels without a document teach
    nothing. A document with both labels counts as toxic; of rows that share a
    doc_id the text with the smallest hash teaches, so that repeats can't
    outgrow the sample.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn is not None:
        marks = marks.filter(learn)
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = bounded_sample(marks, "toxic", F.col("doc_id"), SAMPLE_ROWS, 3)
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(marks), "doc_id")  # bounded by the sample
        .filter(F.col("text").isNotNull())
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["toxic"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_column(df: DataFrame, model: Model, text: Column) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for texts in batches:
            yield pd.Series(np.concatenate([score(texts.iloc[i : i + 256].tolist()) for i in range(0, len(texts), 256)] or [np.zeros(0)]))

    return scored.asNondeterministic()(text)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``toxicity`` in [0, 1] for every text, whole.

    Null and empty texts get the score of a text without words (the bias).
    Repeated rows get equal scores; df's columns are kept, a clashing
    ``toxicity`` is replaced; an empty table gives an empty table.
    """
    return df.withColumn("toxicity", score_column(df, model, F.col(text)))
