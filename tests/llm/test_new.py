"""Alignment, MinHash and spelling variants against brute force and on hard rows."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import CLASH, DOCS, HARD, SF

from coursewatch.llm import alignment, common, minhash, queries, spelling
from coursewatch.llm.common import Scratch


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS).withColumns({c: F.lit("clash") for c in [*CLASH, "word", "n", "key", "k", "segment", "node"]})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


# --- alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    return alignment.prepare(*(str(public_tokenizers.path(n)) for n in (queries.TOKENIZER, queries.PIECES)))


def whole_tokens(texts):
    """(ids, bytes) by A and B of each whole text, straight from the libraries; None where they don't spell it."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(str(public_tokenizers.path(queries.TOKENIZER)))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(queries.PIECES)))
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbol, extra = {chr(c): c for c in plain}, 0
    for byte in range(256):
        if byte not in plain:
            symbol[chr(256 + extra)], extra = byte, extra + 1
    for text in texts:
        if not text:
            yield None
            continue
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_a = [bytes(symbol[c] for c in t) for t in x.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        spells = b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b)
        yield (x.ids, bytes_a, y, bytes_b) if spells else None


def brute_alignment(texts):
    """Rows of the contract by looking at all pairs of tokens of each text."""
    told, count = [], Counter()
    for tokens in whole_tokens(texts):
        if tokens is None:
            told.append(None)
            continue
        a, bytes_a, b, bytes_b = tokens
        spans = lambda parts: list(zip(np.cumsum([0, *map(len, parts[:-1])]).tolist(), np.cumsum([len(p) for p in parts]).tolist()))
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        ends_b = {e: j for j, (_, e) in enumerate(at_b)}
        groups, i0, j0 = [], 0, 0
        for i, (_, e) in enumerate(at_a):
            if e in ends_b:
                groups.append((a[i0 : i + 1], b[j0 : ends_b[e] + 1]))
                i0, j0 = i + 1, ends_b[e] + 1
        links, first = [], 0
        for i, (s, e) in enumerate(at_a):
            while at_b[first][1] <= s:
                first += 1
            j = first
            while j < len(at_b) and at_b[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        count.update(links)
        told.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    for t in told:
        if t is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in t[2])
            yield (t[0], t[1], len(t[2]), len(t[3]), sum(count[p] == top[p[1]] for p in t[3]), sum(count[p] for p in t[3]), hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a  b \n c", "tabs\tand\r\nlines; \r x;\r\n", "{\r}\r", " lead", "trail  ", "\n", " ", "  \n\n ", "nb  sp  x", "᠎ a ​ b﻿ c", "x▁y", "<s> </s> <unk> <0x0A>", "<|endoftext|> a", "日本語 の 文章 です", "👩‍👩‍👧 family", "é é ﬁ", "don't we'll 's", "a\x00b \x1c c\x85d", "x" * 3000, "1234567 8.9e10", "͸  x", "été à la  plage", "a\x0b\x0cb", "\r\r\n", ";\r;\r"]


def test_alignment_equals_brute_force(spark, documents, words, monkeypatch):
    texts = [*documents["text"], *ODD, None, "", *ODD[:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = dict(enumerate(brute_alignment(texts)))
    for few, pairs, held in ((alignment.FREQUENT, alignment.SENT_PAIRS, alignment.HELD), (50, 100, 30)):  # nearly all sent, nearly all joined
        monkeypatch.setattr(alignment, "FREQUENT", few)
        monkeypatch.setattr(alignment, "SENT_PAIRS", pairs)
        monkeypatch.setattr(alignment, "HELD", held)
        out = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.aligned_documents(df, words, Scratch(spark)).collect()}
        wrong = [(texts[k], out[k], expected[k]) for k in expected if out[k] != expected[k]]
        assert not wrong, wrong[:3]
    assert expected[len(documents) + ODD.index("x▁y")][0] == 0


def test_cuts_keep_tokens(words):
    rng = np.random.default_rng(3)
    alphabet = list("ab;{}\r\n\t  \x0b é'1. 日")
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(3000)]
    for text, tokens in zip(texts, whole_tokens(texts), strict=True):
        found = words.align(words.cut(text))
        assert "".join(words.cut(text)) == " " + text
        assert [i for f in found for i in f[0]] == tokens[0] and [i for f in found for i in f[1]] == tokens[2], text
    assert (";", "\r") in words.unsafe and "▁" in words.odd


def test_codes_round_trip():
    rng = np.random.default_rng(4)
    for numbers in ([], [0], [127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**34], rng.integers(0, 1 << 20, 5000)):
        assert alignment.from_code(alignment.to_code(np.array(numbers, np.int64))).tolist() == list(numbers)


def test_texts_are_composed_together(monkeypatch):
    rng = np.random.default_rng(5)
    few = [f"{i}|{i},{2 * i + 1};{i},7|3" for i in range(1000)]
    ends = np.cumsum([0, *[len(g) + 1 for g in few]]).astype(np.int64)
    sums = [np.full(1000, 3, np.int16), np.full(1000, 3, np.int16), np.full(1000, 2, np.int16), np.arange(1000, dtype=np.int16), np.arange(1000) << 40]
    known = alignment.Frequent("", sums, "".join(g + ";" for g in few).encode(), ends)
    texts = []
    for k in range(400):
        own = [{"i": i, "groups": f"{k}|{i},5;8,{k},9|1", "n_best": i, "count_sum": (k + i) << 40} for i in rng.permutation(k % 60).tolist()]
        numbers = [2 * int(x) for x in rng.integers(0, 1000, 400)] + [2 * r["i"] + 1 for r in own for _ in range(2)]
        texts.append((k, -k, 1, rng.permutation(numbers).tolist(), own or None))
    row = pa.struct([("i", pa.int32()), ("groups", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    columns = [pa.array([t[c] for t in texts], pa.int64()) for c in range(3)]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([alignment.to_code(np.array(t[3])) for t in texts]), pa.array([t[4] for t in texts], pa.list_(row))], ["k", "l", "n", "code", "rest"])

    def alone(numbers, own):
        mine = {r["i"]: (r["groups"], (4, 3, 2, r["n_best"], r["count_sum"])) for r in own or ()}
        found = [mine[x >> 1] if x % 2 else (few[x >> 1], tuple(int(v[x >> 1]) for v in sums)) for x in numbers]
        return (*map(sum, zip(*[f[1] for f in found], strict=True)), hashlib.sha256(";".join(f[0] for f in found).encode()).hexdigest())

    expected = [(*t[:3], *alone(*t[3:])) for t in texts]
    for most in (1, 5000, 1 << 19):
        monkeypatch.setattr(alignment, "COMPOSED", most)
        got = [tuple(r.values()) for b in alignment._composed(iter([batch.slice(0, 0), batch.slice(0, 7), batch.slice(7)]), known) for r in b.to_pylist()]
        assert got == expected
    # segments aren't gone through one by one in Python
    seconds = []
    for work in (lambda: list(alignment._composed(iter([batch]), known)), lambda: [alone(alignment.from_code(c.as_py()).tolist(), o.as_py()) for c, o in zip(batch.column(3), batch.column(4), strict=True)]):
        times = []
        for _ in range(3):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        seconds.append(min(times))
    assert seconds[0] < 0.25 * seconds[1], seconds


def test_alignment_on_hard_rows(spark, hard, empty, words):
    rows = alignment.aligned_documents(hard, words, Scratch(spark)).collect()
    expected = Counter(zip([r[0] for r in HARD], brute_alignment([r[1] for r in HARD]), strict=True))
    assert Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in rows) == expected
    assert alignment.aligned_documents(empty, words, Scratch(spark)).count() == 0


# --- MinHash -----------------------------------------------------------------


def sets_of(texts):
    low = {i: i + 32 for i in range(65, 91)}
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        yield {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_components(ids, texts):
    sets, parent = list(sets_of(texts)), {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if sets[x] and sets[y] and min(len(sets[x]), len(sets[y])) * 100 >= 80 * max(len(sets[x]), len(sets[y])) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = top(ids[x]), top(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), top(i)) for i, s in zip(ids, sets, strict=True)}


def noisy(rng, text, share):
    w = text.split()
    for k in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[k] = f"noise{rng.integers(1 << 30)}"
    return " ".join(w)


def planted(documents):
    """The documents, copies with 1 to 6 % of words changed, and a dense group about one text."""
    rng = np.random.default_rng(5)
    texts = documents["text"].tolist()
    long = [t for t in texts if len((t or "").split()) > 60]
    near = [noisy(rng, t, s) for t in long[:40] for s in (0.01, 0.03, 0.05, 0.06)]
    seed = " ".join(f"w{i}" for i in range(150))
    dense = [noisy(rng, seed, s) for s in rng.uniform(0.005, 0.08, 150)]
    return [*texts, *near, *dense, *dense[:20], "a b", "A  b", "c", None, "", " \n"]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_minhash_equals_brute_force(spark, documents, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(minhash, "BLOCK", 16)
        monkeypatch.setattr(minhash, "VERIFY_DOCUMENTS", 16)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = planted(documents)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component) for r in minhash.near_duplicates(df, Scratch(spark)).collect()}
    expected = brute_components(range(len(texts)), texts)
    assert {k: (out[k], v) for k, v in expected.items() if out[k] != v} == {}
    assert sum(v[1] != k for k, v in expected.items()) > 100


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 4000
        both = rng.integers(0, 1 << 63, int(n * share), np.uint64)
        pair = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (n - len(both)) // 2, np.uint64)])) for _ in range(2)]
        true = len(both) / (len(pair[0]) + len(pair[1]) - len(both))
        a, b = minhash.packed(minhash.minima(pair))
        assert abs(minhash.similarity(minhash.agreements(a[None], b[None]))[0] - true) < 0.17
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 3, 200_000, 5)]
    by_hand = [[int(np.min(s * odd) >> np.uint64(32)) for odd in minhash._ODD] for s in sets]
    assert minhash.minima(sets).tolist() == by_hand
    assert 80 < minhash.FEWEST < 95


def test_minhash_on_hard_rows(spark, hard, empty):
    rows = minhash.near_duplicates(hard, Scratch(spark)).collect()
    told = Counter((r.doc_id, r.n_shingles, r.component) for r in rows)
    assert told == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (None, 2, None): 1, (5, 4, 5): 2, (6, 1, 6): 1, (7, 4, 7): 1, (8, 1, 8): 1, (9, 1, 9): 1})
    assert minhash.near_duplicates(empty, Scratch(spark)).count() == 0
    same = spark.createDataFrame([(4, "one two three four five")] * 30 + [(2, "ONE two three\nfour five")] * 30, "doc_id long, text string")
    assert {(r.doc_id, r.component) for r in minhash.near_duplicates(same, Scratch(spark)).collect()} == {(2, 2), (4, 2)}


def test_hot_keys_beyond_what_is_sent_are_salted(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    big = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("x"), F.lit("same").alias("v"))
    small = big.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("x") + 1).filter("x <> 4")
    for how in ("inner", "left"):
        got = common.join_hot(big, small, "x", Scratch(spark), how)
        assert helpers.spark_rows(got) == helpers.spark_rows(big.join(small.drop("n"), "x", how))


# --- spelling variants ---------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count, times=5):
    near = {w: [v for v in count if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= times * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("large", [64, 2])
def test_spelling_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(spelling, "LARGE", large)  # 2: postings are cut down to single places
    rng = np.random.default_rng(9)
    made = {"".join(rng.choice(list("abéß"[:3]), rng.integers(6, 9))) for _ in range(400)}
    made |= {"prefixes" + a + b for a in "abcdé" for b in "xyzÀ"} | {a + b + "suffixes" for a in "abcd" for b in "xyz"} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa"}
    count = {w: int(rng.choice([5, 6, 30, 31, 160, 900])) for w in made}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, Scratch(spark)).collect()}
    assert out == brute_variants(count)


def test_word_counts_equal_loops(spark, documents):
    texts = [*documents["text"], "ÀÉabc×÷ Straße STRASSE abc" * 6, "KelvinK İstanbul", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low, count = {i: i + 32 for i in range(65, 91)}, Counter()
    for k, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{k}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    expected = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in spelling.word_counts(df, damage=199).collect()} == expected


def test_spelling_on_hard_rows(spark, hard, empty):
    rows = {r.word: r.n for r in spelling.word_counts(hard, min_count=1, min_length=1).collect()}
    assert rows["the"] == 40_000 and rows["same"] == 16 and rows["id"] == 1
    assert spelling.variants(spelling.word_counts(empty, damage=199), Scratch(spark)).count() == 0
    told = spelling.variants(spelling.word_counts(hard, min_count=1), Scratch(spark)).collect()
    assert all(r.root == r.word and r.n_near == 0 for r in told)
