"""Alignment of two tokenizers' tokens, each distinct segment once.

A text is cut before a run of white space wherever neither vocabulary can merge
across the cut: the byte-level BPE splits there by its pattern, and no entry of
either vocabulary holds the two characters side by side. So the tokens of a
text are those of its segments. Distinct segments are counted, tokenised and
aligned once; how often two ids are linked in the corpus follows from their
counts. The alignments of frequent segments, a bounded table, go to all tasks;
those of rarer ones are joined back by segment. What is shuffled of a text is
not the text but the numbers of its segments, the frequent ones by rank, and
equal texts count once; then texts are composed.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot

FREQUENT = 350_000
"""Segments whose alignments go to all tasks, those of up to LONGEST characters that occur most."""
LONGEST = 64
SENT_PAIRS = 1_000_000
"""Id pairs whose counts go to all tasks, those linked most; rarer ones are joined."""
HELD = 400_000
"""Distinct segments that a task counts before it passes them on."""
COMPOSED = 1 << 19
"""Bytes of numbered segments that are composed at once."""
SPACES = " \t\n\r\x0b\x0c"
NEVER_AFTER = "\u180e\u200b\u2060\ufeff"
"""Beside white space, characters that some tables class as such: no cut after them."""
PIECE_SPACE = "\u2581"


def byte_symbols() -> dict[str, int]:
    """The byte that each character of byte-level BPE stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """Both vocabularies, without added spaces, and what follows from them: where not to cut, and characters that B doesn't keep."""

    a: str
    b: bytes
    odd: str
    unsafe: list[tuple[str, str]]
    _ready: tuple | None = field(default=None, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _start(self) -> tuple:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(self.a)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        b = SentencePieceProcessor(model_proto=self.b)
        bytes_a = [token_bytes_a(a.id_to_token(i)) for i in range(a.get_vocab_size())]
        bytes_b = [token_bytes_b(b, i) for i in range(b.get_piece_size())]
        odd = re.compile("[" + re.escape(self.odd) + "]") if self.odd else None
        self._ready = a, b, bytes_a, bytes_b, odd, *self._cuts()
        return self._ready

    def _cuts(self) -> tuple:
        """How to cut texts with usual white space, which texts have other white space, and how to cut those."""
        before: dict[str, str] = {}
        for c, space in self.unsafe:
            before[space] = before.get(space, "") + c
        at = "|".join(f"(?<![\\s{NEVER_AFTER}{re.escape(before.get(s, ''))}])(?={re.escape(s)})" for s in SPACES)
        usual = "".join(s for s in " \n\t" if s not in before)
        others = "".join(s for s in map(chr, range(0x3001)) if s.isspace() and s not in usual) + NEVER_AFTER
        run = re.escape(usual)
        return re.compile(f"[{run}]*[^{run}]+|[{run}]+").findall, re.compile(f"[{re.escape(others)}]").search, re.compile(at).split

    def fits(self, text: str | None) -> bool:
        """Whether both token sequences of the text spell it."""
        odd = (self._ready or self._start())[4]
        return bool(text) and not (odd and odd.search(text))

    def cut(self, text: str) -> list[str]:
        """The segments of the text with a space before it."""
        usual, other, at = (self._ready or self._start())[5:]
        spaced = " " + text
        return [s for s in at(spaced) if s] if other(text) else usual(spaced)

    def align(self, segments: list[str]) -> list[tuple[list[int], list[int], int, str, list[tuple[int, int]]]]:
        """(ids of A, ids of B, number of groups, the groups as text, links) of each segment."""
        a, b, bytes_a, bytes_b = (self._ready or self._start())[:4]
        out = []
        encode = getattr(a, "encode_batch_fast", a.encode_batch)  # without offsets, where the library has it
        for segment, x, y in zip(segments, encode(segments, add_special_tokens=False), b.encode(segments, num_threads=1), strict=True):
            ids = x.ids
            if not (b"".join([bytes_a[i] for i in ids]) == segment.encode() == b"".join([bytes_b[i] for i in y])):
                raise ValueError(f"the tokens of {segment!r} don't spell it")
            out.append((ids, y, *groups(ids, y, [len(bytes_a[i]) for i in ids], [len(bytes_b[i]) for i in y])))
        return out


def groups(a: list[int], b: list[int], len_a: list[int], len_b: list[int]) -> tuple[int, str, list[tuple[int, int]]]:
    """Number and text of the groups between common ends, and the links: pairs of tokens whose bytes overlap."""
    i = j = n = from_i = from_j = 0
    end_a, end_b, told, links = len_a[0], len_b[0], [], []
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            told.append(",".join(map(str, a[from_i : i + 1])) + "|" + ",".join(map(str, b[from_j : j + 1])))
            n, i, j = n + 1, i + 1, j + 1
            if i == len(a):
                return n, ";".join(told), links
            from_i, from_j, end_a, end_b = i, j, end_a + len_a[i], end_b + len_b[j]
        elif end_a < end_b:
            i += 1
            end_a += len_a[i]
        else:
            j += 1
            end_b += len_b[j]


_SYMBOLS = byte_symbols()


def token_bytes_a(token: str) -> bytes:
    return bytes(_SYMBOLS[c] for c in token) if all(c in _SYMBOLS for c in token) else token.encode()


def token_bytes_b(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(PIECE_SPACE, " ").encode()


def prepare(path_a: str, path_b: str) -> Vocabularies:
    """Read the byte-level BPE at ``path_a`` and the sentencepiece BPE at ``path_b``, on the driver only, and verify what cutting needs.

    Refused: an A with a normalizer or another pattern than byte-level BPE's, a
    B that changes texts before it splits them, or that matches own symbols.
    """
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(path_a, encoding="utf-8") as f:
        a = f.read()
    with open(path_b, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    config, spec = json.loads(a), model.normalizer_spec
    pre = config.get("pre_tokenizer") or {}
    if config.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("A must be byte-level BPE without normalizer and prefix space")
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("B must be BPE with byte fallback, without normalization and own symbols")
    spec.add_dummy_prefix = False  # the space is in the segment
    b = model.SerializeToString()
    entries = [token_bytes_a(t).decode("utf-8", "ignore") for t in config["model"]["vocab"]] + [p.piece.replace(PIECE_SPACE, " ") for p in model.pieces if p.type == kinds.NORMAL]
    unsafe = sorted({(e[k - 1], e[k]) for e in entries for k in range(1, len(e)) if e[k] in SPACES and not e[k - 1].isspace()})
    return Vocabularies(a, b, _not_kept(SentencePieceProcessor(model_proto=b)), unsafe)


def _not_kept(model) -> str:
    """Characters that B's tokens don't spell as they are, by trying all of them."""
    spelled = lambda text: b"".join(token_bytes_b(model, i) for i in model.encode(text))
    known = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) != "Cn"]
    bad = []
    for at in range(0, len(known), 2048):
        part = "".join(known[at : at + 2048])
        if spelled(part) != part.encode():
            bad += [c for c in part if spelled(f"x{c}x") != f"x{c}x".encode()]
    return "".join(bad)


def _counted(batches: Iterator[pa.RecordBatch], words: Vocabularies) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["segment", "n"])
        held.clear()
        return out

    for b in batches:
        for text in b.column(0):
            if words.fits(t := text.as_py()):
                held.update(words.cut(t))
            if len(held) > HELD:
                yield batch()
    yield batch()


def _aligned(batches: Iterator[pa.RecordBatch], words: Vocabularies) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            found = words.align(b.column(0).to_pylist())
            ints = lambda k, f: pa.array([f(x[k]) for x in found], pa.int64())
            links = pa.array([[p << 32 | q for p, q in x[4]] for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ints(0, len), ints(1, len), ints(2, int), pa.array([x[3] for x in found], pa.string()), links], ["segment", "n", "n_a", "n_b", "n_groups", "groups", "links"])


SEGMENT = "segment string, n long, n_a long, n_b long, n_groups long, groups string, links array<long>"


def _told(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments with the sums over links whose pairs were sent, and the other links."""
    for b in batches:
        links = b.column("links")
        flat, ends = links.flatten().to_numpy(), np.cumsum(links.value_lengths().to_numpy())
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
        here = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
        add = lambda v: np.add.reduceat(np.where(here, v[at], 0).astype(np.int64), starts) if len(pairs) else np.zeros(len(starts), np.int64)
        rest = [flat[s:e][~here[s:e]].tolist() if not here[s:e].all() else [] for s, e in zip(starts, ends, strict=True)]
        keep = [b.column(c) for c in ("id", "segment", "n", "n_a", "n_b", "n_groups", "groups")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(add(best).astype(np.int64)), pa.array(add(counts).astype(np.int64)), pa.array(rest, pa.list_(pa.int64()))], ["id", "segment", "n", "n_a", "n_b", "n_groups", "groups", "n_best", "count_sum", "rest"])


def most(df: DataFrame, count: str, limit: int) -> int:
    """The least number such that at most ``limit`` rows of ``df`` have a ``count`` of at least it, from counts of rows by size."""
    step = F.when(F.col(count) < 64, F.col(count)).otherwise(64 + F.floor(16 * F.log2(F.col(count) / 64))).cast("int")
    rows = 0
    least = None
    for r in df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min(count).alias("least")).orderBy(F.desc("step")).collect():
        rows += r.k
        if rows > limit:
            break
        least = r.least
    return (1 << 62) if least is None else least


def _written(df: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, str]:
    """A scratch table, compressed more than usual, as these hold many short texts."""
    path = scratch.path(name)
    df.write.option("compression", "zstd").parquet(path)
    return scratch.spark.read.schema(df.schema).parquet(path), path


def segments_of(docs: DataFrame, shared: Broadcast, scratch: Scratch, text: str = "text") -> tuple[DataFrame, str]:
    """Each distinct segment with its number of occurrences and its alignment. ``shared``: the sent Vocabularies."""
    counted = docs.select(text).mapInArrow(lambda batches: _counted(batches, shared.value), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    return _written(counted.mapInArrow(lambda batches: _aligned(batches, shared.value), SEGMENT), scratch, "segments")


def pair_counts(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair, count, best): how many links of the corpus join two ids, A's in the high half, and whether that is the most of B's id."""
    counts, _ = scratch.write(segments.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    told, _ = scratch.write(counts.withColumn("b", b).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best")), "pair-counts")
    return told


def weighed(segments: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """Segments with n_best and count_sum: links whose pair is its B id's most frequent one, and the sum of all links' counts."""
    pairs = pair_counts(segments, scratch)
    sent = pairs.filter(F.col("count") >= most(pairs, "count", SENT_PAIRS)).orderBy("pair").toArrow()
    shared = segments.sparkSession.sparkContext.broadcast([sent.column(c).to_numpy().astype(kind) for c, kind in (("pair", np.int64), ("count", np.int64), ("best", np.int8))])
    columns = "id long, segment string, n long, n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long, rest array<long>"
    told, path = _written(segments.withColumn("id", F.monotonically_increasing_id()).mapInArrow(lambda batches: _told(batches, *shared.value), columns), scratch, "weighed")
    open_ = told.filter(F.size("rest") > 0)
    if open_.isEmpty():
        return told.drop("id", "rest"), path
    rest = open_.select("id", F.explode("rest").alias("pair")).join(pairs, "pair").groupBy("id").agg(F.sum("best").alias("_best"), F.sum("count").alias("_sum"))
    all_ = told.drop("rest").join(rest, "id", "left")
    sums = [(F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")]
    whole, at = _written(all_.select("segment", "n", "n_a", "n_b", "n_groups", "groups", *sums), scratch, "summed")
    scratch.drop(path)
    return whole, at


SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


@dataclass
class Frequent:
    """Alignments of frequent segments, the most frequent first: sums by row, and the groups, a separator after each, as one text with the ends of each."""

    segments: str
    sums: list[np.ndarray]
    groups: bytes
    ends: np.ndarray
    _ready: dict | None = field(default=None, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def rows(self) -> dict[str, int]:
        if self._ready is None:
            self._ready = {s: i for i, s in enumerate(self.segments.split("\0"))} if len(self.ends) > 1 else {}
        return self._ready

    def texts(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends), pa.py_buffer(self.groups)])


def frequent(told: DataFrame) -> tuple[Frequent, int]:
    """The segments that go to all tasks, and the least count of those."""
    short = told.filter((F.length("segment") <= LONGEST) & ~F.contains("segment", F.lit("\0")))
    least = most(short, "n", FREQUENT)
    rows = short.filter(F.col("n") >= least).select("segment", "n", *SUMS, "groups").toArrow()
    rows = rows.take(np.argsort(-rows.column("n").to_numpy(), kind="stable"))
    texts = rows.column("groups").combine_chunks().cast(pa.large_binary())
    ends = np.concatenate([[0], np.cumsum(1 + pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    # LONGEST characters have at most 4 bytes, and so tokens and links, each
    sums = [rows.column(c).to_numpy().astype(np.int64 if c == "count_sum" else np.int16) for c in SUMS]
    return Frequent("\0".join(rows.column("segment").to_pylist()), sums, b"".join(t + b";" for t in texts.to_pylist()), ends.astype(np.int64)), least


def to_code(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2^35 as bytes of 7 bits, low ones first, all but a number's last with the high bit set."""
    n = numbers.astype(np.uint64)
    sizes = 1 + sum((n >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for k in range(5):
        here = sizes > k
        out[starts[here] + k] = ((n[here] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(sizes[here] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_code(code: bytes) -> np.ndarray:
    raw = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


def _others(segments: list[str], rows: dict[str, int]) -> dict[str, int]:
    """A text's segments without a row, numbered in order of place."""
    return {s: i for i, s in enumerate(dict.fromkeys(filterfalse(rows.__contains__, segments)))}


def _numbered(segments: list[str], rows: dict[str, int]) -> np.ndarray:
    """Numbers of a text's segments: row r is 2 r, the i-th of the others 2 i + 1."""
    other = _others(segments, rows)
    found = np.fromiter((-1 if r is None else r for r in map(rows.get, segments)), np.int64, len(segments))
    numbers = 2 * found
    if other:
        gone = np.flatnonzero(found < 0)
        numbers[gone] = [2 * other[segments[k]] + 1 for k in gone.tolist()]
    return numbers


def _missed(batches: Iterator[pa.RecordBatch], words: Vocabularies, known: Frequent) -> Iterator[pa.RecordBatch]:
    """(k, l, text) to the text's segments that ``known`` lacks, numbered."""
    rows = known.rows()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            from_, numbers, found = [], [], []
            for i in range(b.num_rows):
                if words.fits(t := b.column(2)[i].as_py()):
                    other = _others(words.cut(t), rows)
                    from_ += [i] * len(other)
                    numbers += range(len(other))
                    found += other
            keys = [b.column(c).take(pa.array(from_, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(numbers, pa.int32()), pa.array(found, pa.string())], ["k", "l", "i", "segment"])


def _coded(batches: Iterator[pa.RecordBatch], words: Vocabularies, known: Frequent) -> Iterator[pa.RecordBatch]:
    """(k, l, text) to (k, l, code) of texts that have tokens."""
    rows = known.rows()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            codes = [to_code(_numbered(words.cut(t), rows)) if words.fits(t := x.as_py()) else None for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], ["k", "l", "code"])


def _portions(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about COMPOSED bytes together, or of one row."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // COMPOSED)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True))


def _own(rest: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """Where each text's alignments start in the order of their numbers, the sums of each in this order, and the groups."""
    starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rest), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    number, groups_, best, count = rest.flatten().flatten()
    order = np.empty(len(number), np.int64)
    order[np.repeat(starts[:-1], np.diff(starts)) + number.to_numpy()] = np.arange(len(number))
    groups_ = groups_.take(pa.array(order))
    occur = lambda texts, x: pc.count_substring(texts, x).to_numpy().astype(np.int64)
    n = occur(groups_, ";") + 1
    commas, of_a = occur(groups_, ","), occur(pc.replace_substring_regex(groups_, r"\|[^;]*", ""), ",")
    return starts, [n + of_a, n + commas - of_a, n, best.to_numpy()[order], count.to_numpy()[order]], pc.binary_join_element_wise(groups_, "", ";").cast(pa.large_binary())


def _composed(batches: Iterator[pa.RecordBatch], known: Frequent) -> Iterator[pa.RecordBatch]:
    """(k, l, n, code, rest) to the sums and the groups' digest; ``rest`` has the alignments that ``known`` lacks.

    Many texts are composed at once: their segments' sums are looked up
    together, and the groups are laid end to end in one buffer.
    """
    frequent_ = known.texts()
    for whole in batches:
        for start, end in _portions(pc.binary_length(whole.column(3)).to_numpy(zero_copy_only=False)) if whole.num_rows else ():
            b = whole.slice(start, end - start)
            code = b"".join(b.column(3).to_pylist())
            bytes_ = np.cumsum(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False))
            first = np.concatenate([[0], np.cumsum(np.frombuffer(code, np.uint8) < 128)[bytes_ - 1]])
            numbers = from_code(code)
            starts, sums_of, own = _own(b.column(4))
            row, other = numbers >> 1, np.flatnonzero(numbers & 1)
            hit = np.flatnonzero(numbers & 1 == 0)
            row[other] += np.repeat(starts[:-1], np.diff(first))[other]
            sums = []
            for here, there in zip(known.sums, sums_of, strict=True):
                values = np.empty(len(row), np.int64)
                values[hit], values[other] = here[row[hit]], there[row[other]]
                sums.append(pa.array(np.add.reduceat(values, first[:-1])))
            row[other] += len(frequent_)
            laid = pa.concat_arrays([frequent_, own]).take(pa.array(row))
            ends = np.frombuffer(laid.buffers()[1], np.int64)[first].tolist()
            text = memoryview(laid.buffers()[2])
            digests = [hashlib.sha256(text[x : y - 1]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]  # without the last separator
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *sums, pa.array(digests, pa.string())], ["k", "l", "n", *SUMS, "groups_sha256"])


def aligned_documents(docs: DataFrame, words: Vocabularies, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    Texts that are null, empty, or hold a character that B doesn't keep have no
    tokens: zeros and an empty digest, and no part in the counts. Repeated rows
    count each and get equal results; null keys stay; ties for a B id's most
    frequent pair all count as best; an empty table gives an empty table; other
    columns aren't read.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(words)
    segments, path = segments_of(docs, shared, scratch, text)
    told, told_path = weighed(segments, scratch)
    scratch.drop(path)
    table, least = frequent(told)
    known = context.broadcast(table)
    by = ["k", "l"]  # a text's name, 128 bits
    names = [F.xxhash64(text).alias("k"), F.xxhash64(F.lit(11), text).alias("l")]
    texts = docs.select(*names, F.col(text).alias("text"))
    missed = texts.mapInArrow(lambda batches: _missed(batches, shared.value, known.value), "k long, l long, i int, segment string")
    others = told.filter((F.col("n") < least) | (F.length("segment") > LONGEST) | F.contains("segment", F.lit("\0"))).select("segment", "groups", "n_best", "count_sum")
    # a segment that wasn't sent is rare or long: no key of this join is a large share of its rows
    rest = missed.join(others, "segment").groupBy(*by).agg(F.collect_set(F.struct("i", "groups", "n_best", "count_sum")).alias("rest"))
    coded = texts.mapInArrow(lambda batches: _coded(batches, shared.value, known.value), "k long, l long, code binary").filter("code is not null")
    once = coded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("code").alias("code"))
    both = once.join(rest, by, "left").select(*by, "n", "code", "rest")
    found, _ = scratch.write(both.mapInArrow(lambda batches: _composed(batches, known.value), "k long, l long, n long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string"), "composed")
    scratch.drop(told_path)
    out = join_hot(docs.select(F.col(key).alias("key"), *names), found, by, scratch, how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    links = F.coalesce(F.col("n_a") + F.col("n_b") - F.col("n_groups"), F.lit(0)).alias("n_links")  # a group of p and q tokens has p + q - 1 links
    return out.select(F.col("key").alias(key), zero("n_a"), zero("n_b"), zero("n_groups"), links, zero("n_best"), zero("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
