"""Spelling variants by an even-partition pigeonhole join.

A word of L letters is indexed by its two even segments: a word of L or L + 1
letters that is one edit away has one of them unchanged, at its place or one
place further. A probe therefore takes the same segments of an equally long
word, and of a word one longer the first segment at its place and the second
one shifted by one. A segment that very many words share is split again: the
half that is still free is cut in two, of which one half must agree as well,
and so on down to a single free place, where the alphabet bounds a posting. So
no posting grows with the square of its words, and none is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
TIMES = 5
"""A form occurs at least so many times as often as its variant."""
LARGE = 64
"""Entries of a posting beyond which its free half is cut once more."""


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", damage: int = 0, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in whole texts, lower-cased in A-Z only, of at least so many letters and occurrences.

    With ``damage`` = d a d-th of all (document, run) lose one letter: those
    whose crc32 of "key:run" d divides, the letter at crc32 % length. A null
    text has no word, a null key counts as empty, repeated rows count each.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), run).filter(F.length("run") >= min_length)
    # lower() would also turn the capitals of U+00C0 to U+00DE
    word = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower("run"))
    words = runs.select("id", word.alias("word"))
    if damage:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("word")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _entry(word: Column, long: Column, size: Column, a: Column, b: Column) -> Column:
    """The posting of a word with indexed places a to b left free; a word one longer leaves one more free."""
    head, tail = F.substring(word, F.lit(1), a), F.substring(word, b + long.cast("int") + 1, F.length(word))
    return F.struct(long.alias("long"), size.alias("size"), a.alias("a"), b.alias("b"), F.xxhash64(size, a, b, head, tail).alias("key"))


def _cut(long: Column, size: Column, a: Column, b: Column) -> Column:
    """The two postings that leave one half of a to b free."""
    mid = (a + F.shiftright(b - a, 1)).cast("int")
    return F.array(_entry(F.col("word"), long, size, a, mid), _entry(F.col("word"), long, size, mid, b))


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, near, near_n), both ways, of all words that one inserted, deleted or replaced code point turns into each other.

    ``words`` has distinct words and any n; null words have no pair; an empty
    table gives none.
    """
    length, zero = F.length("word"), F.lit(0)
    both = F.concat(_cut(F.lit(False), length, zero, length), _cut(F.lit(True), length - 1, zero, length - 1))
    entries, _ = scratch.write(words.filter(length > 1).select("word", "n", F.inline(both)), "entries")
    done = []
    while True:
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("b") - F.col("a")).alias("free"))
        large, _ = scratch.write(sizes.filter((F.col("k") > LARGE) & (F.col("free") > 1)).select("key"), "large")
        if large.isEmpty():
            done.append(entries)
            break
        done.append(entries.join(large, "key", "left_anti").select(entries.columns))
        finer = entries.join(large, "key", "left_semi").select("word", "n", F.inline(_cut(F.col("long"), F.col("size"), F.col("a"), F.col("b"))))
        entries, _ = scratch.write(finer, "finer")
    all_ = done[0]
    for df in done[1:]:
        all_ = all_.unionByName(df)
    probes = all_.select("key", "long", "word", "n")
    index = all_.filter(~F.col("long")).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = probes.join(index, "key").filter((F.col("long") | (F.col("word") > F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
    one_way, _ = scratch.write(met.select("word", "n", "near", "near_n").distinct(), "pairs")
    return one_way.unionByName(one_way.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for (word, form): the last word that forms lead to. Each round doubles the steps taken."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, _ = scratch.write(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, scratch: Scratch, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    form is the near word of largest n, the smallest in code-point order on
    ties, where that n is at least ``times`` n; forms end, as n grows by that
    factor at each step. A word without one has null form and form_n and is
    its own root. An empty table gives an empty table.
    """
    words, _ = scratch.write(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    told = words.join(near, "word", "left")
    form_n = -F.col("best.minus")
    fits = form_n >= times * F.col("n")
    told, _ = scratch.write(told.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, form_n).alias("form_n")), "forms")
    led = roots(told.filter("form is not null"), scratch)
    return told.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
