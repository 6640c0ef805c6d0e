"""Titles and identity: cleaning, slugs, keys, similarity, kinds and date hints.

NFKC and Ratcliff-Obershelp have no built-in form and run in Arrow batches;
everything else is a Catalyst expression.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that are folded, and the patterns that classify.
DASHES = "‐‑‒–—―−"
CURLY = "‘’“” "
STRAIGHT = "''\"\" "
EXAM = r"(?i)\b(exam|midterm|quiz|test)\b|^final\b(?!.*\b(project|paper|essay|portfolio|presentation|report|draft)\b)"
CLASS_ON_PAGE = r"(?i)\b(lecture|class meeting|class session|lab session|recitation|seminar meeting)\b"
CLASS_IN_FEED = r"(?i)\b(lecture|class|lab|recitation|seminar|office hours)\b"
EXAM_IN_MAIL = r"(?i)\b(exam|midterm|quiz|test|final)\b"
DATE_HINT = (
    r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b"
    r"|\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b"
    r"|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b|\b\d{4}-\d{2}-\d{2}\b"
    r"|\btb[ad]\b|\b(?:mon|tues?|wed|thur?s?|fri|sat|sun)[a-z]*day|\bweek of\b|\b(?:before|in|after) class\b"
)


def clean(s: str | None) -> str:
    """NFKC, plain dashes and quotes, single spaces."""
    if not s:
        return ""
    if s.isascii():  # which NFKC leaves alone
        return " ".join(s.split())
    return " ".join(unicodedata.normalize("NFKC", s).translate(_FOLD).split())


_FOLD = {ord(d): "-" for d in DASHES} | {ord(a): b for a, b in zip(CURLY, STRAIGHT, strict=True)}


def clean_text(c: Column) -> Column:
    """clean() of each string; ASCII strings, which NFKC leaves alone, take the built-in way and never meet Python."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(clean, na_action=None)

    ascii_ = F.coalesce(c, F.lit("")).rlike(r"^[\x00-\x7F]*\z")
    return F.when(ascii_, clean_ascii(c)).otherwise(F.pandas_udf(run, "string")(F.when(~ascii_, c)))


def clean_ascii(c: Column) -> Column:
    """clean() for text known to be ASCII, built in."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x1c-\x1f]+", " "))


def slug(cleaned: Column) -> Column:
    """Lower-case ASCII words and digits of cleaned text, one space between."""
    return F.trim(F.regexp_replace(F.lower(cleaned), r"[^a-z0-9]+", " "))


def item_key(course_id: Column, cleaned_title: Column) -> Column:
    return F.concat_ws("::", course_id, slug(cleaned_title))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the words of two slugs; 0 if either is empty."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio, (previous, current) in that order."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(jaccard(a, b), sequence_ratio(a, b))


LETTERS = b" 0123456789abcdefghijklmnopqrstuvwxyz"
_CODES = np.full(256, len(LETTERS) + 1, np.int64)
_CODES[0] = 0  # what fills a short slug up
_CODES[list(LETTERS)] = range(1, len(LETTERS) + 1)
BITS = 64


def _rows(slugs: list[str]) -> np.ndarray:
    """Codes of the characters of slugs, a row each, 0 after the end."""
    at = np.array(slugs, dtype="S")
    return _CODES[at.view(np.uint8).reshape(len(slugs), -1)]


def common(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of slugs, of which that of ``x`` has at most BITS characters: a bit for each, all pairs at once."""
    codes, distinct = pd.factorize(np.array(x, dtype=object))
    shorts = _rows(list(distinct))
    width = len(LETTERS) + 2
    places = np.zeros((len(distinct), width), np.uint64)
    rows = np.arange(len(distinct))
    for k in range(shorts.shape[1]):
        places[rows, shorts[:, k]] |= np.uint64(1 << k)
    places[:, 0] = 0
    flat, base, left = places.ravel(), codes * width, np.full(len(x), 2**64 - 1, np.uint64)
    for k in np.ascontiguousarray(_rows(y).T):
        met = left & flat[base + k]
        left = (left + met) | (left - met)
    return np.bitwise_count(~left)


def ratios_from(x: list[str | None], y: list[str | None], least: float) -> np.ndarray:
    """Ratcliff-Obershelp ratio of each pair of slugs, exact where it is at least ``least``, else 0 or less than ``least``.

    What it matches is a common subsequence, so the length of the longest one
    rules most pairs out at a hundredth of the time.
    """
    out = np.zeros(len(x))
    open_ = np.array([bool(p and q) for p, q in zip(x, y, strict=True)], dtype=bool)
    short = np.array([bool(o) and min(len(p), len(q)) <= BITS for o, p, q in zip(open_, x, y, strict=True)], dtype=bool)
    at = np.flatnonzero(short)
    if len(at):
        pairs = [(x[k], y[k]) if len(x[k]) <= len(y[k]) else (y[k], x[k]) for k in at]
        p, q = map(list, zip(*pairs, strict=True))
        sizes = np.fromiter((len(a) + len(b) for a, b in pairs), np.int64, len(pairs))
        open_[at[2.0 * common(p, q) / sizes < least]] = False
    for k in np.flatnonzero(open_):
        out[k] = SequenceMatcher(None, x[k], y[k]).ratio()
    return out


def words(slug_: Column) -> Column:
    return F.array_distinct(F.split(slug_, " "))


def length_bound(x: Column, y: Column) -> Column:
    """No matching of two slugs has more characters than the shorter one: what sequence_ratio() can't exceed. x, y: (_s, ...)."""
    m, n = F.length(x["_s"]), F.length(y["_s"])
    return F.coalesce(2.0 * F.least(m, n) / F.nullif(m + n, F.lit(0)), F.lit(0.0))


def shared_words(x: Column, y: Column) -> Column:
    """jaccard() of two slugs whose words are known. x, y: (_s, _words)."""
    common = F.size(F.array_intersect(x["_words"], y["_words"]))
    return F.when((x["_s"] == "") | (y["_s"] == ""), F.lit(0.0)).otherwise(common / (F.size(x["_words"]) + F.size(y["_words"]) - common))


def similarity_from(x: Column, y: Column, least: float = 0.0) -> Column:
    """similarity() of (_s, _words), exact where it is at least ``least``; Python sees only pairs whose letters may decide, and compares few of them letter by letter."""

    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(ratios_from(p.tolist(), q.tolist(), least), dtype="float64")

    open_ = length_bound(x, y) >= F.greatest(shared_words(x, y), F.lit(least))
    return F.greatest(shared_words(x, y), F.pandas_udf(run, "double")(F.when(open_, x["_s"]), F.when(open_, y["_s"])))


def is_exam(title: Column) -> Column:
    return title.rlike(EXAM)


def kind_on_page(title: Column, section: Column) -> Column:
    return F.when(is_exam(title), "exam").when(title.rlike(CLASS_ON_PAGE), "class").when(section == "announcements", "announcement").otherwise("assignment")


def kind_in_feed(title: Column) -> Column:
    return F.when(is_exam(title), "exam").when(title.rlike(CLASS_IN_FEED), "class").otherwise("assignment")


def kind_in_mail(title: Column) -> Column:
    return F.when(title.rlike(EXAM_IN_MAIL), "exam").otherwise("announcement")


def has_date_hint(text: Column) -> Column:
    return text.rlike(DATE_HINT)


def mention_score(title_slug: Column, text_slug: Column) -> Column:
    """1 if the title's words occur as they are, 0.8 if all its words do, 0.6 if all but its numbers do."""
    words, said = F.split(title_slug, " "), F.split(text_slug, " ")
    number = lambda w: w.rlike(r"^\d+$")
    core = F.filter(words, lambda w: ~number(w))
    every = (F.size(core) > 0) & F.forall(core, lambda w: F.array_contains(said, w))
    return (
        F.when((title_slug == "") | (text_slug == ""), 0.0)
        .when(F.instr(text_slug, title_slug) > 0, 1.0)
        .when(every & ~F.exists(words, number), 0.8)
        .when(every, 0.6)
        .otherwise(0.0)
    )


def summary(kind: Column, title: Column, course: Column) -> Column:
    lead = F.when(kind == "exam", "Exam: ").when(kind == "class", "").otherwise("Due: ")
    return F.concat(lead, title, F.lit(" ("), course, F.lit(")"))


def clean_url(url: Column) -> Column:
    """Without the values and names of session parameters; left-over separators stay within."""
    bare = F.regexp_replace(url, r"([?&])(sid|session|token|_t)=[^&]*", "$1")
    return F.regexp_replace(bare, r"[?&]+$", "")


def absolute_url(url: Column, page: Column) -> Column:
    return F.when(url.startswith("/"), F.concat(F.regexp_extract(page, r"^(https?://[^/]+)", 1), url)).otherwise(url)
