"""Quality rules as a short-circuit cascade, in built-in functions only.

Rules are CASE branches, and a CASE stops at the first that holds, so what a
later branch would measure isn't measured. On a bounded sample each rule's time
a row is estimated, and which rules reject which rows; the rule with most
rejections for its cost goes first, then the one with most among the rows that
are left, and so on. The order changes what is computed, never which texts are
kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

SAMPLE_ROWS = 1000
"""Rows (about) that costs and selectivities are estimated on."""
SAMPLE_PARTS = 8
TIMED_COPIES = 8
"""So often the sample is gone through when a rule is timed, so that its rows and not Spark's start of a job decide."""
LEAST_SECONDS = 1e-3
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words(text: Column) -> Column:
    """Runs of other than ASCII white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def duplicate_lines(found: Column) -> Column:
    return (F.size(found) - F.size(F.array_distinct(found))).cast("long")


def repeated_words(found: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more. ``found`` must be cheap to read, as a bound variable is."""
    windows = F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(found, i, WINDOW)))

    def covered(at: Column) -> Column:
        """Union of windows starting at sorted positions."""
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(pairs, lambda s: covered(F.sort_array(F.transform(twice(s), lambda x: x["i"]))))

    any_twice = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h))
    return F.when(F.size(found) > WINDOW, let(windows, any_twice)).otherwise(F.lit(0)).cast("long")


def letter_words(text: Column) -> Column:
    """Words with a letter."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*")).cast("long")


def bullet_lines(found: Column) -> Column:
    return F.size(F.filter(found, lambda x: x.rlike(r"^[\x20\t]*[-*•]"))).cast("long")


def ellipsis_lines(found: Column) -> Column:
    return F.size(F.filter(found, lambda x: x.rlike(r"(\.\.\.|…)[\x20\t\r]*\z"))).cast("long")


def pair_over_fifth(found: Column) -> Column:
    """Whether one pair of adjacent words is over a fifth of the words. ``found`` must be cheap to read.

    A pair that occurs c times leaves at most m - c + 1 different ones of m, so
    that most texts are settled by counting those; only others are sorted.
    """
    n = F.size(found)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get(found, i - 1), F.get(found, i)))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, h: Column) -> Column:
        run = F.when(h == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(h.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    exact = lambda ps: 5 * F.aggregate(F.array_sort(ps), start, step, lambda s: s["best"]) > n
    settled = lambda ps: 5 * (F.size(ps) - F.size(F.array_distinct(ps)) + 1) <= n
    return F.when(n > 1, let(pairs, lambda ps: F.when(settled(ps), F.lit(False)).otherwise(exact(ps)))).otherwise(F.lit(False))


def features(text: Column) -> Column:
    """The measures that are reported of every text in one struct; words and lines are split once."""
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), duplicate_lines(x).alias("n_dup_lines")))
    return let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda f: F.struct(f["w"]["n_words"].alias("n_words"), word_chars(text).alias("word_chars"), symbols(text).alias("n_symbols"), f["l"]["n_lines"].alias("n_lines"), f["l"]["n_dup_lines"].alias("n_dup_lines"), f["w"]["n_repeat_words"].alias("n_repeat_words")),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a getter of measures by name to a boolean column that is never null."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE = (
    Rule("few_words", lambda f: f("n_words") < 20),
    Rule("repeats", lambda f: 100 * f("n_repeat_words") > 30 * f("n_words")),
)
RULES = (
    Rule("short_words", lambda f: f("word_chars") < 2 * f("n_words")),
    Rule("long_words", lambda f: f("word_chars") > 20 * f("n_words")),
    Rule("symbols", lambda f: f("n_symbols") > f("n_words")),
    Rule("duplicate_lines", lambda f: 10 * f("n_dup_lines") > 5 * f("n_lines")),
    Rule("few_letters", lambda f: 2 * f("n_letter_words") < f("n_words")),
    Rule("bullets", lambda f: 10 * f("n_bullet_lines") > 9 * f("n_lines")),
    Rule("ellipses", lambda f: 10 * f("n_ellipsis_lines") > 5 * f("n_lines")),
    Rule("top_pair", lambda f: f("pair_over_fifth")),
)
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: Column, known: Column | None = None) -> Callable[[str], Column]:
    """Each measure straight from the text, so that a branch that isn't reached computes nothing; those in ``known`` (of features()) are read there."""
    own = {
        "n_words": lambda: F.size(words(text)).cast("long"),
        "word_chars": lambda: word_chars(text),
        "n_symbols": lambda: symbols(text),
        "n_lines": lambda: F.size(lines(text)).cast("long"),
        "n_dup_lines": lambda: let(lines(text), duplicate_lines),
        "n_repeat_words": lambda: let(words(text), repeated_words),
        "n_letter_words": lambda: letter_words(text),
        "n_bullet_lines": lambda: bullet_lines(lines(text)),
        "n_ellipsis_lines": lambda: ellipsis_lines(lines(text)),
        "pair_over_fifth": lambda: let(words(text), pair_over_fifth),
    }
    here = {*REPORTED, "n_lines"} if known is not None else set()
    return lambda name: known[name] if name in here else own[name]()


def order(df: DataFrame, scratch: Scratch, text: str = "text", rules: tuple[Rule, ...] = RULES, known: bool = False) -> list[Rule]:
    """The rules, each the one with most rejections for its cost among the sampled rows that those before it leave.

    ``known``: features() are there already and cost nothing. A job over the
    sample that evaluates no rule tells what isn't a rule's own time.
    """
    total = max(1, df.count())
    picked = df.select(F.col(text).alias("text")).filter(F.rand(19) < min(1.0, SAMPLE_ROWS / total)).repartition(SAMPLE_PARTS)
    if known:
        picked = picked.withColumn("known", features(F.col("text")))
    sample, path = scratch.write(picked, "quality-sample")
    get = measure(F.col("text"), F.col("known") if known else None)
    flags = [r.rejects(get).alias(f"r{i}") for i, r in enumerate(rules)]
    met = [(r["n"], [r[f"r{i}"] for i in range(len(rules))]) for r in sample.select(*flags).groupBy(*[f"r{i}" for i in range(len(rules))]).agg(F.count(F.lit(1)).alias("n")).collect()]
    copies = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(TIMED_COPIES))))
    # a text that differs in each copy, so that none is measured once for all of them
    copies = copies.withColumn("text", F.concat("text", F.lit(" "), F.col("copy").cast("string")))

    def seconds(flag: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            copies.agg(F.count_if(flag), F.sum(F.length("text"))).first()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds(F.length("text") < 0) if met else 0.0
    cost = [max(LEAST_SECONDS, seconds(r.rejects(get)) - idle) if met else LEAST_SECONDS for r in rules]
    scratch.drop(path)
    return [rules[i] for i in ranked(met, cost)]


def ranked(met: list[tuple[int, list[bool]]], cost: list[float]) -> list[int]:
    """Order of the rules from how many rows each combination of verdicts has, and what each rule costs."""
    found, left = [], list(range(len(cost)))
    while left:
        rejected = {i: sum(n for n, r in met if r[i] and not any(r[j] for j in found)) for i in left}
        best = min(left, key=lambda i: (-rejected[i] / cost[i], cost[i], i))
        found.append(best)
        left.remove(best)
    return found


def first_failed(ordered: list[Rule], get: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    case = None
    for rule in ordered:
        case = (F if case is None else case).when(rule.rejects(get), F.lit(rule.name))
    return case if case is not None else F.lit(None).cast("string")


def keep_good(df: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """``df`` without the rows that a rule rejects, measuring only as far as the first that does."""
    return df.filter(first_failed(order(df, scratch, text, BASE + RULES), measure(F.col(text))).isNull())


def report(df: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """``df`` with the reported measures of each whole text, base_failed, and kept.

    A text that fails the base isn't judged further; of the others the cascade
    measures only as far as the first rule that rejects. Null and empty texts
    have no words and fail the base. Repeated rows get equal results; df's
    columns are kept, clashing names are replaced; an empty table gives an
    empty table.
    """
    ordered = order(df, scratch, text, known=True)
    own = F.col("__measures")
    base = first_failed(list(BASE), measure(F.col(text), own)).isNotNull()
    judged = df.withColumn("__measures", features(F.col(text)))
    judged = judged.withColumn("__kept", F.when(base, F.lit(False)).otherwise(first_failed(ordered, measure(F.col(text), own)).isNull()))
    added = {n: own[n] for n in REPORTED} | {"base_failed": base, "kept": F.col("__kept")}
    kept = [F.col(c) for c in df.columns if c not in added]
    return judged.select(*kept, *[c.alias(n) for n, c in added.items()])
